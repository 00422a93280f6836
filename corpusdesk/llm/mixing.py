"""Mixing sources to target weights by weighted fair queueing.

The documents of a source stand in a shuffled order (md5 of the id), which is
gone through up to ``REPEATS`` times.  A document's virtual finish time in a pass is
(words of its source so far, this document and earlier passes included) / (weight of its
source).  All of them are range-sorted by finish time, and the queue is cut at the virtual time at which
the words served reach the budget.  A source that is used up has no more
documents in the queue, so the others share what it would have had.

No queue passes through one task.  Running sums of a source are taken inside small blocks of
the order and carried by two levels of block totals, so a source with a third of
all rows is spread over all tasks.  Of the global order only the totals of its ranges
are summed up, and one range, ``RANGE`` rows on average, is read to find where it ends.
What a document gives until then follows from its own start and finish.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from corpusdesk.llm.common import documents, settle, without

WEIGHTS = (5, 2, 1)  # by the order of the sources, repeating
RANGE = 50_000  # rows of a range of the global order
BUDGET = 1.5  # words of the mix for each word of the sources
REPEATS = 2


def size_of(text):
    """Words between ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def running_sum(df: DataFrame, group: str, order: list[str], value: str, block: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over this row and all earlier ones of its group.

    ``block`` names a string column that does not decrease along ``order``; rows are
    summed inside blocks of its first four characters, blocks inside those of the
    first two.
    """
    df = df.withColumns({"__b1": F.left(block, F.lit(2)), "__b2": F.left(block, F.lit(4))})
    fine = settle(df.groupBy(group, "__b1", "__b2").agg(F.sum(value).alias("__n")), "blocks")
    wide = fine.groupBy(group, "__b1").agg(F.sum("__n").alias("__n"))
    upto = lambda keys, by: Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    wide = wide.select(group, "__b1", F.coalesce(F.sum("__n").over(upto([group], "__b1")), F.lit(0)).alias("__w"))
    fine = fine.withColumn("__f", F.coalesce(F.sum("__n").over(upto([group, "__b1"], "__b2")), F.lit(0))).drop("__n")
    carried = settle(fine.join(wide, [group, "__b1"]).select(group, "__b2", (F.col("__w") + F.col("__f")).alias("__c")), "carried")
    inside = Window.partitionBy(group, "__b2").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (df.drop("__b1").withColumn("__in", F.sum(value).over(inside))
            .join(carried, [group, "__b2"]).withColumn(out, F.col("__in") + F.col("__c")).drop("__b2", "__in", "__c"))


def targets(sources: DataFrame, weights=WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS) -> DataFrame:
    """(s, source, source_size, weight, spent, target) from (s, source, source_size), one row per source.

    A source is used up at the virtual time repeats * size / weight.  Among the
    sources in that order, the budget less what the earlier ones give in all, over the
    weights of the others, is the time at which the queue ends if it ends before the
    next one is used up: the first time that does is ``spent``.
    """
    # one row per source: a single window over them is small
    ranked = sources.withColumn("__r", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1)
    weight = F.get(F.array(*map(F.lit, weights)), F.pmod("__r", F.lit(len(weights))).cast("int"))
    rows = ranked.withColumn("weight", weight.cast("double")).withColumn("__full", F.col("source_size").cast("double") * repeats)
    order = Window.orderBy(F.col("__full") / F.col("weight"), "__r")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    rows = rows.withColumns({"__given": F.coalesce(F.sum("__full").over(before), F.lit(0.0)), "__open": F.sum("weight").over(onward),
                             "__all": F.sum("source_size").over(everything).cast("double") * budget})
    rows = rows.withColumn("__end", (F.col("__all") - F.col("__given")) / F.col("__open"))
    used_up = F.col("__full") / F.col("weight")
    rows = rows.withColumn("spent", F.min(F.when(F.col("__end") <= used_up, F.struct(used_up, "__r", "__end"))).over(everything)["__end"])
    target = F.least(F.col("__full"), F.coalesce(F.col("spent") * F.col("weight"), F.col("__full")))
    return rows.select("s", "source", "source_size", "weight", "spent", target.alias("target"))


#: What the queue is ordered by, the finish time first.
PLACE = ["at", "__s", "__h", "__k", "size", "__x", "pass"]


def passes(queued: DataFrame, repeats: int) -> DataFrame:
    """One row per document and pass: its place with ``at``, the virtual finish time there, and, of the last document of
    a source in the last pass, the weight that leaves the queue with it (``gone``) and all words that the source has given
    (``given``).  Documents without a word have no row."""
    rows = queued.where("size > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    last = (F.col("pass") == repeats - 1) & (F.col("__upto") == F.col("source_size"))
    at = (F.col("__upto") + F.col("pass") * F.col("source_size")) / F.col("weight")
    return rows.select(at.alias("at"), *PLACE[1:], F.when(last, F.col("weight")).otherwise(0.0).alias("gone"),
                       F.when(last, F.col("source_size") * repeats).otherwise(0).alias("given"))


def end_of_queue(queue: DataFrame, weight: float, budget: float):
    """The virtual time at which the range-sorted ``queue`` has served ``budget`` words; None if it never does.

    ``weight`` is that of all sources with words.  Behind a row, the words served are those of
    the sources that have left the queue, and for each unit of weight that is still in it one for each unit of
    the row's finish time: the first words of the documents in service are served by then as well.
    """
    ranges = max(int(queue.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-queue.count() // RANGE))
    ordered = settle(queue.repartitionByRange(ranges, *PLACE).withColumn("range", F.spark_partition_id()), "ordered")
    served = F.col("at") * (F.lit(weight) - F.col("gone_by")) + F.col("given_by")
    totals = ordered.groupBy("range").agg(F.max("at"), F.sum("gone"), F.sum("given"))
    gone, given = 0.0, 0
    for number, at, g, n in sorted(tuple(r) for r in totals.collect()):  # one row per range
        if at * (weight - gone - g) + given + n >= budget:
            upto = Window.partitionBy("range").orderBy(*PLACE).rowsBetween(Window.unboundedPreceding, Window.currentRow)
            rows = ordered.where(F.col("range") == number).withColumns({"gone_by": F.sum("gone").over(upto) + gone, "given_by": F.sum("given").over(upto) + given})
            row = rows.where(served >= budget).orderBy(*PLACE).first()
            # the budget is spent before this row leaves
            return (budget - (row["given_by"] - row["given"])) / (weight - (row["gone_by"] - row["gone"]))
        gone, given = gone + g, given + n
    return None


def queue_of(docs: DataFrame, keep: list[str], key: str, source: str, text: str, weights, budget: float, repeats: int) -> tuple[DataFrame, DataFrame]:
    """(rows with their sums, targets of the sources): ``keep``, __s, __h, __k, __x, size, source_size, weight, target and __upto,
    the words of the source up to and with this document."""
    rows = docs.select(*keep, F.col(key).alias("__key"), F.col(source).cast("string").alias("source__"), F.col(text).cast("string").alias("__text"))
    ident = F.coalesce(F.col("__key").cast("string"), F.lit(""))
    rows = rows.select(*keep, "source__", F.coalesce(F.concat(F.lit("s"), "source__"), F.lit("n")).alias("__s"),
                       size_of(F.col("__text")).alias("size"), F.md5(ident).alias("__h"), ident.alias("__k"),
                       F.coalesce(F.xxhash64("__text"), F.lit(0)).alias("__x"))
    if text not in keep:
        rows = settle(rows, "queue")  # a few numbers per document, so texts are read once
    sources = settle(rows.groupBy(F.col("__s").alias("s")).agg(F.first("source__").alias("source"), F.sum("size").alias("source_size")), "sources")
    shares = settle(targets(sources, weights, budget, repeats).withColumnRenamed("s", "__s"), "targets")
    queued = running_sum(rows.drop("source__"), "__s", ["__h", "__k", "size", "__x"], "size", "__h", "__upto")
    # one row per source, so this side is as small as the list of sources
    return queued.join(shares.select("__s", "source_size", "weight", "target"), "__s"), shares


def mix(docs: DataFrame, keep: list[str], key: str = "doc_id", source: str = "source", text: str = "text",
        weights=WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS) -> DataFrame:
    """``keep`` plus size, source_size, weight, target, taken and finish, the virtual time at which the document is first used up.

    Each document gives ``taken`` words, repeats counted; of a document that is in service when
    the budget is spent only the first words are taken.  A null source is a source of
    its own, after all others; null texts have size and taken 0.  Rows with the same
    key stand next to each other and count each; an empty table gives no rows.
    """
    kept = without(keep, ["size", "source_size", "weight", "target", "taken", "finish"])
    queued, shares = queue_of(docs, kept, key, source, text, weights, budget, repeats)
    if text not in kept:
        queued = settle(queued, "queued")
    total, weight = shares.agg(F.sum("source_size"), F.sum(F.when(F.col("source_size") > 0, F.col("weight")))).first()
    end = end_of_queue(passes(queued, repeats), weight, float(total) * budget) if total else None
    # words of the source that are served at that time; a document has those between its start and its finish
    served = F.lit(repeats) * F.col("source_size") if end is None else F.least(F.floor(F.lit(end) * F.col("weight")), F.lit(repeats) * F.col("source_size"))
    given = lambda p: F.greatest(F.lit(0), F.least(F.col("size"), served - (p * F.col("source_size") + F.col("__upto") - F.col("size"))))
    taken = sum((given(p) for p in range(1, repeats)), given(0))
    return queued.select(*kept, "size", "source_size", "weight", "target", taken.cast("long").alias("taken"), (F.col("__upto") / F.col("weight")).alias("finish"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir), ["doc_id"]).drop("weight", "finish")


#: The same in SQL, from the totals of the sources alone: the sums are taken over each source's whole queue.
OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS r FROM s),
w AS (SELECT *, CAST([5, 2, 1][1 + r % 3] AS DOUBLE) AS weight, CAST(source_size AS DOUBLE) * 2 AS cap FROM r),
o AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS given,
             sum(weight) OVER (ORDER BY cap / weight, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight,
             CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS budget FROM w),
e AS (SELECT *, (budget - given) / open_weight AS ends FROM o),
v AS (SELECT *, (SELECT ends FROM e WHERE ends <= cap / weight ORDER BY cap / weight, r LIMIT 1) AS spent FROM e),
t AS (SELECT source, source_size, least(cap, coalesce(spent * weight, cap)) AS target FROM v),
q AS (SELECT d.doc_id, d.size, t.source_size, t.target,
             CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY h, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       greatest(0, least(size, CAST(floor(target) AS BIGINT) - (upto - size)))
     + greatest(0, least(size, CAST(floor(target) AS BIGINT) - (source_size + upto - size))) AS taken
FROM q
"""


def mixed_documents(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text",
                    weights=WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS) -> DataFrame:
    """The rows of the mix with the columns of ``docs``, range-sorted by virtual finish time.

    A document that the mix takes twice is two rows.  The document at which the budget
    ends is cut behind the last word that is taken; documents of which no word is taken,
    such as null texts, are left out.  An empty table gives no rows.
    """
    columns = docs.columns
    # under names of its own, so that no column of docs can clash
    held = docs.select(*(F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(columns)))
    name = {c: f"__c{i}" for i, c in enumerate(columns)}
    mixed = mix(held, held.columns, name[key], name[source], name[text], weights, budget, repeats)
    body = name[text]
    rows = mixed.where("taken > 0").withColumn("__pass", F.explode(F.sequence(F.lit(0), F.ceil(F.col("taken") / F.col("size")).cast("int") - 1)))
    left = F.col("taken") - F.col("__pass") * F.col("size")
    words = F.regexp_extract_all(F.col(body), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.when(left >= F.col("size"), F.col(body)).otherwise(F.array_join(F.slice(words, F.lit(1), left.cast("int")), ""))
    at = F.col("finish") + F.col("__pass") * F.col("source_size") / F.col("weight")
    rows = rows.select(*(c for c in held.columns if c != body), cut.alias(body), at.alias("__at"))
    ordered = rows.repartitionByRange("__at").sortWithinPartitions("__at")
    return ordered.select(*(F.col(name[c]).cast(docs.schema[c].dataType).alias(c) for c in columns))
