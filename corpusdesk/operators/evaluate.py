"""Retrieval and classifier metrics.

``results`` frames have (suite, method, question_id, pos) with pos 0-based and
null when the target was not found.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from corpusdesk.functions import pii
from corpusdesk.functions.text import fold_blanks, let, lines_of, lower_tr, strip

KS = (1, 3, 7)
SALTS = 16
MAX_PASSAGES, MAX_PASSAGE_CHARS = 20_000, 8 * 1024 * 1024   # passages that go to every task at once
PIECE_ROWS = 100_000    # pairs leave a task in pieces of about so many
TOKEN = re.compile(r"\S+", re.ASCII)
TOLERANCE = 1
ADOPT_NET = 5

# Phrases and figures looked for in replies.
FALLBACK = r"(?iU)öğrenci\s*işlerine\s*(?:danış|başvur)"
CITATION = r"(?iU)madde\s*\d+"
FIGURE = r"(?iU)\d+\s*(?:TL|₺|lira|gün|hafta|ay|yıl|kişi|adet|kredi|%|puan)"
NAME_LEAKS = ("[isim]", "[İsim]", "[ad]", "[Ad]", "{name}", "{{name}}", "[öğrenci adı]")
PROVISIONAL = "GEÇİCİ"


def article_matches(content: Column, article: Column) -> Column:
    """Does the content name the article?  A provisional one is a different article."""
    wanted = article.startswith(PROVISIONAL)
    no = F.when(wanted, F.element_at(F.split(article, r"\s+"), -1)).otherwise(article)
    number = F.concat(F.lit(r"MADDE\s*\Q"), no, F.lit(r"\E\b"))
    flat = fold_blanks(content)
    plain = F.rlike(flat, F.concat(F.lit(rf"(?U)(?<!{PROVISIONAL}\s{{1,4}})"), number))
    provisional = F.rlike(flat, F.concat(F.lit(rf"(?U){PROVISIONAL}\s+"), number))
    return F.when(wanted, provisional).otherwise(plain)


def first_hit_pos(questions: DataFrame, hits: DataFrame, match: Column) -> DataFrame:
    """(question_id, pos): 0-based place of the first hit that satisfies ``match``.

    ``hits`` has (question_id, rank) and whatever ``match`` refers to.
    """
    found = hits.where(match).groupBy("question_id").agg((F.min("rank") - 1).alias("pos"))
    return questions.select("question_id").join(found, "question_id", "left")


def _hit(k: int) -> Column:
    return F.coalesce(F.col("pos") < k, F.lit(False))


def recall_at_k(results: DataFrame, by: list[str], ks: tuple[int, ...] = KS) -> DataFrame:
    cols = [F.count(F.lit(1)).alias("n")]
    for k in ks:
        cols.append(F.count_if(_hit(k)).alias(f"hits_{k}"))
        cols.append(F.round(F.coalesce(F.avg(_hit(k).cast("double")), F.lit(0.0)), 4).alias(f"recall_{k}"))
    return results.groupBy(*by).agg(*cols)


def mrr(results: DataFrame, by: list[str]) -> DataFrame:
    value = F.coalesce(F.lit(1.0) / (F.col("pos") + 1), F.lit(0.0))
    return results.groupBy(*by).agg(F.round(F.coalesce(F.avg(value), F.lit(0.0)), 4).alias("mrr"))


def misses(results: DataFrame, k: int) -> DataFrame:
    return results.where(~_hit(k))


def paired_outcomes(before: DataFrame, after: DataFrame, k: int) -> DataFrame:
    """Per common question: improved, broken or unchanged."""
    old, new = F.coalesce(F.col("old_pos") < k, F.lit(False)), F.coalesce(F.col("new_pos") < k, F.lit(False))
    return before.select("question_id", F.col("pos").alias("old_pos")).join(
        after.select("question_id", F.col("pos").alias("new_pos")), "question_id"
    ).withColumn("outcome", F.when(new & ~old, "improved").when(old & ~new, "broken").otherwise("unchanged"))


def paired_diff(before: DataFrame, after: DataFrame, k: int) -> DataFrame:
    """One row (k, improved, broken, unchanged)."""
    rows = paired_outcomes(before, after, k)
    return rows.agg(
        F.lit(k).alias("k"),
        *[F.count_if(F.col("outcome") == o).alias(o) for o in ("improved", "broken", "unchanged")],
    )


def regression_gate(diff: DataFrame, same_stamp: Column, tolerance: int = TOLERANCE, net: int = ADOPT_NET) -> DataFrame:
    """Verdict per row of ``paired_diff``: skip, fail, adopt or pass."""
    improved, broken = F.col("improved"), F.col("broken")
    verdict = (
        F.when(~same_stamp, "skip")
        .when(broken > tolerance + improved, "fail")
        .when((improved - broken >= net) & (improved > broken), "adopt")
        .otherwise("pass")
    )
    return diff.withColumn("verdict", verdict)


def recall_by_group(results: DataFrame, group: str, methods: list[str], k: int) -> DataFrame:
    """recall@k per group and TOTAL, one column per method."""
    shares = [F.round(F.avg(F.when(F.col("method") == m, _hit(k).cast("double"))), 4).alias(m) for m in methods]
    return results.rollup(group).agg(*shares).withColumn(group, F.coalesce(group, F.lit("TOTAL")))


def method_compare(results: DataFrame, methods: list[str], ks: tuple[int, ...] = KS) -> DataFrame:
    """One row per suite and k, one column per method."""
    tall = results.select("suite", "method", F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), _hit(k).alias("hit")) for k in ks])).alias("e")).select("suite", "method", "e.*")
    return tall.groupBy("suite", "k").pivot("method", methods).agg(F.round(F.avg(F.col("hit").cast("double")), 4))


def classifier_accuracy(df: DataFrame) -> DataFrame:
    """One row from (expected, got, expected_mail, got_mail)."""
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg((F.col("expected") == F.col("got")).cast("double")), 6).alias("intent_accuracy"),
        F.round(F.avg((F.col("expected_mail") == F.col("got_mail")).cast("double")), 6).alias("mail_accuracy"),
    )


def top_confusions(df: DataFrame, n: int = 8) -> DataFrame:
    return df.where("expected <> got").groupBy("expected", "got").agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.desc("n"), "expected", "got").limit(n)


def stratified_sample(df: DataFrame, label: str, row_id: str, n: int, seed: int) -> DataFrame:
    """n rows per class in the order of a seeded hash; null is a class of its own."""
    named = df.withColumn(label, F.coalesce(F.col(label), F.lit("?")))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(row_id).cast("string")))
    w = Window.partitionBy(label).orderBy(order, row_id)
    return named.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def per_class(total: int, classes: int) -> int:
    return max(1, total // max(classes, 1))


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def has_repeated_line(text: Column) -> Column:
    keys = F.filter(F.transform(lines_of(text), lambda s: lower_tr(fold_blanks(s))), lambda s: F.length(s) > pii.REPEAT_MIN)
    return F.size(F.array_distinct(keys)) < F.size(keys)


def asks_for_pii(text: Column) -> Column:
    return text.rlike(f"(?iuU)(?:{pii.PII_TERMS})")


def field_coverage(body: Column, fields: Column) -> Column:
    """Share of collected values whose first 20 letters occur in the body."""
    low = lower_tr(body)
    found = F.filter(F.map_values(fields), lambda v: F.contains(low, F.substring(lower_tr(v), 1, 20)))
    return F.when(F.size(fields) == 0, 1.0).otherwise(F.size(found) / F.size(fields))


def draft_quality(df: DataFrame) -> DataFrame:
    """Rates per model from (model, json_ok, subject, body, fields)."""
    both = F.concat_ws("\n", F.coalesce("subject", F.lit("")), F.coalesce("body", F.lit("")))

    def rate(flag: Column, name: str) -> Column:
        return F.round(F.avg(flag.cast("double")), 6).alias(name)

    return df.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"),
        rate(F.col("json_ok"), "json_ok"),
        rate(asks_for_pii(both), "pii_request"),
        rate(both.rlike(pii.PLACEHOLDER), "placeholder"),
        rate(has_repeated_line(F.col("body")), "repeated"),
        rate(field_coverage(F.col("body"), F.col("fields")), "coverage"),
    )


def gate_calibration(nearest: DataFrame, thresholds: list[float]) -> DataFrame:
    """Per threshold: share of in-scope queries lost and out-of-scope ones caught.

    ``nearest`` has (in_scope, nearest); the few thresholds ride on each row.
    """
    rows = nearest.select("in_scope", "nearest", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"))
    beyond = F.coalesce(F.col("nearest") > F.col("threshold"), F.lit(True)).cast("double")
    return rows.groupBy("threshold").agg(
        F.round(100 * F.avg(F.when(F.col("in_scope"), beyond)), 4).alias("in_scope_lost"),
        F.round(100 * F.avg(F.when(~F.col("in_scope"), beyond)), 4).alias("out_of_scope_caught"),
    )


def reply_class(body: Column, in_scope: Column) -> Column:
    fallback, figure = body.rlike(FALLBACK), body.rlike(FIGURE)
    return (
        F.when(fallback & ~figure & (F.length(fold_blanks(body)) < 400), "redirect_only")
        .when(figure & ~in_scope, "invented")
        .when(fallback & figure, "answer_and_redirect")
        .when(fallback, "redirect")
        .otherwise("answer")
    )


def reply_classes(df: DataFrame) -> DataFrame:
    """Rates per scope from (in_scope, body, context)."""
    rows = df.withColumn("cls", reply_class(F.col("body"), F.col("in_scope")))

    def rate(flag: Column, name: str) -> Column:
        return F.round(F.avg(flag.cast("double")), 6).alias(name)

    return rows.groupBy("in_scope").agg(
        F.count(F.lit(1)).alias("n"),
        rate(F.col("cls") == "invented", "invented"),
        rate(F.col("cls") == "redirect_only", "redirect_only"),
        rate(F.col("body").rlike(CITATION), "cited"),
        rate(F.coalesce("context", F.lit("")) == "", "empty_context"),
    )


def reply_issues(body: Column, sender: Column, sources: Column) -> Column:
    """ARRAY of the faults of a reply."""
    low = lower_tr(body)
    name = F.coalesce(F.nullif(F.trim(sender), F.lit("")), F.lit("Öğrenci"))
    opening = F.exists(
        F.slice(lines_of(body), F.lit(1), F.lit(3)),
        lambda s: lower_tr(s).startswith(lower_tr(F.concat(F.lit("Sayın "), name))) | lower_tr(s).startswith("sayın öğrenci"))
    leak = F.lit(False)
    for slot in NAME_LEAKS:
        leak = leak | F.contains(low, lower_tr(F.lit(slot)))
    issues = F.array(
        F.when(leak, "placeholder"), F.when(~opening, "greeting"),
        F.when(~F.contains(low, F.lit("saygılarımızla")), "closing"), F.when(sources == 0, "no_sources"))
    return F.filter(issues, lambda s: s.isNotNull())


def labelled_intents(docs: DataFrame, questions: DataFrame, tags: str = "tags", intent: str = "intent") -> DataFrame:
    """Questions whose intent occurs as a tag of some visible document."""
    present = docs.select(F.explode(tags).alias(intent)).distinct()
    return questions.join(present, intent, "left_semi")


def containing_documents(passages: DataFrame, docs: DataFrame, words: int = 5) -> DataFrame:
    """(question_id, doc_id) of documents that contain a passage word for word.

    ``passages`` has (question_id, passage), ``docs`` (doc_id, text).  A checked number of
    passages goes to every task, which reads each document once and moves no text; see
    ``_contained``.  Of a larger set those with ``words`` words or more inside are found by
    an equi-join on a run of that many words, spread over ``SALTS`` tasks, and compared in
    full; runs of shorter ones are too frequent for a join, and they go to the tasks in
    turns.  A blank passage is contained nowhere.
    """
    passages = passages.where(strip(F.col("passage")) != "").select("question_id", "passage")
    turns = _turns(passages)
    if turns <= 1:
        return _contained(passages, docs, words)

    def tokens(c: str) -> Column:
        return F.regexp_extract_all(F.col(c), F.lit(r"\S+"), F.lit(0))

    n = words
    long = F.size(tokens("passage")) >= n + 2
    asked = passages.where(long)
    anchors = asked.select("question_id", F.array_join(F.slice(tokens("passage"), 2, n), " ").alias("anchor"),
                           F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    shingles = docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"), F.explode(let(
        tokens("text"),
        lambda w: F.when(F.size(w) >= n, F.array_distinct(F.transform(
            F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " ")))),
    )).alias("anchor"))
    pairs = shingles.join(anchors, ["anchor", "salt"]).select("question_id", "doc_id").distinct()
    found = pairs.join(asked, "question_id").join(docs, "doc_id").where(
        F.contains("text", F.col("passage"))).select("question_id", "doc_id")
    short = passages.where(~long)
    turns = _turns(short)
    turn = F.pmod(F.xxhash64("question_id", "passage"), F.lit(turns))
    for i in range(turns):
        found = found.unionByName(_contained(short.where(turn == i), docs, words))
    return found


def _turns(passages: DataFrame) -> int:
    """In how many parts passages may go to the tasks."""
    n, chars = passages.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("passage")), F.lit(0))).first()
    return max(-(-n // MAX_PASSAGES), -(-chars // MAX_PASSAGE_CHARS))


def _contained(passages: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """``containing_documents`` for passages that fit into every task.

    A passage of three words or more is compared where the words inside it, ``words`` at
    most, stand in the document between fitting neighbours.  Shorter ones are looked for in
    every document.
    """
    rows = passages.collect()
    schema = StructType([passages.schema["question_id"], docs.schema["doc_id"]])
    asked: dict[str, list[int]] = {}
    for place, row in enumerate(rows):
        asked.setdefault(row["passage"], []).append(place)
    shared = docs.sparkSession.sparkContext.broadcast((list(asked), list(asked.values()), [row["question_id"] for row in rows]))
    out = to_arrow_schema(schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, places, questions = shared.value
        questions = pa.array(questions, out.field(0).type)
        find = _finder(texts, words)
        for batch in batches:
            picked, sources = [], []
            for row, text in enumerate(batch.column("text")):
                for p in find(text.as_py()) if text.is_valid else ():
                    picked += places[p]
                    sources += [row] * len(places[p])
                if len(picked) >= PIECE_ROWS or row + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays(
                        [questions.take(pa.array(picked, pa.int64())), batch.column("doc_id").take(pa.array(sources, pa.int64()))], schema=out)
                    picked, sources = [], []

    return docs.select("doc_id", "text").mapInArrow(scan, schema)


def _finder(passages: list[str], words: int) -> Callable[[str], list[int]]:
    """text -> places of the passages that it contains."""
    # first word inside -> number of words inside -> the words -> place, first and last word
    inside: dict[str, dict[int, dict[str, list[tuple[int, str, str]]]]] = {}
    short = []
    for place, passage in enumerate(passages):
        tokens = TOKEN.findall(passage)
        n = min(len(tokens) - 2, words)
        if n <= 0:
            short.append((place, passage))
            continue
        inside.setdefault(tokens[1], {}).setdefault(n, {}).setdefault(" ".join(tokens[1:n + 1]), []).append((place, tokens[0], tokens[n + 1]))

    def find(text: str) -> list[int]:
        found = [place for place, passage in short if passage in text]
        tokens = TOKEN.findall(text) if inside else []
        likely: set[int] = set()
        for at in range(1, len(tokens) - 1):
            for n, runs in inside.get(tokens[at], {}).items():
                if at + n < len(tokens):
                    asked = runs.get(" ".join(tokens[at:at + n]), ())
                    likely.update(p for p, first, last in asked if tokens[at - 1].endswith(first) and tokens[at + n].startswith(last))
        return found + [p for p in likely if passages[p] in text]

    return find
