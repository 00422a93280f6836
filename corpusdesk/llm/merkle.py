"""Document fingerprints: Merkle trees over paragraphs and sections, in built-in functions.

A text falls into paragraphs (lines), a paragraph into pieces that end behind a
sentence or after ``PIECE`` characters (``SHORT_PIECE`` in texts of fewer than
``SHORT`` characters); the pieces are the leaves.  A paragraph's
node is the hash of its leaves, a section's that of ``SECTION`` paragraphs, and
the root that of all sections.  Roots test equality.  Where roots differ, the
sections and then the paragraphs that differ locate the edit, and the share of
common leaves tells how alike two texts are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from corpusdesk.functions.text import let
from corpusdesk.llm.common import documents, settle

PIECE, SHORT_PIECE, SHORT = 32, 8, 128  # characters
SECTION = 8  # paragraphs in a section
BUCKET_ROWS = 500  # documents that a bucket of the order should hold
MAX_BUCKETS = 10_000  # bounds that the plan holds at most; above it buckets grow
LEAF, SHORT_LEAF = (rf"(?s)[^.!?]{{0,{n - 1}}}." for n in (PIECE, SHORT_PIECE))


def tree(text: Column) -> Column:
    """struct(root, sections, paragraphs, leaves) of hashes; ``text`` is not null.

    The empty text has one paragraph without leaves.
    """
    def cut(leaf: str) -> Column:
        return F.transform(F.split(text, "\n"), lambda p: F.transform(
            F.regexp_extract_all(p, F.lit(leaf), F.lit(0)), lambda x: F.left(F.md5(x), F.lit(16))))

    pieces = F.when(F.length(text) < SHORT, cut(SHORT_LEAF)).otherwise(cut(LEAF))
    return let(pieces, lambda ps: let(
        F.transform(ps, lambda p: F.md5(F.array_join(p, ""))),
        lambda nodes: let(
            F.transform(F.sequence(F.lit(0), ((F.size(nodes) - 1) / SECTION).cast("int")),
                        lambda i: F.md5(F.array_join(F.slice(nodes, i * SECTION + 1, F.lit(SECTION)), ""))),
            lambda sections: F.struct(F.sha2(F.array_join(sections, ""), 256).alias("root"), sections.alias("sections"),
                                      nodes.alias("paragraphs"), F.flatten(ps).alias("leaves")))))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal roots, else the share of distinct leaves that two trees have in common (Dice), below 1."""
    la, lb = F.array_distinct(a["leaves"]), F.array_distinct(b["leaves"])
    total = F.size(la) + F.size(lb)
    share = 2.0 * F.size(F.array_intersect(la, lb)) / total
    return F.when(a["root"] == b["root"], 1.0).when(total == 0, 0.0).otherwise(F.least(share, F.lit(0.999999)))


def first_difference(a: Column, b: Column) -> Column:
    """struct(section, paragraph), from 0, of the first branch that differs; null for equal roots.

    Sections that are equal are skipped whole.
    """
    def first(x: Column, y: Column) -> Column:
        both = F.arrays_zip(x.alias("x"), y.alias("y"))
        marks = F.transform(both, lambda p: p["x"].eqNullSafe(p["y"]))
        return F.array_position(marks, False) - 1

    s = first(a["sections"], b["sections"])
    at = (s * SECTION + 1).cast("int")
    p = first(F.slice(a["paragraphs"], at, F.lit(SECTION)), F.slice(b["paragraphs"], at, F.lit(SECTION)))
    return F.when(a["root"] != b["root"], F.struct(s.alias("section"), (s * SECTION + p).alias("paragraph")))


def bounds_of(docs: DataFrame, key: str) -> list:
    """Ascending keys that cut the rows into buckets of about BUCKET_ROWS rows; the first is the smallest key.

    All bounds are keys of rows; only they reach the driver, MAX_BUCKETS at most.
    """
    n, least = docs.agg(F.count(key), F.min(key)).first()
    if not n:
        return []
    buckets = max(1, min(MAX_BUCKETS, n // BUCKET_ROWS))
    if buckets == 1:
        return [least]
    found = docs.agg(F.percentile_approx(key, [i / buckets for i in range(1, buckets)], 10 * buckets)).first()[0]
    return sorted({least, *found})


def bucket_of(key: Column, bounds: list) -> Column:
    """Index of the last bound that is not above the key: first among every hundredth bound, then among the hundred."""
    step = 100
    wide = F.array(*map(F.lit, bounds[::step]))
    fine = F.array(*map(F.lit, bounds))
    w = F.size(F.filter(wide, lambda b: b <= key)) - 1
    return let(w, lambda i: i * step + F.size(F.filter(F.slice(fine, i * step + 1, F.lit(step)), lambda b: b <= key)) - 1)


def with_next(docs: DataFrame, key: str, text: str, out: str) -> DataFrame:
    """Adds ``out``: the text of the next row by ``key`` (ties by text); after the last row comes the first.

    Rows go once to a bucket of their keys.  The rows whose key begins a bucket go to
    the bucket before as well (those of the first one to the last), where they only
    follow.  So no window spans more than a bucket.  Rows with a null key come first.
    """
    null_last = docs.where(F.col(key).isNull())
    known = docs.where(F.col(key).isNotNull())
    bounds = bounds_of(docs, key)
    if null_last.limit(1).count():
        # without an order of their own they stand before the first bucket, in their own one
        rank = F.when(F.col(key).isNull(), -1)
    else:
        rank, docs = F.lit(None).cast("int"), known
    last = len(bounds) - 1
    has_null = docs is not known
    lowest = -1 if has_null else 0
    if not bounds and not has_null:
        return docs.withColumn(out, F.col(text))
    bucket = F.coalesce(rank, bucket_of(F.col(key), bounds) if bounds else F.lit(-1))
    begins = F.lit(False)
    if bounds:
        begins = F.coalesce(F.array_contains(F.array(*map(F.lit, bounds)), F.col(key)), F.lit(False))
    begins = begins | F.col(key).isNull()
    placed = docs.withColumn("__b", bucket).withColumn("__begins", begins)
    previous = F.when(F.col("__b") == lowest, last if bounds else lowest).otherwise(F.col("__b") - 1)
    copies = F.when(F.col("__begins"), F.array(F.struct(F.col("__b").alias("b"), F.lit(0).alias("g")), F.struct(previous.alias("b"), F.lit(1).alias("g")))) \
        .otherwise(F.array(F.struct(F.col("__b").alias("b"), F.lit(0).alias("g"))))
    dealt = placed.withColumn("__c", F.explode(copies)).withColumns({"__b": F.col("__c.b"), "__g": F.col("__c.g")}).drop("__c", "__begins")
    order = Window.partitionBy("__b").orderBy("__g", F.col(key).asc_nulls_first(), text)
    return dealt.withColumn(out, F.lead(text).over(order)).where("__g = 0").drop("__b", "__g")


def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The Merkle root of each text and of its edited text, and how alike it is to that and to the next document.

    The edited text has its last half replaced by the start of the next document.  A
    null text counts as empty; equal texts have equal fingerprints; a single document
    follows itself.  Rows with a null key come first, in the order of their texts; an
    empty table gives no rows.
    """
    rows = docs.select(F.col(key).alias("__key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    both = with_next(rows, "__key", "__text", "__next")
    n = F.length("__text")
    half = F.floor(n / 2).cast("int")
    both = both.withColumns({"n_chars": n.cast("long"), "__edited": F.concat(
        F.substring(F.col("__text"), F.lit(1), n - half), F.substring(F.col("__next"), F.lit(1), half))})
    trees = both.select("__key", "n_chars", F.sha2("__edited", 256).alias("edited_sha256"),
                        tree(F.col("__text")).alias("a"), tree(F.col("__edited")).alias("e"), tree(F.col("__next")).alias("n"))
    a, e, nxt = F.col("a"), F.col("e"), F.col("n")
    return trees.select(F.col("__key").alias(key), "n_chars", "edited_sha256", a["root"].alias("fingerprint"), e["root"].alias("edited_fingerprint"),
                        likeness(a, e).alias("near_edited"), likeness(a, nxt).alias("near_next"),
                        first_difference(a, e)["paragraph"].alias("edited_paragraph"))


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(documents(spark, sf_dir))


#: The same in SQL, with one window over all documents.
OP9_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
x AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id NULLS FIRST, t), first_value(t) OVER (ORDER BY doc_id NULLS FIRST, t)) AS n FROM d),
y AS (SELECT doc_id, t, n, substr(t, 1, CAST(length(t) - length(t) // 2 AS BIGINT)) || substr(n, 1, CAST(length(t) // 2 AS BIGINT)) AS e FROM x),
p AS (SELECT *, {pieces:t} AS tp, {pieces:e} AS ep, {pieces:n} AS np FROM y),
q AS (SELECT *, {nodes:tp} AS tn, {nodes:ep} AS en, {nodes:np} AS nn,
             list_distinct(flatten(tp)) AS tl, list_distinct(flatten(ep)) AS el, list_distinct(flatten(np)) AS nl FROM p),
r AS (SELECT *, {root:tn} AS tr, {root:en} AS er, {root:nn} AS nr FROM q)
SELECT doc_id, length(t) AS n_chars, sha256(e) AS edited_sha256, tr AS fingerprint, er AS edited_fingerprint,
       {near:e} AS near_edited, {near:n} AS near_next,
       CASE WHEN tr <> er THEN list_position(list_transform(list_zip(tn, en), lambda z: z[1] IS NOT DISTINCT FROM z[2]), false) - 1 END AS edited_paragraph
FROM r
"""


def _expand(sql: str) -> str:
    import re

    cut = "list_transform(string_split(@, chr(10)), lambda p: list_transform(regexp_extract_all(p, '{}'), lambda x: left(md5(x), 16)))"
    forms = {
        "pieces": rf"CASE WHEN length(@) < {SHORT} THEN {cut.format(SHORT_LEAF)} ELSE {cut.format(LEAF)} END",
        "nodes": "list_transform(@, lambda p: md5(array_to_string(p, '')))",
        "root": f"sha256(array_to_string(list_transform(range(0, (len(@) - 1) // {SECTION} + 1), lambda i: md5(array_to_string(@[i * {SECTION} + 1:i * {SECTION} + {SECTION}], ''))), ''))",
        "near": "CASE WHEN tr = @r THEN 1.0::DOUBLE WHEN len(tl) + len(@l) = 0 THEN 0.0 ELSE least(2.0::DOUBLE * len(list_intersect(tl, @l)) / (len(tl) + len(@l)), 0.999999::DOUBLE) END",
    }
    return re.sub(r"\{(\w+):(\w+)\}", lambda m: forms[m[1]].replace("@", m[2]), sql)


OP9_SQL = _expand(OP9_SQL)
