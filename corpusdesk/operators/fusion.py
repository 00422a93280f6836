"""Everything after the two candidate lists, for batches of queries.

Frames are keyed by ``query_id`` (and ``sub_no`` before fusion).  No chunk text
travels through these steps; ``hydrate_hits`` fetches it for the final rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusdesk.functions.mail import sub_queries
from corpusdesk.params import SEARCH
from corpusdesk.sources.workdir import settle


def expand_queries(queries: DataFrame, text: str = "text", subject: str = "subject") -> DataFrame:
    """One row (…, sub_no, text) per search text of a query; blank ones vanish."""
    rest = [c for c in queries.columns if c not in (text, subject)]
    return queries.select(*rest, F.posexplode(sub_queries(F.col(text), F.col(subject))).alias("sub_no", "text")).where(
        F.trim("text") != "")


def merge_legs(vec: DataFrame | None, lex: DataFrame | None) -> DataFrame | None:
    """Both candidate lists as one; either may be missing."""
    legs = [
        leg.select("query_id", "sub_no", F.lit(name).alias("leg"), "chunk_id", "rank", F.col(raw).alias("raw"))
        for leg, name, raw in ((vec, "vec", "distance"), (lex, "lex", "score")) if leg is not None
    ]
    if not legs:
        return None
    return legs[0] if len(legs) == 1 else legs[0].unionByName(legs[1])


def rrf_fuse(legs: DataFrame, k: int = SEARCH.rrf_k) -> DataFrame:
    """(query_id, chunk_id, score): sum of 1 / (k + rank) over all lists."""
    return legs.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"))


def query_stats(queries: DataFrame, legs: DataFrame) -> DataFrame:
    """(query_id, vector_ran, nearest, lexical_hits); ``queries`` has one row per
    sub-query with its vector, a null one meaning that the vector leg did not run."""
    seen = legs.groupBy("query_id").agg(
        F.min(F.when(F.col("leg") == "vec", F.col("raw"))).alias("nearest"),
        F.count_if(F.col("leg") == "lex").alias("lexical_hits"),
    )
    return queries.groupBy("query_id").agg(F.max(F.col("vec").isNotNull()).alias("vector_ran")).join(
        seen, "query_id", "left").select(
        "query_id", "vector_ran", "nearest", F.coalesce("lexical_hits", F.lit(0)).alias("lexical_hits"))


def out_of_scope(max_distance: float = SEARCH.max_distance) -> Column:
    far = F.col("nearest").isNull() | (F.col("nearest") > max_distance)
    return F.col("vector_ran") & far & (F.col("lexical_hits") == 0)


def scope_gate(fused: DataFrame, stats: DataFrame, max_distance: float = SEARCH.max_distance) -> DataFrame:
    """Drop all rows of queries that neither list places in scope."""
    return fused.join(stats.where(out_of_scope(max_distance)).select("query_id"), "query_id", "left_anti")


def tag_bonus(fused: DataFrame, intents: DataFrame, chunk_tags: DataFrame, bonus: float = SEARCH.intent_bonus) -> DataFrame:
    """Add ``bonus`` once where the query's intent is among the chunk's tags.

    Further columns of ``chunk_tags`` come along, so one join fetches them all.
    """
    tagged = fused.join(chunk_tags, "chunk_id").join(intents.select("query_id", "intent"), "query_id", "left")
    hit = F.coalesce(F.array_contains("tags", F.col("intent")), F.lit(False))
    return tagged.withColumn("score", F.round(F.col("score") + F.when(hit, bonus).otherwise(0.0), 9)).drop("tags", "intent")


def rerank_topn(fused: DataFrame, scores: DataFrame | None, n: int = SEARCH.rerank_top_n) -> DataFrame:
    """Re-sort the first n rows of a query by outside scores; adds ``position``.

    A query that lacks any of its n scores keeps its order.
    """
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("chunk_id"))
    ranked = fused.withColumn("old_rank", F.row_number().over(by_score))
    if scores is None:
        return ranked.withColumnRenamed("old_rank", "position")
    joined = ranked.join(scores.select("query_id", "chunk_id", F.col("score").alias("new_score")),
                         ["query_id", "chunk_id"], "left")
    top = F.col("old_rank") <= n
    lacking = F.max(top & F.col("new_score").isNull()).over(Window.partitionBy("query_id"))
    usable = joined.withColumn("new_score", F.when(top & ~lacking, F.col("new_score")))
    order = Window.partitionBy("query_id").orderBy(F.desc(top), F.desc_nulls_last("new_score"), F.asc("old_rank"))
    return (
        usable.withColumn("position", F.row_number().over(order))
        .withColumn("score", F.coalesce("new_score", "score"))
        .drop("old_rank", "new_score")
    )


def diversify(ranked: DataFrame, k: int = SEARCH.top_k, per_document: int = SEARCH.per_document,
              order: list[Column] | None = None) -> DataFrame:
    """The k results: at most ``per_document`` of a document, the rest filled up
    without that limit.  Adds ``rank`` 1..k."""
    order = order or [F.desc("score"), F.asc("chunk_id")]
    in_doc = Window.partitionBy("query_id", "document_id").orderBy(*order)
    in_query = Window.partitionBy("query_id").orderBy(F.asc("_extra"), *order)
    return (
        ranked.withColumn("_extra", F.row_number().over(in_doc) > per_document)
        .withColumn("rank", F.row_number().over(in_query))
        .where(F.col("rank") <= k)
        .drop("_extra")
    )


def hydrate_hits(hits: DataFrame, chunks: DataFrame, docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fetch content and label (description, else file name) of the final rows.

    The hits, a few rows per query, are written first: their size is then known, and
    they travel to the chunks instead of all chunks to them.  Chunks that are a join
    themselves are cut to the hits before it, so no other text is moved for it.
    Labels are joined before texts, which a join behind theirs would move again.

    ``parts`` says that the texts of the hits are few enough to go to every task.  The hits
    are dealt by query into so many parts before they meet them, and the rows, which repeat
    a text for every query, are moved no more where a query's are gathered.
    """
    hits = settle(hits, "hits")
    found = texts_of(hits, chunks)
    label = F.coalesce(F.nullif(F.col("description"), F.lit("")), F.col("filename")).alias("label")
    rest = [c for c in hits.columns if c not in ("document_id", "chunk_id")]
    labelled = hits.join(docs.select("document_id", label), "document_id")
    if parts:
        labelled, found = labelled.repartition(parts, "query_id"), F.broadcast(found)
    return labelled.join(found, "chunk_id").select(
        "document_id", "chunk_id", *rest, "content", "label")


def texts_of(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chunk_id, content) of the chunks that are hits."""
    return chunks.select("chunk_id", "content").join(hits.select("chunk_id").distinct(), "chunk_id", "left_semi")


def document_order(hits: DataFrame) -> DataFrame:
    """Adds ``place``: best document first, inside a document by chunk index."""
    best = F.max("score").over(Window.partitionBy("query_id", "document_id"))
    order = Window.partitionBy("query_id").orderBy(F.desc("best"), F.asc("document_id"), F.asc("chunk_index"), F.asc("chunk_id"))
    return hits.withColumn("best", best).withColumn("place", F.row_number().over(order)).drop("best")


def build_context(hits: DataFrame, max_chars: int | None = None) -> DataFrame:
    """(query_id, context, n_sources) from hits with place, content and label.

    A query has at most k hits, so the gathered list is short.  A chunk over
    budget is left out whole and later, smaller ones may still fit.
    """
    gathered = hits.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("place", "label", "content"))).alias("parts"))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, part: Column) -> Column:
        cost = F.length(part["content"]) + F.length(part["label"]) + 20
        fits = (F.size(state["out"]) == 0) | (state["used"] + cost <= max_chars) if max_chars is not None else F.lit(True)
        text = F.concat(F.lit("[Kaynak "), (F.size(state["out"]) + 1).cast("string"), F.lit(" — "),
                        part["label"], F.lit("]\n"), part["content"])
        return F.struct(
            F.when(fits, state["used"] + cost).otherwise(state["used"]).alias("used"),
            F.when(fits, F.concat(state["out"], F.array(text))).otherwise(state["out"]).alias("out"),
        )

    kept = gathered.select("query_id", F.aggregate("parts", start, step)["out"].alias("kept"))
    return kept.select("query_id", F.array_join("kept", "\n\n---\n\n").alias("context"), F.size("kept").alias("n_sources"))
