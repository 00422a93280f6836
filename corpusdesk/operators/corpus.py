"""Document-table operators: visibility, duplicates, fingerprints, status roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusdesk.functions.text import extractor_for, strip
from corpusdesk.sources.workdir import discard, settle

REINDEX_STATES = ("INDEXED", "PENDING", "PROCESSING", "FAILED")


def visible(docs: DataFrame) -> DataFrame:
    return docs.where("deleted_at is null and status = 'INDEXED'")


def get_live(docs: DataFrame, key: str, value) -> DataFrame:
    return docs.where((F.col(key) == value) & F.col("deleted_at").isNull())


def route_extractor(files: DataFrame, data: str = "content", name: str = "name", mime: str = "mime") -> DataFrame:
    return files.withColumn("extractor", extractor_for(F.col(data), F.col(name), F.col(mime)))


def with_hash(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("sha256", F.sha2(F.col(text).cast("binary"), 256))


def first_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(sha256, keep_id, copies).  Only hashes and ids are shuffled, after a map-side minimum."""
    return with_hash(docs.select(doc_id, text), text).groupBy("sha256").agg(
        F.min(doc_id).alias("keep_id"), F.count(F.lit(1)).alias("copies")
    )


def dedupe_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents whose content is not already held by a lower id; null contents are no copies.

    Only hashes and ids meet.  Hashes are written first, so a text that has to be worked
    out is worked out once for them.  What is left out, the surplus ids, is written and of
    known size, so that the documents stay where they are if it is small; the last
    join is on the unique id, and a content with very many copies makes no large group.
    """
    written = settle(with_hash(docs.select(doc_id, text), text).select(doc_id, "sha256"), "hashes")
    hashed = written.where("sha256 is not null")
    copied = hashed.groupBy("sha256").agg(F.min(doc_id).alias("keep_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    surplus = settle(hashed.join(copied, "sha256").where(F.col(doc_id) != F.col("keep_id")).select(doc_id), "surplus")
    discard(written)
    return docs.join(surplus, doc_id, "left_anti")


def duplicate_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return first_of_each(docs, doc_id, text).where("copies > 1")


def new_documents(incoming: DataFrame, store: DataFrame, text: str = "text",
                  ignore_deleted: bool = False) -> DataFrame:
    """Incoming documents whose content hash the store does not hold."""
    held = store.where("deleted_at is null") if ignore_deleted else store
    known = with_hash(held.select(text), text).select("sha256").distinct()
    return with_hash(incoming, text).join(known, "sha256", "left_anti")


def import_counts(incoming: DataFrame, store: DataFrame, text: str = "text") -> DataFrame:
    """One row (added, skipped): distinct new contents, and rows not added.

    Rows are reduced to one per hash before they meet the store, so a content
    with very many copies is one row in the join.
    """
    counted = with_hash(incoming.select(text), text).groupBy("sha256").agg(F.count(F.lit(1)).alias("n"))
    known = with_hash(store.select(text), text).select("sha256").distinct().withColumn("held", F.lit(True))
    joined = counted.join(known, "sha256", "left")
    fresh = F.col("held").isNull()
    return joined.agg(
        F.coalesce(F.sum(F.when(fresh, 1).otherwise(0)), F.lit(0)).alias("added"),
        F.coalesce(F.sum(F.when(fresh, F.col("n") - 1).otherwise(F.col("n"))), F.lit(0)).alias("skipped"),
    )


def incremental_import(incoming: DataFrame, store: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(sha256, doc_id): one row per new content, the lowest id of its copies.

    Copies are reduced to one row map-side before anything is joined.
    """
    known = with_hash(store.select(text), text).select("sha256").distinct()
    return first_of_each(incoming, doc_id, text).join(known, "sha256", "left_anti").select(
        "sha256", F.col("keep_id").alias(doc_id))


def dedupe_rows(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key.  Partitions are cut to one row per key before the shuffle."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def corpus_stamp(docs: DataFrame, settings: dict[str, object], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One fingerprint of all contents and the index settings.

    Per row a hash of id and text; four 48-bit lanes of it are added up.  Sums
    combine map-side in any order, so no list of hashes is ever gathered.
    """
    h = F.sha2(F.concat_ws(":", F.col(doc_id).cast("string"), F.col(text)), 256)
    lanes = [
        F.sum(F.conv(F.substring(h, 1 + 12 * i, 12), 16, 10).cast("decimal(20,0)")).alias(f"lane{i}") for i in range(4)
    ]
    sums = docs.select(doc_id, text).agg(F.count(F.lit(1)).alias("n"), *lanes)
    tail = ";".join(f"{k}={settings[k]}" for k in sorted(settings))
    joined = F.concat_ws(":", "n", *[F.col(f"lane{i}").cast("string") for i in range(4)], F.lit(tail))
    return sums.select(F.col("n").alias("documents"), F.sha2(joined, 256).alias("stamp"))


def validate_tags(raw: Column) -> Column:
    """STRUCT(ok, tags): the text must be a JSON array of strings; empty text is []."""
    data = F.try_parse_json(F.when(F.coalesce(raw, F.lit("")) == "", "[]").otherwise(raw))
    ok = F.coalesce(F.schema_of_variant(data).isin("ARRAY<STRING>", "ARRAY<VOID>"), F.lit(False))
    # An array of nulls has the same schema as an empty one.
    ok = ok & ~F.coalesce(F.exists(F.try_variant_get(data, "$", "array<string>"), lambda t: t.isNull()), F.lit(False))
    return F.struct(ok.alias("ok"), F.when(ok, F.try_variant_get(data, "$", "array<string>")).alias("tags"))


def tags_or_empty(raw: Column) -> Column:
    return F.coalesce(F.from_json(raw, "array<string>"), F.array().cast("array<string>"))


def index_status(docs: DataFrame, chunks: DataFrame, now: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Roll chunk counts up to documents."""
    counts = chunks.groupBy(doc_id).agg(F.count(F.lit(1)).alias("chunk_count"))
    empty = strip(F.coalesce(F.col(text), F.lit(""))) == ""
    n = F.coalesce("chunk_count", F.lit(0))
    error = F.when(empty, "no text in file").when(n == 0, "no chunks")
    return docs.join(counts, doc_id, "left").select(
        doc_id, F.when(error.isNull(), "INDEXED").otherwise("FAILED").alias("status"),
        F.when(error.isNull(), n).otherwise(0).alias("chunk_count"),
        F.when(error.isNull(), now).alias("indexed_at"), error.alias("processing_error"),
    )


def chunk_stats(old: DataFrame, new: DataFrame, doc_id: str = "doc_id", content: str = "content") -> DataFrame:
    """Chunk counts and mean lengths before and after, per document."""

    def stats(df: DataFrame, side: str) -> DataFrame:
        return df.groupBy(doc_id).agg(
            F.count(F.lit(1)).alias(f"n_{side}"), F.sum(F.length(content)).alias(f"chars_{side}"))

    both = stats(old, "before").join(stats(new, "after"), doc_id, "full_outer")
    return both.select(
        doc_id,
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_before", "n_after", "chars_before", "chars_after")],
    ).withColumn("mean_after", F.round(F.when(F.col("n_after") > 0, F.col("chars_after") / F.col("n_after")).otherwise(0.0), 6))


def delete_documents(docs: DataFrame, chunks: DataFrame, doomed: DataFrame, now: Column,
                     doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(documents with the doomed ones soft-deleted, chunks without theirs)."""
    flag = doomed.select(doc_id).distinct().withColumn("_gone", F.lit(True))
    gone = F.col("_gone").isNotNull()
    after = docs.join(flag, doc_id, "left").withColumn(
        "status", F.when(gone, "DELETED").otherwise(F.col("status"))
    ).withColumn("deleted_at", F.when(gone, now).otherwise(F.col("deleted_at"))).drop("_gone")
    return after, chunks.join(doomed.select(doc_id), doc_id, "left_anti")


def reindex_candidates(docs: DataFrame, binary_only: bool = False) -> DataFrame:
    out = docs.where(F.col("deleted_at").isNull() & F.col("status").isin(*REINDEX_STATES))
    return out.where("mime_type <> 'text/plain'") if binary_only else out
