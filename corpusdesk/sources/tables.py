"""Table stores: chunks replaced per document, mail log, evaluation baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusdesk.functions.pii import mask_pii, pseudonymize
from corpusdesk.params import ERROR_CHARS, RETENTION
from corpusdesk.sources.snapshots import SnapshotTable
from corpusdesk.sources.workdir import members


def replace_chunks(old: DataFrame, new: DataFrame, outcomes: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Chunks after re-indexing: documents that succeeded get the new ones, all
    others keep what they had.  ``outcomes`` has (doc_id, error), null = success."""
    done = members(outcomes.where("error is null"), doc_id)
    return old.join(done, doc_id, "left_anti").unionByName(new.join(done, doc_id, "left_semi"))


def document_outcomes(docs: DataFrame, outcomes: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Document status after re-indexing: INDEXED, or FAILED with a cut error text."""
    return docs.join(outcomes, doc_id).withColumn(
        "status", F.when(F.col("error").isNull(), "INDEXED").otherwise("FAILED")
    ).withColumn("processing_error", F.substring("error", 1, ERROR_CHARS)).drop("error")


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def chunk_table(spark: SparkSession, path: str, buckets: int, doc_id: str = "doc_id") -> SnapshotTable:
    """The chunk table, laid out by document bucket."""
    return SnapshotTable(spark, path, bucket_of(F.col(doc_id), buckets).cast("string"))


def write_chunks(chunks: DataFrame, path: str, buckets: int, doc_id: str = "doc_id") -> None:
    chunk_table(chunks.sparkSession, path, buckets, doc_id).write(chunks)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return SnapshotTable(spark, path, F.lit(None)).read()


def replace_chunks_in_table(spark: SparkSession, path: str, new: DataFrame, outcomes: DataFrame,
                            buckets: int, doc_id: str = "doc_id") -> None:
    """Rewrite only the buckets that hold re-indexed documents, each once.

    Readers see all of the change or nothing of it: a lost executor or a failed job
    leaves the table as it was.  Rows of ``outcomes`` without an id change nothing.
    """
    held = chunk_table(spark, path, buckets, doc_id)
    base = held.current()
    done = outcomes.where(F.col("error").isNull() & F.col(doc_id).isNotNull())
    # At most ``buckets`` numbers.
    touched = [r[0] for r in done.select(held.part).distinct().collect()]
    held.replace(replace_chunks(held.read(touched, base), new, done, doc_id), touched, base)


def log_rows(sent: DataFrame, days: int = RETENTION.log_days) -> DataFrame:
    """Mail-log rows from (draft_id, recipient, subject, body, sent_at)."""
    return sent.select(
        "draft_id", pseudonymize(F.col("recipient")).alias("recipient_hash"), "subject",
        mask_pii(F.col("body")).alias("body_masked"), "sent_at",
        (F.col("sent_at") + F.make_dt_interval(F.lit(days))).alias("retention_expires_at"),
    )


def append_log(sent: DataFrame, path: str, days: int = RETENTION.log_days) -> None:
    log_rows(sent, days).write.mode("append").parquet(path)


def write_baseline(results: DataFrame, stamp: Column, path: str) -> None:
    """Store (suite, question_id, pos) together with the corpus fingerprint."""
    results.select("suite", stamp.alias("stamp"), "question_id", "pos").write.mode("overwrite").partitionBy(
        "suite").parquet(path)


def read_baseline(spark: SparkSession, path: str, suite: str, stamp: str) -> DataFrame:
    """Stored positions, or no rows when the corpus has changed since."""
    return spark.read.parquet(path).where((F.col("suite") == suite) & (F.col("stamp") == stamp))
