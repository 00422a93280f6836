"""File readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from corpusdesk.params import MAX_FETCH_PER_POLL, MAX_UPLOAD_MB

KB_SCHEMA = "title string, tags array<string>, content string"


def read_kb(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entries, rejected lines) of knowledge-base JSON lines.

    Blank lines are skipped and missing tags are empty; a line that is no such object
    is rejected as it stands.
    """
    rows = spark.read.schema(KB_SCHEMA + ", broken string").option("columnNameOfCorruptRecord", "broken").json(path)
    good = rows.where("broken is null").select(
        "title", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), "content")
    # Spark reads no file for the sake of this column alone
    return good, rows.where("broken is not null").select(F.coalesce("broken", "title").alias("line"))


def split_by_size(files: DataFrame, max_mb: float = MAX_UPLOAD_MB) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of files or uploads with a ``length``.  The reject frame reads no bodies."""
    reason = F.when(F.col("length") == 0, "empty file").when(F.col("length") > max_mb * 1024 * 1024, "file too large")
    return files.where(reason.isNull()), files.where(reason.isNotNull()).drop("content").withColumn("reject_reason", reason)


def read_files(spark: SparkSession, path: str, max_mb: int = MAX_UPLOAD_MB) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) files below ``path``.

    Spark lists no empty files, so those are in neither frame; uploads that
    arrive as rows go through ``split_by_size``, which names them.
    """
    files = spark.read.format("binaryFile").load(path)
    return split_by_size(files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", "content"), max_mb)


def export_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_json_parts(df: DataFrame, path: str, key: str, max_bytes: int) -> None:
    """JSON lines in files (``path/*/*/*.json``) of at most ``max_bytes``, however large the table is.

    A row goes to the file in which the bytes before it end, counted per shard in the
    order of ``key``; one above half of ``max_bytes`` gets a file of its own.
    """
    half = max_bytes // 2
    rows = df.select("*", (F.octet_length(F.to_json(F.struct(*df.columns))) + 1).cast("bigint").alias("_size"))
    total = rows.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]
    shards = rows.withColumn("_shard", F.pmod(F.xxhash64(key), F.lit(total // (8 * max_bytes) + 1)))
    large = F.col("_size") > half
    before = Window.partitionBy("_shard").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    held = F.coalesce(F.sum(F.when(large, 0).otherwise(F.col("_size"))).over(before), F.lit(0))
    alone = F.count_if(large).over(before)
    files = shards.withColumn("_file", F.when(large, -1 - alone).otherwise(F.floor(held / half)))
    files.drop("_size").write.partitionBy("_shard", "_file").json(path)


def poll_files(spark: SparkSession, path: str, schema, fmt: str = "parquet",
               max_files: int = MAX_FETCH_PER_POLL) -> DataFrame:
    """Incremental source: at most ``max_files`` new files per poll."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", max_files).load(path)
