"""Where intermediate tables and stream checkpoints live.

A cluster names a shared folder in ``spark.checkpoint.dir``.  Only a local
master may fall back to a temporary folder of this machine.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

_local_fallback: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _local_fallback:
        _local_fallback[sc.applicationId] = tempfile.mkdtemp(prefix="corpusdesk-")
    return _local_fallback[sc.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared root that nobody has used yet."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared root and go on from the written table.

    For small frames that several later steps read: it is computed once, its
    size becomes known to the optimizer, and a lost executor costs nothing.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete settled tables that nothing reads any more; what lies outside the shared root stays.

    Shuffle files are freed as well: Spark deletes those of plans that the driver no longer holds.
    """
    for df in tables:
        spark = df.sparkSession
        folders = {f.rpartition("/")[0] for f in df.inputFiles()}
        for folder in folders:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            root = spark._jvm.org.apache.hadoop.fs.Path(shared_root(spark))
            if path.toUri().getPath().startswith(root.toUri().getPath().rstrip("/") + "/"):
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        gc.collect()
        tables[0].sparkSession._jvm.System.gc()


def fits(df: DataFrame, max_rows: int) -> bool:
    """Does the frame have at most ``max_rows`` rows?  Reads no more than that."""
    return df.limit(max_rows + 1).count() <= max_rows


def members(ids: DataFrame, key: str, small: int = 200_000, share: int = 250_000) -> DataFrame:
    """The distinct values of ``key`` in ``ids``, to look rows up in: no row of the other side is sorted.

    Up to ``small`` of them go to every task.  More are dealt by value, about ``share`` to
    a task, so what a task holds follows from that number, not from the rows it reads.
    """
    held = settle(ids.select(key).distinct(), "members")
    n = held.count()
    if n <= small:
        return F.broadcast(held)
    parts = max(-(-n // share), int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return held.repartition(parts, key).hint("shuffle_hash")
