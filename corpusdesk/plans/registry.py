"""Catalogue of the registered queries and of the SQL that checks them."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusdesk.operators import lexical
from corpusdesk.sources.workdir import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its own name, with its check in SQL if it has one."""

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give every core a share of a table that arrives in fewer pieces than there are cores.

    Text work is bound by the processor.  This is about the test tables of one file
    only: operators never depend on it, and a table with many splits is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def index(spark: SparkSession, sf: str, postings: Callable[[], DataFrame]) -> DataFrame:
    """The lexical index of a folder's documents: written once in a session, then read.

    Its name follows from the files, so other or newer files get an index of their own.
    """
    files = sorted(table(spark, sf, "documents").inputFiles())
    name = "index_" + hashlib.md5("\n".join([spark.sparkContext.applicationId, *files]).encode()).hexdigest()
    if not spark.catalog.tableExists(name):
        lexical.write_index(postings(), name, new_path(spark, name), int(spark.conf.get("spark.sql.shuffle.partitions")))
    return spark.table(name)


TEXT_KEYS = {"documents": "doc_id", "pages": "page_id"}


def texts(spark: SparkSession, sf: str, name: str = "documents") -> DataFrame:
    return spread(table(spark, sf, name), TEXT_KEYS[name])


def frame(spark: SparkSession, sf: str, sql: str) -> DataFrame:
    """Run SQL in which {name} stands for a given table."""
    names = set(re.findall(r"\{(\w+)\}", sql))
    return spark.sql(sql, **{n: texts(spark, sf, n) if n in TEXT_KEYS else table(spark, sf, n) for n in names})


def duck(sql: str) -> str:
    """The same SQL for DuckDB, where the tables are views."""
    return "(" + re.sub(r"\{(\w+)\}", r"\1", sql) + ")"
