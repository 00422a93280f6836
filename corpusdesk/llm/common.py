"""Shared helpers: text columns in bounded blocks, worker-wide stores, settled tables."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType

from corpusdesk.sources.workdir import discard, settle

#: Rows and bytes of text that Python code looks at in one go.
BLOCK_ROWS, BLOCK_BYTES = 512, 1 << 20


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def worker_store(name: str) -> dict:
    """A dict that outlives a task, so that later tasks of the Python worker find it filled.

    A worker keeps that of one operator at a time: the stores of a pipeline's earlier
    stages would only take memory.
    """
    home = sys.modules.setdefault("corpusdesk_worker_store", types.ModuleType("corpusdesk_worker_store"))
    stores = home.__dict__.setdefault("stores", {})
    if name not in stores:
        stores.clear()
    return stores.setdefault(name, {})


def blocks(texts: pa.Array) -> Iterator[tuple[int, list[bytes | None]]]:
    """(first row, texts as UTF-8) of runs of rows; a longer text is a block of its own."""
    texts = texts.cast(pa.large_binary())
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and (held + size > BLOCK_BYTES or i - start >= BLOCK_ROWS):
            yield start, texts.slice(start, i - start).to_pylist()
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, texts.slice(start).to_pylist()


Block = Callable[[list[bytes | None]], list[list]]


def without(columns: list[str], names: list[str]) -> list[str]:
    """Columns but for those called like ``names`` in any case."""
    taken = {n.lower() for n in names}
    return [c for c in columns if c.lower() not in taken]


def add_columns(df: DataFrame, fields: list[StructField], make: Callable[[], Block],
                keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """``df`` (its columns ``keep``; all by default) with columns computed from whole texts.

    ``make`` runs once in each task and returns the function that maps a block of
    texts (UTF-8 or None) to one list per new column.  Rows stay where they are.
    A column of ``df`` that is called like a new one gives way to it.
    """
    names = [f.name for f in fields]
    kept = without(df.columns if keep is None else keep, names)
    schema = StructType([df.schema[c] for c in kept] + fields)
    src = df.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text}`").cast("string").alias("__text"))

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        block = make()
        out = to_arrow_schema(schema)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for start, part in blocks(texts):
                new = block(part)
                old = batch.slice(start, len(part))
                yield pa.RecordBatch.from_arrays(
                    [old.column(i).cast(out.field(i).type) for i in range(len(kept))]
                    + [pa.array(values, out.field(len(kept) + j).type) for j, values in enumerate(new)], schema=out)

    return src.mapInArrow(run, schema)


def keep_rows(df: DataFrame, make: Callable[[], Callable[[list[bytes | None]], list[bool]]], text: str = "text") -> DataFrame:
    """The rows of ``df`` whose whole text passes; ``make`` runs once in each task.  Rows stay where they are."""
    schema = df.schema
    place = df.columns.index(text)

    def run(batches):
        test = make()
        for batch in batches:
            for start, part in blocks(batch.column(place).cast(pa.large_string())):
                kept = batch.slice(start, len(part)).filter(pa.array(test(part), pa.bool_()))
                if kept.num_rows:
                    yield kept

    return df.mapInArrow(run, schema)


def file_order(docs: DataFrame) -> list[Column] | None:
    """The order in which the rows of a written table stand in its files; None if ``docs`` is not read from files."""
    from pyspark.errors import AnalysisException

    order = [F.col("_metadata.file_name"), F.col("_metadata.row_index")]
    try:
        docs.select(*order)
    except AnalysisException:
        return None
    return order


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Is crc32 of the id as text, modulo ``parts``, equal to ``part``?  A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts == part


__all__ = ["BLOCK_BYTES", "BLOCK_ROWS", "add_columns", "blocks", "discard", "documents", "file_order", "held_out", "keep_rows", "settle", "without", "worker_store"]
