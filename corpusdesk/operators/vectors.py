"""Nearest neighbours by cosine distance, exact and approximate, for batches of queries.

Two exact ways, chosen by a checked size:

* The query vectors with the k best of each fit a stated number of bytes: every
  task scans its own vectors once against the query matrix and keeps k per query.
  The corpus is not shuffled; k rows per query and task are.
* They do not fit: both sides are dealt into blocks of bounded bytes and every
  pair of blocks meets once.  A pair hands on k rows per query, whatever its size.

For vectors known to cluster there are cells around pivots instead of blocks: the
triangle inequality rules out cells that cannot hold a neighbour, and full cells
are cut into slices.  The approximate form visits only the nearest cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from corpusdesk.params import SEARCH

MAX_BROADCAST_BYTES = 32 * 1024 * 1024
SLACK = 1e-6   # keeps rounding from ruling out a cell
MERGE = 64
BLOCK_QUERIES, BLOCK_ROWS = 256, 4096   # a block of distances is never larger
QUERY_BYTES, CHUNK_BYTES = 8 * 1024 * 1024, 64 * 1024 * 1024   # vectors of a pair of blocks, as doubles
LEAST_QUERIES = 2048   # more blocks than bytes ask for, so that all cores work, have at least so many
PIECE_ROWS = 10_000   # rows that repeat a vector leave a task in pieces of so many


def check_embeddings(df: DataFrame, dim: int, vec: str = "vec") -> tuple[DataFrame, DataFrame]:
    """(usable rows, quarantined rows with a reason)."""
    reason = unusable(F.col(vec), dim)
    return df.where(reason.isNull()), df.where(reason.isNotNull()).withColumn("reason", reason)


def unusable(vec: Column, dim: int) -> Column:
    """Why a vector has no cosine distance; null for a usable one."""
    odd = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        F.when(vec.isNull(), "vector missing").when(F.size(vec) != dim, "wrong dimension")
        .when(odd, "element missing or not finite").when(F.forall(vec, lambda x: x == 0), "zero vector")
    )


def cosine_distance(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def _unit(vectors: pd.Series) -> np.ndarray:
    m = np.stack(vectors.to_numpy()).astype("float64")
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _best(dist: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k smallest (distance, id) pairs."""
    if len(dist) > k:
        limit = np.partition(dist, k - 1)[k - 1]
        near = np.flatnonzero(dist <= limit)
    else:
        near = np.arange(len(dist))
    return near[np.lexsort((ids[near], dist[near]))][:k]


def _rank(found: DataFrame, keys: list[str], chunk_id: str, k: int) -> DataFrame:
    """The k best of a query in two steps: every task hands on k rows of it, so they are first cut in MERGE parts."""
    by = [F.asc("distance"), F.asc(chunk_id)]
    part = found.withColumn("_part", F.pmod(F.xxhash64(chunk_id), F.lit(MERGE)))
    some = part.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*by))).where(F.col("rank") <= k).drop("_part")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where(F.col("rank") <= k)


def _schema(queries: DataFrame, chunks: DataFrame, keys: list[str], chunk_id: str) -> str:
    q = ", ".join(f"{c} {queries.schema[c].dataType.simpleString()}" for c in keys)
    return f"{q}, {chunk_id} {chunks.schema[chunk_id].dataType.simpleString()}, distance double"


def vector_topk(queries: DataFrame, chunks: DataFrame, keys: list[str], dim: int, k: int = SEARCH.pool,
                chunk_id: str = "chunk_id", vec: str = "vec",
                max_broadcast_bytes: int = MAX_BROADCAST_BYTES, clustered: bool = False) -> DataFrame:
    """(keys, chunk_id, distance, rank): exact k nearest, ties by chunk id.

    Vectors that ``check_embeddings`` would set aside, on either side, are left out.
    ``clustered`` says that cells rule out much; it changes the way, not the result.
    """
    queries = queries.where(unusable(F.col(vec), dim).isNull()).select(*keys, vec)
    chunks = chunks.where(unusable(F.col(vec), dim).isNull()).select(chunk_id, vec)
    room = max_broadcast_bytes // (8 * (dim + 2 * k))
    if queries.limit(room + 1).count() <= room:
        return _scan_topk(queries, chunks, keys, k, chunk_id, vec)
    if clustered:
        return _cell_topk(queries, chunks, keys, k, chunk_id, vec, probe=None)
    return _block_topk(queries, chunks, keys, dim, k, chunk_id, vec)


def vector_topk_ann(queries: DataFrame, chunks: DataFrame, keys: list[str], dim: int, k: int = SEARCH.pool,
                    chunk_id: str = "chunk_id", vec: str = "vec", pivots: int = 64, probe: int = 40) -> DataFrame:
    """Approximate k nearest: only the ``probe`` cells nearest to the query are searched.

    The default suits vectors that hardly cluster; for clustered ones fewer cells do.

    Unusable vectors are left out as in ``vector_topk``.
    """
    queries = queries.where(unusable(F.col(vec), dim).isNull()).select(*keys, vec)
    chunks = chunks.where(unusable(F.col(vec), dim).isNull()).select(chunk_id, vec)
    return _cell_topk(queries, chunks, keys, k, chunk_id, vec, probe=probe, pivots=pivots)


def _scan_topk(queries, chunks, keys, k, chunk_id, vec) -> DataFrame:
    rows = queries.toPandas()
    schema = _schema(queries, chunks, keys, chunk_id)
    if rows.empty:
        return _rank(chunks.limit(0).selectExpr(
            *[f"cast(null as {queries.schema[c].dataType.simpleString()}) as {c}" for c in keys],
            chunk_id, "cast(null as double) as distance"), keys, chunk_id, k)
    shared = queries.sparkSession.sparkContext.broadcast((_unit(rows[vec]), rows[keys]))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matrix, labels = shared.value
        n = len(matrix)
        kept: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0), np.empty(0, dtype=object))] * n
        for batch in batches:
            for at in range(0, len(batch), BLOCK_ROWS):
                part = batch.iloc[at:at + BLOCK_ROWS]
                ids, units = part[chunk_id].to_numpy(), _unit(part[vec]).T
                for first in range(0, n, BLOCK_QUERIES):
                    dist = np.round(1.0 - matrix[first:first + BLOCK_QUERIES] @ units, 9)
                    # A query needs work only if these rows beat its k-th best so far.
                    worst = np.array([d[-1] if len(d) == k else np.inf for d, _ in kept[first:first + BLOCK_QUERIES]])
                    for row in np.flatnonzero(dist.min(axis=1) <= worst):
                        q = first + row
                        d = np.concatenate([kept[q][0], dist[row]])
                        i = np.concatenate([kept[q][1].astype(ids.dtype), ids])
                        pick = _best(d, i, k)
                        kept[q] = (d[pick], i[pick])
        step = max(1, PIECE_ROWS // k)
        for first in range(0, n, step):
            some = kept[first:first + step]
            sizes = [len(d) for d, _ in some]
            if sum(sizes):
                out = labels.iloc[first + np.repeat(np.arange(len(some)), sizes)].reset_index(drop=True)
                out[chunk_id] = np.concatenate([i for _, i in some if len(i)])
                out["distance"] = np.concatenate([d for d, _ in some])
                yield out

    return _rank(chunks.mapInPandas(scan, schema), keys, chunk_id, k)


def _nearest_rows(asked: np.ndarray, units: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of the k nearest rows of every query, ties by row; no more than a block of distances at once."""
    found: list[list[np.ndarray]] = [[], [], []]
    for first in range(0, len(asked), BLOCK_QUERIES):
        matrix = asked[first:first + BLOCK_QUERIES]
        query, row, dist = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        worst = np.full(len(matrix), np.inf)
        for at in range(0, len(units), BLOCK_ROWS):
            raw = 1.0 - matrix @ units[at:at + BLOCK_ROWS].T
            if at == 0 and raw.shape[1] > k:
                worst = np.partition(raw, k - 1, axis=1)[:, k - 1]
            # Rounding moves a distance by half a unit of its ninth digit at most.
            q, r = np.nonzero(raw <= (worst + 2e-9)[:, None])
            query, row, dist = np.concatenate([query, q]), np.concatenate([row, r + at]), np.concatenate([dist, np.round(raw[q, r], 9)])
            order = np.lexsort((row, dist, query))
            query, row, dist = query[order], row[order], dist[order]
            place = np.arange(len(query)) - np.searchsorted(query, query)
            best = place < k
            query, row, dist, place = query[best], row[best], dist[best], place[best]
            last = place == k - 1
            worst[query[last]] = dist[last]
        for part, new in zip(found, (query + first, row, dist)):
            part.append(new)
    return tuple(np.concatenate(part) for part in found)


def _block_topk(queries, chunks, keys, dim, k, chunk_id, vec) -> DataFrame:
    """Every block of queries meets every block of chunks; no task holds more than one pair of blocks."""
    n, m = queries.count(), chunks.count()
    busy = min(2 * queries.sparkSession.sparkContext.defaultParallelism, -(-n // LEAST_QUERIES))
    q_parts = max(1, busy, -(-n * 8 * dim // QUERY_BYTES))
    c_parts = max(1, -(-m * 8 * dim // CHUNK_BYTES))

    def one(parts: int, *cols: str) -> Column:
        return F.pmod(F.xxhash64(*cols), F.lit(parts)).cast("int")

    def each(parts: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))

    group = ["q_part", "c_part"]
    left = queries.withColumn("q_part", one(q_parts, *keys)).withColumn("c_part", each(c_parts))
    right = chunks.withColumn("c_part", one(c_parts, chunk_id)).withColumn("q_part", each(q_parts))

    def nearest(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame({name: [] for name in [*keys, chunk_id, "distance"]})
        c = c.sort_values(chunk_id, ignore_index=True)
        query, row, dist = _nearest_rows(_unit(q[vec]), _unit(c[vec]), k)
        out = q[keys].iloc[query].reset_index(drop=True)
        return out.assign(**{chunk_id: c[chunk_id].to_numpy()[row], "distance": dist})

    found = left.select(*group, *keys, vec).groupBy(*group).cogroup(
        right.select(*group, chunk_id, vec).groupBy(*group)
    ).applyInPandas(nearest, _schema(queries, chunks, keys, chunk_id))
    return _rank(found, keys, chunk_id, k)


def _cell_topk(queries, chunks, keys, k, chunk_id, vec, probe: int | None,
               pivots: int = 256, slice_rows: int = 20_000) -> DataFrame:
    spark = chunks.sparkSession
    # At most a fixed number of pivots, picked by hash: the driver holds pivots * dim numbers.
    pivots = min(pivots, int(chunks.count() ** 0.5) + 1)
    picked = chunks.orderBy(F.md5(F.col(chunk_id).cast("string")), chunk_id).limit(pivots).toPandas()
    if picked.empty:
        return _scan_topk(queries.limit(0), chunks, keys, k, chunk_id, vec)
    centres = spark.sparkContext.broadcast(_unit(picked[vec]))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if b.empty:
                continue
            d = np.sqrt(np.maximum(2.0 - 2.0 * _unit(b[vec]) @ centres.value.T, 0.0))
            cell = d.argmin(axis=1)
            yield b.assign(cell=cell.astype("int32"), radius=d[np.arange(len(b)), cell])

    assigned = chunks.mapInPandas(
        assign, StructType(chunks.schema.fields + [StructField("cell", IntegerType())]).add("radius", "double"))
    # At most one row per pivot.
    stats = assigned.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.min("radius").alias("lo"), F.max("radius").alias("hi")).toPandas()
    stats = stats.sort_values("cell").reset_index(drop=True)
    shape = spark.sparkContext.broadcast({c: stats[c].to_numpy() for c in stats.columns})

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = shape.value
        for b in batches:
            if b.empty:
                continue
            d = np.sqrt(np.maximum(2.0 - 2.0 * _unit(b[vec]) @ centres.value[s["cell"]].T, 0.0))
            if probe is None:
                # k members surely lie within ``reach``; farther cells cannot matter.
                upper = d + s["hi"]
                order = upper.argsort(axis=1)
                counts = s["n"][order].cumsum(axis=1)
                at = np.minimum((counts < k).sum(axis=1), d.shape[1] - 1)
                rows = np.arange(len(b))
                reach = np.where(counts[:, -1] < k, np.inf, upper[rows, order[rows, at]])
                lower = np.maximum(np.maximum(d - s["hi"], s["lo"] - d), 0.0)
                go = lower <= reach[:, None] + SLACK
            else:
                nearest = d.argsort(axis=1)[:, :probe]
                go = np.zeros(d.shape, dtype=bool)
                np.put_along_axis(go, nearest, True, axis=1)
            q, c = np.nonzero(go)
            # A vector is repeated for every cell, so a whole batch at once could be hundreds of times its size.
            for at in range(0, len(q), PIECE_ROWS):
                some = slice(at, at + PIECE_ROWS)
                yield b.iloc[q[some]].reset_index(drop=True).assign(cell=s["cell"][c[some]].astype("int32"))

    visits = queries.mapInPandas(visit, StructType(queries.schema.fields + [StructField("cell", IntegerType())]))

    # Full cells are cut on both sides, so no group outgrows slice_rows on average.
    asked = visits.groupBy("cell").agg(F.count(F.lit(1)).alias("asked")).toPandas()
    parts = stats.merge(asked, on="cell", how="left").fillna({"asked": 0})
    parts["c_parts"] = np.ceil(parts["n"] / slice_rows).clip(lower=1).astype("int32")
    parts["q_parts"] = np.ceil(parts["asked"] / slice_rows).clip(lower=1).astype("int32")
    plan = F.broadcast(spark.createDataFrame(parts[["cell", "c_parts", "q_parts"]]))

    def each(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def one(n: str, *cols: str) -> Column:
        return F.pmod(F.xxhash64(*cols), F.col(n)).cast("int")

    left = visits.join(plan, "cell").withColumn("q_part", one("q_parts", *keys)).withColumn("c_part", each("c_parts"))
    right = assigned.join(plan, "cell").withColumn("c_part", one("c_parts", chunk_id)).withColumn("q_part", each("q_parts"))
    group = ["cell", "c_part", "q_part"]

    def nearest(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame({name: [] for name in [*keys, chunk_id, "distance"]})
        units, ids = _unit(c[vec]), c[chunk_id].to_numpy()
        rows, picks, dists = [], [], []
        # Blocks of queries bound the distance matrix.
        for at in range(0, len(q), BLOCK_QUERIES):
            dist = np.round(1.0 - _unit(q[vec].iloc[at:at + BLOCK_QUERIES]) @ units.T, 9)
            for row, d in enumerate(dist):
                pick = _best(d, ids, k)
                rows.append(np.full(len(pick), at + row))
                picks.append(ids[pick])
                dists.append(d[pick])
        out = q[keys].iloc[np.concatenate(rows)].reset_index(drop=True)
        return out.assign(**{chunk_id: np.concatenate(picks), "distance": np.concatenate(dists)})

    found = left.select(*group, *keys, vec).groupBy(*group).cogroup(
        right.select(*group, chunk_id, vec).groupBy(*group)
    ).applyInPandas(nearest, _schema(queries, chunks, keys, chunk_id))
    return _rank(found, keys, chunk_id, k)
