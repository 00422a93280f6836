"""Minimal perfect hashing of a distributed set of integers.

Keys are dealt to buckets by one hash.  Each bucket, a few hundred keys, is placed
by a task of its own: its keys fall into cells, and cells, fullest first, get the
first seed that sends their keys to free places.  A key's index is the number of keys in
earlier buckets plus its place, so indices run from 0 to n - 1 without gaps.  The
table keeps its keys, since a foreign number would get an index as well.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

BUCKET = 400  # keys of a bucket
CELL = 4  # keys of a cell

# The multipliers of the 64-bit mixing function of splitmix.
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def mixed(keys: np.ndarray, seed) -> np.ndarray:
    """A 64-bit hash of ``keys`` (int64) for each seed; the two broadcast against each other."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.int64).view(np.uint64) + np.asarray(seed, np.uint64) * np.uint64(MIX[0]) + np.uint64(MIX[0])
        x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[1])
        x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[2])
        return x ^ (x >> np.uint64(31))


def cells_of(size):
    return -(-size // CELL)


def place(keys: np.ndarray) -> np.ndarray:
    """The seed of each cell of a bucket with the distinct ``keys``."""
    n, tries = len(keys), 64
    cell = (mixed(keys, 1) % np.uint64(cells_of(n))).astype(np.int64)
    seeds, free = np.zeros(cells_of(n), np.int64), np.ones(n, bool)
    sizes = np.bincount(cell, minlength=len(seeds))
    for c in np.argsort(-sizes, kind="stable"):
        if not sizes[c]:
            break
        mine, first = keys[cell == c], 0
        while True:
            at = np.sort((mixed(mine[None, :], 2 + first + np.arange(tries)[:, None]) % np.uint64(n)).astype(np.int64), axis=1)
            good = free[at].all(axis=1) & (at[:, 1:] != at[:, :-1]).all(axis=1)
            if good.any():
                k = int(good.argmax())
                seeds[c], free[at[k]] = first + k, False
                break
            first += tries
    return seeds


@dataclass
class PerfectHash:
    """Index of known keys; ``keys`` is None until the table is verified against its keys."""

    sizes: np.ndarray  # keys in each bucket
    seeds: np.ndarray  # of all cells of all buckets
    keys: np.ndarray | None = None

    def __post_init__(self):
        self.offsets = np.cumsum(self.sizes) - self.sizes
        cells = cells_of(self.sizes)
        self.cells, self.first_cell = cells, np.cumsum(cells) - cells

    def __len__(self) -> int:
        return int(self.sizes.sum())

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """What a broadcast carries; the class is called with them again."""
        return self.sizes, self.seeds, self.keys

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The index of each of ``keys``; -1 for what is not in the table."""
        if not len(self) or not len(keys):
            return np.full(len(keys), -1)
        b = (mixed(keys, 0) % np.uint64(len(self.sizes))).astype(np.int64)
        known = self.sizes[b] > 0
        cell = (mixed(keys, 1) % np.maximum(self.cells[b], 1).astype(np.uint64)).astype(np.int64)
        seed = self.seeds[np.minimum(self.first_cell[b] + cell, len(self.seeds) - 1)]
        at = self.offsets[b] + (mixed(keys, 2 + seed) % np.maximum(self.sizes[b], 1).astype(np.uint64)).astype(np.int64)
        at = np.where(known, at, 0)
        return np.where(known & (self.keys[at] == keys), at, -1) if self.keys is not None else np.where(known, at, -1)


def build(keys: DataFrame, n: int) -> PerfectHash:
    """The table of the ``n`` distinct longs in the one column of ``keys``; buckets are placed by Spark.

    What comes to the driver is the table itself, some 11 bytes a key: the caller bounds ``n``.
    """
    buckets = max(1, -(-n // BUCKET))
    name = keys.columns[0]

    def deal(batches):
        for batch in batches:
            k = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((mixed(k, 0) % np.uint64(buckets)).astype(np.int64)), pa.array(k)], names=["bucket", "key"])

    def placed(part: pd.DataFrame) -> pd.DataFrame:
        k = part["key"].to_numpy(np.int64)
        return pd.DataFrame({"bucket": part["bucket"].iloc[:1], "size": [len(k)], "seeds": [place(k).tolist()], "keys": [k.tolist()]})

    dealt = keys.select(name).mapInArrow(deal, "bucket long, key long")
    rows = dealt.groupBy("bucket").applyInPandas(placed, "bucket long, size long, seeds array<long>, keys array<long>").toArrow()
    order = np.argsort(rows["bucket"].to_numpy())
    sizes = np.zeros(buckets, np.int64)
    sizes[rows["bucket"].to_numpy()] = rows["size"].to_numpy()
    flat = lambda c: np.concatenate([np.zeros(0, np.int64), *(rows[c][int(i)].values.to_numpy() for i in order)])
    table, known = PerfectHash(sizes, flat("seeds")), flat("keys")
    at = table.index(known)
    slots = np.zeros(len(known), np.int64)
    slots[at] = known
    if len(np.unique(at)) != len(known):
        raise ValueError("keys were not distinct")
    return PerfectHash(sizes, table.seeds, slots)
