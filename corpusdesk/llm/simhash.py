"""SimHash near-dedup with vantage-point trees.

Equal fingerprints are one point with its smallest document, so groups of copies
are gone before any search.  A vantage-point tree made from a bounded sample
cuts Hamming space into shards: a node sends points within ``mu`` of its vantage
point to the left, others to the right, and points of the band (mu, mu + radius]
to both, since by the triangle inequality only they can be within ``radius`` of a
point on the left.  Each pair therefore meets in at least one shard, where the
same recursion goes on down to small leaves that are compared in full.  Shards
hand on one row per linked point (its first linked point), never pairs; rows that
meet in several shards connect their groups.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField

from corpusdesk.llm.common import add_columns, discard, documents, settle

SHINGLE, SEED, BITS, RADIUS = 3, 42, 64, 2
SHARD = 2_000  # points a shard should hold before its borders are added
MAX_SHARDS = 16_384  # the tree stays this small; above it shards grow
FULL = 1 << 16  # points of a shard that one group compares within seconds; of fuller shards, parts meet in pairs
PER_SHARD = 64  # points of the sample for each shard
LEAF = 384  # points that are compared in full
CHUNK = 1 << 16


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    """64 bits; a bit is one if it is set in over half of the shingles' hashes.  No words: zero."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < size:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(size))))
    n = max(1, len(words) - size + 1)
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), shingles), ">u8", n)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, n, CHUNK):
        ones += np.unpackbits(hashes[i:i + CHUNK].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", name: str = "fp") -> DataFrame:
    """``keep`` plus the fingerprint of the whole text as a signed long."""

    def make():
        return lambda texts: [np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64).tolist()]

    return add_columns(docs, [StructField(name, LongType())], make, keep, text)


# --- the tree -------------------------------------------------------------------


def distances(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage)


def choose(points: np.ndarray, radius: int, tries: int = 6) -> tuple[np.uint64, int, float]:
    """(vantage point, mu, points after the split per point before it): the split with the smallest border."""
    best = None
    for k in range(tries):
        v = points[(len(points) - 1) * k // max(1, tries - 1)]
        below = np.cumsum(np.bincount(distances(points, v), minlength=BITS + 1 + radius)[:BITS + 1 + radius])
        left = below[:BITS + 1]
        band = below[radius:BITS + 1 + radius] - left
        even = (left >= 0.3 * len(points)) & (left <= 0.7 * len(points))
        cost = np.where(even, band, 4 * len(points) + np.abs(2 * left - len(points)))
        mu = int(cost.argmin())
        if best is None or cost[mu] < best[0]:
            best = (cost[mu], v, mu, max(left[mu] + band[mu], len(points) - left[mu]) / len(points))
    return best[1], best[2], best[3]


def build_tree(sample: np.ndarray, depth: int, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A complete tree as arrays: node k has the children 2k + 1 and 2k + 2; mu < 0 ends a branch early."""
    size = 2 ** depth - 1
    vantage, mu = np.zeros(size, np.uint64), np.full(size, -1, np.int16)
    todo = [(0, sample)]
    while todo:
        k, points = todo.pop()
        if k >= size or len(points) < 8:
            continue
        vantage[k], cut, _ = choose(points, radius)
        d = distances(points, vantage[k])
        if not 0 < (d <= cut).sum() < len(points):
            continue
        mu[k] = cut
        todo += [(2 * k + 1, points[d <= cut]), (2 * k + 2, points[d > cut])]
    return vantage, mu


def route(points: np.ndarray, tree: tuple[np.ndarray, np.ndarray], radius: int = RADIUS) -> list[tuple[int, np.ndarray]]:
    """(shard, indices of the points that it must see)."""
    vantage, mu = tree
    out, todo = [], [(0, np.arange(len(points)))]
    while todo:
        k, rows = todo.pop()
        if not len(rows):
            continue
        if k >= len(mu) or mu[k] < 0:
            out.append((k, rows))
            continue
        d = distances(points[rows], vantage[k])
        todo += [(2 * k + 1, rows[d <= mu[k] + radius]), (2 * k + 2, rows[d > mu[k]])]
    return out


class Forest:
    """Disjoint sets over 0..n-1 whose root is the smallest member; takes arrays of links."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        r = self.parent[x]
        while (up := self.parent[r]).tobytes() != r.tobytes():
            r = up
        self.parent[x] = r
        return r

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.find(a), self.find(b)
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.parent, np.maximum(ra, rb), np.minimum(ra, rb))


def link(points: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each of the distinct ``points`` the index of the first one of its group; groups link within ``radius``."""
    forest = Forest(len(points))

    def compare(rows: np.ndarray, others: np.ndarray) -> None:
        near = np.bitwise_count(points[rows][:, None] ^ points[others][None, :]) <= radius
        i, j = np.nonzero(near)
        apart = rows[i] != others[j]
        forest.unite(rows[i[apart]], others[j[apart]])

    todo = [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        if len(rows) <= LEAF:
            compare(rows, rows)
            continue
        v, mu, left = choose(points[rows], radius)
        if left > 0.9:  # a dense ball, which no vantage point divides: all blocks meet
            parts = [rows[i:i + LEAF] for i in range(0, len(rows), LEAF)]
            for i, part in enumerate(parts):
                for other in parts[i:]:
                    compare(part, other)
            continue
        d = distances(points[rows], v)
        todo += [rows[d <= mu + radius], rows[d > mu]]
    return forest.find(np.arange(len(points)))


# --- on Spark -------------------------------------------------------------------


def near_links(points: DataFrame, radius: int = RADIUS, bits: int = BITS) -> DataFrame:
    """(fp, root): points of the distinct ``points`` (fp) with a neighbour within ``radius``, once per shard that sees them.

    Only the low ``bits`` are a fingerprint; what is above them is the number of a
    table, and points of different tables never meet.
    """
    low = np.uint64(2 ** bits - 1)
    n = points.count()
    depth = min(MAX_SHARDS, max(1, -(-n // SHARD)))
    depth = (depth - 1).bit_length()
    share = min(1.0, PER_SHARD * 2 ** depth / max(1, n))
    chosen = points.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else points
    sample = np.sort(np.array([r.fp for r in chosen.select("fp").collect()], np.int64).view(np.uint64) & low) if depth else np.zeros(0, np.uint64)
    tree = points.sparkSession.sparkContext.broadcast(build_tree(sample, depth, radius))

    def deal(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            table = (fps >> np.uint64(bits)).astype(np.int64) << 32 if bits < BITS else np.zeros(len(fps), np.int64)
            for shard, rows in route(fps & low, tree.value, radius):
                yield pa.RecordBatch.from_arrays([pa.array(table[rows] + shard), pa.array(fps[rows].view(np.int64))], names=["shard", "fp"])

    def inside(part: pd.DataFrame) -> pd.DataFrame:
        fps = np.unique(part["fp"].to_numpy(np.int64).view(np.uint64))
        root = link(fps, radius)
        grouped = np.flatnonzero(np.bincount(root, minlength=len(fps))[root] > 1)
        return pd.DataFrame({"fp": fps[grouped].view(np.int64), "root": fps[root[grouped]].view(np.int64)})

    dealt = settle(points.select("fp").mapInArrow(deal, "shard long, fp long"), "dealt")
    found = settle(meet(dealt).groupBy("shard", "one", "other").applyInPandas(inside, "fp long, root long"), "links")
    discard(dealt)
    return found


def meet(dealt: DataFrame) -> DataFrame:
    """(shard, one, other, fp): groups of at most about FULL points in which all pairs of a shard meet.

    No vantage point divides a dense ball, such as the points of very many near copies.
    A shard that holds more points than FULL is cut into parts by a hash, and each pair
    of parts is a group; all other shards are one group.
    """
    full = dealt.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FULL)
    # two parts of n / k points make a group
    full = settle(full.select("shard", F.ceil(2 * F.col("n") / FULL).cast("int").alias("k")), "full")
    rows = dealt.join(full, "shard", "left").withColumn("k", F.coalesce("k", F.lit(1)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    return rows.select("shard", F.least("part", "q").alias("one"), F.greatest("part", "q").alias("other"), "fp")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of the edges (a, b) can reach.

    Large-star and small-star rounds: every node is tied to the smallest node
    around it until only stars are left, in a number of rounds that grows with the
    logarithm of the longest path.  Each round is written, so a lost executor
    costs no more than a part of it.
    """

    def tidy(e: DataFrame) -> DataFrame:
        return settle(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges")

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    e = tidy(edges)
    before, now = None, mark(e)
    while now[0] and now != before:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        least = settle(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = settle(both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), "large")
        lowest = settle(large.groupBy("a").agg(F.min("b").alias("m")), "lowest")
        small = large.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(lowest.select("a", "m"))
        done, e = e, tidy(small)
        discard(done, least, large, lowest)
        del done, least, large, lowest, both, small
        before, now = now, mark(e)
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).union(e.select("b", "b").distinct())


def group_points(links: DataFrame) -> DataFrame:
    """(fp, label) of linked points from the settled (fp, root) rows of all shards."""
    first = settle(links.groupBy("fp").agg(F.min("root").alias("m")), "first")
    met = links.join(first, "fp").where("root != m").select(F.col("root").alias("a"), F.col("m").alias("b"))
    found = settle(components(met), "components")
    return first.join(found, first["m"] == found["node"], "left").select("fp", F.coalesce("label", "m").alias("label"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(key, fingerprint, component_id): one row per document.

    Fingerprints link at ``radius`` or fewer differing bits; ``component_id`` is the
    smallest key reachable over links, the document's own included (a null key never
    is, unless the group has no other).  Texts that are null, empty or without words
    have fingerprint zero and link like any other; an empty table gives no rows.
    """
    fps = settle(fingerprints(docs, [key], text).select(F.col(key).alias("k"), "fp"), "fingerprints")
    points = settle(fps.groupBy("fp").agg(F.min("k").alias("least")), "points")
    labels = settle(group_points(near_links(points, radius)), "labels")
    linked = settle(labels.join(points, "fp"), "linked")
    lowest = settle(linked.groupBy("label").agg(F.min("least").alias("component_id")), "lowest")
    linked_ids = linked.join(lowest, "label").select("fp", "component_id")
    alone = points.join(labels, "fp", "left_anti").select("fp", F.col("least").alias("component_id"))
    ids = settle(linked_ids.union(alone), "ids")
    return fps.join(ids, "fp").select(F.col("k").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
