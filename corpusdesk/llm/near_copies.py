"""One document of each group of near copies, by SimHash tables and vantage-point trees.

For a similarity of 0.8 on five-word shingles a single 64-bit fingerprint is too
coarse: near copies differ in up to a dozen bits, and balls of that radius cover
half of Hamming space.  So a text gets ``TABLES`` short fingerprints of its
distinct words; near copies are within ``RADIUS`` bits in at least one of them.
The trees of ``simhash`` find the groups of each table.  A group is never turned
into pairs: its members are paired with one member that differs from table to
table, so a text has TABLES pairs at most.  They are compared shingle by shingle,
and those that reach the similarity are links.

That ties most copies cheaply but promises nothing, so an exact join follows for
texts that are not tied to each other yet.  Two texts of the similarity share a
shingle among the first fifth of both, in any order of shingles that is the same
for all texts (prefix filter); common shingles come last in it, so few texts meet
without reason.  The texts of a shingle are held against each other inside a task: their
lengths, the place of the shingle and a bit map of all shingles bound what two of them
can have in common.  A task hands on one row per text, the group that it may belong to, and
never pairs.  The groups of all shingles make clusters, in which the full sets of shingles
are compared; only links that join two groups leave the task.
"""

from __future__ import annotations

import math
from functools import partial
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField

from corpusdesk.llm.common import add_columns, discard, settle, worker_store
from corpusdesk.llm.simhash import Forest, components, group_points, near_links

TABLES, TABLE_BITS, RADIUS = 4, 48, 2
LONGS = TABLES * TABLE_BITS // 64
MAX_BITS = TABLES * TABLE_BITS * 0.14  # pairs of a group that differ in more bits of all tables are left to the exact join
SHINGLE, SIMILARITY = 5, 0.8
WORDS = 300_000  # words whose hashes a worker keeps
SAMPLE, SAMPLE_SHARE = 4_000, 100  # so many texts, or one in so many if that is more, tell which shingles are common
COMMON_IN, COMMON = 8, 200_000  # common: in so many texts of the sample; so many are told apart at most.  Only the order depends on it
SMALL = 100_000  # rows of ids that may be broadcast
MAP_BITS = 1_024  # bits of the map of a text's shingles
FULL, SIDE, RUN = 8_192, 512, 32  # texts of a shingle that one group compares; of a block inside it; of a run that is compared with others at once
ROW_BITS, PLACE_BITS = 24, 22  # of a text's number inside its partition; of a place in a text (later ones count as the last one)
WIDE_BITS, WIDE = 16_384, 4_096  # bits of the maps of texts in clusters; such texts that one group compares
SET_TEXTS, SET_SHINGLES = 2_048, 1 << 20  # texts, or their shingles, whose sets one group compares


class WordHashes(dict):
    """Word -> as many hash bits as all tables have."""

    def __missing__(self, word: bytes) -> bytes:
        import xxhash

        if len(self) > WORDS:
            self.clear()
        found = self[word] = b"".join(xxhash.xxh3_64_digest(word, seed) for seed in range(LONGS))
        return found


def wide_print(text: bytes | None) -> list[int]:
    """LONGS signed numbers whose bits are one where most of the text's distinct words have a one."""
    store = worker_store("near_copies")
    if "hashes" not in store:
        store["hashes"] = WordHashes()
    words = set((text or b"").lower().split())
    if not words:
        return [0] * LONGS
    ones, raw = np.zeros(64 * LONGS, np.int64), b"".join(map(store["hashes"].__getitem__, words))
    rows = np.frombuffer(raw, np.uint8).reshape(-1, 8 * LONGS)
    for i in range(0, len(rows), 4096):
        ones += np.unpackbits(rows[i:i + 4096], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(rows)).view(">i8").tolist()


def shingles_of(text: bytes | None, size: int = SHINGLE) -> list[bytes]:
    """A shorter text is one shingle, a text without words has none."""
    words = (text or b"").lower().split()
    if not words:
        return []
    return list(map(b" ".join, zip(*(words[k:] for k in range(size))))) if len(words) >= size else [b" ".join(words)]


def shingle_hashes(text: bytes | None, size: int = SHINGLE) -> list[int]:
    """32-bit hashes of the distinct shingles."""
    import xxhash

    found = map(partial(xxhash.xxh32_intdigest, seed=1), shingles_of(text, size))
    return np.unique(np.fromiter(found, np.uint32)).view(np.int32).tolist()


def long_hashes(text: bytes | None) -> np.ndarray:
    """64-bit hashes of the distinct shingles, sorted; [0] for a text without words."""
    import xxhash

    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, shingles_of(text)), np.uint64)).view(np.int64) if (text or b"").split() else np.zeros(1, np.int64)


def prefix(hashes: np.ndarray, similarity: float, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first hashes in the order of all texts: a text of this similarity has one of them among its own first ones.

    ``common`` (sorted) come last, those with the highest ``counts`` at the end.
    """
    n = len(hashes)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        hashes = hashes[np.lexsort((hashes, np.where(common[at] == hashes, counts[at], 0)))]
    return hashes[:n - needed_of(n, similarity) + 1]


def needed_of(n: int, similarity: float) -> int:
    """Shingles that a text of ``n`` has to share at least."""
    return max(1, math.ceil(similarity * n - 1e-9))


def only_shared(batches):
    """Rows, sorted by their first column, whose first value another row has as well."""
    last, given = None, False
    for batch in batches:
        s = batch.column(0).to_numpy()
        if not len(s):
            continue
        same = s[1:] == s[:-1]
        goes_on = last is not None and last.column(0)[0].as_py() == s[0]
        if goes_on and not given:
            yield last
        kept = np.concatenate(([goes_on], same)) | np.concatenate((same, [False]))
        if kept.any():
            yield batch.filter(pa.array(kept))
        last, given = batch.slice(len(s) - 1), bool(kept[-1])


def common_shingles(rows: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of shingles that many texts of a sample have."""
    share = min(1.0, max(SAMPLE / max(1, n), 1 / SAMPLE_SHARE))
    some = rows.where(F.pmod(F.xxhash64("x"), F.lit(1 << 30)) < int(share * (1 << 30)))
    told = add_columns(some, [StructField("s", ArrayType(LongType()))], lambda: lambda texts: [[long_hashes(t).tolist() for t in texts]], [])
    counts = settle(told.select(F.explode("s").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON_IN), "common")
    least, held = 0, 0
    for r in sorted(counts.groupBy(F.least("n", F.lit(10_000)).alias("n")).agg(F.count(F.lit(1)).alias("m")).collect(), reverse=True):
        if held + r.m > COMMON:
            break
        least, held = r.n, held + r.m
    found = sorted((r.s, r.n) for r in counts.where(F.col("n") >= least).collect()) if held else []
    return np.array([s for s, _ in found], np.int64), np.array([c for _, c in found], np.int64)


def bit_map(hashes: np.ndarray, bits: int = MAP_BITS) -> list[int]:
    """For each of ``bits`` whether an odd number of shingles falls on it: two maps differ in no more bits than the sets in shingles."""
    odd = np.bincount(hashes.view(np.uint64).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(bool)).view(np.int64).tolist()


def may_be_alike(n, rest, maps, m, rest_m, maps_m, similarity: float) -> np.ndarray:
    """Can texts (one per row, against one per column) have the similarity?

    ``n`` is the number of shingles and ``rest`` how many of them stand from the common one on.
    That one is held to be the first one that the two share: if it is not, they pass where the first one is.
    Without ``maps`` only these numbers count.
    """
    total = (n[:, None] + m[None, :]).astype(np.float64)
    shared = similarity / (1 + similarity) * total - 1e-9
    found = np.minimum(rest[:, None], rest_m[None, :]) >= shared
    if maps is None:
        return found
    rows, cols = np.nonzero(found)
    step = (1 << 20) // maps.shape[1]
    for i in range(0, len(rows), step):
        r, c = rows[i:i + step], cols[i:i + step]
        apart = np.bitwise_count(maps[r] ^ maps_m[c]).sum(axis=1, dtype=np.int64)
        found[r, c] = total[r, c] - apart >= 2 * shared[r, c]
    return found


def blocks_that_meet(group, n, rest, maps, similarity: float):
    """Pairs (rows, other rows) of different groups that may be alike, block by block."""
    order = np.argsort(n, kind="stable")
    n, rest, group, maps = n[order], rest[order], group[order], maps if maps is None else maps[order]
    for i in range(0, len(n), SIDE):
        a = slice(i, min(i + SIDE, len(n)))
        for j in range(i, len(n), SIDE):
            b = slice(j, min(j + SIDE, len(n)))
            if n[a][-1] < similarity * n[j] - 1e-9:
                break
            needed = similarity / (1 + similarity) * (n[i] + n[j]) - 1e-9
            if min(rest[a].max(), rest[b].max()) < needed:
                continue
            found = may_be_alike(n[a], rest[a], maps if maps is None else maps[a], n[b], rest[b], maps if maps is None else maps[b], similarity)
            rows, cols = np.nonzero(found & (group[a][:, None] != group[b][None, :]))
            yield order[i + rows], order[j + cols]


def rows_that_meet(cuts: np.ndarray, group, n, rest, similarity: float) -> np.ndarray:
    """Of the runs between ``cuts``, the rows that may be alike to a row of another group in their run, by numbers alone."""
    met, sizes = np.zeros(len(n), bool), np.diff(cuts)
    behind = np.repeat(cuts[1:], sizes) - np.arange(len(n))  # rows from here to the end of the run
    small = np.repeat(sizes <= RUN, sizes)
    for d in range(1, min(RUN, int(sizes.max(initial=0)))):
        i = np.flatnonzero((behind > d) & small)
        if not len(i):
            break
        found = (np.minimum(rest[i], rest[i + d]) >= similarity / (1 + similarity) * (n[i] + n[i + d]) - 1e-9) & (group[i] != group[i + d])
        met[i[found]] = met[i[found] + d] = True
    for k in np.flatnonzero(sizes > RUN):
        run = slice(cuts[k], cuts[k + 1])
        for rows, others in blocks_that_meet(group[run], n[run], rest[run], None, similarity):
            met[cuts[k] + rows] = met[cuts[k] + others] = True
    return met


def meet_by_shingle(group, n, rest, maps, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows that may be alike to a row of another group, the first row of the groups that may be one) of one shingle's rows."""
    names, group = np.unique(group, return_inverse=True)
    forest, met = Forest(len(names)), np.zeros(len(n), bool)
    for rows, others in blocks_that_meet(group, n, rest, maps, similarity):
        met[rows] = met[others] = True
        forest.unite(group[rows], group[others])
    first = np.full(len(names), len(n))
    np.minimum.at(first, group, np.arange(len(n)))
    return met, first[forest.find(group)]


def whole_runs(batches, keys: list[str]):
    """Tables of whole runs of rows with equal ``keys`` (longs), with the places where runs begin and end."""
    held = None
    for batch in chain(batches, [None]):
        if batch is not None:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if held is None or not held.num_rows:
            continue
        k = np.stack([held.column(c).to_numpy() for c in keys])
        cuts = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1
        stop = held.num_rows if batch is None else int(cuts[-1]) if len(cuts) else 0
        if stop:
            yield held.slice(0, stop).combine_chunks(), np.concatenate(([0], cuts[cuts < stop], [stop]))
            held = held.slice(stop)


def cut_full(rows: DataFrame, key: str, weight, full: int, by: str) -> DataFrame:
    """``rows`` with (one, other): all pairs of rows of a ``key`` meet in a group; a key with more than ``full`` is cut into parts by the hash of ``by``."""
    sizes = rows.groupBy(key).agg(weight.alias("size")).where(F.col("size") > full)
    parts = settle(sizes.select(key, F.ceil(2 * F.col("size") / full).cast("int").alias("k")), "full")
    rows = rows.join(parts, key, "left").withColumn("k", F.coalesce("k", F.lit(1)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64(by), F.col("k")).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    return rows.withColumns({"one": F.least("part", "q"), "other": F.greatest("part", "q")}).drop("k", "part", "q")


def meeting(shared: DataFrame, similarity: float) -> DataFrame:
    """(s, one, other, number, n, rest): rows of ``shared`` (s, number, group, n, rest) that may be alike to a row of another group with their shingle."""
    names = ["s", "one", "other", "number", "n", "rest"]

    def run(batches):
        for table, cuts in whole_runs(batches, names[:3]):
            group, n, rest = (table.column(c).to_numpy().astype(np.int64) for c in ("group", "n", "rest"))
            met = rows_that_meet(cuts, group, n, rest, similarity)
            if met.any():
                yield from table.select(names).filter(pa.array(met)).to_batches()

    dealt = cut_full(shared, "s", F.count(F.lit(1)), FULL, "number").select(*names, "group")
    dealt = dealt.repartition("s", "one", "other").sortWithinPartitions("s", "one", "other")
    return dealt.mapInArrow(run, "s long, one int, other int, number long, n int, rest int")


def candidates(met: DataFrame, similarity: float) -> DataFrame:
    """(x, g, r): texts that may be alike to one of another group, with a group that theirs may be one with.

    ``met`` has (s, one, other, x, g, n, rest, map): text x of group g and the map of its shingles.
    """
    def run(batches):
        for table, cuts in whole_runs(batches, ["s", "one", "other"]):
            x, g = table.column("x").combine_chunks(), table.column("g").combine_chunks()
            number = np.unique(np.array(g.to_pylist(), object), return_inverse=True)[1]
            n, rest = (table.column(c).to_numpy().astype(np.int64) for c in ("n", "rest"))
            maps = table.column("map").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(table.num_rows, -1)
            here, there = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, j in zip(cuts.tolist(), cuts[1:].tolist()):
                found, first = meet_by_shingle(number[i:j], n[i:j], rest[i:j], maps[i:j], similarity)
                rows = np.flatnonzero(found)
                here.append(i + rows)
                there.append(i + first[rows])
            at = pa.array(np.concatenate(here))
            yield pa.RecordBatch.from_arrays([x.take(at), g.take(at), g.take(pa.array(np.concatenate(there)))], names=["x", "g", "r"])

    dealt = met.repartition("s", "one", "other").sortWithinPartitions("s", "one", "other")
    return dealt.mapInArrow(run, "x binary, g binary, r binary").distinct()


def links_inside(group: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Pairs of the similarity that join different groups, as few as it takes."""
    sizes = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(sizes, kind="stable")
    flat = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)[1]
    n = sizes[order]
    start = np.cumsum(n) - n
    names, group = np.unique(group[order], return_inverse=True)
    forest, mark, out = Forest(len(names)), np.zeros(int(flat.max()) + 1, bool), []
    for i in range(len(n) - 1):
        stop = int(np.searchsorted(n, n[i] / similarity + 1e-6, side="right"))
        if stop <= i + 1:
            continue
        root = forest.find(group)
        others = np.flatnonzero(root[i + 1:stop] != root[i]) + i + 1
        if not len(others):
            continue
        mine = flat[start[i]:start[i] + n[i]]
        mark[mine] = True
        if len(others) * 2 > stop - i - 1:  # most of the run: it is read as it stands
            both = np.add.reduceat(mark[flat[start[i + 1]:start[stop - 1] + n[stop - 1]]], start[i + 1:stop] - start[i + 1], dtype=np.int64)[others - i - 1]
        else:
            both = np.array([np.count_nonzero(mark[flat[start[j]:start[j] + n[j]]]) for j in others], np.int64)
        mark[mine] = False
        alike = others[both >= similarity * (n[i] + n[others] - both) - 1e-9]
        _, first = np.unique(root[alike], return_index=True)
        for j in alike[first]:
            out.append((int(order[i]), int(order[j])))
        forest.unite(np.full(len(alike), group[i]), group[alike])
    return out


def untied_links(rows: DataFrame, nodes: DataFrame, tied: DataFrame, n: int, similarity: float) -> DataFrame:
    """(a, b): links that join texts which are not ``tied`` (node, label) to each other, so that nothing of the similarity stays apart."""
    held = rows.sparkSession.sparkContext.broadcast(common_shingles(rows, n))

    def make():
        def block(texts):
            found = [long_hashes(t) for t in texts]
            return [[prefix(h, similarity, *held.value).tolist() for h in found], [len(h) for h in found], [bit_map(h) for h in found]]

        return block

    fields = [StructField("p", ArrayType(LongType())), StructField("n", IntegerType()), StructField("map", ArrayType(LongType()))]
    found = add_columns(rows, fields, make, ["x"]).groupBy("x").agg(*(F.first(c).alias(c) for c in ("p", "n", "map")))
    found = settle(found.withColumn("id", F.monotonically_increasing_id()), "prefixes")  # the written numbers stay
    # a text's number and a place in it in one long: most rows of the next step are dropped at once
    row = F.col("id").bitwiseAND((1 << 33) - 1)
    number = F.shiftleft(F.shiftright("id", 33), ROW_BITS) + row
    if (found.agg(F.max(row)).first()[0] or 0) >> ROW_BITS:
        raise ValueError("more texts in one partition than can be numbered: use more partitions")
    flat = found.select(F.posexplode("p").alias("pos", "s"), number.alias("number"))
    flat = flat.select("s", (F.shiftleft("number", PLACE_BITS) + F.least("pos", F.lit((1 << PLACE_BITS) - 1))).alias("at")).repartition("s").sortWithinPartitions("s")
    shared = settle(flat.mapInArrow(only_shared, "s long, at long"), "shared")
    labels = found.select(number.alias("number"), "x", "n", "map").join(tied, F.col("x") == F.col("node"), "left").select("number", "x", "n", "map", F.coalesce("label", "x").alias("g"))
    place = F.col("at").bitwiseAND((1 << PLACE_BITS) - 1)
    told = shared.withColumn("number", F.shiftright("at", PLACE_BITS)).join(labels.select("number", "n", F.xxhash64("g").alias("group")), "number")
    told = settle(told.select("s", "number", "group", "n", (F.col("n") - place).cast("int").alias("rest")), "told")
    discard(shared)
    met = settle(meeting(told, similarity), "met")
    discard(told)
    may = settle(candidates(met.join(labels.select("number", "x", "g", "map"), "number"), similarity), "candidates")
    discard(found, met)
    # the same inside the clusters with wide maps, which tell long texts apart
    wide = shingle_sets(clustered(may), rows, nodes, lambda h: bit_map(h, WIDE_BITS), "map")
    wide = cut_full(settle(wide.withColumn("s", F.xxhash64("c")), "wide"), "s", F.count(F.lit(1)), WIDE, "x")
    again = settle(candidates(wide.withColumn("rest", F.col("n")), similarity), "candidates")
    discard(may)
    sets = settle(shingle_sets(clustered(again), rows, nodes, lambda h: h.tolist(), "s"), "sets")
    dealt = cut_full(sets, "c", F.greatest(F.count(F.lit(1)) * (SET_SHINGLES // SET_TEXTS), F.sum(F.size("s"))), SET_SHINGLES, "x")
    # small clusters share a task's group
    many = max(1, (sets.agg(F.sum(F.size("s") + F.lit(SET_SHINGLES // SET_TEXTS))).first()[0] or 0) // SET_SHINGLES)
    dealt = dealt.withColumn("bucket", F.when(F.col("other") == 0, F.pmod(F.xxhash64("c"), F.lit(many))).otherwise(F.xxhash64("c", "one", "other")))

    def verify(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, cluster in part.groupby(["c", "one", "other"], sort=False):
            x, s = cluster["x"].tolist(), [np.asarray(v, np.int64) for v in cluster["s"]]
            number = np.unique(np.array(cluster["g"].tolist(), object), return_inverse=True)[1]
            out += [(x[i], x[j]) for i, j in links_inside(number, s, similarity)]
        return pd.DataFrame(out, columns=["a", "b"])

    links = settle(dealt.groupBy("bucket").applyInPandas(verify, "a binary, b binary"), "untied")
    discard(again, sets)
    return links


def clustered(may: DataFrame) -> DataFrame:
    """(x, g, c): the texts of ``may`` (x, g, r) and the cluster that their group belongs to."""
    clusters = settle(components(may.select(F.col("g").alias("a"), F.col("r").alias("b"))), "clusters")
    return settle(may.select("x", "g").distinct().join(clusters, F.col("g") == F.col("node")).select("x", "g", F.col("label").alias("c")), "clustered")


def shingle_sets(members: DataFrame, rows: DataFrame, nodes: DataFrame, make, name: str) -> DataFrame:
    """``members`` (x and more) with n, the number of distinct shingles, and what ``make`` says of their hashes as ``name``."""
    needed = settle(members.join(nodes.select("x", "least"), "x"), "needed")
    sought = F.broadcast(needed) if needed.count() <= SMALL else needed
    asked = rows.withColumnRenamed("x", "y").join(sought, F.col("k").eqNullSafe(F.col("least")) & (F.col("y") == F.col("x"))).select(*members.columns, "text")

    def block(texts):
        found = [long_hashes(t) for t in texts]
        return [[len(h) for h in found], [make(h) for h in found]]

    fields = [StructField("n", IntegerType()), StructField(name, ArrayType(LongType()))]
    return add_columns(asked, fields, lambda: block, members.columns).dropDuplicates(["x"])


def alike(pairs: DataFrame, rows: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose shingles have the similarity."""
    needed = settle(pairs.select(F.col("a").alias("x")).union(pairs.select("b")).distinct().join(nodes.select("x", "least"), "x"), "needed")
    sought = F.broadcast(needed) if needed.count() <= SMALL else needed
    asked = rows.withColumnRenamed("x", "y").join(sought, F.col("k").eqNullSafe(F.col("least")) & (F.col("y") == F.col("x"))).select("x", "text")
    fields = [StructField("s", ArrayType(IntegerType()))]
    shingles = settle(add_columns(asked, fields, lambda: lambda texts: [[shingle_hashes(t) for t in texts]], ["x"]).dropDuplicates(["x"]), "shingles")
    left, right = shingles.select(F.col("x").alias("a"), F.col("s").alias("sa")), shingles.select(F.col("x").alias("b"), F.col("s").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("n"))
    return settle(both.where(F.col("n") >= similarity * (F.col("na") + F.col("nb") - F.col("n"))).select("a", "b"), "near-links")


def codes(f):
    """The table's number above its bits, for all tables; ``f`` holds the tables' bits one after another."""
    out = []
    for t in range(TABLES):
        i, skip = divmod(t * TABLE_BITS, 64)
        code = F.shiftrightunsigned(F.shiftleft(F.get(f, F.lit(i)), skip), 64 - TABLE_BITS)
        beyond = skip + TABLE_BITS - 64  # bits that stand in the next long
        if beyond > 0:
            code = code.bitwiseOR(F.shiftrightunsigned(F.get(f, F.lit(i + 1)), 64 - beyond))
        out.append(code + F.lit(t << TABLE_BITS))
    return out


def bits_apart(a, b):
    return sum((F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(1, LONGS)),
               F.bit_count(F.get(a, F.lit(0)).bitwiseXOR(F.get(b, F.lit(0)))))


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` without copies: of each group the row with the smallest key stays.

    Equal texts are one group, and groups are joined where two texts share
    ``similarity`` of their distinct five-word shingles (Jaccard).  Of rows that agree
    in key and text one stays.  A null text counts as empty; texts without words are
    copies of each other; a null key is the largest.  An empty table stays empty.
    """
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").alias("k"), body.alias("text")).withColumn("x", F.unhex(F.md5("text")))
    prints = settle(add_columns(rows, [StructField("f", ArrayType(LongType()))], lambda: lambda texts: [[wide_print(t) for t in texts]], ["k", "x"]), "prints")
    nodes = settle(prints.groupBy("x").agg(F.min("k").alias("least"), F.first("f").alias("f")), "nodes")
    repeated = settle(prints.groupBy(F.col("k").alias("__rk"), F.col("x").alias("__rx")).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated")
    discard(prints)
    # members of each table's groups
    cut = nodes.select("x", "f", F.explode(F.array(*codes(F.col("f")))).alias("fp"))
    points = settle(cut.select("fp").distinct(), "points")
    near = near_links(points, RADIUS, TABLE_BITS)
    labels = settle(group_points(near), "labels")
    members = settle(cut.join(labels, "fp", "left").select("x", "f", F.coalesce("label", "fp").alias("g")), "members")
    discard(points, near, labels)
    # one member of each group, another one in every table
    middle = members.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64("g", "x").alias("h"), "x", "f")).alias("c"))
    middle = settle(middle.where("n > 1").select("g", F.col("c.x").alias("b"), F.col("c.f").alias("fb")), "middle")
    pairs = members.join(middle, "g").where("x <> b").select(F.col("x").alias("a"), "b", bits_apart(F.col("f"), F.col("fb")).alias("d")).where(F.col("d") <= MAX_BITS)
    pairs = settle(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    discard(members, middle)
    links = alike(pairs, rows, nodes, similarity)
    found = settle(components(links), "components")
    discard(pairs)
    # all that these did not tie
    more = untied_links(rows, nodes, found, nodes.count(), similarity)
    if not more.isEmpty():
        found = settle(components(links.union(more)), "components")
    # the smallest key of each group
    tied = settle(found.join(nodes.select("x", "least"), found["node"] == nodes["x"]).select("x", "label", "least"), "tied")
    lowest = settle(tied.groupBy("label").agg(F.min(F.struct(F.col("least").isNull(), "least", "x")).alias("m")), "lowest")
    losers = tied.join(lowest, "label").where("x <> m.x").select("x")
    keepers = settle(nodes.select(F.col("x").alias("__kx"), F.col("least").alias("__kk")).join(losers, F.col("__kx") == F.col("x"), "left_anti"), "keepers")
    # under names of its own, so that no column of docs can clash
    whole = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns))).alias("doc")
    held = docs.select(F.col(f"`{key}`").alias("k"), F.unhex(F.md5(body)).alias("x"), whole)
    held = held.join(keepers, F.col("k").eqNullSafe(F.col("__kk")) & (F.col("x") == F.col("__kx"))).select("k", "x", "doc")
    columns = [F.col(f"doc.c{i}").alias(c) for i, c in enumerate(docs.columns)]
    if repeated.isEmpty():
        return held.select(*columns)
    again = F.col("k").eqNullSafe(F.col("__rk")) & (F.col("x") == F.col("__rx"))
    once = held.join(repeated, again, "left_semi").groupBy("k", "x").agg(F.first("doc").alias("doc"))
    return held.join(repeated, again, "left_anti").select("doc").unionByName(once.select("doc")).select(*columns)
