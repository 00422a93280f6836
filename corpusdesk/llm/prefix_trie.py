"""The trie of conversation prefixes, found by blocks of turns first.

A turn's digest covers its place, role and text; the digest of a prefix is the
exclusive or of the digests of its turns (128 bits), so prefixes of any length
are carried from block to block without reading a text again.  Conversations are
cut into blocks of ``BLOCK`` turns and grouped by the digests of the prefixes before
and behind each block.  Where one block follows a prefix, all its turns are nodes with
the members of the block.  Only where several follow are the turns of these
different blocks compared, one row per different block and turn.

Sums over a subtree need no walk.  A conversation is at the top of a node if it is the
smallest member; from the first such node on, it is at the top of all its nodes.  Let
S be the characters of its turns before that node.  A node with the prefix length p
before its own turn saves the sum of (S - p) over its members other than the top one.
Leaves are counted at the conversations on top of them.  Both are sums over
members, taken by blocks as the numbers of members are.

No conversation goes through one task: places are counted inside buckets of turn numbers,
prefixes inside ``CARRY`` blocks, and one row for each of those is carried on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from corpusdesk.llm.common import documents, settle

BLOCK = 8  # turns of a block
BUCKET = 4_096  # turn numbers whose rows are ordered by one task
CARRY = 512  # blocks over which one task carries a digest
HOT = 10_000  # a prefix with more than one in so many of all rows below it is hot; there are fewer of them than that
IDS = 256  # ids that one row of a list holds
STEP, HEAD = 100, 6  # conversation c starts like c - c % STEP, for crc32(c) % HEAD turns

BEFORE, BEHIND = ["p1", "p2"], ["q1", "q2"]


def original_turns(conversations: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """(c, turn, h1, h2, chars): two hashes of role and text and the code points of the text."""
    said = [F.coalesce(F.col(f"`{n}`").cast("string"), F.lit("")) for n in (role, text)]
    rows = conversations.where(F.col(f"`{key}`").isNotNull())
    return rows.select(F.col(f"`{key}`").cast("long").alias("c"), F.col(f"`{turn}`").cast("long").alias("turn"),
                       F.xxhash64(*said).alias("h1"), F.xxhash64(F.lit(1), *said[::-1]).alias("h2"), F.length(said[1]).cast("long").alias("chars"))


def with_places(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(c, pos, h1, h2, chars) with places from 0, and (c, own): the number of turns of each conversation."""
    rows = turns.withColumn("bucket", F.coalesce(F.floor(F.col("turn") / BUCKET), F.lit(-(1 << 62))))
    sizes = settle(rows.groupBy("c", "bucket").agg(F.count(F.lit(1)).alias("n")), "buckets")
    earlier = Window.partitionBy("c").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = sizes.select("c", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    inside = Window.partitionBy("c", "bucket").orderBy(F.col("turn").asc_nulls_first(), "h1", "h2")
    placed = rows.withColumn("pos", F.row_number().over(inside) - 1).join(carried, ["c", "bucket"])
    return placed.select("c", (F.col("pos") + F.col("first")).alias("pos"), "h1", "h2", "chars"), sizes.groupBy("c").agg(F.sum("n").alias("own"))


def rebuilt(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Turns (c, pos, h1, h2, chars) and conversations (c, turns) after the first turns of c - c % STEP are put in front."""
    placed, sizes = with_places(settle(original_turns(conversations, key, turn, role, text), "turns"))
    placed = settle(placed, "placed")
    heads = placed.where((F.col("c") % STEP == 0) & (F.col("pos") < HEAD - 1)).groupBy(F.col("c").alias("base"))
    heads = settle(heads.agg(F.sort_array(F.collect_list(F.struct("pos", "h1", "h2", "chars"))).alias("head")), "heads")  # HEAD - 1 at most
    wish = F.crc32(F.col("c").cast("string")) % HEAD
    convs = sizes.withColumn("base", F.col("c") - F.col("c") % STEP).join(heads, "base", "left")
    convs = convs.withColumn("wish", wish.cast("int")).withColumn("head", F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), F.lit(1), F.col("wish")))
    convs = convs.withColumn("shift", F.size("head") - F.col("wish"))
    convs = settle(convs.select("c", "wish", "shift", "head", (F.size("head") + F.greatest(F.lit(0), F.col("own") - F.col("wish"))).alias("turns")), "conversations")
    # one row per bucket of places: a busy conversation is many keys
    spread = convs.select("c", "wish", "shift", F.explode(F.sequence(F.lit(0), F.floor((F.col("turns") - F.col("shift")) / BUCKET))).alias("part"))
    own = placed.withColumn("part", F.floor(F.col("pos") / BUCKET)).join(spread, ["c", "part"]).where("pos >= wish")
    own = own.select("c", (F.col("pos") + F.col("shift")).alias("pos"), "h1", "h2", "chars")
    put = convs.select("c", F.explode("head").alias("t")).select("c", F.col("t.pos").cast("long").alias("pos"), "t.h1", "t.h2", "t.chars")
    return own.unionByName(put), convs.select("c", "turns")


def blocks_of(turns: DataFrame) -> DataFrame:
    """(c, k, turns, p1, p2, pre, q1, q2): blocks of turns (depth, g1, g2, chars) with the digests before and behind
    them and the characters before them."""
    depth = F.col("pos") + 1
    digest = turns.select("c", F.floor(F.col("pos") / BLOCK).alias("k"), depth.alias("depth"), F.xxhash64(F.lit(1), depth, "h1", "h2").alias("g1"),
                          F.xxhash64(F.lit(2), "h2", depth, "h1").alias("g2"), "chars")
    made = digest.groupBy("c", "k").agg(F.sort_array(F.collect_list(F.struct("depth", "g1", "g2", "chars"))).alias("turns"),
                                        F.bit_xor("g1").alias("d1"), F.bit_xor("g2").alias("d2"), F.sum("chars").alias("n"))
    made = settle(made.withColumn("far", F.floor(F.col("k") / CARRY)), "blocks")
    upto = lambda keys, by, last: Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, last)
    ends = made.groupBy("c", "far").agg(F.bit_xor("d1").alias("d1"), F.bit_xor("d2").alias("d2"), F.sum("n").alias("n"))
    earlier = upto(["c"], "far", -1)
    carried = ends.select("c", "far", *(F.coalesce(f(c).over(earlier), F.lit(0)).alias(o) for f, c, o in
                                        ((F.bit_xor, "d1", "c1"), (F.bit_xor, "d2", "c2"), (F.sum, "n", "c3"))))
    here = upto(["c", "far"], "k", Window.currentRow)
    made = made.withColumns({"q1": F.bit_xor("d1").over(here), "q2": F.bit_xor("d2").over(here), "upto": F.sum("n").over(here)}).join(carried, ["c", "far"])
    q1, q2 = F.col("q1").bitwiseXOR(F.col("c1")), F.col("q2").bitwiseXOR(F.col("c2"))
    return made.select("c", "k", "turns", q1.bitwiseXOR(F.col("d1")).alias("p1"), q2.bitwiseXOR(F.col("d2")).alias("p2"),
                       (F.col("upto") + F.col("c3") - F.col("n")).alias("pre"), q1.alias("q1"), q2.alias("q2"))


def look_up(rows: DataFrame, keys: list[str], table: DataFrame, weight: str, total: int) -> DataFrame:
    """``rows`` left-joined with ``table``, whose distinct ``keys`` stand for ``weight`` of the ``total`` rows.

    Keys with more than one row in ``HOT`` are fewer than HOT, so they are broadcast;
    the others are joined by a shuffle, in which no key is hot any more.
    """
    hot = settle(table.where(F.col(weight) * HOT > total), "hot")
    others = [c for c in table.columns if c not in keys]
    told = rows.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), keys, "left")
    found = told.where("__hot").drop("__hot")
    rest = told.where("__hot is null").drop("__hot", *others)
    return found.unionByName(rest.join(table.where(F.col(weight) * HOT <= total), keys, "left"))


def nodes_of(blocks: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """One row per node of the different ``blocks``: a block that follows its prefix alone gives its turns as they are,
    the turns of all others (``split``) are put together; ``sums`` says how."""
    names = list(sums)
    step = lambda acc, t: F.struct(
        F.array_append(acc["out"], F.struct(t["depth"].alias("depth"), acc["p1"].alias("p1"), acc["p2"].alias("p2"), acc["pre"].alias("pre"),
                                            acc["p1"].bitwiseXOR(t["g1"]).alias("q1"), acc["p2"].bitwiseXOR(t["g2"]).alias("q2"))).alias("out"),
        acc["p1"].bitwiseXOR(t["g1"]).alias("p1"), acc["p2"].bitwiseXOR(t["g2"]).alias("p2"), (acc["pre"] + t["chars"]).alias("pre"))
    none = F.array().cast("array<struct<depth:bigint,p1:bigint,p2:bigint,pre:bigint,q1:bigint,q2:bigint>>")
    start = F.struct(none.alias("out"), F.col("p1").alias("p1"), F.col("p2").alias("p2"), F.col("pre").alias("pre"))
    flat = blocks.select("split", *names, F.explode(F.aggregate("turns", start, step)["out"]).alias("t")).select("split", *names, "t.*")
    keys = ["depth", "q1", "q2"]
    joined = flat.where("split").groupBy(*keys).agg(F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.first("pre").alias("pre"), *(f.alias(n) for n, f in sums.items()))
    columns = [*keys, "p1", "p2", "pre", *names]
    return flat.where("not split").select(*columns).unionByName(joined.select(*columns))


def ends_of(convs: DataFrame, last: DataFrame) -> DataFrame:
    """(depth, q1, q2, ends_sha256): the digest of the ids of the conversations that end at a node.

    Ids are gathered by ranges of ``IDS`` first; the text of a node's ranges is digested
    as it streams by, never held whole.
    """
    here = convs.join(last, "c", "left").select(F.col("turns").alias("depth"), F.coalesce("q1", F.lit(0)).alias("q1"), F.coalesce("q2", F.lit(0)).alias("q2"), "c")
    ranges = here.groupBy("depth", "q1", "q2", F.floor(F.col("c") / IDS).alias("r")).agg(F.array_join(F.sort_array(F.collect_list("c")).cast("array<string>"), ",").alias("ids"))
    keys = ["depth", "q1", "q2"]

    def digest(batches):
        import hashlib

        import pyarrow as pa

        now, sha = None, None
        for batch in batches:
            out = []
            cols = [c.to_pylist() for c in batch.columns]
            for depth, q1, q2, ids in zip(*cols):
                if now == (depth, q1, q2):
                    sha.update(b"," + ids.encode())
                    continue
                if now is not None:
                    out.append((*now, sha.hexdigest()))
                now, sha = (depth, q1, q2), hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_pylist([dict(zip([*keys, "ends_sha256"], r)) for r in out], pa.schema(
                [("depth", pa.int64()), ("q1", pa.int64()), ("q2", pa.int64()), ("ends_sha256", pa.string())]))
        if now is not None:
            yield pa.RecordBatch.from_pylist([dict(zip([*keys, "ends_sha256"], (*now, sha.hexdigest())))])

    ordered = ranges.repartition(*keys).sortWithinPartitions(*keys, "r").select(*keys, "ids")
    return ordered.mapInArrow(digest, "depth long, q1 long, q2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per node of the trie of the rebuilt ``conversations``: (conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256).

    Turns are ordered by ``turn``, null first, equal ones by a hash of role and text; a null role
    or text is empty; repeated rows are turns of their own.  Rows without ``key`` belong to no
    conversation and are left out.  An empty table has no nodes.
    """
    turns, convs = rebuilt(conversations, key, turn, role, text)
    convs = settle(convs, "rebuilt")
    blocks = settle(blocks_of(turns), "prefixes")
    block = ["k", *BEFORE, *BEHIND]
    kinds = settle(blocks.groupBy(*block).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("top"), F.first("turns").alias("turns"), F.first("pre").alias("pre")), "kinds")
    follow = settle(kinds.groupBy("k", *BEFORE).agg(F.count(F.lit(1)).alias("follow")), "follow")
    kinds = settle(look_up(kinds, ["k", *BEFORE], follow, "follow", kinds.count()).withColumn("split", F.col("follow") > 1).drop("follow"), "kinds-split")
    nodes = nodes_of(kinds, {"n": F.sum("n"), "top": F.min("top")})
    root = convs.agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("top")).where("n > 0")
    zero = F.lit(0).cast("long")
    nodes = settle(nodes.unionByName(root.select(*(zero.alias(c) for c in ("depth", "q1", "q2", "p1", "p2", "pre")), "n", "top")), "nodes")
    ident = ["depth", "q1", "q2"]
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2")).agg(F.count(F.lit(1)).alias("children"))
    nodes = settle(nodes.join(children, ident, "left").withColumn("children", F.coalesce("children", F.lit(0))), "nodes-children")
    # of each conversation: characters before it is on top, and is it on top of a leaf
    tops = nodes.groupBy(F.col("top").alias("c")).agg(F.min(F.struct("depth", "pre"))["pre"].alias("s"), F.max((F.col("children") == 0).cast("long")).alias("leaf"))
    chars = blocks.groupBy("c").agg(F.max(F.col("pre") + F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + t["chars"])).alias("all"))
    weights = convs.join(chars, "c", "left").join(tops, "c", "left").select("c", "turns", F.coalesce("s", "all", F.lit(0)).alias("s"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    weights = settle(weights, "weights")
    spread = weights.select("c", "s", "leaf", F.explode(F.sequence(F.lit(0), F.floor(F.col("turns") / (BLOCK * CARRY)))).alias("far"))
    sums = {"s": F.sum("s"), "leaves": F.sum("leaves"), "top_s": F.min("top_s")}
    weighed = blocks.withColumn("far", F.floor(F.col("k") / CARRY)).join(spread, ["c", "far"])
    weighed = weighed.groupBy(*block).agg(F.sum("s").alias("s"), F.sum("leaf").alias("leaves"), F.min(F.struct("c", "s")).alias("top_s"))
    below = nodes_of(kinds.select(*block, "turns", "pre", "split").join(weighed, block), sums).select(*ident, *sums)
    total = weights.agg(F.sum("s").alias("s"), F.sum("leaf").alias("leaves"), F.min(F.struct("c", "s")).alias("top_s"), F.count(F.lit(1)).alias("__n")).where("__n > 0")
    below = below.unionByName(total.select(*(zero.alias(c) for c in ident), *sums))
    last = blocks.select("c", "k", *BEHIND).join(convs.select("c", F.floor((F.col("turns") - 1) / BLOCK).alias("k")), ["c", "k"]).drop("k")
    nodes = settle(nodes.join(below, ident).join(ends_of(convs, last), ident, "left"), "nodes-below")
    # the top conversation of the parent; parents with very many children are known
    parents = nodes.where("children > 0").select((F.col("depth") + 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2"), F.col("top").alias("parent"), "children")
    below_root = look_up(nodes.where("depth > 0").withColumnRenamed("children", "n_children"), ["depth", *BEFORE], parents, "children", nodes.count())
    every = below_root.unionByName(nodes.where("depth = 0").withColumnRenamed("children", "n_children").withColumns({"parent": F.lit(None).cast("long"), "children": zero}))
    # the root has no turn of its own, so nothing is saved at it
    saved = F.col("s") - F.col("top_s.s") - (F.col("n") - 1) * F.col("pre")
    return every.select(F.col("top").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("n").cast("long").alias("n_convs"),
                        F.col("n_children").cast("long").alias("n_children"), F.col("leaves").cast("long").alias("n_leaves"), saved.cast("long").alias("saved_tokens"),
                        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(documents(spark, sf_dir, "conversations"))


#: The same by whole prefixes: a node is the list of digests of its turns.
OP12_SQL = r"""
WITH t AS (
  SELECT CAST(conv_id AS BIGINT) AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(coalesce(role, '') || chr(31) || coalesce(text, ''))) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT c, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: ascii(x)::UBIGINT)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda x, y: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))) AS crc
  FROM (SELECT DISTINCT c FROM t)),
h AS (SELECT c, CAST(xor(crc, 4294967295::UBIGINT) % 6 AS INT) AS h FROM ids),
r AS (
  SELECT h.c, b.pos AS pos, b.role, b.text FROM h JOIN t b ON b.c = h.c - h.c % 100 AND b.pos < h.h
  UNION ALL
  SELECT h.c, t.pos, t.role, t.text FROM h JOIN t ON t.c = h.c AND t.pos >= h.h),
d AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY pos) AS depth, length(text) AS chars,
         string_agg(md5(to_json([role, text])), '' ORDER BY pos) OVER (PARTITION BY c ORDER BY pos) AS node FROM r),
m AS (SELECT c, depth, chars, md5(node) AS node FROM d UNION ALL SELECT c, 0, 0, 'root' FROM h),
p AS (SELECT *, lag(node) OVER (PARTITION BY c ORDER BY depth) AS parent, lead(node) OVER (PARTITION BY c ORDER BY depth) AS child FROM m),
n AS (
  SELECT node, depth, min(c) AS conv_id, any_value(parent) AS parent, any_value(chars) AS chars, count(*) AS n_convs, count(DISTINCT child) AS n_children,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (child IS NULL), '')) AS ends_sha256 FROM p GROUP BY node, depth),
s AS (
  SELECT DISTINCT a.node, a.depth, b.node AS below, b.depth AS below_depth FROM p a JOIN p b ON a.c = b.c AND b.depth >= a.depth),
u AS (
  SELECT s.node, s.depth, CAST(count(*) FILTER (n.n_children = 0) AS BIGINT) AS n_leaves, CAST(sum((n.n_convs - 1) * n.chars) AS BIGINT) AS saved_tokens
  FROM s JOIN n ON n.node = s.below AND n.depth = s.below_depth GROUP BY s.node, s.depth)
SELECT n.conv_id, n.depth, q.conv_id AS parent_conv_id, n.n_convs, n.n_children, u.n_leaves, u.saved_tokens, n.ends_sha256
FROM n JOIN u ON u.node = n.node AND u.depth = n.depth LEFT JOIN n q ON q.node = n.parent AND q.depth = n.depth - 1
"""
