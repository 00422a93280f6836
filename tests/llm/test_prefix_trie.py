"""The prefix trie against whole prefixes in SQL, and against a plain loop."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from corpusdesk.llm import prefix_trie

SCHEMA = "conv_id long, turn int, role string, text string, n_convs string, c long, K string, depth int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def by_hand(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    made = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = tuple(own.get(c - c % 100 if c >= 0 else c + -c % 100, ())[:h]) + tuple(ts[h:])
    nodes = defaultdict(list)
    for c, ts in made.items():
        for d in range(len(ts) + 1):
            nodes[ts[:d]].append(c)
    out = []
    for node, members in nodes.items():
        below = [n for n in nodes if n[:len(node)] == node]
        ends = ",".join(map(str, sorted(c for c in members if made[c] == node)))
        out.append((min(members), len(node), min(nodes[node[:-1]]) if node else None, len(members), sum(len(n) == len(node) + 1 for n in below),
                    sum(not any(m[:len(n)] == n and len(m) == len(n) + 1 for m in below) for n in below),
                    sum((len(nodes[n]) - 1) * len(n[-1][1]) for n in below if n), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def small_rows(seed, convs, turns, texts):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-250, 500), convs):
        start = rng.randint(-3, 2)
        for t in range(rng.choice((0, 1, 2, turns, turns))):
            rows.append((c, start + t, rng.choice(("user", "bot", None)[:2]) if t % 2 else "user", rng.choice(texts)))
    return rows


def run(spark, rows):
    df = spark.createDataFrame([(*r, "n", 1, "k", 2) for r in rows], SCHEMA).repartition(4)
    found = prefix_trie.prefix_trie(df)
    assert found.columns == COLUMNS
    return sorted((tuple(r) for r in found.collect()), key=str)


@pytest.mark.parametrize(("block", "bucket", "carry", "hot", "ids"), [(8, 4096, 512, 10_000, 256), (2, 3, 2, 5, 7), (3, 4, 1, 1, 1000)])
def test_as_by_hand(spark, monkeypatch, block, bucket, carry, hot, ids):
    for name, value in zip(("BLOCK", "BUCKET", "CARRY", "HOT", "IDS"), (block, bucket, carry, hot, ids)):
        monkeypatch.setattr(prefix_trie, name, value)
    rows = small_rows(block, 60, 9, ["a", "", "é𝒳 z", None])
    rows += [(7, None, None, None), (7, None, "user", "first"), (None, 1, "user", "of nobody"), (300, 5, "user", "a"), (300, 5, "user", "a")]
    rows += [(c, t, "user", "same" if t < 20 else f"{c % 3}") for c in (1001, 1002, 1003, 1100) for t in range(30)]
    assert run(spark, rows) == by_hand(rows)


def test_empty_and_single(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, 1, "a", "b")]) == []
    assert run(spark, [(5, None, None, None)]) == by_hand([(5, None, None, None)])


def test_sql_agrees(spark):
    rows = small_rows(9, 40, 8, ["a", "b", "cc"])
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn int, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    cur = con.execute(prefix_trie.OP12_SQL)
    assert [d[0] for d in cur.description] == COLUMNS
    assert sorted(cur.fetchall(), key=str) == by_hand(rows)


def test_a_busy_conversation_is_many_keys(spark, monkeypatch):
    """Places and prefixes of one long conversation come from parts of it."""
    for name, value in (("BUCKET", 64), ("CARRY", 4)):
        monkeypatch.setattr(prefix_trie, name, value)
    rows = [(100, t, "user", f"{t % 7}") for t in range(600)] + [(101, t, "user", f"{t % 7}") for t in range(400)]
    placed, sizes = prefix_trie.with_places(prefix_trie.original_turns(spark.createDataFrame([(*r, "n", 1, "k", 2) for r in rows], SCHEMA), "conv_id", "turn", "role", "text"))
    assert placed.groupBy("c").agg({"pos": "max"}).count() == 2 and {(r.c, r.own) for r in sizes.collect()} == {(100, 600), (101, 400)}
    got = run(spark, rows)
    shared = {(r[1], r[3]) for r in got}
    assert (400, 2) in shared and (401, 1) in shared and len(got) == 601
