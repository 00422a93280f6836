"""Weighted fair queueing against a queue that serves word by word."""

import hashlib
import random
import re
from collections import defaultdict

import duckdb
import pytest

from corpusdesk.llm import merkle, mixing


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def fill(sizes, weights, budget, repeats):
    """Targets by pouring: the shares of full sources go to the others until none is above its limit."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, full, target = budget * sum(sizes.values()), set(), {}
    while True:
        open_ = [s for s in names if s not in full]
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > repeats * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = float(repeats * sizes[s])
            left -= target[s]
            full.add(s)


def by_hand(rows):
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += words(t)
    target = fill(sizes, mixing.WEIGHTS, mixing.BUDGET, mixing.REPEATS)
    out, served = [], defaultdict(int)
    order = sorted(rows, key=lambda r: (hashlib.md5(("" if r[0] is None else str(r[0])).encode()).hexdigest(), words(r[1])))
    taken = defaultdict(int)
    for _ in range(mixing.REPEATS):
        for i, t, s in order:
            n = max(0, min(words(t), int(target[s]) - served[s]))
            taken[i] += n
            served[s] += n
    return target, sizes, taken


def check(frame, rows):
    got = frame.collect()
    assert len(got) == len(rows)
    target, sizes, taken = by_hand(rows)
    sums = defaultdict(int)
    source = {r[0]: r[2] for r in rows}
    for r in got:
        sums[r.doc_id] += r.taken
    ids = [r[0] for r in rows]
    for r in got:
        assert 0 <= r.taken <= mixing.REPEATS * r.size
        if ids.count(r.doc_id) == 1:
            s = source[r.doc_id]
            assert r.source_size == sizes[s] and r.target == pytest.approx(target[s], abs=1e-6)
    total = defaultdict(int)
    for r in got:
        total[(r.source_size, r.target)] += r.taken
    for (_, t), n in total.items():
        assert abs(n - t) < 1 + 1e-6 or t == 0
    for i in set(ids):
        if ids.count(i) == 1:
            assert sums[i] == taken[i]


def test_made_up_sources(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(0, 30), rng.choice(("a", "a", "a", "b", "c", "B", "é", None))) for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    check(mixing.mix(frame, ["doc_id"]), rows)


def test_a_small_source_is_used_up(spark):
    rows = [(0, "w " * 10, "a"), (1, "w " * 1000, "b"), (2, "w " * 1000, "c"), (3, "", "d")]
    got = {r.doc_id: r.taken for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), ["doc_id"]).collect()}
    # 3015 words: a is used up at 20, b gets two thirds of the rest, c one third
    assert got == {0: 20, 1: 1996, 2: 998, 3: 0}


def test_edge_rows_and_reruns(edge, nothing):
    rows = [(r.doc_id, r.text, r.source) for r in edge.collect()]
    check(mixing.mix(edge, ["doc_id"]), rows)
    one, two = (sorted(map(tuple, mixing.mix(edge.repartition(n), ["doc_id"]).drop("finish").collect()), key=str) for n in (1, 5))
    assert one == two
    assert mixing.mix(nothing, ["doc_id"]).collect() == []


def test_rows_of_the_mix(edge, nothing):
    taken = {}
    for r in mixing.mix(edge, ["doc_id", "text"]).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    out = mixing.mixed_documents(edge)
    assert out.schema.simpleString() == edge.schema.simpleString()
    given = defaultdict(int)
    texts = defaultdict(set)
    for r in edge.collect():
        texts[r.doc_id].add(r.text)
    for r in out.collect():
        given[r.doc_id] += words(r.text)
        assert any((t or "").startswith(r.text) for t in texts[r.doc_id])
    assert {i: n for i, n in taken.items() if n} == dict(given)
    assert mixing.mixed_documents(nothing).collect() == []


def duck(rows, sql):
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", rows)
    cursor = con.execute(sql)
    return [d[0] for d in cursor.description], cursor.fetchall()


def canon(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=str)


def test_sql_says_the_same(spark):
    rng = random.Random(6)
    rows = [(i, ". ".join("w" * rng.randint(0, 40) for _ in range(rng.randint(0, 9))) + "\n" * rng.randint(0, 2), rng.choice(("a", "b", "c", None))) for i in range(60)]
    rows += [(100, None, "a"), (101, "", "b"), (102, "é𝒳東 京\n\n", "c")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    mixed = mixing.mix(frame, ["doc_id"]).drop("weight", "finish")
    assert canon(mixed.columns, mixed.collect()) == canon(*duck(rows, mixing.OP8_SQL))
    printed = merkle.fingerprint_documents(frame)
    assert canon(printed.columns, printed.collect()) == canon(*duck(rows, merkle.OP9_SQL))
