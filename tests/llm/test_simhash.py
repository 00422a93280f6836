"""Fingerprints, trees, groups and near copies against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusdesk.llm import near_copies, simhash
from llm_cases import EN, prose


def by_hand(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(points, radius):
    root = list(range(len(points)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(points)):
        for j in np.flatnonzero(np.bitwise_count(points[i] ^ points[i + 1:]) <= radius) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(points))]


def cloud(n, seed, tight=0.5):
    """Random points, and points that grow from others by one to three flipped bits."""
    rng = random.Random(seed)
    points = [rng.getrandbits(64) for _ in range(n // 4 + 1)]
    while len(points) < n:
        p = rng.choice(points[-20:] if rng.random() < tight else points)
        for _ in range(rng.randint(1, 3)):
            p ^= 1 << rng.randrange(64)
        points.append(p)
    return np.unique(np.array(points, np.uint64))


@pytest.mark.parametrize("n,seed", ((1, 1), (50, 2), (900, 3), (3000, 4)))
def test_links_in_a_shard(n, seed):
    points = cloud(n, seed)
    assert simhash.link(points).tolist() == groups(points, 2)


def test_a_ball_that_no_vantage_point_divides():
    rng = random.Random(1)
    centre = rng.getrandbits(64)
    flips = [1 << i for i in range(64)] + [(1 << i) | (1 << j) for i in range(40) for j in range(i)]
    points = np.unique(np.array([centre] + [centre ^ f for f in flips], np.uint64))
    assert len(points) > 2 * simhash.LEAF and set(simhash.link(points)) == {0}


@pytest.mark.parametrize("depth", (0, 1, 4))
def test_every_near_pair_meets_in_a_shard(depth):
    points = cloud(1500, 9)
    tree = simhash.build_tree(points[::3], depth)
    met, homes = set(), set()
    for _, rows in simhash.route(points, tree):
        homes.update(rows.tolist())
        for i in rows:
            met.update((int(i), int(j)) for j in rows[np.bitwise_count(points[rows] ^ points[i]) <= 2])
    pairs = {(i, int(j)) for i in range(len(points)) for j in np.flatnonzero(np.bitwise_count(points ^ points[i]) <= 2)}
    assert homes == set(range(len(points))) and met == pairs


@pytest.mark.parametrize("full", (60, 1 << 16))
def test_groups_over_many_shards(spark, monkeypatch, full):
    monkeypatch.setattr(simhash, "SHARD", 100)
    monkeypatch.setattr(simhash, "FULL", full)
    points = cloud(1200, 6, tight=0.8)
    signed = points.view(np.int64).tolist()
    frame = spark.createDataFrame([(p,) for p in signed], "fp long").repartition(4)
    got = {r.fp: r.label for r in simhash.group_points(simhash.near_links(frame)).collect()}
    root = groups(points, 2)
    for i, p in enumerate(signed):
        assert (p in got) == (root.count(root[i]) > 1)
    by_label, by_root = {}, {}
    for i, p in enumerate(signed):
        by_label.setdefault(got.get(p, p), set()).add(p)
        by_root.setdefault(root[i], set()).add(p)
    assert sorted(map(sorted, by_label.values())) == sorted(map(sorted, by_root.values()))


def test_components_of_long_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.label for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200}
    assert simhash.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_documents(edge, nothing):
    rows = simhash.near_duplicates(edge).collect()
    assert len(rows) == edge.count() and set(rows[0].asDict()) == {"doc_id", "fingerprint", "component_id"}
    texts = edge.select("doc_id", "text").collect()
    assert sorted((str(r.doc_id), r.fingerprint) for r in rows) == sorted((str(r.doc_id), f"{by_hand(r.text):016x}") for r in texts)
    points = np.array([by_hand(r.text) for r in texts], np.uint64)
    root = groups(points, 2)
    lowest = {}
    for r, g in zip(texts, root):
        lowest[g] = min([x for x in (lowest.get(g), r.doc_id) if x is not None], default=None)
    want = sorted((str(r.doc_id), f"{p:016x}", str(lowest[g])) for r, p, g in zip(texts, points.tolist(), root))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in rows) == want
    assert simhash.near_duplicates(nothing).collect() == []


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def test_one_of_each_group_of_near_copies_stays(spark):
    rng = random.Random(8)
    words = [a + b + c for a in EN for b in ("", "ly", "ed", "ness") for c in ("", "s", "er")]
    rows, family = [], {}
    for g in range(12):
        base = prose(rng, words, rng.randint(60, 400)).split()
        for _ in range(40 if g == 0 else 3):
            mine = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 80))):
                mine[rng.randrange(len(mine))] = rng.choice(words) + "x"
            family[len(rows)] = g
            rows.append((len(rows), " ".join(mine)))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted(r.doc_id for r in near_copies.drop_near_copies(docs).collect())
    texts = dict(rows)
    for i in kept:
        for j in kept:
            assert i == j or len(shingles(texts[i]) & shingles(texts[j])) < 0.8 * len(shingles(texts[i]) | shingles(texts[j]))
    assert {family[i] for i in kept} == set(range(12))


def test_texts_that_share_a_passage_are_no_copies(spark):
    rng = random.Random(2)
    passage = prose(rng, EN, 60)
    rows = [(i, f"{prose(rng, EN, 60)} {passage} {prose(rng, EN, 60)}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert near_copies.drop_near_copies(docs).count() == 20


def test_copies_among_odd_rows(edge, nothing):
    kept = near_copies.drop_near_copies(edge)
    assert kept.columns == edge.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(rows) == len(set(rows))
    by_text = {}
    for r in edge.collect():
        by_text.setdefault(" ".join((r.text or "").split()).lower(), []).append(r.doc_id)
    blank = [i for i, t in rows if not (t or "").strip(" \t\n\x0b\x0c\r")]
    assert blank == [0]
    assert {t for _, t in rows if t and t.strip(" \t\n\x0b\x0c\r")} == {r.text for r in edge.where(F.trim("text") != "").collect()} - {"   \n\t "}
    assert near_copies.drop_near_copies(nothing).collect() == []


def kept_by_hand(texts):
    """The smallest number of each group of texts that share 0.8 of their shingles."""
    sets = [set(zip(*(t.split()[k:] for k in range(5)))) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if n >= 0.8 * (len(a) + len(sets[j]) - n):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [i for i in range(len(texts)) if find(i) == i]


def test_copies_that_are_only_alike_to_a_common_base(spark):
    rng = random.Random(21)
    base = [f"w{rng.randrange(3000)}" for _ in range(300)]
    texts = [" ".join(base)]
    for v in range(200):
        words = list(base)
        for i in rng.sample(range(5, 295), 5):
            words[i] = f"new{v}x{i}"
        texts.append(" ".join(words))
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = kept_by_hand(texts)
    assert len(want) < 20
    assert sorted(r.doc_id for r in near_copies.drop_near_copies(docs).collect()) == want


def test_copies_with_another_block(spark):
    rng = random.Random(22)
    texts = []
    for i in range(60):
        words = [f"w{min(int(rng.paretovariate(0.7)), 5000)}" for _ in range(rng.randint(100, 400))]
        more = [f"w{min(int(rng.paretovariate(0.7)), 5000)}" for _ in range(len(words) // 6)]
        cut = len(words) - len(words) // 6
        texts += [" ".join(words), " ".join((words + more, words[:cut], words[:cut] + more[:len(words) // 20])[i % 3])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = kept_by_hand(texts)
    assert len(want) <= 80
    assert sorted(r.doc_id for r in near_copies.drop_near_copies(docs).collect()) == want


def alike_by_hand(sets, similarity=0.8):
    return {(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])}


def some_sets(seed, families, members, size):
    rng = random.Random(seed)
    out = []
    for _ in range(families):
        base = [rng.getrandbits(60) for _ in range(rng.randint(1, size))]
        for _ in range(members):
            out.append(set(base[rng.randint(0, len(base) // 8):]) | {rng.getrandbits(60) for _ in range(rng.randint(0, max(1, len(base) // 6)))})
    return out


@pytest.mark.parametrize("seed", range(4))
def test_bounds_let_every_pair_through_where_it_first_meets(seed):
    sets = some_sets(seed, 12, 9, 60)
    arrays = [np.sort(np.array(list(s), np.int64)) for s in sets]
    none = np.zeros(0, np.int64)
    first = [near_copies.prefix(a, 0.8, none, none).tolist() for a in arrays]
    maps = np.array([near_copies.bit_map(a) for a in arrays], np.int64).view(np.uint64)
    n = np.array([len(a) for a in arrays])
    for i, j in alike_by_hand(sets):
        s = min(set(first[i]) & set(first[j]))
        rest = [n[k] - first[k].index(s) for k in (i, j)]
        assert near_copies.may_be_alike(n[[i]], np.array(rest[:1]), maps[[i]], n[[j]], np.array(rest[1:]), maps[[j]], 0.8).all()


@pytest.mark.parametrize("seed", range(4))
def test_links_inside_a_cluster(seed):
    sets = some_sets(seed + 10, 10, 12, 40)
    groups_before = [i // 3 if i % 12 < 6 else 1000 + i for i in range(len(sets))]
    found = near_copies.links_inside(np.array(groups_before), [np.array(sorted(s), np.int64) for s in sets], 0.8)
    pairs = alike_by_hand(sets)
    assert all((max(p), min(p)) in pairs for p in found) and len(found) < len(sets)

    def classes(links):
        root = list(groups_before)
        for a, b in links:
            x, y = root[a], root[b]
            root = [min(x, y) if r in (x, y) else r for r in root]
        return [root.index(r) for r in root]

    assert classes(found) == classes(pairs)


@pytest.mark.parametrize("full", (80, 8_192))
def test_one_line_in_many_short_texts_gives_no_pairs(spark, monkeypatch, full):
    """Twice the texts that share a line or a base: about twice the rows at every step, and the same rows kept as by brute force.

    Parts of a full shingle meet in pairs, at the price of copies: then only what is kept counts."""
    rng = random.Random(5)
    line = "this very line stands in all of these short texts as it does"
    monkeypatch.setattr(near_copies, "FULL", full)
    if full < 1000:
        monkeypatch.setattr(near_copies, "SET_SHINGLES", 1 << 14)
        monkeypatch.setattr(near_copies, "SET_TEXTS", 64)
    base = [f"b{i}" for i in range(120)]
    texts = [f"{line} {' '.join(f'w{rng.randrange(10 ** 6)}' for _ in range(rng.randint(1, 30)))}" for _ in range(600)]
    for v in range(200):
        words = list(base)
        for i in rng.sample(range(5, 115), rng.randint(1, 3)):
            words[i] = f"new{v}x{i}"
        texts.append(" ".join(words))
    counts = {}
    settle = near_copies.settle

    def counted(df, name):
        out = settle(df, name)
        counts[size].setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(near_copies, "settle", counted)
    for size in (400, 800) if full > 1000 else (800,):
        counts[size] = {}
        part = texts[::800 // size]
        docs = spark.createDataFrame(list(enumerate(part)), "doc_id long, text string").repartition(4)
        kept = sorted(r.doc_id for r in near_copies.drop_near_copies(docs).collect())
        assert kept == kept_by_hand(part)
    for name, rows in counts[800].items() if full > 1000 else ():
        assert sum(rows) <= max(1_600, 3 * sum(counts[400].get(name, [0]))), (name, rows, counts[400].get(name))


def test_columns_called_like_ours(spark):
    rows = [(1, "a b c d e f g", 1, 2, "x"), (2, "a b c d e f g", 3, 4, "y"), (2, "a b c d e f g", 5, 6, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __kx long, __n long, doc string")
    assert near_copies.drop_near_copies(docs).collect() == docs.where("doc_id = 1").collect()
