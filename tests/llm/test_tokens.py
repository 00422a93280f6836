"""Token counts and packing against the tokenizer library."""

import itertools
import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpusdesk.llm import packing, token_counts

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def test_counts_are_the_library_s(edge, nothing):
    tokenizer = Tokenizer.from_file(BYTES)
    got = token_counts.count_tokens(edge, BYTES, ["doc_id", "text", "n_words"]).collect()
    assert len(got) == edge.count()
    for r in got:
        n = len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit, r.n_words) == (len((r.text or "").encode()), n, n > 512, 7), r.text[:50]
    assert token_counts.count_tokens(nothing, BYTES, ["doc_id"]).collect() == []


def test_a_full_second_tier_starts_anew(monkeypatch):
    monkeypatch.setattr(token_counts, "TIER2", 3)
    tokenizer = Tokenizer.from_file(BYTES)
    counts = token_counts.Counts(tokenizer, {" the": 1})
    for part in (["a", "bb"], ["ccc", "dddd", " the"], ["a", "bb", "ccc", "dddd", "eeeee"]):
        counts.learn(set(part))
        assert all(counts[p] == len(tokenizer.encode(p).ids) for p in part)


def test_plain_pattern_splits_as_the_vocabulary_does():
    import re

    import regex

    plain, full, odd = re.compile(token_counts.PLAIN), regex.compile(token_counts.PRE_TOKEN), re.compile(token_counts.NOT_PLAIN)
    letters = [c for c in "ab Z'stre_ 09.\n\t!?é ÀŸ\x0b-#\x0c\r x" if not odd.search(c)]
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 12)))
        assert plain.findall(text) == full.findall(text)


def test_pieces_give_back_every_token(edge, nothing):
    tokenizer = Tokenizer.from_file(WORDS)
    rows = packing.pack(edge, WORDS).collect()
    want = sorted((*tokenizer.encode(r.text or "", add_special_tokens=False).ids, packing.END) for r in edge.collect())
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append(r)
    for parts in by_sequence.values():
        parts.sort(key=lambda r: r.offset)
        at = 0
        for r in parts:
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= packing.LENGTH
    assert sum(r.length for r in rows) == sum(map(len, want))
    ids = {r.doc_id for r in edge.collect()}
    counts = edge.groupBy("doc_id").count().collect()
    texts = {r.doc_id: r.text for r in edge.collect()}
    for one in (c.doc_id for c in counts if c["count"] == 1):
        ids = np.array([*tokenizer.encode(texts[one] or "", add_special_tokens=False).ids, packing.END], "<u4").tobytes()
        parts, at = sorted((r for r in rows if r.doc_id == one), key=lambda r: r.start), 0
        for r in parts:
            assert (r.start, r.doc_tokens) == (at, len(ids) // 4) and r.ids_crc32 == zlib.crc32(ids[4 * at:4 * (at + r.length)])
            at += r.length
        assert at == len(ids) // 4
    assert packing.pack(nothing, WORDS).collect() == []


def brute_cost(places, costs, length):
    inner = range(1, len(places) - 1)
    best = None
    for n in range(len(places) - 1):
        for chosen in itertools.combinations(inner, n):
            cuts = [0, *chosen, len(places) - 1]
            gaps = [places[b] - places[a] for a, b in zip(cuts, cuts[1:])]
            if max(gaps) <= length:
                cost = sum(length - g for g in gaps) + sum(costs[i] for i in chosen)
                best = cost if best is None else min(best, cost)
    return best


@pytest.mark.parametrize("seed", range(40))
def test_cuts_cost_least(seed):
    rng = random.Random(seed)
    places = [0]
    for _ in range(rng.randint(1, 9)):
        places.append(places[-1] + rng.randint(1, 6))
    costs = [rng.choice((0, 2, 5)) for _ in places]
    cuts = packing.best_cuts(places, costs, 8)
    gaps = [places[b] - places[a] for a, b in zip(cuts, cuts[1:])]
    assert cuts[0] == 0 and cuts[-1] == len(places) - 1 and max(gaps) <= 8
    assert sum(8 - g for g in gaps) + sum(costs[i] for i in cuts[1:-1]) == brute_cost(places, costs, 8)


@pytest.mark.parametrize("horizon", (10, 50, 10_000))
def test_packer_keeps_the_order_and_stays_within_its_horizon(horizon):
    rng = random.Random(3)
    stops = np.zeros(10, bool)
    stops[1] = True
    packer, out, docs = packing.Packer(5, stops, 16, horizon), [], []
    for k in range(60):
        ids = [rng.randint(0, 9) for _ in range(rng.choice((1, 3, 9, 70)))]
        docs.append(ids)
        out += packer.add(k, struct.pack(f"<{len(ids)}I", *ids))
        assert packer.places[-1] < horizon + 16 + 70
    out += packer.flush()
    stream = [(k, i) for k, ids in enumerate(docs) for i in range(len(ids))]
    assert [(k, start + i) for k, start, n, *_ in out for i in range(n)] == stream
    sizes = defaultdict(int)
    for _, _, n, _, _, sequence, offset in out:
        assert offset == sizes[sequence]
        sizes[sequence] += n
    assert max(sizes.values()) <= 16 and min(sizes) == 5


def test_little_padding(corpus):
    rows = packing.pack(corpus.coalesce(1), WORDS, length=512).collect()
    total = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= -(-total // 512) + 1


def test_order_of_a_written_table(spark, edge, tmp_path):
    """Pieces follow the rows of the files, equal keys or not; without files the key tells the order."""
    from corpusdesk.llm.common import file_order

    edge.coalesce(1).orderBy("text").write.parquet(str(tmp_path / "t"))
    written = spark.read.parquet(str(tmp_path / "t"))
    assert file_order(edge) is None and file_order(written)
    rows = packing.pack(written, WORDS, order=file_order(written)).orderBy("sequence_id", "offset").collect()
    heads = [r.doc_id for r in rows if r.start == 0]
    assert heads == [r.doc_id for r in written.collect()]
