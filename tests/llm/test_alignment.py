"""Alignment of two tokenizers and its perfect hash against brute force."""

import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from corpusdesk.llm import alignment, perfect_hash

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["a\r\nb \r c", "x  y", "▁up", "tab\tand  two", " lead", "trail ", "\n\n", "<s> </s> <unk> <0x41>", "<|endoftext|>", "é Å ﬁ",
       "\x00\x1c \x1d!", "日本 語", "we'll don't\n\n\n  x", "x" * 3000, "!?" * 500 + " " * 40 + "z", "1 234.5e-6", "  　 q", "  .", "a" + "́" * 30]


def by_hand(texts):
    """Every text by both libraries as a whole, links by comparing ranges."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    bytes_a = alignment.bytes_of_byte_level(a)
    rows = []
    for t in texts:
        ia = a.encode(" " + t, add_special_tokens=False).ids if t else []
        ib = b.encode(t) if t else []
        pieces = [b.id_to_piece(i) for i in ib]
        raw = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ib, pieces)]
        if not t or b"".join(bytes_a[i] for i in ia) != (" " + t).encode() or b"".join(raw) != (" " + t).encode():
            rows.append(([], [], [], []))
            continue
        spans = []
        for lens in ([len(bytes_a[i]) for i in ia], [len(r) for r in raw]):
            at, out = 0, []
            for n in lens:
                out.append((at, at + n))
                at += n
            spans.append(out)
        links, k = [], 0
        for i, (s, e) in enumerate(spans[0]):
            while k and spans[1][k][0] >= s:
                k -= 1
            for m in range(k, len(ib)):
                if spans[1][m][0] >= e:
                    break
                if spans[1][m][1] > s:
                    links.append((ia[i], ib[m]))
                    k = m
        ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, start = [], 0
        for end in ends:
            inside = [[str(x) for x, (s, e) in zip(ids, sp) if start <= s and e <= end] for ids, sp in ((ia, spans[0]), (ib, spans[1]))]
            groups.append("|".join(",".join(x) for x in inside))
            start = end
        rows.append((ia, ib, links, groups))
    count = Counter(p for r in rows for p in r[2])
    best = Counter()
    for (x, y), n in count.items():
        best[y] = max(best[y], n)
    return [(len(x), len(y), len(g), len(ln), sum(count[p] == best[p[1]] for p in ln), sum(count[p] for p in ln), ";".join(g)) for x, y, ln, g in rows]


@pytest.mark.parametrize("table", [None, 60])
def test_alignment_by_hand(spark, edge, nothing, monkeypatch, table):
    schema = edge.schema
    extra = [(100 + i, t, None, None, 0, *edge.first()[5:]) for i, t in enumerate([*ODD, "a ▁ b is not right", *ODD[:4]])]
    docs = edge.where("length(coalesce(text, '')) < 9100").union(spark.createDataFrame(extra, schema)).repartition(3)
    monkeypatch.setattr(alignment, "CACHE", 25)
    found = alignment.align(docs, A, B, ["doc_id", "text", "n_words"], table=table).collect()
    assert len(found) == docs.count()
    want = by_hand([r.text for r in found])
    for r, w in zip(found, want):
        assert tuple(r)[3:] == w and r.n_words == 7, (r.text, tuple(r)[3:], w)
    assert alignment.align(nothing, A, B, ["doc_id"]).collect() == []


def test_long_text(spark):
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("abcdeé…") for _ in range(rng.randint(1, 9))) for _ in range(60_000)) + "y" * 70_000
    r = alignment.align(spark.createDataFrame([(1, text), (2, "a b")], "doc_id long, text string"), A, B, ["doc_id"]).where("doc_id = 1").first()
    tokenizer = Tokenizer.from_file(A)
    assert r.n_a == len(tokenizer.encode(" " + text).ids) and r.n_links >= max(r.n_a, r.n_b) and r.n_groups > 50_000


def test_query_digests_groups(spark, tmp_path):
    import hashlib

    spark.createDataFrame([(1, "one two"), (2, None), (3, "▁")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in alignment.op13_token_alignment(spark, str(tmp_path)).collect()}
    want = by_hand(["one two", None, "▁"])
    assert rows[1].groups_sha256 == hashlib.sha256(want[0][-1].encode()).hexdigest()
    assert [rows[k].groups_sha256 for k in (2, 3)] == ["", ""] and rows[3].n_a == 0


def test_fast_encoder_is_the_library():
    aligner = alignment.Aligner(A, B)
    assert aligner.fast is not None
    rng = random.Random(1)
    for _ in range(500):
        text = "".join(rng.choice("ab'st 09.\n\téあ<|>_-́") for _ in range(rng.randint(0, 30)))
        assert aligner.fast.encode_ordinary(text) == aligner.a.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 2, 700, 5000])
def test_perfect_hash(spark, n):
    rng = random.Random(n)
    keys = list({rng.randint(-(1 << 62), 1 << 62) for _ in range(n)})
    table = perfect_hash.build(spark.createDataFrame([(k,) for k in keys], "k long").repartition(3), n)
    at = table.index(np.array(keys, np.int64))
    assert sorted(at.tolist()) == list(range(n)) and len(table) == n
    foreign = np.array([k + 1 for k in keys if k + 1 not in set(keys)], np.int64)
    assert (table.index(foreign) == -1).all()


def test_dense_counts_are_added_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(alignment, "FAN", 2)
    monkeypatch.setattr(alignment, "SLICE", 16)
    rows = [(k, k % 5 + i) for k in range(90) for i in range(4)] + [(1000, 7)]
    counts = spark.createDataFrame(rows, "pair long, n long").repartition(7)
    table = perfect_hash.build(spark.range(90).toDF("pair"), 90)
    total = alignment.dense_counts(counts, table)
    assert total[table.index(np.arange(90))].tolist() == [4 * (k % 5) + 6 for k in range(90)]
