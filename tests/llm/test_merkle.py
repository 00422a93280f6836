"""Merkle fingerprints against plain Python."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from corpusdesk.llm import merkle

md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def by_hand(text):
    leaf = re.compile(merkle.SHORT_LEAF if len(text) < merkle.SHORT else merkle.LEAF)
    pieces = [[md5(x)[:16] for x in leaf.findall(p)] for p in text.split("\n")]
    nodes = [md5("".join(p)) for p in pieces]
    sections = [md5("".join(nodes[i:i + merkle.SECTION])) for i in range(0, len(nodes), merkle.SECTION)]
    return sha("".join(sections)), {x for p in pieces for x in p}, nodes


def alike(a, b):
    if a[0] == b[0]:
        return 1.0
    n = len(a[1]) + len(b[1])
    return min(2 * len(a[1] & b[1]) / n, 0.999999) if n else 0.0


def check(frame):
    rows = sorted(((r.doc_id, r.text or "") for r in frame.collect()), key=lambda r: (r[0] is not None, r[0], r[1]))
    want = []
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        t, e, n = by_hand(text), by_hand(edited), by_hand(following)
        first = next((j for j in range(max(len(t[2]), len(e[2]))) if t[2][j:j + 1] != e[2][j:j + 1]), None) if t[0] != e[0] else None
        want.append((i, len(text), sha(edited), t[0], e[0], round(alike(t, e), 6), round(alike(t, n), 6), first))
    got = [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 6), round(r.near_next, 6), r.edited_paragraph)
           for r in merkle.fingerprint_documents(frame).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("rows", (1, 7, 500))
def test_edge_rows(edge, nothing, monkeypatch, rows):
    monkeypatch.setattr(merkle, "BUCKET_ROWS", rows)
    check(edge)
    assert merkle.fingerprint_documents(nothing).collect() == []


@pytest.mark.parametrize("rows", (3, 1000))
def test_ids_with_gaps(corpus, monkeypatch, rows):
    monkeypatch.setattr(merkle, "BUCKET_ROWS", rows)
    check(corpus.withColumn("doc_id", F.when(F.col("doc_id") > 60, F.col("doc_id") * 10 ** 12).otherwise(F.col("doc_id") - 30)))


def test_single_rows(corpus):
    check(corpus.where("doc_id = 5"))
    check(corpus.where("doc_id = 5").withColumn("doc_id", F.lit(None).cast("long")))


def test_plan_is_native_and_windows_are_buckets(corpus):
    plan = merkle.fingerprint_documents(corpus)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|SinglePartition|Cartesian|NestedLoop", plan) and "hashpartitioning(__b" in plan
