"""Quality rules against counting by hand."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from corpusdesk.llm import quality


def by_hand(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {k for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for k in range(i, i + 5)}
    seen, repeated = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), repeated, len(covered)


@pytest.mark.parametrize("seed", range(5))
def test_statistics(seed):
    rng = random.Random(seed)
    parts = ["a", "b", " ", "  ", "\n", "é", "𝒳", "#", "|\t", "a b a b a b", "\x0b", "\r", "\x1c", " "]
    for _ in range(400):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))
        raw = t.encode()
        assert quality.statistics(raw, raw.split()) == by_hand(t)


def test_distance_is_that_of_the_definition():
    rng = np.random.default_rng(2)
    p, q = rng.dirichlet(np.ones(6)), rng.dirichlet(np.ones(6))
    m = (p + q) / 2
    want = np.sqrt(((p * np.log2(p / m)).sum() + (q * np.log2(q / m)).sum()) / 2)
    assert quality.js_distance(p, q[None])[0] == pytest.approx(want)
    assert quality.js_distance(np.array([1.0, 0]), np.array([[0, 1.0], [1.0, 0]])).tolist() == [1.0, 0.0]


def test_references_are_those_of_all_documents(corpus):
    got = quality.language_references(corpus)
    assert got["langs"] == ["de", "en"]
    for i, lang in enumerate(got["langs"]):
        texts = [r.text for r in corpus.where(f"lang = '{lang}'").collect()]
        counts = sum(quality.class_counts(t.encode()) for t in texts)
        assert got["classes"][i] == pytest.approx(counts / counts.sum())
        words = Counter(w.decode() for t in texts for w in t.encode().lower().split())
        top = sorted(words.items(), key=lambda x: (-x[1], x[0]))[:quality.COMMON]
        assert got["words"][i] == pytest.approx({w.encode(): n / sum(words.values()) for w, n in top})


def test_verdicts(spark, corpus, edge, nothing):
    references = quality.language_references(corpus)
    good = [r for r in quality.judge_quality(corpus, references, ["doc_id", "text"]).collect()]
    assert all(r.kept for r in good if r.n_words >= 10 and 5 * r.n_repeat_words <= r.n_words)
    rng = random.Random(4)
    sentence = lambda: " ".join(rng.choice(("river", "stone", "house", "light")) + str(rng.randint(0, 999)) for _ in range(60))
    bad = [" ".join(w.upper() + "!!" for w in (sentence() + " " + sentence()).split()), " ".join(f"{w}$$$ %%%" for w in sentence().split())]
    docs = spark.createDataFrame(list(enumerate(bad)), "doc_id long, text string")
    assert [r.kept for r in quality.judge_quality(docs, references, ["doc_id"]).collect()] == [False, False]
    rows = quality.judge_quality(edge, references, ["doc_id", "text"]).collect()
    assert len(rows) == edge.count()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == by_hand(r.text or "")
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    kept = quality.keep_good(edge, references)
    assert kept.columns == edge.columns and kept.count() == sum(r.kept for r in rows)
    none = quality.language_references(nothing)
    assert none["langs"] == [] and quality.judge_quality(nothing, none, ["doc_id"]).collect() == []
    assert all(r.kept != r.base_failed for r in quality.judge_quality(edge, none, ["doc_id"]).collect())


def test_rare_languages_have_references(spark):
    rng = random.Random(8)
    words = {"en": [f"{a}{b}" for a in "river stone house light".split() for b in "abcdefgh"], "ar": "بيت نهر حجر ضوء كتاب باب شمس قمر ليل نهار".split()}
    text = lambda lang: " ".join(rng.choice(words[lang]) + str(rng.randint(0, 9)) * (rng.random() < 0.1) for _ in range(150))
    rows = [(i, text("ar" if i < 4 else "en"), "ar" if i < 4 else "en") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    references = quality.language_references(docs)
    assert references["langs"] == ["ar", "en"]
    assert quality.keep_good(docs, references).count() == 600


def test_words_that_do_not_fit_go_on(spark, corpus, monkeypatch):
    want = quality.language_references(corpus)
    monkeypatch.setattr(quality, "PRUNE", 10)
    got = quality.language_references(corpus)
    assert got["langs"] == want["langs"] and got["words"] == want["words"]
