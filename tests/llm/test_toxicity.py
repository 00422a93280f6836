"""The classifier on planted words, stems and noise."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusdesk.llm import toxicity
from llm_cases import DE, EN, prose

ENDS = ("", "er", "isch", "ung", "heit", "lein", "chen", "los", "bar", "sam")


@pytest.fixture(scope="module")
def taught(spark):
    """Toxic English texts hold one of three words, German ones a stem with any ending."""
    rng, rows = random.Random(12), []
    words = {"en": [a + b for a in EN for b in ENDS], "de": [a + b for a in DE for b in ENDS]}
    for i in range(1500):
        lang, toxic = ("en", "de")[i % 2], int(rng.random() < 0.2)
        text = prose(rng, words[lang], rng.randint(5, 120)).split()
        for _ in range(toxic * rng.randint(1, 4)):
            bad = rng.choice(("scum", "moron", "clown")) if lang == "en" else rng.choice(("blöd", "dummkopf")) + "".join(rng.choices("aeioutn", k=3))
            text.insert(rng.randint(0, len(text)), bad)
        rows.append((i, " ".join(text), lang, toxic))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int").repartition(4).cache()
    return frame, toxicity.train(frame.where("doc_id < 1000"))


def test_held_out(taught):
    frame, model = taught
    out = toxicity.score_toxicity(frame.where("doc_id >= 1000"), model, ["lang", "toxic"]).collect()
    for lang in ("en", "de"):
        mine = [r for r in out if r.lang == lang]
        found = sum(r.predicted for r in mine if r.toxic) / sum(r.toxic for r in mine)
        wrong = sum(r.predicted for r in mine if not r.toxic) / sum(1 - r.toxic for r in mine)
        assert found > 0.9 and wrong < 0.03, (lang, found, wrong)
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in out)
    assert sum(r.told_lang == r.lang for r in out) > 0.95 * len(out)


def test_long_texts_are_read_to_the_end(spark, taught):
    rng = random.Random(1)
    long_text = prose(rng, EN, 30_000)
    docs = spark.createDataFrame([(1, long_text), (2, long_text + " you moron"), (3, "moron " + long_text)], "doc_id long, text string")
    got = {r.doc_id: r.predicted for r in toxicity.score_toxicity(docs, taught[1], ["doc_id"]).collect()}
    assert got == {1: 0, 2: 1, 3: 1}


def test_same_rows_teach_the_same(taught):
    frame, model = taught
    again = toxicity.train(frame.where("doc_id < 1000").repartition(7))
    assert again["cuts"] == model["cuts"] and np.array_equal(again["adds"], model["adds"])


def test_edge_rows(edge, nothing, taught):
    model = taught[1]
    out = toxicity.score_toxicity(edge, model, ["doc_id", "text"]).collect()
    assert len(out) == edge.count() and all(r.score is not None for r in out)
    assert len({r.score for r in out if not (r.text or "").strip()}) == 1
    kept = toxicity.keep_clean(edge, model)
    assert kept.columns == edge.columns and kept.count() == sum(r.predicted == 0 for r in out)
    assert toxicity.train(nothing.withColumn("toxic", F.lit(1))) is None
    assert {r.score for r in toxicity.score_toxicity(edge, None, ["doc_id"]).collect()} == {0.0}
    assert toxicity.score_toxicity(nothing, model, ["doc_id"]).collect() == []


def test_words_beyond_the_store(taught, monkeypatch):
    monkeypatch.setattr(toxicity, "WORDS", 5)
    scorer = toxicity.Scorer(taught[1])
    texts = [toxicity.words_of(t) for t in (b"the moron of the house", b"a river and a stone under light", b"scum")]
    whole = scorer.values(texts)[0]
    assert whole == pytest.approx([scorer.values([t])[0][0] for t in texts], abs=1e-4)


def test_thresholds():
    assert toxicity.cut(np.array([0.0, 1.0, 2.0, 3.0]), np.array([False, False, True, True])) == 1.5
    assert toxicity.cut(np.array([0.0, 1.0, 2.0, 3.0]), np.array([False, True, False, True])) == 2.5
