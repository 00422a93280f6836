"""The registered queries and the pipeline on the smallest tables."""

import os
from collections import defaultdict

import pytest

import __spark_entry__ as entry_points
import corpus_pipeline
from corpusdesk.llm import mixing, quality, registry, toxicity
from corpusdesk.llm.common import documents
from oracle_check import compare, connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_queries(spark, name):
    assert entry_points.queries()[name] is registry.QUERIES[name]
    ok, message = compare(spark, SF_DIR, name, registry.QUERIES[name], registry.ORACLES.get(name), connect(SF_DIR))
    assert ok, message


def test_one_query_per_operator():
    names = [n.split("_")[0] for n in registry.QUERIES]
    assert sorted(names) == sorted(f"op{i}" for i in range(1, 14)) and "pipeline" in entry_points.queries()


def test_stages(spark):
    docs = documents(spark, SF_DIR)
    kept, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        before, kept = kept, stage(spark, kept, SF_DIR)
        if name != "packing":
            assert kept.schema.simpleString() == docs.schema.simpleString()
        seen[name] = kept.collect()
        kept = spark.createDataFrame(seen[name], kept.schema)
    texts = {r.doc_id: r.text for r in docs.collect()}
    judged = {r.doc_id: r.kept for r in quality.judge_quality(docs, quality.language_references(docs), ["doc_id"]).collect()}
    good = {r.doc_id for r in seen["quality_rules"]}
    assert good == {i for i, k in judged.items() if k}
    model = toxicity.train(toxicity.labelled(spark, SF_DIR))
    clean = {r.doc_id for r in toxicity.score_toxicity(docs, model, ["doc_id"]).where("predicted = 0").collect()}
    assert {r.doc_id for r in seen["toxicity"]} == good & clean
    words = lambda t: set(zip(*([t.lower().split()[k:] for k in range(5)])))
    sets = {i: words(texts[i]) for i in good & clean}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    single = {r.doc_id for r in seen["near_dedup"]}
    assert not any(alike(a, b) for a in single for b in single if a < b)
    assert all(any(alike(a, b) for b in good & clean if b != a) for a in (good & clean) - single)
    given = defaultdict(int)
    for r in seen["source_mixing"]:
        given[r.doc_id] += len(r.text.split())
    deduped = spark.createDataFrame(seen["near_dedup"], docs.schema)
    want = {r.doc_id: r.taken for r in mixing.mix(deduped, ["doc_id"]).where("taken > 0").collect()}
    assert dict(given) == want
    tokens = {r.doc_id: r.doc_tokens for r in seen["packing"]}
    assert set(tokens) == set(given)


def test_run_is_the_stages(spark):
    rows = corpus_pipeline.run(spark, SF_DIR)
    assert rows.count() > 0 and {"doc_id", "start", "length", "sequence_id", "offset"} <= set(rows.columns)


def test_empty_documents(spark, tmp_path):
    for name in ("documents", "labels"):
        documents(spark, SF_DIR, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
