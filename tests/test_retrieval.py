import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusdesk.operators import evaluate, fusion, lexical, vectors
from corpusdesk.operators.evaluate import containing_documents
from corpusdesk.plans import q_search, search as plan

KEYS = ["query_id"]


@pytest.fixture(scope="module")
def vector_case(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    corpus = centres[rng.integers(0, 12, 900)] + 0.3 * rng.normal(size=(900, 16))
    corpus[:300] = corpus[0] + 0.01 * rng.normal(size=(300, 16))    # a third of all rows in one place
    corpus[300:310] = corpus[5]                                     # equal vectors: ties
    asked = centres[rng.integers(0, 12, 40)] + 0.3 * rng.normal(size=(40, 16))
    chunks = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(corpus)], "chunk_id long, vec array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id long, vec array<double>")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    dist = np.round(1 - unit(asked) @ unit(corpus).T, 9)
    want = {q: sorted(range(900), key=lambda c: (dist[q, c], c))[:20] for q in range(40)}
    return queries.repartition(3), chunks.repartition(5), want


def ranked(df):
    out = collections.defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        out[r["query_id"]].append(r["chunk_id"])
    return dict(out)


def test_scan_equals_brute_force(vector_case):
    queries, chunks, want = vector_case
    assert ranked(vectors.vector_topk(queries, chunks, KEYS, 16, 20)) == want


def test_cells_equal_brute_force_with_hot_cell_split(vector_case):
    queries, chunks, want = vector_case
    found = vectors._cell_topk(queries, chunks, KEYS, 20, "chunk_id", "vec", probe=None, slice_rows=50)
    assert ranked(found) == want


@pytest.mark.parametrize("rows", [4, 64])
def test_blocks_equal_brute_force(vector_case, monkeypatch, rows):
    """Many pairs of blocks, and blocks of distances smaller than they are."""
    queries, chunks, want = vector_case
    monkeypatch.setattr(vectors, "QUERY_BYTES", 8 * 16 * rows)
    monkeypatch.setattr(vectors, "CHUNK_BYTES", 8 * 16 * 3 * rows)
    assert ranked(vectors.vector_topk(queries, chunks, KEYS, 16, 20, max_broadcast_bytes=0)) == want


def test_nearest_rows_in_small_blocks(monkeypatch):
    rng = np.random.default_rng(5)
    units = rng.normal(size=(200, 8))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    units[50:90] = units[10]
    monkeypatch.setattr(vectors, "BLOCK_QUERIES", 7)
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 16)
    query, row, dist = vectors._nearest_rows(units[:23], units, 30)
    every = np.round(1 - units[:23] @ units.T, 9)
    assert [sorted(range(200), key=lambda r: (every[q, r], r))[:30] for q in range(23)] == row.reshape(23, 30).tolist()
    assert (query == np.repeat(np.arange(23), 30)).all() and (dist == every[query, row]).all()


def test_no_task_emits_a_batch_of_repeated_vectors(spark, vector_case, monkeypatch):
    """Rows that repeat a vector, or the k best of many queries, leave a task in small pieces."""
    queries, chunks, want = vector_case
    monkeypatch.setattr(vectors, "PIECE_ROWS", 60)
    sizes = spark.sparkContext.accumulator(0)

    def counted(frame, fn, schema, whole=type(chunks).mapInPandas):
        def watched(batches):
            for piece in fn(batches):
                sizes.add(int(len(piece) > 60 and "radius" not in piece))
                yield piece
        return whole(frame, watched, schema)

    monkeypatch.setattr(type(chunks), "mapInPandas", counted)
    assert ranked(vectors.vector_topk(queries, chunks, KEYS, 16, 20)) == want
    assert ranked(vectors.vector_topk(queries, chunks, KEYS, 16, 20, max_broadcast_bytes=0, clustered=True)) == want
    assert sizes.value == 0


def test_more_neighbours_asked_than_rows(spark, vector_case):
    queries, chunks, _ = vector_case
    few = chunks.where("chunk_id < 7")
    a = ranked(vectors.vector_topk(queries, few, KEYS, 16, 20))
    b = ranked(vectors.vector_topk(queries, few, KEYS, 16, 20, max_broadcast_bytes=0))
    assert a == b and all(len(v) == 7 for v in a.values())


def test_no_queries_give_no_rows(vector_case):
    queries, chunks, _ = vector_case
    assert vectors.vector_topk(queries.where("query_id < 0"), chunks, KEYS, 16, 5).count() == 0


def test_approximate_recall(vector_case):
    queries, chunks, want = vector_case
    got = ranked(vectors.vector_topk_ann(queries, chunks, KEYS, 16, 20, probe=8))
    hits = sum(len(set(got.get(q, [])) & set(w)) for q, w in want.items())
    assert hits / (20 * len(want)) > 0.8


def test_approximate_recall_without_clusters(spark):
    """Vectors in no particular place, as in the given tables; all 64 cells exist."""
    rng = np.random.default_rng(8)
    units = rng.normal(size=(4500, 24))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    chunks = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(units)], "chunk_id long, vec array<double>")
    queries = chunks.where("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id")
    got = ranked(vectors.vector_topk_ann(queries, chunks, KEYS, 24, 20))
    want = {q: set(np.argsort(-(units @ units[q]), kind="stable")[:20]) for q in range(0, 4500, 50)}
    assert sum(len(set(got[q]) & w) for q, w in want.items()) >= 0.9 * 20 * len(want)


def test_cosine_distance_column(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert df.select(vectors.cosine_distance(F.col("a"), F.col("b"))).first()[0] == pytest.approx(1 - 1 / math.sqrt(2))


def corpus(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string")


def test_hostile_questions_never_fail(spark):
    chunks = corpus(spark, "transkript belgesi", "başka bir metin")
    asked = ["https://a.b/c?d=e&f", "a & b | !c", "():*<->", "' or 1=1 --", "ve veya ile", "", "   ", "\\", "x" * 5000, "TRANSKRİPT"]
    q = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    got = ranked(lexical.lexical_topk(q, lexical.build_postings(chunks), KEYS))
    assert got == {9: [0]}


def test_unusable_vectors_change_nothing(spark, vector_case):
    queries, chunks, want = vector_case
    odd = [[0.0] * 16, [1.0] * 5, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, None]
    bad = spark.createDataFrame([(1000 + i, v) for i, v in enumerate(odd)], "chunk_id long, vec array<double>")
    asked = queries.unionByName(bad.withColumnRenamed("chunk_id", "query_id"))
    more = chunks.unionByName(bad)
    for limit in (vectors.MAX_BROADCAST_BYTES, 0):
        assert ranked(vectors.vector_topk(asked, more, KEYS, 16, 20, max_broadcast_bytes=limit)) == want
    good, quarantined = vectors.check_embeddings(more, 16)
    assert good.count() == 900 and sorted(r["reason"] for r in quarantined.collect()) == sorted([
        "zero vector", "wrong dimension", "vector missing", *["element missing or not finite"] * 3])
    assert vectors.vector_topk_ann(asked, more, KEYS, 16, 20).select("query_id").distinct().count() == 40


def test_many_questions_go_in_turns(spark):
    """Beyond the broadcast limit an index is searched in place, turn by turn; no join repeats the questions."""
    words = [f"w{chr(97 + i)}" for i in range(20)]
    rng = random.Random(2)
    chunks = corpus(spark, *(" ".join(rng.choices(words, k=12)) for _ in range(60)))
    q = spark.createDataFrame([(i, " ".join(rng.choices(words, k=6))) for i in range(50)], "query_id long, text string")
    postings = lexical.weighted(lexical.build_postings(chunks)).repartition(4, "chunk_id")
    want = ranked(lexical.lexical_topk(q, postings, KEYS, 5, placed=True))
    turns = lexical.lexical_topk(q, postings, KEYS, 5, placed=True, max_broadcast=40)
    assert ranked(turns) == want and len(want) == 50
    assert "salt" not in turns._jdf.queryExecution().toString()


def test_turns_make_no_row_per_match(spark, monkeypatch):
    """A turn sums scores inside the tasks, with the rows of the other way; keys and ids may repeat or be null."""
    words = [f"w{chr(97 + i)}" for i in range(20)]
    rng = random.Random(5)
    texts = [(f"c{i % 55}" if i % 9 else None, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(60)]
    chunks = spark.createDataFrame([*texts, ("z1", "wa wb"), ("z0", "wa wb")], "chunk_id string, content string")
    asked = [(i % 25 if i % 8 else None, i % 2, " ".join(rng.choices(words, k=rng.randint(1, 6)))) for i in range(60)]
    q = spark.createDataFrame([*asked, (90, 0, "zz"), (91, 0, "wa wb"), (92, 0, None)], "query_id long, sub_no int, text string")
    postings = lexical.weighted(lexical.build_postings(chunks)).repartition(4, "chunk_id")
    keys = ["query_id", "sub_no"]
    want = sorted(map(str, lexical.lexical_topk(q, postings, keys, 5, placed=True).collect()))

    def matched(*_):
        raise AssertionError("matches were made as rows")

    monkeypatch.setattr(lexical, "_best", matched)
    monkeypatch.setattr(lexical, "BLOCK_POSTINGS", 100)
    monkeypatch.setattr(lexical, "PIECE_ROWS", 7)
    for rows in (10, 60):
        assert sorted(map(str, lexical.lexical_topk(q, postings, keys, 5, placed=True, max_broadcast=rows).collect())) == want
    # a vocabulary that no chunk has, and chunks without postings
    none = spark.createDataFrame([(i, 0, "zz yy xx") for i in range(9)], "query_id long, sub_no int, text string")
    assert lexical.lexical_topk(none, postings, keys, 5, placed=True, max_broadcast=2).count() == 0
    assert lexical.lexical_topk(q, postings.limit(0), keys, 5, placed=True, max_broadcast=10).count() == 0


def test_a_large_question_side_is_never_broadcast_unasked(spark, monkeypatch):
    """The salted join repeats its question side; Spark, seeing a small file, would broadcast it."""
    monkeypatch.setattr(lexical, "MAX_BROADCAST_LEXEMES", 64)
    chunks = corpus(spark, "alfa beta", "gama")
    q = spark.createDataFrame([(i, "alfa beta gama") for i in range(9)], "query_id long, text string")
    plan = lexical.lexical_topk(q, lexical.build_postings(chunks), KEYS, max_broadcast=0)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_lexical_score_by_hand_and_both_joins_agree(spark):
    chunks = corpus(spark, "alfa alfa beta", "beta gama", "delta")
    q = spark.createDataFrame([(1, "alfa beta alfa")], "query_id long, text string")
    postings = lexical.build_postings(chunks)
    small = lexical.lexical_topk(q, postings, KEYS).collect()
    salted = lexical.lexical_topk(q, postings, KEYS, max_broadcast=0).collect()
    assert sorted(map(tuple, small)) == sorted(map(tuple, salted))
    score = {r["chunk_id"]: r["score"] for r in small}
    part = 0.1 / lexical.PI2_6 / 2
    assert score[0] == pytest.approx(part * (1.25 + 1) / (1 + math.log(3)), abs=1e-9)
    assert score[1] == pytest.approx(part / (1 + math.log(2)), abs=1e-9)


def test_matches_are_summed_where_the_chunk_lies(spark, tmp_path):
    chunks = corpus(spark, *[f"ortak kelime{i % 7}" for i in range(200)]).repartition(4)
    q = spark.createDataFrame([(1, "ortak"), (2, "kelime3 ortak")], "query_id long, text string")
    moved = lexical.lexical_topk(q, lexical.build_postings(chunks), KEYS)
    index = lexical.write_index(lexical.build_postings(chunks), "index_of_matches", str(tmp_path / "index"), 4)
    lying = lexical.lexical_topk(q, index, KEYS, placed=True)
    plan = lying._jdf.queryExecution().executedPlan().toString()
    # The scores are summed where the buckets lie; one exchange gathers the best per query.
    assert "hashpartitioning(query_id" in plan and plan.count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, moved.collect())) == sorted(map(tuple, lying.collect()))


def test_word_present_in_every_chunk(spark):
    chunks = corpus(spark, *[f"ortak kelime{i % 7}" for i in range(500)])
    q = spark.createDataFrame([(1, "ortak"), (2, "kelime3 ortak")], "query_id long, text string")
    got = lexical.chunk_matches(q, lexical.build_postings(chunks), KEYS, max_broadcast=0)
    assert lexical.matching_chunks(q, lexical.build_postings(chunks)).count() == 500
    assert got.groupBy("query_id").count().orderBy("query_id").collect()[0]["count"] == 500


def test_building_the_index_moves_no_rows(spark):
    plan = lexical.build_postings(corpus(spark, "a b"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_fusion_does_not_depend_on_list_order(spark):
    rows = [(1, 0, "vec", c, r, 0.1) for r, c in enumerate((5, 6, 7), 1)] + [(1, 0, "lex", c, r, 1.0) for r, c in enumerate((7, 8), 1)]
    schema = "query_id long, sub_no int, leg string, chunk_id long, rank int, raw double"
    a = {r["chunk_id"]: r["score"] for r in fusion.rrf_fuse(spark.createDataFrame(rows, schema)).collect()}
    b = {r["chunk_id"]: r["score"] for r in fusion.rrf_fuse(spark.createDataFrame(rows[::-1], schema)).collect()}
    assert a == b and a[7] == pytest.approx(1 / 63 + 1 / 61, abs=1e-9) and a[5] == pytest.approx(1 / 61, abs=1e-9)


def test_registered_fusion_takes_the_lists_of_subjects(spark, tmp_path):
    """The subject is a sub-query: what only its list holds is fused, too, and what both hold gets both ranks."""
    tables = {
        "documents": ([(1, "alfa beta", "en", "src1", 9), (2, "gama", "en", "src2", 4), (3, "delta", "en", "src1", 5)],
                      "doc_id long, text string, lang string, source string, n_chars long"),
        "benchmark": ([(1, "alfa"), (7, "alfa")], "item_id long, text string"),
        "conversations": ([(1, 0, "user", "gama beta"), (1, 1, "user", "delta"), (7, 0, "assistant", "gama")],
                          "conv_id long, turn long, role string, text string"),
        "embeddings": ([(99, [1.0] * 64, 0)], "vec_id long, embedding array<float>, label int"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {(r["query_id"], r["chunk_id"]): r["score"] for r in q_search.rrf_fuse(spark, str(tmp_path)).collect() if r["query_id"] in (1, 7)}
    # chunk 2, the shorter one, is first in the subject's word list; vector lists hold only chunks with a vector
    assert got == {(1, 1): round(1 / 61 + 1 / 62, 9), (1, 2): round(1 / 61, 9), (7, 1): round(1 / 61, 9)}


def test_gate_needs_both_signals(spark):
    stats = spark.createDataFrame(
        [(1, True, 0.9, 0), (2, True, 0.9, 3), (3, True, 0.2, 0), (4, False, None, 0), (5, True, None, 0)],
        "query_id long, vector_ran boolean, nearest double, lexical_hits long")
    fused = spark.createDataFrame([(q, 1, 0.1) for q in range(1, 6)], "query_id long, chunk_id long, score double")
    assert sorted(r[0] for r in fusion.scope_gate(fused, stats).select("query_id").collect()) == [2, 3, 4]


def two_passes(rows, k, cap):
    rows = sorted(rows, key=lambda r: (-r[2], r[1]))
    taken, per_doc = [], collections.Counter()
    for _, chunk, _, doc in rows:
        if len(taken) < k and per_doc[doc] < cap:
            per_doc[doc] += 1
            taken.append(chunk)
    for _, chunk, _, doc in rows:
        if len(taken) < k and chunk not in taken:
            taken.append(chunk)
    return taken


def test_diversify_equals_two_passes(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for q in range(150):
        mine = [(q, c, round(rng.random(), 2), rng.randint(0, 3)) for c in range(rng.randint(0, 15))]
        rows += mine
        if mine:
            want[q] = two_passes(mine, 7, 3)
    df = spark.createDataFrame(rows, "query_id long, chunk_id long, score double, document_id long")
    got = ranked(fusion.diversify(df))
    assert got == want


def test_rerank_is_all_or_nothing_per_query(spark):
    fused = spark.createDataFrame([(q, c, 1.0 - c / 10) for q in (1, 2) for c in range(4)], "query_id long, chunk_id long, score double")
    scores = spark.createDataFrame([(1, 0, 0.1), (1, 1, 0.9), (2, 0, 0.5)], "query_id long, chunk_id long, score double")
    out = fusion.rerank_topn(fused, scores, n=2).orderBy("query_id", "position").collect()
    assert [r["chunk_id"] for r in out] == [1, 0, 2, 3, 0, 1, 2, 3]


def test_context_skips_what_does_not_fit(spark):
    hits = spark.createDataFrame([(1, 1, "x" * 90, "a"), (1, 2, "y" * 500, "b"), (1, 3, "z" * 10, "c")],
                                 "query_id long, place int, content string, label string")
    row = fusion.build_context(hits, 200).first()
    assert row["n_sources"] == 2
    assert row["context"] == "[Kaynak 1 — a]\n" + "x" * 90 + "\n\n---\n\n[Kaynak 2 — c]\n" + "z" * 10
    assert fusion.build_context(hits, 1).first()["n_sources"] == 1      # the first always stays
    assert fusion.build_context(hits).first()["n_sources"] == 3


def hits_and_corpus(spark):
    hits = spark.createDataFrame(
        [(q, (q * 3 + n) % 11, f"d{(q * 3 + n) % 11 % 4}", (q * 3 + n) % 11, (q + n) % 5 / 10, n + 1) for q in range(30) for n in range(7)],
        "query_id long, chunk_id long, document_id string, chunk_index long, score double, rank int")
    chunks = spark.createDataFrame([(i, f"text {i} " * (i + 1)) for i in range(40)], "chunk_id long, content string")
    docs = spark.createDataFrame([(f"d{i}", "" if i else "first", f"f{i}.pdf") for i in range(3)],
                                 "document_id string, description string, filename string")
    return hits, plan.Corpus(chunks, docs)


def test_contexts_in_turns_are_the_contexts(spark, monkeypatch):
    hits, own = hits_and_corpus(spark)
    for chars in (None, 150):
        want = sorted(map(tuple, fusion.build_context(
            fusion.document_order(fusion.hydrate_hits(hits, own.chunks, own.documents)), chars).collect()))
        for few, turn in ((1 << 20, 1 << 20), (0, 1 << 20), (0, 1000)):
            monkeypatch.setattr(plan, "MAX_BROADCAST_CHARS", few)
            monkeypatch.setattr(plan, "TURN_CHARS", turn)
            turns = []
            got = plan.contexts_in_turns(hits, own, lambda c: turns.append(1) or c, chars)
            assert sorted(map(tuple, got.collect())) == want and len(want) == 30
            assert len(turns) == 1 if turn > 1000 else len(turns) > 3
    assert plan.contexts_in_turns(hits.limit(0), own, lambda c: c).count() == 0


def test_texts_of_contexts_are_not_exchanged(spark):
    """Few texts go to every task, and the rows that repeat them stay where the join made them."""
    hits, own = hits_and_corpus(spark)
    got = fusion.build_context(fusion.hydrate_hits(fusion.document_order(hits), own.chunks, own.documents, parts=3))
    tree = got._jdf.queryExecution().executedPlan().toString()
    joined = [n for n, line in enumerate(tree.splitlines()) if "BroadcastHashJoin" in line][0]
    assert "ObjectHashAggregate" in tree and not re.search(r"Exchange hashpartitioning", "\n".join(tree.splitlines()[:joined]))


def test_subject_joins_only_when_it_adds_something(spark):
    q = spark.createDataFrame([(1, "transkript istiyorum", "transkript"), (2, "belge", "  not itirazı "), (3, "a", None)],
                              "query_id long, text string, subject string")
    rows = fusion.expand_queries(q).orderBy("query_id", "sub_no").collect()
    assert [(r["query_id"], r["sub_no"], r["text"]) for r in rows] == [
        (1, 0, "transkript istiyorum"), (2, 0, "belge"), (2, 1, "not itirazı"), (3, 0, "a")]


def test_containing_documents_equals_plain_search(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcde") for _ in range(60)) for _ in range(40)]
    passages = [t[10:40] for t in texts[:15]] + ["yok " * 10]
    passages += ["a", "b c", "e d a", "a b c d", "a a a a a", "a b a b a b", "zz", "c zz", "a zz b"]
    got = containing_documents(
        spark.createDataFrame(list(enumerate(passages)), "question_id long, passage string"),
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {tuple(r) for r in got.collect()} == {(i, j) for i, p in enumerate(passages) for j, t in enumerate(texts) if p in t}


@pytest.mark.parametrize("at_once", [20_000, 3])
def test_containing_documents_with_parts_of_words_and_all_white_space(spark, monkeypatch, at_once):
    """Passages that begin or end inside words, and sets that go in turns."""
    monkeypatch.setattr(evaluate, "MAX_PASSAGES", at_once)
    texts = ["the quick\tbrown  fox jumps\nover the lazy dog", "quickbrown", "", None, "a\u2003b c", "the quick brown fox", "x the quick\tbrown"]
    passages = ["quick", "ick", "k b", "k\tb", "ck\tbro", " quick", "quick ", "he quick\tbro", "  fox", "b c", "\u2003b", "quick\tbrown  fox jumps\nover the",
                "fox jumps\nover the lazy d", "e quick brown f", " ", None, "quick"]
    asked = [(i, p) for i, p in enumerate(passages)]
    got = evaluate.containing_documents(
        spark.createDataFrame(asked, "question_id long, passage string"),
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    want = [(i, j) for i, p in asked for j, t in enumerate(texts) if p is not None and p.strip() and t is not None and p in t]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_containing_documents_moves_no_text(spark):
    """Passages go to the documents: no pair of a frequent word meets its text in a join."""
    got = evaluate.containing_documents(
        spark.createDataFrame([(0, "a b c"), (1, "b")], "question_id long, passage string"),
        spark.createDataFrame([(0, "x a b c y")], "doc_id long, text string"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert sorted(map(tuple, got.collect())) == [(0, 0), (1, 0)]


def test_exploded_postings_do_not_carry_the_words_of_their_chunk(spark):
    """A list kept beside the exploded rows made an index of wide rows, square in the words of a chunk."""
    chunks = spark.createDataFrame([(1, "kedi köpek kedi"), (2, "")], "chunk_id long, content string")
    postings = lexical.weighted(lexical.build_postings(chunks))
    plan = postings._jdf.queryExecution().executedPlan().toString()
    beside = re.search(r"Generate \w+\(.*\), \[([^\]]*)\], false", plan).group(1)
    assert re.sub(r"#\w+", "", beside) == "chunk_id"
    assert sorted(tuple(r) for r in postings.select("lexeme", "chunk_id", "tf", "len").collect()) == [("kedi", 1, 2, 3), ("köpek", 1, 1, 3)]


def test_hydrating_moves_no_text_of_other_chunks(spark):
    """Chunks whose vectors come by a join: the texts are cut to the hits below that join."""
    texts = spark.createDataFrame([(i, f"text {i}") for i in range(9)], "chunk_id long, content string")
    vecs = spark.createDataFrame([(i, [1.0]) for i in range(5)], "vec_id long, vec array<double>")
    chunks = texts.join(vecs, texts.chunk_id == vecs.vec_id, "left")
    docs = spark.createDataFrame([("d", "", "d.pdf")], "document_id string, description string, filename string")
    hits = spark.createDataFrame([(1, 3, "d"), (1, 7, "d"), (2, 3, "d")], "query_id long, chunk_id long, document_id string")
    got = fusion.hydrate_hits(hits, chunks, docs)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.find("LeftOuter") < plan.find("LeftSemi")
    rows = sorted(tuple(r) for r in got.select("query_id", "chunk_id", "content", "label").collect())
    assert rows == [(1, 3, "text 3", "d.pdf"), (1, 7, "text 7", "d.pdf"), (2, 3, "text 3", "d.pdf")]
