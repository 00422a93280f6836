import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from corpusdesk.functions import pii
from corpusdesk.operators import corpus, desk, evaluate as ev, history, mailbox, retention, status
from corpusdesk.operators.windows import active_sessions, asof_join, last_before, sessions
from corpusdesk.sources import files, tables


def ts(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def events(spark, n=600):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        user = 0 if rng.random() < 0.4 else rng.randint(1, 9)      # one user holds a large share
        rows.append((i, user, ts(1) + dt.timedelta(minutes=rng.randint(0, 20000)), rng.choice(["a", "b", None])))
    return rows, spark.createDataFrame(rows, "id long, u long, ts timestamp, v string").repartition(4)


def test_last_before_equals_a_loop(spark):
    rows, df = events(spark)
    out = last_before(df, ["u"], ["ts", "id"], "v", "prev", F.date_trunc("day", F.col("ts")))
    got = {r["id"]: r["prev"] for r in out.collect()}
    last, want = {}, {}
    for i, u, at, v in sorted(rows, key=lambda r: (r[2], r[0])):
        want[i] = last.get(u)
        if v is not None:
            last[u] = v
    assert got == want


@pytest.mark.parametrize("inclusive", [False, True])
def test_asof_join(spark, inclusive):
    left = spark.createDataFrame([(1, 5), (1, 10), (2, 3), (1, 1)], "k int, t int")
    right = spark.createDataFrame([(1, 5, "x"), (1, 9, "y"), (2, 4, "z")], "k int, t int, v string")
    out = asof_join(left, right, ["k"], "t", "t", "v", "found", lambda c: F.floor(c / 4), inclusive)
    got = sorted((r["k"], r["t"], r["found"] or "") for r in out.collect())
    assert got == [(1, 1, ""), (1, 5, "x" if inclusive else ""), (1, 10, "y"), (2, 3, "")]


def test_sessions_equal_a_loop(spark):
    rows, df = events(spark)
    gap = 3600
    got = sorted((r["u"], r["session_start"], r["last_seen"], r["events"]) for r in sessions(df, "u", "ts", gap).collect())
    want, seen = [], {}
    for _, u, at, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        if u in seen and (at - seen[u][1]).total_seconds() < gap:
            seen[u][1], seen[u][2] = at, seen[u][2] + 1
        else:
            if u in seen:
                want.append((u, *seen[u]))
            seen[u] = [at, at, 1]
    want += [(u, *s) for u, s in seen.items()]
    assert got == sorted(want)
    assert active_sessions(sessions(df, "u", "ts", gap), F.lit("2024-01-05 00:00:00").cast("timestamp"), gap).count() == 1


def test_latest_per_key_keeps_one_live_row(spark):
    rows = [(1, "k", ts(1), ts(1), None), (2, "k", ts(3), ts(1), None), (3, "k", None, ts(5), None), (4, "k", ts(9), ts(9), ts(9)), (5, "j", None, ts(1), None)]
    df = spark.createDataFrame(rows, "id int, key string, last_active_at timestamp, started_at timestamp, deleted_at timestamp")
    out = desk.latest_per_key(df, "key", "id", F.lit("2024-02-01").cast("timestamp"))
    assert {r["id"] for r in out.where("deleted_at is null").collect()} == {2, 5}
    assert out.count() == 5


def test_duplicates_with_one_content_in_a_third_of_all_rows(spark):
    docs = spark.createDataFrame([(i, "same" if i % 3 == 0 else f"t{i}") for i in range(300)], "doc_id long, text string")
    assert corpus.dedupe_documents(docs).count() == 201
    assert corpus.duplicate_report(docs).first()["copies"] == 100
    store = docs.where("doc_id < 10")
    assert corpus.incremental_import(docs, store).count() == 201 - 7
    assert tuple(corpus.import_counts(docs, store).first()) == (194, 106)


def test_documents_without_text_are_no_copies(spark):
    docs = spark.createDataFrame([(1, None), (2, None), (3, "a"), (4, "a"), (5, "")], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus.dedupe_documents(docs).collect()) == [1, 2, 3, 5]


def test_copies_do_not_move_the_texts(spark):
    docs = spark.createDataFrame([(i, "same" if i % 3 == 0 else f"t{i}") for i in range(300)], "doc_id long, text string")
    plan = corpus.dedupe_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_texts_are_worked_out_once_for_their_hashes(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def costly(i):
        calls.add(1)
        return "same" if i % 3 == 0 else f"t{i}"

    docs = spark.range(300).select(F.col("id").alias("doc_id"), costly("id").alias("text"))
    fresh = corpus.dedupe_documents(docs)
    assert calls.value == 300
    assert fresh.count() == 201


def test_replacing_chunks_of_many_documents_sorts_none(spark):
    old = spark.range(0, 400_000, 1000).select(F.col("id").alias("doc_id"), F.lit(0).alias("chunk_index"), F.lit("old").alias("content"))
    new = old.withColumn("content", F.lit("new"))
    outcomes = spark.range(300_000).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("error"))
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = tables.replace_chunks(old, new, outcomes)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
        assert {r["content"]: r["count"] for r in out.groupBy("content").count().collect()} == {"old": 100, "new": 300}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_erasing_many_subjects_sorts_no_rows(spark):
    convs = spark.range(0, 400_000, 1000).select(
        F.col("id").alias("conversation_id"), F.lit("said").alias("messages"), F.lit(None).cast("timestamp").alias("deleted_at"))
    drafts = convs.select("conversation_id", F.lit("enc").alias("fields_enc")).union(spark.createDataFrame([(None, "enc")], "id long, enc string"))
    requests = spark.range(300_000).select(F.col("id").alias("conversation_id"))
    now = F.lit("2024-02-01").cast("timestamp")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for asked in (requests.union(requests), requests.where("id < 2000")):     # dealt by id, to every task
            gone = asked.where("conversation_id % 1000 = 0").distinct().count()
            erased, cleared = retention.erase_subject(convs, drafts, asked, now)
            for out in (erased, cleared):
                assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
            assert erased.count() == 400 and erased.where("messages = '[]' and deleted_at is not null").count() == gone
            assert cleared.count() == 401 and cleared.where("fields_enc is null").count() == gone
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_asof_keeps_rows_without_key_or_time(spark):
    from corpusdesk.operators.windows import asof_join

    left = spark.createDataFrame([(1, "a", 10), (2, None, 10), (3, "a", None), (4, "b", 5)], "id long, k string, t long")
    right = spark.createDataFrame([("a", 3, "x"), (None, 3, "y"), ("a", None, "z"), ("b", 5, "w")], "k string, t long, v string")
    out = asof_join(left, right, ["k"], "t", "t", "v", "found", lambda c: c.cast("long") - c.cast("long") % 4)
    assert sorted((r.id, r.found) for r in out.collect()) == [(1, "x"), (2, None), (3, None), (4, None)]


def test_first_arrival_of_a_message_stays(spark):
    from corpusdesk.operators import mailbox

    rows = [("m", 2, "late"), ("m", 1, "first"), ("n", 1, "only"), ("o", 1, "known")]
    incoming = spark.createDataFrame(rows, "message_id string, at long, body string")
    store = spark.createDataFrame([("o",)], "message_id string")
    for n in (1, 4):
        got = mailbox.dedupe_messages(incoming.repartition(n), store, order=("at",)).collect()
        assert sorted((r.message_id, r.body) for r in got) == [("m", "first"), ("n", "only")]


def test_stamp_follows_content_and_settings(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    stamp = lambda d, s: corpus.corpus_stamp(d, s).first()["stamp"]
    base = stamp(docs, {"size": 500})
    assert base == stamp(docs.orderBy(F.desc("doc_id")).repartition(3), {"size": 500})
    assert base != stamp(docs, {"size": 400})
    assert base != stamp(spark.createDataFrame([(1, "b"), (2, "a")], "doc_id long, text string"), {"size": 500})


def test_failed_documents_keep_their_chunks_in_the_table(spark, tmp_path):
    path = str(tmp_path / "chunks")
    old = spark.createDataFrame([(d, i, f"old {d}") for d in range(20) for i in range(2)], "doc_id long, chunk_index int, content string")
    tables.write_chunks(old, path, 4)
    new = spark.createDataFrame([(d, 0, f"new {d}") for d in (3, 4)], "doc_id long, chunk_index int, content string")
    outcomes = spark.createDataFrame([(3, None), (4, "embedding failed " * 200)], "doc_id long, error string")
    tables.replace_chunks_in_table(spark, path, new, outcomes, 4)
    rows = {(r["doc_id"], r["chunk_index"]): r["content"] for r in tables.read_chunks(spark, path).collect()}
    assert rows[(3, 0)] == "new 3" and (3, 1) not in rows
    assert rows[(4, 0)] == "old 4" and len(rows) == 39
    docs = spark.createDataFrame([(3,), (4,)], "doc_id long")
    states = {r["doc_id"]: (r["status"], r["processing_error"]) for r in tables.document_outcomes(docs, outcomes).collect()}
    assert states[3] == ("INDEXED", None) and states[4][0] == "FAILED" and len(states[4][1]) == 2000


def test_files_over_the_limit_are_rejected(spark, tmp_path):
    (tmp_path / "a.txt").write_text("metin")
    (tmp_path / "b.txt").write_bytes(b"")
    (tmp_path / "c.txt").write_bytes(b"x" * (1024 * 1024 + 1))
    good, bad = files.read_files(spark, str(tmp_path), max_mb=1)
    assert [r["name"] for r in good.collect()] == ["a.txt"]
    assert {r["name"]: r["reject_reason"] for r in bad.collect()} == {"c.txt": "file too large"}
    uploads = spark.createDataFrame([("a", 1), ("b", 0), ("c", 2 ** 21)], "name string, length long")
    good, bad = files.split_by_size(uploads, max_mb=1)
    assert {r["name"]: r["reject_reason"] for r in bad.collect()} == {"b": "empty file", "c": "file too large"}
    assert [r["name"] for r in good.collect()] == ["a"]


def test_knowledge_base_skips_blank_lines(spark, tmp_path):
    lines = [json.dumps({"title": "t", "content": "c"}), "", json.dumps({"title": "u", "tags": ["x", "y"], "content": "d"}), '{"title": "v', "[1"]
    (tmp_path / "kb.jsonl").write_text("\n".join(lines))
    good, rejected = files.read_kb(spark, str(tmp_path / "kb.jsonl"))
    assert [(r["title"], r["tags"]) for r in good.orderBy("title").collect()] == [("t", []), ("u", ["x", "y"])]
    assert sorted(r["line"] for r in rejected.collect()) == ["[1", '{"title": "v']


def test_baseline_of_another_corpus_is_not_used(spark, tmp_path):
    results = spark.createDataFrame([("s", 1, 0)], "suite string, question_id int, pos int")
    tables.write_baseline(results, F.lit("abc"), str(tmp_path / "b"))
    assert tables.read_baseline(spark, str(tmp_path / "b"), "s", "abc").count() == 1
    assert tables.read_baseline(spark, str(tmp_path / "b"), "s", "other").count() == 0


def purge_case(spark):
    now = F.lit("2024-01-10").cast("timestamp")
    convs = spark.createDataFrame([(1, "[1]", ts(9), None), (2, "[2]", ts(11), None), (3, "[3]", ts(1), ts(2))],
                                  "conversation_id int, messages string, retention_expires_at timestamp, deleted_at timestamp")
    drafts = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "conversation_id int, fields_enc string")
    logs = spark.createDataFrame([(1, "s", "b", ts(10), None)], "id int, subject string, body_masked string, retention_expires_at timestamp, deleted_at timestamp")
    mails = spark.createDataFrame([(1, "e", "t", "h", "r", ts(1), None)],
                                  "id int, sender string, body_text string, body_html string, reply_body string, retention_expires_at timestamp, deleted_at timestamp")
    return convs, drafts, logs, mails, now


def test_purge_is_complete_and_repeatable(spark):
    convs, drafts, logs, mails, now = purge_case(spark)
    out = retention.retention_purge(convs, drafts, logs, mails, now)
    assert {r["conversation_id"]: r["messages"] for r in out.conversations.collect()} == {1: "[]", 2: "[2]", 3: "[3]"}
    assert sorted((r["conversation_id"], r["fields_enc"]) for r in out.drafts.collect() if r["fields_enc"]) == [(2, "z")]
    assert out.logs.first()["subject"] == "s" and out.logs.first()["deleted_at"] is not None
    assert out.incoming.first()["sender"] == "" and out.incoming.first()["reply_body"] is None
    assert {r["table_name"]: r["purged"] for r in out.counts.collect()} == {"conversations": 1, "logs": 1, "incoming": 1}
    again = retention.retention_purge(out.conversations, out.drafts, out.logs, out.incoming, now)
    assert all(r["purged"] == 0 for r in again.counts.collect())
    assert retention.retention_purge(convs, drafts, logs, mails, now, blank_logs=True).logs.first()["subject"] is None


def test_field_crypto_refuses_a_wrong_key(spark):
    df = spark.createDataFrame([({"a": "1"},)], "m map<string,string>")
    key, other = F.unhex(F.sha2(F.lit("k"), 256)), F.unhex(F.sha2(F.lit("o"), 256))
    sealed = df.select(pii.encrypt_fields(F.col("m"), key).alias("t"))
    assert sealed.select(pii.decrypt_fields(F.col("t"), key)).first()[0] == {"a": "1"}
    assert sealed.select(pii.decrypt_fields(F.col("t"), other)).first()[0] is None


def test_recall_mrr_and_misses(spark):
    rows = [("s", "m", i, p) for i, p in enumerate([0, 2, 6, 9, None])]
    df = spark.createDataFrame(rows, "suite string, method string, question_id int, pos int")
    r = ev.recall_at_k(df, ["method"]).first()
    assert (r["recall_1"], r["recall_3"], r["recall_7"], r["n"]) == (0.2, 0.4, 0.6, 5)
    assert ev.mrr(df, ["method"]).first()["mrr"] == round((1 + 1 / 3 + 1 / 7 + 1 / 10) / 5, 4)
    assert sorted(x["question_id"] for x in ev.misses(df, 3).collect()) == [2, 3, 4]


def test_paired_comparison_and_verdicts(spark):
    schema = "question_id int, pos int"
    before = spark.createDataFrame([(1, 0), (2, None), (3, 5), (4, 0)], schema)
    after = spark.createDataFrame([(1, 4), (2, 0), (3, 5), (9, 0)], schema)
    assert tuple(ev.paired_diff(before, after, 3).first()) == (3, 1, 1, 1)
    diffs = spark.createDataFrame([(1, 0, 2), (2, 0, 1), (3, 6, 1), (4, 9, 0)], "k int, improved long, broken long")
    got = ev.regression_gate(diffs, F.col("k") != 4).orderBy("k").collect()
    assert [r["verdict"] for r in got] == ["fail", "pass", "adopt", "skip"]


def test_article_targets(spark):
    rows = [("x MADDE 12 – y", "12"), ("GEÇİCİ MADDE 1 – y", "1"), ("GEÇİCİ MADDE 1 – y", "GEÇİCİ 1"), ("MADDE 41/A – y", "41/A"), ("MADDE 123", "12")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, c string, a string")
    got = df.select("i", ev.article_matches(F.col("c"), F.col("a")).alias("m")).orderBy("i").collect()
    assert [r["m"] for r in got] == [True, False, True, True, False]


def test_sample_is_the_same_each_time(spark):
    df = spark.createDataFrame([(i, ["a", "b", None][i % 3]) for i in range(90)], "id int, c string")
    a = sorted(map(tuple, ev.stratified_sample(df, "c", "id", 5, 1).collect()))
    b = sorted(map(tuple, ev.stratified_sample(df.repartition(5), "c", "id", 5, 1).collect()))
    assert a == b and len(a) == 15 and {c for _, c in a} == {"a", "b", "?"}


def test_reply_classes(spark):
    rows = [("Öğrenci işlerine danışınız.", True, "redirect_only"), ("Süre 30 gün", False, "invented"), ("Süre 30 gün", True, "answer"),
            ("30 gün; öğrenci işlerine başvurun", True, "answer_and_redirect"), ("öğrenci işlerine danışın " + "x" * 400, True, "redirect")]
    df = spark.createDataFrame(rows, "b string, s boolean, want string")
    assert df.where(ev.reply_class(F.col("b"), F.col("s")) != F.col("want")).count() == 0


def test_unknown_filter_value_is_an_error(spark):
    df = spark.createDataFrame([(1, "SENT", ts(1))], "id int, status string, created_at timestamp")
    with pytest.raises(ValueError):
        desk.list_page(df, {"status": "NOPE"}, "created_at", "id", 0, 10, {"status": desk.DRAFT_STATES})


def test_incoming_machine_and_terminal_states(spark):
    allowed = status.transitions(spark, status.INCOMING_TRANSITIONS)
    seen = spark.createDataFrame([(s,) for s in status.INCOMING_TRANSITIONS], "status string")
    assert {r[0] for r in status.terminal_states(seen, allowed).collect()} == {"REPLIED", "SKIPPED"}
    rows = [(1, 7, ts(1), "RECEIVED"), (2, 7, ts(2), "ANALYZING"), (3, 7, ts(3), "PENDING_REVIEW"), (4, 7, ts(4), "APPROVED")]
    hist = spark.createDataFrame(rows, "id int, e int, ts timestamp, status string")
    bad = status.audit_transitions(hist, allowed, "e", "ts", "id", F.date_trunc("day", F.col("ts"))).collect()
    assert [(r["from_status"], r["to_status"]) for r in bad] == [("ANALYZING", "PENDING_REVIEW")]


def test_reindex_review(spark):
    docs = spark.createDataFrame([(1, "FAILED", "e"), (2, "PENDING", "e")],
                                 "id int, status string, last_error string").withColumns(
        {"reviewed_by": F.lit(None).cast("string"), "reviewed_at": F.lit(None).cast("timestamp")})
    acts = spark.createDataFrame([(1, "reindex", "a", None), (2, "reindex", "a", None)], "id int, action string, reviewer string, note string")
    got = {r["id"]: (r["status"], r["last_error"], r["outcome"]) for r in
           status.apply_reviews(docs, acts, "document", F.current_timestamp()).collect()}
    assert got == {1: ("PENDING", None, "applied"), 2: ("PENDING", "e", "refused")}


def test_trim_history_equals_json_lengths(spark):
    rng = random.Random(9)
    rows, want = [], {}
    for conv in range(60):
        sizes = [rng.randint(1, 60) for _ in range(rng.randint(1, 12))]
        messages = [{"c": "x" * s} for s in sizes]
        kept = list(enumerate(messages))[-6:]
        while len(json.dumps([m for _, m in kept])) > 150 and len(kept) > 1:
            kept = kept[1:]
        want[conv] = [i for i, _ in kept]
        rows += [(conv, i, json.dumps(m)) for i, m in enumerate(messages)]
    df = spark.createDataFrame(rows, "conv int, turn int, encoded string")
    got = {}
    for r in history.trim_history(df, "conv", "turn", max_messages=6, max_chars=150).orderBy("conv", "turn").collect():
        got.setdefault(r["conv"], []).append(r["turn"])
    assert got == want


def test_broken_histories_are_empty(spark):
    df = spark.createDataFrame([("[]",), ("{}",), ('[{"role":"u"',), (None,), ('[{"role":"u","content":"c","ts":"t"}]',)], "t string")
    assert [len(r[0]) for r in df.select(history.parse_history(F.col("t"))).collect()] == [0, 0, 0, 0, 1]


def test_merge_and_route(spark):
    req = spark.createDataFrame([(1, "complaint"), (2, "nonsense")], "id int, intent string")
    out = mailbox.route_department(req, mailbox.label_frame(spark, {"complaint": "d"}, "intent", "department"),
                                   mailbox.label_frame(spark, {"d": "m@x"}, "department", "mailbox"))
    assert {r["id"]: r["mailbox"] for r in out.collect()} == {1: "m@x", 2: None}


def test_json_parts_stay_below_the_limit(spark, tmp_path):
    """Files of a table of any size can be read again: none is above the limit unless one row is."""
    rows = spark.range(3000).selectExpr("id as doc_id", "case when id % 500 = 7 then repeat('y', 6000) when id > 0 then repeat('é\"', cast(id % 90 as int)) end as text")
    files.write_json_parts(rows, str(tmp_path / "parts"), "doc_id", 10_000)
    sizes = [p.stat().st_size for p in (tmp_path / "parts").glob("*/*/*.json")]
    assert max(sizes) <= 10_000 and len(sizes) < 3 * sum(sizes) / 10_000 + 50
    accepted, rejected = files.read_files(spark, str(tmp_path / "parts") + "/*/*/*.json", max_mb=10_000 / 1024 / 1024)
    assert rejected.count() == 0 and accepted.agg(F.sum("length")).first()[0] == sum(sizes)
    back = spark.read.schema("doc_id long, text string").json(str(tmp_path / "parts") + "/*/*/*.json")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
