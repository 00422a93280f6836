import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusdesk.sources.files import poll_files
from corpusdesk.sources.workdir import new_path
from corpusdesk.streaming import jobs, messages, state

SCHEMA = "id long, user long, ts timestamp, kind string"


def write(spark, folder, rows, name):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def rows(ids, users=3):
    return [(i, i % users, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=7 * i), "ab"[i % 2]) for i in ids]


def test_restart_takes_each_file_once(spark, tmp_path):
    src, out = tmp_path / "src", new_path(spark, "t-polled")
    write(spark, src, rows(range(10)), "a")
    stream = lambda: poll_files(spark, str(src), spark.createDataFrame([], SCHEMA).schema, max_files=1)
    assert jobs.run_to_table(stream(), out).count() == 10
    write(spark, src, rows(range(10, 25)), "b")
    assert jobs.run_to_table(stream(), out).count() == 25
    assert jobs.run_to_table(stream(), out).count() == 25


def test_dedupe_over_files_in_any_order(spark, tmp_path):
    src = tmp_path / "src"
    for part in (range(30, 60), range(0, 40), range(20, 50)):
        write(spark, src, rows(part), "x")
        write(spark, src, rows(part) * 3, "x")
    stream = poll_files(spark, str(src), spark.createDataFrame([], SCHEMA).schema, max_files=2)
    out = jobs.run_to_table(jobs.dedupe(stream, "id", "ts", "1 day"), new_path(spark, "t-dedupe"))
    assert sorted(r["id"] for r in out.collect()) == list(range(60))


def test_running_counts_equal_the_batch(spark, tmp_path):
    src = tmp_path / "src"
    for part in (range(200, 400), range(0, 200)):
        write(spark, src, rows(part), "x")
    stream = poll_files(spark, str(src), spark.createDataFrame([], SCHEMA).schema, max_files=1)
    out = new_path(spark, "t-daily")
    first = jobs.run_latest(jobs.daily_intents(stream, "kind", "ts", "10 days"), out, "complete").collect()
    got = jobs.run_latest(jobs.daily_intents(stream, "kind", "ts", "10 days"), out, "complete")
    assert sorted(map(tuple, first)) == sorted(map(tuple, got.collect()))      # a second run finds nothing new
    want = spark.read.parquet(str(src)).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "kind").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_limits_and_cards(spark, tmp_path):
    src = tmp_path / "src"
    write(spark, src, rows(range(40), users=2), "x")
    schema = spark.createDataFrame([], SCHEMA).schema
    found = jobs.rate_windows(poll_files(spark, str(src), schema), "user", "ts", "1 hour", 4, "1 day")
    over = jobs.run_latest(found, new_path(spark, "t-rate"), "complete").collect()
    assert over and all(r["requests"] == 5 for r in over)
    cards = jobs.live_cards(poll_files(spark, str(src), schema), "user", "ts", "id", {"last": "kind"})
    got = {r["user"]: (r["last"], r["events"]) for r in jobs.run_latest(cards, new_path(spark, "t-cards"), "complete").collect()}
    assert got == {0: ("a", 20), 1: ("b", 20)}


def test_histories_over_several_batches(spark, tmp_path):
    own = jobs.state_session(spark)
    src = tmp_path / "src"
    schema = "conv_id long, turn long, size long"
    for turns in (range(0, 4), range(4, 9)):
        own.createDataFrame([(c, t, 10) for c in (1, 2) for t in turns], schema).coalesce(1).write.mode("append").parquet(str(src))
    stream = poll_files(own, str(src), own.createDataFrame([], schema).schema, max_files=1)
    out = jobs.run_latest(state.trimmed_histories(stream, max_messages=6, max_chars=48), new_path(spark, "t-hist"), "update")
    last = out.groupBy("conv_id").agg(F.max_by("turns", "version").alias("t")).collect()
    assert {r["conv_id"]: list(r["t"]) for r in last} == {1: [5, 6, 7, 8], 2: [5, 6, 7, 8]}


def test_histories_in_any_order_of_arrival(spark, tmp_path):
    own = jobs.state_session(spark)
    src = tmp_path / "src"
    schema = "conv_id long, turn long, size long"
    # turn 5 leaves no room for turn 2, so the short turn 1 that comes last is out as well
    for turns in ([(2, 30), (5, 10)], [(6, 20)], [(1, 1)]):
        own.createDataFrame([(1, t, s) for t, s in turns], schema).coalesce(1).write.mode("append").parquet(str(src))
    stream = poll_files(own, str(src), own.createDataFrame([], schema).schema, max_files=1)
    out = jobs.run_latest(state.trimmed_histories(stream, max_messages=6, max_chars=48), new_path(spark, "t-order"), "update")
    assert list(out.groupBy("conv_id").agg(F.max_by("turns", "version").alias("t")).first()["t"]) == [5, 6]


def test_failed_mails_are_set_aside(spark, tmp_path):
    src = tmp_path / "src"
    spark.createDataFrame([(1, "RECEIVED", "x"), (2, "RECEIVED", ""), (3, "REPLIED", "y")], "id long, status string, body string").write.parquet(str(src))
    mails = poll_files(spark, str(src), spark.read.parquet(str(src)).schema)
    out = new_path(spark, "t-analyze")
    run = lambda: jobs.analyze_batches(mails, out, lambda d: d.select("id", F.lit("PENDING_REVIEW").alias("status")),
                                       "id", F.when(F.col("body") == "", "body missing"))
    run()
    done, failed = run()
    assert [tuple(r) for r in done.select("id", "status").collect()] == [(1, "PENDING_REVIEW")]
    assert [tuple(r) for r in failed.select("id", "status", "last_error").collect()] == [(2, "ANALYSIS_FAILED", "body missing")]


def test_registered_streams_take_several_batches(spark):
    import os

    import pytest

    from corpusdesk.plans import q_streams

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    seen = []
    path = new_path(spark, "t-batches")
    jobs.run_batches(q_streams._events(spark, "/root/testdata/sf0.001"), path, lambda batch, i: seen.append(i))
    assert len(seen) == q_streams.FILES // 3


def test_task_functions_travel_with_the_job():
    from pyspark import cloudpickle

    import corpusdesk

    assert corpusdesk.__name__ in cloudpickle.list_registry_pickle_by_value()


def failing(rows):
    """Lengths of bodies; a mail of three letters x cannot be analyzed."""
    chars = F.when(F.col("body") == "xxx", F.raise_error(F.lit("three x"))).otherwise(F.length("body"))
    return rows.select("id", chars.cast("long").alias("chars"))


def test_only_mails_that_throw_are_set_aside(spark, tmp_path):
    now = dt.datetime(2024, 1, 1, 12)
    mails = spark.createDataFrame([(i, "xxx" if i in (7, 23) else "ok" * i, "RECEIVED") for i in range(40)] + [(99, "xxx", "SENT")], "id long, body string, status string")
    analysis = jobs.Analysis(spark, str(tmp_path / "a"), failing, "id")
    for _ in range(2):      # the same run again replaces what it wrote
        analysis.run(mails, "first", now)
        state = {r["id"]: r for r in analysis.outcomes().collect()}
        assert len(state) == 40 and {i for i, r in state.items() if r["status"] != "DONE"} == {7, 23}
        assert analysis.done().count() == 38 and {r["id"] for r in analysis.done().collect()}.isdisjoint({7, 23})
    assert state[7]["attempts"] == 1 and "three x" in state[7]["last_error"] and state[7]["next_retry"] == now + dt.timedelta(seconds=60)
    assert analysis.due(now).count() == 0
    analysis.retry("second", now + dt.timedelta(seconds=60))
    state = {r["id"]: r for r in analysis.outcomes().collect()}
    assert state[23]["attempts"] == 2 and state[23]["next_retry"] == now + dt.timedelta(seconds=60 + 120)
    # One of them is mended before the last attempt.
    analysis.analyze = lambda rows: failing(rows.withColumn("body", F.when(F.col("id") == 7, "now fine").otherwise(F.col("body"))))
    analysis.retry("third", now + dt.timedelta(hours=1))
    state = {r["id"]: r for r in analysis.outcomes().collect()}
    assert (state[7]["status"], state[7]["last_error"], state[7]["attempts"]) == ("DONE", None, 3)
    assert state[23]["status"] == "ANALYSIS_FAILED" and state[23]["next_retry"] is None
    assert analysis.due(now + dt.timedelta(days=9)).count() == 0
    assert {r["id"]: r["chars"] for r in analysis.done().collect()}[7] == 8


def test_a_broken_analysis_blames_no_mail(spark, tmp_path):
    mails = spark.createDataFrame([(1, "a", "RECEIVED"), (2, "b", "RECEIVED")], "id long, body string, status string")

    def broken(rows):
        raise ConnectionError("no model")

    analysis = jobs.Analysis(spark, str(tmp_path / "b"), broken, "id")
    with pytest.raises(ConnectionError):
        analysis.run(mails, "first", dt.datetime(2024, 1, 1))
    assert not (tmp_path / "b" / "failed").exists() and not (tmp_path / "b" / "attempts").exists()
    analysis.analyze = failing
    analysis.run(mails.limit(0), "first", dt.datetime(2024, 1, 1))
    assert analysis.done().count() == 0 and analysis.outcomes().count() == 0 and analysis.due(dt.datetime(2025, 1, 1)).count() == 0


def test_mails_analyzed_one_by_one_take_few_jobs(spark, tmp_path):
    """A hundred of four hundred mails throw: the jobs of a run do not grow with them."""
    def one(mail):
        if mail["body"] == "xxx":
            raise ValueError("three x")
        return {"id": mail["id"], "chars": len(mail["body"]) if mail["body"] is not None else None}

    start, now = dt.datetime(2024, 1, 1, 12), dt.datetime(2024, 1, 1, 13)
    rows = [(i, "xxx" if i % 4 == 1 else None if i == 2 else "ok" * i, "RECEIVED", start) for i in range(400)] + [(999, "xxx", "SENT", start)]
    mails = spark.createDataFrame(rows, "id long, body string, status string, seen timestamp").repartition(3)
    analysis = jobs.Analysis(spark, str(tmp_path / "c"), one, "id", schema="id long, chars long")
    sc = spark.sparkContext
    sc.setJobGroup("one-by-one", "")
    for _ in range(2):      # the same run again replaces what it wrote
        analysis.run(mails, "first", start)
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(sc.statusTracker().getJobIdsForGroup("one-by-one")) < 60
    state = {r["id"]: r for r in analysis.outcomes().collect()}
    assert len(state) == 400 and {i for i, r in state.items() if r["status"] != "DONE"} == {i for i in range(400) if i % 4 == 1}
    assert state[1]["last_error"] == "three x" and state[1]["attempts"] == 1
    assert {r["id"]: r["chars"] for r in analysis.done().collect()} == {i: None if i == 2 else 2 * i for i in range(400) if i % 4 != 1}
    assert analysis.due(now).where("id = 5 and body = 'xxx' and seen = timestamp '2024-01-01 12:00:00'").count() == 1
    analysis.retry("second", now)
    analysis.retry("third", now + dt.timedelta(hours=1))
    assert {r["status"] for r in analysis.outcomes().where("id % 4 = 1").collect()} == {"ANALYSIS_FAILED"}
    analysis.run(mails.limit(0), "empty", now)
    assert analysis.done().count() == 300


SAID = "conv_id long, turn long, role string, content string, ts timestamp, size long"


def said(spark, folder, rows):
    """One file of (conversation, turn, content, day)."""
    made = [(c, t, "user", text, d and dt.datetime(2024, 1, d), None if text is None else len(text)) for c, t, text, d in rows]
    spark.createDataFrame(made, SAID).coalesce(1).write.mode("append").parquet(str(folder))


def test_messages_are_kept_masked_and_leave_with_time(spark, tmp_path):
    own = jobs.state_session(spark)
    src, out = tmp_path / "src", new_path(spark, "t-messages")
    run = lambda: {r["conv_id"]: [(m["turn"], m["content"], m["ts"]) for m in r["messages"]] for r in messages.run_histories(messages.stored_histories(
        poll_files(own, str(src), own.createDataFrame([], SAID).schema, max_files=1), "1 day", 3, 1000, dt.timedelta(days=10)), out).collect()}
    said(own, src, [(1, t, f"text {t}", 1 + t) for t in range(5)] + [(2, 0, "tel +90 532 111 22 33", 1), (None, 1, "x", 1), (3, None, "x", 1), (3, 1, "x", None)])
    first = run()
    assert set(first) == {1, 2}
    assert [t for t, _, _ in first[1]] == [2, 3, 4] and first[1][0][1:] == ("text 2", "2024-01-03T00:00:00")
    assert "532" not in first[2][0][1]
    # A later message moves the watermark beyond the end of conversation 2 (January 11th) but not of 1 (15th).
    said(own, src, [(4, 0, None, 13)])
    said(own, src, [(1, 1, "left out before", 13)])
    got = run()
    assert set(got) == {1, 4} and [t for t, _, _ in got[1]] == [2, 3, 4] and got[4] == [(0, None, "2024-01-13T00:00:00")]
    # Conversation 2 comes again: its old messages are gone for good.
    said(own, src, [(2, 5, "new", 14)])
    got = run()
    assert got[2] == [(5, "new", "2024-01-14T00:00:00")]
    # The message of the 13th has put off the end of conversation 1 to the 23rd.
    said(own, src, [(5, 0, "far", 24)])
    said(own, src, [(5, 1, "far", 26)])
    assert set(run()) == {5}


class Handle:
    """One value of state, its accesses and the timers that are set."""

    def __init__(self):
        self.value, self.calls, self.timers = None, 0, []

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, at):
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


class Times(Handle):
    """The timer at ``value`` fires under the watermark ``mark``."""

    def __init__(self, value, mark):
        self.value, self.mark = value, mark

    getExpiryTimeInMs = lambda self: self.value
    getCurrentWatermarkInMs = lambda self: self.mark


def test_conversations_of_a_block_take_one_call(spark):
    assert spark.range(-64, 128).groupBy(state.block_of(F.col("id")).alias("b")).count().where("count = 64").count() == 3
    handle, histories = Handle(), state.History(2, 1500)
    histories.init(handle)
    for turns in ((1, 2), (0, 3)):
        rows = pd.DataFrame([(c, t, 10) for c in range(64) for t in turns], columns=["conv_id", "turn", "size"])
        (out,) = histories.handleInputRows((0,), iter([rows[:50], rows[50:]]), None)
    assert handle.calls == 4
    assert out["conv_id"].tolist() == list(range(64)) and set(map(tuple, out["turns"])) == {(2, 3)} and set(out["version"]) == {2}


def test_messages_of_a_block_end_one_by_one():
    handle, held = Handle(), messages.Messages(3, 1500, 100)
    held.init(handle)
    columns = ["conv_id", "turn", "role", "content", "shown", "size", "at"]
    rows = pd.DataFrame([(c, t, "user", f"{c} {t}", "", 10, 10 * c) for c in range(4) for t in range(5)], columns=columns)
    (out,) = held.handleInputRows((0,), iter([rows]), None)
    assert [[m["turn"] for m in ms] for ms in out["messages"]] == [[2, 3, 4]] * 4
    assert handle.timers == [100] and handle.calls == 2
    list(held.handleInputRows((0,), iter([rows[:1].assign(at=115)]), None))     # puts off the end of conversation 0
    assert handle.timers == [110]
    (out,) = held.handleExpiredTimer((0,), Times(None, 121), Times(110, None))
    assert out["conv_id"].tolist() == [1, 2] and handle.timers == [110, 130]
    (out,) = held.handleExpiredTimer((0,), Times(None, 500), Times(130, None))
    assert sorted(out["conv_id"]) == [0, 3] and handle.value is None
