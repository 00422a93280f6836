"""Registered queries: streams over the given tables, run until all input is read."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from corpusdesk.functions import mail
from corpusdesk.operators import fusion, mailbox
from corpusdesk.plans import derive, oracle as o, search as plan
from corpusdesk.plans.q_desk import CARDS_SQL, SESSIONS_SQL, TRIM_SQL, _GAP, _shown, shown_cards
from corpusdesk.plans.q_mail import _MAIL
from corpusdesk.plans.q_search import P, corpus
from corpusdesk.plans.registry import duck, query, table
from corpusdesk.sources.files import poll_files
from corpusdesk.sources.workdir import new_path
from corpusdesk.streaming import jobs, messages, state


FILES = 12


def _stream(spark, sf, name, max_files=3):
    """The given table as a stream of FILES files in mixed order, a few of them per micro-batch."""
    feed = new_path(spark, f"feed-{name}")
    table(spark, sf, name).repartition(FILES).write.parquet(feed)
    return poll_files(spark, feed, table(spark, sf, name).schema, max_files=max_files)


def _events(spark, sf, **kw):
    return _stream(spark, sf, "events", **kw).withColumn("ts", F.col("ts").cast("timestamp"))


@query(f"select event_id, user_id, event_type, {o.stamp('ts')} as ts from events")
def poll_source(spark, sf):
    out = jobs.run_to_table(_events(spark, sf, max_files=3), new_path(spark, "polled"))
    return out.select("event_id", "user_id", "event_type", _shown("ts"))


@query(f"""select page_id, concat('<generated-', md5(html), '@example.org>') as message_id,
 {o.html('html')} as body, '2024-01-01 09:30:00' as received_at from pages""")
def stream_ingest(spark, sf):
    """Poll, generate missing ids, take text from HTML, convert dates, append."""
    raw = _stream(spark, sf, "pages", max_files=3)
    clean = raw.select(
        "page_id", mail.message_id_or_generated(F.lit(None).cast("string"), F.encode("html", "UTF-8"), "example.org").alias("message_id"),
        mail.body_or_html(F.lit(None).cast("string"), F.col("html")).alias("body"),
        mail.to_naive_utc(F.lit("Mon, 1 Jan 2024 12:30:00 +0300"), F.current_timestamp()).alias("received_at"))
    return jobs.run_to_table(clean, new_path(spark, "ingested")).select("page_id", "message_id", "body", _shown("received_at"))


@query("select distinct event_id, event_type from events")
def stream_dedupe(spark, sf):
    twice = _events(spark, sf).union(_events(spark, sf))
    # Files come in any order of time, so the delay spans the whole table.
    out = jobs.run_to_table(jobs.dedupe(twice, "event_id", "ts", "60 days"), new_path(spark, "deduped"))
    return out.select("event_id", "event_type")


@query("""select strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') as window_start, user_id, count(*) as requests from events group by all having count(*) > 3""")
def rate_limit_windows(spark, sf):
    """Days with more than three requests of a user; the table is too sparse for minutes."""
    found = jobs.rate_windows(_events(spark, sf), "user_id", "ts", "1 day", 3, "60 days")
    return jobs.run_latest(found, new_path(spark, "rates"), "complete").select(_shown("window_start"), "user_id", "requests")


@query(f"{SESSIONS_SQL} select user_id, {o.stamp('session_start')} as session_start, {o.stamp('last_seen')} as last_seen, events from found")
def sessions_idle(spark, sf):
    found = jobs.idle_sessions(_events(spark, sf), "user_id", "ts", "60 days", _GAP)
    return jobs.run_latest(found, new_path(spark, "sessions"), "complete").select(
        "user_id", _shown("session_start"), _shown("last_seen"), "events")


@query("select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n from events group by all")
def intent_counts_stream(spark, sf):
    counts = jobs.daily_intents(_events(spark, sf), "event_type", "ts", "60 days")
    return jobs.run_latest(counts, new_path(spark, "daily"), "complete")


@query(CARDS_SQL)
def live_cards_stream(spark, sf):
    rows = _events(spark, sf).selectExpr(
        "user_id", "event_id", "ts", f"case when event_type in ('click', 'purchase') then {derive.INTENT} end as intent",
        "case when event_type = 'signup' then 'PENDING_APPROVAL' end as state",
        "case when event_type <> 'error' then props end as content")
    cards = jobs.live_cards(rows, "user_id", "ts", "event_id", {c: c for c in ("intent", "state", "content")})
    return shown_cards(jobs.run_latest(cards, new_path(spark, "cards"), "complete"))


@query(TRIM_SQL.replace("select conv_id, turn, role from", "select conv_id, cast(turn as bigint) as turn from"))
def history_stream(spark, sf):
    """Histories in state, trimmed to 5 messages and 1500 characters as messages arrive."""
    own = jobs.state_session(spark)
    rows = _stream(own, sf, "conversations").select("conv_id", "turn", (F.length("text") + 20).cast("bigint").alias("size"))
    updates = jobs.run_latest(state.trimmed_histories(rows, 5, 1500), new_path(spark, "histories"), "update")
    latest = updates.groupBy("conv_id").agg(F.max_by("turns", "version").alias("turns"))
    return latest.select("conv_id", F.explode("turns").alias("turn"))


@query(f"""select x.conv_id, cast(x.turn as bigint) as turn, x.role, {o.mask("concat(x.text, ' ara +90 532 111 22 33')")} as content,
 strftime(timestamp '2024-01-01 00:00:00' + to_seconds(cast(x.conv_id * 60 + x.turn as bigint)), '%Y-%m-%dT%H:%M:%S') as ts
 from (select *, row_number() over (partition by conv_id order by turn desc) as rn,
  sum(length(text) + 22) over (partition by conv_id order by turn desc) as size from conversations) x where rn <= 5 and (size <= 1500 or rn = 1)""")
def history_messages_stream(spark, sf):
    """The masked messages that are kept in state, trimmed to 5 messages and 1500 characters."""
    own = jobs.state_session(spark)
    at = "timestamp '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, conv_id * 60 + turn)"
    rows = _stream(own, sf, "conversations").selectExpr(
        "conv_id", "turn", "role", "concat(text, ' ara +90 532 111 22 33') as content", f"{at} as ts", "length(text) + 20 as size")
    # Files come in any order of time, so the delay spans the whole table.
    held = messages.run_histories(messages.stored_histories(rows, "5000 days", 5, 1500), new_path(spark, "messages"))
    return held.select("conv_id", F.inline("messages"))


_AUTO = f"(select mail_id, role, length(trim(body)) as n from {duck(_MAIL)} m)"


@query(f"""select mail_id, case when role = 'system' then 'ANALYSIS_FAILED' else 'PENDING_REVIEW' end as status,
 case when role = 'system' then 'body missing' else '' end as last_error, role <> 'system' as has_sources from {_AUTO} a""")
def analyze_batches(spark, sf):
    """Mails are cleaned, searched for and set to review, batch by batch."""
    mails = _stream(spark, sf, "conversations", max_files=4).selectExpr(
        "conv_id * 1000 + turn as mail_id", "role", "concat('Konu ', cast(conv_id as string)) as subject",
        "case when role = 'system' then '' else text end as body", "'RECEIVED' as status")
    c = corpus(spark, sf)
    settings = spark.createDataFrame([("CO_PILOT",)], "mode string")

    def analyze(batch):
        asked = mailbox.build_query(batch.withColumns({
            "intent": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double")}))
        subs = fusion.expand_queries(asked.select(F.col("mail_id").alias("query_id"), "text", "subject", "intent"))
        subs = subs.withColumn("vec", F.lit(None).cast("array<float>"))
        shown = plan.contexts_in_turns(plan.search(subs, c, P, use_vectors=False), c, lambda context: context.select(
            F.col("query_id").alias("mail_id"), mail.context_preview(F.col("context"))["source_count"].alias("source_count")))
        seen = batch.select("mail_id", F.lit(None).cast("string").alias("reviewed_by"),
                            F.lit(None).cast("timestamp").alias("reviewed_at")).join(
            shown, "mail_id", "left")
        done = mailbox.auto_approve(seen, settings, F.lit(derive.NOW_EVENTS).cast("timestamp"))
        return done.select("mail_id", "status", F.coalesce("source_count", F.lit(0)).alias("sources"))

    missing = F.when(F.trim("body") == "", "body missing")
    done, failed = jobs.analyze_batches(mails, new_path(spark, "analyzed"), analyze, "mail_id", missing)
    return done.select("mail_id", "status", F.lit("").alias("last_error"), (F.col("sources") > 0).alias("has_sources")).unionByName(
        failed.select("mail_id", "status", "last_error", F.lit(False).alias("has_sources")))


_BROKEN = "conv_id % 53 = 5 and turn = 1"


@query(f"""select conv_id * 1000 + turn as mail_id, case when {_BROKEN} then 'ANALYSIS_FAILED' else 'DONE' end as status,
 case when {_BROKEN} then 3 else 1 end as attempts, case when {_BROKEN} then '[USER_RAISED_EXCEPTION] cannot be read' else '' end as last_error,
 case when {_BROKEN} then -1 else length(text) end as chars from conversations where turn is not null and conv_id is not null""")
def analyze_batches_isolated(spark, sf):
    """Some mails make the analysis throw: they alone are set aside, tried three times and given up."""
    mails = _stream(spark, sf, "conversations", max_files=6).where("turn is not null and conv_id is not null").selectExpr(
        "conv_id * 1000 + turn as mail_id", f"{_BROKEN} as broken", "text as body", "'RECEIVED' as status")

    def analyze(one):
        if one["broken"]:
            raise ValueError("[USER_RAISED_EXCEPTION] cannot be read")
        return {"mail_id": one["mail_id"], "chars": None if one["body"] is None else len(one["body"])}

    path, now = new_path(spark, "isolated"), derive.NOW_EVENTS
    analysis = jobs.Analysis(spark, path, analyze, "mail_id", schema="mail_id long, chars long")
    start = datetime.fromisoformat(str(now))
    jobs.analyze_isolated(mails, path + "/stream", analysis, lambda: start)
    for n in (1, 2):
        analysis.retry(f"retry{n}", start + timedelta(hours=n))
    return analysis.outcomes().join(analysis.done(), "mail_id", "left").select(
        "mail_id", "status", "attempts", F.coalesce("last_error", F.lit("")).alias("last_error"), F.coalesce("chars", F.lit(-1)).alias("chars"))
