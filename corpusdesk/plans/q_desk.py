"""Registered queries: reports, queues, status histories, conversation histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusdesk.functions.mail import valid_token
from corpusdesk.operators import corpus, desk, history, status
from corpusdesk.operators.windows import active_sessions as count_active, sessions
from corpusdesk.plans import derive, oracle as o
from corpusdesk.plans.registry import duck, frame, query, table

D, I, L, N, K = (duck(x) for x in (derive.DRAFTS, derive.INCOMING, derive.LOGS, derive.INTENTS, derive.DOCS))


def _ts(text):
    return F.lit(text).cast("timestamp")


def _shown(name):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


@query(f"""select (select count(*) from {D} d where status = 'PENDING_APPROVAL') as pending_drafts,
 (select count(*) from {L} l where sent_at >= timestamp '2001-07-31 00:00:00' and deleted_at is null) as sent_today,
 (select count(*) from {K} k where status = 'INDEXED' and deleted_at is null) as indexed_documents,
 (select count(*) from {I} i where status = 'PENDING_REVIEW') as pending_incoming,
 (select count(*) from {I} i where status = 'REPLIED' and reply_sent_at >= timestamp '2001-07-31 00:00:00') as replied_today""")
def dashboard_stats(spark, sf):
    return desk.dashboard_stats(frame(spark, sf, derive.DRAFTS), frame(spark, sf, derive.LOGS), frame(spark, sf, derive.DOCS),
                                frame(spark, sf, derive.INCOMING), _ts("2001-07-31 15:30:00"))


_BREAK = f"select intent_type, count(*) as n from {N} e where detected_at >= timestamp '{derive.NOW_EVENTS}' - interval '7' day group by intent_type"


@query(_BREAK)
def intent_breakdown(spark, sf):
    return desk.intent_breakdown(frame(spark, sf, derive.INTENTS), _ts(derive.NOW_EVENTS))


@query(f"select intent_type, n, round(least(100.0, n / max(n) over () * 100), 6) as percent from ({_BREAK}) b")
def share_of_max(spark, sf):
    return desk.share_of_max(desk.intent_breakdown(frame(spark, sf, derive.INTENTS), _ts(derive.NOW_EVENTS)))


@query(f"select id, conversation_id, intent_type, {o.stamp('detected_at')} as detected_at from {N} e order by e.detected_at desc, id desc limit 50")
def activity_feed(spark, sf):
    """The latest 50; the limit is the feed's own."""
    return desk.activity_feed(frame(spark, sf, derive.INTENTS)).select("id", "conversation_id", "intent_type", _shown("detected_at"))


def _queue_sql(status_d: str, status_i: str) -> str:
    return f"""select item_type, id, status, subject, sender_display, {o.stamp('created_at')} as created_at from (
 select 'draft' as item_type, cast(id as string) as id, status, subject, '' as sender_display, created_at, id as tie from {D} d where {status_d} union all
 select 'incoming_reply', cast(id as string), case status when 'PENDING_REVIEW' then 'PENDING_APPROVAL' when 'REPLIED' then 'SENT' when 'SKIPPED' then 'REJECTED' else status end,
 coalesce(nullif(reply_subject, ''), subject), coalesce(nullif(sender_name, ''), concat('#', left(sender_hash, 8))), received_at, id
 from {I} i where deleted_at is null and {status_i}) u order by u.created_at desc, item_type, tie desc limit 50"""


def _queue(spark, sf, state):
    out = desk.unified_queue(frame(spark, sf, derive.DRAFTS), frame(spark, sf, derive.INCOMING), state)
    return out.select("item_type", "id", "status", "subject", F.coalesce("sender_display", F.lit("")).alias("sender_display"), _shown("created_at"))


@query(_queue_sql("true", "status in ('PENDING_REVIEW', 'APPROVED', 'REPLIED', 'SKIPPED', 'FAILED')"))
def unified_queue(spark, sf):
    """The newest 50 of both lists; the limit is the queue's own."""
    return _queue(spark, sf, None)


@query(_queue_sql("status = 'REJECTED'", "status = 'SKIPPED'"))
def unified_queue_filtered(spark, sf):
    return _queue(spark, sf, "REJECTED")


@query(f"select id, subject, {o.stamp('created_at')} as created_at from {D} d where status = 'FAILED' order by d.created_at desc, id desc limit 20 offset 40")
def list_page(spark, sf):
    """The third page of failed drafts; a page is a limit by nature."""
    page = desk.list_page(frame(spark, sf, derive.DRAFTS), {"status": "FAILED"}, "created_at", "id", 40, 20,
                          {"status": desk.DRAFT_STATES})
    return page.select("id", "subject", _shown("created_at"))


@query(f"select id, subject from {L} l where sent_at between timestamp '1997-01-01 00:00:00' and timestamp '1998-06-30 00:00:00' and deleted_at is null")
def log_range(spark, sf):
    return desk.log_range(frame(spark, sf, derive.LOGS), _ts("1997-01-01 00:00:00"), _ts("1998-06-30 00:00:00")).select("id", "subject")


@query(f"select doc_id, lang from {K} k where source = 'src5' and deleted_at is null")
def get_live(spark, sf):
    return corpus.get_live(frame(spark, sf, derive.DOCS), "source", "src5").select("doc_id", "lang")


@query(f"""select (select count(*) from {D} d where status = 'PENDING_APPROVAL') as drafts,
 (select count(*) from {I} i where status = 'PENDING_REVIEW') as incoming""")
def pending_badges(spark, sf):
    return desk.pending_badges(frame(spark, sf, derive.DRAFTS), frame(spark, sf, derive.INCOMING))


@query("""select c_custkey, case when c_mktsegment = 'MACHINERY' then concat('#', left(sha256(c_name), 8)) else c_name end as shown from customer""")
def display_name(spark, sf):
    name = F.when(F.col("c_mktsegment") == "MACHINERY", "").otherwise(F.col("c_name"))
    return table(spark, sf, "customer").select("c_custkey", desk.display_name(name, F.sha2("c_name", 256)).alias("shown"))


@query(f"""select conversation_id, count(*) as active, count(*) > 1 as several from {D} d where status not in ('SENT', 'REJECTED', 'CANCELLED', 'FAILED') group by 1""")
def active_drafts(spark, sf):
    return desk.active_drafts(frame(spark, sf, derive.DRAFTS))


_TOKENS = """select event_id, user_id, case when event_type = 'error' then null else cast(ts as timestamp) end as last_active_at, cast(ts as timestamp) as started_at,
 case when event_type = 'signup' then cast(ts as timestamp) end as deleted_at from {events}"""


@query(f"""select event_id, case when deleted_at is not null then {o.stamp('deleted_at')} when rn = 1 then '' else '{derive.NOW_EVENTS}' end as deleted_at
 from (select *, row_number() over (partition by user_id, deleted_at is null order by last_active_at desc nulls last, started_at desc, event_id desc) as rn from {duck(_TOKENS)} t) x""")
def latest_per_key(spark, sf):
    out = desk.latest_per_key(frame(spark, sf, _TOKENS), "user_id", "event_id", _ts(derive.NOW_EVENTS))
    return out.select("event_id", F.coalesce(F.date_format("deleted_at", "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias("deleted_at"))


CARD_EVENTS = f"""select event_id, user_id, cast(ts as timestamp) as ts, case when event_type in ('click', 'purchase') then {derive.INTENT} end as intent,
 case when event_type = 'signup' then 'PENDING_APPROVAL' end as state, case when event_type <> 'error' then props end as content from {{events}}"""
CARDS_SQL = f"""select user_id, coalesce(arg_max(intent, event_id) filter (where intent is not null), '') as intent,
 coalesce(arg_max(state, event_id) filter (where state is not null), '') as state, coalesce(arg_max(content, event_id) filter (where content is not null), '') as content,
 {o.stamp('max(ts)')} as last_ts, count(*) as events from {duck(CARD_EVENTS)} e group by user_id"""


def shown_cards(df):
    return df.select("user_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("intent", "state", "content")], _shown("last_ts"), "events")


@query(CARDS_SQL)
def conversation_cards(spark, sf):
    return shown_cards(desk.conversation_cards(frame(spark, sf, CARD_EVENTS), "user_id", "ts", "event_id",
                                               {"intent": "intent", "state": "state", "content": "content"}))


@query(f"""select 'send_draft' as queue, cast(id as string) as id from {D} d where status = 'APPROVED' union all
 select 'analyze', cast(id as string) from {I} i where status = 'RECEIVED' union all select 'send_reply', cast(id as string) from {I} i where status = 'APPROVED' union all
 select 'index', cast(doc_id as string) from {K} k where deleted_at is null and status in ('PENDING', 'PROCESSING')""")
def work_backlog(spark, sf):
    return desk.work_backlog(frame(spark, sf, derive.DRAFTS), frame(spark, sf, derive.INCOMING), frame(spark, sf, derive.DOCS))


_HISTORY = """select event_id, user_id, cast(ts as timestamp) as ts, case event_type when 'view' then 'PENDING_APPROVAL' when 'click' then 'APPROVED'
 when 'purchase' then 'SENT' when 'signup' then 'FAILED' else 'CANCELLED' end as status from {events}"""
_ALLOWED = ", ".join(f"('{a}', '{b}')" for a, nexts in status.DRAFT_TRANSITIONS.items() for b in nexts)


@query(f"""select event_id, user_id, from_status, status as to_status from (select *, lag(status) over (partition by user_id order by ts, event_id) as from_status
 from {duck(_HISTORY)} h) x where from_status is not null and from_status <> status and (from_status, status) not in ({_ALLOWED})""")
def audit_transitions(spark, sf):
    allowed = status.transitions(spark, status.DRAFT_TRANSITIONS)
    out = status.audit_transitions(frame(spark, sf, _HISTORY), allowed, "user_id", "ts", "event_id", F.date_trunc("day", F.col("ts")))
    return out.select("event_id", "user_id", "from_status", "to_status")


@query(f"""select distinct status from (select status from {duck(_HISTORY)} h union all select status from {D} d) s
 where status not in (select a from (values {_ALLOWED}) t(a, b))""")
def terminal_states(spark, sf):
    """Of the states that occur in histories and drafts, those without a successor."""
    seen = frame(spark, sf, _HISTORY).select("status").unionByName(frame(spark, sf, derive.DRAFTS).select("status"))
    return status.terminal_states(seen, status.transitions(spark, status.DRAFT_TRANSITIONS))


_ATTEMPTS = """select event_id, user_id * 100 + event_id % 100 as mail_id, cast(ts as timestamp) as ts, event_type <> 'error' as ok,
 case when event_type = 'error' then concat('error ', cast(event_id as string)) end as error from {events} where event_type in ('error', 'purchase')"""


@query(f"""select mail_id, attempts, case when sent then 'SENT' when attempts >= 3 then 'FAILED' else 'APPROVED' end as status, case when sent then '' else err end as last_error
 from (select mail_id, count(*) as attempts, arg_max(ok, event_id) as sent, arg_max(error, event_id) filter (where not ok) as err from {duck(_ATTEMPTS)} a group by mail_id) x""")
def retry_outcome(spark, sf):
    out = status.retry_outcome(frame(spark, sf, _ATTEMPTS), "mail_id", "ts", "event_id")
    return out.withColumn("last_error", F.coalesce("last_error", F.lit("")))


@query(f"""select id, case when asked and status = 'FAILED' then 'APPROVED' else status end as status, case when asked and status = 'FAILED' then '' else coalesce(last_error, '') end as last_error,
 case when asked and status = 'FAILED' then 'retried' when asked then 'refused' else '' end as outcome from (select *, intent_type = 'complaint' as asked from {D} d) x""")
def manual_retry(spark, sf):
    drafts = frame(spark, sf, derive.DRAFTS)
    out = status.manual_retry(drafts, drafts.where("intent_type = 'complaint'").select("id"))
    return out.select("id", "status", F.coalesce("last_error", F.lit("")).alias("last_error"), F.coalesce("outcome", F.lit("")).alias("outcome"))


_EDITS = """select o_orderkey as id, case when o_orderstatus = 'O' then concat('new ', o_orderpriority) end as subject, case when o_totalprice > 100000 then 'new body' end as body
 from {orders} where o_orderpriority <> '5-LOW'"""


@query(f"""select d.id, case when editable then coalesce(e.subject, d.subject) else d.subject end as subject, case when editable then coalesce(e.body, d.body) else d.body end as body,
 e.id is not null and not editable as refused from (select *, status in ('PENDING_APPROVAL', 'DRAFT_CREATED') as editable from {D} x) d left join {duck(_EDITS)} e using (id)""")
def apply_edits(spark, sf):
    drafts, edits = frame(spark, sf, derive.DRAFTS), frame(spark, sf, _EDITS)
    after, refused = status.apply_edits(drafts, edits, "draft", ["subject", "body"])
    flag = refused.select("id", F.lit(True).alias("refused"))
    return after.join(flag, "id", "left").select("id", "subject", "body", F.coalesce("refused", F.lit(False)).alias("refused"))


_MAIL_EDITS = """select event_id as id, case when value > 10 then concat('re: ', event_type) end as reply_subject, case when value > 20 then 'staff' end as sender_name
 from {events} where value > 5"""


@query(f"""select i.id, case when editable then coalesce(e.reply_subject, i.reply_subject) else i.reply_subject end as reply_subject,
 case when editable then coalesce(e.sender_name, i.sender_name) else i.sender_name end as sender_name, e.id is not null and not editable as refused
 from (select *, status = 'PENDING_REVIEW' as editable from {I} x) i left join {duck(_MAIL_EDITS)} e using (id)""")
def apply_mail_edits(spark, sf):
    """The same for incoming mails, which have other columns and states."""
    mails, edits = frame(spark, sf, derive.INCOMING), frame(spark, sf, _MAIL_EDITS)
    after, refused = status.apply_edits(mails, edits, "incoming", ["reply_subject", "sender_name"])
    flag = refused.select("id", F.lit(True).alias("refused"))
    return after.join(flag, "id", "left").select("id", "reply_subject", "sender_name", F.coalesce("refused", F.lit(False)).alias("refused"))


_REVIEWS_D = """select o_orderkey as id, case when o_totalprice > 150000 then 'approve' else 'reject' end as action, 'admin' as reviewer, o_orderpriority as note from {orders} where o_totalprice > 100000"""
_REVIEWS_I = """select event_id as id, case when value > 20 then 'reanalyze' when value > 10 then 'skip' else 'approve' end as action, 'admin' as reviewer, case when value > 15 then 'not needed' else '' end as note
 from {events} where value > 5"""
_AT = "2001-08-01 00:00:00"


@query(f"""with d as (select d.*, r.action, r.note, r.action is not null as asked, coalesce(d.status = 'PENDING_APPROVAL' and r.action is not null, false) as done from {D} d left join {duck(_REVIEWS_D)} r using (id)),
 i as (select i.*, r.action, r.note, r.action is not null as asked, coalesce((r.action in ('approve', 'skip') and status = 'PENDING_REVIEW')
 or (r.action = 'reanalyze' and status in ('ANALYSIS_FAILED', 'PENDING_REVIEW', 'REPLIED')), false) as done from {I} i left join {duck(_REVIEWS_I)} r using (id))
 select 'draft' as kind, id, case when not done then status when action = 'approve' then 'APPROVED' else 'REJECTED' end as status, case when done then 'applied' when asked then 'refused' else '' end as outcome,
 case when done then 'admin' else '' end as reviewed_by, case when done and action = 'reject' then note else '' end as remark, case when done and action = 'reject' then '' else fields_enc end as kept from d
 union all select 'incoming', id, case when not done then status when action = 'approve' then 'APPROVED' when action = 'skip' then 'SKIPPED' else 'RECEIVED' end,
 case when done then 'applied' when asked then 'refused' else '' end, case when done and action <> 'reanalyze' then 'admin' else '' end,
 case when done and action = 'skip' then note else '' end, case when done and action = 'reanalyze' then '' else coalesce(last_error, '') end from i""")
def apply_reviews(spark, sf):
    drafts = status.apply_reviews(frame(spark, sf, derive.DRAFTS), frame(spark, sf, _REVIEWS_D), "draft", _ts(_AT))
    mails = status.apply_reviews(frame(spark, sf, derive.INCOMING), frame(spark, sf, _REVIEWS_I), "incoming", _ts(_AT))

    def rows(df, kind, remark, kept):
        def text(c, name):
            return F.coalesce(c, F.lit("")).alias(name)

        return df.select(F.lit(kind).alias("kind"), "id", "status", text("outcome", "outcome"), text("reviewed_by", "reviewed_by"),
                         text(remark, "remark"), text(kept, "kept"))

    return rows(drafts, "draft", "rejection_reason", "fields_enc").unionByName(rows(mails, "incoming", "admin_notes", "last_error"))


_SAID = """select conv_id, turn, role, concat(text, ' ara +90 532 111 22 33 veya user', cast(conv_id as string), '@example.org') as text from {conversations}"""


@query(f"""select conv_id, string_agg(concat(turn, ':', role, ':', {o.mask('text')}), chr(10) order by turn) as messages from {duck(_SAID)} s group by conv_id""")
def history_arrays(spark, sf):
    out = history.history_arrays(frame(spark, sf, _SAID), "conv_id", "turn", "role", "text")
    return out.select("conv_id", F.array_join(F.transform("messages", lambda m: F.concat_ws(
        ":", m["turn"].cast("string"), m["role"], m["content"])), "\n").alias("messages"))


TRIM_SQL = """select conv_id, turn, role from (select *, row_number() over (partition by conv_id order by turn desc) as rn,
 sum(length(text) + 22) over (partition by conv_id order by turn desc) as size from conversations) x where rn <= 5 and (size <= 1500 or rn = 1)"""


@query(TRIM_SQL)
def trim_history(spark, sf):
    """The default limits cut nothing in these tables, so smaller ones are set: 5 messages, 1500 characters."""
    rows = table(spark, sf, "conversations").withColumn("encoded", F.concat(F.col("text"), F.lit(" " * 20)))
    return history.trim_history(rows, "conv_id", "turn", max_messages=5, max_chars=1500).select("conv_id", "turn", "role")


_STORED = """select conv_id * 1000 + turn as id, role, turn, case when role = 'user' then concat('[', chr(123), '"role": "user", "content": "', text, '", "ts": "t"', chr(125), ']')
 when role = 'assistant' then concat('[', chr(123), '"role": "user", "content": "', text) else concat(chr(123), '"content": "', text, '"', chr(125)) end as stored
 from (select conv_id, turn, role, replace(text, chr(10), ' ') as text from {conversations}) c"""


@query(f"""select id, case when role = 'user' then 1 else 0 end as n, case when role = 'user' then stored[31:length(stored) - 14] else '' end as content from {duck(_STORED)} s""")
def parse_history(spark, sf):
    rows = frame(spark, sf, _STORED).select("id", history.parse_history(F.col("stored")).alias("m"))
    return rows.select("id", F.size("m").alias("n"), F.coalesce(F.get("m", F.lit(0))["content"], F.lit("")).alias("content"))


_KEYS = """select event_id, case event_type when 'view' then md5(cast(event_id as string)) when 'click' then cast(event_id as string)
 when 'purchase' then concat(md5(props), '+') when 'signup' then concat(md5(props), '_-', md5(props)) else '' end as token from {events}"""


@query(f"select event_id, regexp_full_match(token, '[A-Za-z0-9_-]{{32,64}}') as valid from {duck(_KEYS)} k")
def valid_tokens(spark, sf):
    return frame(spark, sf, _KEYS).select("event_id", valid_token(F.col("token")).alias("valid"))


_MESSAGES = """select conv_id, turn, case when role = 'system' then concat('  ', chr(10)) else text end as text from {conversations}"""


@query(f"select conv_id, turn, case when length({o.strip('text')}) > 400 then 'message too long' else '' end as reason from {duck(_MESSAGES)} m where {o.strip('text')} <> ''")
def message_guard(spark, sf):
    good, bad = history.message_guard(frame(spark, sf, _MESSAGES), "text", 400)
    return good.select("conv_id", "turn", F.lit("").alias("reason")).unionByName(bad.select("conv_id", "turn", "reason"))


_GAP = 6 * 3600
SESSIONS_SQL = f"""with marked as (select *, case when epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts)) < {_GAP}000000 then 0 else 1 end as new from events),
 numbered as (select *, sum(new) over (partition by user_id order by ts, event_id) as no from marked),
 found as (select user_id, min(ts) as session_start, max(ts) as last_seen, cast(count(*) as bigint) as events from numbered group by user_id, no)"""


@query(f"{SESSIONS_SQL} select user_id, {o.stamp('session_start')} as session_start, {o.stamp('last_seen')} as last_seen, events from found")
def sessions_idle_batch(spark, sf):
    """Sessions of the whole table in one batch, with a six-hour pause."""
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return sessions(events, "user_id", "ts", _GAP).select("user_id", _shown("session_start"), _shown("last_seen"), "events")


@query(f"{SESSIONS_SQL} select count(*) as active from found where session_start <= timestamp '2024-01-20 00:00:00' and last_seen + interval '{_GAP}' second > timestamp '2024-01-20 00:00:00'")
def active_sessions(spark, sf):
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return count_active(sessions(events, "user_id", "ts", _GAP), _ts("2024-01-20 00:00:00"), _GAP)
