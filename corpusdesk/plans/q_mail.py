"""Registered queries: incoming mail and model output."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusdesk.functions import mail
from corpusdesk.operators import mailbox
from corpusdesk.plans import derive, oracle as o
from corpusdesk.plans.registry import duck, frame, query, table, texts


def _in(words) -> str:
    return ", ".join(o.lit(w) for w in words)


@query(f"""select message_id, min(id) as id, arg_min(intent_type, id) as intent_type from {duck(derive.INCOMING)} where intent_type <> 'complaint'
 and message_id not in (select message_id from {duck(derive.INCOMING)} where intent_type = 'complaint') group by message_id""")
def dedupe_messages(spark, sf):
    """Every message arrives twice, the second time later and as another type; complaints are in the store already."""
    all_ = frame(spark, sf, derive.INCOMING).select("message_id", "id", "intent_type", F.lit(1).alias("arrival"))
    store = all_.where("intent_type = 'complaint'")
    late = all_.withColumns({"intent_type": F.lit("late"), "arrival": F.lit(2)})
    return mailbox.dedupe_messages(late.unionByName(all_), store, order=("arrival", "id")).select("message_id", "id", "intent_type")


_RAW_MAIL = "select page_id, html, case when page_id > 100 then concat('  <m', cast(page_id as string), '>') else '  ' end as mid from {pages}"


@query(f"""select page_id, case when trim(mid) <> '' then trim(mid) else
 concat('<generated-', md5(html), '@example.org>') end as message_id from {duck(_RAW_MAIL)} r""")
def synthetic_message_id(spark, sf):
    rows = frame(spark, sf, _RAW_MAIL)
    return rows.select("page_id", mail.message_id_or_generated(
        F.col("mid"), F.encode("html", "UTF-8"), "example.org").alias("message_id"))


@query("""select conv_id, turn, role from conversations where not (role = 'system' or length(text) > 900
 or (role = 'assistant' and turn < 3) or turn = 6)""")
def auto_reply_filter(spark, sf):
    rows = table(spark, sf, "conversations").withColumn(
        "headers",
        F.when(F.length("text") > 900, F.create_map(F.lit("precedence"), F.lit("Bulk")))
        .when(F.col("role") == "system", F.create_map(F.lit("auto-submitted"), F.lit("auto-replied")))
        .otherwise(F.create_map(F.lit("precedence"), F.lit("normal"))),
    ).withColumn(
        "sender",
        F.when((F.col("role") == "assistant") & (F.col("turn") < 3), "No-Reply@example.org")
        .when(F.col("turn") == 6, "mailer-daemon@example.org").otherwise("a@example.org"))
    return mailbox.keep_personal(rows).select("conv_id", "turn", "role")


@query(f"""select page_id, case when coalesce(text, '') <> '' then text else {o.html('html')} end as body
 from pages left join (select doc_id, case when lang = 'en' then '' else text end as text from documents) d on page_id = doc_id""")
def body_fallback(spark, sf):
    docs = texts(spark, sf).select("doc_id", F.when(F.col("lang") == "en", "").otherwise(F.col("text")).alias("text"))
    pages = texts(spark, sf, "pages")
    return pages.join(docs, pages.page_id == docs.doc_id, "left").select(
        "page_id", mail.body_or_html(F.col("text"), F.col("html")).alias("body"))


_DATES = """select o_orderkey, o_orderdate, o_orderstatus, o_orderpriority from {orders}"""


@query(f"""select o_orderkey, {o.stamp("case when o_orderpriority like '1%' then o_orderdate + interval '12' hour when o_orderpriority like '2%' then o_orderdate + interval '17' hour "
 "when o_orderpriority like '3%' then o_orderdate + interval '9' hour + interval '30' minute when o_orderstatus = 'F' then o_orderdate + interval '9' hour "
 "when o_orderstatus = 'O' then o_orderdate + interval '12' hour else timestamp '2000-01-01 00:00:00' end")} as received_at from orders""")
def to_naive_utc(spark, sf):
    rows = table(spark, sf, "orders")
    day = F.date_format("o_orderdate", "d MMM yyyy")
    # zone names, no seconds, two-digit years
    stamp = (
        F.when(F.col("o_orderpriority").startswith("1"), F.concat(F.lit("Tue, "), day, F.lit(" 12:00:00 GMT")))
        .when(F.col("o_orderpriority").startswith("2"), F.concat(F.date_format("o_orderdate", "d MMM yy"), F.lit(" 12:00:00 EST")))
        .when(F.col("o_orderpriority").startswith("3"), F.concat(day, F.lit("  12:30 +0300")))
        .when(F.col("o_orderstatus") == "F", F.concat(F.lit("Mon, "), day, F.lit(" 12:00:00 +0300 (TRT)")))
        .when(F.col("o_orderstatus") == "O", F.concat(day, F.lit(" 12:00:00")))
        .otherwise("yesterday"))
    out = mail.to_naive_utc(stamp, F.lit("2000-01-01 00:00:00").cast("timestamp"))
    return rows.select("o_orderkey", F.date_format(out, "yyyy-MM-dd HH:mm:ss").alias("received_at"))


# Mails: greeting, own text, closing, signature and a quoted thread, by role.
_MAIL = """select conv_id * 1000 + turn as mail_id, conv_id, turn, role, concat('Konu ', cast(conv_id as string)) as subject,
 case role when 'user' then concat('Sayın Hocam,', chr(10), text, chr(10), 'Saygılarımla', chr(10), 'Mehmet Demir', chr(10), 'Tel: +90 532 111 22 33',
 chr(10), '> alıntı satırı', chr(10), 'On Mon, 1 Jan 2024 someone wrote:', chr(10), text)
 when 'assistant' then concat('Merhaba', chr(10), text, chr(10), '-- ', chr(10), 'imza satırı', chr(10), 'https://example.org/x')
 else concat('-----Original Message-----', chr(10), text) end as body from {conversations}"""

_QUOTE = (r"(?im)(?:^-{2,}\s*Original Message\s*-{2,}|^_{5,}|^-{5,}|^From:\s|^Gönderen:\s|^Kimden:\s"
          r"|^\s*\d{1,2}\s+[\p{L}\p{N}_]+\s+\d{4}\s+.*(?:yazdı|wrote)\s*:|^On\s.+wrote:|^.*\b\d{1,2}[./]\d{1,2}[./]\d{2,4}\b.*\byazdı\s*:)")


def _trimmed(x: str) -> str:
    cut = f"string_split({o.sub(x, _QUOTE, chr(1))}, chr(1))[1]"
    cut = f"string_split({o.sub(cut, '(?m)^--[ \t]*$', chr(1))}, chr(1))[1]"
    kept = f"list_filter(string_split({cut}, chr(10)), lambda s: not regexp_matches(s, '^\\s*>'))"
    return o.strip(f"array_to_string({kept}, chr(10))")


def _stripped(x: str) -> str:
    w = r"[\p{L}\p{N}_]"
    greet = mail.GREETINGS.replace("ı", "[ıiI]").replace(r"\s", "[ \t]")
    contact = mail.CONTACT_LINES.replace(r"[\w.+-]+@[\w.-]+\.\w+", r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_.-]+\." + w + "+")
    x = o.sub(x, rf"(?im)^\s*(?:{greet})\s*[,.]?\s*$", "")
    x = o.sub(x, rf"(?im)^\s*(?:{contact})$", "")
    s = o.strip("s")
    kept = (f"list_filter(string_split({x}, chr(10)), lambda s: not (length({s}) < 30 and "
            f"regexp_matches({s}, '^\\p{{Lu}}[\\p{{L}} ]* [\\p{{L}} ]*$')))")
    return o.strip(o.sub(f"array_to_string({kept}, chr(10))", r"\n{2,}", "\n"))


def _search_text(x: str) -> str:
    return f"left(case when length(clean) < 80 then {o.strip(x)} else clean end, 1200)"


@query(f"select mail_id, {_trimmed('body')} as text from {duck(_MAIL)}")
def trim_quoted(spark, sf):
    return frame(spark, sf, _MAIL).select("mail_id", mail.trim_quoted(F.col("body")).alias("text"))


@query(f"select mail_id, {_stripped('body')} as text from {duck(_MAIL)}")
def strip_boilerplate(spark, sf):
    return frame(spark, sf, _MAIL).select("mail_id", mail.strip_boilerplate(F.col("body")).alias("text"))


_ASKED = f"""select m.*, case when turn = 0 then 'complaint' else 'other' end as intent,
 case when turn < 2 then 0.9 when turn < 4 then 0.4 end as confidence from ({_MAIL}) m"""
_CLEAN = f"(select *, {_stripped(_trimmed('body'))} as clean from {duck(_ASKED)} q)"


@query(f"""select mail_id, {_search_text('body')} as text, case when confidence is null or confidence >= 0.7 then intent else '' end as intent from {_CLEAN}""")
def build_query(spark, sf):
    return mailbox.build_query(frame(spark, sf, _ASKED)).select(
        "mail_id", "text", F.coalesce("intent", F.lit("")).alias("intent"))


@query(f"""with q as (select mail_id, {_search_text('body')} as text, subject from {_CLEAN})
 select mail_id, 0 as sub_no, text from q union all
 select mail_id, 1, trim(subject) from q where trim(subject) <> '' and not contains(text, trim(subject))""")
def expand_queries(spark, sf):
    from corpusdesk.operators.fusion import expand_queries as expand

    return expand(mailbox.build_query(frame(spark, sf, _ASKED)).select("mail_id", "text", "subject"))


# Braces are written as characters, since names in braces stand for tables.
_RAW_INTENT = f"""select event_id, event_type, intent, user_id, case event_type
 when 'view' then concat(chr(123), '"intent": "', intent, '", "confidence": 0.', cast(user_id + 100 as string), chr(125))
 when 'click' then concat('```json', chr(10), chr(123), '"intent": "', intent, '"', chr(125), chr(10), '```')
 when 'purchase' then concat('Cevap: ', chr(123), '"intent": "', intent, '", "confidence": "0.25"', chr(125), ' tamam')
 when 'signup' then concat(chr(123), '"confidence": 0.5, "x": ', cast(user_id as string), chr(125))
 else concat(chr(123), '"intent": ', intent) end as raw from (select *, {derive.INTENT} as intent from {{events}}) e"""


@query(f"""select event_id, case event_type when 'signup' then 'other' when 'error' then 'general_question' else intent end as intent,
 round(case event_type when 'view' then cast(concat('0.', user_id + 100) as double) when 'click' then 0.7 when 'purchase' then 0.25 else 0.5 end, 6) as confidence,
 event_type in ('click', 'purchase') as requires_email from {duck(_RAW_INTENT)} r""")
def parse_intent(spark, sf):
    rows = frame(spark, sf, _RAW_INTENT).select("event_id", mail.parse_intent(F.col("raw")).alias("p"))
    return rows.select("event_id", "p.intent", F.round("p.confidence", 6).alias("confidence"), "p.requires_email")


# Model replies: JSON with raw line breaks, fenced JSON, JSON inside prose, plain text.
_REPLIES = """select conv_id * 1000 + turn as id, conv_id, turn, role, text, concat('konu ', cast(conv_id as string)) as subject,
 case when role = 'user' then concat(chr(123), '"subject": "Re: s', cast(turn as string), '", "body": "', text, '"', chr(125))
 when role = 'assistant' and turn < 3 then concat('Cevap:', chr(10), '```json', chr(10), chr(123), '"body": "', text, '"', chr(125), chr(10), '```')
 when role = 'assistant' then concat('Yanıt ', chr(123), '"subject": null, "body": "', text, '"', chr(125), ' bitti')
 else text end as raw from {conversations}"""


@query(f"""select id, case when role = 'user' then concat('Re: s', turn) when role = 'assistant' and turn >= 3 then '' else concat('Re: ', subject) end as subject,
 text as body from {duck(_REPLIES)} r""")
def parse_reply_json(spark, sf):
    rows = frame(spark, sf, _REPLIES).select("id", mail.parse_reply(F.col("raw"), F.col("subject")).alias("r"))
    return rows.select("id", F.coalesce("r.subject", F.lit("")).alias("subject"), "r.body")


_DIRTY = """select conv_id * 1000 + turn as id, role, case when turn < 4 then concat('Ayşe ', cast(conv_id as string)) end as sender,
 case role when 'user' then concat('Sayın Öğrenci, ', text, ' [Kaynak 2 — belge.pdf] devam', chr(10), 'Konu: transkript', chr(10), chr(10), chr(10), chr(10), 'Sayın [isim] son')
 when 'assistant' then concat(chr(123), '"subject": "x", "body": "', text, chr(10), 'YÖNETMELİK BİLGİSİ burada', chr(10), 'rag_context ile', '"', chr(125))
 else concat('Sayın Hocamız', chr(10), text, ' [name]') end as body from {conversations}"""


def _dirty_sql() -> str:
    x = "body"
    for leak in mail.JSON_LEAKS:
        x = o.sub(x, leak, "")
    x = o.sub(o.sub(x, r"\s+$", ""), r'"\s*\}\s*$', "")
    x = o.sub(x, mail.SOURCE_TAG, " ")
    x = o.sub(x, r"YÖNETMEL[İI]K\s+B[İI]LG[İI]S[İI]\s*", "")
    x = o.sub(x, r"\brag_context\b\s*", "")
    x = o.sub(x, "(?im)" + mail.META_LINE, "")
    x = o.sub(x, r"\n{3,}", "\n\n")
    for slot in (r"\[\s*isim\s*\]", r"\[\s*name\s*\]"):
        x = f"regexp_replace({x}, {o.lit('(?i)' + slot)}, name, 'g')"
    x = o.sub(x, r"^\s+", "")
    greet = r"(?i)^\s*Sayın\s+[^,\n]{1,60},?[ \t]*([^\n]*)"
    rest = f"regexp_extract(string_split({x}, chr(10))[1], {o.lit(greet)}, 1)"
    first = f"string_split({x}, chr(10))[1]"
    body = (f"case when regexp_matches({first}, {o.lit(greet)}) then {o.strip(rest)} else {first} end")
    tail = f"string_split({x}, chr(10))[2:]"
    joined = f"array_to_string(list_concat([concat('Sayın ', name, ',')], case when {body} <> '' then [{body}] else [] end, {tail}), chr(10))"
    return o.strip(o.sub(joined, r"\n[ \t]*(\n[ \t]*)+\n", "\n\n"))


@query(f"""select id, {_dirty_sql()} as body from (select *, coalesce(nullif(trim(sender), ''), 'Öğrenci') as name from {duck(_DIRTY)} d) n""")
def sanitize_reply(spark, sf):
    return frame(spark, sf, _DIRTY).select("id", mail.sanitize_reply(F.col("body"), F.col("sender")).alias("body"))


_REQUIRED = "['academic_year', 'semester', 'language']"


@query(f"""select event_id, case when k % 2 = 0 then '2024' else cast(k as string) end as academic_year, 'en' as language,
 case when event_type = 'view' then '' when event_type = 'click' then 'bahar' else '' end as semester,
 case when event_type = 'click' then '' else 'semester' end as missing
 from (select *, cast(json_extract_string(props, '$.k') as int) as k from events) e""")
def merge_fields(spark, sf):
    ev = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    none = F.lit(None).cast("string")
    collected = F.when(F.col("k") % 2 == 0, F.create_map(F.lit("academic_year"), F.lit("2024"), F.lit("language"), F.lit("en"))
                       ).otherwise(F.create_map(F.lit("language"), F.lit("en")))
    extracted = F.create_map(
        F.lit("academic_year"), F.col("k").cast("string"), F.lit("language"), F.lit("fr"), F.lit("unknown"), F.lit("x"),
        F.lit("semester"), F.when(F.col("event_type") == "view", "").when(F.col("event_type") == "click", "bahar").otherwise(none))
    required = F.array(*[F.lit(f) for f in mail.REQUIRED_FIELDS["transcript_request"]])
    rows = ev.select("event_id", mail.merge_fields(collected, extracted, required).alias("m"))

    def value(name):
        return F.coalesce(F.try_element_at("m.collected", F.lit(name)), F.lit("")).alias(name)

    return rows.select("event_id", value("academic_year"), value("language"), value("semester"),
                       F.array_join("m.missing", ",").alias("missing"))


@query(f"""select event_id, intent, case when intent = 'general_question' then '' else 'ogrenci_isleri' end as department,
 case when intent = 'general_question' then '' else 'desk@example.org' end as mailbox from (select *, {derive.INTENT} as intent from events) e""")
def route_department(spark, sf):
    requests = frame(spark, sf, f"select event_id, {derive.INTENT} as intent from {{events}}")
    out = mailbox.route_department(
        requests, mailbox.label_frame(spark, mail.INTENT_DEPARTMENT, "intent", "department"),
        mailbox.label_frame(spark, {"ogrenci_isleri": "desk@example.org"}, "department", "mailbox"))
    return out.select("event_id", "intent", F.coalesce("department", F.lit("")).alias("department"),
                      F.coalesce("mailbox", F.lit("")).alias("mailbox"))


_ANSWERS = """select conv_id * 1000 + turn as id, concat(text, case when turn = 0 then ' Evet, uygun' when turn = 1 then ' HAYIR vazgeçtim' else '' end) as said,
 case role when 'user' then 'DRAFT_CREATED' when 'assistant' then 'COLLECTING_INFO' else 'SENT' end as state from {conversations}"""


def _any(words) -> str:
    low = o.lower_tr("said")
    return "(" + " or ".join(f"contains({low}, {o.lit(w)})" for w in words) + ")"


@query(f"""select id, case state when 'DRAFT_CREATED' then case when {_any(mail.APPROVE_WORDS)} then 'PENDING_APPROVAL'
 when {_any(mail.REVIEW_CANCEL_WORDS)} then 'CANCELLED' else 'DRAFT_CREATED' end
 when 'COLLECTING_INFO' then case when {_any(mail.COLLECT_CANCEL_WORDS)} then 'CANCELLED' else 'COLLECTING_INFO' end
 else state end as next_state from {duck(_ANSWERS)} a""")
def decide_reply(spark, sf):
    return frame(spark, sf, _ANSWERS).select("id", mail.decide_reply(F.col("said"), F.col("state")).alias("next_state"))


_NOTES = """select conv_id * 1000 + turn as id, concat(text, ' ', chr(10)) as body,
 case role when 'user' then '  ek bilgi ' when 'assistant' then '   ' end as note from {conversations}"""


@query(f"""select id, case when coalesce(trim(note), '') <> '' then concat({o.sub('body', r'[ \n\r\t]+$', '')}, chr(10), chr(10), 'NOT: ', trim(note)) else body end as body
 from {duck(_NOTES)} n""")
def compose_reply(spark, sf):
    return frame(spark, sf, _NOTES).select("id", mail.compose_reply(F.col("body"), F.col("note")).alias("body"))


_CONTEXTS = """select doc_id, concat('[Kaynak 1 — ', source, ']', chr(10), text, case when lang = 'en' then concat(chr(10), '[Kaynak 2 — b]') else '' end) as context from {documents}"""


@query(f"""select doc_id, cast((length(context) - length(replace(context, '[Kaynak', ''))) / 7 as int) as source_count,
 case when length(context) > 1000 then concat(left(context, 1000), '...') else context end as preview from {duck(_CONTEXTS)} c""")
def context_preview(spark, sf):
    rows = frame(spark, sf, _CONTEXTS).select("doc_id", mail.context_preview(F.col("context")).alias("p"))
    return rows.select("doc_id", "p.source_count", "p.preview")


@query(f"""select id, mode, case when mode = 'PILOT' then 'APPROVED' else 'PENDING_REVIEW' end as status, mode = 'PILOT' as auto_approved,
 case when mode = 'PILOT' then '{derive.NOW_ORDERS}' else '' end as reviewed_at from {duck(derive.DRAFTS)} d, (values ('PILOT'), ('CO_PILOT')) m(mode)""")
def auto_approve(spark, sf):
    drafts = frame(spark, sf, derive.DRAFTS)
    out = None
    for mode in ("PILOT", "CO_PILOT"):
        settings = spark.createDataFrame([(mode,)], "mode string")
        one = mailbox.auto_approve(drafts, settings, F.lit(derive.NOW_ORDERS).cast("timestamp")).select(
            "id", F.lit(mode).alias("mode"), "status", "auto_approved",
            F.coalesce(F.date_format("reviewed_at", "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias("reviewed_at"))
        out = one if out is None else out.unionByName(one)
    return out


_LABEL_CASE = "case intent " + " ".join(f"when {o.lit(k)} then {o.lit(v)}" for k, v in mail.INTENT_LABELS.items()) + " else intent end"
_COLLECTED = f"""select event_id, case when event_type = 'error' then 'unknown_intent' else {derive.INTENT} end as intent, event_type, user_id from {{events}}"""


@query(f"""select event_id, {_LABEL_CASE} as subject, case when event_type = 'view' then concat('k', user_id, ' bahar')
 when event_type = 'click' then 'bahar' else {_LABEL_CASE} end as text from {duck(_COLLECTED)} c""")
def draft_query(spark, sf):
    k = F.when(F.col("event_type") == "view", F.concat(F.lit("k"), F.col("user_id").cast("string"))).otherwise("")
    v = F.when(F.col("event_type").isin("view", "click"), "bahar")
    rows = frame(spark, sf, _COLLECTED).withColumn("collected", F.create_map(F.lit("year"), k, F.lit("semester"), v))
    out = mailbox.draft_queries(rows, mailbox.label_frame(spark, mail.INTENT_LABELS, "intent", "label"))
    return out.select("event_id", "subject", "text")
