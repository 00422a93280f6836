"""Registered queries: masking, draft clean-up, retention, erasure."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from corpusdesk.functions import pii
from corpusdesk.operators import retention
from corpusdesk.plans import derive, oracle as o
from corpusdesk.plans.registry import duck, frame, query, table, texts
from corpusdesk.sources.workdir import new_path


@query(f"select doc_id, {o.mask('text')} as text from {duck(derive.PII_DOCS)}")
def mask_pii(spark, sf):
    return frame(spark, sf, derive.PII_DOCS).select("doc_id", pii.mask_pii(F.col("text")).alias("text"))


@query(f"select doc_id, {o.has_pii('text')} as has_pii from documents")
def has_pii(spark, sf):
    return texts(spark, sf).select("doc_id", pii.has_pii(F.col("text")).alias("has_pii"))


def _count(i: int) -> str:
    if i == 0:
        marked = o.sub(o.delimit("text"), o.WORD_ID, "\x03")
    elif i == 3:
        marked = o.sub(o.delimit("text"), o.WORD_NAME, "\x03")
    else:
        before, core, _ = o.PII[i]
        # Marking twice finds neighbours that share a separator.
        hit = before + core + o.NOT_WORD_END
        marked = o.sub(o.sub("text", hit, "\\1\x03\\3"), hit, "\\1\x03\\3")
    return f"(length({marked}) - length(replace({marked}, chr(3), '')))"


@query(f"""select lang, source, count(*) as documents, count(*) filter (where {o.has_pii('text')}) as masked,
 cast(sum({_count(0)}) as bigint) as ids, cast(sum({_count(1)}) as bigint) as phones,
 cast(sum({_count(2)}) as bigint) as emails, cast(sum({_count(3)}) as bigint) as names
 from {duck(derive.PII_DOCS)} d group by lang, source""")
def pii_profile(spark, sf):
    text = F.col("text")
    counts = pii.pii_counts(text)
    return frame(spark, sf, derive.PII_DOCS).groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(pii.has_pii(text)).alias("masked"),
        F.sum(counts["id"]).alias("ids"), F.sum(counts["phone"]).alias("phones"),
        F.sum(counts["email"]).alias("emails"), F.sum(counts["name"]).alias("names"))


_ADDRESSES = """select doc_id, case when lang = 'fr' then source when lang = 'de' then concat(source, '@a@mail.example.com')
 else concat('user', cast(doc_id as string), '@mail.example.com') end as address from {documents}"""


@query(f"""select doc_id, case when not contains(address, '@') then '***'
 else concat(left(regexp_extract(address, '^(.*)@', 1), 2), '***@', regexp_extract(address, '@([^@]*)$', 1)) end as shown from {duck(_ADDRESSES)}""")
def mask_email_address(spark, sf):
    return frame(spark, sf, _ADDRESSES).select("doc_id", pii.mask_email_address(F.col("address")).alias("shown"))


# Lines that ask for personal data, placeholders, repeats and orphaned intros around every document.
_DRAFTY = """select doc_id, concat('Sayın [İsim],', chr(10), 'Şu bilgiler dosyada yok:', chr(10), 'TCKN bilginiz?', chr(10),
 '- [Öğrenci No]', chr(10), text, chr(10), 'Bu satır birden çok kez geçiyor olabilir.', chr(10), '[Ad Soyad] için örnek , belge  konuldu.', chr(10),
 'Ekler:', chr(10), chr(10), '1. transkript', chr(10), 'bu satır birden çok  kez geçiyor olabilir.', chr(10), 'TCKN ile ilgili uzun bir açıklama satırı ki altmış karakterden uzundur ve sormaz', chr(10),
 'Öğrenci numaranızı bu uzun satırda belirtmeniz gerekiyor, çünkü işlem için gereklidir', chr(10), 'Son:') as text from {documents}"""

_TERMS = r"(?i)t\.?\s*c\.?\s*kimlik|tckn|kimlik\s*numara|öğrenci\s*numara|ogrenci\s*numara|ad(?:[ıi]n[ıi]z)?\s*(?:ve)?\s*soyad|doğum\s*tarih"
_ASKS = (r"(?i):\s*$|\?\s*$|(?:^|[^\p{L}\p{N}_])(?:belirt|yaz|gir|ilet|sağla|sagla|paylaş|paylas|ekle|gönder|gonder|bildir|doldur|beyan|sun|göster|goster)[\p{L}\p{N}_]*")
_PH = r"\[[^\]\n]{1,60}\]"


def _no_requests(ls: str) -> str:
    bare = o.strip(o.sub("l", _PH, ""))
    return (f"list_filter({ls}, lambda l: not (regexp_matches({o.sub('l', _PH, '')}, {o.lit(_TERMS)}) and "
            f"(regexp_matches({bare}, {o.lit(_ASKS)}) or length({bare}) < 60)))")


def _no_placeholders(ls: str) -> str:
    left = o.sub(o.sub("l", _PH, ""), r"^[ \-•\t:,.]+|[ \-•\t:,.]+$", "")
    return (f"list_transform(list_filter({ls}, lambda l: not (regexp_matches(l, {o.lit(_PH)}) and length({left}) < 3)), "
            f"lambda l: {o.sub('l', _PH, '')})")


def _rows(ls: str) -> str:
    return f"select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as i from (select doc_id, {ls} as ls from d)"


def _deduped(source: str) -> str:
    """SELECT doc_id, line, i of the rows of ``source`` without later repeats."""
    key = o.lower_tr(o.fold("line"))
    return (f"select doc_id, line, i from (select *, {key} as key, row_number() over (partition by doc_id, {key} order by i) as rn "
            f"from ({source}) a) b where length(key) <= 25 or rn = 1")


def _no_orphans(source: str) -> str:
    item = r"^\s*(?:[-•*]|\d+[.)]|[\p{L}\p{N}_][^:\n]{0,40}:)"
    return (f"select doc_id, line, i from (select *, lead(line) over (partition by doc_id, {o.strip('line')} <> '' order by i) as nxt "
            f"from ({source}) a) b where not regexp_matches(line, ':\\s*$') or regexp_matches(coalesce(nxt, ''), {o.lit(item)})")


def _joined(source: str) -> str:
    return f"select d.doc_id, coalesce(j.text, '') as text from d left join (select doc_id, string_agg(line, chr(10) order by i) as text from ({source}) r group by doc_id) j using (doc_id)"


_D = f"with d as (select * from {duck(_DRAFTY)} x)"


@query(f"{_D} {_joined(_rows(_no_requests(o.lines('text'))))}")
def strip_pii_requests(spark, sf):
    return frame(spark, sf, _DRAFTY).select("doc_id", pii.strip_pii_requests(F.col("text")).alias("text"))


@query(f"{_D} {_joined(_rows(_no_placeholders(o.lines('text'))))}")
def strip_placeholders(spark, sf):
    return frame(spark, sf, _DRAFTY).select("doc_id", pii.strip_placeholders(F.col("text")).alias("text"))


@query(f"{_D} {_joined(_deduped(_rows(o.lines('text'))))}")
def dedupe_lines(spark, sf):
    return frame(spark, sf, _DRAFTY).select("doc_id", pii.dedupe_lines(F.col("text")).alias("text"))


@query(f"{_D} {_joined(_no_orphans(_rows(o.lines('text'))))}")
def drop_orphan_intros(spark, sf):
    return frame(spark, sf, _DRAFTY).select("doc_id", pii.drop_orphan_intros(F.col("text")).alias("text"))


def _tidied(x: str) -> str:
    for pattern, new in ((r"[ \t]{2,}", " "), (r"\s+([,;.!?])", r"\1"), (r"([,;])\s*([,;.])", r"\2"),
                         (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n")):
        x = o.sub(x, pattern, new)
    return o.strip(x)


@query(f"""{_D}, clean as ({_joined(_deduped(_no_orphans(_rows(_no_placeholders(_no_requests(o.lines('text')))))))})
 select doc_id, {_tidied('text')} as text from clean""")
def sanitize_draft(spark, sf):
    return frame(spark, sf, _DRAFTY).select("doc_id", pii.sanitize_draft(F.col("text")).alias("text"))


@query("select c_custkey, sha256(lower(trim(concat(' ', c_name, '@Example.org ')))) as digest from customer")
def pseudonymize(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", pii.pseudonymize(F.concat(F.lit(" \t"), F.col("c_name"), F.lit("@Example.org\r\n"))).alias("digest"))


@query("select c_custkey, c_name as name, c_mktsegment as segment, true as hidden from customer")
def field_crypto(spark, sf):
    """Encrypt and decrypt again.  The key here is a test key; jobs take theirs from a secret."""
    key = F.unhex(F.sha2(F.lit("test key"), 256))
    fields = F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment"))
    sealed = table(spark, sf, "customer").select("c_custkey", "c_name", pii.encrypt_fields(fields, key).alias("token"))
    opened = sealed.withColumn("fields", pii.decrypt_fields(F.col("token"), key))
    return opened.select("c_custkey", F.col("fields")["name"].alias("name"), F.col("fields")["segment"].alias("segment"),
                         (~F.contains("token", F.col("c_name"))).alias("hidden"))


_CONVS = """select o_orderkey as conversation_id, o_orderpriority as messages,
 cast(o_orderdate as timestamp) + interval '90' day as retention_expires_at,
 case when o_orderstatus = 'P' then cast(o_orderdate as timestamp) end as deleted_at from {orders}"""
_CONV_DRAFTS = """select l_orderkey as conversation_id, concat('enc', cast(l_partkey as string)) as fields_enc, l_linenumber as n from {lineitem}"""
_MAIL_LOGS = """select o_orderkey as id, o_orderpriority as subject, 'masked' as body_masked,
 cast(o_orderdate as timestamp) + interval '180' day as retention_expires_at, cast(null as timestamp) as deleted_at from {orders}"""
_MAILS = """select event_id as id, concat('user', cast(user_id as string)) as sender, props as body_text, event_type as body_html, props as reply_body,
 cast(ts as timestamp) - interval '9550' day + interval '180' day as retention_expires_at, cast(null as timestamp) as deleted_at from {events}"""
_PURGE_AT = "1998-06-01 00:00:00"


_PURGED_SQL = f"""with now as (select timestamp '{_PURGE_AT}' as now),
 c as (select *, retention_expires_at <= now and deleted_at is null as hit from {duck(_CONVS)} x, now),
 l as (select *, retention_expires_at <= now as hit from {duck(_MAIL_LOGS)} x, now),
 m as (select *, retention_expires_at <= now as hit from {duck(_MAILS)} x, now)
 select 'conversation' as kind, conversation_id as id, case when hit then '[]' else messages end as payload,
 coalesce({o.stamp('case when hit then now else deleted_at end')}, '') as deleted_at from c
 union all select 'draft', d.conversation_id, coalesce(case when c.hit then null else d.fields_enc end, ''), cast(d.n as string) from {duck(_CONV_DRAFTS)} d left join c using (conversation_id)
 union all select 'log', id, concat(subject, body_masked), coalesce({o.stamp('case when hit then now end')}, '') from l
 union all select 'incoming', id, case when hit then '' else concat(sender, body_text, body_html, reply_body) end, coalesce({o.stamp('case when hit then now end')}, '') from m"""


@query(_PURGED_SQL)
def retention_purge(spark, sf):
    now = F.lit(_PURGE_AT).cast("timestamp")
    out = retention.retention_purge(frame(spark, sf, _CONVS), frame(spark, sf, _CONV_DRAFTS),
                                    frame(spark, sf, _MAIL_LOGS), frame(spark, sf, _MAILS), now)
    return _purged_rows(out)


def _purged_rows(out):
    stamp = F.coalesce(F.date_format("deleted_at", "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias("deleted_at")

    def rows(df, kind, key, payload, last=stamp):
        return df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.coalesce(payload, F.lit("")).alias("payload"), last)

    body = F.concat("sender", *[F.coalesce(c, F.lit("")) for c in ("body_text", "body_html", "reply_body")])
    return (
        rows(out.conversations, "conversation", "conversation_id", F.col("messages"))
        .unionByName(rows(out.drafts, "draft", "conversation_id", F.col("fields_enc"), F.col("n").cast("string").alias("deleted_at")))
        .unionByName(rows(out.logs, "log", "id", F.concat("subject", "body_masked")))
        .unionByName(rows(out.incoming, "incoming", "id", body))
    )


@query(f"""select 'conversations' as table_name, count(*) filter (where retention_expires_at <= timestamp '{_PURGE_AT}' and deleted_at is null) as purged from {duck(_CONVS)} c
 union all select 'logs', count(*) filter (where retention_expires_at <= timestamp '{_PURGE_AT}') from {duck(_MAIL_LOGS)} l
 union all select 'incoming', count(*) filter (where retention_expires_at <= timestamp '{_PURGE_AT}') from {duck(_MAILS)} m""")
def scheduled_purge(spark, sf):
    """The counts that the daily purge reports."""
    return retention.purge_counts(
        {"conversations": frame(spark, sf, _CONVS), "logs": frame(spark, sf, _MAIL_LOGS), "incoming": frame(spark, sf, _MAILS)},
        F.lit(_PURGE_AT).cast("timestamp"))


@query(f"""{_PURGED_SQL}
 union all select 'purged', count(*), 'conversations', '' from c where hit union all select 'purged', count(*), 'logs', '' from l where hit
 union all select 'purged', count(*), 'incoming', '' from m where hit union all select 'purged again', 0, '', ''""")
def scheduled_purge_stored(spark, sf):
    """The stored tables after the daily purge, its counts, and how much a second run finds."""
    stores = retention.RetentionStores.at(spark, new_path(spark, "purge"), 8)
    for name, sql in (("conversations", _CONVS), ("drafts", _CONV_DRAFTS), ("logs", _MAIL_LOGS), ("incoming", _MAILS)):
        getattr(stores, name).write(frame(spark, sf, sql))
    now = datetime.fromisoformat(_PURGE_AT)
    counts, again = (retention.scheduled_purge(stores, now, at_once=48) for _ in range(2))
    said = counts.select(F.lit("purged").alias("kind"), F.col("purged").alias("id"), F.col("table_name").alias("payload"), F.lit("").alias("deleted_at"))
    more = again.agg(F.sum("purged").alias("id")).select(F.lit("purged again").alias("kind"), "id", F.lit("").alias("payload"), F.lit("").alias("deleted_at"))
    return _purged_rows(retention.Purged(*(getattr(stores, n).read() for n in ("conversations", "drafts", "logs", "incoming")), counts)).unionByName(
        said).unionByName(more)


_REQUESTED = "select o_orderkey as conversation_id from {orders} where o_totalprice > 400000"


@query(f"""with hit as (select * from {duck(_REQUESTED)} h)
 select 'conversation' as kind, conversation_id, case when conversation_id in (from hit) then '[]' else messages end as payload,
 coalesce({o.stamp(f"case when conversation_id in (from hit) then timestamp '{_PURGE_AT}' else deleted_at end")}, '') as deleted_at from {duck(_CONVS)} c
 union all select 'draft', conversation_id, case when conversation_id in (from hit) then '' else fields_enc end, '' from {duck(_CONV_DRAFTS)} d""")
def erase_subject(spark, sf):
    convs, drafts = retention.erase_subject(
        frame(spark, sf, _CONVS), frame(spark, sf, _CONV_DRAFTS), frame(spark, sf, _REQUESTED), F.lit(_PURGE_AT).cast("timestamp"))
    return convs.select(
        F.lit("conversation").alias("kind"), "conversation_id", F.col("messages").alias("payload"),
        F.coalesce(F.date_format("deleted_at", "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias("deleted_at"),
    ).unionByName(drafts.select(F.lit("draft").alias("kind"), "conversation_id",
                                F.coalesce("fields_enc", F.lit("")).alias("payload"), F.lit("").alias("deleted_at")))


@query(f"""select o_orderkey, {o.stamp("o_orderdate + interval '90' day")} as conversation, {o.stamp("o_orderdate + interval '180' day")} as log,
 '2002-01-28 00:00:00' as incoming from orders""")
def expiry_dates(spark, sf):
    rows = table(spark, sf, "orders").withColumn("at", F.col("o_orderdate").cast("timestamp"))
    out = retention.expiry_dates(rows, "at", "at", F.lit(derive.NOW_ORDERS).cast("timestamp"))

    def shown(name):
        return F.date_format(f"{name}_expires", "yyyy-MM-dd HH:mm:ss").alias(name)

    return out.select("o_orderkey", shown("conversation"), shown("log"), shown("incoming"))


@query(f"""select id, status, case when status in ('SENT', 'REJECTED') then '' else fields_enc end as fields_enc from {duck(derive.DRAFTS)}
 union all select id, status, case when status = 'REPLIED' then '' else sender_hash end from {duck(derive.INCOMING)}""")
def clear_terminal_pii(spark, sf):
    drafts = retention.clear_terminal_pii(frame(spark, sf, derive.DRAFTS), ["fields_enc"])
    mails = retention.clear_terminal_pii(frame(spark, sf, derive.INCOMING), ["sender_hash"], retention.INCOMING_DONE)
    return drafts.select("id", "status", F.coalesce("fields_enc", F.lit("")).alias("fields_enc")).unionByName(
        mails.select("id", "status", F.coalesce("sender_hash", F.lit("")).alias("fields_enc")))
