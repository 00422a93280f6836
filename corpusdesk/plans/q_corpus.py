"""Registered queries: ingestion, chunking, deduplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusdesk.functions import text as tx
from corpusdesk.operators import chunking, corpus
from corpusdesk.operators.windows import asof_join
from corpusdesk.plans import derive, oracle as o
from corpusdesk.plans.q_sources import _windows
from corpusdesk.plans.registry import duck, frame, query, table, texts


@query("""select doc_id, text as plain, text as with_mark, replace(replace(text, 'ß', 's'), 'ñ', 'n') as single_byte from documents""")
def decode_text(spark, sf):
    docs = texts(spark, sf)
    # Latin letters of these texts have the same bytes in ISO-8859-1 and in cp1254.
    simple = F.replace(F.replace(F.col("text"), F.lit("ß"), F.lit("s")), F.lit("ñ"), F.lit("n"))
    return docs.select(
        "doc_id",
        tx.decode_text(F.encode("text", "UTF-8")).alias("plain"),
        tx.decode_text(F.unhex(F.concat(F.lit("EFBBBF"), F.hex(F.encode("text", "UTF-8"))))).alias("with_mark"),
        tx.decode_text(F.encode(simple, "ISO-8859-1")).alias("single_byte"),
    )


_SNIFF = """select doc_id, case lang when 'en' then concat(source, '.pdf') when 'de' then concat(source, '.md')
 when 'fr' then concat(source, '.bin') else concat(source, '.txt') end as name,
 case when source in ('src1', 'src2', 'src3', 'src4') then 'application/octet-stream' else 'text/html' end as declared,
 case when source in ('src0', 'src1') then concat('%PDF-1.7', text) when source = 'src2' then concat('PK', chr(3), chr(4), text)
 when source = 'src5' then concat(text, chr(1)) when source = 'src6' then concat('x', chr(1), text) else text end as body
 from {documents}"""


@query(f"""select doc_id, case when left(body, 5) = '%PDF-' then 'application/pdf'
 when left(body, 4) = concat('PK', chr(3), chr(4)) then '{tx.DOCX_MIME}' when reason is null then
 case when name like '%.md' then 'text/markdown' else 'text/plain' end end as mime,
 case when left(body, 5) <> '%PDF-' and left(body, 4) <> concat('PK', chr(3), chr(4)) then reason end as reject_reason
 from (select doc_id, name, body, case when name like '%.pdf' then 'signature missing'
 when name like '%.bin' and declared not like 'text/%' then 'type unknown'
 when contains(body, chr(1)) then 'binary content'
 end as reason from {duck(_SNIFF)}) x""")
def sniff_type(spark, sf):
    rows = frame(spark, sf, _SNIFF)
    return rows.select("doc_id", tx.sniff_type(F.encode("body", "UTF-8"), F.col("name"), F.col("declared")).alias("t")).select(
        "doc_id", "t.mime", "t.reject_reason")


_ROUTE = """select doc_id, case lang when 'en' then concat(source, '.PDF') when 'de' then concat(source, '.docx')
 when 'fr' then concat(source, '.md') else source end as name,
 case when source in ('src1', 'src2') then 'text/plain' when source = 'src3' then 'application/pdf' end as mime,
 case when source = 'src4' then concat('%PDF-', text) else text end as body from {documents}"""


@query(f"""select extractor, count(*) as n from (select case when mime = 'application/pdf' or lower(name) like '%.pdf' then 'pdf'
 when name like '%.docx' then 'docx' when mime like 'text/%' or name like '%.md' then 'text'
 when left(body, 5) = '%PDF-' then 'pdf' else 'text' end as extractor from {duck(_ROUTE)}) x group by 1""")
def route_extractor(spark, sf):
    rows = corpus.route_extractor(frame(spark, sf, _ROUTE).withColumn("content", F.encode("body", "UTF-8")))
    return rows.groupBy("extractor").agg(F.count(F.lit(1)).alias("n"))


@query(f"select page_id, {o.html('html')} as text from pages")
def html_to_text(spark, sf):
    return texts(spark, sf, "pages").select("page_id", tx.html_to_text(F.col("html")).alias("text"))


_RAW = "select doc_id, replace(replace(text, '. ', concat('.', chr(13), chr(10), chr(9))), 'tion ', concat('tion-', chr(10))) as text from {documents}"


@query(f"select doc_id, {o.normalize('text')} as text from {duck(_RAW)}")
def normalize_text(spark, sf):
    return frame(spark, sf, _RAW).select("doc_id", tx.normalize_text(F.col("text")).alias("text"))


# Every line of a document becomes an article; some numbers run backward, some
# carry a prefix or a letter, some lines are preceded by a chapter heading.
def _regulation_heading(concat: str, i: str) -> str:
    return (
        f"case {i} % 9 when 4 then concat('GEÇİCİ MADDE ', cast({i} // 9 + 1 as string), ' – ') "
        f"when 6 then concat('MADDE ', cast({i} - 4 as string), ' - ') "
        f"when 7 then concat('MADDE ', cast({i} as string), '/A (') "
        f"when 8 then concat('BİRİNCİ BÖLÜM', chr(10), 'Genel hükümler', chr(10), 'Madde ', cast({i} + 1 as string), ' — ') "
        f"else concat('MADDE ', cast({i} + 1 as string), chr(10), '– ') end"
    )


_REG_DUCK = f"""(select doc_id, array_to_string(list_transform(string_split(text, chr(10)),
 lambda l, j: concat({_regulation_heading('', '(j - 1)')}, l)), chr(10)) as text from documents)"""


def regulation(spark, sf):
    heading = _regulation_heading("", "i").replace("//", "div")
    return texts(spark, sf).selectExpr(
        "doc_id", f"array_join(transform(split(text, '\\n'), (l, i) -> concat({heading}, l)), '\\n') as text")


_HEAD = r"((?:GEÇİCİ|GEÇICI|GECICI|EK)\s+)?MADDE[ \t\r\n]*(\d{1,3}(?:\s*/\s*[A-ZÇĞİÖŞÜ])?)[ \t\r\n]*(?:[-–—]|\()"
_PIECES = f"""with norm as (select doc_id, {o.normalize('text')} as t from {_REG_DUCK} r),
 pieces as (select doc_id, t, unnest(string_split({o.sub('t', '(?im)^(' + _HEAD + ')', chr(1) + r'\1')}, chr(1))) as piece,
 generate_subscripts(string_split({o.sub('t', '(?im)^(' + _HEAD + ')', chr(1) + r'\1')}, chr(1)), 1) as i from norm),
 heads as (select doc_id, t, i, piece, upper(trim(regexp_extract(piece, {o.lit('(?i)^' + _HEAD)}, 1))) as prefix,
 replace(regexp_extract(piece, {o.lit('(?i)^' + _HEAD)}, 2), ' ', '') as no from pieces where not (i = 1 and piece = '')),
 numbered as (select *, try_cast(regexp_extract(no, '^(\\d+)') as double) + case when no like '%/%' then 0.5 else 0 end as ord from heads),
 judged as (select *, ord is not null and ord > coalesce(max(ord) over (partition by doc_id, prefix order by i
 rows between unbounded preceding and 1 preceding), 0) as ok,
 coalesce(sum(length(piece)) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as pos from numbered),
 grouped as (select *, sum(case when ok then 1 else 0 end) over (partition by doc_id order by i) as sec from judged),
 sections as (select doc_id, any_value(t) as t, cast(sec as int) - 1 as section_no, arg_min(no, i) as no, arg_min(prefix, i) as prefix,
 cast(min(pos) as int) as pos, string_agg(piece, '' order by i) as body from grouped group by doc_id, sec)"""


@query(f"{_PIECES} select doc_id, section_no, no, prefix, pos, body from sections where section_no >= 0")
def article_split(spark, sf):
    return chunking.article_split(regulation(spark, sf))


@query(f"{_PIECES} select doc_id, max(section_no) + 1 >= 3 as is_regulation from sections group by doc_id")
def is_regulation(spark, sf):
    return chunking.is_regulation(regulation(spark, sf)).select("doc_id", "is_regulation")


_TITLES = f"""{_PIECES}, windows as (select *, list_filter(list_transform(string_split(
 substr(t, greatest(pos - 200, 0) + 1, pos - greatest(pos - 200, 0)), chr(10)), lambda s: {o.strip('s')}), lambda s: s <> '') as ls
 from sections where section_no >= 0),
 joined as (select *, case when len(ls) = 0 then '' when len(ls) >= 2 and regexp_matches(ls[-1], '^\\p{{Ll}}')
 then concat(ls[-2], ' ', ls[-1]) else ls[-1] end as line from windows),
 tails as (select *, string_split({o.sub('line', r'[.!?]\s+', chr(1))}, chr(1))[-1] as tail from joined),
 picked as (select *, {o.sub("case when " + o.strip('tail') + " <> '' then tail else line end", r'^[ \-–—:;,]+|[ \-–—:;,]+$', '')} as raw from tails),
 titled as (select *, case when length(raw) between 1 and 90 then raw else '' end as title from picked)"""


@query(f"{_TITLES} select doc_id, section_no, title from titled")
def article_title(spark, sf):
    rows = chunking.article_sections(regulation(spark, sf)).select("doc_id", "norm", F.posexplode("sections").alias("section_no", "s"))
    begin = F.greatest(F.col("s.pos") - 200, F.lit(0))
    before = F.substring("norm", begin + 1, F.col("s.pos") - begin)
    return rows.select("doc_id", "section_no", chunking.article_title(before).alias("title"))


@query("""select p.event_id, p.user_id, coalesce(v.event_id, -1) as last_view from
 (select event_id, case when event_id % 17 <> 0 then user_id end as user_id, case when event_id % 19 <> 0 then ts end as ts
  from events where event_type = 'purchase') p asof left join (select * from events where event_type = 'view') v
 on p.user_id = v.user_id and p.ts > v.ts""")
def chapter_asof(spark, sf):
    """The as-of lookup on events: the latest view before each purchase of a user; some purchases lack user or time."""
    ev = table(spark, sf, "events")
    views = ev.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"))
    buys = ev.where("event_type = 'purchase'").select(
        "event_id", F.when(F.col("event_id") % 17 != 0, F.col("user_id")).alias("user_id"), F.when(F.col("event_id") % 19 != 0, F.col("ts")).alias("ts"))
    out = asof_join(buys, views, ["user_id"], "ts", "ts", "view_id", "last_view", lambda c: F.date_trunc("day", c))
    return out.select("event_id", "user_id", F.coalesce("last_view", F.lit(-1)).alias("last_view"))


@query(f"""select doc_id, cast(part as int) as part, case when length(text) <= 2500 then text else substr(text, part * 1800 + 1, 1800) end as body
 from (select doc_id, text, unnest(case when length(text) <= 2500 then [0] else range(0, cast(ceil(length(text) / 1800.0) as bigint)) end) as part
 from documents) x""")
def paragraph_pack(spark, sf):
    return texts(spark, sf).select(
        "doc_id", F.posexplode(chunking.paragraph_pack(F.col("text"))).alias("part", "body"))


@query(f"""{_TITLES}, noted as (select *, regexp_extract(body, '(?m)^([A-ZÇĞİÖŞÜ\\p{{L}}\\p{{N}}_]+)\\s+BÖLÜM[ \\t]*$', 1) as ch from sections),
 chapters as (select doc_id, section_no, case when ch <> '' then concat(ch, ' BÖLÜM — Genel hükümler') end as chapter from noted),
 placed as (select t.*, (select arg_max(c.chapter, c.section_no) from chapters c where c.doc_id = t.doc_id and c.section_no < t.section_no
 and c.chapter is not null) as bolum, {o.strip('body')} as b from titled t),
 parts as (select *, unnest(case when length(b) <= 2500 then [0] else range(0, cast(ceil(length(b) / 1800.0) as bigint)) end) as part,
 case when length(b) <= 2500 then 1 else cast(ceil(length(b) / 1800.0) as int) end as n from placed),
 texts as (select *, concat(case when title <> '' then concat(title, chr(10)) else '' end,
 case when part > 0 then concat(case when prefix <> '' then concat(prefix, ' ') else '' end, 'MADDE ', no, ' (devam ', part + 1, '/', n, ')', chr(10)) else '' end) as top,
 case when length(b) <= 2500 then b else substr(b, part * 1800 + 1, 1800) end as gov from parts),
 arts as (select doc_id, section_no, part, 'madde' as kind, no, prefix, title, coalesce(bolum, '') as bolum, n as part_count,
 case when top <> '' then {o.strip('concat(top, gov)')} else gov end as content from texts),
 pre as (select doc_id, -1 as section_no, 0 as part, 'preamble' as kind, '' as no, '' as prefix, '' as title, '' as bolum, 0 as part_count,
 {o.strip('body')} as content from sections s where section_no = -1 and length({o.strip('body')}) > 40
 and exists (select 1 from sections z where z.doc_id = s.doc_id and z.section_no >= 0))
 select doc_id, cast(row_number() over (partition by doc_id order by section_no, part) - 1 as int) as chunk_index, kind, no as madde_no,
 prefix as madde_prefix, title as baslik, bolum, cast(part as int) as part, part_count, content from (select * from arts union all select * from pre) u""")
def chunk_articles(spark, sf):
    out = chunking.chunk_articles(regulation(spark, sf))

    def text(name):
        return F.coalesce(F.col(f"meta.{name}"), F.lit("")).alias(name)

    def number(name):
        return F.coalesce(F.col(f"meta.{name}"), F.lit(0)).alias(name)

    return out.select("doc_id", "chunk_index", "meta.kind", text("madde_no"), text("madde_prefix"), text("baslik"),
                      text("bolum"), number("part"), number("part_count"), "content")


@query(_windows(500, 50))
def chunk_words(spark, sf):
    return chunking.chunk_words(texts(spark, sf))


@query()
def chunk_chars(spark, sf):
    """Character-budget chunks: recursive splitting has no SQL form."""
    return chunking.chunk_chars(texts(spark, sf))


@query("""select min(doc_id) as doc_id, text from documents where doc_id % 31 <> 0 group by text
 union all select doc_id, null from documents where doc_id % 31 = 0""")
def dedupe_documents(spark, sf):
    """Some documents have no text; they stay."""
    docs = texts(spark, sf).select("doc_id", F.when(F.col("doc_id") % 31 != 0, F.col("text")).alias("text"))
    return corpus.dedupe_documents(docs)


@query("select sha256(text) as sha256, min(doc_id) as keep_id, count(*) as copies from documents group by text having count(*) > 1")
def duplicate_report(spark, sf):
    return corpus.duplicate_report(texts(spark, sf))


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity from lineitem qualify row_number() over (
 partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) = 1""")
def dedupe_chunks(spark, sf):
    cols = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
    rows = corpus.dedupe_rows(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], [F.col(c) for c in cols])
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@query("""select min(doc_id) as doc_id, sha256(text) as sha256 from documents d where lang <> 'en'
 and not exists (select 1 from documents s where s.lang = 'en' and s.text = d.text) group by text""")
def incremental_import(spark, sf):
    docs = texts(spark, sf)
    return corpus.incremental_import(docs.where("lang <> 'en'"), docs.where("lang = 'en'"))


@query("""select cast(count(*) filter (where not held) as bigint) as added,
 cast(sum(case when held then n else n - 1 end) as bigint) as skipped from (select text, count(*) as n,
 exists (select 1 from documents s where s.lang = 'en' and s.text = d.text) as held from documents d group by text) x""")
def import_counts(spark, sf):
    docs = texts(spark, sf)
    return corpus.import_counts(docs, docs.where("lang = 'en'"))


_LANES = ", ".join(f"sum(cast(('0x' || substr(h, {1 + 12 * i}, 12)) as bigint))::hugeint as l{i}" for i in range(4))


@query(f"""select n as documents, sha256(concat_ws(':', n, l0, l1, l2, l3, 'chunk_overlap=50;chunk_size=500;chunker=3;dimensions=64')) as stamp
 from (select count(*) as n, {_LANES} from (select sha256(concat(doc_id, ':', text)) as h from documents) x) y""")
def corpus_stamp(spark, sf):
    return corpus.corpus_stamp(texts(spark, sf),
                               {"chunk_size": 500, "chunk_overlap": 50, "dimensions": 64, "chunker": 3})


_TAGS = """select event_id, case event_type when 'view' then concat('["k', cast(user_id as string), '","b"]') when 'click' then props
 when 'purchase' then concat('[', cast(user_id as string), ',"a"]') when 'signup' then case when value > 20 then '' else '[]' end
 else concat('["broken', cast(user_id as string)) end as raw, event_type from {events}"""


@query(f"""select event_id, event_type in ('view', 'signup') as ok,
 case event_type when 'view' then array_to_string(from_json(raw, '["VARCHAR"]'), ',') else '' end as tags from {duck(_TAGS)}""")
def validate_tags(spark, sf):
    return frame(spark, sf, _TAGS).select("event_id", corpus.validate_tags(F.col("raw")).alias("t")).select(
        "event_id", "t.ok", F.coalesce(F.array_join("t.tags", ","), F.lit("")).alias("tags"))


@query(f"""select concat(c.doc_id, '-', c.chunk_index) as chunk_id, c.doc_id, c.chunk_index, d.source as tags,
 cast(len({o.words('c.content')}) as int) as word_count from ({_windows(500, 50)}) c join documents d using (doc_id)""")
def chunk_rows(spark, sf):
    docs = texts(spark, sf).withColumn("tags", F.array("source"))
    rows = chunking.chunk_rows(chunking.chunk_words(docs), docs)
    return rows.select("chunk_id", "doc_id", "chunk_index", F.array_join("tags", ",").alias("tags"), "word_count")


_BLANKED = """select doc_id, case when source in ('src3', 'src4') then concat('  ', chr(10)) else text end as text, source, lang from {documents}"""


@query(f"""select doc_id, case when error = '' then 'INDEXED' else 'FAILED' end as status, case when error = '' then n else 0 end as chunk_count,
 case when error = '' then '2024-01-30 00:00:00' else '' end as indexed_at, error as processing_error from (
 select d.doc_id, case when {o.strip('d.text')} = '' then 'no text in file' when c.n is null then 'no chunks' else '' end as error,
 coalesce(c.n, 0) as n from {duck(_BLANKED)} d left join
 (select doc_id, count(*) as n from ({_windows(500, 50)}) w where doc_id in (select doc_id from documents where lang <> 'es') group by doc_id) c using (doc_id)) x""")
def index_status(spark, sf):
    docs = frame(spark, sf, _BLANKED)
    chunks = chunking.chunk_words(docs.where("lang <> 'es'"))
    out = corpus.index_status(docs, chunks, F.lit(derive.NOW_EVENTS).cast("timestamp"))
    return out.select("doc_id", "status", "chunk_count",
                      F.coalesce(F.date_format("indexed_at", "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias("indexed_at"),
                      F.coalesce("processing_error", F.lit("")).alias("processing_error"))


@query(f"""select doc_id, coalesce(b.n, 0) as n_before, coalesce(a.n, 0) as n_after, coalesce(b.c, 0) as chars_before, coalesce(a.c, 0) as chars_after,
 round(case when a.n > 0 then a.c / a.n else 0.0 end, 6) as mean_after from
 (select doc_id, count(*) as n, cast(sum(length(content)) as bigint) as c from ({_windows(500, 50, "lang <> 'fr'")}) x group by doc_id) b full join
 (select doc_id, count(*) as n, cast(sum(length(content)) as bigint) as c from ({_windows(200, 20, "lang <> 'de'")}) x group by doc_id) a using (doc_id)""")
def chunk_stats(spark, sf):
    docs = texts(spark, sf)
    return corpus.chunk_stats(chunking.chunk_words(docs.where("lang <> 'fr'")),
                              chunking.chunk_words(docs.where("lang <> 'de'"), size=200, overlap=20))


@query(f"""select 'document' as kind, doc_id, case when toxic = 1 then 'DELETED' else status end as state,
 coalesce({o.stamp("case when toxic = 1 then timestamp '2024-01-30 00:00:00' else deleted_at end")}, '') as deleted_at from {duck(derive.DOCS)} d left join labels using (doc_id)
 union all select 'chunk', doc_id, cast(chunk_index as string), '' from ({_windows(500, 50)}) w
 where doc_id not in (select doc_id from labels where toxic = 1)""")
def delete_document(spark, sf):
    docs = frame(spark, sf, derive.DOCS)
    doomed = table(spark, sf, "labels").where("toxic = 1").select("doc_id")
    after, chunks = corpus.delete_documents(docs, chunking.chunk_words(docs), doomed, F.lit(derive.NOW_EVENTS).cast("timestamp"))
    return after.select(
        F.lit("document").alias("kind"), "doc_id", F.col("status").alias("state"),
        F.coalesce(F.date_format("deleted_at", "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias("deleted_at"),
    ).unionByName(chunks.select(F.lit("chunk").alias("kind"), "doc_id", F.col("chunk_index").cast("string").alias("state"),
                                F.lit("").alias("deleted_at")))


@query(f"""select doc_id, status from {duck(derive.DOCS)} where deleted_at is null and status in ('INDEXED', 'PENDING', 'PROCESSING', 'FAILED')
 and mime_type <> 'text/plain'""")
def reindex_candidates(spark, sf):
    return corpus.reindex_candidates(frame(spark, sf, derive.DOCS), binary_only=True).select("doc_id", "status")
