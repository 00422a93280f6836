"""Registered queries: sources, sinks, stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusdesk.functions.text import decode_text, normalize_text, sniff_type
from corpusdesk.operators import chunking, corpus
from corpusdesk.params import MAX_UPLOAD_MB
from corpusdesk.plans import derive, oracle as o
from corpusdesk.plans.registry import duck, frame, query, table, texts
from corpusdesk.sources import files, tables
from corpusdesk.sources.workdir import discard, new_path, settle


@query("""select concat('doc ', doc_id) as title, case when lang = 'en' then source else '' end as tags, text as content
 from documents where source <> 'src3' union all select 'rejected', '', '{"title": "src3' from documents where source = 'src3'""")
def read_jsonl_kb(spark, sf):
    path = new_path(spark, "kb")
    entry = F.to_json(F.struct(
        F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("title"),
        F.when(F.col("lang") == "en", F.array("source")).alias("tags"), F.col("text").alias("content")))
    # documents of one source are cut short and so are broken lines
    texts(spark, sf).select(F.when(F.col("source") == "src3", F.concat(F.lit('{"title": "'), "source")).otherwise(entry)).write.text(path)
    good, rejected = files.read_kb(spark, path)
    return good.select("title", F.array_join("tags", ",").alias("tags"), "content").unionByName(
        rejected.select(F.lit("rejected").alias("title"), F.lit("").alias("tags"), F.col("line").alias("content")))


@query("select doc_id, length(text) as chars, md5(text) as digest, true as has_name from documents")
def read_files(spark, sf):
    """Files far below the upload limit, written from all documents; one document above the limit would be rejected."""
    path = new_path(spark, "files")
    files.write_json_parts(texts(spark, sf).select("doc_id", "text"), path, "doc_id", MAX_UPLOAD_MB * 1024 * 1024 // 4)
    accepted, _ = files.read_files(spark, path + "/*/*/*.json")
    rows = accepted.select("name", F.explode(F.split(decode_text(F.col("content")), "\n")).alias("line")).where("line <> ''")
    parsed = rows.select("name", F.from_json("line", "doc_id bigint, text string").alias("r"))
    return parsed.select("r.doc_id", F.length("r.text").alias("chars"), F.md5("r.text").alias("digest"),
                         F.endswith("name", F.lit(".json")).alias("has_name"))


@query("""select doc_id, case when strlen(body) = 0 then 'empty file' when strlen(body) > 2048 then 'file too large' else '' end as reason
 from (select doc_id, case when source = 'src1' then '' else text end as body from documents) d""")
def split_uploads(spark, sf):
    """Uploads that are empty or above the limit, here 2 KB, go to the reject frame."""
    body = F.when(F.col("source") == "src1", F.lit("")).otherwise(F.col("text"))
    uploads = texts(spark, sf).select("doc_id", body.alias("content")).withColumn("length", F.octet_length("content"))
    good, rejected = files.split_by_size(uploads, max_mb=2 / 1024)
    return good.select("doc_id", F.lit("").alias("reason")).unionByName(rejected.select("doc_id", F.col("reject_reason").alias("reason")))


@query(f"select doc_id, lang, source from {duck(derive.DOCS)} where deleted_at is null and status = 'INDEXED'")
def visible_docs(spark, sf):
    return corpus.visible(frame(spark, sf, derive.DOCS)).select("doc_id", "lang", "source")


def _windows(size: int, overlap: int, where: str = "true") -> str:
    step = size - overlap
    return f"""select doc_id, cast(i as int) as chunk_index, array_to_string(w[i * {step} + 1 : i * {step} + {size}], ' ') as content
 from (select doc_id, w, unnest(range(0, greatest(cast(ceil((len(w) - {overlap}) / {step}.0) as bigint), 1))) as i
 from (select doc_id, {o.words('text')} as w from documents where {where}) a where len(w) > 0) b"""


@query(_windows(500, 50, "lang in ('fr', 'es')") + " union all " + _windows(200, 20, "lang in ('en', 'de')"))
def replace_chunks(spark, sf):
    docs = texts(spark, sf)
    outcomes = docs.select("doc_id", F.when(F.col("lang").isin("fr", "es"), "embedding failed").alias("error"))
    return tables.replace_chunks(chunking.chunk_words(docs), chunking.chunk_words(docs, size=200, overlap=20), outcomes)


def _cut(rows: str, size: int, overlap: int) -> str:
    step = size - overlap
    return f"""select doc_id, cast(i as int) as chunk_index, array_to_string(w[i * {step} + 1 : i * {step} + {size}], ' ') as content
 from (select doc_id, w, unnest(range(0, greatest(cast(ceil((len(w) - {overlap}) / {step}.0) as bigint), 1))) as i
 from (select doc_id, {o.words('body')} as w from {rows} r) a where len(w) > 0) b"""


@query(f"""with uploads as (select doc_id, text as body, source = 'src5' as broken, {o.normalize('text')} as even from documents),
 good as (select min(doc_id) as doc_id, even as body from uploads where not broken group by even),
 others as (select doc_id, body from uploads where doc_id not in (select doc_id from good))
 {_cut('good', 200, 20)} union all {_cut('others', 500, 50)}""")
def index_documents(spark, sf):
    """Uploads to chunk table: sniff, decode, normalise, drop copies, chunk, replace.

    Documents whose upload is rejected or a copy keep the chunks they had.
    """
    path, docs = new_path(spark, "indexed"), texts(spark, sf)
    tables.write_chunks(chunking.chunk_words(docs), path, 8)
    body = F.when(F.col("source") == "src5", F.concat("text", F.lit("\x01"))).otherwise(F.col("text"))
    uploads = docs.select("doc_id", F.encode(body, "UTF-8").alias("content"), F.concat("source", F.lit(".txt")).alias("name"))
    checked = uploads.withColumn("reason", sniff_type(F.col("content"), F.col("name"), F.lit("text/plain"))["reject_reason"])
    # Four steps read what follows, and a filter on it would work it out again.
    sniffed = settle(checked.select("doc_id", "reason", F.when(
        F.col("reason").isNull(), normalize_text(decode_text(F.col("content")))).alias("text")), "uploads")
    even = sniffed.where("reason is null").select("doc_id", "text")
    fresh = corpus.dedupe_documents(even)
    kept = settle(fresh.select("doc_id", F.lit(True).alias("kept")), "kept")
    outcomes = settle(sniffed.select("doc_id", "reason").join(kept, "doc_id", "left").select(
        "doc_id", F.coalesce("reason", F.when(F.col("kept").isNull(), "copy")).alias("error")), "outcomes")
    new = chunking.chunk_words(fresh, size=200, overlap=20)
    tables.replace_chunks_in_table(spark, path, new, outcomes, 8)
    discard(sniffed)
    return tables.read_chunks(spark, path).select("doc_id", "chunk_index", "content")


_CONV_LOG = """select conv_id * 1000 + turn as draft_id, concat('  User', cast(conv_id as string), '@Example.org ') as recipient,
 role as subject, concat(text, ' ara +90 532 111 22 33') as body, timestamp '2024-01-30 00:00:00' as sent_at from {conversations}"""


@query(f"""select draft_id, sha256(lower(trim(recipient))) as recipient_hash, subject, {o.mask('body')} as body_masked,
 {o.stamp("sent_at + interval '180' day")} as expires from {duck(_CONV_LOG)}""")
def append_mail_log(spark, sf):
    path = new_path(spark, "log")
    tables.append_log(frame(spark, sf, _CONV_LOG), path)
    return spark.read.parquet(path).select(
        "draft_id", "recipient_hash", "subject", "body_masked",
        F.date_format("retention_expires_at", "yyyy-MM-dd HH:mm:ss").alias("expires"))


@query("""select d.doc_id, l.quality as expected, case when d.n_chars > 1000 then 1 else 0 end as got, d.text
 from documents d join labels l using (doc_id) where l.quality <> case when d.n_chars > 1000 then 1 else 0 end""")
def export_errors_jsonl(spark, sf):
    path = new_path(spark, "errors")
    joined = texts(spark, sf).join(table(spark, sf, "labels"), "doc_id").select(
        "doc_id", F.col("quality").alias("expected"), F.when(F.col("n_chars") > 1000, 1).otherwise(0).alias("got"), "text")
    files.export_jsonl(joined.where("expected <> got"), path)
    return spark.read.schema("doc_id bigint, expected int, got int, text string").json(path)


@query("""select 'labels' as suite, doc_id as question_id, cast(doc_id % 10 as int) as pos from labels where quality = 1""")
def baseline_store(spark, sf):
    """Store positions with the corpus fingerprint; read them back under the same one."""
    path = new_path(spark, "baseline")
    results = table(spark, sf, "labels").where("quality = 1").select(
        F.lit("labels").alias("suite"), F.col("doc_id").alias("question_id"), (F.col("doc_id") % 10).cast("int").alias("pos"))
    mark = corpus.corpus_stamp(texts(spark, sf), {"chunk_size": 500}).first()["stamp"]
    tables.write_baseline(results, F.lit(mark), path)
    return tables.read_baseline(spark, path, "labels", mark).select("suite", "question_id", "pos")
