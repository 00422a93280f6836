"""Registered queries: vector and lexical search, fusion, selection, context."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from corpusdesk.operators import fusion, lexical, vectors
from corpusdesk.operators.corpus import tags_or_empty
from corpusdesk.params import SEARCH
from corpusdesk.plans import oracle as o, search as plan
from corpusdesk.sources.workdir import settle
from corpusdesk.plans.registry import duck, frame, index, query, table, texts

P = replace(SEARCH, dim=64)
KEYS = ["query_id", "sub_no"]

# Benchmark passages are the questions, the first turn of a conversation is the
# subject.  Reversed embeddings serve as question vectors; subjects have none.
# Further questions that hold only signs, one per intent under ids of their own
# (below zero), have no lexical match and so meet the gate.
_QUERIES = """(select b.item_id as query_id, b.text as text, c.text as subject, concat('src', cast(b.item_id % 20 as string)) as intent
 from {benchmark} b left join (select conv_id, text from {conversations} where turn = 0 and role = 'user') c on c.conv_id = b.item_id
 union all select -1 - min(item_id), '%%% ###', null, concat('src', cast(item_id % 20 as string)) from {benchmark} group by item_id % 20)"""
_VECTORS = """(select vec_id as query_id, 0 as sub_no, reverse(embedding) as vec from {embeddings}
 union all select -1 - vec_id, 0, reverse(embedding) from {embeddings})"""


def corpus(spark, sf) -> plan.Corpus:
    docs, emb = texts(spark, sf), table(spark, sf, "embeddings")
    chunks = docs.join(emb, docs.doc_id == emb.vec_id, "left").select(
        F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"), F.col("doc_id").alias("chunk_index"),
        F.col("text").alias("content"), F.array("source").alias("tags"), F.col("embedding").alias("vec"))
    labels = docs.groupBy(F.col("source").alias("document_id")).agg(
        F.lit("").alias("description"), F.concat(F.first("source"), F.lit(".pdf")).alias("filename"))
    return plan.Corpus(chunks, labels, postings=index(spark, sf, lambda: lexical.build_postings(chunks)), placed=True)


def queries(spark, sf, subjects: bool = True):
    q = frame(spark, sf, f"select * from {_QUERIES} q")
    q = q if subjects else q.withColumn("subject", F.lit(None).cast("string"))
    subs = fusion.expand_queries(q)
    return subs.join(frame(spark, sf, f"select * from {_VECTORS} v"), KEYS, "left").select("query_id", "sub_no", "text", "intent", "vec")


def search_sql(subjects: bool = True, use_vectors: bool = True, use_words: bool = True, k: int = 7, bonus: bool = True) -> str:
    """The whole search as common table expressions, ending in ``hits``."""
    q = duck(_QUERIES)
    second = f" union all select query_id, 1, trim(subject), intent from {q} s where trim(coalesce(subject, '')) <> '' and not contains(text, trim(subject))" if subjects else ""
    legs = []
    if use_vectors:
        legs.append("select query_id, sub_no, 'vec' as leg, chunk_id, rank, distance as raw from vecr")
    if use_words:
        legs.append("select query_id, sub_no, 'lex' as leg, chunk_id, rank, score as raw from lexr")
    return f"""with subs as (select query_id, 0 as sub_no, text, intent from {q} b where trim(text) <> ''{second}),
 q as (select subs.*, list_reverse(embedding)::double[] as vec from subs left join embeddings on vec_id = case when query_id < 0 then -1 - query_id else query_id end and sub_no = 0),
 intents as (select query_id, max(intent) as intent from q group by query_id),
 chunks as (select doc_id as chunk_id, source as document_id, doc_id as chunk_index, text as content, embedding::double[] as vec
  from documents left join embeddings on vec_id = doc_id),
 toks as (select chunk_id, {o.tokens('content')} as ts from chunks),
 words as (select chunk_id, len(ts) as n, unnest(ts) as lexeme from toks),
 post as (select chunk_id, lexeme, any_value(n) as len, count(*) as tf from words group by all),
 qts as (select query_id, sub_no, list_distinct({o.tokens('text')}) as ts from q),
 qlex as (select query_id, sub_no, len(ts) as n, unnest(ts) as lexeme from qts),
 lexs as (select query_id, sub_no, chunk_id, round(sum(0.1 / 1.64493406685 * list_sum(list_transform(range(1, tf + 1), lambda i: 1.0::double / (i * i)))
  / (1 + ln(len)) / qlex.n), 9) as score from post join qlex using (lexeme) group by all),
 lexr as (select *, row_number() over (partition by query_id, sub_no order by score desc, chunk_id) as rank from lexs qualify rank <= 50),
 vecs as (select query_id, sub_no, chunk_id, round(1 - list_cosine_similarity(q.vec, c.vec), 9) as distance from q, chunks c
  where q.vec is not null and c.vec is not null),
 vecr as (select *, row_number() over (partition by query_id, sub_no order by distance, chunk_id) as rank from vecs qualify rank <= 50),
 legs as ({' union all '.join(legs) or 'select 1 as query_id where false'}),
 fused as (select query_id, chunk_id, round(sum(1.0::double / (60 + rank)), 9) as score from legs group by all),
 stats as (select query_id, bool_or(vec is not null) as vector_ran,
  (select min(raw) from legs l where l.query_id = q.query_id and leg = 'vec') as nearest,
  (select count(*) from legs l where l.query_id = q.query_id and leg = 'lex') as lexical_hits from q group by query_id),
 gated as (select * from fused where query_id not in (select query_id from stats
  where vector_ran and (nearest is null or nearest > 0.6) and lexical_hits = 0)),
 boosted as (select g.query_id, g.chunk_id, document_id, chunk_index, round(score + case when intent = document_id
  then {0.003 if bonus else 0.0} else 0 end, 9) as score from gated g join chunks using (chunk_id) left join intents using (query_id)),
 capped as (select *, row_number() over (partition by query_id, document_id order by score desc, chunk_id) as in_doc from boosted),
 hits as (select query_id, chunk_id, document_id, chunk_index, score, row_number() over (partition by query_id
  order by in_doc > 3, score desc, chunk_id) as rank from capped qualify rank <= {k})"""


@query("""select vec_id, case when vec is null then 'vector missing' when len(vec) <> 64 then 'wrong dimension' else '' end as reason
 from (select vec_id, case when label = 3 then null when label = 5 then list_slice(embedding, 1, 10) else embedding end as vec from embeddings) x""")
def check_embeddings(spark, sf):
    """Missing and short vectors; the tests have the other reasons."""
    rows = table(spark, sf, "embeddings").withColumn(
        "vec", F.when(F.col("label") == 5, F.slice("embedding", 1, 10)).when(F.col("label") != 3, F.col("embedding")))
    good, bad = vectors.check_embeddings(rows, 64)
    return good.select("vec_id", F.lit("").alias("reason")).unionByName(bad.select("vec_id", "reason"))


def _question_vectors(spark, sf):
    """All embeddings, reversed, are questions."""
    return frame(spark, sf, "select vec_id as query_id, 0 as sub_no, reverse(embedding) as vec from {embeddings}")


_VEC_SQL = """select query_id, sub_no, chunk_id, round(distance, 6) as distance, rank from (select *, row_number() over (
 partition by query_id order by distance, chunk_id) as rank from (select q.vec_id as query_id, 0 as sub_no, c.vec_id as chunk_id,
 round(1 - list_cosine_similarity(list_reverse(q.embedding)::double[], c.embedding::double[]), 9) as distance
 from embeddings q, embeddings c) x qualify rank <= 50) y"""


def _vector_chunks(spark, sf):
    """All embeddings and, under ids below zero, vectors that cannot be compared: null, short, zero, not finite."""
    good = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"))
    zeros = F.transform("vec", lambda x: F.lit(0).cast("float"))
    bad = (F.when(F.col("chunk_id") % 4 == 0, F.slice("vec", 1, 10)).when(F.col("chunk_id") % 4 == 1, zeros)
           .when(F.col("chunk_id") % 4 == 2, F.transform("vec", lambda x: F.lit("NaN").cast("float"))))
    return good.unionByName(good.select((-1 - F.col("chunk_id")).alias("chunk_id"), bad.alias("vec")))


@query(_VEC_SQL)
def vector_topk(spark, sf):
    out = vectors.vector_topk(_question_vectors(spark, sf), _vector_chunks(spark, sf), KEYS, 64)
    return out.withColumn("distance", F.round("distance", 6))


@query(_VEC_SQL)
def vector_topk_cells(spark, sf):
    """The exact search for question sets beyond the broadcast limit."""
    out = vectors.vector_topk(_question_vectors(spark, sf), _vector_chunks(spark, sf), KEYS, 64, max_broadcast_bytes=0)
    return out.withColumn("distance", F.round("distance", 6))


@query("""with good as (select vec_id as chunk_id, embedding::double[] as v from embeddings),
 pivots as (select row_number() over (order by md5(cast(chunk_id as varchar)), chunk_id) - 1 as cell, v from good
  qualify cell < least(64, cast(floor(sqrt((select count(*) from good))) as int) + 1)),
 cells as (select g.chunk_id, g.v, p.cell from good g, pivots p qualify row_number() over (
  partition by g.chunk_id order by list_cosine_similarity(g.v, p.v) desc, p.cell) = 1),
 asked as (select vec_id as query_id, list_reverse(embedding)::double[] as v from embeddings),
 visits as (select a.query_id, a.v, p.cell from asked a, pivots p where p.cell in (select cell from cells)
  qualify row_number() over (partition by a.query_id order by list_cosine_similarity(a.v, p.v) desc, p.cell) <= 40),
 found as (select query_id, chunk_id, round(1 - list_cosine_similarity(visits.v, cells.v), 9) as distance from visits join cells using (cell))
 select query_id, 0 as sub_no, chunk_id, round(distance, 6) as distance, row_number() over (partition by query_id order by found.distance, chunk_id) as rank
 from found qualify rank <= 50""")
def vector_topk_ann(spark, sf):
    """Approximate neighbours: the steps in SQL; a test compares them with the exact ones."""
    out = vectors.vector_topk_ann(_question_vectors(spark, sf), _vector_chunks(spark, sf), KEYS, 64)
    return out.withColumn("distance", F.round("distance", 6))


@query(f"select doc_id, array_to_string({o.tokens('text')}, ' ') as lexemes from documents")
def tokenize(spark, sf):
    from corpusdesk.functions.text import tokenize as tokens

    return texts(spark, sf).select("doc_id", F.array_join(tokens(F.col("text")), " ").alias("lexemes"))


_POST = f"""with words as (select doc_id as chunk_id, len(ts) as len, unnest(ts) as lexeme from (select doc_id, {o.tokens('text')} as ts from documents) t),
 post as (select lexeme, chunk_id, count(*) as tf, any_value(len) as len from words group by lexeme, chunk_id)"""


@query(f"{_POST} select * from post")
def build_postings(spark, sf):
    return lexical.build_postings(corpus(spark, sf).chunks)


@query(f"{_POST} select lexeme, count(*) as df, cast(sum(tf) as bigint) as occurrences from post group by lexeme")
def document_frequencies(spark, sf):
    return lexical.document_frequencies(lexical.build_postings(corpus(spark, sf).chunks))


@query(f"""{_POST}, q as (select unnest(list_distinct({o.tokens('text')})) as lexeme from benchmark)
 select distinct chunk_id from q join post using (lexeme)""")
def lexical_match(spark, sf):
    """Chunks that any question matches; the shared words of each pair are an option."""
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return lexical.matching_chunks(q, corpus(spark, sf).postings)


@query(f"{search_sql()} select query_id, sub_no, chunk_id, score, rank from lexr")
def lexical_topk(spark, sf):
    q, c = queries(spark, sf), corpus(spark, sf)
    return lexical.lexical_topk(q, c.postings, KEYS, placed=c.placed)


@query(f"{search_sql()} select query_id, sub_no, chunk_id, score, rank from lexr")
def lexical_topk_salted(spark, sf):
    """The same for question sets beyond the broadcast limit."""
    q, c = queries(spark, sf), corpus(spark, sf)
    return lexical.lexical_topk(q, c.postings, KEYS, max_broadcast=0)


def _legs(spark, sf):
    q, c = settle(queries(spark, sf), "queries"), corpus(spark, sf)
    return q, c, settle(plan.candidates(q, c, P), "legs")


@query(f"{search_sql()} select * from fused")
def rrf_fuse(spark, sf):
    """Reciprocal ranks over all lists of all sub-queries of a question, its subject's as well."""
    return fusion.rrf_fuse(_legs(spark, sf)[2])


_HITS = "select query_id, chunk_id, document_id, chunk_index, score, rank from hits"


@query(f"{search_sql()} select * from fused")
def multi_query_search(spark, sf):
    """Body and subject as separate searches, fused once."""
    return fusion.rrf_fuse(_legs(spark, sf)[2])


@query(f"{search_sql()} select query_id, vector_ran, round(coalesce(nearest, -1), 6) as nearest, lexical_hits, query_id not in (select query_id from gated) as dropped from stats")
def scope_gate(spark, sf):
    q, _, legs = _legs(spark, sf)
    stats = fusion.query_stats(q, legs)
    kept = fusion.scope_gate(fusion.rrf_fuse(legs), stats, P.max_distance).select("query_id").distinct().withColumn("kept", F.lit(True))
    return stats.join(kept, "query_id", "left").select(
        "query_id", "vector_ran", F.round(F.coalesce("nearest", F.lit(-1.0)), 6).alias("nearest"), "lexical_hits",
        F.col("kept").isNull().alias("dropped"))


@query(f"""select 'words' as mode, * from ({search_sql(use_vectors=False)} {_HITS}) a union all
 select 'vectors', * from ({search_sql(use_words=False)} {_HITS}) b""")
def degrade_legs(spark, sf):
    """Search with one of the two lists missing; with both missing there are no hits."""
    q, c = queries(spark, sf), corpus(spark, sf)
    none = plan.search(q, c, P, use_vectors=False, use_words=False)
    words = plan.search(q.withColumn("vec", F.lit(None).cast("array<float>")), c, P, use_vectors=False)
    vecs = plan.search(q, c, P, use_words=False)
    cols = ["query_id", "chunk_id", "document_id", "chunk_index", "score", "rank"]
    return (words.select(F.lit("words").alias("mode"), *cols)
            .unionByName(vecs.select(F.lit("vectors").alias("mode"), *cols))
            .unionByName(none.select(F.lit("none").alias("mode"), *cols)))


@query(f"{search_sql()} select query_id, chunk_id, score from boosted")
def tag_bonus(spark, sf):
    q, c, legs = _legs(spark, sf)
    tags = texts(spark, sf).select(
        F.col("doc_id").alias("chunk_id"),
        tags_or_empty(F.concat(F.lit('["'), F.col("source"), F.lit('"]'))).alias("tags"))
    gated = fusion.scope_gate(fusion.rrf_fuse(legs), fusion.query_stats(q, legs), P.max_distance)
    return fusion.tag_bonus(gated, q.select("query_id", "intent").distinct(), tags).select("query_id", "chunk_id", "score")


@query(f"""{search_sql()}, ordered as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as old_rank from boosted),
 scored as (select r.*, case when old_rank <= 20 and query_id in (select query_id from subs where sub_no = 1) then n_chars end as new_score from ordered r join documents on doc_id = chunk_id)
 select query_id, chunk_id, row_number() over (partition by query_id order by old_rank <= 20 desc, new_score desc nulls last, old_rank) as position,
 round(coalesce(new_score, score), 6) as score from scored""")
def rerank_topn(spark, sf):
    """Outside scores (here text lengths) exist for questions with a subject only."""
    q, c, legs = _legs(spark, sf)
    gated = fusion.scope_gate(fusion.rrf_fuse(legs), fusion.query_stats(q, legs), P.max_distance)
    base = fusion.tag_bonus(gated, q.select("query_id", "intent").distinct(), c.chunks.select("chunk_id", "tags"))
    docs = texts(spark, sf).select(F.col("doc_id").alias("chunk_id"), F.col("n_chars").cast("double").alias("chars"))
    subject = q.where("sub_no = 1").select("query_id").distinct()
    scores = base.join(subject, "query_id", "left_semi").join(docs, "chunk_id").select("query_id", "chunk_id", F.col("chars").alias("score"))
    return fusion.rerank_topn(base, scores).select("query_id", "chunk_id", "position", F.round("score", 6).alias("score"))


@query("""select query_id, chunk_id, document_id, rank from (select *, row_number() over (partition by query_id order by in_doc > 3, distance, chunk_id) as rank
 from (select *, row_number() over (partition by query_id, document_id order by distance, chunk_id) as in_doc from (
 select q.vec_id as query_id, c.vec_id as chunk_id, c.label as document_id,
 round(1 - list_cosine_similarity(list_reverse(q.embedding)::double[], c.embedding::double[]), 9) as distance
 from embeddings q, embeddings c) x
 qualify row_number() over (partition by query_id order by distance, chunk_id) <= 50) y qualify rank <= 7) z""")
def diversify(spark, sf):
    found = vectors.vector_topk(_question_vectors(spark, sf), _vector_chunks(spark, sf), KEYS, 64)
    labels = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("document_id"))
    return fusion.diversify(found.drop("rank").join(labels, "chunk_id"), order=[F.asc("distance"), F.asc("chunk_id")]).select(
        "query_id", "chunk_id", "document_id", "rank")


@query(f"{search_sql()} select query_id, hits.chunk_id, hits.document_id, rank, content, concat(hits.document_id, '.pdf') as label from hits join chunks using (chunk_id)")
def hydrate_hits(spark, sf):
    c = corpus(spark, sf)
    hits = plan.search(queries(spark, sf), c, P)
    return fusion.hydrate_hits(hits, c.chunks, c.documents).select("query_id", "chunk_id", "document_id", "rank", "content", "label")


_PLACED = f"""{search_sql()}, best as (select *, max(score) over (partition by query_id, document_id) as top from hits),
 placed as (select *, row_number() over (partition by query_id order by top desc, document_id, chunk_index, chunk_id) as place from best)"""


@query(f"{_PLACED} select query_id, chunk_id, document_id, rank, place from placed")
def document_order(spark, sf):
    hits = plan.search(queries(spark, sf), corpus(spark, sf), P)
    return fusion.document_order(hits).select("query_id", "chunk_id", "document_id", "rank", "place")


@query(f"""{_PLACED.replace('with subs as', 'with recursive subs as', 1)}, parts as (select query_id, place, content, concat(p.document_id, '.pdf') as label from placed p join chunks using (chunk_id)),
 fold(query_id, place, used, n, context) as (select distinct query_id, cast(0 as bigint), cast(0 as bigint), 0, '' from parts union all
 select f.query_id, f.place + 1,
 case when f.n = 0 or f.used + length(content) + length(label) + 20 <= 6000 then f.used + length(content) + length(label) + 20 else f.used end,
 case when f.n = 0 or f.used + length(content) + length(label) + 20 <= 6000 then f.n + 1 else f.n end,
 case when f.n = 0 or f.used + length(content) + length(label) + 20 <= 6000 then concat(f.context, case when f.n > 0 then concat(chr(10), chr(10), '---', chr(10), chr(10)) else '' end,
 '[Kaynak ', f.n + 1, ' — ', label, ']', chr(10), content) else f.context end from fold f join parts p on p.query_id = f.query_id and p.place = f.place + 1)
 select query_id, arg_max(context, place) as context, arg_max(n, place) as n_sources from fold group by query_id""")
def build_context(spark, sf):
    return plan.contexts(queries(spark, sf), corpus(spark, sf), P, max_chars=6000)


@query(f"{search_sql()} {_HITS}")
def search(spark, sf):
    return plan.search(queries(spark, sf), corpus(spark, sf), P)
