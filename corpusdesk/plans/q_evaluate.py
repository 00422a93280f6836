"""Registered queries: retrieval metrics, classifier metrics, quality of drafts and replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusdesk.operators import evaluate as ev, vectors
from corpusdesk.plans import derive, oracle as o, search as plan
from corpusdesk.plans.q_search import KEYS, P, _question_vectors, _vector_chunks, corpus, queries, search_sql
from corpusdesk.plans.registry import duck, frame, query, table, texts
from corpusdesk.sources.workdir import settle

METHODS = ("lexical", "hybrid")


def _questions(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("passage"))


def _gold(spark, sf):
    return ev.containing_documents(_questions(spark, sf), texts(spark, sf).select("doc_id", "text"))


def _results(spark, sf):
    """(suite, method, question_id, pos) of both search methods on the benchmark passages."""
    q = settle(queries(spark, sf, subjects=False), "queries")
    c = corpus(spark, sf)
    gold = settle(_gold(spark, sf), "gold").withColumnRenamed("doc_id", "chunk_id").withColumn("match", F.lit(True))
    legs = settle(plan.candidates(q, c, P), "legs")
    words = legs.where((F.col("leg") == "lex") & (F.col("rank") <= P.top_k))
    hybrid = plan.rank_candidates(q, legs, c, P)
    out = None
    for name, hits in zip(METHODS, (words, hybrid)):
        judged = hits.select(F.col("query_id").alias("question_id"), "chunk_id", "rank").join(gold, ["question_id", "chunk_id"], "left")
        one = ev.first_hit_pos(_questions(spark, sf), judged, F.coalesce("match", F.lit(False))).select(
            F.lit("benchmark").alias("suite"), F.lit(name).alias("method"), "question_id", "pos")
        out = one if out is None else out.unionByName(one)
    return settle(out, "results")


_RESULTS = f"""{search_sql(subjects=False)}, gold as (select item_id as question_id, doc_id as chunk_id from benchmark b join documents d on contains(d.text, b.text)),
 found as (select 'lexical' as method, query_id, chunk_id, rank from lexr where rank <= 7 union all select 'hybrid', query_id, chunk_id, rank from hits),
 results as (select 'benchmark' as suite, m.method, b.item_id as question_id, (select min(rank) - 1 from found f join gold g on g.question_id = f.query_id
 and g.chunk_id = f.chunk_id where f.method = m.method and f.query_id = b.item_id) as pos from benchmark b, (values ('lexical'), ('hybrid')) m(method))"""


def _hit(k: int, pos: str = "pos") -> str:
    return f"(coalesce({pos}, 99) < {k})"


@query(f"{_RESULTS} select suite, method, question_id, coalesce(pos, -1) as pos from results")
def first_hit_pos(spark, sf):
    return _results(spark, sf).withColumn("pos", F.coalesce("pos", F.lit(-1)))


@query(f"""{search_sql()} select b.item_id as question_id, coalesce((select min(rank) - 1 from hits h where h.query_id = b.item_id
 and h.document_id = concat('src', b.item_id % 20)), -1) as pos from benchmark b""")
def first_tag_pos(spark, sf):
    """The same with a tag as the target: the first hit whose tags hold the question's intent."""
    q, c = settle(queries(spark, sf), "queries"), corpus(spark, sf)
    hits = plan.search(q, c, P).select(F.col("query_id").alias("question_id"), "chunk_id", "rank")
    intents = q.groupBy(F.col("query_id").alias("question_id")).agg(F.max("intent").alias("intent"))
    judged = hits.join(c.chunks.select("chunk_id", "tags"), "chunk_id").join(intents, "question_id")
    out = ev.first_hit_pos(_questions(spark, sf), judged, F.array_contains("tags", F.col("intent")))
    return out.withColumn("pos", F.coalesce("pos", F.lit(-1)))


_SHORT = """select item_id * 10 + n as question_id, array_join(slice(split(text, ' '), 3, n), ' ') as passage
 from {benchmark} lateral view explode(array(1, 2, 3, 5, 6)) t as n"""


@query("""select distinct question_id, doc_id from (select item_id * 10 + n as question_id, array_to_string(string_split(text, ' ')[3:2 + n], ' ') as passage
 from benchmark, (values (1), (2), (3), (5), (6)) t(n)) p join documents d on contains(d.text, p.passage) where trim(passage) <> ''""")
def containing_documents(spark, sf):
    """Passages of one to six words; the gold of the metrics has longer ones."""
    return ev.containing_documents(frame(spark, sf, _SHORT), texts(spark, sf).select("doc_id", "text"))


@query(f"""{_RESULTS} select suite, method, count(*) as n, """ + ", ".join(
    f"count(*) filter (where {_hit(k)}) as hits_{k}, round(avg(case when {_hit(k)} then 1.0 else 0 end), 4) as recall_{k}" for k in ev.KS)
    + " from results group by suite, method")
def recall_at_k(spark, sf):
    return ev.recall_at_k(_results(spark, sf), ["suite", "method"])


@query(f"{_RESULTS} select suite, method, round(avg(coalesce(1.0 / (pos + 1), 0)), 4) as mrr from results group by suite, method")
def mrr(spark, sf):
    return ev.mrr(_results(spark, sf), ["suite", "method"])


@query(f"{_RESULTS} select method, question_id from results where not {_hit(3)}")
def misses(spark, sf):
    return ev.misses(_results(spark, sf), 3).select("method", "question_id")


def _pair(spark, sf):
    r = _results(spark, sf)
    return r.where("method = 'lexical'"), r.where("method = 'hybrid'")


def _diff_sql(k: int) -> str:
    old, new = _hit(k, "a.pos"), _hit(k, "b.pos")
    return (f"select {k} as k, count(*) filter (where {new} and not {old}) as improved, count(*) filter (where {old} and not {new}) as broken, "
            f"count(*) filter (where {old} = {new}) as unchanged from results a join results b using (question_id) where a.method = 'lexical' and b.method = 'hybrid'")


@query(f"{_RESULTS} " + " union all ".join(_diff_sql(k) for k in ev.KS))
def paired_diff(spark, sf):
    before, after = _pair(spark, sf)
    parts = [ev.paired_diff(before, after, k) for k in ev.KS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""{_RESULTS}, diffs as ({" union all ".join(_diff_sql(k) for k in ev.KS)}) select k, case when k = 7 then 'skip' when broken > 1 + improved then 'fail'
 when improved - broken >= 5 then 'adopt' else 'pass' end as verdict from diffs""")
def regression_gate(spark, sf):
    before, after = _pair(spark, sf)
    parts = [ev.paired_diff(before, after, k) for k in ev.KS]
    diffs = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return ev.regression_gate(diffs, F.col("k") != 7).select("k", "verdict")


@query(f"""{_RESULTS} select coalesce(grp, 'TOTAL') as grp, round(avg(case when {_hit(3)} then 1.0 else 0 end) filter (where method = 'lexical'), 4) as lexical,
 round(avg(case when {_hit(3)} then 1.0 else 0 end) filter (where method = 'hybrid'), 4) as hybrid
 from (select r.*, d.lang as grp from results r join documents d on d.doc_id = r.question_id) x group by rollup (grp)""")
def recall_by_group(spark, sf):
    langs = table(spark, sf, "documents").select(F.col("doc_id").alias("question_id"), F.col("lang").alias("grp"))
    return ev.recall_by_group(_results(spark, sf).join(langs, "question_id"), "grp", list(METHODS), 3)


@query(f"{_RESULTS} " + " union all ".join(
    f"select suite, {k} as k, round(avg(case when {_hit(k)} then 1.0 else 0 end) filter (where method = 'lexical'), 4) as lexical, "
    f"round(avg(case when {_hit(k)} then 1.0 else 0 end) filter (where method = 'hybrid'), 4) as hybrid from results group by suite" for k in ev.KS))
def method_compare(spark, sf):
    return ev.method_compare(_results(spark, sf), list(METHODS))


_CLASSIFIED = """select d.doc_id, cast(l.quality as string) as expected, case when d.n_chars > 2000 then '2' when d.n_chars > 1000 then '1' else '0' end as got,
 l.toxic = 1 as expected_mail, d.text like '%@%' as got_mail from {documents} d join {labels} l on l.doc_id = d.doc_id"""


@query(f"""select count(*) as n, round(avg(case when expected = got then 1.0 else 0 end), 6) as intent_accuracy,
 round(avg(case when expected_mail = got_mail then 1.0 else 0 end), 6) as mail_accuracy from {duck(_CLASSIFIED)} c""")
def classifier_accuracy(spark, sf):
    return ev.classifier_accuracy(frame(spark, sf, _CLASSIFIED))


@query(f"select expected, got, count(*) as n from {duck(_CLASSIFIED)} c where expected <> got group by all order by n desc, expected, got limit 8")
def top_confusions(spark, sf):
    return ev.top_confusions(frame(spark, sf, _CLASSIFIED))


_CLASSES = "select doc_id, case when source in ('src2', 'src9') then null else lang end as lang from {documents}"


@query(f"""select doc_id, coalesce(lang, '?') as lang from {duck(_CLASSES)} c qualify row_number() over (
 partition by coalesce(lang, '?') order by md5(concat('7:', doc_id)), doc_id) <= 20""")
def stratified_sample(spark, sf):
    """20 rows per class; the sample is the operator's purpose."""
    return ev.stratified_sample(frame(spark, sf, _CLASSES), "lang", "doc_id", ev.per_class(100, 5), 7)


@query("select lang, count(*) as n from documents group by lang")
def class_distribution(spark, sf):
    return ev.class_distribution(table(spark, sf, "documents"), "lang")


_DRAFTS = """select doc_id, source as model, lang = 'en' as json_ok, case when lang = 'de' then 'TCKN belirtiniz' else 'Konu' end as subject,
 case when lang = 'fr' then concat(text, chr(10), '[Adınız]') else text end as body from {documents}"""


def _repeated() -> str:
    keys = f"list_filter(list_transform({o.lines('body')}, lambda l: {o.lower_tr(o.fold('l'))}), lambda k: length(k) > 25)"
    return f"(len(list_distinct({keys})) < len({keys}))"


@query(f"""select model, count(*) as n, round(avg(case when json_ok then 1.0 else 0 end), 6) as json_ok,
 round(avg(case when regexp_matches(concat(subject, chr(10), body), '(?i)tckn|t\\.?\\s*c\\.?\\s*kimlik|kimlik\\s*numara|ad(?:[ıi]n[ıi]z)?\\s*(?:ve)?\\s*soyad') then 1.0 else 0 end), 6) as pii_request,
 round(avg(case when regexp_matches(concat(subject, chr(10), body), '\\[[^\\]\\n]{{1,60}}\\]') then 1.0 else 0 end), 6) as placeholder,
 round(avg(case when {_repeated()} then 1.0 else 0 end), 6) as repeated,
 round(avg(((case when contains({o.lower_tr('body')}, 'the') then 1 else 0 end) + (case when contains({o.lower_tr('body')}, lower(model)) then 1 else 0 end)) / 2.0), 6) as coverage
 from {duck(_DRAFTS)} d group by model""")
def draft_quality(spark, sf):
    rows = frame(spark, sf, _DRAFTS).withColumn("fields", F.create_map(F.lit("a"), F.lit("THE"), F.lit("b"), F.col("model")))
    return ev.draft_quality(rows)


@query("""with near as (select q.vec_id, q.label % 2 = 0 as in_scope, min(round(1 - list_cosine_similarity(list_reverse(q.embedding)::double[], c.embedding::double[]), 9)) as nearest
 from embeddings q, embeddings c group by all)
 select threshold, round(100 * avg(case when nearest > threshold then 1.0 else 0 end) filter (where in_scope), 4) as in_scope_lost,
 round(100 * avg(case when nearest > threshold then 1.0 else 0 end) filter (where not in_scope), 4) as out_of_scope_caught
 from near, (values (0.47::double), (0.5::double), (0.55::double), (0.6::double), (0.65::double)) t(threshold) group by threshold""")
def gate_calibration(spark, sf):
    near = vectors.vector_topk(_question_vectors(spark, sf), _vector_chunks(spark, sf), KEYS, 64, k=1)
    scope = table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), (F.col("label") % 2 == 0).alias("in_scope"))
    rows = near.join(scope, "query_id").select("in_scope", F.col("distance").alias("nearest"))
    return ev.gate_calibration(rows, [0.47, 0.50, 0.55, 0.60, 0.65])


_REPLIES = """select conv_id * 1000 + turn as id, role = 'user' as in_scope, case when turn % 2 = 0 then text else '' end as context,
 case when turn = 0 then 'Lütfen öğrenci işlerine danışınız.' when turn = 1 then concat(text, ' 30 gün içinde, madde 5')
 when turn = 2 then 'Ücret 150 TL, öğrenci işlerine başvurun' when turn = 3 then concat(text, ' öğrenci işlerine danışın ', text, text, text) else text end as body
 from {conversations}"""
_FALL, _FIG = "(?i)öğrenci\\s*işlerine\\s*(?:danış|başvur)", "(?i)[0-9]+\\s*(?:TL|₺|lira|gün|hafta|ay|y[ıi]l|kişi|adet|kredi|%|puan)"


@query(f"""with c as (select *, regexp_matches(body, {o.lit(_FALL)}) as fb, regexp_matches(body, {o.lit(_FIG)}) as fig, length({o.fold('body')}) as n from {duck(_REPLIES)} r),
 k as (select *, case when fb and not fig and n < 400 then 'redirect_only' when fig and not in_scope then 'invented' else 'x' end as cls from c)
 select in_scope, count(*) as n, round(avg(case when cls = 'invented' then 1.0 else 0 end), 6) as invented,
 round(avg(case when cls = 'redirect_only' then 1.0 else 0 end), 6) as redirect_only,
 round(avg(case when regexp_matches(body, '(?i)madde\\s*[0-9]+') then 1.0 else 0 end), 6) as cited,
 round(avg(case when context = '' then 1.0 else 0 end), 6) as empty_context from k group by in_scope""")
def reply_classes(spark, sf):
    return ev.reply_classes(frame(spark, sf, _REPLIES))


_CHECKED = """select conv_id * 1000 + turn as id, case when turn < 3 then concat('Ali ', cast(conv_id as string)) end as sender, turn % 3 as sources,
 case role when 'user' then concat('Sayın Öğrenci,', chr(10), text, chr(10), 'Saygılarımızla') when 'assistant' then concat(text, ' [İsim]')
 else concat('x', chr(10), 'Sayın Ali ', cast(conv_id as string), chr(10), text) end as body from {conversations}"""


@query(f"""select id, concat_ws(',', case when role_leak then 'placeholder' end, case when not opening then 'greeting' end,
 case when not contains(lower(body), 'saygılarımızla') then 'closing' end, case when sources = 0 then 'no_sources' end) as issues
 from (select *, contains(body, '[İsim]') as role_leak, len(list_filter({o.lines('body')}[1:3], lambda l: starts_with({o.lower_tr('l')}, 'sayın öğrenci')
 or (sender is not null and starts_with({o.lower_tr('l')}, concat('sayın ', lower(sender)))))) > 0 as opening from {duck(_CHECKED)} c) d""")
def reply_checks(spark, sf):
    rows = frame(spark, sf, _CHECKED)
    return rows.select("id", F.array_join(ev.reply_issues(F.col("body"), F.col("sender"), F.col("sources")), ",").alias("issues"))


_LABELLED = f"""select event_id as question_id, case event_type when 'view' then 'src1' when 'click' then 'src2' when 'purchase' then 'src3' else {derive.INTENT} end as intent from {{events}}"""


@query(f"select question_id, intent from {duck(_LABELLED)} q where intent in (select source from {duck(derive.DOCS)} d where deleted_at is null and status = 'INDEXED')")
def labelled_intents(spark, sf):
    from corpusdesk.operators.corpus import visible

    docs = visible(frame(spark, sf, derive.DOCS)).withColumn("tags", F.array("source"))
    return ev.labelled_intents(docs, frame(spark, sf, _LABELLED)).select("question_id", "intent")
