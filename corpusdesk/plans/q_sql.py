"""Registered queries: the functions for SQL users, called from SQL."""

from __future__ import annotations

from corpusdesk.functions import sqlfuncs
from corpusdesk.plans import oracle as o
from corpusdesk.plans.q_sources import _windows
from corpusdesk.plans.registry import frame, query


def _sql(spark, sf, sql: str):
    sqlfuncs.register(spark)
    return frame(spark, sf, sql)


@query(f"select doc_id, {o.mask('text')} as masked from documents")
def sql_mask_pii(spark, sf):
    return _sql(spark, sf, "select doc_id, mask_pii(text) as masked from {documents}")


@query(f"select doc_id, {o.has_pii('text')} as found from documents")
def sql_has_pii(spark, sf):
    return _sql(spark, sf, "select doc_id, has_pii(text) as found from {documents}")


@query(f"select page_id, {o.html('html')} as body from pages")
def sql_html_to_text(spark, sf):
    return _sql(spark, sf, "select page_id, html_to_text(html) as body from {pages}")


_UNEVEN = "concat('  ', replace(replace(text, ' ', '  '), '. ', concat('-', chr(10), chr(10), chr(10), chr(10))), chr(13), chr(10))"


@query(f"select doc_id, {o.normalize(_UNEVEN)} as even from documents")
def sql_normalize_text(spark, sf):
    return _sql(spark, sf, f"select doc_id, normalize_text({_UNEVEN}) as even from {{documents}}")


@query("""select vec_id, round(1 - list_cosine_similarity(list_reverse(embedding)::double[], embedding::double[]), 6) as distance from embeddings""")
def sql_cosine_distance(spark, sf):
    return _sql(spark, sf, """select vec_id, round(cosine_distance(cast(reverse(embedding) as array<double>), cast(embedding as array<double>)), 6) as distance
 from {embeddings}""")


@query(_windows(200, 20))
def sql_chunk_text(spark, sf):
    return _sql(spark, sf, "select d.doc_id, c.chunk_index, c.content from {documents} d, lateral chunk_text(d.text, 200, 20) c")
