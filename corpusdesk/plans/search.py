"""The whole hybrid search as one plan over a batch of queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from corpusdesk.operators import fusion, lexical, vectors
from corpusdesk.params import SEARCH, SearchParams
from corpusdesk.sources.workdir import discard, settle

MAX_BROADCAST_CHARS = 64 * 1024 * 1024   # texts that go to every task
PART_CHARS = 32 * 1024 * 1024            # texts of the contexts that a task makes
TURN_CHARS, TURN_HITS = 250_000_000, 1_000_000   # texts and hits of a turn


@dataclass
class Corpus:
    """``chunks``: chunk_id, document_id, chunk_index, content, tags, vec.
    ``documents``: document_id, description, filename.  Both already visible.
    ``postings``: an index of the chunks, ``placed`` if it is bucketed by chunk id."""

    chunks: DataFrame
    documents: DataFrame
    postings: DataFrame | None = None
    placed: bool = False


def candidates(queries: DataFrame, corpus: Corpus, p: SearchParams = SEARCH,
               use_vectors: bool = True, use_words: bool = True) -> DataFrame | None:
    """Candidate lists of all sub-queries; ``queries``: query_id, sub_no, text, vec."""
    keys = ["query_id", "sub_no"]
    vec = lex = None
    if use_vectors:
        vec = vectors.vector_topk(queries, corpus.chunks, keys, p.dim, p.pool)
    if use_words:
        postings = corpus.postings
        if postings is None:
            postings = lexical.build_postings(corpus.chunks)
        lex = lexical.lexical_topk(queries, postings, keys, p.pool, placed=corpus.placed)
    return fusion.merge_legs(vec, lex)


def rank_candidates(queries: DataFrame, legs: DataFrame, corpus: Corpus, p: SearchParams = SEARCH,
                    scores: DataFrame | None = None) -> DataFrame:
    """Gate, bonus, optional outside scores and diversity: (query_id, chunk_id,
    document_id, chunk_index, score, rank)."""
    gated = fusion.scope_gate(fusion.rrf_fuse(legs, p.rrf_k), fusion.query_stats(queries, legs), p.max_distance)
    intents = queries.groupBy("query_id").agg(F.max("intent").alias("intent"))
    attributes = corpus.chunks.select("chunk_id", "document_id", "chunk_index", "tags")
    boosted = fusion.tag_bonus(gated, intents, attributes, p.intent_bonus)
    placed = fusion.rerank_topn(boosted, scores, p.rerank_top_n)
    return fusion.diversify(placed, p.top_k, p.per_document, [F.asc("position")]).drop("position")


def search(queries: DataFrame, corpus: Corpus, p: SearchParams = SEARCH, scores: DataFrame | None = None,
           use_vectors: bool = True, use_words: bool = True) -> DataFrame:
    """Ranked hits without text; ``queries``: query_id, sub_no, text, intent, vec.

    The questions and their candidates (at most two lists of ``pool`` rows each)
    are read by several steps and are settled; the corpus is read once per list.
    """
    queries = settle(queries, "queries")
    legs = candidates(queries, corpus, p, use_vectors, use_words)
    if legs is None:
        return corpus.chunks.limit(0).selectExpr(
            "cast(null as bigint) query_id", "chunk_id", "document_id", "chunk_index", "0d score", "0 rank")
    return rank_candidates(queries, settle(legs, "legs"), corpus, p, scores)


def contexts(queries: DataFrame, corpus: Corpus, p: SearchParams = SEARCH, max_chars: int | None = None) -> DataFrame:
    hits = fusion.hydrate_hits(search(queries, corpus, p), corpus.chunks, corpus.documents)
    return fusion.build_context(fusion.document_order(hits), max_chars)


def contexts_in_turns(hits: DataFrame, corpus: Corpus, use: Callable[[DataFrame], DataFrame], max_chars: int | None = None) -> DataFrame:
    """``use`` of the contexts of ``hits``, for what is small beside the contexts.

    A text goes into as many contexts as it is a hit of, so the contexts of a large batch are many times
    its corpus.  Hits are ordered while they have no text, and the texts are looked up once.  Those of
    checked size go to every task, and nothing else of the contexts is moved.  Others are joined in turns
    of bounded size, and what ``use`` keeps of a turn is written before the next one.
    """
    hits = settle(fusion.document_order(hits), "ordered")
    found = settle(fusion.texts_of(hits, corpus.chunks), "texts")
    docs = settle(corpus.documents, "labels")
    size = F.length("content")
    one = found.agg(F.sum(size)).first()[0] or 0
    n, chars = hits.join(found.select("chunk_id", size.alias("chars")), "chunk_id").agg(F.count(F.lit(1)), F.sum("chars")).first()
    parts, turns = None, max(1, -(-n // TURN_HITS), -(-(chars or 0) // TURN_CHARS))
    if one <= MAX_BROADCAST_CHARS:
        parts, turns = max(1, -(-(chars or 0) // PART_CHARS)), 1
    out = None
    for i in range(turns):
        some = settle(hits.where(F.pmod(F.xxhash64("query_id"), F.lit(turns)) == i), "turn")
        kept = settle(use(fusion.build_context(fusion.hydrate_hits(some, found, docs, parts), max_chars)), "used")
        out = kept if out is None else out.unionByName(kept)
        discard(some)
    discard(hits, found, docs)
    return out
