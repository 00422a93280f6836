"""Inverted index and lexical ranking for batches of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from corpusdesk.functions.text import let, runs, tokenize
from corpusdesk.params import SEARCH
from corpusdesk.sources.workdir import fits, settle

PI2_6 = 1.64493406685   # limit of 1 + 1/4 + 1/9 + ...
WORD_WEIGHT = 0.1       # weight of an unlabelled word
SALTS = 32
MAX_BROADCAST_LEXEMES = 200_000   # rows of (keys, lexeme), some 10 MB
TURN = 5                 # a turn of a larger query set has so many times the rows that may be broadcast
BLOCK_POSTINGS, LEAST_POSTINGS = 1_250_000, 500_000   # a task holds up to so many; less are not worth a task
PIECE_ROWS = 100_000     # rows that leave a task at once


def build_postings(chunks: DataFrame, chunk_id: str = "chunk_id", content: str = "content") -> DataFrame:
    """(lexeme, chunk_id, tf, len).  A chunk's words are counted inside its row, so
    building the index moves no data at all.  Each word brings the length along: as a
    column beside the list it would take the whole list into every exploded row."""
    words = let(tokenize(F.col(content)), lambda t: F.transform(runs(t), lambda w: F.struct(
        w["lexeme"].alias("lexeme"), w["tf"].alias("tf"), F.size(t).alias("len"))))
    return chunks.select(chunk_id, F.inline(words)).select("lexeme", chunk_id, "tf", "len")


def document_frequencies(postings: DataFrame) -> DataFrame:
    return postings.groupBy("lexeme").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("occurrences"))


def write_index(postings: DataFrame, table: str, path: str, buckets: int, chunk_id: str = "chunk_id") -> DataFrame:
    """The postings with their weights as a table below ``path``, bucketed by chunk id and sorted by lexeme.

    Searches that read it sum the scores of a chunk where its bucket lies (pass
    ``placed=True``) and skip row groups without a wanted lexeme.
    """
    placed = weighted(postings, chunk_id).repartition(buckets, chunk_id)
    placed.write.mode("overwrite").option("path", path).bucketBy(buckets, chunk_id).sortBy("lexeme").saveAsTable(table)
    return postings.sparkSession.table(table)


def weighted(postings: DataFrame, chunk_id: str = "chunk_id") -> DataFrame:
    """(lexeme, chunk_id, tf, len, weight): weight is 0.1 * H2(tf) / (pi^2/6) / (1 + ln(len)), H2(n) = 1 + 1/4 + ... + 1/n^2."""
    h2 = F.when(F.col("tf") == 1, 1.0).otherwise(
        F.aggregate(F.sequence(F.lit(1), F.col("tf")), F.lit(0.0),
                    lambda a, i: a + F.lit(1.0) / (i.cast("double") * i.cast("double"))))
    return postings.withColumn("weight", WORD_WEIGHT / PI2_6 * h2 / (1 + F.log(F.col("len").cast("double"))))


def query_lexemes(queries: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, lexeme, n_lexemes) with each lexeme of a query once."""
    words = F.array_distinct(tokenize(F.col(text)))
    return queries.select(*keys, words.alias("words")).select(
        *keys, F.size("words").alias("n_lexemes"), F.explode("words").alias("lexeme")
    )


def _matches(lexemes: DataFrame, postings: DataFrame, chunk_id: str, salts: int, max_broadcast: int,
             placed: bool) -> DataFrame:
    """Postings of the lexemes that queries ask for, once per query that asks.

    A checked number of query rows is broadcast.  Matches are then summed per
    query and chunk, and a batch of queries makes many more matches than there
    are postings.  So the wanted postings are moved to their chunk first, unless
    they lie there already (``placed``: the table is bucketed or partitioned by
    chunk id); sums and the cut to the best k need no exchange of matches.

    A larger query set is joined on (lexeme, salt): a lexeme that occurs in a
    third of all chunks is spread over ``salts`` tasks, and the query side,
    still the smaller one, is repeated.
    """
    if fits(lexemes, max_broadcast):
        if not placed:
            wanted = F.broadcast(lexemes.select("lexeme").distinct())
            postings = postings.join(wanted, "lexeme", "left_semi").repartition(chunk_id)
        return postings.join(F.broadcast(lexemes), "lexeme")
    spread = postings.withColumn("salt", F.pmod(F.xxhash64(chunk_id), F.lit(salts)).cast("int"))
    repeated = lexemes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # Spark's estimate of the query side knows nothing of the repeats, and a small file of queries would be broadcast.
    if not fits(lexemes, MAX_BROADCAST_LEXEMES // salts):
        repeated = repeated.hint("merge")
    return spread.join(repeated, ["lexeme", "salt"])


def matching_chunks(queries: DataFrame, postings: DataFrame, chunk_id: str = "chunk_id", text: str = "text") -> DataFrame:
    """(chunk_id): chunks that share a lexeme with any of the queries; each chunk once, no pairs."""
    wanted = queries.select(F.explode(F.array_distinct(tokenize(F.col(text)))).alias("lexeme")).distinct()
    return postings.join(wanted, "lexeme", "left_semi").select(chunk_id).distinct()


def chunk_matches(queries: DataFrame, postings: DataFrame, keys: list[str], chunk_id: str = "chunk_id",
                  salts: int = SALTS, max_broadcast: int = MAX_BROADCAST_LEXEMES, placed: bool = False) -> DataFrame:
    """(keys, chunk_id, shared): chunks that share any lexeme with the query.

    As many rows as there are matches, nearly all pairs for questions of common words:
    for few queries only.  ``matching_chunks`` is the form without pairs.
    """
    found = _matches(query_lexemes(queries, keys), postings, chunk_id, salts, max_broadcast, placed)
    return found.groupBy(*keys, chunk_id).agg(F.count(F.lit(1)).alias("shared"))


def lexical_topk(queries: DataFrame, postings: DataFrame, keys: list[str], k: int = SEARCH.pool,
                 chunk_id: str = "chunk_id", salts: int = SALTS,
                 max_broadcast: int = MAX_BROADCAST_LEXEMES, placed: bool = False) -> DataFrame:
    """(keys, chunk_id, score, rank): the k best chunks of every query.

    score = sum of the weights of shared lexemes, divided by the number of query
    lexemes.  ``postings`` is an index (see ``write_index``) or the bare postings.
    ``placed`` says that all postings of a chunk lie in one partition by chunk id.  More
    queries than may be broadcast then go in turns, each over the whole index; the k best
    of a turn are written before the next one.  A turn makes no row per match: every task
    sums the scores of its chunks in arrays.
    """
    rows = postings if "weight" in postings.columns else weighted(postings, chunk_id)
    lexemes, wanted = query_lexemes(queries, keys), rows.select("lexeme", chunk_id, "weight")
    if not placed or not max_broadcast or fits(lexemes, max_broadcast):
        return _best(_matches(lexemes, wanted, chunk_id, salts, max_broadcast, placed), keys, k, chunk_id)
    lexemes = settle(lexemes, "lexemes")
    turns = -(-lexemes.count() // (TURN * max_broadcast))
    turn = F.pmod(F.xxhash64(*keys), F.lit(turns))
    n = wanted.count()
    cores = wanted.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-n // BLOCK_POSTINGS), min(cores, n // LEAST_POSTINGS))
    out = None
    for i in range(turns):
        best = settle(_block_topk(lexemes.where(turn == i), wanted, keys, k, chunk_id, parts), "lexical")
        out = best if out is None else out.unionByName(best)
    return out


def _block_topk(lexemes: DataFrame, wanted: DataFrame, keys: list[str], k: int, chunk_id: str, parts: int) -> DataFrame:
    """The k best chunks of the queries of a turn.

    Every task gets all queries and the postings of its share of the chunks, and hands on k rows per query.
    """
    asked = wanted.sparkSession.sparkContext.broadcast(_by_query(lexemes.toArrow(), keys))
    schema = StructType([*(lexemes.schema[c] for c in keys), wanted.schema[chunk_id], StructField("score", DoubleType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, vocabulary, words, parts_of = asked.value
        if not len(words):
            return
        held = []
        for some in _gathered(batches, PIECE_ROWS):
            word = pc.index_in(some["lexeme"], value_set=vocabulary)
            held.append(some.drop(["lexeme"]).append_column("word", word).filter(pc.is_valid(word)))
        if not any(some.num_rows for some in held):
            return
        postings = pa.concat_tables(held)
        del held
        # Numbers of the chunks in the order of their ids, which settles ties; null comes first, as in Spark.
        ids = postings[chunk_id].combine_chunks().dictionary_encode(null_encoding="encode")
        by_id = pc.sort_indices(ids.dictionary, null_placement="at_start")
        place = np.empty(len(by_id), np.int32)
        place[by_id.to_numpy()] = np.arange(len(by_id))
        word = postings["word"].to_numpy()
        order = np.argsort(word, kind="stable")
        chunk, weight = place[ids.indices.to_numpy()][order], postings["weight"].to_numpy()[order]
        starts = np.searchsorted(word[order], np.arange(len(vocabulary) + 1)).tolist()
        ids = ids.dictionary.take(by_id)
        del postings, word, order

        def piece(found: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            query = np.repeat([q for q, _, _ in found], [len(c) for _, c, _ in found])
            columns = [labels[c].take(pa.array(query)).combine_chunks() for c in keys]
            columns += [ids.take(pa.array(np.concatenate([c for _, c, _ in found]))), pa.array(np.concatenate([s for _, _, s in found]))]
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        found, n = [], 0
        for query, summands in enumerate(parts_of):
            score = np.zeros(len(ids))
            for first, last, n_lexemes in summands:
                spans = [slice(starts[w], starts[w + 1]) for w in words[first:last].tolist() if starts[w] < starts[w + 1]]
                if spans:
                    score += np.bincount(np.concatenate([chunk[x] for x in spans]),
                                         np.concatenate([weight[x] for x in spans]), len(ids)) / n_lexemes
            best, score = _highest(score, k)
            if len(best):
                found.append((query, best, score))
                n += len(best)
            if n >= PIECE_ROWS:
                yield piece(found)
                found, n = [], 0
        if n:
            yield piece(found)

    return _first(wanted.repartition(parts, chunk_id).mapInArrow(scan, schema), keys, k, chunk_id)


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The batches as tables of ``rows`` rows or more, the last one aside."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _by_query(rows: pa.Table, keys: list[str]) -> tuple[pa.Table, pa.Array, np.ndarray, list[list[tuple[int, int, int]]]]:
    """Query lexemes as (keys of the queries, vocabulary, words as numbers, per query the places of its words and their
    number).  Rows with equal keys, null ones as well, are one query, whose texts are summed by their numbers of lexemes."""
    query = np.zeros(rows.num_rows, np.int64)
    for name in keys:
        number = rows[name].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64)
        query = np.unique(query * (number.max(initial=0) + 1) + number, return_inverse=True)[1]
    first, number = np.unique(query, return_index=True)[1], rows["n_lexemes"].to_numpy()
    order = np.lexsort((number, query))
    words = rows["lexeme"].combine_chunks().dictionary_encode()
    query, number = query[order], number[order]
    bounds = np.r_[0, np.flatnonzero((np.diff(query) != 0) | (np.diff(number) != 0)) + 1, len(order)] if len(order) else np.zeros(1, np.int64)
    parts_of: list[list[tuple[int, int, int]]] = [[] for _ in first]
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        parts_of[query[a]].append((a, b, int(number[a])))
    return rows.select(keys).take(pa.array(first)).combine_chunks(), words.dictionary, words.indices.to_numpy()[order], parts_of


def _highest(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and rounded values of the k highest scores above zero, ties by place."""
    least = np.partition(score, len(score) - k)[len(score) - k] if len(score) > k else 0.0
    # Rounding moves a score by half a unit of its ninth digit at most.
    near = np.flatnonzero(score >= least - 2e-9) if least > 2e-9 else np.flatnonzero(score)
    value = np.round(score[near], 9)
    order = np.lexsort((near, -value))[:k]
    return near[order], value[order]


def _best(found: DataFrame, keys: list[str], k: int, chunk_id: str) -> DataFrame:
    """The k best chunks of every query from its matches."""
    scored = found.groupBy(*keys, chunk_id).agg(F.round(F.sum(F.col("weight") / F.col("n_lexemes")), 9).alias("score"))
    return _first(scored, keys, k, chunk_id)


def _first(scored: DataFrame, keys: list[str], k: int, chunk_id: str) -> DataFrame:
    best = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc(chunk_id))
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
