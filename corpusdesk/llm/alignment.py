"""Alignment of the tokens of two tokenizers, with corpus-wide counts of linked ids.

The bytes of a text are cut by both vocabularies; where tokens of both end, a group
ends, and an A token is linked with each B token whose bytes overlap its own.  Both
vocabularies break before a blank that follows a word, so a text is aligned word by
word, and a worker aligns a word it knows only once.

First pass: each task counts the pairs of linked ids of its documents.  The distinct
pairs get a minimal perfect hash (``perfect_hash``), each slice of the counts becomes a
dense vector in the order of the hash, and vectors are added up in a tree.
The table of keys and counts, ``TABLE`` pairs at most, is broadcast.  Second pass:
the documents are aligned again and each link looks its count up; the table's keys tell
whether a pair is in it.  Beyond ``TABLE`` distinct pairs it holds the most
frequent ones, and links of all others are joined with their counts.
"""

from __future__ import annotations

import re
import uuid
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField

from corpusdesk.llm import perfect_hash
from corpusdesk.llm.common import add_columns, blocks, documents, settle, without, worker_store
from corpusdesk.llm.token_counts import PRE_TOKEN

TABLE = 3_000_000  # pairs of the broadcast table, some 30 bytes each
CACHE, CACHE_CHARS = 500_000, 12_000_000  # words of a worker's cache, and their characters
LONG_WORD = 1 << 16  # characters that are encoded in one go; a longer word goes to the library alone
SLICE, FAN = 1 << 16, 16  # counts of a piece of a dense vector; vectors that are added up at once

#: A run of these blanks and what follows up to the next of them.
PLAIN = re.compile(r"[ \n\t]+[^ \n\t]*|[^ \n\t]+")
#: White space beyond these: behind it a blank is no end of a word.
ODD = re.compile(r"[^\S \n\t]|[\x1c-\x1f]")
ENDS = re.compile(r"(?<=[^\s\x1c-\x1f])(?=[ \n\t])")


def words_of(text: str) -> list[str]:
    """Pieces of ``text`` that no token of either vocabulary crosses."""
    return ENDS.split(text) if ODD.search(text) else PLAIN.findall(text)


def bytes_of_byte_level(tokenizer) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary, whose tokens have one printable character for a byte."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    tokens = (tokenizer.id_to_token(i) for i in range(tokenizer.get_vocab_size()))
    return [bytes(byte[c] for c in t) if t and all(c in byte for c in t) else (t or "").encode() for t in tokens]


def bytes_of_pieces(model) -> list[bytes]:
    """The bytes of each id of a piece vocabulary, the blank's sign as a blank."""
    def one(i: int) -> bytes:
        piece = model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()

    return [one(i) for i in range(model.vocab_size())]


def fast_encoder(tokenizer, tokens: list[bytes]):
    """``tokenizer`` as an encoder by ranks, which does the same in a third of the time; None where its merges are not in the order of ids."""
    import json

    import tiktoken

    model = json.loads(tokenizer.to_str())["model"]
    special = set(tokenizer.get_added_tokens_decoder())
    ranks = {t: i for i, t in enumerate(tokens) if i not in special}
    sign = {i: tokenizer.id_to_token(i) for i in ranks.values()}
    merges = [m if isinstance(m, str) else "".join(m) for m in model["merges"]]
    if [sign.get(256 + i) for i in range(len(merges))] != [m.replace(" ", "") for m in merges]:
        return None
    return tiktoken.Encoding("ranks", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})


class Aligner:
    """Both vocabularies of a worker."""

    def __init__(self, path_a: str, path_b: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        self.bytes_a, self.bytes_b = bytes_of_byte_level(self.a), bytes_of_pieces(self.b)
        self.len_a, self.len_b = (np.array([len(t) for t in v], np.int64) for v in (self.bytes_a, self.bytes_b))
        self.fast = fast_encoder(self.a, self.bytes_a)
        if any(re.search(rb"[^\s][ \n\t]", t) for t in self.bytes_b):
            raise ValueError("a piece of this vocabulary goes beyond the end of a word")

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        if self.fast and len(text) <= LONG_WORD:
            a = self.fast.encode_ordinary(text)
        else:
            a = self.a.encode(text, add_special_tokens=False).ids
        # the library puts a blank before what it is given: a letter takes it, and goes
        return a, self.b.encode("a" + text, num_threads=1)[1:]

    def align(self, words: list[str], strings: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """(n_a, n_b, n_groups, n_links of each word; pairs of all links; is a word right?; groups as text)."""
        runs, size = [[]], 0  # words that are encoded together: only the last one may end in a blank
        for w in words:
            if runs[-1] and (size + len(w) > LONG_WORD or runs[-1][-1][-1].isspace()):
                runs.append([])
                size = 0
            runs[-1].append(w)
            size += len(w)
        found = [f for run in runs if run for f in self._align(run, strings)]
        stats, pairs, right, texts = zip(*found) if found else ((), (), (), ())
        return (np.concatenate([np.zeros((0, 4), np.int64), *stats]), np.concatenate([np.zeros(0, np.int64), *pairs]),
                np.concatenate([np.zeros(0, bool), *right]), [t for part in texts for t in part])

    def _align(self, words: list[str], strings: bool) -> list[tuple]:
        joined = "".join(words)
        a, b = self.encode(joined)
        raw = joined.encode()
        if not b"".join(map(self.bytes_a.__getitem__, a)) == raw == b"".join(map(self.bytes_b.__getitem__, b)):
            if len(words) == 1:
                return [(np.zeros((1, 4), np.int64), np.zeros(0, np.int64), np.zeros(1, bool), [""])]
            half = len(words) // 2
            return self._align(words[:half], strings) + self._align(words[half:], strings)
        flat_a, flat_b = np.array(a, np.int64), np.array(b, np.int64)
        end_a, end_b = np.cumsum(self.len_a[flat_a]), np.cumsum(self.len_b[flat_b])
        ends = np.union1d(end_a, end_b)  # one link ends at each of them
        at_a, at_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        both = (end_a[at_a] == ends) & (end_b[at_b] == ends)
        word_end = np.cumsum([len(w.encode()) for w in words] if len(raw) > len(joined) else list(map(len, words)))
        links = np.searchsorted(ends, word_end, side="right")
        groups = np.concatenate(([0], np.cumsum(both)))[links]
        stats = np.diff(np.stack([np.searchsorted(end_a, word_end, side="right"), np.searchsorted(end_b, word_end, side="right"), groups, links], axis=1), axis=0, prepend=0)
        texts = [""] * len(words)
        if strings:
            sa, sb = list(map(str, a)), list(map(str, b))
            stop_a, stop_b = (at_a[both] + 1).tolist(), (at_b[both] + 1).tolist()
            cut = [f"{sa[i]}|{sb[k]}" if j - i == 1 == m - k else f"{','.join(sa[i:j])}|{','.join(sb[k:m])}"
                   for i, j, k, m in zip([0, *stop_a], stop_a, [0, *stop_b], stop_b)]
            stop = groups.tolist()
            texts = [";".join(cut[x:y]) for x, y in zip([0, *stop], stop)]
        return [(stats, flat_a[at_a] * len(self.len_b) + flat_b[at_b], np.ones(len(words), bool), texts)]


class Words:
    """What a worker knows of words; when it is ``full``, the caller lets it forget all of them."""

    def __init__(self, aligner: Aligner, strings: bool):
        self.aligner, self.strings = aligner, strings
        self.forget()

    def forget(self) -> None:
        self.number, self.chars, self.texts = {}, 0, []
        self.stats, self.pairs, self.right = np.zeros((0, 4), np.int64), [], np.zeros(0, bool)
        self.sums, self.missed = np.zeros((0, 2), np.int64), {}

    def full(self) -> bool:
        return len(self.number) > CACHE or self.chars > CACHE_CHARS

    def learn(self, words: set[str]) -> tuple[np.ndarray, np.ndarray]:
        """Takes in the new ones of ``words``; (their stats, the pairs of their links)."""
        new = [w for w in words if w not in self.number]
        found = [self.aligner.align(new, self.strings)]
        self.number |= {w: len(self.number) + k for k, w in enumerate(new)}
        self.chars += sum(map(len, new))
        stats = np.concatenate([self.stats[:0], *(f[0] for f in found)])
        self.stats = np.concatenate([self.stats, stats])
        self.right = np.concatenate([self.right, *(f[2] for f in found)])
        for f in found:
            self.texts += f[3]
        return stats, np.concatenate([np.zeros(0, np.int64), *(f[1] for f in found)])

    def numbers(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of all words of all texts, number of words of each text); a text with a wrong word has none."""
        sizes = np.array([len(t) for t in texts], np.int64)
        found = np.fromiter(map(self.number.__getitem__, chain.from_iterable(texts)), np.int64, int(sizes.sum()))
        right = sums_by((~self.right[found]).astype(np.int64), sizes) == 0
        return found[np.repeat(right, sizes)], np.where(right, sizes, 0)


def aligner_of(path_a: str, path_b: str) -> Aligner:
    store = worker_store("alignment")
    if (path_a, path_b) not in store:
        store[path_a, path_b] = Aligner(path_a, path_b)
    return store[path_a, path_b]


def words_in(name: str, path_a: str, path_b: str, strings: bool) -> Words:
    """The words that this worker knows in the pass called ``name``."""
    aligner, store = aligner_of(path_a, path_b), worker_store("alignment")
    if name not in store:
        for other in [k for k in store if isinstance(store[k], Words)]:
            del store[other]
        store[name] = Words(aligner, strings)
    return store[name]


def sums_by(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of rows, ``sizes`` rows each; an empty run gives zero."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)])
    stop = np.cumsum(sizes)
    return total[stop] - total[stop - sizes]


def split(texts: list[bytes | None]) -> list[list[str]]:
    return [words_of(" " + t.decode()) if t else [] for t in texts]


def summed(pairs: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs with the sums of ``n``."""
    order = np.argsort(pairs, kind="stable")
    pairs, n = pairs[order], n[order]
    first = np.flatnonzero(np.diff(pairs, prepend=-1))
    return pairs[first], np.add.reduceat(n, first) if len(first) else n


# --- first pass -----------------------------------------------------------------


def pair_counts(docs: DataFrame, path_a: str, path_b: str, text: str = "text") -> DataFrame:
    """(pair, n): links of each pair of ids; a task gives a pair once each time its cache is full."""

    def run(batches):
        words = words_in("count", path_a, path_b, False)
        seen = np.zeros(0, np.int64)

        def flush():
            n = np.repeat(np.pad(seen, (0, len(words.number) - len(seen))), words.stats[:, 3])
            found, n = summed(np.concatenate([np.zeros(0, np.int64), *words.pairs])[n > 0], n[n > 0])
            return pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["pair", "n"])

        for batch in batches:
            for _, part in blocks(batch.column(0)):
                cut = split(part)
                words.pairs.append(words.learn(set().union(*cut))[1])
                numbers, _ = words.numbers(cut)
                seen = np.pad(seen, (0, len(words.number) - len(seen))) + np.bincount(numbers, minlength=len(words.number))
                if words.full():
                    yield flush()
                    words.forget()
                    seen = np.zeros(0, np.int64)
        yield flush()

    return docs.select(F.col(f"`{text}`").cast("string")).mapInArrow(run, "pair long, n long")


def dense_counts(counts: DataFrame, table: perfect_hash.PerfectHash) -> np.ndarray:
    """The sums of ``counts`` (pair, n) in the order of the table; pairs that it does not hold are skipped.

    A task adds up one dense vector and hands on slices of it; ``FAN`` slices of the same
    place are added up at a time until one is left of each place.
    """
    if not len(table):
        return np.zeros(0, np.int64)
    held = counts.sparkSession.sparkContext.broadcast(table.arrays())

    def to_slices(batches):
        from pyspark import TaskContext

        table = perfect_hash.PerfectHash(*held.value)
        vector = np.zeros(len(table), np.int64)
        for batch in batches:
            at = table.index(batch.column(0).to_numpy())
            np.add.at(vector, at[at >= 0], batch.column(1).to_numpy()[at >= 0])
        cut = [(i // SLICE, vector[i:i + SLICE]) for i in range(0, len(vector), SLICE)]
        cut = [(i, v.tobytes()) for i, v in cut if v.any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in cut], pa.int64()), pa.array([TaskContext.get().partitionId()] * len(cut), pa.int64()),
                                          pa.array([v for _, v in cut], pa.binary())], names=["slice", "part", "v"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(v, np.int64) for v in rows["v"])
        return pd.DataFrame({"slice": rows["slice"].iloc[:1], "part": rows["part"].iloc[:1] // FAN, "v": [total.tobytes()]})

    slices, schema = counts.mapInArrow(to_slices, "slice long, part long, v binary"), "slice long, part long, v binary"
    left = counts.rdd.getNumPartitions()
    while left > 1:
        slices = slices.groupBy("slice", F.floor(F.col("part") / FAN)).applyInPandas(add, schema)
        left = -(-left // FAN)
    total = np.zeros(len(table), np.int64)
    for r in slices.select("slice", "v").collect():
        v = np.frombuffer(r.v, np.int64)
        total[r.slice * SLICE:r.slice * SLICE + len(v)] += v
    return total


def most_frequent(counts: DataFrame, at_most: int) -> DataFrame:
    """Pairs of the distinct ``counts`` (pair, n) with the highest ``n``, ``at_most`` of them, ties left out together."""
    least, found = 0, counts
    while (n := found.count()) > at_most:
        share = at_most / n * 0.9
        least = max(least + 1, int(found.agg(F.percentile_approx("n", 1 - share, 10_000)).first()[0]))
        found = counts.where(F.col("n") >= least)
    return found.select("pair")


# --- second pass ----------------------------------------------------------------


def align(docs: DataFrame, path_a: str, path_b: str, keep: list[str], text: str = "text", table: int | None = None) -> DataFrame:
    """``keep`` plus n_a, n_b, n_groups, n_links, n_best, count_sum (long) and groups (string) of every whole text.

    ``path_a`` is a byte-level tokenizer file, ``path_b`` a piece model, present on all
    machines; both see a blank and the text.  ``groups`` lists the ids of both sides,
    ``a1,a2|b1;a3|b2``.  A link's count is the number of links of its two ids in all of
    ``docs``; ``n_best`` counts links that no other partner of their B id exceeds.
    Texts that are null or empty, or that one of the vocabularies does not give back byte
    by byte, have no tokens: zeros and an empty ``groups``.  Repeated rows count each;
    an empty table gives an empty result.
    """
    table = TABLE if table is None else table
    counts = settle(pair_counts(docs, path_a, path_b, text), "pair-counts")
    pairs = settle(counts.select("pair").distinct(), "pairs")
    n, rest = pairs.count(), None
    if n > table:
        sums = settle(counts.groupBy("pair").agg(F.sum("n").alias("n")), "pair-sums")
        pairs = settle(most_frequent(sums, table), "frequent")
        rest, n = sums.join(pairs, "pair", "left_anti"), pairs.count()
    hashed = perfect_hash.build(pairs, n)
    count = dense_counts(counts, hashed)
    kinds = len(aligner_of(path_a, path_b).len_b)
    best = np.zeros(kinds, np.int64)  # highest count of each B id: as many as the vocabulary has
    np.maximum.at(best, hashed.keys % kinds, count)
    if rest is not None:
        for r in rest.groupBy((F.col("pair") % kinds).alias("b")).agg(F.max("n").alias("n")).collect():
            best[r.b] = max(best[r.b], r.n)
    some = rest is not None  # the table holds some of the pairs only
    held = docs.sparkSession.sparkContext.broadcast((hashed.arrays(), count, best))
    name = f"look-up-{uuid.uuid4().hex}"  # what a worker knows of words holds for these counts only

    def make():
        arrays, count, best = held.value
        hashed = perfect_hash.PerfectHash(*arrays)
        words = words_in(name, path_a, path_b, True)

        def look_up(stats, pairs):
            """Sums of each new word; pairs that are not in the table are noted."""
            at, first = hashed.index(pairs), len(words.sums)
            n = np.where(at >= 0, count[at] if len(count) else 0, 0)
            sums = sums_by(np.stack([(n == best[pairs % kinds]) & (at >= 0), n], axis=1).astype(np.int64), stats[:, 3])
            words.sums = np.concatenate([words.sums, sums])
            if (at < 0).any():
                word = first + np.repeat(np.arange(len(stats)), stats[:, 3])
                for w, p in zip(word[at < 0].tolist(), pairs[at < 0].tolist()):
                    words.missed.setdefault(w, []).append(p)

        def block(texts):
            if words.full():
                words.forget()
            cut = split(texts)
            look_up(*words.learn(set().union(*cut)))
            numbers, sizes = words.numbers(cut)
            out = sums_by(np.concatenate([words.stats, words.sums], axis=1)[numbers], sizes).T.tolist()
            stop, listed = np.cumsum(sizes).tolist(), numbers.tolist()
            mine = [listed[i:j] for i, j in zip([0, *stop], stop)]
            out.append([";".join([words.texts[k] for k in m]) for m in mine])
            if some:
                missed = words.missed
                out.append([[p for k in m if k in missed for p in missed[k]] for m in mine])
            return out

        return block

    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    fields = [StructField(c, LongType()) for c in names] + [StructField("groups", StringType())]
    if rest is None:
        return add_columns(docs, fields, make, keep, text)
    return _with_rest(docs, fields, make, keep, text, rest, best, kinds)


def _with_rest(docs, fields, make, keep, text, rest, best, kinds):
    """The second pass where the table holds a part of all pairs: links of the others are joined with their counts."""
    kept = without(keep, [f.name for f in fields])
    src = docs.select(F.col(f"`{text}`").alias("__text"), F.struct(F.lit(0).alias("__0"), *(F.col(f"`{c}`") for c in kept)).alias("__kept"))
    rows = add_columns(src, [*fields, StructField("__missed", ArrayType(LongType()))], make, ["__kept"], "__text")
    rows = settle(rows.withColumn("__id", F.monotonically_increasing_id()), "aligned")  # the written number stays
    links = rows.select("__id", F.explode("__missed").alias("pair")).groupBy("__id", "pair").agg(F.count(F.lit(1)).alias("links"))
    # one row for each id of the vocabulary
    tops = F.broadcast(docs.sparkSession.createDataFrame(pd.DataFrame({"b": np.arange(kinds), "top": best})))
    counted = rest.withColumn("b", F.col("pair") % kinds).join(tops, "b").select("pair", "n", (F.col("n") == F.col("top")).cast("long").alias("top"))
    sums = links.join(counted, "pair").groupBy("__id").agg(F.sum(F.col("links") * F.col("top")).alias("__best"), F.sum(F.col("links") * F.col("n")).alias("__sum"))
    both = rows.join(sums, "__id", "left")
    more = {"n_best": "__best", "count_sum": "__sum"}
    columns = [(F.col(f.name) + F.coalesce(more[f.name], F.lit(0))).alias(f.name) if f.name in more else F.col(f.name) for f in fields]
    return both.select(*(F.col(f"__kept.`{c}`") for c in kept), *columns)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = align(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), ["doc_id"])
    digest = F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2("groups", 256))
    return found.withColumn("groups_sha256", digest).drop("groups")
