"""Order-preserving packing of tokenised documents into fixed windows.

The documents, in order, are one stream of tokens that is cut into windows of at
most ``LENGTH`` tokens.  A cut behind a document costs nothing, one behind a
sentence ``SENTENCE`` and one inside a sentence ``INSIDE``, all in tokens of
padding.  Let P(j) be the tokens before cut place j and f(j) the least cost of
padding and cuts up to j.  With g(j) = f(j) + P(j),

    g(j) = min { g(i) : P(j) - P(i) <= LENGTH } + LENGTH + cost(j),

a sliding minimum, which a monotone queue keeps in constant time a place.
Range partitions of the document id are packed independently of each other and
hold about ``HORIZON`` tokens at a time, so memory does not grow with the data.
"""

from __future__ import annotations

import struct
import zlib
from collections import deque

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from corpusdesk.llm.common import blocks, documents, worker_store

LENGTH = 4096
END = 2  # the id that closes each document
SENTENCE, INSIDE = 8, 64  # costs of cuts, in tokens of padding
STEP = 256  # inside a longer sentence a cut is possible every so many tokens
HORIZON = 1 << 20  # tokens over which cuts are chosen together
CACHED = 1_000_000  # words in a worker's cache

PIECE = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


#: Punctuation and controls become a dot, all else a blank: two dots in a row tell that marks touch.
MARKS = bytes(46 if c < 128 and not chr(c).isalnum() and c not in b" \t\n\x0b\x0c\r" else 32 for c in range(256))


def apart(text: bytes) -> bytes:
    """A blank before full stops and commas of a text of Latin letters whose marks never touch.

    The vocabulary splits there in any case; fewer different words remain.
    """
    return text if b".." in text.translate(MARKS) else text.replace(b".", b" .").replace(b",", b" ,")


class WordIds(dict):
    """Word between white space (UTF-8) -> its ids as little-endian unsigned 32-bit numbers.

    The vocabulary drops white space and no token spans it, so that texts can be
    put together from words.
    """

    def __init__(self, path: str):
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # what lower-case Latin words need of it: no normalizer, and bytes only where there are letters beyond ASCII
        self.letters, self.latin = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.letters.normalizer = self.latin.normalizer = None
        self.letters.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.latin.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        names = {i: n for n, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        size = max(names) + 1
        self.ends_word = np.array([names.get(i, "").endswith("</w>") for i in range(size)])
        self.ends_sentence = np.array([bool(re.fullmatch(r"[.!?]+(</w>)?", names.get(i, ""))) for i in range(size)])
        # in UTF-8: lower-case letters of Latin-1, and such a word with ASCII punctuation behind it
        self.is_latin = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch
        self.word_and_marks = re.compile(rb"((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+)([!-/:-@\[-`{-~]+)").fullmatch
        self.beyond_latin = re.compile(r"[^\x00-\x7fÀ-ÖØ-öø-ÿ]").search

    def learn(self, words: set[bytes]) -> None:
        """Afterwards all ``words`` are known; a full store starts anew."""
        new = [w for w in words if w not in self]
        if len(self) + len(new) > CACHED:
            self.clear()
            new = list(words)
        letters, latin, rest, parts = set(), set(), [], {}
        for w in new:
            if w.isalpha() and w.islower():
                letters.add(w)
            elif m := self.word_and_marks(w):
                parts[w] = word, marks = m.groups()
                if word not in self:
                    (letters if word.isascii() else latin).add(word)
                if marks not in self:
                    rest.append(marks)
            elif self.is_latin(w):
                latin.add(w)
            else:
                rest.append(w)
        for tokenizer, found in ((self.letters, list(letters)), (self.latin, list(latin))):
            for i in range(0, len(found), 4096):
                self.learn_joined(tokenizer, found[i:i + 4096])
        for i in range(0, len(rest), 4096):
            some = rest[i:i + 4096]
            for w, e in zip(some, self.tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)):
                self[w] = np.array(e.ids, "<u4").tobytes()
        for w, (word, marks) in parts.items():
            self[w] = self[word] + self[marks]

    def learn_joined(self, tokenizer, words: list[bytes]) -> None:
        """Words of letters, each of which ends with the token that ends a word."""
        ids = np.array(tokenizer.encode(b" ".join(words).decode(), add_special_tokens=False).ids, "<u4")
        ends = ((np.flatnonzero(self.ends_word[ids]) + 1) * 4).tolist()
        raw = ids.tobytes()
        assert len(ends) == len(words)
        self.update(zip(words, map(raw.__getitem__, map(slice, [0, *ends[:-1]], ends))))

    def ids(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of each text and END."""
        words = []
        for t in texts:
            t = t or b""
            # lower case is the vocabulary's own first step; special strings are told apart by case
            if b"<|" not in t:
                if t.isascii():
                    t = apart(t.lower())
                elif not self.beyond_latin(text := t.decode()):
                    t = apart(text.lower().encode())
            words.append(t.split())
        self.learn(set().union(*words))
        get, end = self.__getitem__, struct.pack("<I", END)
        return [b"".join(map(get, w)) + end for w in words]


def best_cuts(places: list[int], costs: list[int], length: int = LENGTH) -> list[int]:
    """Indices of the cheapest cuts; the first and the last place are cut anyway.

    ``places`` ascend by steps of at most ``length``.
    """
    last = len(places) - 1
    g, back, queue = [0] * (last + 1), [0] * (last + 1), deque([0])
    for j in range(1, last + 1):
        floor = places[j] - length
        while places[queue[0]] < floor:
            queue.popleft()
        i = queue[0]
        back[j] = i
        value = g[j] = g[i] + length + (costs[j] if j < last else 0)
        while queue and g[queue[-1]] > value:
            queue.pop()
        queue.append(j)
    cuts = [last]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return cuts[::-1]


class Packer:
    """Takes documents in order; gives the pieces of full windows."""

    def __init__(self, first_sequence: int, ends_sentence: np.ndarray, length: int = LENGTH, horizon: int = HORIZON):
        self.sequence, self.ends_sentence, self.length, self.horizon = first_sequence, ends_sentence, length, horizon
        self.docs: deque = deque()  # (key, raw ids, tokens before the piece still to come, number of ids)
        self.places, self.costs = [0], [0]

    def add(self, key, raw: bytes) -> list[tuple]:
        ids = np.frombuffer(raw, "<u4")
        n, base = len(ids), self.places[-1]
        ends = np.flatnonzero(self.ends_sentence[ids]) + 1
        step = min(STEP, self.length)
        marks = np.concatenate(([0], ends[ends < n], [n]))
        gaps = np.diff(marks)
        if gaps.max(initial=0) > step:
            filled = [np.arange(a, b, step) for a, b in zip(marks[:-1], marks[1:]) if b > a]
            places = np.concatenate([*filled, [n]])
            costs = np.where(np.isin(places, marks), SENTENCE, INSIDE)
        else:
            places = marks[np.concatenate(([True], gaps > 0))]
            costs = np.full(len(places), SENTENCE)
        costs[-1] = 0
        self.places += (places[1:] + base).tolist()
        self.costs += costs[1:].tolist()
        self.docs.append((key, raw, 0, n))
        return self.flush(False) if self.places[-1] >= self.horizon else []

    def flush(self, final: bool = True) -> list[tuple]:
        """Pieces of all windows; unless ``final``, the last window stays open."""
        if len(self.places) < 2:
            return []
        cuts = best_cuts(self.places, self.costs, self.length)
        if not final:
            cuts = cuts[:-1]
        out = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            room, offset = self.places[b] - self.places[a], 0
            while room:
                key, raw, start, n = self.docs[0]
                take = min(room, n - start)
                out.append((key, start, take, zlib.crc32(raw[4 * start:4 * (start + take)]), n, self.sequence, offset))
                room, offset = room - take, offset + take
                if start + take == n:
                    self.docs.popleft()
                else:
                    self.docs[0] = (key, raw, start + take, n)
            self.sequence += 1
        done = self.places[cuts[-1]]
        self.places = [p - done for p in self.places[cuts[-1]:]]
        self.costs = self.costs[cuts[-1]:]
        return out


def pack(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", length: int = LENGTH, order: list[Column] | None = None) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, sequence_id, offset), one row per piece.

    ``vocabulary`` is the path of the tokenizer file on all machines.  Documents
    are taken in the ``order`` given, else in that of ``key`` (null first, ties by a hash
    of the text, so that equal keys are spread, and by the text).  A null or empty
    text is one piece that holds END alone; repeated rows are packed each; a text
    longer than a window lies in several pieces; an empty table gives no rows.
    """
    kind = docs.schema[key].dataType
    schema = StructType([StructField(key, kind)] + [StructField(n, LongType()) for n in PIECE])
    body = F.col(text).cast("string")
    order = [F.col(key), F.xxhash64(body), body] if order is None else order
    names = [f"__order{i}" for i in range(min(2, len(order)))]  # a range needs no whole texts
    rows = docs.select(F.col(key), body.alias("__text"), *(o.alias(n) for o, n in zip(order, names)))
    ordered = rows.repartitionByRange(*names).sortWithinPartitions(*names, "__text").select(key, "__text")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        store, out = worker_store("packing"), to_arrow_schema(schema)
        if vocabulary not in store:
            store[vocabulary] = WordIds(vocabulary)
        words = store[vocabulary]
        packer = Packer(TaskContext.get().partitionId() << 40, words.ends_sentence, length)

        def batch_of(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows), out)] if rows else [pa.array([], f.type) for f in out], schema=out)

        for batch in batches:
            keys = batch.column(0)
            for start, part in blocks(batch.column(1)):
                rows = []
                for k, raw in zip(keys.slice(start, len(part)).to_pylist(), words.ids(part)):
                    rows += packer.add(k, raw)
                yield batch_of(rows)
        yield batch_of(packer.flush())

    return ordered.mapInArrow(run, schema)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
