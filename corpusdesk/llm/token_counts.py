"""Token counts by a map-side two-tier lookup.

Tier 1 is a compact table of the token numbers of frequent pre-tokens, made once
and broadcast: at most ``TIER1`` entries, whatever the corpus.  Tier 2 is a cache
in each Python worker that keeps what the library says about all other
pre-tokens.  Texts and pre-tokens never move; the only shuffle is that of each
task's heavy hitters, at most ``1 / SHARE`` rows a task.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import BooleanType, LongType, StructField

from corpusdesk.llm.common import add_columns, blocks, documents, worker_store

TIER1 = 32_768  # frequent words in the broadcast table
SHARE = 1 / 16_384  # a word counts as frequent in a task from this share of its words on
PRUNE = 200_000  # words that a task's counter holds before it drops rare ones
TIER2 = 600_000  # pre-tokens in a worker's cache
LIMIT = 512

# The pre-token pattern of the byte-level vocabulary.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for ASCII and letters of Latin-1 and Latin Extended-A, where the standard module agrees.
PLAIN = PRE_TOKEN.replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d").replace(
    r"[^\s[^\W\d_]\d]", r"(?:[^\s\w]|_)")
NOT_PLAIN = r"[^\t-\r -~À-ÖØ-öø-ſ]"
#: The vocabulary's special string counts as one token wherever it stands.
SPECIAL = "<|endoftext|>"


def frequent_words(docs: DataFrame, text: str = "text", top: int = TIER1) -> list[str]:
    """The most frequent words of all texts, by lossy counts that are summed over tasks."""

    def count(batches):
        seen, total, lost = Counter(), 0, 0
        for batch in batches:
            for _, part in blocks(batch.column(0)):
                for t in part:
                    words = (t or b"").split()
                    seen.update(words)
                    total += len(words)
                if len(seen) > PRUNE:
                    lost += 1
                    seen = Counter({w: n for w, n in seen.items() if n > lost})
        found = [(w, n) for w, n in seen.items() if n >= max(2, total * SHARE) and len(w) <= 64]
        yield pa.RecordBatch.from_arrays(
            [pa.array([w.decode() for w, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())],
            names=["word", "n"])

    found = docs.select(F.col(text).cast("string")).mapInArrow(count, "word string, n long")
    best = found.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(top)
    return [r.word for r in best.collect()]


class Counts(dict):
    """Pre-token -> number of tokens: the pinned first tier, and what was met since."""

    def __init__(self, tokenizer, pinned: dict[str, int]):
        super().__init__(pinned)
        self.tokenizer, self.pinned = tokenizer, pinned

    def learn(self, pieces: set[str]) -> None:
        """Afterwards all ``pieces`` are known; a full second tier starts anew."""
        new = [p for p in pieces if p not in self]
        if len(self) + len(new) > len(self.pinned) + TIER2:
            self.clear()
            self.update(self.pinned)
            new = [p for p in pieces if p not in self]
        for i in range(0, len(new), 4096):
            part = new[i:i + 4096]
            for p, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                self[p] = len(e.ids)


def _counter(path: str, pinned: dict[str, int]):
    """A function from a block of texts to [bytes, tokens, over the limit]."""
    import os
    import re

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    store = worker_store(f"token_counts:{path}")
    if store.get("pinned") != pinned:
        store["pinned"] = pinned
        store["counts"] = Counts(Tokenizer.from_file(path), pinned)
    counts, plain, odd = store["counts"], re.compile(PLAIN), re.compile(NOT_PLAIN)

    def block(texts):
        pieces, whole = [], {}
        for i, raw in enumerate(texts):
            t = (raw or b"").decode()
            if SPECIAL in t or odd.search(t):
                whole[i] = t  # the library splits special strings and all other scripts itself
                pieces.append([])
            else:
                pieces.append(plain.findall(t))
        counts.learn(set().union(*pieces))
        get = counts.__getitem__
        n = [sum(map(get, p)) for p in pieces]
        for i, t in whole.items():
            n[i] = len(counts.tokenizer.encode(t, add_special_tokens=False).ids)
        return [[len(t or b"") for t in texts], n, [k > LIMIT for k in n]]

    return block


def count_tokens(docs: DataFrame, vocabulary: str, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` plus (n_bytes, n_tokens, over_limit) of every whole text.

    ``vocabulary`` is the path of a byte-level tokenizer file, present on all
    machines.  A null text counts as empty: no bytes, no tokens.  Repeated rows
    are counted each; an empty table gives an empty result.
    """
    import re

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary)
    plain, odd = re.compile(PLAIN), re.compile(NOT_PLAIN)
    pieces = {p for w in frequent_words(docs, text) if not odd.search(w) and SPECIAL not in w
              for p in (*plain.findall(f" {w}"), *plain.findall(w))}
    names = sorted(pieces | {" ", "\n", "\n\n"})
    sizes = np.array([len(e.ids) for e in tokenizer.encode_batch_fast(names, add_special_tokens=False)], np.int16)
    table = docs.sparkSession.sparkContext.broadcast(("\0".join(names), sizes.tobytes()))

    def make():
        joined, raw = table.value
        return _counter(vocabulary, dict(zip(joined.split("\0"), np.frombuffer(raw, np.int16).tolist())))

    fields = [StructField("n_bytes", LongType()), StructField("n_tokens", LongType()), StructField("over_limit", BooleanType())]
    return add_columns(docs, fields, make, keep, text)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), ["doc_id"])
