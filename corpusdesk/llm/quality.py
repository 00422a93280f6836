"""Quality rules: word statistics and the divergence from a language's usual text.

References are two histograms per language over all its documents: the share of
each character class among the characters, and the share of each of the
``COMMON`` most common words (and of all others) among the words.  A document is
compared with the references by the Jensen-Shannon distance (base 2, 0 to 1) and
takes the nearest one.  Too little text tells nothing, so both comparisons have a
minimum length below which they keep the document.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField

from corpusdesk.llm.common import add_columns, blocks, documents, keep_rows, settle, worker_store

MIN_WORDS = 10  # fewer words fail
MAX_REPEATED = 20  # per cent of words inside repeated windows
WINDOW = 5
COMMON = 40  # words in a reference
CLASS_CHARS, CLASS_LIMIT = 200, 0.3  # guard and largest distance of the character classes
WORD_WORDS, WORD_LIMIT = 100, 0.4  # the same for common words
PRUNE = 200_000  # different words that a task counts before it hands them on
CLASSES = ("lower", "upper", "letter", "digit", "space", "mark", "symbol", "control")

# Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\x0b\x0c\r"
SYMBOL_BYTES = np.isin(np.arange(256), list(SYMBOLS))
WHITE_BYTES = np.isin(np.arange(256), list(WHITE))


def class_table() -> np.ndarray:
    """Code point -> index in CLASSES, from the general category."""
    store = worker_store("char_classes")
    if "table" not in store:
        kinds = {"Ll": 0, "Lu": 1, "Lt": 1, "Nd": 3, "Zs": 4, "Zl": 4, "Zp": 4, "Pi": 5, "Pf": 5, "Po": 5, "Ps": 5, "Pe": 5, "Pd": 5, "Pc": 5}
        first = {"L": 2, "M": 2, "N": 3, "S": 6, "C": 7}
        table = np.fromiter((kinds.get(c, first.get(c[0], 7)) for c in map(unicodedata.category, map(chr, range(0x110000)))), np.uint8, 0x110000)
        table[list(WHITE)] = 4
        table[list(SYMBOLS)] = 6
        store["table"] = table
    return store["table"]


def class_counts(text: bytes) -> np.ndarray:
    points = np.frombuffer(text.decode().encode("utf-32-le"), "<u4")
    return np.bincount(class_table()[points], minlength=len(CLASSES))


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of WINDOW words which the text holds twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + (h[k:k + n] ^ (h[k:k + n] >> np.uint64(29)))
    order = np.argsort(mixed, kind="stable")
    sorted_ = mixed[order]
    same = sorted_[1:] == sorted_[:-1]
    if not same.any():
        return 0
    suspects = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))]
    seen = Counter(tuple(words[i:i + WINDOW]) for i in suspects.tolist())
    starts = [i for i in suspects.tolist() if seen[tuple(words[i:i + WINDOW])] > 1]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.array(starts, np.int64) + WINDOW, -1)
    return int((np.cumsum(edge) > 0).sum())


def statistics(text: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    raw = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    chars = int(raw.sum() - raw[0x80:0xC0].sum() - raw[WHITE_BYTES].sum())
    lines = [x for x in text.split(b"\n") if x.strip(WHITE)]
    return len(words), chars, int(raw[SYMBOL_BYTES].sum()), len(lines) - len(set(lines)), repeated_words(words)


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2) of ``p`` to each row of ``q``; all sum to one."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(-1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(-1)
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


def language_references(docs: DataFrame, lang: str = "lang", text: str = "text") -> dict:
    """{"classes": languages x CLASSES, "words": [{word: share}]} of all languages that have words.

    All documents with a language count.  Each task sums its own documents and
    hands on one row per language and class and one per word, so a busy
    language is summed before anything moves; words that do not fit into memory
    go on before the others.
    """

    def count(batches):
        classes, words, totals, held = {}, {}, Counter(), 0

        def made(rows):
            columns = list(zip(*rows)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.int64()))],
                                              names=["lang", "kind", "word", "n"])

        def seen():
            rows = ((k, len(CLASSES) + 1, w.decode(), n) for k, mine in words.items() for w, n in mine.items())
            while part := list(islice(rows, 16_384)):
                yield made(part)

        for batch in batches:
            langs = batch.column(0)
            for start, part in blocks(batch.column(1)):
                for k, t in zip(langs.slice(start, len(part)).to_pylist(), part):
                    if k is None or not t:
                        continue
                    classes[k] = classes.get(k, 0) + class_counts(t)
                    mine, found = words.setdefault(k, Counter()), t.lower().split()
                    held -= len(mine)
                    mine.update(found)
                    held += len(mine)
                    totals[k] += len(found)
                    if held > PRUNE:
                        yield from seen()
                        words, held = {}, 0
        yield from seen()
        yield made([(k, i, "", int(n)) for k, c in classes.items() for i, n in enumerate(c)] + [(k, len(CLASSES), "", n) for k, n in totals.items()])

    found = (docs.select(F.col(lang).cast("string"), F.col(text).cast("string")).mapInArrow(count, "lang string, kind int, word string, n long")
             .groupBy("lang", "kind", "word").agg(F.sum("n").alias("n")))
    found = settle(found, "quality-references")
    sizes = found.where(F.col("kind") == len(CLASSES)).select("lang", F.col("n").alias("total"))
    big = {r.lang: r.total for r in sizes.collect() if r.total}
    if not big:
        return {"langs": [], "classes": np.zeros((0, len(CLASSES))), "words": []}
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    common = found.where(F.col("kind") > len(CLASSES)).withColumn("place", place).where(F.col("place") <= COMMON).drop("place")
    best = [r for r in found.where(F.col("kind") < len(CLASSES)).union(common).collect() if r.lang in big]
    langs = sorted(big)
    row = {k: i for i, k in enumerate(langs)}
    classes = np.zeros((len(langs), len(CLASSES)))
    words: list[dict] = [{} for _ in langs]
    for r in best:
        i = row[r.lang]
        if r.kind < len(CLASSES):
            classes[i, r.kind] = r.n
        else:
            words[i][r.word.encode()] = r.n / big[r.lang]
    return {"langs": langs, "classes": classes / classes.sum(1, keepdims=True), "words": words}


class Judge:
    """Statistics and verdict of texts against references."""

    def __init__(self, references: dict):
        self.classes = references["classes"]
        self.bins: dict[bytes, list[tuple[int, int]]] = {}
        wide = max((len(w) for w in references["words"]), default=0)
        self.words = np.zeros((len(references["words"]), wide + 1))
        for i, shares in enumerate(references["words"]):
            for j, (w, share) in enumerate(sorted(shares.items())):
                self.words[i, j] = share
                self.bins.setdefault(w, []).append((i, j))
            self.words[i, -1] = max(0.0, 1 - self.words[i].sum())

    def distances(self, text: bytes, words: list[bytes]) -> tuple[float | None, float | None]:
        """(characters, words) to the nearest reference; None where a guard or the lack of references forbids it."""
        if not len(self.classes):
            return None, None
        counts = class_counts(text)
        by_class = by_word = None
        if counts.sum() >= CLASS_CHARS:
            by_class = float(js_distance(counts / counts.sum(), self.classes).min())
        if len(words) >= WORD_WORDS:
            seen = Counter(text.lower().split())
            mine = np.zeros_like(self.words)
            for w in self.bins.keys() & seen.keys():
                for i, j in self.bins[w]:
                    mine[i, j] = seen[w]
            mine[:, -1] = len(words) - mine.sum(1)
            by_word = float(js_distance(mine / len(words), self.words).min())
        return by_class, by_word

    def rows(self, texts: list[bytes | None]) -> list[list]:
        out = []
        for t in texts:
            t = t or b""
            words = t.split()
            stats = statistics(t, words)
            failed = stats[0] < MIN_WORDS or 100 * stats[4] > MAX_REPEATED * stats[0]
            by_class, by_word = self.distances(t, words)
            kept = not (failed or (by_class or 0) > CLASS_LIMIT or (by_word or 0) > WORD_LIMIT)
            out.append((*stats, failed, kept, by_class, by_word))
        return [list(c) for c in zip(*out)]


FIELDS = [StructField(n, LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [
    StructField("base_failed", BooleanType()), StructField("kept", BooleanType()),
    StructField("class_distance", DoubleType()), StructField("word_distance", DoubleType())]


def judge_quality(docs: DataFrame, references: dict, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` plus the statistics, base_failed, kept and the two distances (null under a guard).

    A null text has no words and fails.  Repeated rows get equal results; without
    references (an empty table, no language known) only the base rules judge.
    """
    held = docs.sparkSession.sparkContext.broadcast(references)
    return add_columns(docs, FIELDS, lambda: Judge(held.value).rows, keep, text)


def keep_good(docs: DataFrame, references: dict, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``judge_quality`` keeps, with all their columns."""
    held = docs.sparkSession.sparkContext.broadcast(references)
    place = [f.name for f in FIELDS].index("kept")
    return keep_rows(docs, lambda: lambda texts, rows=Judge(held.value).rows: rows(texts)[place], text)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return judge_quality(docs, language_references(docs), ["doc_id"])
