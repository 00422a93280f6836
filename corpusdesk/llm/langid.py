"""Language ID: script ranges narrow the candidates, then Viterbi over per-word scores.

A word's score in a language is the log likelihood of its character trigrams.
The script of a word rules out languages that hardly use it.  The path of
languages through a text pays ``SWITCH`` for each change, so that a foreign name
does not break a span but a foreign sentence does; spans of mixed texts come out
labelled, and the text's language is the one whose spans hold most letters.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from corpusdesk.llm.common import add_columns, blocks, documents, held_out, settle, worker_store

LANG_ROWS = 5_000  # about so many rows of each language, chosen by a hash of the id, teach the model; all of a smaller one
GRAMS, LANG_GRAMS = 60_000, 3_000  # trigrams in the model: each language gives its share of GRAMS, at least LANG_GRAMS
SWITCH = 12.0
OTHER_SCRIPT = -60.0
ALPHA = 0.5
WORDS = 300_000  # words whose scores a worker keeps, fewer beyond 30 languages
CELLS = 30_000_000  # words times languages that are looked at in one go
UNKNOWN = "und"

# First code point of ranges of scripts; "" holds what is none of these.
SCRIPTS = (
    (0x0041, "latin"), (0x0250, "latin"), (0x02B0, ""), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"),
    (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, ""), (0x0750, "arabic"), (0x0780, ""), (0x08A0, "arabic"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"),
    (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"),
    (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1380, ""), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, ""),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, ""), (0x2E80, "han"), (0x3040, "kana"), (0x3100, "han"),
    (0x3130, "hangul"), (0x3190, "han"), (0xA000, ""), (0xAC00, "hangul"), (0xD7B0, ""), (0xF900, "han"), (0xFB00, ""),
    (0x20000, "han"), (0x323B0, ""),
)
STARTS = [a for a, _ in SCRIPTS]

#: ASCII other than letters becomes a blank; A-Z become a-z.
TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def script_of(word: str) -> str | None:
    """The script of the first letter; None without a letter."""
    for c in word:
        if c.isalpha():
            i = bisect_right(STARTS, ord(c)) - 1
            return SCRIPTS[i][1] if i >= 0 else ""
    return None


def trigrams(word: str) -> list[str]:
    padded = f" {word} "
    return [padded[i:i + 3] for i in range(len(padded) - 2)]


def train(docs: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id") -> dict:
    """The model of rows with a language; counts are summed in each task before they move."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"), F.pmod(F.xxhash64(key), F.lit(1 << 30)).alias("h"))
    sizes = settle(known.groupBy("lang").agg(F.count(F.lit(1)).alias("size")), "language-sizes")
    some = known.join(F.broadcast(sizes), "lang").where(F.col("h") * F.col("size") < F.lit(LANG_ROWS << 30))

    def count(batches):
        words = {}
        for batch in batches:
            langs = batch.column(0)
            for start, part in blocks(batch.column(1)):
                for k, t in zip(langs.slice(start, len(part)).to_pylist(), part):
                    words.setdefault(k, Counter()).update(t.translate(TO_WORDS).split())
        out = []
        for k, held in words.items():
            grams, scripts = Counter(), Counter()
            for w, n in held.items():
                w = w.decode()
                if (script := script_of(w)) is not None:
                    scripts[script] += n
                    for g in trigrams(w):
                        grams[g] += n
            out += [(k, "script", s, n) for s, n in scripts.items()] + [(k, "gram", g, n) for g, n in grams.items()]
        columns = list(zip(*out)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(),) * 3 + (pa.int64(),))], names=["lang", "kind", "item", "n"])

    counts = settle(some.select("lang", "text")
                    .mapInArrow(count, "lang string, kind string, item string, n long")
                    .groupBy("lang", "kind", "item").agg(F.sum("n").alias("n")), "language-counts")
    mine = counts.where("kind = 'gram'")
    langs = sorted(r.lang for r in mine.select("lang").distinct().collect())
    each = max(LANG_GRAMS, GRAMS // max(1, len(langs)))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "item"))
    best = mine.withColumn("rank", rank).where(F.col("rank") <= each).select("item").distinct()
    found = mine.join(best, "item", "left_semi").collect()
    place = {k: i for i, k in enumerate(langs)}
    grams: dict[str, int] = {}
    for r in found:
        grams.setdefault(r["item"], len(grams))
    table = np.zeros((len(grams) + 1, len(langs)))  # the last row is that of unknown trigrams
    for r in found:
        table[grams[r["item"]], place[r.lang]] = r.n
    totals = np.maximum(1, table.sum(0))
    floor = ALPHA / totals.max(initial=1)  # the same for all: a trigram that no language knows must not speak for a small one
    logs = np.log((table / totals + floor) / (1 + floor * len(table)))
    scripts: dict[str, np.ndarray] = {}
    for r in counts.where("kind = 'script'").collect():
        scripts.setdefault(r["item"], np.zeros(len(langs)))[place[r.lang]] = r.n
    per_lang = sum(scripts.values()) if scripts else np.ones(len(langs))
    masks = {s: np.where(n >= 0.01 * per_lang, 0.0, OTHER_SCRIPT) for s, n in scripts.items() if (n >= 0.01 * per_lang).any()}
    return {"langs": langs, "grams": grams, "logs": logs.astype(np.float32), "masks": masks}


def best_paths(scores: np.ndarray, sizes: list[int], switch: float = SWITCH) -> np.ndarray:
    """The state of each row on the best path of its sequence; sequences of ``sizes`` rows stand one after another.

    All sequences advance together, a step per row: step t of the longest ones
    first, so each step works on a prefix.
    """
    sizes_ = np.array(sizes)
    order = np.argsort(-sizes_, kind="stable")
    starts = (np.cumsum(sizes_) - sizes_)[order]
    lengths = sizes_[order]
    steps = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")  # sequences longer than t
    at = np.concatenate(([0], np.cumsum(active)))
    rows = np.empty(at[-1], np.int64)
    for t in range(steps):
        rows[at[t]:at[t + 1]] = starts[:active[t]] + t
    held = scores[rows]  # by step
    for t in range(1, steps):
        before = held[at[t - 1]:at[t - 1] + active[t]]
        floor = before.max(axis=1, keepdims=True)
        floor -= switch
        held[at[t]:at[t + 1]] += np.maximum(before, floor)
    top = held.argmax(axis=1)
    stay = held >= held.max(axis=1, keepdims=True) - switch
    states = np.empty(at[-1], np.int64)
    for t in range(steps - 1, -1, -1):
        n, later = active[t], active[t + 1] if t + 1 < steps else 0
        best = top[at[t]:at[t + 1]].copy()
        if later:
            after = states[at[t + 1]:at[t + 2]]
            best[:later] = np.where(stay[at[t]:at[t] + later][np.arange(later), after], after, best[:later])
        states[at[t]:at[t] + n] = best
    out = np.empty(len(scores), np.int64)
    out[rows] = states
    return out


class Labeller:
    def __init__(self, model: dict):
        self.langs, self.grams, self.logs, self.masks = model["langs"], model["grams"], model["logs"], model["masks"]
        self.forget()

    def forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.scores = np.zeros((1024, len(self.langs)), np.float32)
        self.letters = np.zeros(1024, np.int32)

    def learn(self, words: set[bytes]) -> None:
        if len(self.index) + len(words) > WORDS * min(1, 30 / max(1, len(self.langs))):
            self.forget()
        new = [w for w in words if w not in self.index]
        first = len(self.index)
        need = first + len(new)
        if need > len(self.letters):
            grown = max(need, 2 * len(self.letters))
            self.scores = np.concatenate((self.scores, np.zeros((grown - len(self.scores), len(self.langs)), np.float32)))
            self.letters = np.concatenate((self.letters, np.zeros(grown - len(self.letters), np.int32)))
        get, unknown = self.grams.get, len(self.logs) - 1
        flat, edges, rows = [], [], []
        for i, raw in enumerate(new, first):
            self.index[raw] = i
            w = raw.decode()
            script = "latin" if w.isascii() else script_of(w)
            if script is None:
                self.letters[i] = 0
                self.scores[i] = 0
                continue
            self.letters[i] = len(w) if w.isalpha() else sum(map(str.isalpha, w))
            rows.append(i)
            edges.append(len(flat))
            flat += [get(g, unknown) for g in trigrams(w)]
            self.scores[i] = self.masks.get(script, 0)
        for k in range(0, len(rows), 50_000):
            part = edges[k:k + 50_000]
            end = edges[k + 50_000] if k + 50_000 < len(edges) else len(flat)
            sums = np.add.reduceat(self.logs[flat[part[0]:end]], np.array(part) - part[0], axis=0)
            self.scores[rows[k:k + 50_000]] += sums

    def rows(self, texts: list[bytes | None]) -> list[list]:
        """[language, score, number of spans, spans as (language, first word, words)] of each text."""
        words = [(t or b"").translate(TO_WORDS).split() for t in texts]
        if len(texts) > 1 and sum(map(len, words)) * len(self.langs) > CELLS:
            half = len(texts) // 2
            return [a + b for a, b in zip(self.rows(texts[:half]), self.rows(texts[half:]))]
        self.learn(set().union(*words))
        sizes = [len(w) for w in words]
        ids = np.fromiter((i for w in words for i in map(self.index.__getitem__, w)), np.int64, sum(sizes))
        letters = self.letters[ids]
        states = best_paths(self.scores[ids], sizes) if self.langs else None
        out, a = [], 0
        for n in sizes:
            mine = letters[a:a + n]
            total = int(mine.sum())
            if not total or states is None:
                out.append((UNKNOWN, 0.0, []))
            else:
                s = states[a:a + n]
                per = np.bincount(s, weights=mine, minlength=len(self.langs))
                best = int(per.argmax())
                cuts = np.concatenate(([0], np.flatnonzero(np.diff(s)) + 1, [n])).tolist()
                out.append((self.langs[best], float(per[best] / total), [(self.langs[s[i]], i, j - i) for i, j in zip(cuts[:-1], cuts[1:])]))
            a += n
        return [list(c) for c in zip(*out)]


FIELDS = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("spans", ArrayType(StructType(
    [StructField("lang", StringType()), StructField("from_word", LongType()), StructField("n_words", LongType())])))]


def label_languages(docs: DataFrame, model: dict, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` plus lang_pred, score (the share of letters in its spans) and the spans of every whole text.

    ``und`` with score 0 for a text that is null or has no letters, and for all
    texts if nothing taught a language.  Words are runs of letters.
    """
    held, made = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def make():
        store = worker_store("langid")
        if store.get("of") != made:
            store.update(of=made, labeller=Labeller(held.value))
        return store["labeller"].rows

    return add_columns(docs, FIELDS, make, keep, text)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    test = held_out(F.col("doc_id"), 4, 2)
    model = train(docs.where(~test))
    return label_languages(docs, model, ["doc_id"]).select("doc_id", test.alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))
