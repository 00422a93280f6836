"""Toxicity: a convolutional text classifier with thresholds calibrated by language.

A word's embedding is the sum of the embeddings of its features, the word itself
and its beginnings, each known by a 32-bit hash.  Filters of several widths slide
over the words of a text, max pooling keeps each filter's strongest answer, and a
logistic layer weighs them.  Training is plain numpy on a bounded sample.  A text's
language is told by its own common words, and each language has a threshold of
its own; the score is shifted so that 0.5 is the threshold.
"""

from __future__ import annotations

import uuid
import zlib
import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField

from corpusdesk.llm.common import add_columns, documents, held_out, keep_rows, worker_store

TRAIN_ROWS = 8_000  # about so many labelled rows, chosen by a hash of the id, teach the model
TRAIN_CHARS = 20_000  # rows that teach are at most so long
MIN_DOCS = 4  # features of fewer of them have no embedding
DIM, WIDTHS, FILTERS = 12, (1, 2, 3), 8
PREFIXES = (4, 5, 6)
EPOCHS, BATCH, RATE, DECAY = 6, 64, 0.02, 1e-4
CALIBRATES = 5  # one in so many rows calibrates instead
CLEAN_WEIGHT = 3.0  # a clean text that is called toxic weighs so many toxic ones that are missed
MIN_TOXIC = 15  # a language needs so many toxic rows for a threshold of its own
COMMON = 150  # words that tell a language
WORDS = 120_000  # words that a worker keeps

#: ASCII other than digits and letters becomes a blank; A-Z become a-z.
TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TO_WORDS).split()


def features(word: bytes) -> list[int]:
    w = word if word.isascii() else word.decode(errors="ignore")
    out = [zlib.crc32(b"=" + word)]
    for k in PREFIXES:
        if len(w) >= k:
            start = w[:k]
            out.append(zlib.crc32(b"^%d" % k + (start if isinstance(start, bytes) else start.encode())))
    return out


def join(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all texts, each followed by blanks so that every filter fits, and where each text begins."""
    gap = np.zeros(max(WIDTHS), np.int32)
    parts = [x for d in docs for x in (d, gap)]
    sizes = np.array([len(d) + len(gap) for d in docs])
    return np.concatenate(parts), np.cumsum(sizes) - sizes


def inside(answers: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Rules out the places from which a filter would reach into the next text."""
    ends = np.append(starts[1:], len(answers))
    for j in range(1, width):
        answers[ends - j] = -np.inf
    return answers


class Network:
    def __init__(self, n_features: int, prior: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.e = rng.normal(0, 0.05, (n_features, DIM))
        self.e[:, 0] += prior  # what the counts already say about each feature
        self.e[0] = 0
        self.w = {k: rng.normal(0, 0.1, (k, DIM, FILTERS)) for k in WIDTHS}
        for k in WIDTHS:
            self.w[k][:, 0, :FILTERS // 2] += 0.5 / k
        self.b = {k: np.zeros(FILTERS) for k in WIDTHS}
        self.out = np.full(len(WIDTHS) * FILTERS, 0.1)
        self.bias = -1.0

    def answers(self, x: np.ndarray, k: int) -> np.ndarray:
        total = self.b[k] + x @ self.w[k][0]
        for j in range(1, k):
            total[:-j] += x[j:] @ self.w[k][j]
        return total

    def fit(self, docs: list[np.ndarray], table: np.ndarray, y: np.ndarray, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        squares = {id(p): np.full(p.shape, 1e-6) for p in (self.e, self.out, *self.w.values(), *self.b.values())}
        bias_sq = 1e-6
        weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))

        def step(p: np.ndarray, grad: np.ndarray, rows=slice(None)) -> None:
            s = squares[id(p)]
            s[rows] += grad ** 2
            p[rows] -= RATE * grad / np.sqrt(s[rows])

        for _ in range(EPOCHS):
            order = rng.permutation(len(docs))
            for at in range(0, len(order), BATCH):
                batch = order[at:at + BATCH]
                ids, starts = join([docs[i] for i in batch])
                feats = table[ids]
                x = self.e[feats].sum(axis=1)
                ends = np.append(starts[1:], len(ids))
                held, tops = [], {}
                for k in WIDTHS:
                    a = inside(self.answers(x, k), starts, k)
                    tops[k] = np.array([s + a[s:t].argmax(axis=0) for s, t in zip(starts, ends)])
                    held.append(np.take_along_axis(a, tops[k], axis=0))
                h = np.concatenate(held, axis=1)
                z = np.tanh(h)
                p = 1 / (1 + np.exp(-(z @ self.out + self.bias)))
                g = (p - y[batch]) * weight[batch] / len(batch)
                grad_out, grad_bias = z.T @ g + DECAY * self.out, g.sum()
                gh = g[:, None] * self.out * (1 - z ** 2)
                rows, grads, steps = [], [], []
                for n, k in enumerate(WIDTHS):
                    gk = gh[:, n * FILTERS:(n + 1) * FILTERS]
                    gw = np.empty_like(self.w[k])
                    for j in range(k):
                        at_ = np.minimum(tops[k] + j, len(ids) - 1)
                        gw[j] = np.einsum("bfd,bf->df", x[at_], gk)
                        rows.append(feats[at_].reshape(-1, feats.shape[1]))
                        grads.append((gk[:, :, None] * self.w[k][j].T[None]).reshape(-1, DIM))
                    steps.append((self.w[k], gw + DECAY * self.w[k]))
                    steps.append((self.b[k], gk.sum(axis=0)))
                rows_, grads_ = np.concatenate(rows), np.concatenate(grads)
                touched, inverse = np.unique(rows_, return_inverse=True)
                total = np.zeros((len(touched), DIM))
                np.add.at(total, inverse.reshape(rows_.shape), grads_[:, None, :])
                step(self.e, total, touched)
                self.e[0] = 0
                for param, grad in steps:
                    step(param, grad)
                step(self.out, grad_out)
                bias_sq += grad_bias ** 2
                self.bias -= RATE * grad_bias / np.sqrt(bias_sq)

    def freeze(self) -> dict:
        """Per feature what it adds to each filter at each place, so that words are looked up, not multiplied."""
        kernel = np.concatenate([self.w[k][j] for k in WIDTHS for j in range(k)], axis=1)
        return {"adds": (self.e @ kernel).astype(np.float32), "b": {k: v.astype(np.float32) for k, v in self.b.items()},
                "out": self.out.astype(np.float32), "bias": float(self.bias)}


def logits(frozen: dict, adds: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """``adds``: by word number, what the word adds to each filter at each place."""
    held, column = [], 0
    for k in WIDTHS:
        total = frozen["b"][k] + adds[ids, column:column + FILTERS]
        for j in range(1, k):
            total[:-j] += adds[ids[j:], column + j * FILTERS:column + (j + 1) * FILTERS]
        held.append(np.maximum.reduceat(inside(total, starts, k), starts, axis=0))
        column += k * FILTERS
    return np.tanh(np.concatenate(held, axis=1)) @ frozen["out"] + frozen["bias"]


def cut(values: np.ndarray, toxic: np.ndarray) -> float:
    """The threshold with the least weighted error rate, in the middle of its gap."""
    order = np.argsort(values, kind="stable")
    v, t = values[order], toxic[order].astype(float)
    missed = np.concatenate(([0], np.cumsum(t))) / max(t.sum(), 1)
    wrong = ((1 - t).sum() - np.concatenate(([0], np.cumsum(1 - t)))) / max((1 - t).sum(), 1)
    cost = missed + CLEAN_WEIGHT * wrong
    cost[1:-1][v[1:] == v[:-1]] = np.inf
    i = int(cost.argmin())
    return float(v[0] - 1 if i == 0 else v[-1] + 1 if i == len(v) else (v[i - 1] + v[i]) / 2)


def train(rows: DataFrame, text: str = "text", label: str = "toxic", lang: str = "lang", key: str = "doc_id") -> dict | None:
    """The model of labelled rows; None unless there are rows of both labels."""
    known = rows.where(F.col(label).isin(0, 1) & F.col(text).isNotNull() & (F.length(text) <= TRAIN_CHARS))
    known = known.select(F.col(text).cast("string").alias("text"), F.col(label).cast("int").alias("label"),
                         F.col(lang).cast("string").alias("lang"), F.pmod(F.xxhash64(key, text), F.lit(1 << 40)).alias("h"))
    share = min(1.0, TRAIN_ROWS / max(1, known.count()))
    # texts become numbers of words at once: the driver holds a few bytes per word of the sample
    index: dict[bytes, int] = {b"": 0}
    docs, labels, langs = [], [], []
    for r in known.where(F.col("h") < int(share * (1 << 40))).orderBy("h", "text").toLocalIterator():
        words = words_of(r.text.encode())
        docs.append(np.fromiter((index.setdefault(w, len(index)) for w in words), np.int32, len(words)))
        labels.append(r.label)
        langs.append(r.lang)
    y = np.array(labels, float)
    fits = np.arange(len(docs)) % CALIBRATES != 0
    if not docs or not 0 < y[fits].sum() < fits.sum():
        return None
    hashes = feature_hashes(index)
    frequent, n, n_toxic = feature_counts(hashes, docs, fits, y)
    odds = np.log((n_toxic + 0.5) / (y[fits].sum() + 1)) - np.log((n - n_toxic + 0.5) / ((1 - y[fits]).sum() + 1))
    prior = np.concatenate(([0], np.clip(odds * n / (n + 10), -4, 4) * 0.25))
    # feature hash -> index of its embedding; 0 for rare ones and for the gaps of short words
    place = np.searchsorted(frequent, hashes).clip(max=max(len(frequent) - 1, 0))
    table = np.where((hashes >= 0) & (frequent[place] == hashes), place + 1, 0) if len(frequent) else np.zeros_like(hashes)
    network = Network(len(frequent) + 1, prior)
    network.fit([d for d, f in zip(docs, fits) if f], table, y[fits])
    frozen = network.freeze()
    model = frozen | {"id": uuid.uuid4().hex, "features": {int(h): i for i, h in enumerate(frequent, 1)}} | common_words(index, docs, langs)
    checks = np.flatnonzero(~fits) if (~fits).sum() and 0 < y[~fits].sum() < (~fits).sum() else np.arange(len(docs))
    adds = np.concatenate([frozen["adds"][table[i:i + 20_000]].sum(axis=1) for i in range(0, len(table), 20_000)])
    tells = np.zeros((len(index), len(model["langs"])), np.float32)
    for w, told in model["tells"].items():
        tells[index[w]] = told
    values, guessed = judged(model, adds, tells, [docs[i] for i in checks])
    toxic = y[checks] > 0
    model["cuts"] = {None: cut(values, toxic)}
    for i in range(len(model["langs"])):
        mine = guessed == i
        if toxic[mine].sum() >= MIN_TOXIC and (~toxic[mine]).any():
            model["cuts"][i] = cut(values[mine], toxic[mine])
    return model


def feature_hashes(words) -> np.ndarray:
    """One row of feature hashes per word, in their order; -1 where a word is too short."""
    width = 1 + len(PREFIXES)
    out = np.full((len(words), width), -1, np.int64)
    for i, w in enumerate(words):
        if w:
            found = features(w)
            out[i, :len(found)] = found
    return out


def feature_counts(hashes: np.ndarray, docs: list[np.ndarray], fits: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the features of at least MIN_DOCS rows that fit, rows of each, toxic rows of each)."""
    def seen(chosen) -> tuple[np.ndarray, np.ndarray]:
        parts = [np.unique(hashes[np.unique(docs[i])]) for i in chosen]
        return np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    found, n = seen(np.flatnonzero(fits))
    frequent = (found >= 0) & (n >= MIN_DOCS)
    found, n = found[frequent], n[frequent]
    toxic, n_toxic = seen(np.flatnonzero(fits & (y > 0)))
    counts = np.zeros(len(found), np.int64)
    common, at, of = np.intersect1d(found, toxic, return_indices=True)
    counts[at] = n_toxic[of]
    return found, n, counts


def common_words(index: dict[bytes, int], docs: list[np.ndarray], langs: list[str | None]) -> dict:
    """{"langs", "tells": word -> log share by language} of the common words of each language."""
    words = list(index)
    counts: dict[str, np.ndarray] = {}
    for ids, lang in zip(docs, langs):
        if lang is not None and len(ids):
            counts.setdefault(lang, np.zeros(len(words), np.int32))
            np.add.at(counts[lang], ids, 1)
    names = sorted(counts)
    common = sorted({i for k in names for i in sorted(np.argpartition(-counts[k], min(COMMON, len(words) - 1))[:COMMON].tolist())})
    shares = np.array([[(counts[k][i] + 0.5) / (counts[k].sum() + 1) for k in names] for i in common])
    return {"langs": names, "tells": {words[i]: t for i, t in zip(common, np.log(shares).astype(np.float32))} if common else {}}


def judged(model: dict, adds: np.ndarray, tells: np.ndarray, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(logit, guessed language or -1) of texts as word numbers."""
    ids, starts = join(docs)
    out = logits(model, adds, ids, starts)
    if not tells.shape[1]:
        return out, np.full(len(docs), -1)
    told = np.add.reduceat(tells[ids], starts, axis=0)
    return out, np.where((told != 0).any(axis=1), told.argmax(axis=1), -1)


class Scorer:
    """Scores texts; of each word it has met it keeps what the word adds to the filters and tells about languages."""

    def __init__(self, model: dict):
        self.model, self.n_langs = model, len(model["langs"])
        self.forget()

    def forget(self) -> None:
        self.index: dict[bytes, int] = {b"": 0}
        self.adds = np.zeros((1024, self.model["adds"].shape[1]), np.float32)
        self.tells = np.zeros((1024, self.n_langs), np.float32)

    def learn(self, words: set[bytes]) -> None:
        new = [w for w in words if w not in self.index]
        if len(self.index) + len(new) > WORDS:
            self.forget()
            new = [w for w in words if w]
        first, need = len(self.index), len(self.index) + len(new)
        if need > len(self.adds):
            more = max(need, len(self.adds) * 3 // 2) - len(self.adds)
            self.adds = np.concatenate((self.adds, np.zeros((more, self.adds.shape[1]), np.float32)))
            self.tells = np.concatenate((self.tells, np.zeros((more, self.n_langs), np.float32)))
        get, tells, width = self.model["features"].get, self.model["tells"], 1 + len(PREFIXES)
        for a in range(0, len(new), 20_000):
            part = new[a:a + 20_000]
            rows = np.zeros((len(part), width), np.int64)
            for i, w in enumerate(part):
                self.index[w] = first + a + i
                found = [get(f, 0) for f in features(w)]
                rows[i, :len(found)] = found
                if w in tells:
                    self.tells[first + a + i] = tells[w]
            self.adds[first + a:first + a + len(part)] = self.model["adds"][rows].sum(axis=1)

    def values(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """(logit, guessed language or -1) of each text."""
        self.learn(set().union(*texts))
        get = self.index.__getitem__
        return judged(self.model, self.adds, self.tells, [np.fromiter(map(get, words), np.int64, len(words)) for words in texts])

    def rows(self, texts: list[bytes | None]) -> list[list]:
        out, guessed = self.values([words_of(t) for t in texts])
        cuts = self.model["cuts"]
        limits = np.array([cuts.get(int(i), cuts[None]) for i in guessed])
        scores = 1 / (1 + np.exp(-(out.astype(float) - limits)))
        langs = [self.model["langs"][i] if i >= 0 else None for i in guessed]
        return [scores.tolist(), (scores >= 0.5).astype(int).tolist(), langs]


FIELDS = [StructField("score", DoubleType()), StructField("predicted", IntegerType()), StructField("told_lang", StringType())]


def score_toxicity(docs: DataFrame, model: dict | None, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` plus score, predicted (1 from 0.5 on) and the language by whose threshold it was judged.

    A null or empty text is scored like a text without known words.  Without a model
    (no labelled rows of both kinds) every score is 0.
    """
    return add_columns(docs, FIELDS, scorer_of(docs, model), keep, text)


def keep_clean(docs: DataFrame, model: dict | None, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted to be toxic, with all their columns."""
    make = scorer_of(docs, model)
    return keep_rows(docs, lambda: lambda texts, rows=make(): [p == 0 for p in rows(texts)[1]], text)


def scorer_of(docs: DataFrame, model: dict | None):
    """A maker of the function from a block of texts to FIELDS; workers keep the words they have met."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    made = model["id"] if model else None

    def make():
        if made is None:
            return lambda texts: [[0.0] * len(texts), [0] * len(texts), [None] * len(texts)]
        store = worker_store("toxicity")
        if store.get("of") != made:
            store.update(of=made, scorer=Scorer(held.value))
        return store["scorer"].rows

    return make


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that may teach: labelled documents outside the held-out part."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    labels = documents(spark, sf_dir, "labels").select("doc_id", "toxic")
    return docs.where(~held_out(F.col("doc_id"), 5, 0)).join(labels, "doc_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(documents(spark, sf_dir), train(labelled(spark, sf_dir)), ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")
