"""URL filters: rules first, else a ratio of character language models.

Two smoothed variable-order Markov models, of accepted and of rejected URLs, give
each character (byte of UTF-8) a probability after its last ``ORDER`` ones: every
order falls back to the next shorter one in the proportion in which its context met
new characters.  The difference of the two log likelihoods, divided by the number
of characters, is compared with a threshold that is calibrated on URLs which the
models have not seen.

All URLs that rules judge are counted, and every count is used.  The contexts seen
most often, with all their successors, are broadcast as far as ``MODEL_GRAMS``
sequences go.  Counts beyond that stay in tables: the sequences of each distinct URL
that the broadcast part does not hold are joined with them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusdesk.llm.common import discard, documents, settle, without, worker_store

ORDER = 5
MODEL_GRAMS = 400_000  # sequences of a model that are broadcast; the others are joined
HELD = 5  # one judged URL in so many, by its hash, calibrates instead
ALPHABET = 256
START, END = 0xFF, 0xFE  # bytes that UTF-8 never has
PLACES = 1 << 18  # places of URLs that are looked at in one go
URLS = 256  # URLs whose joined counts a task holds at once
LIMIT, DIGITS = 20.0, 3  # calibrating ratios are counted in cells of 0.001 between -20 and 20
ALLOW, BLOCK = "allow", "block"

# Fixed values: (verdict, host, start of the path); a rule also fits all subdomains.
RULES = (
    (ALLOW, "com", "/"),
    (BLOCK, "example.com", "/en/"),
    (ALLOW, "www.example.com", "/en/"),
    (BLOCK, "net", "/es/"),
    (BLOCK, "net", "/fr/"),
)


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end; A-Z lower-cased; empty if there is none."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null without one."""
    rule = verdict = None
    for kind, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def padded(urls: list[bytes]) -> np.ndarray:
    """The bytes of all URLs, each behind ORDER marks of the start and before one of the end."""
    return np.frombuffer(b"".join(bytes([START]) * ORDER + u + bytes([END]) for u in urls), np.uint8)


def sequences(data: np.ndarray) -> Iterator[tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """(places, per order: numbers of the sequence that ends there and of its context), for blocks of places.

    A number holds the at most six bytes and above them their count, so it is exact.
    """
    for low in range(0, len(data), PLACES):
        at = low + np.flatnonzero(data[low:low + PLACES] != START)
        held = np.zeros(len(at), np.int64)
        orders = []
        for k in range(ORDER + 1):
            held = held | data[at - k].astype(np.int64) << 8 * k
            orders.append((held | k + 1 << 48, held >> 8 | k << 48))
        yield at, orders


def look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Values of the wanted keys (``keys`` ascend), zero for those that are not there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


class Rest:
    """Counts from rows (gram, n, context, total, kinds), repeats allowed."""

    def __init__(self, gram: np.ndarray, n: np.ndarray, context: np.ndarray, total: np.ndarray, kinds: np.ndarray):
        self.grams, at = np.unique(gram, return_index=True)
        self.counts = n[at]
        self.contexts, at = np.unique(context, return_index=True)
        self.totals, self.kinds = total[at], kinds[at]


class Markov:
    """Counts of sequences (all successors of each context that is held) as a smoothed model."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        order = np.argsort(grams)
        self.grams, self.counts = grams[order], counts[order]
        context = ((self.grams & (1 << 48) - 1) >> 8) | (self.grams >> 48) - 1 << 48
        self.contexts, first = np.unique(context, return_inverse=True)
        self.totals = np.bincount(first, self.counts, len(self.contexts)).astype(np.int64)
        self.kinds = np.bincount(first, minlength=len(self.contexts)).astype(np.int64)

    def lacking(self, urls: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(URL, sequence, context): all whose context this model does not hold."""
        data = padded(urls)
        owner = np.repeat(np.arange(len(urls)), [len(u) + ORDER + 1 for u in urls])
        found = [(owner[at], gram, context, look_up(self.contexts, self.totals, context) == 0)
                 for at, orders in sequences(data) for gram, context in orders]
        return tuple(np.concatenate([f[i][f[3]] for f in found]) if found else np.empty(0, np.int64) for i in range(3))

    def log(self, urls: list[bytes], more: Rest | None = None) -> np.ndarray:
        """Log likelihood of each URL with its end; ``more`` has counts of contexts that this model does not hold."""
        data = padded(urls)
        owner = np.repeat(np.arange(len(urls)), [len(u) + ORDER + 1 for u in urls])
        out = np.zeros(len(urls))
        for at, orders in sequences(data):
            p, open_ = np.full(len(at), 1 / ALPHABET), np.ones(len(at), bool)
            for gram, context in orders:
                total = look_up(self.contexts, self.totals, context)
                kinds = look_up(self.contexts, self.kinds, context)
                seen = look_up(self.grams, self.counts, gram)
                if more is not None:
                    total += look_up(more.contexts, more.totals, context)
                    kinds += look_up(more.contexts, more.kinds, context)
                    seen += look_up(more.grams, more.counts, gram)
                open_ &= total > 0
                longer = (seen + kinds * p) / np.maximum(total + kinds, 1)
                p = np.where(open_, longer, p)
            out += np.bincount(owner[at], np.log(p), len(urls))
        return out


class Ratio:
    """Length-normalised log-likelihood difference; positive speaks for an accepted URL."""

    def __init__(self, model: dict):
        self.allow, self.block = Markov(*model[ALLOW]), Markov(*model[BLOCK])
        self.known = model.get("known", len(model[ALLOW][0]) > 0 and len(model[BLOCK][0]) > 0)

    def __call__(self, urls: list[bytes | None], more: dict[bool, Rest] | None = None) -> np.ndarray:
        """Zero for null and empty URLs and without examples of both kinds."""
        urls = [u or b"" for u in urls]
        sizes = np.array([len(u) for u in urls], np.int64)
        if not self.known or not sizes.any():
            return np.zeros(len(urls))
        more = more or {}
        return np.where(sizes > 0, (self.allow.log(urls, more.get(True)) - self.block.log(urls, more.get(False))) / np.maximum(sizes, 1), 0.0)


def threshold(values: np.ndarray, allowed: np.ndarray, rows: np.ndarray | None = None) -> float:
    """The cut with the best mean accuracy over both classes (the middle of the gap); 0 without examples of both.

    ``rows`` tells how many examples each value stands for (one by default).
    """
    if allowed.all() or not allowed.any():
        return 0.0
    order = np.argsort(values, kind="stable")
    v, a = values[order], allowed[order]
    n = np.ones(len(v)) if rows is None else rows[order].astype(float)
    good, bad = n * a, n * ~a
    right = np.concatenate(([0], np.cumsum(bad))) / bad.sum() + (good.sum() - np.concatenate(([0], np.cumsum(good)))) / good.sum()
    right[1:-1][v[1:] == v[:-1]] = -1  # no cut between equal values
    i = int(right.argmax())
    return float(v[0] - 1 if i == 0 else v[-1] + 1 if i == len(v) else (v[i - 1] + v[i]) / 2)


def count_sequences(urls: DataFrame) -> DataFrame:
    """(allow, gram, n) over all rows of (url as bytes, allow); counted in each batch before anything moves."""

    def count(batches):
        for batch in batches:
            allowed = batch.column(1)
            for kind in (True, False):
                data = padded(batch.column(0).filter(pc.equal(allowed, kind)).to_pylist())
                for _, orders in sequences(data):
                    for gram, _ in orders:
                        grams, n = np.unique(gram, return_counts=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(grams), kind)), pa.array(grams), pa.array(n.astype(np.int64))], names=["allow", "gram", "n"])

    return urls.mapInArrow(count, "allow boolean, gram long, n long").groupBy("allow", "gram").agg(F.sum("n").alias("n"))


def scores(url: Column, model: dict, spark: SparkSession) -> Column:
    """The ratio of a URL given as bytes."""
    held, made = spark.sparkContext.broadcast(model), uuid.uuid4().hex

    @F.pandas_udf("double")
    def ratio(urls: pd.Series) -> pd.Series:
        store = worker_store("urlfilter")
        if store.get("of") != made:
            store.update(of=made, ratio=Ratio(held.value))
        return pd.Series(store["ratio"](urls.tolist()))

    return ratio(url)


def with_ratio(rows: DataFrame, url: str, model: dict, name: str) -> DataFrame:
    """``rows`` with the ratio of the URL in the column ``url`` (bytes), by all counts."""
    spark = rows.sparkSession
    if "rest" not in model:
        return rows.withColumn(name, scores(F.col(f"`{url}`"), model, spark))
    counts, contexts = model["rest"]
    plain, made = {c: v for c, v in model.items() if c != "rest"}, uuid.uuid4().hex
    held = spark.sparkContext.broadcast(plain)

    def ratio() -> Ratio:
        store = worker_store("urlfilter")
        if store.get("of") != made:
            store.update(of=made, ratio=Ratio(held.value))
        return store["ratio"]

    def lacking(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, URLS):
                some = batch.column(0).slice(first, URLS)
                for kind, markov in ((True, ratio().allow), (False, ratio().block)):
                    owner, gram, context = markov.lacking(some.to_pylist())
                    yield pa.RecordBatch.from_arrays([some.take(pa.array(owner)), pa.array(np.full(len(gram), kind)), pa.array(gram), pa.array(context)],
                                                     names=["url", "allow", "gram", "context"])

    def judge(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, URLS):
                some = batch.slice(first, URLS)
                joined = pc.list_flatten(some.column(1))
                field = {c: np.asarray(pc.struct_field(joined, c).to_numpy(zero_copy_only=False)) for c in ("allow", "gram", "n", "context", "total", "kinds")}
                kinds = field.pop("allow").astype(bool)
                more = {kind: Rest(*(v[kinds == kind].astype(np.int64) for v in field.values())) for kind in (True, False)}
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(ratio()(some.column(0).to_pylist(), more))], names=["url", "ratio"])

    urls = settle(rows.select(F.col(f"`{url}`").alias("url")).where("url is not null").distinct(), "url-distinct")
    wanted = urls.mapInArrow(lacking, "url binary, allow boolean, gram long, context long")
    joined = wanted.join(contexts.select("allow", "context", "total", "kinds"), ["allow", "context"]).join(
        counts.select("allow", "gram", "n"), ["allow", "gram"], "left")
    fact = F.struct("allow", "gram", F.coalesce("n", F.lit(0)).alias("n"), "context", "total", "kinds")
    per_url = joined.groupBy("url").agg(F.collect_list(fact).alias("facts"))
    found = settle(urls.join(per_url, "url", "left").mapInArrow(judge, "url binary, ratio double"), "url-ratios")
    discard(urls)
    return rows.join(found.select(F.col("url").alias(f"of_{made}"), F.col("ratio").alias(name)), F.col(f"`{url}`") == F.col(f"of_{made}"), "left").drop(
        f"of_{made}").fillna(0.0, [name])


def train(judged: DataFrame, url: str = "url", verdict: str = "verdict") -> dict:
    """Models and threshold from all rows with a URL and a verdict.

    The driver receives at most MODEL_GRAMS sequences of each model and, for the
    threshold, one row per cell of the ratio; repeated URLs weigh as often as they occur.
    With more sequences ``rest`` holds the tables of all counts, see ``with_ratio``.
    """
    held = F.pmod(F.xxhash64(F.col(url).cast("string")), F.lit(HELD)) == 0
    rows = judged.where(F.col(url).isNotNull() & F.col(verdict).isin(ALLOW, BLOCK)).select(
        as_bytes(F.col(url)).alias("url"), (F.col(verdict) == ALLOW).alias("allow"), held.alias("held"))
    counts = settle(count_sequences(rows.where(~F.col("held")).select("url", "allow")).withColumn("context", F.expr(
        "shiftright(gram & 281474976710655, 8) + shiftleft(shiftright(gram, 48) - 1, 48)")), "url-grams")
    # A context has at most 256 successors, so no group is large; a shorter context is seen at least as often.
    contexts = settle(counts.groupBy("allow", "context").agg(
        F.floor(F.log2(F.sum("n").cast("double")) * 4).cast("int").alias("support"), F.count(F.lit(1)).alias("kinds"),
        F.sum("n").alias("total")), "url-contexts")
    sizes = contexts.groupBy("allow", "support").agg(F.sum("kinds").alias("kinds")).orderBy(F.desc("support")).collect()
    model: dict = {"known": len({r.allow for r in sizes}) == 2}
    for name, kind in ((ALLOW, True), (BLOCK, False)):
        least, used = 1 << 30, 0
        for r in (r for r in sizes if r.allow == kind):
            used += r.kinds
            if used > MODEL_GRAMS:
                break
            least = r.support
        kept = contexts.where((F.col("allow") == kind) & (F.col("support") >= least)).select("context")
        found = counts.where(F.col("allow") == kind).join(kept, "context", "left_semi").select("gram", "n").toArrow()
        model[name] = found.column("gram").to_numpy(), found.column("n").to_numpy()
    if model["known"] and sum(r.kinds for r in sizes) > len(model[ALLOW][0]) + len(model[BLOCK][0]):
        model["rest"] = counts, contexts
    else:
        discard(counts, contexts)
    model["threshold"] = 0.0
    if model["known"]:
        cell = F.round(F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.col("ratio"))), DIGITS)
        cells = with_ratio(rows.where("held"), "url", model, "ratio").select("allow", cell.alias("cell")).groupBy("allow", "cell").agg(F.count(F.lit(1)).alias("n")).orderBy("cell", "allow").toArrow()
        if cells.num_rows:
            model["threshold"] = threshold(*(cells.column(c).to_numpy() for c in ("cell", "allow", "n")))
    return model


def as_bytes(url: Column) -> Column:
    return F.lower(url.cast("string")).cast("binary")


def judge_urls(pages: DataFrame, keep: list[str], url: str = "url", rules=RULES) -> DataFrame:
    """``keep`` plus host, path, rule, verdict and the ratio of every URL.

    A null URL or one without ``://`` has neither host nor path, fits no rule and is
    blocked.  Without examples of both classes the ratio is 0 and URLs that no rule
    fits are allowed.
    """
    new = ["host", "path", "rule", "verdict", "ratio"]
    kept = without(keep, new)
    own = uuid.uuid4().hex  # no column of the caller is called like ours
    text, ruled = f"url_{own}", f"ruled_{own}"
    rows = pages.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{url}`").cast("string").alias(text)).select(
        "*", host_of(F.col(text)).alias("host"), path_of(F.col(text)).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = rows.select("*", rule.alias("rule"), verdict.alias(ruled))
    model = train(judged, text, ruled)
    scored = with_ratio(judged.withColumn(f"bytes_{own}", as_bytes(F.col(text))), f"bytes_{own}", model, "ratio")
    if "rest" in model:
        discard(*model["rest"])
    by_model = F.when((F.col("host") == "") & (F.col("path") == ""), BLOCK).when(F.col("ratio") >= model["threshold"], ALLOW).otherwise(BLOCK)
    return scored.select(*(F.col(f"`{c}`") for c in kept), "host", "path", "rule", F.coalesce(ruled, by_model).alias("verdict"), "ratio")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(documents(spark, sf_dir, "pages"), ["page_id"])
