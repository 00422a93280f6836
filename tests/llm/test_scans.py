"""License scans, languages and URL filters."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusdesk.llm import langid, licenses, urlfilter
from llm_cases import DE, EN, prose


def edits(pattern, text):
    """Least edits between the pattern and any part of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        last, row = row, [i]
        for j, c in enumerate(text, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (p != c)))
    return min(row)


def base_by_hand(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase, label in {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}.items():
        n = len(phrase.split())
        found = [i for i in range(len(words)) if " ".join(words[i:i + n]) == phrase]
        places += found
        labels |= {label} if found else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_and_edge_rows(spark, edge, nothing):
    more = ["CC-BY cc by CC BY", "(MIT)\nLicense; apache\tlicense MIT LICENSE", "gnu general public licenses", "é_cc_by_é"]
    docs = edge.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    rows = licenses.scan_licenses(docs, ["doc_id", "text"]).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_by_hand(r.text), r.text[:60]
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert licenses.scan_licenses(nothing, ["doc_id"]).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_fuzzy_notices_are_all_found(seed):
    rng, scanner = random.Random(seed), licenses.Scanner()
    for _ in range(25):
        notice = rng.choice(sorted(licenses.NOTICES))
        mine = list(notice)
        for _ in range(rng.randint(0, len(notice) // licenses.EDITED + 2)):
            at = rng.randrange(len(mine))
            mine[at:at + rng.choice((0, 1))] = [rng.choice("abcde "), ""][rng.randrange(2)]
        line = " ".join(f" {prose(rng, EN, 8).lower()} {''.join(mine)} {prose(rng, DE, 8).lower()} ".split())
        found = {n for n, *_ in scanner.spans(f" {line} ")}
        want = {n for n in licenses.NOTICES if edits(n, line) <= len(n) // licenses.EDITED}
        assert found == want, (line, found ^ want)


def test_spans_name_the_words():
    row = licenses.Scanner().row(b"one two All rihgts reserved, three")
    assert row[5] == "all-rights-reserved" or row[5] == ""
    row = licenses.Scanner().row(b"one two All rigts reserved, three")
    assert row[5] == "all-rights-reserved" and row[7] == [("all-rights-reserved", 2, 4, 1)] and row[6] == pytest.approx(1 - 1 / 19)


def best_by_hand(scores, switch):
    import itertools

    n, k = scores.shape
    return max(sum(scores[t, p[t]] for t in range(n)) - switch * sum(p[t] != p[t - 1] for t in range(1, n))
               for p in itertools.product(range(k), repeat=n))


@pytest.mark.parametrize("seed", range(10))
def test_paths_are_best(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(0, 7, 5).tolist()
    scores = rng.normal(0, 3, (sum(sizes), 3)).astype(np.float32)
    states, a = langid.best_paths(scores.copy(), sizes, 2.0), 0
    for n in sizes:
        if n:
            mine, s = scores[a:a + n], states[a:a + n]
            value = mine[np.arange(n), s].sum() - 2.0 * (s[1:] != s[:-1]).sum()
            assert value == pytest.approx(best_by_hand(mine, 2.0), abs=1e-4)
        a += n


def test_languages(spark, corpus, edge, nothing):
    model = langid.train(corpus)
    assert model["langs"] == ["de", "en"]
    rng = random.Random(77)
    held = [(i, prose(rng, EN if i % 2 else DE, 12), "en" if i % 2 else "de") for i in range(60)]
    held.append((60, prose(rng, EN, 40) + " " + prose(rng, DE, 15), "en"))
    rows = {r.doc_id: r for r in langid.label_languages(spark.createDataFrame(held, "doc_id long, text string, lang string"), model, ["doc_id"]).collect()}
    assert sum(rows[i].lang_pred == lang for i, _, lang in held) >= 60
    mixed = rows[60]
    assert [s.lang for s in mixed.spans] == ["en", "de"] and abs(mixed.spans[1].from_word - 40) <= 3 and 0.5 < mixed.score < 1
    odd = langid.label_languages(edge, model, ["doc_id", "text"]).collect()
    assert len(odd) == edge.count()
    for r in odd:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")), r.text
    empty = langid.train(nothing)
    assert {r.lang_pred for r in langid.label_languages(edge, empty, ["doc_id"]).collect()} == {"und"}
    assert langid.label_languages(nothing, model, ["doc_id"]).collect() == []


def test_scripts_narrow_candidates(spark):
    rows = [(i, "река дом и свет" if i % 2 else "the river and house", "ru" if i % 2 else "en") for i in range(20)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = spark.createDataFrame([(1, "ЖЩЪ"), (2, "zzz qqq"), (3, "日本")], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in langid.label_languages(asked, model, ["doc_id"]).collect()}
    assert got[1] == "ru" and got[2] == "en" and got[3] in ("en", "ru")


def url_by_hand(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [h + p for _, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=len, default=None)


URLS = [None, "", "x", "://", "http://", "http://com", "http://com/", "HTTP://WWW.Example.COM/en/x?y#z", "https://example.com/en/", "https://a.example.com/en",
        "https://xexample.com/en/1", "ftp://a.b.net/es/q", "http://net/fr/", "http://a.net?u=://b.net/es/", "http://h#f/es/", "a://b://c.com/", "http://É.com/x", "http://x.org/en/1\n2"]


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "v") for i, u in enumerate(URLS)], "page_id long, url string, Verdict string")
    rows = urlfilter.judge_urls(pages, ["page_id", "url", "Verdict"]).collect()
    assert len(rows) == len(URLS)
    kinds = {h + p: v for v, h, p in urlfilter.RULES}
    for r in rows:
        host, path, rule = url_by_hand(r.url)
        assert (r.host, r.path, r["rule"]) == (host, path, rule), r.url
        assert r.verdict == kinds[rule] if rule else r.verdict in ("allow", "block")
        assert host or path or r.verdict == "block"
    assert urlfilter.judge_urls(pages.limit(0), ["page_id"]).collect() == []


def test_models_tell_accepted_from_rejected(spark):
    rng = random.Random(3)
    good, bad = ("news", "wiki", "school", "library"), ("casino", "pills", "bets", "adult")
    make = lambda kind, end: f"http://{rng.choice(kind)}{rng.randint(1, 99)}.{rng.choice(kind)}.{end}"
    rows = [(i, make(good, "com/a")) if i % 2 else (i, make(bad, "net/es/a")) for i in range(300)]
    asked = [(1000 + i, make(good if i % 2 else bad, "org/z")) for i in range(60)]
    out = urlfilter.judge_urls(spark.createDataFrame(rows + asked, "page_id long, url string"), ["page_id"]).where("rule is null").collect()
    assert len(out) == 60 and sum((r.verdict == "allow") == (r.page_id % 2 == 1) for r in out) >= 54


def markov(urls):
    """Plain counts of all sequences of 1 to ORDER + 1 bytes that end in a URL or at its end."""
    counts = collections.Counter()
    for u in urls:
        full = bytes([urlfilter.START]) * urlfilter.ORDER + u + bytes([urlfilter.END])
        counts.update(full[i - k:i + 1] for i in range(urlfilter.ORDER, len(full)) for k in range(urlfilter.ORDER + 1))
    return counts


def log_by_hand(counts, u):
    total, kinds = collections.Counter(), collections.Counter()
    for g, n in counts.items():
        total[g[:-1]] += n
        kinds[g[:-1]] += 1
    full = bytes([urlfilter.START]) * urlfilter.ORDER + u + bytes([urlfilter.END])
    out = 0.0
    for i in range(urlfilter.ORDER, len(full)):
        p = 1 / urlfilter.ALPHABET
        for k in range(urlfilter.ORDER + 1):
            c = full[i - k:i]
            if not total[c]:
                break
            p = (counts[c + full[i:i + 1]] + kinds[c] * p) / (total[c] + kinds[c])
        out += math.log(p)
    return out


def packed(counts):
    number = lambda g: int.from_bytes(g, "big") | len(g) << 48
    return np.array([number(g) for g in counts], np.int64), np.array(list(counts.values()), np.int64)


def test_next_characters_add_up_to_one():
    model = urlfilter.Markov(*packed(markov([b"aab", b"aac", b"zb"])))
    for start in (b"", b"a", b"aa", b"zb", b"qq"):
        longer = model.log([start + bytes([c]) for c in range(254)])
        last = [log_by_hand(markov([b"aab", b"aac", b"zb"]), start + bytes([c])) for c in range(254)]
        assert np.allclose(longer, last)
    assert model.log([b"aab"])[0] > model.log([b"qqq"])[0]
    # The probabilities of what follows a context, summed over the alphabet.
    counts = markov([b"aab", b"aac", b"zb"])
    totals = lambda c: sum(n for g, n in counts.items() if g[:-1] == c)
    for context in (b"a", b"aa", b"zb"):
        ps = []
        for x in range(urlfilter.ALPHABET):
            p = 1 / urlfilter.ALPHABET
            for k in range(len(context) + 1):
                c = context[len(context) - k:]
                if not totals(c):
                    break
                kinds = sum(g[:-1] == c for g in counts)
                p = (counts[c + bytes([x])] + kinds * p) / (totals(c) + kinds)
            ps.append(p)
        assert sum(ps) == pytest.approx(1)


def urls_of_two_kinds(n, seed=3):
    rng = random.Random(seed)
    good, bad = ("news", "wiki", "school", "library"), ("casino", "pills", "bets", "adult")
    make = lambda kind, end: f"http://{rng.choice(kind)}{rng.randint(1, 99)}.{rng.choice(kind)}.{end}"
    rows = [make(good, "com/a") if i % 2 else make(bad, "net/es/Ä") for i in range(n)]
    return rows + [make(good if i % 2 else bad, "org/z") for i in range(60)] + rows[:1] * n + [None, "", "ftp://x"]


def test_verdicts_equal_plain_counting(spark):
    urls = urls_of_two_kinds(300)
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").repartition(5)
    got = urlfilter.judge_urls(pages, ["page_id", "url"]).collect()
    held = {r.url for r in pages.where(F.pmod(F.xxhash64("url"), F.lit(urlfilter.HELD)) == 0).collect()}
    kinds = {h + p: v for v, h, p in urlfilter.RULES}
    judged = [(u, kinds[rule]) for u in urls for rule in [url_by_hand(u)[2]] if rule]
    models = {v: markov([u.lower().encode() for u, w in judged if w == v and u not in held]) for v in kinds.values()}
    ratio = lambda u: (log_by_hand(models["allow"], u) - log_by_hand(models["block"], u)) / len(u)
    by_hand = {u: ratio(u.lower().encode()) if u else 0.0 for u in set(urls)}
    checks = [(round(by_hand[u], urlfilter.DIGITS), v == "allow") for u, v in judged if u in held]
    cut = urlfilter.threshold(np.array([c for c, _ in checks]), np.array([a for _, a in checks]))
    assert len(got) == len(urls)
    for r in got:
        assert r.ratio == pytest.approx(by_hand[r.url], abs=1e-9)
        host, path, rule = url_by_hand(r.url)
        assert r.verdict == (kinds[rule] if rule else "block" if not host and not path else "allow" if r.ratio >= cut else "block")


def test_small_models_keep_whole_contexts(spark, monkeypatch):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls_of_two_kinds(300))], "page_id long, url string")
    monkeypatch.setattr(urlfilter, "MODEL_GRAMS", 300)
    rows = pages.select("url", F.when(F.col("url").contains(".com/"), "allow").when(F.col("url").contains(".net/"), "block").alias("verdict"))
    model = urlfilter.train(rows)
    kept = [u.lower().encode() for u in (r.url for r in rows.where("verdict = 'allow'").where(F.pmod(F.xxhash64("url"), F.lit(urlfilter.HELD)) != 0).collect())]
    grams, counts = model["allow"]
    full = markov(kept)
    assert 0 < len(grams) <= 300 < len(full)
    number = {int(g): int(n) for g, n in zip(grams, counts)}
    all_of = {int(g): int(n) for g, n in zip(*packed(full))}
    assert all(all_of[g] == n for g, n in number.items())
    context = lambda g: ((g & (1 << 48) - 1) >> 8) | ((g >> 48) - 1) << 48
    held = {context(g) for g in number}
    assert {g for g in all_of if context(g) in held} == set(number)


@pytest.mark.parametrize("grams", [0, 300])
def test_counts_beyond_the_broadcast_are_joined(spark, monkeypatch, grams):
    """Ratios and verdicts do not depend on how many sequences are broadcast."""
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls_of_two_kinds(300))], "page_id long, url string").repartition(3)
    rows = lambda: {r.page_id: (r.url, r.rule, r.verdict, round(r.ratio, 9)) for r in urlfilter.judge_urls(pages, ["page_id", "url"]).collect()}
    want = rows()
    monkeypatch.setattr(urlfilter, "MODEL_GRAMS", grams)
    monkeypatch.setattr(urlfilter, "URLS", 7)
    assert rows() == want and len(want) == pages.count()


def test_thresholds_lie_in_the_middle_of_the_gap():
    assert urlfilter.threshold(np.array([0.0, 0.2, 0.4, 0.5]), np.array([False, False, True, True])) == pytest.approx(0.3)
    assert urlfilter.threshold(np.array([1.0, 2.0]), np.array([True, True])) == 0.0


def test_rare_languages_are_learnt(spark):
    rng = random.Random(9)
    rare = "ilma vesi kivi talo yksi puu lumi metsä".split()
    rows = [(i, prose(rng, EN, 8), "en") for i in range(4000)] + [(4000 + i, prose(rng, rare, 8), "fi") for i in range(3)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3))
    assert model["langs"] == ["en", "fi"]
    asked = [(1, prose(rng, rare, 10)), (2, prose(rng, EN, 10)), (3, "zzz qqq xxx " + prose(rng, EN, 6))]
    got = {r.doc_id: r.lang_pred for r in langid.label_languages(spark.createDataFrame(asked, "doc_id long, text string"), model, ["doc_id"]).collect()}
    assert got == {1: "fi", 2: "en", 3: "en"}


def test_trigrams_are_chosen_per_language(spark, monkeypatch):
    monkeypatch.setattr(langid, "GRAMS", 40)
    if hasattr(langid, "LANG_GRAMS"):
        monkeypatch.setattr(langid, "LANG_GRAMS", 20)
    rows = [(i, " ".join(EN), "en") for i in range(200)] + [(200 + i, "ilma vesi kivi", "fi") for i in range(5)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3))
    assert {"ilm", "ves", "kiv"} <= set(model["grams"])


def test_a_damaged_notice_before_an_exact_one_has_its_span():
    spans = licenses.Scanner().row(b"released undr the mit license released under the mit license released under teh mit license")[-1]
    assert [s[1] for s in spans if s[0] == "mit" and s[2] - s[1] >= 4] == [0, 5, 10]


def test_license_spans_of_a_long_run_take_linear_time():
    import random
    import time

    scanner = licenses.Scanner()
    start = time.time()
    row = scanner.row(b"released under teh mit license " * 33_000)
    assert time.time() - start < 60
    mit = [s for s in row[-1] if s[0] == "mit"]
    assert len(mit) == 33_000 and mit[-1][2] == 5 * 33_000 - 1
    # pieces find what one search of the whole window finds
    rng = random.Random(3)
    notices = ["released under the mit license", "relesed under the mit license", "released undr teh mit licence", "a gnu general public license", "x y z"]
    for _ in range(30):
        line = f" {' '.join(rng.choice(notices) for _ in range(25))} "
        for notice in ("released under the mit license", "gnu general public license"):
            whole = {m.span() for m in scanner.matches(notice, line, 0, len(line))}
            pieces = [m.span() for m in scanner.stepped(notice, line, 0, len(line))]
            assert len(pieces) == len(set(pieces)) and all(a[1] <= b[0] for a, b in zip(sorted(pieces), sorted(pieces)[1:]))
            assert abs(len(whole) - len(pieces)) <= 1 and len(whole & set(pieces)) >= 0.9 * len(whole)
