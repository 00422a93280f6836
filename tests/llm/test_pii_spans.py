"""Personal data: plain spans against the stated patterns, disguised ones by hand, places by brute force."""

import hashlib
import random
import re
import time

import pytest

from corpusdesk.llm import pii_spans as pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(digits[::-1])) % 10 == 0


def by_pattern(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                  "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, *m.span(), True))
    return out


PIECES = ["a.b", "@", "x.de", "-", ".", "+", "1", "255", "256", "4111 1111 1111 1111", "4337166598464399", "+1 (988) 555-2485", " ", "(", ")", "é", "q@w.e", "_", "%", "0001", "10.0.0.1", "\n", "@@"]


def test_plain_spans_by_pattern():
    rng = random.Random(4)
    for _ in range(4000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 9)))
        assert [s for s in pii.find_spans(text) if s[3]] == by_pattern(text), text


DISGUISED = {
    "mail john (at) example (dot) com now": ("email", "john (at) example (dot) com"),
    "jane.doe [at] mail [dot] example [dot] org": ("email", "jane.doe [at] mail [dot] example [dot] org"),
    "bob at example dot com, ok": ("email", "bob at example dot com"),
    "name_at_host_dot_co_dot_uk": ("email", "name_at_host_dot_co_dot_uk"),
    "joe@mail dot example dot com.": ("email", "joe@mail dot example dot com"),
    "to іvаn@ехаmple.com!": ("email", "іvаn@ехаmple.com"),
    "ｊｏｅ＠ｅｘａｍｐｌｅ．ｃｏｍ": ("email", "ｊｏｅ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
    "é j​oe@exam​ple.com": ("email", "j​oe@exam​ple.com"),
    "card four" + " one" * 15 + " end": ("card", "four" + " one" * 15),
    "card vier" + "-eins" * 15 + ", gut": ("card", "vier" + "-eins" * 15),
    "4111 llll 1111 1111": ("card", "4111 llll 1111 1111"),
    "plus four nine one five one two three four five six seven": ("phone", "plus four nine one five one two three four five six seven"),
    "at +49 (15l) 234 5678": ("phone", "+49 (15l) 234 5678"),
    "ip one nine two dot one six eight dot zero dot one.": ("ip", "one nine two dot one six eight dot zero dot one"),
    "192 dot 168 dot 1 dot 20": ("ip", "192 dot 168 dot 1 dot 20"),
    "10[.]0[.]0[.]1": ("ip", "10[.]0[.]0[.]1"),
    "x ١٩٢.١٦٨.٠.١ x": ("ip", "١٩٢.١٦٨.٠.١")}


@pytest.mark.parametrize("text", DISGUISED)
def test_disguised(text):
    assert [(k, text[a:b], plain) for k, a, b, plain in pii.find_spans(text)] == [(*DISGUISED[text], False)]


@pytest.mark.parametrize("text", ["look at example.com", "at the dot of the i, one two", "почта@яндекс.рф", "four one two three", "x@y dot", "meet at one dot", "300 dot 1 dot 1 dot 1", "bob at home dot 4"])
def test_left_alone(text):
    assert pii.find_spans(text) == []


def test_plain_ones_stay():
    text = "write bob@x.com dot your i's, 10.0.0.1 and 10 dot 0 dot 0 dot 2"
    assert [(k, text[a:b], p) for k, a, b, p in pii.find_spans(text)] == [
        ("email", "bob@x.com", True), ("ip", "10.0.0.1", True), ("ip", "10 dot 0 dot 0 dot 2", False)]


def test_places_lead_back():
    """Each output character comes from the characters of its edit, or from itself."""
    rng = random.Random(6)
    for _ in range(1500):
        source = "".join(rng.choice("abcdef") for _ in range(rng.randint(1, 14)))
        edits, at = [], 0
        while at < len(source) and rng.random() < 0.8:
            start = rng.randint(at, len(source) - 1)
            end = rng.randint(start + 1, len(source))
            edits.append((start, end, rng.choice(("", "X", "XYZ"))))
            at = end
        step, out, came = pii.Rewritten(source, edits), "", []
        at = 0
        for start, end, new in [*edits, (len(source), len(source), "")]:
            out += source[at:start] + new
            came += [(i, i + 1) for i in range(at, start)] + [(start, end)] * len(new)
            at = end
        assert step.text == out and [step.back(i) for i in range(len(out))] == came


@pytest.mark.parametrize("unit", ["1", "1.", "a@", "+1 ", "one ", "[at] ", "a dot ", "l0", "é​", "a.", "@a.", "x at y ", "İ one "])
def test_long_texts_take_linear_time(unit):
    start = time.time()
    pii.find_spans(unit * (600_000 // len(unit)))
    assert time.time() - start < 10


def test_operator(spark, edge, nothing, tmp_path):
    found = pii.find_personal_data(edge, ["doc_id", "text", "label"]).collect()
    assert len(found) == edge.count()
    for r in found:
        assert [tuple(s) for s in r.spans] == pii.find_spans(r.text or "") and r.label == "l"
    assert pii.find_personal_data(nothing, ["doc_id"]).collect() == []
    text = "a@b.de 10.0.0.1 x (at) y (dot) com"
    spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in pii.op11_pii_spans(spark, str(tmp_path)).collect()}
    assert rows[1].spans == "email:0:6,email:16:34,ip:7:15" and (rows[1].n_email, rows[1].n_ip, rows[1].n_card, rows[1].n_phone) == (1, 1, 0, 0)
    assert rows[1].base_sha256 == hashlib.sha256(b"email:0:6,ip:7:15").hexdigest()
    assert all(rows[k].spans == "" and rows[k].base_sha256 == hashlib.sha256(b"").hexdigest() for k in (2, 3))
