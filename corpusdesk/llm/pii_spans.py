"""Personal data in plain and in disguise, with places in the source text.

Plain identifiers are found as they stand.  For those in disguise a cascade of
transducers rewrites the text: characters that look like others and invisible ones, then
spelled digits, "at" and "dot" in words or brackets, letters for digits.  Each rewriting
keeps the list of its edits, so a place in its output leads back to the place in its
input.  Identifiers found in the last output are carried back to the source
characters; those that a rewriting has touched are the disguised ones.

All patterns read a text once: runs are taken whole (possessive) and are entered at their
start only, so a text of any length and content takes linear time.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from corpusdesk.llm.common import add_columns, documents

KINDS = ("email", "ip", "card", "phone")

# What the four kinds look like.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Letters of other scripts that look like Latin ones.
LOOKALIKES = dict(zip("аеорсухіјѕԁһӏАВЕКМНОРСТХІЈЅοαρνικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhlABEKMHOPCTXIJSoapvikABEZHIKMNOPTYX"))
DASHES, DOTS, BLANKS = "‐‑‒–—−﹣", "․。｡﹒", "      　"
INVISIBLE = "­​‌‍⁠﻿"

# The digits in four languages.
SPELLED = {"zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
           "null": 0, "eins": 1, "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
           "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
           "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9}
AT_WORDS, DOT_WORDS = "at|ät|arroba|arobase", "dot|punkt|point|punto"

_WORD = "(?:" + "|".join(sorted(SPELLED, key=len, reverse=True)) + ")"
_SEP = r"[\x20-]{1,2}"
#: Two spelled digits or more, or one beside a figure.  All patterns with words are for lower-case text.
RUN = re.compile(rf"(?<!\w){_WORD}(?:{_SEP}{_WORD})++(?!\w)|(?<=[0-9.\x20])(?<!\w){_WORD}(?=\.[0-9]|{_SEP}[0-9])|(?<=[0-9][.\x20-]){_WORD}(?!\w)")
SPELLED_WORD = re.compile(_WORD)
PLUS = re.compile(rf"(?<!\w)plus\x20(?=[0-9]|{_WORD}{_SEP}{_WORD})")
BRACKET_AT = re.compile(rf"\x20?[\[({{<]\x20?(?:{AT_WORDS}|@)\x20?[\])}}>]\x20?")
BRACKET_DOT = re.compile(rf"\x20?[\[({{<]\x20?(?:{DOT_WORDS}|\.)\x20?[\])}}>]\x20?")
_GAP = r"[\x20_-]{1,2}"
BARE_DOT = re.compile(rf"(?<=[a-z0-9]){_GAP}(?:{DOT_WORDS}){_GAP}(?=[a-z0-9])")
#: "at" in words counts where a host with a spelled or bracketed dot follows.
BARE_AT = re.compile(rf"(?<=[a-z0-9]){_GAP}(?:{AT_WORDS}){_GAP}(?=[a-z0-9-]{{1,63}}(?:\.[a-z0-9-]{{1,63}}){{0,3}}(?:{_GAP}(?:{DOT_WORDS}){_GAP}|\x20?[\[({{<]\x20?(?:{DOT_WORDS}|\.)\x20?[\])}}>]\x20?)[a-z0-9])")
FIGURE = re.compile(r"(?<![A-Za-z0-9])[0-9OolI]{2,}+(?![A-Za-z0-9])")
BESIDE = re.compile(r"[0-9][\x20-]$")
LETTER_FIGURES = str.maketrans("OolI", "0011")
TOP = re.compile(r"\.[A-Za-z]{2,24}$")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            out.append((start, free))
        at = text.find("@", max(at + 1, free))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    def fits(part: str) -> bool:
        part = part.lstrip("0")
        return len(part) < 3 or len(part) == 3 and part <= "255"

    return [m.span() for m in IP.finditer(text) if all(map(fits, m[0].split(".")))]


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15] if "+" in text else []


FINDERS = {"email": emails, "ip": ips, "card": cards, "phone": phones}


# --- transducers ----------------------------------------------------------------

Edit = tuple[int, int, str]
#: A spelled digit beside a dot that comes out of a round is read in the next one.
ROUNDS = 5


class Rewritten:
    """A text after edits (start, end, replacement), with the way back."""

    def __init__(self, source: str, edits: list[Edit]):
        self.edits, self.starts, out, at, shift = [], [], [], 0, 0
        for start, end, new in edits:
            if start < at:
                continue  # an earlier edit holds these characters
            out += [source[at:start], new]
            self.edits.append((start, end, start + shift, len(new)))
            self.starts.append(start + shift)
            shift += len(new) - (end - start)
            at = end
        self.text = "".join([*out, source[at:]])

    def back(self, i: int) -> tuple[int, int]:
        """The source characters (start, end) that character ``i`` comes from."""
        k = bisect_right(self.starts, i) - 1
        while k >= 0 and self.edits[k][3] == 0 and self.edits[k][2] == i:
            k -= 1  # what is deleted before a character is not a part of it
        if k < 0:
            first = bisect_right(self.starts, i)
            gone = sum(e[1] - e[0] for e in self.edits[:first] if e[3] == 0 and e[2] <= i) if first else 0
            return i + gone, i + gone + 1
        start, end, out, n = self.edits[k]
        if i < out + n:
            return start, end
        at = end + i - out - n
        for s, e, o, m in self.edits[k + 1:bisect_right(self.starts, i)]:
            at += e - s if m == 0 else 0
        return at, at + 1

    def span(self, start: int, end: int) -> tuple[int, int]:
        return self.back(start)[0], self.back(end - 1)[1]


@cache
def looks() -> tuple[dict[int, str], frozenset[str]]:
    """What each look-alike stands for, and all characters that are rewritten.

    Full-width forms, letters and figures of mathematics and the decimal digits of all
    scripts follow from the character database.
    """
    found = {ord(c): a for c, a in LOOKALIKES.items()} | {ord(c): "-" for c in DASHES} | {ord(c): "." for c in DOTS} | {ord(c): " " for c in BLANKS}
    found[0xFE6B] = "@"
    for code in (*range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800)):
        plain = unicodedata.normalize("NFKC", chr(code))
        if plain.isascii() and len(plain) == 1:
            found[code] = plain
    for code in range(0x80, 0x20000):
        if (digit := unicodedata.decimal(chr(code), None)) is not None:
            found[code] = str(digit)
    return found, frozenset(INVISIBLE) | {chr(c) for c in found}


#: Punctuation as blanks.
APART = {i: " " for i in range(0x21, 0x7F) if not chr(i).isalnum()}


def lowered(text: str) -> str:
    """Lower case, character for character."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def spelled_edits(low: str) -> list[Edit]:
    words = low.translate(APART).split()
    if SPELLED.keys().isdisjoint(words):
        return []
    return [(*m.span(), "".join(str(SPELLED[w[0]]) for w in SPELLED_WORD.finditer(m[0]))) for m in RUN.finditer(low)]


def disguises(text: str) -> list[Edit]:
    """Edits for spelled digits, "at", "dot" and "plus", and letters that stand for figures."""
    low = lowered(text)
    edits = spelled_edits(low)
    if "plus" in low:
        edits += [(*m.span(), "+") for m in PLUS.finditer(low)]
    if "]" in low or ")" in low or "}" in low or ">" in low:
        edits += [(*m.span(), "@") for m in BRACKET_AT.finditer(low)] + [(*m.span(), ".") for m in BRACKET_DOT.finditer(low)]
    if any(w in low for w in DOT_WORDS.split("|")):
        edits += [(*m.span(), ".") for m in BARE_DOT.finditer(low)]
        if any(w in low for w in AT_WORDS.split("|")):
            edits += [(*m.span(), "@") for m in BARE_AT.finditer(low)]
    for m in FIGURE.finditer(text):
        start, end = m.span()
        if not m[0].isdigit() and (any(c.isdigit() for c in m[0]) or end - start > 2 and BESIDE.search(text[max(0, start - 2):start])):
            edits.append((start, end, m[0].translate(LETTER_FIGURES)))
    return sorted(edits)


def rewrite(text: str) -> tuple[str, list[Rewritten]]:
    """The text without disguise, and the rewritings that led to it, first one first."""
    steps, now = [], text
    table, odd = looks()
    if not text.isascii() and not odd.isdisjoint(text):
        now = now.translate(table)  # character for character
        gone = [(m.start(), m.end(), "") for m in re.finditer(f"[{INVISIBLE}]+", now)]
        if gone:
            steps.append(Rewritten(now, gone))
            now = steps[-1].text
    for _ in range(ROUNDS):
        edits = disguises(now)
        if not edits:
            break
        steps.append(Rewritten(now, edits))
        now = steps[-1].text
    return now, steps


def fits(kind: str, found: str) -> bool:
    """Disguised addresses end in letters: a sentence with "at" and "dot" seldom reads like that."""
    return bool(TOP.search(found)) if kind == "email" else True


def find_spans(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, stands plainly?) in the order of KINDS and start."""
    plain = {kind: find(text) for kind, find in FINDERS.items()}
    now, steps = rewrite(text)
    out = []
    for kind in KINDS:
        spans = [(*s, True) for s in plain[kind]]
        if now != text:
            starts = [s for s, _ in plain[kind]]
            for start, end in FINDERS[kind](now):
                seen, (a, b) = now[start:end], (start, end)
                for step in reversed(steps):
                    a, b = step.span(a, b)
                if text[a:b] == seen or not fits(kind, seen) or text[a - 1:a].isalnum() or text[b:b + 1].isalnum():
                    continue  # nothing was disguised, or a part of a word
                k = bisect_right(starts, a)
                if (k and plain[kind][k - 1][1] > a) or (k < len(starts) and starts[k] < b):
                    continue  # the plain one stays as it is
                spans.append((a, b, False))
        out += [(kind, *s) for s in sorted(spans)]
    return out


SPANS = ArrayType(StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType()), StructField("plain", BooleanType())]))


def find_personal_data(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` plus ``spans``, array<struct<kind, start, end, plain>> of every whole text.

    Places are code points, the end is exclusive; spans are sorted by kind (email, ip,
    card, phone) and start.  ``plain`` ones stand in the text as they are, the others in
    disguise; spans of one kind do not overlap.  A null or empty text has none.  Repeated
    rows count each; an empty table gives an empty result.
    """

    def make():
        names = ("kind", "start", "end", "plain")
        return lambda texts: [[[dict(zip(names, s)) for s in find_spans(t.decode())] if t else [] for t in texts]]

    return add_columns(docs, [StructField("spans", SPANS)], make, keep, text)


def listed(spans: Column) -> Column:
    """kind:start:end of all, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op11_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four numbers and the digest tell of plain spans only, ``spans`` of all."""
    found = find_personal_data(documents(spark, sf_dir), ["doc_id"])
    plain = F.filter("spans", lambda s: s["plain"])
    number = lambda kind: F.size(F.filter(plain, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(number, KINDS), F.sha2(listed(plain), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
