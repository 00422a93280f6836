"""License scans: fuzzy search for short notices.

A notice of n characters may have ``n // EDITED`` edits, k say.  Cut into k + 1
seeds, at least one of them is untouched wherever the notice stands (pigeonhole).
One automaton finds the seeds of all notices in a text; around each hit the
``regex`` library matches the notice with at most k errors and tells the span.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from corpusdesk.llm.common import add_columns, documents, worker_store

EDITED = 10  # one edit for so many characters of a notice

# Phrases that count wherever their words stand, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Short notices of public licenses, as lower-case words.
NOTICES = {
    "licensed under the gnu general public license": "gpl",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "licensed under the apache license version 2 0": "apache",
    "licensed under the apache license": "apache",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "creative commons attribution": "cc-by",
    "licensed under cc by": "cc-by",
    "creative commons zero": "cc0",
    "dedicated to the public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}

#: ASCII other than digits and letters becomes a blank; A-Z become a-z.
TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def seeds_of(notice: str) -> list[tuple[int, str]]:
    """(offset, seed): k + 1 parts of the notice, where k is the number of edits it may have."""
    k = len(notice) // EDITED
    edges = [len(notice) * i // (k + 1) for i in range(k + 2)]
    return [(a, notice[a:b]) for a, b in zip(edges[:-1], edges[1:])]


class Scanner:
    def __init__(self):
        import ahocorasick
        import regex

        self.automaton = ahocorasick.Automaton()
        self.patterns = {n: regex.compile(rf"(?be)(?:{regex.escape(n)}){{e<={len(n) // EDITED}}}") for n in NOTICES}
        held: dict[str, list] = {}
        for notice in NOTICES:
            for offset, seed in seeds_of(notice):
                held.setdefault(seed, []).append((notice, offset))
        for seed, uses in held.items():
            self.automaton.add_word(seed, (len(seed), uses))
        self.automaton.make_automaton()

    def spans(self, line: str) -> list[tuple[str, int, int, int]]:
        """(notice, first character, end, edits) in a text of lower-case words between single blanks."""
        windows: dict[str, list[list[int]]] = {}
        for end, (size, uses) in self.automaton.iter(line):
            for notice, offset in uses:
                k = len(notice) // EDITED
                a = max(0, end + 1 - size - offset - k)
                b = end + 1 - size - offset + len(notice) + k
                held = windows.setdefault(notice, [])
                if held and a <= held[-1][1]:
                    held[-1] = [min(a, held[-1][0]), max(b, held[-1][1])]
                else:
                    held.append([a, b])
        found = []
        for notice, parts in windows.items():
            for a, b in parts:
                for m in self.stepped(notice, line, a, min(b, len(line))):
                    found.append((notice, *m.span(), sum(m.fuzzy_counts)))
        return sorted(found, key=lambda x: (x[1], x[2], x[0]))

    def stepped(self, notice: str, line: str, a: int, b: int) -> Iterator:
        """The matches of a window of any length, found in pieces of bounded length.

        A match that ends near the end of a piece is left to the next one, which begins
        before all that such a match may hold.
        """
        k = len(notice) // EDITED
        reach = len(notice) + 2 * k
        while b - a > 4 * reach:
            border, next_a = a + 3 * reach, a + 2 * reach
            for m in self.matches(notice, line, a, a + 4 * reach):
                if m.end() <= border:
                    yield m
                    next_a = max(next_a, m.end())
            a = next_a
        yield from self.matches(notice, line, a, b)

    def matches(self, notice: str, line: str, a: int, b: int) -> Iterator:
        """All matches from ``a`` to ``b``; the pattern finds the best one first, whatever stands before it."""
        least = len(notice) - len(notice) // EDITED
        while b - a >= least and (m := self.patterns[notice].search(line, a, b)):
            yield from self.matches(notice, line, a, m.start())
            yield m
            a = m.end()

    def row(self, text: bytes | None) -> tuple:
        words = (text or b"").translate(TO_WORDS).split()
        padded = b" " + b" ".join(words) + b" "
        places, labels, score, spans = [], set(), 0.0, []
        blanks = np.flatnonzero(np.frombuffer(padded, np.uint8) == 32)
        for phrase, label in PHRASES.items():
            sought = f" {phrase} ".encode()
            at = padded.find(sought)
            while at >= 0:
                places.append(int(np.searchsorted(blanks, at)))
                labels.add(label)
                at = padded.find(sought, at + 1)
        line = padded.decode()
        if len(line) < len(padded):
            blanks = np.flatnonzero(np.frombuffer(line.encode("utf-32-le"), "<u4") == 32)
        before = lambda at: int(np.searchsorted(blanks, at))
        more = set()
        for notice, a, b, edits in self.spans(line):
            more.add(NOTICES[notice])
            score = max(score, 1 - edits / len(notice))
            spans.append((NOTICES[notice], before(a + 1) - 1 if a else 0, max(0, before(b) - 1), edits))
        return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)),
                ",".join(sorted(labels | more)), 1.0 if labels else score, spans)

    def rows(self, texts: list[bytes | None]) -> list[list]:
        return [list(c) for c in zip(*map(self.row, texts))]


SPAN = StructType([StructField("label", StringType()), StructField("from_word", LongType()),
                   StructField("to_word", LongType()), StructField("edits", IntegerType())])
FIELDS = [StructField(n, LongType()) for n in ("n_words", "n_base", "first_word", "last_word")] + [
    StructField("base_labels", StringType()), StructField("labels", StringType()), StructField("score", DoubleType()),
    StructField("spans", ArrayType(SPAN))]


def scan_licenses(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` plus word count, places of the exact phrases, labels, score and spans of every whole text.

    ``score`` is 1 for an exact phrase, else one minus the best notice's share of
    edits, else 0.  ``spans`` are the words from_word to to_word of each matched
    notice.  A null or empty text has no words and no labels.
    """

    def make():
        store = worker_store("licenses")
        if "scanner" not in store:
            store["scanner"] = Scanner()
        return store["scanner"].rows

    return add_columns(docs, FIELDS, make, keep, text)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir), ["doc_id"])
