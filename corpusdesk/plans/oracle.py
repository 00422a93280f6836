"""Pieces of DuckDB SQL shared by the checks.

DuckDB's regular expressions know no look-around and only ASCII word limits, so
limits are written as captured neighbours; replacing twice covers neighbours
that two matches share.
"""

from __future__ import annotations

from corpusdesk.functions.text import STOP_WORDS

NOT_WORD = r"(^|[^\p{L}\p{N}_])"
NOT_WORD_END = r"($|[^\p{L}\p{N}_])"
ID = r"([1-9][0-9]{10})"
PHONE = r"((?:\+90|0)[\s\-.]?[0-9]{3}[\s\-.]?[0-9]{3}[\s\-.]?[0-9]{2}[\s\-.]?[0-9]{2})"
EMAIL = r"([A-Za-z0-9_][A-Za-z0-9._%+\-]*@[A-Za-z0-9.\-]+\.[A-Za-z]{2,})"
NAME = r"([A-ZÇĞİÖŞÜ][a-zçğıöşü]{2,}(?:\s+[A-ZÇĞİÖŞÜ][a-zçğıöşü]{2,}){1,2})"
PII = (
    (NOT_WORD, ID, "[TCKN_MASKED]"),
    (r"(^|[^\p{L}\p{N}_+])", PHONE, "[TEL_MASKED]"),
    (NOT_WORD, EMAIL, "[EMAIL_MASKED]"),
    (NOT_WORD, NAME, "[AD_SOYAD_MASKED]"),
)


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sub(x: str, pattern: str, new: str) -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(new)}, 'g')"


WORD_ID = "\x01" + ID + "\x02"
WORD_NAME = ("\x01[A-ZÇĞİÖŞÜ][a-zçğıöşü]{2,}\x02(?:\\s+\x01[A-ZÇĞİÖŞÜ][a-zçğıöşü]{2,}\x02){1,2}")


def delimit(x: str) -> str:
    """Put marks around every word, so that a limit takes up no character of its own."""
    return sub(x, r"([\p{L}\p{N}_]+)", "\x01\\1\x02")


def undelimit(x: str) -> str:
    return sub(x, "[\x01\x02]", "")


def mask(x: str) -> str:
    x = undelimit(sub(delimit(x), WORD_ID, PII[0][2]))
    for before, core, new in PII[1:3]:
        for _ in range(2):
            x = sub(x, before + core + NOT_WORD_END, r"\1" + new + r"\3")
    return undelimit(sub(delimit(x), WORD_NAME, PII[3][2]))


def has_pii(x: str) -> str:
    return "(" + " or ".join(f"regexp_matches({x}, {lit(b + c + NOT_WORD_END)})" for b, c, _ in PII) + ")"


def strip(x: str) -> str:
    return sub(x, r"^\s+|\s+$", "")


def fold(x: str) -> str:
    return strip(sub(x, r"\s+", " "))


def lower_tr(x: str) -> str:
    return f"lower(replace({x}, 'İ', 'i'))"


def lines(x: str) -> str:
    return f"(case when {x} = '' then [] else string_split({sub(x, chr(10) + r'$', '')}, chr(10)) end)"


def normalize(x: str) -> str:
    for pattern, new in (
        (r"\r\n?", "\n"), ("\xa0", " "), ("​", ""), (r"([\p{L}\p{N}_])-\n([a-zçğıöşü])", r"\1\2"),
        (r"[ \t]+", " "), (r" *\n *", "\n"), (r"\n{3,}", "\n\n"),
    ):
        x = sub(x, pattern, new)
    return strip(x)


def html(x: str) -> str:
    for pattern, new in (
        (r"(?is)<script[^>]*>.*?</script>", ""), (r"(?is)<style[^>]*>.*?</style>", ""),
        (r"(?i)<br\s*/?>", "\n"), (r"(?i)</?p[^>]*>", "\n"), (r"<[^>]+>", ""),
    ):
        x = sub(x, pattern, new)
    for entity, new in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
        x = f"replace({x}, {lit(entity)}, {lit(new)})"
    return strip(sub(x, r"\n{3,}", "\n\n"))


def words(x: str) -> str:
    return f"regexp_extract_all({x}, '\\S+')"


def tokens(x: str) -> str:
    stops = "[" + ", ".join(lit(w) for w in STOP_WORDS) + "]"
    return f"list_filter(regexp_extract_all({lower_tr(x)}, '[\\p{{L}}\\p{{N}}]+'), lambda t: not list_contains({stops}, t))"


def stamp(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"
