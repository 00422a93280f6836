"""Decoding, type sniffing, HTML stripping, normalisation and tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from corpusdesk.params import SEARCH

DOCX_MIME = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"

# What ends a line besides a line feed; the pair comes first.
LINE_ENDS = ("\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029")

# The characters that count as white space at either end of a text.
WHITE_SPACE = "".join(map(chr, (
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))

# The Windows-1254 code page differs from Latin-1 here.
CP1254_80_9F = {
    0x80: "€", 0x82: "‚", 0x83: "ƒ", 0x84: "„", 0x85: "…", 0x86: "†", 0x87: "‡", 0x88: "ˆ",
    0x89: "‰", 0x8A: "Š", 0x8B: "‹", 0x8C: "Œ", 0x91: "‘", 0x92: "’", 0x93: "“", 0x94: "”",
    0x95: "•", 0x96: "–", 0x97: "—", 0x98: "˜", 0x99: "™", 0x9A: "š", 0x9B: "›", 0x9C: "œ", 0x9F: "Ÿ",
}
CP1254_LETTERS = {0xD0: "Ğ", 0xDD: "İ", 0xDE: "Ş", 0xF0: "ğ", 0xFD: "ı", 0xFE: "ş"}
CP1254_UNDEFINED = r"[\x{81}\x{8D}\x{8E}\x{8F}\x{90}\x{9D}\x{9E}]"

# Stop words of the Snowball project; the Turkish list in full, of the others the most frequent words.
STOP_LISTS = {
    "tr": (
        "acaba ama aslında az bazı belki biri birkaç birşey biz bu çok çünkü da daha de defa diye eğer en "
        "gibi hem hep hepsi her hiç için ile ise kez ki kim mı mu mü nasıl ne neden nerde nerede nereye "
        "niçin niye o sanki şey siz şu tüm ve veya ya yani"
    ).split(),
    "en": "a an and are as at be been but by for from had has have he her his i in is it its not of on or she that the their they this to was were which with you".split(),
    "de": "aber als am an auch auf aus bei bin bis das dass dem den der des die ein eine einem einen einer er es für hat ich im in ist mit nach nicht oder sich sie so und von war wie zu zum zur".split(),
    "fr": "au aux avec ce ces dans de des du elle en est et il je la le les leur lui mais ne nous on ou par pas pour qu que qui sa se son sur un une vous".split(),
    "es": "al como con de del el ella en es esta este la las lo los más me mi no o para pero por que se si sin su sus un una y ya".split(),
}
STOP_WORDS = sorted(set().union(*STOP_LISTS.values()))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once inside a larger expression.

    Without it an expression that a formula names three times is computed three
    times, and once per element when the formula is a lambda over an array.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lines_of(text: Column) -> Column:
    """Lines without their ends; one final line break adds no further line."""
    out = text
    for end in LINE_ENDS:
        out = F.replace(out, F.lit(end), F.lit("\n"))
    return let(out, lambda t: F.split(
        F.when(t.endswith("\n"), F.left(t, F.length(t) - 1)).otherwise(t), "\n"))


def strip(text: Column) -> Column:
    """Trim white space of every kind, not only blanks."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def fold_blanks(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def lower_tr(text: Column) -> Column:
    """Lower case in which a dotted capital I gives one plain letter."""
    return F.lower(F.replace(text, F.lit("İ"), F.lit("i")))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def decode_text(data: Column) -> Column:
    """UTF-8 (byte-order mark dropped), else Windows-1254, else UTF-8 with replacements."""
    utf8 = F.regexp_replace(F.decode(data, "UTF-8"), r"\A\x{FEFF}", "")
    latin = F.decode(data, "ISO-8859-1")
    table = {**CP1254_80_9F, **CP1254_LETTERS}
    single = F.translate(latin, "".join(map(chr, table)), "".join(table.values()))
    replaced = F.make_valid_utf8(data.cast("string"))
    return (
        F.when(F.is_valid_utf8(data.cast("string")), utf8)
        .when(~latin.rlike(CP1254_UNDEFINED), single)
        .otherwise(F.regexp_replace(replaced, r"\A\x{FEFF}", ""))
    )


def file_suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(?<=[^/])(\.[^./]+)$", 1))


def sniff_type(data: Column, name: Column, declared: Column) -> Column:
    """STRUCT(mime, reject_reason): decided by content; the claim only ever admits text."""
    head = F.hex(F.substring(data, 1, 5))
    as_latin = F.decode(data, "ISO-8859-1")
    looks_text = (
        (F.length(data) > 0)
        & ~as_latin.rlike(r"[\x00-\x08\x0E-\x1F\x7F]")
        & (F.is_valid_utf8(data.cast("string")) | ~as_latin.rlike(CP1254_UNDEFINED))
    )
    suffix = file_suffix(name)
    by_suffix = (
        F.when(suffix == ".txt", "text/plain")
        .when(suffix.isin(".md", ".markdown"), "text/markdown")
        .when(declared.startswith("text/"), "text/plain")
    )
    mime = F.when(head == "255044462D", "application/pdf").when(head.startswith("504B0304"), DOCX_MIME)
    reason = (
        F.when(suffix.isin(".pdf", ".docx"), "signature missing")
        .when(by_suffix.isNull(), "type unknown")
        .when(~looks_text, "binary content")
    )
    return F.struct(
        F.coalesce(mime, F.when(reason.isNull(), by_suffix)).alias("mime"),
        F.when(mime.isNull(), reason).alias("reject_reason"),
    )


def extractor_for(data: Column, name: Column, mime: Column) -> Column:
    """Which text extractor a file needs: pdf, docx or text."""
    suffix, mime = file_suffix(name), F.coalesce(mime, F.lit(""))
    return (
        F.when((mime == "application/pdf") | (suffix == ".pdf"), "pdf")
        .when((suffix == ".docx") | mime.contains("wordprocessingml"), "docx")
        .when(mime.startswith("text/") | suffix.isin(".txt", ".md", ".markdown"), "text")
        .when(F.hex(F.substring(data, 1, 5)) == "255044462D", "pdf")
        .otherwise("text")
    )


# Patterns of a simple HTML body and what stands for them.
HTML_PATTERNS = (
    (r"(?is)<script[^>]*>.*?</script>", ""),
    (r"(?is)<style[^>]*>.*?</style>", ""),
    (r"(?i)<br\s*/?>", "\n"),
    (r"(?i)</?p[^>]*>", "\n"),
    (r"<[^>]+>", ""),
)
# The entities that are resolved, in this order.
HTML_ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'))
BLANK_LINES = (r"\n{3,}", "\n\n")

# Characters and patterns that are evened out.  Each pattern starts with
# what is rare and matches only where something changes.
EVEN_CHARACTERS = (("\r\n", "\n"), ("\r", "\n"), ("\xa0", " "), ("\u200b", ""))
EVEN_PATTERNS = (
    (r"(?U)-\n(?<=\w-\n)(?=[a-zçğıöşü])", ""),
    (r"\t[ \t]*| [ \t]+", " "),
    (r" ?\n ?", "\n"),
    BLANK_LINES,
)


def html_to_text(html: Column) -> Column:
    """Readable text of a simple HTML body."""
    out = html
    for pattern, new in HTML_PATTERNS:
        out = F.regexp_replace(out, pattern, new)
    for entity, new in HTML_ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(new))
    return strip(F.regexp_replace(out, *BLANK_LINES))


def normalize_text(text: Column) -> Column:
    """Even out white space but keep line ends, which structure detection relies on."""
    out = text
    for old, new in EVEN_CHARACTERS:
        out = F.replace(out, F.lit(old), F.lit(new))
    for pattern, new in EVEN_PATTERNS:
        out = F.regexp_replace(out, pattern, new)
    return strip(out)


def tokenize(text: Column, stem: int | None = SEARCH.stem, lang: str | None = None) -> Column:
    """Lexemes in text order: letter/digit runs, lower case, stop words out, whole or cut to a stem.

    The stop words are those of ``lang``, of all listed languages by default.
    """
    raw = F.regexp_extract_all(lower_tr(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    kept = F.filter(raw, lambda t: ~t.isin(*(STOP_LISTS[lang] if lang else STOP_WORDS)))
    return kept if stem is None else F.transform(kept, lambda t: F.substring(t, 1, stem))


def runs(tokens: Column) -> Column:
    """ARRAY of STRUCT(lexeme, tf): the distinct tokens of one text with their counts.

    Sorting brings equal tokens together, so counting needs no exchange of rows.
    """

    def count(s: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.get(s, i - 1) != F.get(s, i - 2)))
        return let(starts, lambda at: F.transform(at, lambda p, k: F.struct(
            F.get(s, p - 1).alias("lexeme"), (F.coalesce(F.get(at, k + 1), F.size(s) + 1) - p).alias("tf"))))

    empty = F.array().cast("array<struct<lexeme:string,tf:int>>")
    # sort_array compares strings natively; array_sort calls an interpreted comparison
    return let(F.sort_array(tokens), lambda s: F.when(F.size(s) == 0, empty).otherwise(count(s)))
