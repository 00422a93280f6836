"""Finding and masking personal data, and cleaning drafted text of requests for it."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from corpusdesk.functions.text import fold_blanks, let, lines_of, lower_tr, strip

# Masks and patterns, applied in this order (specific before general).
PII_PATTERNS = {
    "id": (r"(?U)\b([1-9][0-9]{10})\b", "[TCKN_MASKED]"),
    "phone": (
        r"(?U)(?<![\w+])(\+90|0)[\s\-.]?[0-9]{3}[\s\-.]?[0-9]{3}[\s\-.]?[0-9]{2}[\s\-.]?[0-9]{2}\b",
        "[TEL_MASKED]",
    ),
    "email": (r"(?U)\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", "[EMAIL_MASKED]"),
    "name": (
        r"(?U)\b([A-ZÇĞİÖŞÜ][a-zçğıöşü]{2,}(?:\s+[A-ZÇĞİÖŞÜ][a-zçğıöşü]{2,}){1,2})\b",
        "[AD_SOYAD_MASKED]",
    ),
}
# An addition for texts with numbers such as +1 (743) 555-3824.
INTL_PHONE = (r"(?U)(?<![\w+])\+[0-9]{1,3}[\s\-.]?\(?[0-9]{2,4}\)?(?:[\s\-.]?[0-9]{2,4}){2,4}\b", "[TEL_MASKED]")
INTL_PATTERNS = {
    "id": PII_PATTERNS["id"],
    "phone": PII_PATTERNS["phone"],
    "intl_phone": INTL_PHONE,
    "email": PII_PATTERNS["email"],
    "name": PII_PATTERNS["name"],
}

# Words that name a personal datum, and marks of a line that asks for one.
PII_TERMS = (
    r"t\.?\s*c\.?\s*kimlik|tckn|kimlik\s*numara|öğrenci\s*numara|ogrenci\s*numara"
    r"|ad(?:ınız)?\s*(?:ve)?\s*soyad|doğum\s*tarih"
)
REQUEST_MARK = (
    r":\s*$|\?\s*$|\b(?:belirt|yaz|gir|ilet|sağla|sagla|paylaş|paylas|ekle|gönder|gonder"
    r"|bildir|doldur|beyan|sun|göster|goster)\w*\b"
)
PLACEHOLDER = r"\[[^\]\n]{1,60}\]"
LIST_ITEM = r"^\s*(?:[-•*]|\d+[.)]|\w[^:\n]{0,40}:)"
SHORT_LINE = 60
REPEAT_MIN = 25

_IGNORE_CASE = "(?iuU)"


def mask_pii(text: Column, patterns: dict = PII_PATTERNS) -> Column:
    out = text
    for pattern, mask in patterns.values():
        out = F.regexp_replace(out, pattern, mask)
    return out


def has_pii(text: Column, patterns: dict = PII_PATTERNS) -> Column:
    found = F.lit(False)
    for pattern, _ in patterns.values():
        found = found | text.rlike(pattern)
    return found


def pii_counts(text: Column, patterns: dict = PII_PATTERNS) -> dict[str, Column]:
    """Matches per class on the untouched text."""
    return {name: F.regexp_count(text, F.lit(pattern)) for name, (pattern, _) in patterns.items()}


def mask_email_address(address: Column) -> Column:
    """Keep two letters of the local part and the domain."""
    local = F.regexp_extract(address, r"(?s)^(.*)@[^@]*$", 1)
    domain = F.regexp_extract(address, r"(?s)^.*@([^@]*)$", 1)
    return F.when(F.coalesce(address, F.lit("")).contains("@"),
                  F.concat(F.substring(local, 1, 2), F.lit("***@"), domain)).otherwise("***")


def pseudonymize(address: Column) -> Column:
    return F.sha2(F.lower(strip(address)), 256)


def _join(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def strip_pii_requests(text: Column) -> Column:
    """Drop lines that ask for personal data; prose that merely mentions it stays."""

    def asks(bare: Column) -> Column:
        naked = strip(bare)
        looks_like = F.regexp_like(naked, F.lit(_IGNORE_CASE + f"(?:{REQUEST_MARK})")) | (F.length(naked) < SHORT_LINE)
        return bare.rlike(_IGNORE_CASE + f"(?:{PII_TERMS})") & looks_like

    def stays(line: Column) -> Column:
        return ~let(F.regexp_replace(line, PLACEHOLDER, ""), asks)

    return _join(F.filter(lines_of(text), stays))


def strip_placeholders(text: Column) -> Column:
    """Remove [placeholders]; a line that was little else goes with them."""

    def clean(line: Column) -> Column:
        return F.regexp_replace(line, PLACEHOLDER, "")

    def stays(line: Column) -> Column:
        rest = F.regexp_replace(clean(line), r"\A[ \-•\t:,.]+|[ \-•\t:,.]+\z", "")
        return ~(line.rlike(PLACEHOLDER) & (F.length(rest) < 3))

    return _join(F.transform(F.filter(lines_of(text), stays), clean))


def dedupe_lines(text: Column) -> Column:
    """Keep the first of equal long lines.

    Sorting (key, position) brings equal lines together, so a document of n
    lines costs n log n inside its own row instead of a comparison of all pairs.
    """
    keyed = F.transform(
        lines_of(text),
        lambda x, i: F.struct(lower_tr(fold_blanks(x)).alias("key"), i.alias("i"), x.alias("line")),
    )

    def first_ones(ordered: Column) -> Column:
        before = F.concat(F.array(F.lit(None).cast("string")), ordered["key"])
        paired = F.arrays_zip(ordered.alias("cur"), before.alias("prev"))
        kept = F.filter(
            paired,
            lambda z: z["cur"].isNotNull()
            & ((F.length(z["cur"]["key"]) <= REPEAT_MIN) | z["prev"].isNull() | (z["prev"] != z["cur"]["key"])),
        )
        back = F.transform(kept, lambda z: F.struct(z["cur"]["i"].alias("i"), z["cur"]["line"].alias("line")))
        return _join(F.sort_array(back)["line"])

    return let(F.sort_array(keyed), first_ones)


def drop_orphan_intros(text: Column) -> Column:
    """Drop a line ending in a colon unless a list item or a "key:" line follows."""
    numbered = F.transform(lines_of(text), lambda x, i: F.struct(i.alias("i"), x.alias("line")))

    def without_orphans(all_lines: Column) -> Column:
        filled = F.filter(all_lines, lambda e: strip(e["line"]) != "")
        blank = F.filter(all_lines, lambda e: strip(e["line"]) == "")

        def keep(full: Column) -> Column:
            following = F.concat(F.slice(full["line"], F.lit(2), F.greatest(F.size(full), F.lit(1))), F.array(F.lit("")))
            paired = F.arrays_zip(full.alias("cur"), following.alias("next"))
            kept = F.filter(
                paired,
                lambda z: z["cur"].isNotNull()
                & (~z["cur"]["line"].rlike(r"(?U):\s*\z") | z["next"].rlike("(?U)" + LIST_ITEM)),
            )
            return F.transform(kept, lambda z: z["cur"])

        return _join(F.sort_array(F.concat(let(filled, keep), blank))["line"])

    return let(numbered, without_orphans)


def sanitize_draft(text: Column) -> Column:
    """All draft clean-ups in order, then tidy blanks and punctuation; null stays null."""
    out = dedupe_lines(drop_orphan_intros(strip_placeholders(strip_pii_requests(text))))
    for pattern, new in (
        (r"[ \t]{2,}", " "),
        (r"(?U)\s+([,;.!?])", "$1"),
        (r"(?U)([,;])\s*([,;.])", "$2"),
        (r"[ \t]+\n", "\n"),
        (r"\n{3,}", "\n\n"),
    ):
        out = F.regexp_replace(out, pattern, new)
    return strip(out)


def encrypt_fields(fields: Column, key: Column) -> Column:
    """Base64 AES-GCM of the fields as JSON; the key comes from a secret setting."""
    return F.base64(F.aes_encrypt(F.to_json(fields).cast("binary"), key, F.lit("GCM")))


def decrypt_fields(token: Column, key: Column, schema: str = "map<string,string>") -> Column:
    plain = F.try_aes_decrypt(F.unbase64(token), key, F.lit("GCM")).cast("string")
    return F.from_json(plain, schema)
