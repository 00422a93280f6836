"""Cleaning of mail bodies, building of search text, and reading of model output."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from corpusdesk.functions.text import html_to_text, let, lines_of, lower_tr, strip
from corpusdesk.params import QUERY, QueryParams

# Java flags: ignore case, multi-line anchors on \n only, Unicode classes.
_LINES = "(?imdU)"

# Starts of a quoted thread.
QUOTE_STARTS = (
    r"^-{2,}\s*Original Message\s*-{2,}",
    r"^_{5,}",
    r"^-{5,}",
    r"^From:\s",
    r"^Gönderen:\s",
    r"^Kimden:\s",
    r"^\s*\d{1,2}\s+\w+\s+\d{4}\s+.*(?:yazdı|wrote)\s*:",
    r"^On\s.+wrote:",
    r"^.*\b\d{1,2}[./]\d{1,2}[./]\d{2,4}\b.*\byazdı\s*:",
)
SIGNATURE_MARK = r"^--\s*$"
# Greetings and closings, and the lines of a signature block.
GREETINGS = (
    r"sayın[^\n]{0,60}|merhaba[^\n]{0,30}|iyi günler[^\n]{0,30}|selam[^\n]{0,30}|dear\s+[^\n]{0,40}"
    r"|saygılar[^\n]{0,40}|saygılarımla[^\n]{0,20}|iyi çalışmalar[^\n]{0,30}"
    r"|teşekkür(?:ler)?[^\n]{0,40}|teşekkür ederim[^\n]{0,20}"
    r"|gereğini[^\n]{0,40}|bilgilerinize[^\n]{0,40}|şimdiden teşekkür[^\n]{0,40}"
    r"|best regards[^\n]{0,30}|kind regards[^\n]{0,30}"
)
CONTACT_LINES = (
    r"(?:tel|gsm|cep|telefon|phone)\s*[:.]?\s*[+\d].*|[\w.+-]+@[\w.-]+\.\w+\s*|https?://\S+\s*"
    r"|(?:prof|doç|dr|arş\.?\s*gör|öğr\.?\s*gör)\.?\s.*"
)
# Headers and senders of automatic mail.
AUTO_HEADERS = ("auto-submitted", "x-autorespond", "x-auto-response-suppress")
BULK_PRECEDENCE = ("bulk", "junk", "list")
AUTO_SENDER = r"^(noreply|no-reply|mailer-daemon)"

# The intents, the label of each, and the ones that lead to a mail.
INTENT_LABELS = {
    "transcript_request": "Transkript belgesi talebi",
    "certificate_request": "Öğrenci belgesi / sertifika talebi",
    "enrollment_letter": "Kayıt belgesi talebi",
    "leave_of_absence": "İzin / kayıt dondurma talebi",
    "complaint": "Şikayet veya itiraz",
    "grade_objection": "Not itirazı",
    "general_question": "Genel bilgi sorusu (e-posta gerektirmez)",
    "other": "Diğer",
}
MAIL_INTENTS = (
    "transcript_request", "certificate_request", "enrollment_letter",
    "leave_of_absence", "complaint", "grade_objection",
)
# Fields to collect per intent.
REQUIRED_FIELDS = {
    "transcript_request": ["academic_year", "semester", "language"],
    "certificate_request": ["document_type", "purpose"],
    "enrollment_letter": ["purpose", "language"],
    "leave_of_absence": ["reason", "duration"],
    "grade_objection": ["course_code", "exam_type", "objection_reason"],
    "complaint": ["subject", "description"],
}
INTENT_DEPARTMENT = {intent: "ogrenci_isleri" for intent in MAIL_INTENTS}

# Words that approve or cancel a draft.
APPROVE_WORDS = ("evet", "tamam", "gönder", "onaylıyorum", "ok", "uygun")
REVIEW_CANCEL_WORDS = ("hayır", "iptal", "değiştir", "istemiyorum", "vazgeç")
COLLECT_CANCEL_WORDS = ("iptal", "vazgeç", "istemiyorum", "cancel")

# Unfilled name slots, in the order in which they are filled.
NAME_SLOTS = (
    r"\[\s*isim\s*\]", r"\[\s*İsim\s*\]", r"\[\s*ad\s*\]", r"\[\s*Ad\s*\]", r"\[\s*adı\s*\]",
    r"\[\s*öğrenci\s*(?:adı|ad)\s*\]", r"\[\s*Öğrenci\s*(?:Adı|Ad)\s*\]", r"\[\s*name\s*\]",
    r"\{\s*name\s*\}", r"\{\{\s*name\s*\}\}", r"\{\s*isim\s*\}",
)
META_LINE = r"^\s*(?:Konu|Gönderen|Talep\s*tipi|E-posta\s*içeri[gğ]i|Subject|From|Intent)\s*:\s*.*$"
SOURCE_TAG = r"\s*\[Kaynak\s*(?:\d+|N)(?:\s*[—–-]\s*[^\]]+)?\]\s*"
JSON_LEAKS = (
    r'^\s*\{\s*"subject"\s*:\s*"[^"]*"\s*,\s*"body"\s*:\s*"?',
    r'^\s*\{\s*"[^"]{1,80}"\s*:\s*"?',
)


def body_or_html(body: Column, html: Column) -> Column:
    return F.coalesce(F.nullif(body, F.lit("")), html_to_text(html))


def message_id_or_generated(message_id: Column, raw: Column, domain: str) -> Column:
    made = F.concat(F.lit("<generated-"), F.md5(raw), F.lit(f"@{domain}>"))
    return F.coalesce(F.nullif(F.trim(message_id), F.lit("")), made)


def is_auto_reply(headers: Column, sender: Column) -> Column:
    """``headers`` is a MAP of lower-case header names."""
    marked = F.lit(False)
    for name in AUTO_HEADERS:
        marked = marked | (F.coalesce(F.try_element_at(headers, F.lit(name)), F.lit("")) != "")
    precedence = F.lower(F.coalesce(F.try_element_at(headers, F.lit("precedence")), F.lit("")))
    return marked | precedence.isin(*BULK_PRECEDENCE) | F.lower(F.coalesce(sender, F.lit(""))).rlike(AUTO_SENDER)


# Zone names of mail dates and their offsets.
ZONES = (
    ("GMT|UTC|UT|Z", "+0000"), ("EST", "-0500"), ("EDT", "-0400"), ("CST", "-0600"), ("CDT", "-0500"),
    ("MST", "-0700"), ("MDT", "-0600"), ("PST", "-0800"), ("PDT", "-0700"),
)


def to_naive_utc(stamp: Column, default: Column) -> Column:
    """RFC 2822 style date -> UTC without zone (session zone UTC).

    The day name, a comment and the seconds may be missing, the zone may be a name,
    and a year of two digits belongs to 1950-2049.
    """
    bare = F.regexp_replace(stamp, r"^\s*[A-Za-z]{3},\s*|\s*\([^)]*\)\s*$", "")
    bare = F.trim(F.regexp_replace(bare, r"\s+", " "))
    bare = F.regexp_replace(bare, r"^(\d{1,2} [A-Za-z]{3}) ([0-4]\d) ", "$1 20$2 ")
    bare = F.regexp_replace(bare, r"^(\d{1,2} [A-Za-z]{3}) ([5-9]\d) ", "$1 19$2 ")
    bare = F.regexp_replace(bare, r"( \d{1,2}:\d{2})(?= |$)", "$1:00")
    for names, offset in ZONES:
        bare = F.regexp_replace(bare, rf" (?:{names})$", f" {offset}")
    parsed = F.coalesce(
        F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z")),
        F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss")),
    )
    return F.coalesce(parsed, default)


def trim_quoted(text: Column) -> Column:
    """Cut the quoted thread, the signature below its mark, and ">" lines."""
    own = F.split(text, _LINES + "(?:" + "|".join(QUOTE_STARTS) + ")", 2)[0]
    own = F.split(own, "(?mdU)" + SIGNATURE_MARK, 2)[0]
    lines = F.filter(F.split(own, "\n"), lambda s: ~s.rlike(r"(?U)^\s*>"))
    return strip(F.array_join(lines, "\n"))


def strip_boilerplate(text: Column) -> Column:
    """Remove greetings, closings, contact lines and left-over bare names."""
    out = F.regexp_replace(text, _LINES + rf"^\s*(?:{GREETINGS})\s*[,.]?\s*$", "")
    out = F.regexp_replace(out, _LINES + rf"^\s*(?:{CONTACT_LINES})$", "")

    def bare_name(line: Column) -> Column:
        s = strip(line)
        return (F.length(s) < 30) & s.rlike(r"^\p{Lu}[\p{L} ]* [\p{L} ]*$")

    kept = F.filter(F.split(out, "\n"), lambda s: ~bare_name(s))
    return strip(F.regexp_replace(F.array_join(kept, "\n"), r"\n{2,}", "\n"))


def search_text(raw: Column, p: QueryParams = QUERY) -> Column:
    """Cleaned text, or the raw one when cleaning left too little; at most max_chars."""
    raw = F.coalesce(raw, F.lit(""))
    chosen = let(strip_boilerplate(trim_quoted(raw)),
                 lambda clean: F.when(F.length(clean) < p.min_chars, strip(raw)).otherwise(clean))
    return F.substring(chosen, 1, p.max_chars)


def trusted_intent(intent: Column, confidence: Column, p: QueryParams = QUERY) -> Column:
    return F.when(confidence.isNull() | (confidence >= p.min_confidence), intent)


def sub_queries(text: Column, subject: Column) -> Column:
    """ARRAY of search texts: the body, then the subject unless the body contains it."""
    s = F.coalesce(strip(subject), F.lit(""))
    return F.concat(F.array(text), F.when((s != "") & ~F.contains(text, s), F.array(s)).otherwise(F.array().cast("array<string>")))


def parse_intent(raw: Column) -> Column:
    """STRUCT(intent, confidence, requires_email) from a classifier's raw answer."""

    def unfence(clean: Column) -> Column:
        lines = F.filter(F.split(clean, "\n"), lambda s: ~s.startswith("```"))
        return F.when(clean.startswith("```"), F.array_join(lines, "\n")).otherwise(clean)

    def block(clean: Column) -> Column:
        found = F.regexp_extract(clean, r'(\{[^{}]*"intent"[^{}]*\})', 1)
        return F.coalesce(F.nullif(found, F.lit("")), clean)

    def read(data: Column) -> Column:
        def given(name: str) -> Column:
            return F.try_variant_get(data, f"$.{name}", "variant").isNotNull()

        number = F.when(given("confidence"), F.try_variant_get(data, "$.confidence", "string").try_cast("double")
                        ).otherwise(F.lit(0.7))
        usable = F.coalesce(F.startswith(F.schema_of_variant(data), F.lit("OBJECT")) & number.isNotNull(), F.lit(False))
        name = F.when(given("intent"), F.try_variant_get(data, "$.intent", "string")).otherwise("other")
        return F.struct(F.when(usable, name).otherwise("general_question").alias("intent"),
                        F.when(usable, number).otherwise(F.lit(0.5)).alias("confidence"))

    answer = let(F.try_parse_json(let(let(strip(raw), unfence), block)), read)
    return let(answer, lambda a: F.struct(
        a["intent"].alias("intent"), a["confidence"].alias("confidence"),
        F.coalesce(a["intent"].isin(*MAIL_INTENTS), F.lit(False)).alias("requires_email")))


def reply_json_block(raw: Column) -> Column:
    """The JSON part of a reply: fences removed, first brace to last brace."""

    def unfence(clean: Column) -> Column:
        fences = F.split(clean, "```")
        after_json = F.split(F.split(clean, "```json", 2)[1], "```", 2)[0]
        return (
            F.when(clean.contains("```json"), after_json)
            .when(F.size(fences) >= 3, fences[1])
            .otherwise(clean)
        )

    def braces(clean: Column) -> Column:
        found = F.regexp_extract(clean, r"(?s)(\{.*\})", 1)
        return F.when(found != "", found).otherwise(strip(clean))

    return let(let(strip(raw), unfence), braces)


def parse_reply(raw: Column, subject: Column) -> Column:
    """STRUCT(subject, body) from a model's reply; raw text when it is no JSON object."""
    parsed = F.from_json(reply_json_block(raw), "map<string,string>", {"allowUnquotedControlChars": "true"})
    default = F.concat(F.lit("Re: "), F.coalesce(F.nullif(subject, F.lit("")), F.lit("Yanıt")))

    def read(data: Column) -> Column:
        def field(name: str, fallback: Column) -> Column:
            given = F.coalesce(F.map_contains_key(data, name), F.lit(False))
            return F.when(given, F.try_element_at(data, F.lit(name))).otherwise(fallback)

        return F.struct(field("subject", default).alias("subject"), field("body", raw).alias("body"))

    return let(parsed, read)


def sanitize_reply(body: Column, sender: Column) -> Column:
    """Remove leaked JSON, tags and meta lines, fill the name, force the greeting."""
    out = F.coalesce(body, F.lit(""))
    for leak in JSON_LEAKS:
        out = F.regexp_replace(out, "(?U)" + leak, "")
    out = F.regexp_replace(F.regexp_replace(out, r"(?U)\s+\z", ""), r'(?U)"\s*\}\s*\z', "")
    out = F.regexp_replace(out, "(?U)" + SOURCE_TAG, " ")
    out = F.regexp_replace(out, r"(?iU)\bYÖNETMEL[İI]K\s+B[İI]LG[İI]S[İI]\b\s*", "")
    out = F.regexp_replace(out, r"(?iU)\brag_context\b\s*", "")
    out = F.regexp_replace(out, _LINES + META_LINE, "")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    name = F.coalesce(F.nullif(strip(sender), F.lit("")), F.lit("Öğrenci"))
    literal = F.regexp_replace(name, r"([\\$])", r"\\$1")
    for slot in NAME_SLOTS:
        out = F.regexp_replace(out, F.lit("(?iU)" + slot), literal)
    greeting = F.concat(F.lit("Sayın "), name, F.lit(","))
    greet = r"(?iU)^\s*Sayın\s+[^,\n]{1,60},?\s*(.*)$"

    def greeted(lines: Column) -> Column:
        tail = F.slice(lines, F.lit(2), F.greatest(F.size(lines), F.lit(1)))
        rest = let(lines[0], lambda first: F.when(
            first.rlike(greet), strip(F.regexp_extract(first, greet, 1))).otherwise(first))
        kept = let(rest, lambda r: F.when(r != "", F.array(r)).otherwise(F.array().cast("array<string>")))
        return F.array_join(F.concat(F.array(greeting), kept, tail), "\n")

    joined = let(lines_of(F.regexp_replace(out, r"(?U)\A\s+", "")), greeted)
    return strip(F.regexp_replace(joined, r"(?U)(\n[^\S\n]*)(?:\n[^\S\n]*)+(?=\n)", "$1"))


def any_word(text: Column, words: tuple, whole_word: bool = False) -> Column:
    low = lower_tr(text)
    if whole_word:
        return low.rlike(r"(?U)\b(?:" + "|".join(words) + r")\b")
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))


def decide_reply(text: Column, state: Column, whole_word: bool = False) -> Column:
    """Next state after a user's answer to a draft or to a question for a field."""
    review = (
        F.when(any_word(text, APPROVE_WORDS, whole_word), "PENDING_APPROVAL")
        .when(any_word(text, REVIEW_CANCEL_WORDS, whole_word), "CANCELLED")
        .otherwise("DRAFT_CREATED")
    )
    collect = F.when(any_word(text, COLLECT_CANCEL_WORDS, whole_word), "CANCELLED").otherwise("COLLECTING_INFO")
    return F.when(state == "DRAFT_CREATED", review).when(state == "COLLECTING_INFO", collect).otherwise(state)


def compose_reply(body: Column, note: Column) -> Column:
    body = F.coalesce(body, F.lit(""))
    noted = F.concat(F.regexp_replace(body, r"(?U)\s+\z", ""), F.lit("\n\nNOT: "), strip(note))
    return F.when(strip(F.coalesce(note, F.lit(""))) != "", noted).otherwise(body)


def context_preview(context: Column) -> Column:
    """STRUCT(source_count, preview) of a search context."""
    return F.struct(
        F.coalesce(F.regexp_count(context, F.lit(r"\[Kaynak")), F.lit(0)).alias("source_count"),
        F.when(F.length(context) > 1000, F.concat(F.substring(context, 1, 1000), F.lit("...")))
        .otherwise(context).alias("preview"),
    )


def merge_fields(collected: Column, extracted: Column, required: Column) -> Column:
    """STRUCT(collected, missing): only absent required keys with a value are added."""
    fresh = F.map_filter(
        extracted,
        lambda k, v: F.array_contains(required, k) & ~F.map_contains_key(collected, k) & (F.coalesce(v, F.lit("")) != ""),
    )
    merged = F.map_concat(collected, fresh)
    return F.struct(merged.alias("collected"), F.array_except(required, F.map_keys(merged)).alias("missing"))


def draft_query(collected: Column, label: Column) -> Column:
    """Search text of a draft: its collected values, else the label of its intent."""
    values = F.filter(F.map_values(collected), lambda v: F.coalesce(v, F.lit("")) != "")
    return F.coalesce(F.nullif(F.array_join(values, " "), F.lit("")), label)


def valid_token(token: Column) -> Column:
    return F.coalesce(token.rlike(r"^[A-Za-z0-9_-]{32,64}\n?\z"), F.lit(False))
