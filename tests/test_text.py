import pytest
from pyspark.sql import functions as F

from corpusdesk.functions import mail, pii, sqlfuncs, text as tx
from corpusdesk.operators.corpus import validate_tags


def apply(spark, fn, *values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, t string").select("i", fn(F.col("t")).alias("o"))
    return [r["o"] for r in rows.orderBy("i").collect()]


@pytest.mark.parametrize("raw, want", [
    ("Kimlik 12345678901 var", "Kimlik [TCKN_MASKED] var"),
    ("01234567890x", "01234567890x"),
    ("123456789012", "123456789012"),
    ("+90 532 111 22 33", "[TEL_MASKED]"),
    ("tel:0532-111-22-33.", "tel:[TEL_MASKED]."),
    ("a.b+c@okul.example.org yaz", "[EMAIL_MASKED] yaz"),
    ("Çağla Öztürk geldi", "[AD_SOYAD_MASKED] geldi"),
    ("Ahmet geldi", "Ahmet geldi"),
    ("", ""),
])
def test_mask(spark, raw, want):
    once = apply(spark, pii.mask_pii, raw)[0]
    assert once == want
    assert apply(spark, pii.mask_pii, once) == [once]


def test_international_numbers_need_the_wider_set(spark):
    raw = "ara +1 (743) 555-3824 lütfen"
    assert apply(spark, pii.mask_pii, raw) == [raw]
    assert apply(spark, lambda c: pii.mask_pii(c, pii.INTL_PATTERNS), raw) == ["ara [TEL_MASKED] lütfen"]


def test_mask_null(spark):
    assert apply(spark, pii.mask_pii, None) == [None]


def test_mail_address(spark):
    got = apply(spark, pii.mask_email_address, "ahmet.yilmaz@okul.example.org", "a@b", "@b", "yok", None, "")
    assert got == ["ah***@okul.example.org", "a***@b", "***@b", "***", "***", "***"]


def test_requests_go_and_prose_stays(spark):
    prose = "[Ad Soyad] için hazırlanan belgenin bir örneği dosyaya konuldu ve ilgiliye duyuruldu."
    raw = f"TCKN bilginiz?\n{prose}\nöğrenci numaranız\nSon satır"
    assert apply(spark, pii.strip_pii_requests, raw) == [prose + "\nSon satır"]


def test_repeats_and_orphans(spark):
    raw = "Bu satır yirmi beş karakterden uzundur.\nkısa\nkısa\nBU satır  yirmi beş karakterden uzundur."
    assert apply(spark, pii.dedupe_lines, raw) == ["Bu satır yirmi beş karakterden uzundur.\nkısa\nkısa"]
    assert apply(spark, pii.drop_orphan_intros, "Eksik olanlar:\n\nson söz", "Ekler:\n\n- bir\n2. iki") == [
        "\nson söz", "Ekler:\n\n- bir\n2. iki"]


def test_sanitize_draft_handles_null_and_gaps(spark):
    assert apply(spark, pii.sanitize_draft, None, "", "lütfen [x] veya [y] , yazın\n\n\n\nson ") == [
        None, "", "lütfen veya, yazın\n\nson"]


def test_decode(spark):
    blobs = ["çğıöşü".encode(), "\ufeffa".encode(), "İĞŞığş€".encode("cp1254"), b"\x81\xfe"]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(blobs)], "i int, b binary")
    got = [r["o"] for r in df.select("i", tx.decode_text(F.col("b")).alias("o")).orderBy("i").collect()]
    assert got == ["çğıöşü", "a", "İĞŞığş€", b"\x81\xfe".decode("utf-8", errors="replace")]


def test_every_cp1254_byte(spark):
    rows = []
    for byte in range(0x80, 0x100):
        raw = b"ab" + bytes([byte]) + b"c"
        try:
            rows.append((byte, bytearray(raw), raw.decode("cp1254")))
        except UnicodeDecodeError:
            rows.append((byte, bytearray(raw), raw.decode("utf-8", errors="replace")))
    df = spark.createDataFrame(rows, "i int, b binary, want string")
    assert df.where(tx.decode_text(F.col("b")) != F.col("want")).count() == 0


@pytest.mark.parametrize("body, name, declared, want", [
    (b"%PDF-1.7 x", "a.txt", "text/plain", ("application/pdf", None)),
    (b"PK\x03\x04..", "a.docx", "", (tx.DOCX_MIME, None)),
    (b"MZ\x90", "a.pdf", "application/pdf", (None, "signature missing")),
    (b"metin", "a.md", "application/octet-stream", ("text/markdown", None)),
    (b"metin", "a.xyz", "text/html", ("text/plain", None)),
    (b"metin", "a.xyz", "application/pdf", (None, "type unknown")),
    (b"\x7fELF\x02", "a.txt", "text/plain", (None, "binary content")),
    (b"", "a.txt", "text/plain", (None, "binary content")),
])
def test_sniff(spark, body, name, declared, want):
    df = spark.createDataFrame([(bytearray(body), name, declared)], "b binary, n string, d string")
    assert tuple(df.select(tx.sniff_type(F.col("b"), F.col("n"), F.col("d")).alias("t")).first()["t"]) == want


def test_html(spark):
    raw = '<SCRIPT>x("</p>")</SCRIPT><style>p{}</style><p>a&nbsp;b</p><br/>c &amp;lt; <b>d</b>'
    assert apply(spark, tx.html_to_text, raw) == ["a b\n\nc < d"]


def test_quotes_and_signatures(spark):
    got = apply(spark, mail.trim_quoted, "soru\n\n-----Original Message-----\nx", "soru\n-- \nimza", "a\n> b\nc",
                "1 Ocak 2024 Pazartesi X yazdı:\neski", "On Mon, x wrote:\ny", "düz metin")
    assert got == ["soru", "soru", "a\nc", "", "", "düz metin"]


def test_boilerplate(spark):
    got = apply(spark, mail.strip_boilerplate, "Sayın Hocam,\ntranskript istiyorum\nSaygılarımla\nAhmet Yılmaz\nTel: +90 5",
                "Belge Ne Zaman?")
    assert got == ["transkript istiyorum", "Belge Ne Zaman?"]


def test_search_text_falls_back_and_is_cut(spark):
    quoted = "kısa soru\n-----Original Message-----\n" + "eski metin " * 20
    got = apply(spark, mail.search_text, quoted, "a" * 2000, None)
    assert got[0] == quoted.strip() and len(got[1]) == 1200 and got[2] == ""


def test_parse_intent(spark):
    got = apply(spark, mail.parse_intent, '{"intent":"complaint","confidence":0.9,"requires_email":false}', "```json\n{\"intent\":\"other\"}\n```",
                'Cevap: {"intent": "x", "confidence": "0.5"}', "bozuk", '{"intent":"a","confidence":"çok"}', "[1]")
    assert [tuple(g) for g in got] == [("complaint", 0.9, True), ("other", 0.7, False), ("x", 0.5, False),
                                       ("general_question", 0.5, False), ("general_question", 0.5, False), ("general_question", 0.5, False)]


def test_parse_reply(spark):
    got = apply(spark, lambda c: mail.parse_reply(c, F.lit("Konu")), '{"subject":"S","body":"a\nb\tc"}', '```json\n{"body":"x"}\n```', "düz metin")
    assert [tuple(g) for g in got] == [("S", "a\nb\tc"), ("Re: Konu", "x"), ("Re: Konu", "düz metin")]


@pytest.mark.parametrize("raw, sender, want", [
    ("Sayın Veli,\nKayıt dondurma süreci\nİyi günler", "Derya Ak", "Sayın Derya Ak,\nKayıt dondurma süreci\nİyi günler"),
    ("Belgeniz hazır", "Umut", "Sayın Umut,\nBelgeniz hazır"),
    ('{"subject": "Re: belge", "body": "Sayın Hocam, belge hazır."}', "Ece", "Sayın Ece,\nbelge hazır."),
    ("Sayın Kaya,\n[Kaynak 3 — rehber.pdf] Madde 9 uyarınca", "Kaya", "Sayın Kaya,\nMadde 9 uyarınca"),
    ("Sayın [ad], belge hazır.", None, "Sayın Öğrenci,\nbelge hazır."),
    (None, None, "Sayın Öğrenci,"),
])
def test_sanitize_reply(spark, raw, sender, want):
    df = spark.createDataFrame([(raw, sender)], "b string, s string")
    assert df.select(mail.sanitize_reply(F.col("b"), F.col("s"))).first()[0] == want


def test_decide(spark):
    said = ["Evet lütfen", "hayır", "bilmem", "çok güzel"]
    review = apply(spark, lambda c: mail.decide_reply(c, F.lit("DRAFT_CREATED")), *said)
    assert review == ["PENDING_APPROVAL", "CANCELLED", "DRAFT_CREATED", "PENDING_APPROVAL"]   # "ok" inside "çok"
    whole = apply(spark, lambda c: mail.decide_reply(c, F.lit("DRAFT_CREATED"), True), *said)
    assert whole[3] == "DRAFT_CREATED"


def test_auto_replies(spark):
    df = spark.createDataFrame(
        [(1, {"auto-submitted": "no"}, "a@b"), (2, {"precedence": "BULK"}, "a@b"), (3, {}, "NoReply@b"), (4, {"precedence": "x"}, "a@b"), (5, {}, None)],
        "i int, h map<string,string>, s string")
    got = df.select("i", mail.is_auto_reply(F.col("h"), F.col("s")).alias("a")).orderBy("i").collect()
    assert [r["a"] for r in got] == [True, True, True, False, False]


def test_tags(spark):
    got = apply(spark, validate_tags, '["a","b"]', "", "[]", '["a",1]', "{}", "bozuk", "[null]", None)
    assert [g["ok"] for g in got] == [True, True, True, False, False, False, False, True]
    assert got[0]["tags"] == ["a", "b"] and got[1]["tags"] == []


def test_tokens(spark):
    assert apply(spark, tx.tokenize, "Öğrencilerin TRANSKRİPT ve 2024/1 belgesi") == [["öğrencilerin", "transkript", "2024", "1", "belgesi"]]
    assert apply(spark, lambda c: tx.tokenize(c, stem=5, lang="tr"), "Öğrencilerin TRANSKRİPT ve the") == [["öğren", "trans", "the"]]
    got = apply(spark, lambda c: tx.runs(tx.tokenize(c, lang="tr")), "a b a c a", "", "ve")
    assert [[tuple(x) for x in g] for g in got] == [[("a", 3), ("b", 1), ("c", 1)], [], []]


def test_tokens_of_token_format(spark):
    good, bad = "a" * 43, "x"
    assert apply(spark, mail.valid_token, good, bad, "", None, "a" * 65, "a" * 40 + "!") == [True, False, False, False, False, False]


def test_sql_functions(spark):
    sqlfuncs.register(spark)
    row = spark.sql("""select mask_pii('tel 0532 111 22 33') m, has_pii('a@b.co') h, html_to_text('<p>a&amp;b</p>') t,
      normalize_text('a\\n\\n\\n\\nb  c') n, cosine_distance(array(1d, 0d), array(0d, 1d)) d""").first()
    assert tuple(row) == ("tel [TEL_MASKED]", True, "a&b", "a\n\nb c", 1.0)
    assert [r["content"] for r in spark.sql("select * from chunk_text('a b c d e', 3, 1)").collect()] == ["a b c", "c d e"]


def test_sorts_inside_rows_are_native(spark):
    """array_sort compares by an interpreted function; strings and structs without nulls need none."""
    from pyspark.sql import functions as F

    from corpusdesk.functions import pii, text

    rows = spark.createDataFrame([("b a b c a b",)], "t string")
    df = rows.select(text.runs(F.split("t", " ")).alias("runs"), pii.dedupe_lines(F.col("t")), pii.drop_orphan_intros(F.col("t")))
    assert "array_sort(" not in df._jdf.queryExecution().analyzed().toString()
    assert [tuple(r) for r in df.first()["runs"]] == [("a", 2), ("b", 3), ("c", 1)]
