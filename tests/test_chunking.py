import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from corpusdesk.functions.text import normalize_text
from corpusdesk.operators import chunking as ch

REGULATION = "\n".join([
    "ÖRNEK YÖNETMELİK metni, resmi gazetede yayımlanan sürümdür.",
    "BİRİNCİ BÖLÜM",
    "Amaç ve Kapsam",
    "Amaç",
    "MADDE 1 – (1) Bu yönetmelik amaçları düzenler. Kapsam",
    "Madde 2 - Bu yönetmelik öğrencileri kapsar.",
    "Kredi transferi",
    "ve intibak",
    "MADDE 10 ",
    "– ",
    "(1) Uygulama 14 üncü ve 44 üncü maddelere göredir.",
    "MADDE 3 – geriye giden numara",
    "İKİNCİ BÖLÜM",
    "MADDE 41 – metin",
    "MADDE 41/A – (Ek:RG-1) metin",
    "GEÇİCİ MADDE 1 —(Ek) metin",
    "geçici madde 2 - metin",
    "EK",
    "MADDE 1 – ek metin",
])


def frame(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def sections(spark, text):
    rows = ch.article_split(frame(spark, text)).orderBy("section_no").collect()
    return [(r["prefix"], r["no"]) for r in rows], rows


def test_headings_accept_variants_and_drop_backward_numbers(spark):
    got, rows = sections(spark, REGULATION)
    assert got == [("", "1"), ("", "2"), ("", "10"), ("", "41"), ("", "41/A"),
                   ("GEÇİCİ", "1"), ("GEÇICI", "2"), ("EK", "1")]


def test_sections_rebuild_the_text(spark):
    r = ch.article_sections(frame(spark, REGULATION)).first()
    assert r["preamble"] + "".join(s["body"] for s in r["sections"]) == r["norm"]
    for s in r["sections"]:
        assert r["norm"][s["pos"]:].startswith(s["body"])


def test_acceptance_equals_a_plain_loop(spark):
    rng = random.Random(5)
    texts, want = [], []
    for _ in range(200):
        best, accepted, lines = {}, [], ["giriş"]
        for _ in range(rng.randint(0, 12)):
            pre, n, a = rng.choice(["", "EK ", "GEÇİCİ "]), rng.randint(1, 15), rng.choice(["", "/A"])
            lines.append(f"{pre}MADDE {n}{a} – metin")
            value = n + (0.5 if a else 0)
            if value > best.get(pre, 0):
                best[pre] = value
                accepted.append((pre.strip(), f"{n}{a}"))
        texts.append("\n".join(lines))
        want.append(accepted)
    out = ch.article_sections(frame(spark, *texts)).orderBy("doc_id").collect()
    assert [[(s["prefix"], s["no"]) for s in r["sections"]] for r in out] == want


def test_titles_and_chapters(spark):
    metas = {r["meta"]["madde_prefix"] or "": r for r in ch.chunk_articles(frame(spark, REGULATION)).collect()}
    by_no = {(r["meta"]["madde_prefix"], r["meta"]["madde_no"]): r["meta"]
             for r in ch.chunk_articles(frame(spark, REGULATION)).collect()}
    assert by_no[(None, "1")]["baslik"] == "Amaç"
    assert by_no[(None, "2")]["baslik"] == "Kapsam"
    assert by_no[(None, "10")]["baslik"] == "Kredi transferi ve intibak"
    assert by_no[(None, "1")]["bolum"] == "BİRİNCİ BÖLÜM — Amaç ve Kapsam"
    assert by_no[(None, "41/A")]["bolum"] == "İKİNCİ BÖLÜM"
    assert metas


def test_preamble_is_kept_when_long_enough(spark):
    rows = ch.chunk_articles(frame(spark, REGULATION)).orderBy("chunk_index").collect()
    assert rows[0]["meta"]["kind"] == "preamble" and rows[0]["chunk_index"] == 0
    short = ch.chunk_articles(frame(spark, "kısa\nMADDE 1 – a")).collect()
    assert [r["meta"]["kind"] for r in short] == ["madde"]


def pack(spark, body):
    return spark.createDataFrame([(body,)], "b string").select(ch.paragraph_pack(F.col("b"))).first()[0]


def test_long_body_splits_at_paragraphs(spark):
    paras = [f"({i}) " + "kelime " * 100 for i in range(1, 8)]
    body = "MADDE 5 – giriş " + "".join(paras)
    parts = pack(spark, body)
    assert "".join(parts) == body and len(parts) > 1
    assert parts[0].startswith("MADDE 5") and all(len(p) < 2500 for p in parts)


def test_paragraph_numbers_must_be_in_sequence(spark):
    body = "x (1) " + "a" * 1500 + " (7) " + "b" * 600 + " (2) " + "c" * 900
    parts = pack(spark, body)
    assert "".join(parts) == body and len(parts) == 2 and parts[1].startswith("(2)")


def test_body_without_paragraphs_is_sliced(spark):
    body = "MADDE 5 – " + "z" * 4000
    parts = pack(spark, body)
    assert [len(p) for p in parts] == [1800, 1800, 410] and "".join(parts) == body
    assert pack(spark, "kısa") == ["kısa"]


def test_continued_parts_carry_the_article_number(spark):
    text = "Başlık\nMADDE 1 – giriş " + " ".join(f"({i}) " + "söz " * 200 for i in range(1, 6)) + "\nMADDE 2 – b"
    rows = ch.chunk_articles(frame(spark, text)).orderBy("chunk_index").collect()
    first = [r for r in rows if r["meta"]["madde_no"] == "1"]
    assert len(first) > 1 and first[1]["content"].startswith(f"Başlık\nMADDE 1 (devam 2/{len(first)})")
    assert all(r["meta"]["part_count"] == len(first) for r in first)


def test_is_regulation_needs_three_headings(spark):
    df = ch.is_regulation(frame(spark, "MADDE 1 – a\nMADDE 2 – b", "MADDE 1 – a\nMADDE 2 – b\nMADDE 3 – c"))
    assert [r["is_regulation"] for r in df.orderBy("doc_id").collect()] == [False, True]


def test_word_windows_cover_everything_and_overlap(spark):
    words = [f"w{i}" for i in range(1203)]
    rows = ch.chunk_words(frame(spark, " ".join(words), "tek", "")).orderBy("doc_id", "chunk_index").collect()
    first = [r["content"].split() for r in rows if r["doc_id"] == 0]
    assert [len(c) for c in first] == [500, 500, 303]
    assert first[0][-50:] == first[1][:50] and first[0] + first[1][50:] + first[2][50:] == words
    assert [r["content"] for r in rows if r["doc_id"] == 1] == ["tek"]


def test_char_budget_chunks(spark):
    text = "\n\n".join(" ".join(f"k{j}" for j in range(i * 60)) for i in range(1, 9))
    rows = ch.chunk_chars(frame(spark, text, "   ")).orderBy("chunk_index").collect()
    assert {r["doc_id"] for r in rows} == {0}
    assert all(len(r["content"]) <= 2500 for r in rows)
    assert set(re.findall(r"k\d+", text)) == set(re.findall(r"k\d+", " ".join(r["content"] for r in rows)))


def test_mode_choice(spark):
    kinds = ch.split_documents(frame(spark, REGULATION, "Düz metin.")).select("doc_id", "meta.kind").distinct().collect()
    assert {(r[0], r[1]) for r in kinds} == {(0, "preamble"), (0, "madde"), (1, "plain")}


def test_normalize(spark):
    raw = "yönet-\nmelik\r\nA\xa0B​C  \t d \n\n\n\n e "
    got = spark.createDataFrame([(raw,)], "t string").select(normalize_text(F.col("t"))).first()[0]
    assert got == "yönetmelik\nA BC d\n\ne"


def test_chunks_leave_a_task_in_pieces(monkeypatch):
    """A batch of texts is never held a second time as all of its chunks."""
    monkeypatch.setattr(ch, "PIECE_CHARS", 50)
    texts = [f"{i} " + "abcd " * 40 for i in range(30)]
    schema = pa.schema([("doc_id", pa.int64()), ("chunk_index", pa.int32()), ("content", pa.string())])
    batch = pa.RecordBatch.from_arrays([pa.array(range(30)), pa.array(texts)], names=["doc_id", "text"])
    pieces = list(ch._splitter(schema, 20, 0)([batch]))
    assert len(pieces) > 30 and max(sum(map(len, p["content"].to_pylist())) for p in pieces) < 50 + 20
    want = [(i, n, c) for i, t in enumerate(texts) for n, c in enumerate(ch._split_by_size(t, 20, 0, ("\n\n", "\n", " ", "")))]
    assert [tuple(r.values()) for p in pieces for r in p.to_pylist()] == want
