"""Structure-aware and plain chunking.

A document is one row, so headings, chapters, paragraphs and parts are worked
out inside that row with array functions.  Chunking therefore never shuffles:
text goes in, one ``posexplode`` comes out, in the task that read the file.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from corpusdesk.functions.text import let, normalize_text, strip, word_count
from corpusdesk.params import CHUNK, ChunkParams

# Article heading, chapter heading, paragraph mark, end of sentence.
PREFIXES = "GEÇİCİ|GEÇICI|GECICI|EK"
HEADING = (
    rf"[ \t]*(?:({PREFIXES})\s+)?MADDE[ \t\r\n]*"
    r"(\d{1,3}(?:\s*/\s*[A-ZÇĞİÖŞÜ])?)[ \t\r\n]*(?:[-–—]|\()"
)
CHAPTER = r"^[ \t]*([A-ZÇĞİÖŞÜ\w]+)\s+BÖLÜM[ \t]*$"
PARAGRAPH = r"\(\s*(\d{1,2})\s*\)"
SENTENCE_END = r"[.!?]\s+"

PIECE_CHARS = 1024 * 1024   # chunks leave a task in pieces of about so many letters

_HEAD_AT_START = r"(?iU)\A" + HEADING
_SPLIT_HEADS = rf"(?imdU)(?=^{HEADING})(?<!^(?:{PREFIXES})\s{{1,2}})"

META_TYPE = (
    "struct<v:int,kind:string,madde_no:string,madde_prefix:string,"
    "baslik:string,bolum:string,part:int,part_count:int>"
)


def _empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _heads(pieces: Column) -> Column:
    def head(piece: Column, i: Column) -> Column:
        no = F.replace(F.regexp_extract(piece, _HEAD_AT_START, 2), F.lit(" "), F.lit(""))
        base = F.regexp_extract(no, r"^(\d+)", 1).try_cast("double")
        return F.struct(
            i.alias("i"),
            F.upper(F.regexp_extract(piece, _HEAD_AT_START, 1)).alias("prefix"),
            no.alias("no"),
            (base + F.when(no.contains("/"), 0.5).otherwise(0.0)).alias("ord"),
            F.length(piece).alias("len"),
        )

    return F.transform(pieces, head)


def _accepted(heads: Column) -> Column:
    """Headings whose number exceeds all earlier ones with the same prefix."""
    start = F.struct(
        F.create_map().cast("map<string,double>").alias("best"),
        F.lit(0).alias("pos"),
        F.array().cast("array<struct<i:int,prefix:string,no:string,pos:int>>").alias("taken"),
    )

    def step(state: Column, h: Column) -> Column:
        top = F.try_element_at(state["best"], h["prefix"])
        grows = F.coalesce(h["ord"].isNotNull() & (top.isNull() | (h["ord"] > top)), F.lit(False))
        best = F.map_concat(F.map_filter(state["best"], lambda k, v: k != h["prefix"]),
                            F.create_map(h["prefix"], h["ord"]))
        taken = F.concat(state["taken"], F.array(
            F.struct(h["i"].alias("i"), h["prefix"].alias("prefix"), h["no"].alias("no"), state["pos"].alias("pos"))))
        return F.struct(
            F.when(grows, best).otherwise(state["best"]).alias("best"),
            (state["pos"] + h["len"]).alias("pos"),
            F.when(grows, taken).otherwise(state["taken"]).alias("taken"),
        )

    return F.aggregate(heads, start, step)["taken"]


def _sections_of(norm: Column) -> Column:
    """STRUCT(preamble, sections) of a normalised text."""

    def cut(pieces: Column, taken: Column) -> Column:
        def section(t: Column, k: Column) -> Column:
            end = F.coalesce(F.get(taken, k + 1)["i"], F.size(pieces))
            return F.struct(
                t["no"].alias("no"), t["prefix"].alias("prefix"), t["pos"].alias("pos"),
                F.array_join(F.slice(pieces, t["i"] + 1, end - t["i"]), "").alias("body"),
            )

        first = F.coalesce(F.get(taken, F.lit(0))["i"], F.size(pieces))
        return F.struct(
            F.array_join(F.slice(pieces, F.lit(1), first), "").alias("preamble"),
            F.transform(taken, section).alias("sections"),
        )

    return let(F.split(norm, _SPLIT_HEADS), lambda pieces: let(_accepted(_heads(pieces)), lambda taken: cut(pieces, taken)))


def article_sections(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``norm``, ``preamble`` and ``sections``, an array of
    STRUCT(no, prefix, pos, body), with one element per accepted heading."""
    found = let(normalize_text(F.col(text)), lambda norm: F.struct(norm.alias("norm"), _sections_of(norm).alias("s")))
    return df.withColumn("_found", found).withColumns(
        {"norm": F.col("_found.norm"), "preamble": F.col("_found.s.preamble"), "sections": F.col("_found.s.sections")}
    ).drop("_found")


def article_split(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per accepted article: (doc, section_no from 0, no, prefix, pos, body)."""
    return article_sections(df, text).select(
        doc_id, F.posexplode("sections").alias("section_no", "s")
    ).select(doc_id, "section_no", "s.no", "s.prefix", "s.pos", "s.body")


def is_regulation(df: DataFrame, text: str = "text", p: ChunkParams = CHUNK) -> DataFrame:
    """Adds ``is_regulation``: enough accepted headings."""
    out = article_sections(df, text)
    return out.withColumn("is_regulation", F.size("sections") >= p.article_threshold).drop("norm", "preamble", "sections")


def article_title(before: Column, p: ChunkParams = CHUNK) -> Column:
    """Title found in the text that precedes a heading, or the empty string."""

    def pick(lines: Column) -> Column:
        last = F.try_element_at(lines, F.lit(-1))
        wrapped = (F.size(lines) >= 2) & last.rlike(r"^\p{Ll}")
        joined = F.when(wrapped, F.concat(F.try_element_at(lines, F.lit(-2)), F.lit(" "), last)).otherwise(last)
        tail = F.element_at(F.split(joined, "(?U)" + SENTENCE_END), -1)
        title = F.when(strip(tail) != "", tail).otherwise(joined)
        title = F.regexp_replace(title, r"\A[ \-–—:;,]+|[ \-–—:;,]+\z", "")
        return F.when(F.length(title).between(1, p.title_max), title).otherwise("")

    lines = F.filter(F.transform(F.split(before, "\n"), strip), lambda s: s != "")
    return F.coalesce(let(lines, pick), F.lit(""))


def last_chapter(block: Column, p: ChunkParams = CHUNK) -> Column:
    """Name (and note) of the last chapter heading inside a block of text, or null."""
    pattern = F.lit("(?mdU)" + CHAPTER + r"(?=([\s\S]{0,120}))")
    name = F.try_element_at(F.regexp_extract_all(block, pattern, F.lit(1)), F.lit(-1))
    after = F.try_element_at(F.regexp_extract_all(block, pattern, F.lit(2)), F.lit(-1))
    note = F.get(F.filter(F.transform(F.split(after, "\n"), strip), lambda s: s != ""), F.lit(0))
    good = (F.length(note) <= p.chapter_note_max) & ~note.rlike(_HEAD_AT_START)
    return F.concat(name, F.lit(" BÖLÜM"), F.when(good, F.concat(F.lit(" — "), note)).otherwise(""))


def paragraph_pack(body: Column, p: ChunkParams = CHUNK) -> Column:
    """Parts of a long body: packed paragraphs (1), (2), ... or fixed slices."""
    mark = r"(?U)(?=(?:\A|(?<=\s))" + PARAGRAPH + ")"

    def paragraphs(pieces: Column) -> Column:
        # The first element collects what stands before "(1)".
        start = F.struct(F.lit(1).alias("want"), F.array(F.lit("")).alias("out"))

        def step(state: Column, piece: Column) -> Column:
            number = F.regexp_extract(piece, r"(?U)\A" + PARAGRAPH, 1).try_cast("int")
            opens = F.coalesce(number == state["want"], F.lit(False))
            n = F.size(state["out"])
            grown = F.concat(F.slice(state["out"], F.lit(1), n - 1),
                             F.array(F.concat(F.element_at(state["out"], -1), piece)))
            return F.struct(
                F.when(opens, state["want"] + 1).otherwise(state["want"]).alias("want"),
                F.when(opens, F.concat(state["out"], F.array(piece))).otherwise(grown).alias("out"),
            )

        return F.aggregate(pieces, start, step)["out"]

    def pack(paras: Column) -> Column:
        start = F.struct(_empty("string").alias("out"), F.lit("").alias("cur"))

        def step(state: Column, para: Column) -> Column:
            full = (state["cur"] != "") & (F.length(state["cur"]) + F.length(para) > p.article_target)
            return F.struct(
                F.when(full, F.concat(state["out"], F.array(state["cur"]))).otherwise(state["out"]).alias("out"),
                F.when(full, para).otherwise(F.concat(state["cur"], para)).alias("cur"),
            )

        packed = F.aggregate(
            F.slice(paras, F.lit(2), F.size(paras) - 1), start, step,
            lambda s: F.when(strip(s["cur"]) != "", F.concat(s["out"], F.array(s["cur"]))).otherwise(s["out"]),
        )
        return let(packed, lambda out: F.transform(
            out, lambda x, i: F.when(i == 0, F.concat(F.element_at(paras, 1), x)).otherwise(x)))

    slices = F.transform(
        F.sequence(F.lit(1), F.length(body), F.lit(p.article_target)),
        lambda at: F.substring(body, at, F.lit(p.article_target)),
    )
    split_up = let(
        paragraphs(F.split(body, mark)),
        lambda paras: F.when(F.size(paras) < 3, slices).otherwise(pack(paras)),
    )
    return F.when(F.length(body) <= p.article_max, F.array(body)).otherwise(split_up)


def _article_chunks(norm: Column, preamble: Column, sections: Column, p: ChunkParams) -> Column:
    """ARRAY of STRUCT(content, meta) for one document."""
    blocks = F.concat(F.array(preamble), F.transform(sections, lambda s: s["body"]))

    def article(s: Column, k: Column, chapters: Column) -> Column:
        begin = F.greatest(s["pos"] - p.title_window, F.lit(0))
        title = article_title(F.substring(norm, begin + 1, s["pos"] - begin), p)
        chapter = F.try_element_at(F.filter(F.slice(chapters, F.lit(1), k + 1), lambda c: c.isNotNull()), F.lit(-1))
        label = F.concat(F.when(s["prefix"] != "", F.concat(s["prefix"], F.lit(" "))).otherwise(""),
                         F.lit("MADDE "), s["no"])

        def parts(ctx: Column) -> Column:
            bodies, name = ctx["bodies"], ctx["title"]

            def part(b: Column, j: Column) -> Column:
                more = F.concat(label, F.lit(" (devam "), (j + 1).cast("string"), F.lit("/"),
                                F.size(bodies).cast("string"), F.lit(")"))
                top = F.concat(F.when(name != "", F.concat(name, F.lit("\n"))).otherwise(""),
                               F.when(j > 0, F.concat(more, F.lit("\n"))).otherwise(""))
                content = F.when(top != "", strip(F.concat(top, b))).otherwise(b)
                meta = F.struct(
                    F.lit(p.version).alias("v"), F.lit("madde").alias("kind"), s["no"].alias("madde_no"),
                    F.nullif(s["prefix"], F.lit("")).alias("madde_prefix"), F.nullif(name, F.lit("")).alias("baslik"),
                    ctx["chapter"].alias("bolum"), j.alias("part"), F.size(bodies).alias("part_count"),
                ).cast(META_TYPE)
                return F.struct(content.alias("content"), meta.alias("meta"))

            return F.transform(bodies, part)

        return let(F.struct(paragraph_pack(strip(s["body"]), p).alias("bodies"), title.alias("title"),
                            chapter.alias("chapter")), parts)

    articles = let(
        F.transform(blocks, lambda b: last_chapter(b, p)),
        lambda chapters: F.flatten(F.transform(sections, lambda s, k: article(s, k, chapters))),
    )
    opening = strip(preamble)
    first_meta = F.from_json(F.lit('{"v":%d,"kind":"preamble"}' % p.version), META_TYPE)
    kept_opening = F.when(
        (F.length(opening) > p.preamble_min) & (F.size(sections) > 0),
        F.array(F.struct(opening.alias("content"), first_meta.alias("meta"))),
    ).otherwise(F.array().cast(f"array<struct<content:string,meta:{META_TYPE}>>"))
    return F.concat(kept_opening, articles)


def chunk_articles(df: DataFrame, doc_id: str = "doc_id", text: str = "text", p: ChunkParams = CHUNK) -> DataFrame:
    """(doc, chunk_index, content, meta) with one chunk per article or part of it."""
    chunks = let(
        normalize_text(F.col(text)),
        lambda norm: let(_sections_of(norm), lambda d: _article_chunks(norm, d["preamble"], d["sections"], p)),
    )
    return df.select(doc_id, F.posexplode(chunks).alias("chunk_index", "c")).select(
        doc_id, "chunk_index", "c.content", "c.meta"
    )


def chunk_words(df: DataFrame, doc_id: str = "doc_id", text: str = "text",
                size: int = CHUNK.words, overlap: int = CHUNK.overlap) -> DataFrame:
    """(doc, chunk_index, content): windows of ``size`` words that share ``overlap``."""
    step = size - overlap

    def windows(words: Column) -> Column:
        last = F.greatest(F.ceil((F.size(words) - overlap) / step).cast("int") - 1, F.lit(0))
        return F.when(F.size(words) > 0, F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.array_join(F.slice(words, i * step + 1, F.lit(size)), " "),
        ))

    words = F.regexp_extract_all(F.col(text), F.lit(r"(?U)\S+"), F.lit(0))
    return df.select(doc_id, F.posexplode(let(words, windows)).alias("chunk_index", "content"))


def _split_by_size(text: str, size: int, overlap: int, separators: tuple[str, ...]) -> Iterator[str]:
    """Split at the coarsest separator that occurs, join small pieces, refine large ones."""
    sep = next((s for s in separators if s == "" or s in text), "")
    finer = separators[separators.index(sep) + 1:] if sep in separators else ()
    pieces = list(text) if sep == "" else [p for p in text.split(sep) if p]
    held: deque[str] = deque()
    letters = 0  # of the pieces held

    def width(more: int = 0) -> int:
        """Of the pieces held, and of one more of so many letters."""
        n = len(held) + (more > 0)
        return letters + more + len(sep) * max(n - 1, 0)

    def joined() -> Iterator[str]:
        body = sep.join(held).strip()
        if body:
            yield body

    for piece in pieces:
        if len(piece) > size and finer:
            yield from joined()
            held.clear()
            letters = 0
            yield from _split_by_size(piece, size, overlap, finer)
            continue
        if held and width(len(piece)) > size:
            yield from joined()
            while held and (width() > overlap or width(len(piece)) > size):
                letters -= len(held.popleft())
        held.append(piece)
        letters += len(piece)
    yield from joined()


def chunk_chars(df: DataFrame, doc_id: str = "doc_id", text: str = "text",
                size: int = CHUNK.words * CHUNK.chars_per_word,
                overlap: int = CHUNK.overlap * CHUNK.chars_per_word) -> DataFrame:
    """(doc, chunk_index, content): paragraphs, lines, words up to a character budget.

    A task holds one text and ``PIECE_CHARS`` letters of chunks beside the batch that it
    was given, not the chunks of all its texts.
    """
    schema = StructType([df.schema[doc_id], StructField("chunk_index", IntegerType()), StructField("content", StringType())])
    return df.where(strip(F.col(text)) != "").select(doc_id, text).mapInArrow(_splitter(to_arrow_schema(schema), size, overlap), schema)


def _splitter(schema: pa.Schema, size: int, overlap: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (doc, text) -> batches of chunks."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, places, chunks, letters = [], [], [], 0
            for row, body in enumerate(batch.column(1)):
                for place, chunk in enumerate(_split_by_size(body.as_py(), size, overlap, ("\n\n", "\n", " ", ""))):
                    rows.append(row)
                    places.append(place)
                    chunks.append(chunk)
                    letters += len(chunk)
                    if letters >= PIECE_CHARS:
                        yield _piece(batch.column(0), rows, places, chunks, schema)
                        rows, places, chunks, letters = [], [], [], 0
            if rows:
                yield _piece(batch.column(0), rows, places, chunks, schema)

    return split


def _piece(ids: pa.Array, rows: list[int], places: list[int], chunks: list[str], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [ids.take(pa.array(rows, pa.int64())), pa.array(places, pa.int32()), pa.array(chunks, schema.field("content").type)], schema=schema)


def split_documents(df: DataFrame, doc_id: str = "doc_id", text: str = "text", p: ChunkParams = CHUNK) -> DataFrame:
    """Regulations by article, everything else by size; same columns for both."""
    flagged = is_regulation(df.select(doc_id, text), text, p)
    plain_meta = F.from_json(F.lit('{"v":%d,"kind":"plain"}' % p.version), META_TYPE)
    plain = chunk_chars(flagged.where("not is_regulation"), doc_id, text,
                        p.words * p.chars_per_word, p.overlap * p.chars_per_word)
    return chunk_articles(flagged.where("is_regulation"), doc_id, text, p).unionByName(
        plain.withColumn("meta", plain_meta)
    )


def chunk_rows(chunks: DataFrame, docs: DataFrame, doc_id: str = "doc_id", tags: str = "tags") -> DataFrame:
    """Chunk table rows: inherited tags, word count, chunk id."""
    return chunks.join(docs.select(doc_id, tags), doc_id).select(
        F.concat_ws("-", doc_id, "chunk_index").alias("chunk_id"), doc_id, "chunk_index", "content",
        tags, word_count(F.col("content")).alias("word_count"),
    )
