"""Queries of the block chunker: sources are manuscripts, documents their pages, and every line with a letter or digit is a block."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks as B
from ..operators import geometry as G
from ..sources.stages import staged
from .layouts import printed
from .registry import query, spread, table

BLOCKS = r"""l AS (SELECT source AS doc, doc_id AS page, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM documents),
b AS (SELECT doc, page, row_number() OVER (PARTITION BY page ORDER BY k) - 1 AS block, trim(regexp_replace(line, '\s+', ' ', 'g')) AS text FROM l WHERE regexp_matches(line, '[\p{L}\p{N}]'))"""


def page_blocks(spark: SparkSession, d: str) -> DataFrame:
    """(doc, page, block, text, char_start, heading, language): short first lines without a final mark are headings."""
    pages = spread(table(spark, d, "documents"), "doc_id").select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"), F.col("lang").alias("language"))
    return G.plain(pages).withColumn("heading", (F.col("block") == 0) & (F.length("text") <= 60) & ~F.col("text").rlike(B.TERMINAL))


def _own(c: DataFrame) -> DataFrame:
    return c.withColumn("own", F.substring("content", (F.col("overlap_chars") + 1).cast("int"), F.length("content")))


def _letters(c: DataFrame) -> DataFrame:
    """Per manuscript the characters other than space of its chunks' own texts."""
    return _own(c).groupBy("doc").agg(F.sum(F.length(F.regexp_replace("own", r"\s", ""))).alias("chars"), F.max("token_count").alias("most"))


COVERED = f"WITH {BLOCKS} SELECT doc, sum(length(regexp_replace(text, '\\s', '', 'g')))::BIGINT AS chars, true AS fits FROM b GROUP BY doc"


@query(None)
def ch_pack(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk of every manuscript, packed from whole blocks with sections and page ranges."""
    return B.chunked(page_blocks(spark, d)).drop("spans")


@query(COVERED)
def ch_units(spark: SparkSession, d: str) -> DataFrame:
    """No character is lost or doubled between blocks and chunks."""
    return _letters(B.chunked(page_blocks(spark, d))).select("doc", "chars", F.lit(True).alias("fits"))


@query(COVERED)
def ch_window(spark: SparkSession, d: str) -> DataFrame:
    """The chunks cut again for a window of 256 tokens: all characters are there, each once, and every chunk fits."""
    parts = staged(page_blocks(spark, d), "parts")
    return _letters(B.windowed(B.chunked(parts), parts, 256)).select("doc", "chars", (F.col("most") <= 256).alias("fits"))


@query(None)
def ch_merge(spark: SparkSession, d: str) -> DataFrame:
    """Chunks below the least length that stay, as nothing on their page and in their section is before them or takes them."""
    return _own(B.chunked(page_blocks(spark, d))).filter(F.length("own") < 400).select("doc", "chunk_index", "page_start", "page_end", "section", F.length("own").alias("chars"))


@query(None)
def win_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Each chunk's overlap, and whether the chunk before it in its section ends so."""
    rows = _own(B.chunked(page_blocks(spark, d)))
    before = rows.select("doc", (F.col("chunk_index") + 1).alias("chunk_index"), F.substring("own", -F.lit(200), F.lit(200)).alias("end"), F.col("section").alias("of"))
    tail = F.substring("content", F.lit(1), (F.col("overlap_chars") - 2).cast("int"))
    found = rows.filter("overlap_chars > 0").join(before, ["doc", "chunk_index"])
    return found.select("doc", "chunk_index", "overlap_chars", (F.endswith(F.rtrim("end"), tail) & F.col("of").eqNullSafe(F.col("section"))).alias("repeats"))


@query(rf"""WITH {BLOCKS} SELECT page AS doc_id, block::BIGINT AS block, regexp_matches(text, '[.!?؟。！？…]["''”’)\]»]*$') OR (length(text) <= 48 AND (regexp_matches(text, '(?i)^[\s\p{{P}}\p{{S}}]*(?:(?:page|pg|p|صفحة|ص)[\s.:]*)?\p{{Nd}}{{1,4}}(?:\s*(?:/|of|من)\s*\p{{Nd}}{{1,4}})?[\s\p{{P}}\p{{S}}]*$')
  OR regexp_matches(text, '^(?:.{{0,40}}[|—–·•/-]\s*\p{{Nd}}{{1,4}}|\p{{Nd}}{{1,4}}\s*[|—–·•/-].{{0,40}})$'))) AS ends FROM b""")
def ch_endings(spark: SparkSession, d: str) -> DataFrame:
    """Whether each block of each document ends a paragraph: by its mark, or as a page number or running footer."""
    return page_blocks(spark, d).select(F.col("page").alias("doc_id"), "block", B.ends_paragraph(F.col("text")).alias("ends"))


@query(None)
def ch_searchable(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk with its language, direction, tokens and search text."""
    return B.searchable(B.chunked(page_blocks(spark, d))).select("doc", "chunk_index", "language", "direction", "token_count", "search_text")


@query(None)
def ch_rects(spark: SparkSession, d: str) -> DataFrame:
    """The printed pages' chunks and the rectangles of their lines, from placed words to highlights."""
    laid = G.page(printed(spark, d))
    of = table(spark, d, "documents").select(F.col("doc_id").alias("page"), F.col("source").alias("doc"))
    chunks = B.chunked(laid.blocks.join(of, "page"))
    lines = laid.lines.join(of, "page").select("doc", "page", "char_start", "char_end", F.col("x0").alias("x"), F.col("top").alias("y"), (F.col("x1") - F.col("x0")).alias("w"), (F.col("bottom") - F.col("top")).alias("h"))
    return B.highlights(chunks, lines).select("doc", "chunk_index", "page", F.size("rects").cast("long").alias("rects"))


@query("SELECT source AS doc, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS place FROM documents")
def win_numbered(spark: SparkSession, d: str) -> DataFrame:
    """Rows numbered inside hot groups by ranges, in falling order."""
    from ..operators.ordered import numbered

    rows = table(spark, d, "documents").select(F.col("source").alias("doc"), "doc_id", (-F.col("doc_id")).alias("key"))
    return numbered(rows, "doc", "key", "place").select("doc", "doc_id", (F.col("place") + 1).alias("place"))
