"""Queries over placed text: every document is a page whose words are put where a printer or a scanner would put them, and read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import geometry as G
from .registry import ITEMS_SQL, norm_sql, query, spread, table

#: Letters of the right-to-left script that Latin ones become in every third word.
LATIN, ARABIC = "abcdefghijklmnopqrstuvwxyz", "ابتثجحخدذرزسشصضطظعغفقكلمنه"


def _words(spark: SparkSession, d: str) -> DataFrame:
    """(page, i, word): every word of every document."""
    return spread(table(spark, d, "documents"), "doc_id").select(F.col("doc_id").alias("page"), F.posexplode(text.surface_words(F.col("text"))).alias("i", "word"))


@query(f"""WITH w AS ({ITEMS_SQL}), t AS (SELECT page, list_transform(w, lambda x, i: CASE WHEN i % 3 = 1 AND regexp_full_match(x, '[a-z]+') THEN translate(x, '{LATIN}', '{ARABIC}') ELSE x END) AS w FROM w)
SELECT page, k::BIGINT AS line, array_to_string(w[9 * k + 1:9 * k + 9], ' ') AS text FROM t, range(ceil(len(w) / 9.0)::BIGINT) r(k)""")
def lay_bidi(spark: SparkSession, d: str) -> DataFrame:
    """Lines of nine words, every third in Arabic letters, drawn as a right-to-left paragraph shows them, come out in the order they are read."""
    words = _words(spark, d).withColumn("line", F.floor(F.col("i") / 9))
    turned = (F.col("i") % 3 == 0) & F.col("word").rlike("^[a-z]+$")
    words = words.withColumns({"right": turned, "word": F.when(turned, F.translate("word", LATIN, ARABIC)).otherwise(F.col("word"))})
    said = Window.partitionBy("page", "line").orderBy("i")
    runs = words.withColumn("turn", F.coalesce((F.col("right") != F.lag("right").over(said)).cast("int"), F.lit(0))).withColumn("run", F.sum("turn").over(said))
    shown = F.row_number().over(Window.partitionBy("page", "line").orderBy(F.desc("run"), F.when(F.col("right"), -F.col("i")).otherwise(F.col("i"))))
    x = shown.cast("double") * 20
    return G.assembled(runs.select("page", "line", x.alias("x0"), (x + 15).alias("x1"), F.lit(10.0).alias("size"), F.col("word").alias("text"), F.lit("R").alias("base"))).select("page", "line", "text")


PAGES = f"""p AS (SELECT doc_id AS page, unnest(string_split(text, chr(10))) AS para, unnest(range(len(string_split(text, chr(10))))) AS k FROM documents),
w AS (SELECT page, row_number() OVER (PARTITION BY page ORDER BY k) - 1 AS k, w FROM (SELECT page, k, list_filter(string_split({norm_sql('para')}, ' '), lambda x: x <> '') AS w FROM p) WHERE len(w) > 0),
l AS MATERIALIZED (SELECT page, k, j, array_to_string(w[9 * j + 1:9 * j + 9], ' ') AS text, CASE WHEN k % 5 = 0 THEN 13 ELSE 10 END AS size, len(array_to_string(w[9 * j + 1:9 * j + 9], '')) AS chars FROM w, range(ceil(len(w) / 9.0)::BIGINT) r(j)),
body AS (SELECT page, arg_max(size, (n, -first)) AS body FROM (SELECT page, size, sum(chars) AS n, min(k) AS first FROM l GROUP BY ALL) GROUP BY page),
way AS (SELECT page, count(*) AS n, count(*) FILTER (j > 0) AS near FROM l WHERE NOT (k = 0 AND j = 0) GROUP BY page),
b AS (SELECT l.*, body, (k = 0 AND j = 0) OR (j = 0 AND (size <> lag(size) OVER o OR coalesce(n, 0) < 2 OR floor(0.25 * (n - 1)) < near)) AS opens FROM l JOIN body USING (page) LEFT JOIN way USING (page) WINDOW o AS (PARTITION BY page ORDER BY k, j)),
c AS (SELECT *, sum(opens::INTEGER) OVER (PARTITION BY page ORDER BY k, j) - 1 AS block FROM b),
t AS (SELECT page, block, string_agg(text, chr(10) ORDER BY k, j) AS text, count(*) AS lines, arg_min(size, (k, j)) AS size, first(body) AS body FROM c GROUP BY page, block)"""


@query(f"""WITH {PAGES} SELECT page, block::BIGINT AS block, text, (char_end - length(text))::BIGINT AS char_start, char_end::BIGINT AS char_end, lines <= 2 AND length(text) <= 120 AND size >= 1.2 * body AS heading
FROM (SELECT *, sum(length(text) + 2) OVER (PARTITION BY page ORDER BY block) - 2 AS char_end FROM t)""")
def lay_page(spark: SparkSession, d: str) -> DataFrame:
    """Every paragraph of every document printed, nine words to a line and every fifth paragraph in larger type, and laid out again: blocks, offsets and headings."""
    return G.page(printed(spark, d)).blocks.select("page", "block", "text", "char_start", "char_end", "heading")


def printed(spark: SparkSession, d: str) -> DataFrame:
    """The documents' words on pages: 12 from line to line, 24 to a new paragraph."""
    paragraphs = spread(table(spark, d, "documents"), "doc_id").select(F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("p", "text"))
    paragraphs = paragraphs.select("page", "p", F.explode(F.array(text.surface_words(F.col("text")))).alias("words")).filter(F.size("words") > 0)
    page = Window.partitionBy("page").orderBy("p")
    ways = F.sum(24 + 12 * F.floor((F.size("words") - 1) / 9)).over(page.rowsBetween(Window.unboundedPreceding, -1))
    words = paragraphs.withColumns({"k": F.dense_rank().over(page) - 1, "from": F.coalesce(ways, F.lit(0))}).select("page", "k", "from", F.posexplode("words").alias("i", "text"))
    words = words.withColumn("down", F.col("from") + 24 + 12 * F.floor(F.col("i") / 9))
    x = (F.col("i") % 9) * 400.0
    return words.select("page", x.alias("x0"), (x + 396).alias("x1"), F.col("down").cast("double").alias("baseline"), F.when(F.col("k") % 5 == 0, 13.0).otherwise(10.0).alias("size"), F.lit(False).alias("bold"), F.lit(True).alias("horizontal"), "text")


SCANNED = f"""w AS ({ITEMS_SQL}), n AS (SELECT page, w, ceil(len(w) / 9.0)::BIGINT AS n FROM w),
l AS (SELECT page, k, array_to_string(w[9 * k + 1:9 * k + 9], ' ') AS text, k % ((n + 1) // 2) AS row, k // ((n + 1) // 2) AS col, least(7 * length(w[9 * k + 1]), 99) AS conf FROM n, range(n) r(k)),
u AS (SELECT *, 24 * row + 30 * (row // 7) AS y, row_number() OVER (PARTITION BY page ORDER BY k) - 1 AS line FROM l WHERE conf >= 15 AND regexp_matches(text, '[\\p{{L}}\\p{{N}}]')),
g AS (SELECT *, y - lag(y) OVER o AS way, lag(col) OVER o AS was FROM u WINDOW o AS (PARTITION BY page ORDER BY k)),
q AS (SELECT page, list(way ORDER BY way) FILTER (way > 4) AS ways FROM g GROUP BY page),
b AS (SELECT g.*, was IS NULL OR way <= 0 OR col <> was OR way > 1.4 * CASE WHEN len(ways) >= 2 THEN greatest(ways[1 + floor(0.25 * (len(ways) - 1))::INTEGER], 18) ELSE 24 END AS opens FROM g JOIN q USING (page)),
t AS (SELECT page, block, string_agg(text, chr(10) ORDER BY k) AS text FROM (SELECT *, sum(opens::INTEGER) OVER (PARTITION BY page ORDER BY k) - 1 AS block FROM b) GROUP BY ALL)"""


def scanned(spark: SparkSession, d: str) -> DataFrame:
    """Every document as a recogniser gives it: lines of nine words in two columns, a wider gap after every seventh; of a line that begins with a short word it is not sure."""
    docs = spread(table(spark, d, "documents"), "doc_id").select(F.col("doc_id").alias("page"), F.explode(F.array(text.surface_words(F.col("text")))).alias("words")).filter(F.size("words") > 0)
    nine = lambda k: F.slice("words", 9 * k + 1, F.lit(9))
    lines = F.transform(F.sequence(F.lit(0), F.ceil(F.size("words") / 9).cast("int") - 1), lambda k: F.struct(F.array_join(nine(k), " ").alias("text"), F.length(F.get("words", 9 * k)).alias("first")))
    line = docs.select("page", F.posexplode(lines).alias("k", "line"), F.ceil(F.size("words") / 9).alias("n")).select("page", F.col("k").cast("long").alias("k"), "n", "line.text", "line.first")
    half = F.floor((F.col("n") + 1) / 2)
    rows = line.withColumns({"row": F.col("k") % half, "col": F.floor(F.col("k") / half)})
    y: Column = (F.col("row") * 24 + F.floor(F.col("row") / 7) * 30).cast("double")
    x = F.col("col") * 600.0
    return rows.select("page", F.col("k").alias("seq"), "text", F.least(F.col("first") * 7.0, F.lit(99.0)).alias("confidence"), x.alias("x0"), y.alias("y0"), (x + 500).alias("x1"), (y + 20).alias("y1"))


@query(f"WITH {SCANNED} SELECT page, block::BIGINT AS block, text, (char_end - length(text))::BIGINT AS char_start, char_end::BIGINT AS char_end FROM (SELECT *, sum(length(text) + 2) OVER (PARTITION BY page ORDER BY block) - 2 AS char_end FROM t)")
def lay_ocrpage(spark: SparkSession, d: str) -> DataFrame:
    """Recognised lines in two columns as blocks in reading order, with offsets; lines of little confidence are gone."""
    return G.recognised(scanned(spark, d)).blocks.select("page", "block", "text", "char_start", "char_end")
