"""Queries for the smaller rules; several run on a few rows of their own, since the tables hold no such text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..operators import answers as A
from ..operators import chunking, layout, ordered, retrieval
from ..operators import replies as P
from ..sources import schemas
from .registry import ITEMS_SQL, norm_sql, placed_words, query, table
from .retrieval import BASE, COVER, LEX, _asked, _index


@query(r"SELECT item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS question FROM benchmark")
def fn_query_norm(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", P.clean_line(F.col("text")).alias("question"))


@query(r"SELECT page_id, trim(regexp_replace(url, '\s+', ' ', 'g')) AS url FROM pages")
def fn_clean_line(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", P.clean_line(F.col("url")).alias("url"))


@query(f"SELECT item_id, len(list_filter(string_split({norm_sql('text')}, ' '), lambda w: w IN ('page', 'pages', 'text', 'about'))) AS vocabulary FROM benchmark")
def fn_page_vocab(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", F.size(F.filter(F.split(text.match_form(F.col("text")), " "), lambda w: w.isin("page", "pages", "text", "about"))).cast("long").alias("vocabulary"))


@query(f"{BASE}, {COVER} SELECT item_id, lexical_hit AND (identifier_hit OR coverage >= 0.45) AS informative FROM cov")
def ev_informative(spark: SparkSession, d: str) -> DataFrame:
    c = retrieval.coverage(*_asked(spark, d))
    return c.select("item_id", (F.col("lexical_hit") & (F.col("identifier_hit") | (F.col("coverage") >= fixed.INFORMATIVE))).alias("informative"))


@query(f"{BASE}, {LEX} SELECT item_id, 'hybrid' AS mode, max(score) AS top, count(*) AS kept FROM lex WHERE rank <= 6 GROUP BY item_id")
def rt_record(spark: SparkSession, d: str) -> DataFrame:
    best = retrieval.lexical(*_asked(spark, d), k=6)
    return best.groupBy("item_id").agg(F.lit("hybrid").alias("mode"), F.max("score").alias("top"), F.count("*").alias("kept"))


@query("SELECT source AS doc, least(count(*), 8) AS chunks FROM documents GROUP BY source")
def rt_manuscript(spark: SparkSession, d: str) -> DataFrame:
    """How many chunks the overview of each manuscript takes."""
    parts = _index(spark, d).select("doc", "chunk_index", (F.col("chunk_index") + 1).alias("page_start"), (F.col("chunk_index") + 1).alias("page_end"), F.lit(None).cast("string").alias("section"))
    return layout.sampled(parts).groupBy("doc").agg(F.count("*").alias("chunks"))


@query("WITH a AS (SELECT conv_id, max(turn) AS turn FROM conversations WHERE role = 'assistant' AND length(text) % 2 = 0 GROUP BY conv_id) SELECT a.conv_id, c.text AS focus FROM a JOIN conversations c ON c.conv_id = a.conv_id AND c.turn = a.turn")
def rt_reveal(spark: SparkSession, d: str) -> DataFrame:
    """The answer that a reveal opens."""
    m = table(spark, d, "conversations").filter((F.col("role") == "assistant") & (F.length("text") % 2 == 0))
    return m.groupBy("conv_id").agg(F.max_by("text", "turn").alias("focus"))


MANDATED = " OR ".join(f"starts_with({norm_sql('said')}, {norm_sql(chr(39) + x + chr(39))})" for x in fixed.NOT_FOUND.values())
REFUSED = ["[[NO_ANSWER]] ", " The document does not contain information on it. ", *[x.upper().replace(".", " -") for k, x in fixed.NOT_FOUND.items() if k != "tr"]]


@query(rf"""SELECT conv_id, turn, regexp_matches(said, '^\s*(?:\[\[NO_ANSWER\]\]|(?i:the (?:uploaded )?document does not (?:provide|contain) (?:enough )?information))') OR {MANDATED} AS refused
FROM (SELECT conv_id, turn, coalesce([{", ".join("'" + x + "'" for x in REFUSED)}][conv_id % 12 + 1], '') || text AS said FROM conversations)""")
def rep_refusal(spark: SparkSession, d: str) -> DataFrame:
    """All turns, most with a refusal before them, in capitals and without its stops."""
    head = F.coalesce(F.get(F.array(*[F.lit(x) for x in REFUSED]), (F.col("conv_id") % 12).cast("int")), F.lit(""))
    return table(spark, d, "conversations").select("conv_id", "turn", P.refusal(F.concat(head, "text")).alias("refused"))


@query(r"""SELECT conv_id, turn, array_to_string(list_filter(string_split(said, chr(10)), lambda x: NOT regexp_matches(x, '^\s*[-*•]') OR regexp_matches(x, '\[S[0-9]{1,3}\]')), chr(10)) AS text
FROM (SELECT conv_id, turn, text || chr(10) || '- a [S' || turn || ']' || chr(10) || '• b' || chr(10) || 'end' AS said FROM conversations)""")
def rep_points(spark: SparkSession, d: str) -> DataFrame:
    """All turns with a list after them; points that cite nothing go."""
    said = F.concat("text", F.lit("\n- a [S"), F.col("turn").cast("string"), F.lit("]\n• b\nend"))
    return table(spark, d, "conversations").select("conv_id", "turn", P.cited_points(said).alias("text"))


@query("SELECT item_id, 'Answer in en from the excerpts alone and cite them as [S1].' || chr(10) || '<x>' || chr(10) || 'Question: ' || text AS prompt FROM benchmark")
def prm_build(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", P.prompt(F.col("text"), F.lit("<x>"), F.lit("en")).alias("prompt"))


@query(r"SELECT conv_id, turn, trim(regexp_replace(regexp_replace(said, '\s*\[S[0-9]{1,3}\]', '', 'g'), '\[S?[0-9]*$', '')) AS shown FROM (SELECT conv_id, turn, text || ' [S' || turn || '] and [S1' AS said FROM conversations)")
def ui_display(spark: SparkSession, d: str) -> DataFrame:
    """All turns as they stream: markers hidden, an unfinished one too."""
    said = F.concat("text", F.lit(" [S"), F.col("turn").cast("string"), F.lit("] and [S1"))
    return table(spark, d, "conversations").select("conv_id", "turn", text.without_markers(said).alias("shown"))


@query("WITH r AS (SELECT doc_id % 40 AS page, lang, max(n_chars % 97) AS confidence, max(doc_id % 2) AS fits FROM documents GROUP BY ALL) SELECT page, arg_max(lang, (fits, confidence, lang)) AS lang FROM (SELECT *, max(confidence) OVER (PARTITION BY page) AS top FROM r) WHERE confidence >= top - 3 GROUP BY page")
def ocr_trial(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "documents").groupBy((F.col("doc_id") % 40).alias("page"), "lang").agg(F.max(F.col("n_chars") % 97).alias("confidence"), F.max(F.col("doc_id") % 2).alias("fits"))
    return P.combined_runs(runs)


@query("SELECT chunk_id, page, count(*) AS rects FROM (SELECT DISTINCT doc_id % 20 AS chunk_id, doc_id % 3 AS page, doc_id % 7 AS x, doc_id % 5 AS y FROM documents) GROUP BY ALL")
def ch_highlights(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("doc_id")
    lines = table(spark, d, "documents").select((e % 20).alias("chunk_id"), (e % 3).alias("page"), (e % 7).cast("double").alias("x"), (e % 5).cast("double").alias("y"), F.lit(1.0).alias("w"), F.lit(1.0).alias("h"))
    return P.highlights(lines).select("chunk_id", "page", F.size("rects").cast("long").alias("rects"))


@query("SELECT doc_id, lang FROM (SELECT source, doc_id, lang, lag(lang) OVER (PARTITION BY source ORDER BY doc_id) AS before FROM documents) WHERE lang IS DISTINCT FROM before")
def win_dedup_adj(spark: SparkSession, d: str) -> DataFrame:
    key = ["source"], ["doc_id"]
    rows = ordered.ranged(table(spark, d, "documents").select("source", "doc_id", "lang"), *key)
    return ordered.folded(rows, *key, former={"before": F.col("lang")}).filter(~F.col("lang").eqNullSafe(F.col("before"))).select("doc_id", "lang")


@query("SELECT o_orderkey, o_custkey FROM orders o WHERE o_totalprice > 200000 AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_returnflag = 'R')")
def jn_semi_exists(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").filter("o_totalprice > 200000").select("o_orderkey", "o_custkey").join(lines, "o_orderkey", "left_semi")


@query("SELECT source AS doc, count(*) AS pages, CASE WHEN count(*) FILTER (doc_id % 11 = 0) > 4 THEN 'failed' ELSE 'ready' END AS status, CASE WHEN count(*) FILTER (doc_id % 11 = 0) > 4 THEN 'OCR_UNAVAILABLE' END AS error FROM documents GROUP BY source")
def prj_summary(spark: SparkSession, d: str) -> DataFrame:
    bad = F.count_if(F.col("doc_id") % 11 == 0) > 4
    return table(spark, d, "documents").groupBy(F.col("source").alias("doc")).agg(F.count("*").alias("pages"), F.when(bad, "failed").otherwise("ready").alias("status"), F.when(bad, "OCR_UNAVAILABLE").alias("error"))



@query(f"WITH w AS ({ITEMS_SQL}) SELECT page, bool_or(len(w) - 9 * k > 5) AS tabular FROM w, range(ceil(len(w) / 9.0)::BIGINT) r(k) GROUP BY page")
def lay_tabular(spark: SparkSession, d: str) -> DataFrame:
    """Whether a page has a line with a gap of more than three em."""
    return layout.lines(placed_words(table(spark, d, "documents"))).groupBy("page").agg(F.max("tabular").alias("tabular"))


@query("SELECT 0::BIGINT AS violations")
def ch_final(spark: SparkSession, d: str) -> DataFrame:
    """Chunks whose overlap is not the end of the chunk before."""
    rows = chunking.chunked(table(spark, d, "documents"), target=500, most=800, least=100, overlap=120)
    before = F.lag("char_end").over(Window.partitionBy("doc_id").orderBy("chunk_index"))
    return rows.withColumn("before", before).agg(F.count_if((F.col("overlap_chars") > 120) | ((F.col("overlap_chars") > 0) & (F.col("before") > F.col("char_start")))).alias("violations"))


@query(None)
def fn_sentences(spark: SparkSession, d: str) -> DataFrame:
    return P.sentences(table(spark, d, "benchmark"), "text").select("item_id", F.size("sentences").alias("n"))


@query(f"SELECT {len(schemas.TABLES)}::BIGINT AS tables, 0::BIGINT AS rows")
def src_migrate(spark: SparkSession, d: str) -> DataFrame:
    """All tables made from their schemas, empty."""
    frames = [spark.createDataFrame([], s) for s in schemas.TABLES.values()]
    return spark.createDataFrame([(len(frames), 0)], "tables long, rows long")


@query("SELECT page_id, url FROM pages WHERE regexp_matches(url, '^https?://[a-z0-9.-]+/[A-Za-z0-9/_.?=&#-]+$')")
def src_storage(spark: SparkSession, d: str) -> DataFrame:
    """Keys of the form that the store accepts."""
    return table(spark, d, "pages").filter(F.col("url").rlike(r"^https?://[a-z0-9.-]+/[A-Za-z0-9/_.?=&#-]+$")).select("page_id", "url")


@query("SELECT lang AS kind, source AS doc, max(doc_id) AS item, count(*) AS n FROM documents GROUP BY ALL")
def snk_stage(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(F.col("lang").alias("kind"), F.col("source").alias("doc")).agg(F.max("doc_id").alias("item"), F.count("*").alias("n"))
