"""Queries over ingest jobs: users are jobs or documents, their events units of work, pages or settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import calibration, jobs, retrieval
from ..sources import stages
from .evaluation import FLOOR, MARGIN, M, _measures
from .registry import query, table

UNITS = "u AS (SELECT user_id AS job, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS unit, event_type AS stage, floor(value * 100)::BIGINT AS ms, user_id % 5 AS attempts, user_id % 7 * 1000 AS spent FROM events)"


def _placed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("unit", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long"))


@query(f"""WITH {UNITS}, b AS (SELECT *, coalesce(sum(ms) OVER (PARTITION BY job ORDER BY unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 20000 AS begun FROM u),
p AS (SELECT job, count(*) FILTER (begun) AS done, arg_min(stage, unit) FILTER (NOT begun) AS nxt, max(attempts) AS attempts, max(spent) AS spent FROM b GROUP BY job),
e AS (SELECT *, CASE WHEN attempts >= 4 THEN 'INGEST_INTERRUPTED' WHEN spent > 5000 THEN 'PDF_UNREADABLE' END AS error FROM p)
SELECT job, CASE WHEN error IS NULL THEN done ELSE 0 END AS done, CASE WHEN error IS NULL THEN coalesce(nxt, 'ready') ELSE 'error' END AS stage, error FROM e""")
def st_tick(spark: SparkSession, d: str) -> DataFrame:
    units = _placed(spark, d).select(F.col("user_id").alias("job"), "unit", F.col("event_type").alias("stage"), F.floor(F.col("value") * 100).alias("ms"), (F.col("user_id") % 5).alias("attempts"), (F.col("user_id") % 7 * 1000).alias("spent_ms"))
    return jobs.ticked(units, budget_ms=20_000, most_attempts=4, timeout_ms=5_000)


@query("""WITH u AS (SELECT user_id AS doc, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS page, CASE event_type WHEN 'click' THEN 'failed' WHEN 'view' THEN 'failed' WHEN 'error' THEN 'stop' ELSE 'read' END AS kind FROM events),
r AS (SELECT *, count(*) FILTER (kind = 'read') OVER (PARTITION BY doc ORDER BY page ROWS UNBOUNDED PRECEDING) AS run FROM u),
g AS (SELECT *, count(*) FILTER (kind <> 'read') OVER (PARTITION BY doc, run ORDER BY page ROWS UNBOUNDED PRECEDING) >= 5 OR count(*) FILTER (kind = 'stop') OVER (PARTITION BY doc ORDER BY page ROWS UNBOUNDED PRECEDING) >= 3 AS over_ FROM r),
l AS (SELECT doc, min(page) FILTER (over_) AS last FROM g GROUP BY doc)
SELECT doc, page, CASE WHEN page > last THEN 'skipped' WHEN kind = 'read' THEN 'read' ELSE 'failed' END AS outcome FROM u JOIN l USING (doc)""")
def ocr_run(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type").isin("click", "view"), "failed").when(F.col("event_type") == "error", "stop").otherwise("read")
    return jobs.read_outcomes(_placed(spark, d).select(F.col("user_id").alias("doc"), F.col("unit").alias("page"), kind.alias("kind")))


@query("SELECT doc, chunk_id, (n // 100)::BIGINT AS statement FROM (SELECT source AS doc, doc_id AS chunk_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n FROM documents)")
def snk_batch(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("chunk_id"))
    return jobs.statements(rows, "doc", "chunk_id", "chunks")


@query(f"WITH {M}, {MARGIN}, f AS (SELECT same, {FLOOR} AS floor FROM g) SELECT same, floor, count(*) FILTER (kind = 'unrelated' AND cosine >= floor) AS leaked, count(*) FILTER (kind = 'answerable' AND cosine < floor) AS lost FROM m JOIN f USING (same) WHERE cosine IS NOT NULL AND NOT informative GROUP BY same, floor")
def snk_generated(spark: SparkSession, d: str) -> DataFrame:
    """The measured thresholds written as a JSON file and read back."""
    floors = calibration.floors(_measures(spark, d), ["same"]).select("same", "floor", "leaked", "lost")
    path = stages.path(spark, "thresholds")
    floors.coalesce(1).write.json(path)
    return spark.read.schema(floors.schema).json(path)


@query(r"""WITH o AS (SELECT item_id, text[1:20] AS t FROM benchmark), e AS (
  SELECT item_id, 0 AS place, 'Part  ' || item_id AS title, 1 AS page FROM o UNION ALL SELECT item_id, 2, 'Deep ' || item_id, (item_id % 9 + 2)::INTEGER FROM o UNION ALL SELECT item_id, 4, 'Last', 9 FROM o WHERE item_id % 2 = 0)
SELECT item_id, place - CASE WHEN place > 0 THEN 1 ELSE 0 END - CASE WHEN place > 3 THEN 1 ELSE 0 END AS place, regexp_replace(title, '\s+', ' ', 'g') AS title, page FROM e""")
def src_outline(spark: SparkSession, d: str) -> DataFrame:
    """Outlines three levels deep; entries without a page, without a title, or on a fourth level go."""
    k = F.col("item_id").cast("string")
    deep = F.concat(F.lit('{"title":"Deep '), k, F.lit('","page":'), (F.col("item_id") % 9 + 2).cast("string"), F.lit(',"items":[{"title":"Too deep","page":3}]}'))
    said = F.concat(F.lit('[{"title":"Part  '), k, F.lit('","page":1,"items":[{"title":"No page","page":null,"items":['), deep, F.lit(']},{"title":" ","page":4}]}'), F.when(F.col("item_id") % 2 == 0, ',{"title":"Last","page":9}').otherwise(""), F.lit("]"))
    return table(spark, d, "benchmark").select("item_id", F.posexplode(jobs.outline(said)).alias("place", "e")).select("item_id", "place", "e.*")


VALUES = "CASE WHEN event_id % 13 = 0 THEN 'x' || event_id WHEN event_type = 'error' THEN CASE WHEN event_id % 3 = 0 THEN 'yes' ELSE 'true' END WHEN event_type = 'click' THEN (event_id % 150 / 100.0)::DECIMAL(5, 2)::VARCHAR ELSE (event_id * 7 % 70000)::VARCHAR END"
KEYS = "CASE event_type WHEN 'view' THEN 'PORT' WHEN 'purchase' THEN 'RAG_TOP_K' WHEN 'click' THEN 'COSINE_FLOOR' WHEN 'error' THEN 'REVEAL' ELSE CASE WHEN event_id % 2 = 0 THEN 'OCR_MIN_CHARS' ELSE 'OLD_' || user_id END END"


@query(rf"""WITH s AS (SELECT user_id AS deployment, {KEYS} AS key, {VALUES} AS value FROM events), r AS (SELECT 'PORT' AS key, 'int' AS kind, 1 AS low, 65535 AS high UNION ALL SELECT 'OCR_MIN_CHARS', 'int', 0, 10000 UNION ALL SELECT 'RAG_TOP_K', 'int', 1, 50 UNION ALL SELECT 'COSINE_FLOOR', 'double', 0, 1 UNION ALL SELECT 'REVEAL', 'bool', 0, 0),
f AS (SELECT deployment, CASE WHEN r.key IS NULL THEN s.key || ': unknown' WHEN NOT regexp_matches(value, CASE kind WHEN 'int' THEN '^-?[0-9]{{1,9}}$' WHEN 'double' THEN '^-?[0-9]{{1,9}}(\.[0-9]+)?$' ELSE '^(true|false)$' END) THEN s.key || ': no ' || kind || ': ' || value
  WHEN kind <> 'bool' AND NOT value::DOUBLE BETWEEN low AND high THEN s.key || ': not ' || low || ' to ' || high || ': ' || value END AS fault FROM s LEFT JOIN r USING (key))
SELECT deployment, coalesce(list_sort(list(DISTINCT fault) FILTER (fault IS NOT NULL)), []) AS errors, count(fault) = 0 AS valid FROM f GROUP BY deployment""")
def src_config(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("deployment"), F.expr(KEYS.replace("||", "||")).alias("key"), F.expr(VALUES.replace("::DECIMAL(5, 2)::VARCHAR", "").replace("(event_id % 150 / 100.0)", "cast(cast(event_id % 150 / 100.0 as decimal(5, 2)) as string)").replace("(event_id * 7 % 70000)::VARCHAR", "cast(event_id * 7 % 70000 as string)")).alias("value"))
    return jobs.configured(e)


@query(r"""SELECT doc, arg_max(lang, {'n': letters, 'p': -first}) AS lang FROM (SELECT source AS doc, lang, sum(len(regexp_extract_all(text, '\p{L}'))) AS letters, min(doc_id) AS first FROM (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 'und' ELSE lang END AS l FROM documents) WHERE l <> 'und' GROUP BY ALL) GROUP BY doc""")
def agg_majority(spark: SparkSession, d: str) -> DataFrame:
    """The language of most letters in each manuscript; blocks of no known language don't count, the first of equals wins."""
    rows = table(spark, d, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("block"), F.when(F.col("doc_id") % 3 == 0, "und").otherwise(F.col("lang")).alias("lang"), F.regexp_count("text", F.lit(r"\p{L}")).alias("letters"))
    return retrieval.majority(rows)
