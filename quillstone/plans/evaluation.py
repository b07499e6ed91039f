"""Calibration queries: labelled documents as measured questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calibration as K
from .registry import query, table

M = """m AS (SELECT doc_id, source AS grp, CASE WHEN toxic = 1 THEN 'trap' WHEN quality = 1 THEN 'answerable' ELSE 'unrelated' END AS kind, doc_id % 2 = 0 AS same,
  CASE WHEN doc_id % 17 <> 0 THEN round(0.3 + (doc_id * 37 % 400) / 1000.0 + CASE WHEN quality = 1 THEN 0.25 ELSE 0 END, 4) END::DOUBLE AS cosine, doc_id % 3 <> 0 AS lexical_hit, (doc_id * 53 % 100) / 100.0::DOUBLE AS coverage, doc_id % 5 = 0 AS informative FROM labels JOIN documents USING (doc_id))"""
FLOOR = "floor(greatest(0.3, least(0.9, CASE WHEN u IS NOT NULL AND a IS NOT NULL THEN least(u + 0.03, a - 0.03) WHEN a IS NOT NULL THEN a - 0.05 WHEN u IS NOT NULL THEN u + 0.03 ELSE 0.6 END)) * 100 + 1e-9) / 100"
MARGIN = "g AS (SELECT same, round(max(cosine) FILTER (kind = 'unrelated'), 6) AS u, round(min(cosine) FILTER (kind = 'answerable'), 6) AS a, count(*) FILTER (kind = 'unrelated') AS nu, count(*) FILTER (kind = 'answerable') AS na FROM m WHERE cosine IS NOT NULL AND NOT informative GROUP BY same)"


def _measures(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("doc_id")
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", F.col("source").alias("grp")), "doc_id")
    kind = F.when(F.col("toxic") == 1, "trap").when(F.col("quality") == 1, "answerable").otherwise("unrelated")
    cosine = F.when(e % 17 != 0, F.round(0.3 + (e * 37 % 400) / 1000.0 + F.when(F.col("quality") == 1, 0.25).otherwise(0), 4))
    return rows.select("doc_id", "grp", kind.alias("kind"), (e % 2 == 0).alias("same"), cosine.alias("cosine"), (e % 3 != 0).alias("lexical_hit"), ((e * 53 % 100) / 100.0).alias("coverage"), (e % 5 == 0).alias("informative"))


@query(f"WITH {M}, {MARGIN} SELECT same, u AS most_unrelated, a AS least_answerable, nu AS unrelated, na AS answerable FROM g")
def agg_margins(spark: SparkSession, d: str) -> DataFrame:
    return K.margins(_measures(spark, d), ["same"])


@query(f"WITH {M}, {MARGIN}, f AS (SELECT same, {FLOOR} AS floor FROM g) SELECT same, floor, count(*) FILTER (kind = 'unrelated' AND cosine >= floor) AS leaked, count(*) FILTER (kind = 'answerable' AND cosine < floor) AS lost FROM m JOIN f USING (same) WHERE cosine IS NOT NULL AND NOT informative GROUP BY same, floor")
def cal_floor(spark: SparkSession, d: str) -> DataFrame:
    return K.floors(_measures(spark, d), ["same"]).select("same", "floor", "leaked", "lost")


GRID = f"""WITH {M}, x AS (SELECT *, lexical_hit AND coverage >= mark AS i FROM m, (SELECT unnest([{", ".join(f"{g}::DOUBLE" for g in K.GRID)}]) AS mark)),
c AS (SELECT mark, count(*) FILTER (kind = 'answerable' AND NOT i AND cosine IS NULL) AS lost, count(*) FILTER (kind = 'unrelated' AND i) AS exempt, count(*) FILTER (kind = 'unrelated' AND NOT i) AS stopped FROM x GROUP BY mark)"""


@query(f"{GRID} SELECT mark, lost, exempt, stopped FROM c")
def cal_exempt(spark: SparkSession, d: str) -> DataFrame:
    return K.coverage_grid(_measures(spark, d))


@query(f"{GRID} SELECT mark, lost, exempt, stopped FROM c ORDER BY lost, exempt, stopped DESC, mark LIMIT 1")
def cal_coverage(spark: SparkSession, d: str) -> DataFrame:
    return K.best_coverage(K.coverage_grid(_measures(spark, d)))


@query(f"WITH {M} SELECT round(greatest(coalesce(max(cosine) FILTER (kind = 'trap') + 0.02, quantile_cont(cosine, 0.25) FILTER (kind = 'answerable'), 0.7), 0.62), 2) AS strong FROM m")
def cal_strong(spark: SparkSession, d: str) -> DataFrame:
    return K.strong_mark(_measures(spark, d), 0.6)


@query(f"""WITH {M}, e AS (SELECT * FROM m WHERE cosine IS NOT NULL AND NOT informative), h AS (SELECT DISTINCT grp FROM e),
x AS (SELECT h.grp, max(e.cosine) FILTER (e.kind = 'unrelated') AS u, min(e.cosine) FILTER (e.kind = 'answerable') AS a FROM h LEFT JOIN e ON e.grp <> h.grp GROUP BY h.grp), f AS (SELECT grp, {FLOOR} AS floor FROM x)
SELECT grp, floor, count(*) FILTER (cosine < floor) AS lost FROM e JOIN f USING (grp) WHERE kind = 'answerable' GROUP BY grp, floor""")
def cal_loo(spark: SparkSession, d: str) -> DataFrame:
    return K.leave_one_out(_measures(spark, d), "grp")
