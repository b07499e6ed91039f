"""Queries register here with the SQL that DuckDB checks them by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, text

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt out by a key where their files give fewer tasks than there are cores: a file of one row group is one task, however large."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(4 * cores, key) if rows.rdd.getNumPartitions() < cores else rows


def norm_sql(x: str) -> str:
    """The match form in SQL, for text without Arabic."""
    return rf"trim(regexp_replace(regexp_replace(translate(lower({x}), '''’‘ʼ', ''), '[\p{{P}}\p{{S}}]', ' ', 'g'), '\s+', ' ', 'g'))"


#: Every document's words as the items of a page: nine to a line, 14 units apart, with 40 more after the fifth.
ITEMS_SQL = f"SELECT doc_id AS page, list_filter(string_split({norm_sql('text')}, ' '), lambda x: x <> '') AS w FROM documents"


def placed_words(docs: DataFrame) -> DataFrame:
    words = docs.select(F.col("doc_id").alias("page"), F.posexplode(text.surface_words(F.col("text"))).alias("i", "text"))
    x = 14.0 * (F.col("i") % 9) + F.when(F.col("i") % 9 >= 5, 40.0).otherwise(0.0)
    return words.select("page", x.alias("x"), (20.0 * F.floor(F.col("i") / 9)).alias("y"), F.lit(10.0).alias("width"), F.lit(10.0).alias("size"), "text")


def cues_sql() -> str:
    """Each language's points for a text t of words w, in SQL."""
    out = []
    for lang, (plain, strong, letters) in fixed.CUES.items():
        quoted = lambda ws: ", ".join("'" + w.replace("'", "''") + "'" for w in ws.split())
        x = f"len(list_filter(w, lambda x: x IN ({quoted(plain)}))) + 2 * len(list_filter(w, lambda x: x IN ({quoted(strong)})))"
        if weak := "".join(c for c, n in letters.items() if n == 1):
            x += f" + least(1, len(regexp_extract_all(t, '[{weak}]')))"
        if own := "".join(c for c, n in letters.items() if n > 1):
            x += f" + {max(n for n in letters.values())} * least(2, len(regexp_extract_all(t, '[{own}]')))"
        out.append(f"SELECT item_id, '{lang}' AS lang, {x} AS n FROM s")
    return " UNION ALL ".join(out)
