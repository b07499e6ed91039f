"""The ingest of documents as data: ticks over units of work, outcomes of page readings, statements of rows, outlines, settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import numbered

# Readings that fail in a row, and stops of the reader, after which the rest of a document is skipped; levels and entries of an outline.
FAILURES, STOPS, LEVELS, ENTRIES = 5, 3, 3, 500
# Rows of one statement.
STATEMENT = {"chunks": 100, "pages": 50, "embeddings": 200}
# Settings with their kind, least and most.
SETTINGS = {"PORT": ("int", 1, 65535), "OCR_MIN_CHARS": ("int", 0, 10000), "RAG_TOP_K": ("int", 1, 50), "COSINE_FLOOR": ("double", 0, 1), "REVEAL": ("bool", 0, 0)}


def ticked(units: DataFrame, budget_ms: int, most_attempts: int, timeout_ms: int) -> DataFrame:
    """One tick of every job: (job, done, stage, error). Needs (job, unit, stage, ms, attempts, spent_ms): a job's units in order, and what it has used before.

    Units are begun while the tick has time, so the one that crosses the budget is still done; the stage is that of the next unit, or ready. A job that was
    interrupted too often, or has taken too long, fails before any work.
    """
    w = Window.partitionBy("job").orderBy("unit")
    before = F.coalesce(F.sum("ms").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = units.withColumn("begun", before < budget_ms)
    per = rows.groupBy("job").agg(F.count_if("begun").alias("done"), F.min_by("stage", F.when(~F.col("begun"), F.col("unit"))).alias("next"), F.max("attempts").alias("attempts"), F.max("spent_ms").alias("spent"))
    error = F.when(F.col("attempts") >= most_attempts, "INGEST_INTERRUPTED").when(F.col("spent") > timeout_ms, "PDF_UNREADABLE")
    return per.select("job", F.when(error.isNull(), F.col("done")).otherwise(0).alias("done"), F.when(error.isNull(), F.coalesce("next", F.lit("ready"))).otherwise("error").alias("stage"), error.alias("error"))


def read_outcomes(events: DataFrame) -> DataFrame:
    """(doc, page, outcome) of pages read in order: needs (doc, page, kind: read, failed or stop). Pages after FAILURES failures in a row, or STOPS stops, are skipped."""
    w = Window.partitionBy("doc").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    good = F.col("kind") == "read"
    runs = events.withColumn("run", F.count_if(good).over(w))
    since = Window.partitionBy("doc", "run").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    given_up = (F.count_if(~good).over(since) >= FAILURES) | (F.count_if(F.col("kind") == "stop").over(w) >= STOPS)
    first = runs.withColumn("over", given_up).groupBy("doc").agg(F.min(F.when(F.col("over"), F.col("page"))).alias("last"))
    return events.join(first, "doc").select("doc", "page", F.when(F.col("page") > F.col("last"), "skipped").when(good, "read").otherwise("failed").alias("outcome"))


def statements(rows: DataFrame, group: str, key: str, kind: str) -> DataFrame:
    """Adds statement: the number of the multi-row write that each row goes into, in key order inside its group."""
    return numbered(rows, group, key, "_place").withColumn("statement", F.floor(F.col("_place") / STATEMENT[kind])).drop("_place")


_ENTRY = "struct<title:string,page:int{}>"
OUTLINE = f"array<{_ENTRY.format(',items:array<' + _ENTRY.format(',items:array<' + _ENTRY.format('') + '>') + '>')}>"


def outline(c: Column) -> Column:
    """A nested outline in JSON as (title, page) in reading order: LEVELS deep, ENTRIES at most; entries without a page or title go, what hangs on them stays."""

    def own(e: Column) -> Column:
        return F.array(F.struct(F.trim(F.regexp_replace(e["title"], r"\s+", " ")).alias("title"), e["page"].alias("page")))

    def below(e: Column, level: int) -> Column:
        none = F.array().cast("array<struct<title:string,page:int>>")
        return F.concat(own(e), F.coalesce(F.flatten(F.transform(e["items"], lambda x: below(x, level + 1))), none)) if level < LEVELS else own(e)

    flat = F.flatten(F.transform(F.from_json(c, OUTLINE), lambda e: below(e, 1)))
    return F.slice(F.filter(flat, lambda e: e["page"].isNotNull() & (e["title"] != "")), 1, ENTRIES)


def configured(settings: DataFrame) -> DataFrame:
    """(deployment, errors, valid): every fault of a deployment's settings at once, in the order of their keys. Needs (deployment, key, value)."""
    kinds = {"int": r"^-?[0-9]{1,9}$", "double": r"^-?[0-9]{1,9}(\.[0-9]+)?$", "bool": "^(true|false)$"}
    said = F.lit(None).cast("string")
    for key, (kind, low, high) in SETTINGS.items():
        fine = F.col("value").rlike(kinds[kind])
        wrong = F.when(~fine, F.concat(F.lit(f"{key}: no {kind}: "), "value"))
        if kind != "bool":
            number = F.when(fine, F.col("value")).cast("double")
            wrong = wrong.when(~number.between(low, high), F.concat(F.lit(f"{key}: not {low} to {high}: "), "value"))
        said = F.when(F.col("key") == key, wrong).otherwise(said)
    rows = settings.withColumn("fault", F.when(~F.col("key").isin(*SETTINGS), F.concat("key", F.lit(": unknown"))).otherwise(said))
    return rows.groupBy("deployment").agg(F.sort_array(F.collect_set("fault")).alias("errors")).withColumn("valid", F.size("errors") == 0)
