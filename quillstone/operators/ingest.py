"""Ingest bookkeeping: accepted uploads, tickets, stages, progress, error classes, incremental embedding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STAGES = ("queued", "validating", "parsing", "ocr", "analyzing", "chunking", "embedding", "ready")


def accepted(uploads: DataFrame, most: int) -> DataFrame:
    """The first rule an upload breaks, or null; of a session's accepted ones only the newest stays active."""
    error = F.when(F.col("bytes") == 0, "EMPTY_FILE").when(F.col("bytes") > most, "TOO_LARGE").when(~F.lower("name").endswith(".pdf"), "NOT_PDF").when(~F.col("is_pdf"), "INVALID_PDF")
    order = Window.partitionBy("session", F.col("error").isNull()).orderBy(F.desc("at"), F.desc("upload_id"))
    return uploads.withColumn("error", error).withColumn("active", F.col("error").isNull() & (F.row_number().over(order) == 1))


def tickets(events: DataFrame, now: Column) -> DataFrame:
    """Each ticket's state from its events: released, claimed, expired or open, and the bytes it still promises."""
    state = events.groupBy("ticket").agg(F.max(F.when(F.col("event") == "issue", F.col("expires"))).alias("expires"), F.max(F.when(F.col("event") == "issue", F.col("bytes"))).alias("bytes"), F.max(F.col("event") == "claim").alias("claimed"), F.max(F.col("event") == "release").alias("released"))
    said = F.when(F.col("released"), "released").when(F.col("claimed"), "claimed").when(F.col("expires") <= now, "expired").otherwise("open")
    return state.withColumn("state", said).withColumn("promised", F.when(said == "open", F.col("bytes")).otherwise(F.lit(0)))


def progress(jobs: DataFrame) -> DataFrame:
    """Stage as a share of the way, direction from chunking on, queue place only while queued."""
    place = F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("stage"))
    return jobs.withColumn("share", F.round((place - 1) / (len(STAGES) - 1), 4)).withColumn("direction", F.when(place >= 6, F.col("direction"))).withColumn("queue", F.when(F.col("stage") == "queued", F.col("queue")))


def pending(chunks: DataFrame, embedded: DataFrame, model: str, batch: int) -> DataFrame:
    """The next batch of chunks without an embedding of the model."""
    have = embedded.filter(F.col("model") == model).select("chunk_id")
    return chunks.join(have, "chunk_id", "left_anti").orderBy("doc", "chunk_index").limit(batch)


def transient(code: Column) -> Column:
    """Which part failed for a while, by its state code or message; null if the failure stays."""
    return F.when(code.rlike("^(08|57P|53)"), "database").when(code.rlike("(?i)blob|storage|ENOSPC"), "store").when(code.rlike("(?i)embed"), "embedding").when(code.rlike("(?i)timeout|timed out|ETIMEDOUT"), "timeout")


def http_status(code: Column) -> Column:
    # Statuses of contract codes.
    known = {"NOT_FOUND": 404, "TOO_LARGE": 413, "NOT_PDF": 415, "RATE_LIMITED": 429, "INVALID_REQUEST": 400, "UNAUTHORIZED": 401, "BUSY": 503}
    return F.coalesce(*[F.when(code == k, F.lit(v)) for k, v in known.items()], F.lit(500))


def about_file(code: Column) -> Column:
    """Whether a failure is the file's own, so that it is deleted, or the system's, so that it is kept."""
    return code.isin("INVALID_PDF", "ENCRYPTED_PDF", "TOO_MANY_PAGES", "EMPTY_PDF", "NO_TEXT")


def parked(jobs: DataFrame, midnight: Column) -> DataFrame:
    """Jobs whose quota ran out wait for the next quota day unless at most a tenth of their pages (one at least) is left and some were read."""
    left = F.col("pages") - F.col("done")
    let_go = (left <= F.greatest(F.lit(1), F.floor(F.col("pages") / 10))) & (F.col("done") >= 1)
    return jobs.withColumn("parked_until", F.when(F.col("exhausted") & ~let_go, midnight))


def job_state(events: DataFrame) -> DataFrame:
    """A job's state by folding its events: last lease, attempts and errors since the last success."""
    w = Window.partitionBy("job").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = events.withColumn("good", F.coalesce(F.max(F.when(F.col("kind") == "save", F.col("at"))).over(w), F.lit(-1)))
    last = events.groupBy("job").agg(F.max(F.when(F.col("kind") == "save", F.col("at"))).alias("saved"), F.count_if(F.col("kind") == "acquire").alias("attempts"), F.max_by("kind", "at").alias("last"))
    errors = rows.filter("kind = 'error'").join(last.select("job", F.coalesce("saved", F.lit(-1)).alias("s")), "job").filter(F.col("at") > F.col("s")).groupBy("job").agg(F.count("*").alias("errors"))
    return last.join(errors, "job", "left").withColumn("errors", F.coalesce("errors", F.lit(0)))


def removed(tables: dict[str, DataFrame], gone: DataFrame) -> DataFrame:
    """(kind, id) of the rows that stay in each table of (id) when the ids in ``gone`` are removed from all of them."""
    left = [rows.join(gone, "id", "left_anti").select(F.lit(kind).alias("kind"), "id") for kind, rows in tables.items()]
    return reduce(DataFrame.unionByName, left)
