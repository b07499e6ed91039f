"""Windowed limits, quotas, leases, retention and retry timing over event rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed


def window_start(ts: Column, seconds: int) -> Column:
    return F.timestamp_seconds(F.floor(F.unix_timestamp(ts.cast("timestamp")) / seconds) * seconds)


def quota_day(ts: Column) -> Column:
    """Start of the Pacific day that holds the moment, in UTC; daylight saving time included."""
    return F.to_utc_timestamp(F.date_trunc("DAY", F.from_utc_timestamp(ts.cast("timestamp"), fixed.PACIFIC)), fixed.PACIFIC)


def admitted(calls: DataFrame, key: list[str], limit: int, order: list[str]) -> DataFrame:
    """Calls of amount one: a window admits its first ``limit``; refused calls count nothing, so rank decides exactly."""
    w = Window.partitionBy(*key).orderBy(*order)
    return calls.withColumn("admitted", F.row_number().over(w) <= limit)


def admitted_amounts(calls: DataFrame, key: list[str], limit: int, order: list[str]) -> DataFrame:
    """Calls of any amount: in order, one is admitted if the window's count and its amount stay within the limit. A fold in Arrow batches."""
    schema = T.StructType([*calls.schema.fields, T.StructField("admitted", T.BooleanType())])
    rows = calls.repartition(*key).sortWithinPartitions(*key, *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, used = None, 0
        for b in batches:
            said = []
            for k, amount in zip(zip(*[b[c] for c in key], strict=True), b["amount"], strict=True):
                if k != now:
                    now, used = k, 0
                ok = used + amount <= limit
                used += amount if ok else 0
                said.append(bool(ok))
            yield b.assign(admitted=said)

    return rows.mapInPandas(run, schema)


def paced(calls: DataFrame, key: list[str], limit: int, seconds: int) -> DataFrame:
    """How many calls the last ``seconds`` before each one held, itself included, and whether they exceed the limit."""
    w = Window.partitionBy(*key).orderBy(F.unix_timestamp("ts")).rangeBetween(-seconds + 1, 0)
    return calls.withColumn("recent", F.count("*").over(w)).withColumn("over", F.col("recent") > limit)


def settled(spend: DataFrame) -> DataFrame:
    """Net charge of each request: reserved, less what was not used, plus what was used beyond it; nothing if refused."""
    return spend.groupBy("request").agg(F.sum("reserved").alias("reserved"), F.sum("used").alias("used"), F.max("refused").alias("refused")).withColumn("net", F.when(F.col("refused"), F.lit(0).cast("double")).otherwise(F.greatest("used", F.lit(0.0))))


def backoff(attempt: Column, first: float = 2.0, factor: float = 3.0, most: float = 60.0) -> Column:
    return F.least(F.lit(most), F.lit(first) * F.pow(F.lit(factor), attempt - 1))


def runs(rows: DataFrame, key: list[str], order: str, flag: str) -> DataFrame:
    """Lengths of the stretches in which flag holds: gaps and islands."""
    w = Window.partitionBy(*key).orderBy(order)
    held = rows.withColumn("n", F.row_number().over(w)).filter(F.col(flag))
    island = held.withColumn("island", F.col("n") - F.row_number().over(w))
    return island.groupBy(*key, "island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length")).drop("island")


def lease(jobs: DataFrame, now: Column, concurrency: int) -> DataFrame:
    """What an attempt to take each job meets: held, parked, busy or acquired; a lease that ran out adds an attempt."""
    live = jobs.groupBy("pool").agg(F.count_if(F.col("lease_until") > now).alias("live"))  # a row for each pool, so no pool's jobs meet in one task
    said = F.when(F.col("lease_until") > now, "held").when(F.col("parked_until") > now, "parked").when(F.col("live") >= concurrency, "busy").otherwise("acquired")
    rows = jobs.join(live, "pool").withColumn("outcome", said)
    return rows.withColumn("attempts_after", F.col("attempts") + F.when((F.col("outcome") == "acquired") & F.col("lease_until").isNotNull(), 1).otherwise(0))


def slid(created: Column, expires: Column, now: Column, hours: int = 24, most: int = 72) -> Column:
    """An expiry moved on by use: never past ``most`` hours of age, and only if it gains over a minute."""
    new = F.least(now + F.make_dt_interval(hours=F.lit(hours)), created + F.make_dt_interval(hours=F.lit(most)))
    return F.when(F.unix_timestamp(new) - F.unix_timestamp(expires) > 60, new).otherwise(expires)


def failure_kind(status: Column, message: Column) -> Column:
    """One class for a provider's failure, in order of precedence."""
    return (
        F.when(message.rlike(r"limit: 0\b"), "no_quota").when(message.rlike("PerDay|Daily"), "daily_quota").when(status == 429, "rate_limited").when(status.isin(401, 403) | message.rlike("(?i)api key"), "unauthorized")
        .when(status == 404, "not_found").when(status.isNull() | (status >= 500) | (status == 408), "unavailable").otherwise("rejected")
    )


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the last in order. The ranked limit is applied before the shuffle."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def upserted(table: DataFrame, changes: DataFrame, key: list[str], version: str) -> DataFrame:
    """The table with the changes of later version put in."""
    return latest(table.unionByName(changes), key, [F.desc(version)])


def kept(table: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The table and those new rows whose key it does not hold."""
    return table.unionByName(new.join(table.select(*key), key, "left_anti").select(*table.columns))
