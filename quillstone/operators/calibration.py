"""Calibration of evidence thresholds from measured questions, as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRID = [0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70]


def floored(x: Column) -> Column:
    return F.floor(F.greatest(F.lit(0.3), F.least(F.lit(0.9), x)) * 100 + 1e-9) / 100


def floor_from(most: Column, least: Column) -> Column:
    """A floor between the highest unrelated and the lowest answerable cosine."""
    raw = F.when(most.isNotNull() & least.isNotNull(), F.least(most + 0.03, least - 0.03)).when(least.isNotNull(), least - 0.05).when(most.isNotNull(), most + 0.03).otherwise(F.lit(0.6))
    return floored(raw)


def exposed(measures: DataFrame) -> DataFrame:
    """Measures that the cosine alone decides."""
    return measures.filter(F.col("cosine").isNotNull() & ~F.col("informative"))


def margins(measures: DataFrame, by: list[str]) -> DataFrame:
    cos = lambda kind: F.when(F.col("kind") == kind, F.col("cosine"))
    return exposed(measures).groupBy(*by).agg(F.round(F.max(cos("unrelated")), 6).alias("most_unrelated"), F.round(F.min(cos("answerable")), 6).alias("least_answerable"), F.count(cos("unrelated")).alias("unrelated"), F.count(cos("answerable")).alias("answerable"))


def floors(measures: DataFrame, by: list[str]) -> DataFrame:
    """Per group: the floor, unrelated that pass it and answerable that do not."""
    edge = margins(measures, by).withColumn("floor", floor_from(F.col("most_unrelated"), F.col("least_answerable")))
    counts = exposed(measures).join(F.broadcast(edge.select(*by, "floor")), by).groupBy(*by).agg(F.count_if((F.col("kind") == "unrelated") & (F.col("cosine") >= F.col("floor"))).alias("leaked"), F.count_if((F.col("kind") == "answerable") & (F.col("cosine") < F.col("floor"))).alias("lost"))
    return edge.join(counts, by)


def coverage_grid(measures: DataFrame) -> DataFrame:
    """Outcomes at each coverage mark; the grid has nine rows, so measures are multiplied by nine at most."""
    rows = measures.withColumn("mark", F.explode(F.array(*[F.lit(x) for x in GRID])))
    informative = F.col("lexical_hit") & (F.col("coverage") >= F.col("mark"))
    stopped = (F.col("kind") == "unrelated") & ~informative
    lost = (F.col("kind") == "answerable") & ~informative & F.col("cosine").isNull()
    exempt = (F.col("kind") == "unrelated") & informative
    return rows.groupBy("mark").agg(F.count_if(lost).alias("lost"), F.count_if(exempt).alias("exempt"), F.count_if(stopped).alias("stopped"))


def best_coverage(grid: DataFrame) -> DataFrame:
    return grid.orderBy("lost", "exempt", F.desc("stopped"), "mark").limit(1)


def strong_mark(measures: DataFrame, floor: float) -> DataFrame:
    """Above every trap, else the answerable's lower quartile, else a tenth over the floor; never closer to it than 0.02."""
    trap = F.max(F.when(F.col("kind") == "trap", F.col("cosine")))
    quartile = F.percentile(F.when(F.col("kind") == "answerable", F.col("cosine")), 0.25)
    return measures.agg(F.round(F.greatest(F.coalesce(trap + 0.02, quartile, F.lit(floor + 0.1)), F.lit(floor + 0.02)), 2).alias("strong"))


def leave_one_out(measures: DataFrame, group: str) -> DataFrame:
    """Answerable measures lost under the floor learned without their own group.

    The extremes without a group come from the two most extreme groups, so no pair of groups is formed.
    """
    rows = exposed(measures)
    per = rows.groupBy(group).agg(F.max(F.when(F.col("kind") == "unrelated", F.col("cosine"))).alias("u"), F.min(F.when(F.col("kind") == "answerable", F.col("cosine"))).alias("a"))
    two = per.agg(F.slice(F.sort_array(F.collect_list("u"), asc=False), 1, 2).alias("us"), F.slice(F.sort_array(F.collect_list("a")), 1, 2).alias("as"))
    at = lambda xs, own: F.when(F.get(xs, F.lit(0)) == F.col(own), F.get(xs, F.lit(1))).otherwise(F.get(xs, F.lit(0)))
    held = per.withColumn("_k", F.lit(1)).join(F.broadcast(two.withColumn("_k", F.lit(1))), "_k")  # one row
    apart = held.select(group, floor_from(at(F.col("us"), "u"), at(F.col("as"), "a")).alias("floor"))
    return rows.filter("kind = 'answerable'").join(apart, group).groupBy(group).agg(F.first("floor").alias("floor"), F.count_if(F.col("cosine") < F.col("floor")).alias("lost"))
