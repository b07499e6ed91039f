"""What depends on the rows before: numbers, sums, carried values and former rows, in the order of a group, without gathering the group.

Rows are sorted by sampled ranges of (group, order) and written once. Windows stand inside a range; what earlier ranges of the same group hand on is one row for a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stages import staged


def ranged(rows: DataFrame, group: list[str], order: list[str], name: str = "ranges", ranges: int | None = None) -> DataFrame:
    """rows with ``_part``, the range of (group, order) that they stand in. Ranges follow the rows' own distribution, so neither a hot group nor outlying keys fill one.

    There are as many as Spark shuffles to, or ``ranges``.
    """
    cut = rows.repartitionByRange(ranges, *group, *order) if ranges else rows.repartitionByRange(*group, *order)
    return staged(cut.withColumn("_part", F.spark_partition_id()), name)


def folded(rows: DataFrame, group: list[str], order: list[str], sums: dict[str, Column] | None = None, last: dict[str, Column] | None = None, former: dict[str, Column] | None = None) -> DataFrame:
    """rows of ranged() with columns added, in the order of their group.

    sums: the sum up to and with the row; last: the last value that is not null up to and with the row; former: the value in the row before, null in the first.
    """
    sums, last, former = sums or {}, last or {}, former or {}
    inside = Window.partitionBy("_part", *group).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = F.struct(*order)
    # A struct tells a former row that holds a null from none.
    own = {k: F.sum(c).over(upto) for k, c in sums.items()} | {k: F.last(c, ignorenulls=True).over(upto) for k, c in last.items()} | {k: F.lag(F.struct(c.alias("x"))).over(inside) for k, c in former.items()}
    per = [F.sum(c).alias(f"_{k}") for k, c in sums.items()] + [F.max_by(c, F.when(c.isNotNull(), at)).alias(f"_{k}") for k, c in last.items()] + [F.max_by(F.struct(c.alias("x")), at).alias(f"_{k}") for k, c in former.items()]
    parts = Window.partitionBy(*group).orderBy("_part")
    earlier = parts.rowsBetween(Window.unboundedPreceding, -1)
    hand = [F.sum(f"_{k}").over(earlier).alias(f"_{k}") for k in sums] + [F.last(f"_{k}", ignorenulls=True).over(earlier).alias(f"_{k}") for k in last] + [F.lag(f"_{k}").over(parts).alias(f"_{k}") for k in former]
    names = [F.col(g).alias(f"_g{i}") for i, g in enumerate(group)]
    carry = rows.groupBy("_part", *group).agg(*per).select(F.col("_part").alias("_p"), *names, *hand, F.row_number().over(parts).alias("_r")).filter("_r > 1").drop("_r")
    same = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    # Only the first group of a range can have begun in an earlier one: a row for each range at most, whatever the input.
    out = rows.withColumns(own).join(F.broadcast(carry), same, "left")
    out = out.withColumns({k: F.col(k) + F.coalesce(f"_{k}", F.lit(0)) for k in sums} | {k: F.coalesce(k, f"_{k}") for k in last} | {k: F.coalesce(k, f"_{k}")["x"] for k in former})
    return out.drop("_p", *[f"_g{i}" for i in range(len(group))], *[f"_{k}" for k in (*sums, *last, *former)])


def numbered(rows: DataFrame, group: str, key: str, name: str, then: tuple[str, ...] = (), each: int | None = None) -> DataFrame:
    """rows with their place, from 0, in the order of a key (and of the columns ``then``, among equals) inside their group. each: about so many rows a range."""
    order = [key, *then]
    ranges = max(1, -(-rows.count() // each)) if each else None
    return folded(ranged(rows, [group], order, "numbered", ranges), [group], order, sums={name: F.lit(1)}).withColumn(name, F.col(name).cast("long") - 1).drop("_part")
