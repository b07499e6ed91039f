"""Sharding by a Feistel permutation of global row numbers, with DataFrame functions alone.

Rows get gapless numbers in the order of their key. A Feistel network over ``a * b >= n`` positions permutes the numbers;
positions beyond n are walked along their cycle until they fall inside. ``shard = position mod shards`` and
``slot = position div shards`` can thus be computed for any row number, and inverted, without a table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import settle

PRIME = 2147483647
ROUNDS = 6


def round_keys(seed: int) -> list[tuple[int, int]]:
    """Multiplier and increment of each round, from the seed by a linear congruence."""
    keys, x = [], (seed * 2 + 1) % PRIME
    for _ in range(ROUNDS):
        m = x = (x * 48271 + 11) % PRIME
        c = x = (x * 48271 + 11) % PRIME
        keys.append((m, c))
    return keys


def domain(n: int) -> tuple[int, int]:
    """The sides of the smallest near-square grid that holds n positions."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def permute_int(x: int, n: int, seed: int) -> int:
    """The position of row number x among n rows, in plain Python: what the columns below compute."""
    a, b = domain(n)
    while True:
        left, right = x // b, x % b
        for k, (m, c) in enumerate(round_keys(seed)):
            v = left if k % 2 else right
            f = (v * m + c) % PRIME
            f = (f * f + v) % PRIME
            if k % 2:
                right = (right + f) % b
            else:
                left = (left + f) % a
        x = left * b + right
        if x < n:
            return x


def _mix(v: Column, m, c) -> Column:
    f = (v * m + c) % F.lit(PRIME)
    return (f * f + v) % F.lit(PRIME)


def permuted(df: DataFrame, row: str, n: int, seed: int, out: str) -> DataFrame:
    """Adds ``out``, the permuted position of the row number in ``row`` among n rows."""
    a, b = domain(n)
    wide, keys = F.lit(b).cast("long"), round_keys(seed)
    df = df.withColumn("_left", F.expr(f"`{row}` div {b}L")).withColumn("_right", F.col(row) % wide)
    for k, (m, c) in enumerate(keys):
        of, to, side = ("_left", "_right", b) if k % 2 else ("_right", "_left", a)
        df = df.withColumn(to, (F.col(to) + _mix(F.col(of), F.lit(m).cast("long"), F.lit(c).cast("long"))) % F.lit(side).cast("long"))
    first = F.col("_left") * wide + F.col("_right")

    def once(x: Column) -> Column:
        steps = F.array(*[F.struct(F.lit(k % 2).alias("odd"), F.lit(m).cast("long").alias("m"), F.lit(c).cast("long").alias("c")) for k, (m, c) in enumerate(keys)])
        start = F.struct(F.floor(x / wide).cast("long").alias("l"), (x % wide).alias("r")) if n < 2**50 else F.struct(((x - x % wide) / wide).cast("long").alias("l"), (x % wide).alias("r"))

        def step(s: Column, k: Column) -> Column:
            odd = k["odd"] == 1
            return F.struct(
                F.when(odd, s["l"]).otherwise((s["l"] + _mix(s["r"], k["m"], k["c"])) % F.lit(a).cast("long")).alias("l"),
                F.when(odd, (s["r"] + _mix(s["l"], k["m"], k["c"])) % wide).otherwise(s["r"]).alias("r"),
            )

        return F.aggregate(steps, start, step, lambda s: s["l"] * wide + s["r"])

    # A cycle holds at most a * b - n positions outside in a row: so many steps always lead back inside.
    outside = max(1, a * b - n)
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(outside)), first, lambda x, _: F.when(x >= F.lit(n), once(x)).otherwise(x))
    return df.withColumn(out, F.when(first < F.lit(n), first).otherwise(walk)).drop("_left", "_right")


def numbered(df: DataFrame, keys: list[str], out: str, name: str = "numbered") -> tuple[DataFrame, int]:
    """df, written to the shared folder in key order, with gapless global row numbers from 0; and the count of rows.

    Sorted by range, so no task holds more than its range; rows alike in every key are split between ranges by a last tie-break.
    Numbers inside a range are counted there, and the few ranges' own counts are summed before them.
    """
    ranged = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys, "_tie").sortWithinPartitions(*keys, "_tie")
    held = settle(ranged.withColumn("_part", F.spark_partition_id()), name)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = held.groupBy("_part").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    inside = Window.partitionBy("_part").orderBy(*keys, "_tie")
    # One row for each range of the sort: as many as shuffle partitions, whatever the input.
    rows = held.withColumn("_in", F.row_number().over(inside)).join(F.broadcast(parts.select("_part", "_before")), "_part")
    return rows.withColumn(out, F.col("_before") + F.col("_in") - 1).drop("_part", "_before", "_in", "_tie"), held.count()


def shard(docs: DataFrame, n_shards: int = 24, seed: int = 20260101) -> DataFrame:
    """Every document's shard and slot. The law ``rows`` holds: the shards' counts are at most one apart.

    Row numbers follow doc_id ascending (nulls first), then checksum and size; rows alike in all three are interchangeable. Equal texts
    are spread like any other rows. A null text counts as no bytes; of a text of any length only size and checksum are moved. An empty table gives no rows. Other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    light = docs.select("doc_id", (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows, n = numbered(light, ["doc_id", "text_crc32", "size"], "_row", "shards")
    at = permuted(rows, "_row", n, seed, "_at")
    return at.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("_at") % n_shards).cast("int").alias("shard"),
        F.expr(f"_at div {n_shards}").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def oracle(n_shards: int = 24, seed: int = 20260101) -> str:
    """The same rows in DuckDB: checksum, row number, network and walk written out."""
    keys = ", ".join(f"({k}, {m}::BIGINT, {c}::BIGINT)" for k, (m, c) in enumerate(round_keys(seed)))
    steps = ", ".join(f"{{'odd': {k % 2}, 'm': {m}::BIGINT, 'c': {c}::BIGINT}}" for k, (m, c) in enumerate(round_keys(seed)))
    del keys
    mix = lambda v: f"((({v} * s.m + s.c) % {PRIME}) * (({v} * s.m + s.c) % {PRIME}) + {v}) % {PRIME}"
    net = f"""list_reduce({{steps}}, lambda p, s: CASE WHEN s.odd = 1
        THEN {{{{'odd': 0, 'm': p.m, 'c': (p.c + {mix('p.m')}) % b}}}}
        ELSE {{{{'odd': 0, 'm': (p.m + {mix('p.c')}) % a, 'c': p.c}}}} END,
        {{{{'odd': 0, 'm': x // b, 'c': x % b}}}})""".replace("{{", "{").replace("}}", "}").replace("{steps}", f"[{steps}]")
    return f"""
WITH RECURSIVE tab AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([1,2,3,4,5,6,7,8], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, i::BIGINT) AS c
    FROM range(256) r(i))),
sized AS (
  SELECT doc_id, (coalesce(octet_length(encode(text)), 0) + 8)::BIGINT AS size,
    xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT),
      lambda x, y: xor(x >> 8, t[1 + (xor(x, y) & 255)]), 4294967295::BIGINT))::BIGINT AS text_crc32
  FROM documents, tab),
numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS n FROM sized),
sides AS (
  SELECT count(*) AS n, floor(sqrt(greatest(count(*) - 1, 0)))::BIGINT + 1 AS a,
    ceil(count(*) / (floor(sqrt(greatest(count(*) - 1, 0))) + 1))::BIGINT AS b FROM documents),
walk AS (
  SELECT numbered.n AS row, numbered.n::BIGINT AS x, 0 AS step FROM numbered
  UNION ALL
  SELECT row, q.m * b + q.c, step + 1 FROM (SELECT row, step, sides.n, a, b, {net} AS q FROM walk, sides WHERE step = 0 OR x >= sides.n)),
placed AS (SELECT row, x FROM walk, sides WHERE step > 0 AND x < sides.n)
SELECT doc_id, size, text_crc32, 'rows' AS law, (x % {n_shards})::INTEGER AS shard, (x // {n_shards})::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM numbered JOIN placed ON numbered.n = placed.row
"""
