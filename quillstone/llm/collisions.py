"""Near-duplicate vectors by collision-counting projections.

Every distinct vector of a label is projected on many random lines and keeps its place on each as a byte. Two vectors collide on a line when their places
are at most half a window apart: each is the centre of its own window. A pair at the threshold collides on a known share of the lines, so the count that
all but one in a thousand of such pairs reach is known as well; pairs that reach it are verified by their cosine in double precision.

Counting all pairs would be quadratic in a label, so a pair is only counted where it also stands together in a table: a table sorts its own few lines
into cells of a grid with random offsets. The lines of a table grow with the logarithm of the largest label, so cells stay small, and the tables are as
many as the recall asks for. A cell that is large all the same is counted block against block, so no cell is one task's.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import partitions, settle, spans
from .jaccard import components

#: Lines; places of a unit of length; the farthest place; half a window and a cell's width in distances at the threshold; rows of a block.
LINES, STEP, FAR, HALF, WIDE, BLOCK = 64, 32, 127, 1.5, 6.0, 2048
#: Vectors of a cell that are looked for; share of the pairs at the threshold that tables and count may miss each; counters held together.
CELL, MISS, MISCOUNT, COUNTERS = 64, 0.002, 0.001, 1 << 20


@dataclass(frozen=True)
class Plan:
    """Lines of a table, tables, half a window and a cell's width in places, and the count that a pair must reach."""

    lines: int
    tables: int
    half: int
    wide: int
    count: int
    seed: int

    def directions(self, width: int) -> np.ndarray:
        """A row for each dimension, the same whatever the width."""
        return np.random.default_rng(self.seed).standard_normal((width, LINES))

    def cells(self, places: np.ndarray) -> np.ndarray:
        """(vectors, tables, lines): each table's cell of each vector. A table has lines of its own choice and offsets of its own."""
        rng = np.random.default_rng(self.seed + 1)
        own = np.stack([rng.choice(LINES, self.lines, replace=False) for _ in range(self.tables)])
        return ((places.astype(np.int16)[:, own] + FAR + 1 + rng.integers(0, self.wide, own.shape)) // self.wide).astype(np.uint8)


def planned(cosine: float, largest: int, seed: int = 7) -> Plan:
    """The plan for labels of at most ``largest`` distinct vectors.

    A pair at distance d differs on a line by a normal variable of deviation d, so it stands in one cell of width w with probability E[max(0, 1 - |x| / w)].
    Places are whole numbers of 1 / STEP and may be off by one, so windows are wider by one. The count is the highest that a pair at the threshold misses with
    a probability of MISCOUNT at most.
    """
    d = math.sqrt(2 - 2 * cosine)
    wide = max(2, round(WIDE * d * STEP))
    grid = np.linspace(-8, 8, 4001)
    bell = np.exp(-grid * grid / 2) / np.exp(-grid * grid / 2).sum()
    together = float((bell * np.maximum(0, 1 - (np.abs(grid) * d * STEP + 1) / wide)).sum())
    apart = float((bell * np.maximum(0, 1 - np.abs(grid) * math.sqrt(2) * STEP / wide)).sum())
    lines = min(24, max(1, math.ceil(math.log(max(largest / CELL, 1)) / -math.log(apart))))
    tables = max(4, math.ceil(math.log(MISS) / math.log(1 - together**lines)))
    half = math.ceil(HALF * d * STEP)
    near = math.erf(half / (STEP * d) / math.sqrt(2))
    tail, count = 0.0, 0
    while count < LINES and (tail := tail + math.comb(LINES, count) * near**count * (1 - near) ** (LINES - count)) <= MISCOUNT:
        count += 1
    return Plan(lines, tables, half + 1, wide, count, seed)


def _unit(vectors: pa.ListArray) -> np.ndarray:
    """The vectors as rows of length one in double precision, shorter ones padded with zeros."""
    lengths = np.asarray(vectors.value_lengths(), np.int64)
    values = np.asarray(vectors.flatten(), np.float64)
    wide = np.zeros((len(lengths), int(lengths.max(initial=0))))
    wide[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    if not wide.size:
        return wide
    wide /= np.abs(wide).max(axis=1, keepdims=True)  # else squares of very large or small components are lost
    return wide / np.sqrt(np.square(wide).sum(axis=1, keepdims=True))


def _placed(sets: DataFrame, plan: Plan) -> DataFrame:
    """(table, cell, hi, lo, places): each distinct vector in its cell of each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = plan.directions(0)
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):  # a row becomes one for each table
                batch = whole.slice(k, 1024)
                x = _unit(batch["v"])
                if len(lines) < x.shape[1]:
                    lines = plan.directions(x.shape[1])
                places = np.clip(np.floor(x @ lines[: x.shape[1]] * STEP), -FAR - 1, FAR).astype(np.int8)
                cells = [c.tobytes() for c in plan.cells(places).reshape(-1, plan.lines)]
                each = pa.array(np.repeat(np.arange(len(places)), plan.tables))
                own = pa.array([p.tobytes() for p in places], pa.binary())
                table = pa.array(np.tile(np.arange(plan.tables, dtype=np.int32), len(places)))
                yield pa.RecordBatch.from_arrays([table, batch["label"].take(each), pa.array(cells, pa.binary()), batch["hi"].take(each), batch["lo"].take(each), own.take(each)], ["table", "label", "cell", "hi", "lo", "places"])

    return sets.select("label", "hi", "lo", "v").mapInArrow(run, "table int, label long, cell binary, hi long, lo long, places binary")


def collided(cell: np.ndarray, places: np.ndarray, half: int, count: int, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs a < b of rows of one cell that collide on at least ``count`` lines. cell: ascending numbers; side: where given, only rows of different sides pair.

    Each line is sorted cell by cell; a row's window on it is a stretch of that order, and every row in the stretch counts once for the pair.
    """
    n = len(cell)
    first = np.searchsorted(cell, cell)
    size = np.searchsorted(cell, cell, "right") - first
    order, key = np.zeros((LINES, n), np.int32), np.zeros((LINES, n), np.int64)
    own = cell[None, :] * 1024 + places.T.astype(np.int64)
    for k in range(LINES):
        order[k] = np.argsort(own[k], kind="stable")
        key[k] = own[k][order[k]]
    ends, found_a, found_b = np.cumsum(size), [], []
    cuts = np.searchsorted(ends, np.arange(0, int(size.sum()) + COUNTERS, COUNTERS))
    for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
        rows = np.arange(start, stop)
        if not len(rows):
            continue
        base = np.cumsum(size[rows]) - size[rows] - first[rows]
        seen = np.zeros(int(size[rows].sum()), np.uint8)
        for k in range(LINES):
            low, high = np.searchsorted(key[k], own[k][rows] - half), np.searchsorted(key[k], own[k][rows] + half, "right")
            seen[np.repeat(base, high - low) + order[k][spans(low, high - low)]] += 1
        at = np.flatnonzero(seen >= count)
        a = np.repeat(rows, size[rows])[at]
        b = at - np.repeat(base, size[rows])[at]
        keep = a < b if side is None else (a < b) & (side[a] != side[b])
        found_a.append(a[keep])
        found_b.append(b[keep])
    none = [np.zeros(0, np.int64)]
    return np.concatenate(found_a or none), np.concatenate(found_b or none)


def _counted(units: DataFrame, plan: Plan) -> DataFrame:
    """Pairs of one cell that collide often enough, each told by the first table in which it stands together."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        hi, lo, block, table, label = (np.asarray(rows[c].combine_chunks()) for c in ("hi", "lo", "block", "table", "label"))
        name = np.unique(np.array(rows["cell"].to_pylist(), dtype=f"S{plan.lines}"), return_inverse=True)[1]
        places = np.frombuffer(b"".join(rows["places"].to_pylist()), np.int8).reshape(-1, LINES)
        order = np.lexsort((name, label, table))
        hi, lo, block, table, places = hi[order], lo[order], block[order], table[order], places[order]
        key = np.stack([table, label[order], name[order]], axis=1)
        cell = np.cumsum(np.append(0, (key[1:] != key[:-1]).any(axis=1)))
        a, b = collided(cell, places, plan.half, plan.count, block if rows["one"][0].as_py() != rows["two"][0].as_py() else None)
        first = [np.zeros(0, bool)]
        for k in range(0, len(a), 4096):
            same = (plan.cells(places[a[k : k + 4096]]) == plan.cells(places[b[k : k + 4096]])).all(axis=2)
            first.append(same.argmax(axis=1) == table[a[k : k + 4096]])
        first = np.concatenate(first)
        a, b = a[first], b[first]
        return pa.Table.from_arrays([pa.array(x) for x in (hi[a], lo[a], hi[b], lo[b])], ["a_hi", "a_lo", "b_hi", "b_lo"])

    return units.groupBy("unit", "one", "two").applyInArrow(run, "a_hi long, a_lo long, b_hi long, b_lo long")


def _verified(pairs: DataFrame, sets: DataFrame, cosine: float) -> DataFrame:
    """The pairs whose cosine is at least ``cosine`` in double precision."""
    own = lambda side: sets.select(F.col("hi").alias(f"{side}_hi"), F.col("lo").alias(f"{side}_lo"), F.col("v").alias(f"{side}_v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = _unit(batch["a_v"]), _unit(batch["b_v"])
            width = min(a.shape[1], b.shape[1])
            near = np.einsum("ij,ij->i", a[:, :width], b[:, :width]) >= cosine
            yield batch.select(["a_hi", "a_lo", "b_hi", "b_lo"]).filter(pa.array(near))

    both = pairs.join(own("a"), ["a_hi", "a_lo"]).join(own("b"), ["b_hi", "b_lo"])
    return both.select("a_hi", "a_lo", "b_hi", "b_lo", "a_v", "b_v").mapInArrow(run, "a_hi long, a_lo long, b_hi long, b_lo long")


def _usable(v: Column) -> Column:
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)


def links(sets: DataFrame, cosine: float, seed: int = 7) -> DataFrame:
    """(a_hi, a_lo, b_hi, b_lo): pairs of distinct vectors, rows (label, hi, lo, v), of one label with at least that cosine. Each pair once."""
    largest = sets.groupBy("label").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    plan = planned(cosine, largest, seed)
    placed = settle(_placed(sets, plan), "placed")
    cell = ["table", "label", "cell"]
    sizes = placed.groupBy(*cell).count().filter("count > 1")
    held = placed.join(sizes, cell).withColumn("blocks", F.ceil(F.col("count") / BLOCK))
    held = held.withColumn("block", F.pmod(F.xxhash64("hi", "lo"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    bins = max(partitions(sets.sparkSession), placed.count() // (4 * BLOCK))
    unit = F.when(F.col("blocks") > 1, F.xxhash64(*cell)).otherwise(F.pmod(F.xxhash64(*cell), F.lit(bins)))
    units = held.select(*cell, "hi", "lo", "places", "block", unit.alias("unit"), other.alias("other")).withColumns({"one": F.least("block", "other"), "two": F.greatest("block", "other")})
    found = settle(_counted(units.drop("other"), plan), "counted")
    return _verified(found, sets, cosine)


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", seed: int = 7) -> DataFrame:
    """Per row: vec_id, n_links (other rows linked directly), component_id (least vec_id reachable by links, itself included), kept.

    Rows link when their labels are equal and not null and the cosine of their vectors is at least ``cosine`` in double precision. A pair at just that cosine is
    found with a probability of at least 0.997, a closer one of more; no pair below it links. Equal vectors of a label always link and are handled as one, so
    thousands of copies cost as much as one. Vectors that are null, empty or zero or hold a null or non-finite component link with nothing; shorter ones
    count as padded with zeros, and of any length all components take part. Rows that share a vec_id are rows of their own; rows without one
    take part but name no component (null where no other row of theirs has one) and are kept. An empty table gives no rows. Other columns are not read.
    """
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.xxhash64(F.col(label_col)).alias("label"), F.col(label_col).isNotNull().alias("labelled"), v.alias("v"))
    rows = rows.withColumn("fine", F.col("labelled") & _usable(F.col("v")))
    named = rows.withColumns({"hi": F.when(F.col("fine"), F.xxhash64("label", "v")), "lo": F.when(F.col("fine"), F.xxhash64("v", F.lit(1), "label"))})
    fine = named.filter("fine").groupBy("hi", "lo").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    sets = settle(fine, "vectors")
    found = settle(links(sets.select("label", "hi", "lo", "v"), cosine, seed), "links")
    copies = sets.select("hi", "lo", "copies")
    ends = found.select(F.col("a_hi").alias("hi"), F.col("a_lo").alias("lo"), F.col("b_hi").alias("o_hi"), F.col("b_lo").alias("o_lo"))
    ends = ends.unionByName(found.select(F.col("b_hi").alias("hi"), F.col("b_lo").alias("lo"), F.col("a_hi").alias("o_hi"), F.col("a_lo").alias("o_lo")))
    linked = ends.join(copies.select(F.col("hi").alias("o_hi"), F.col("lo").alias("o_lo"), "copies"), ["o_hi", "o_lo"]).groupBy("hi", "lo").agg(F.sum("copies").alias("linked"))
    stars = components(found).select(F.col("u.hi").alias("hi"), F.col("u.lo").alias("lo"), F.col("v.hi").alias("root_hi"), F.col("v.lo").alias("root_lo"))
    mine = sets.select("hi", "lo", "copies", "least").join(linked, ["hi", "lo"], "left").join(stars, ["hi", "lo"], "left")
    mine = mine.withColumns({"root_hi": F.coalesce("root_hi", "hi"), "root_lo": F.coalesce("root_lo", "lo")})
    least = mine.groupBy("root_hi", "root_lo").agg(F.min("least").alias("component_id"))
    own = settle(mine.join(least, ["root_hi", "root_lo"]).select("hi", "lo", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"), "found")
    out = named.select("vec_id", "hi", "lo").join(own, ["hi", "lo"], "left")
    component = F.when(F.col("hi").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("vec_id").isNull()))


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.b FROM r JOIN l ON r.y = l.a),
c AS (SELECT x AS vec_id, min(y) AS component_id FROM r GROUP BY x),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""
