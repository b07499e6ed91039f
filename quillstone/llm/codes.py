"""Product codes of vectors: every part of a vector becomes the index of its nearest codebook entry.

The nearest entry is found by a float32 matrix product. Each product is surrounded by an interval that holds all of its rounding errors; entries whose interval
overlaps the best one's are compared again in whole numbers, so the answers are exact and equal distances go to the lower index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import settle

#: Rows screened together; from this magnitude squares may leave 64 bits, and Python's whole numbers are used; components are held at this magnitude.
ROWS, WIDE, HELD = 4096, 1 << 28, 1 << 60
MOST = (1 << 63) - 1
#: A rounding error of float32, with room for the errors of the bounds themselves.
UNIT = 2.0**-24 * 1.01


def whole(vectors: pa.ListArray, scale: int, width: int | None = None) -> np.ndarray:
    """floor(scale * x) as whole numbers, a row each, shorter vectors padded with zeros."""
    lengths = np.asarray(vectors.value_lengths(), np.int64)
    values = np.floor(np.asarray(vectors.flatten(), np.float64) * scale)
    wide = np.zeros((len(lengths), int(lengths.max(initial=0)) if width is None else width), np.int64)
    at = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    wide[np.repeat(np.arange(len(lengths)), lengths), at] = np.clip(values, -HELD, HELD).astype(np.int64)
    return wide


def _distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows x from rows entries, pair by pair, exactly. Beyond WIDE as Python's whole numbers."""
    d = x - entries
    if len(d) and np.abs(d).max() >= WIDE:
        d = d.astype(object)
    return (d * d).sum(axis=-1)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's nearest entry, equal distances to the lower index, and the squared distance."""
    n, d = x.shape
    best, error = np.zeros(n, np.int64), np.zeros(n, object if max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0)) >= WIDE >> 1 else np.int64)
    own = np.square(entries.astype(np.float64)).sum(axis=1)
    size = np.sqrt(own)
    c32, own32 = entries.astype(np.float32), own.astype(np.float32)
    for k in range(0, n, ROWS):
        part = x[k : k + ROWS]
        x32 = part.astype(np.float32)
        # |c|^2 - 2 x.c: the inputs' rounding, d products and sums, the doubling and the last sum; each at most a unit of the magnitudes added up.
        score = own32 - 2 * (x32 @ c32.T)
        reach = np.sqrt(np.square(part.astype(np.float64)).sum(axis=1))
        slack = (d + 6) * UNIT * (own + 2 * reach[:, None] * size)
        low, high = score - slack, score + slack
        open_ = low <= high.min(axis=1, keepdims=True)
        row, entry = np.nonzero(open_)
        distance = _distances(part[row], entries[entry])
        order = np.lexsort((entry, distance, row)) if distance.dtype != object else np.array(sorted(range(len(row)), key=lambda i: (row[i], distance[i], entry[i])), np.int64)
        first = order[np.append(True, row[order][1:] != row[order][:-1])] if len(order) else order
        best[k : k + ROWS], error[k : k + ROWS] = entry[first], distance[first]
    return best, error


@dataclass(frozen=True)
class Codebooks:
    """entries[p][j]: entry j of part p."""

    entries: list[np.ndarray]
    scale: int

    @property
    def width(self) -> int:
        return sum(e.shape[1] for e in self.entries)

    def parts(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """The vectors cut where the codebooks are; components beyond them are left out."""
        at = 0
        for e in self.entries:
            yield x[:, at : at + e.shape[1]]
            at += e.shape[1]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(int(v)) for e in self.entries for v in e.ravel()).encode()).hexdigest()


def usable(v: Column) -> Column:
    """Vectors without a null or non-finite component."""
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def _rows(vectors: DataFrame, id_col: str, vector_col: str, *also: Column) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), *also).filter(usable(F.col("v")))


def train(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> Codebooks:
    """Codebooks that start as the parts of the ``entries`` least ids' vectors and are moved ``rounds`` times to the floor of their members' mean.

    Every usable row takes part in every round; a task sends one sum for each entry, so the driver gets parts * entries of them whatever the input. Ties of ids go
    to the lesser vector; rows without an id come after all others. The widest vector sets the parts' width; a width that ``parts`` does not divide is
    rounded up, and missing components are zeros. Fewer rows give fewer entries. An entry without members stays as it is.
    """
    rows = _rows(vectors, id_col, vector_col)
    width = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0]
    wide = -(-width // parts)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).toArrow()["v"].combine_chunks()
    start = whole(first, scale, wide * parts)
    books = Codebooks([start[:, p * wide : (p + 1) * wide] for p in range(parts)], scale)
    for _ in range(rounds if len(start) else 0):
        books = _moved(rows, books)
    return books


def _moved(rows: DataFrame, books: Codebooks) -> Codebooks:
    held = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = held.value
        sums = [np.zeros(e.shape, object) for e in books.entries]
        counts = [np.zeros(len(e), np.int64) for e in books.entries]
        for batch in batches:
            for k, part in enumerate(books.parts(whole(batch["v"], books.scale, books.width))):
                best, _ = nearest(part, books.entries[k])
                counts[k] += np.bincount(best, minlength=len(counts[k]))
                # Halves of 32 bits add up without leaving 64 bits.
                high, low = np.zeros(sums[k].shape, np.int64), np.zeros(sums[k].shape, np.int64)
                np.add.at(high, best, part >> 32)
                np.add.at(low, best, part & 0xFFFFFFFF)
                sums[k] = sums[k] + high.astype(object) * (1 << 32) + low
        used = [(k, j) for k, c in enumerate(counts) for j in np.flatnonzero(c)]
        flat = [[int(v) for v in sums[k][j]] for k, j in used]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in used], pa.int32()), pa.array([int(j) for _, j in used], pa.int32()), pa.array([int(counts[k][j]) for k, j in used], pa.int64()), pa.array(flat, pa.list_(pa.decimal128(38, 0)))],
            ["part", "entry", "count", "sums"],
        )

    told = rows.mapInArrow(run, "part int, entry int, count long, sums array<decimal(38,0)>")
    each = told.select("part", "entry", "count", F.posexplode("sums").alias("at", "x"))
    total = each.groupBy("part", "entry", "at").agg(F.sum("x").cast("decimal(38,0)").alias("x"), F.sum("count").alias("n")).toArrow()
    moved = [e.copy() for e in books.entries]
    for part, entry, at, x, n in zip(*(total[c].to_pylist() for c in ("part", "entry", "at", "x", "n")), strict=True):
        moved[part][entry, at] = int(x) // n
    return Codebooks(moved, books.scale)


def encode(vectors: DataFrame, books: Codebooks, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per usable row: vec_id, label, code (one byte a part), error (squared distances summed over the parts).

    Rows whose vector is null or holds a null or non-finite component are left out. A vector that is shorter than the codebooks counts as padded with zeros; what
    is longer is cut. Components are held at 2^60 in magnitude, errors at 2^63 - 1. Rows that share an id are coded each; an empty table, or one that the codebooks
    were trained on without a usable row, gives no rows. Other columns are not read.
    """
    rows = _rows(vectors, id_col, vector_col, F.col(label_col).alias("label"))
    kind = rows.schema["label"].dataType
    held = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = held.value
        for batch in batches:
            if not len(books.entries[0]):
                return
            code, error = np.zeros((batch.num_rows, len(books.entries)), np.uint8), np.zeros(batch.num_rows, object)
            cut = pa.compute.list_slice(batch["v"], 0, books.width) if books.width else batch["v"]
            for k, part in enumerate(books.parts(whole(cut, books.scale, books.width))):
                code[:, k], far = nearest(part, books.entries[k])
                error = error + far
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], pa.array([c.tobytes() for c in code], pa.binary()), pa.array([min(int(e), MOST) for e in error], pa.int64())], ["vec_id", "label", "code", "error"])

    return rows.mapInArrow(run, f"vec_id long, label {kind.simpleString()}, code binary, error long")


def coded(vectors: DataFrame, books: Codebooks, **names: str) -> DataFrame:
    """encode() with label_error, the error summed over all rows of the label, rows without a label together; sums are held at 2^63 - 1. Written once, as it is read twice."""
    own = settle(encode(vectors, books, **names), "codes")
    sums = own.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long").alias("label_error"))
    sums = sums.withColumnRenamed("label", "of")
    return own.join(sums, F.col("label").eqNullSafe(F.col("of"))).drop("of")


ORACLE_SQL = """
WITH rows AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, k AS part, e[k * (len(e) // 16) + 1 : (k + 1) * (len(e) // 16)] AS v FROM rows, range(16) t(k)),
c0 AS MATERIALIZED (SELECT part, rank - 1 AS entry, v AS c FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY vec_id) AS rank FROM p) WHERE rank <= 64),
a0 AS MATERIALIZED (SELECT vec_id, part, v, arg_min(entry, (d, entry)) AS entry FROM (
  SELECT vec_id, p.part, v, entry, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM p JOIN c0 USING (part)) GROUP BY ALL),
""" + "".join(f"""
m{k} AS MATERIALIZED (SELECT part, entry, list(s ORDER BY i) AS c FROM (
  SELECT part, entry, i, floor(sum(x)::HUGEINT / count(*))::BIGINT AS s FROM (SELECT part, entry, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{k - 1}) GROUP BY ALL) GROUP BY ALL),
c{k} AS MATERIALIZED (SELECT part, entry, coalesce(m{k}.c, c{k - 1}.c) AS c FROM c{k - 1} LEFT JOIN m{k} USING (part, entry)),
a{k} AS MATERIALIZED (SELECT vec_id, part, v, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
  SELECT vec_id, p.part, v, entry, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM p JOIN c{k} USING (part)) GROUP BY ALL),"""
for k in (1, 2)) + """
o AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY vec_id),
s AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, i)) AS codebooks_sha256 FROM (SELECT part, entry, unnest(c) AS x, generate_subscripts(c, 1) AS i FROM c2))
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM o JOIN rows USING (vec_id), s
"""  # fmt: skip
