"""Exact top-k inner products by columnar branch and bound.

Candidates are held dimension by dimension. Scores grow block of dimensions by block, heaviest dimensions first; after each block a pair
survives only if its partial score plus the product of the norms of what remains (Cauchy-Schwarz) can still reach the query's
k-th best so far. While many pairs survive, whole columns are compacted; once few do, the pairs themselves are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import partitions

#: Dimensions added between two bounds; queries of one matrix product; queries of a task; rows of a block; candidates for the first thresholds.
DIMS, TILE, QUERIES, BLOCK, SEEDS = 16, 256, 65_536, 4096, 1024
LOW = np.iinfo(np.int64).min
#: Queries of a tile of whole numbers.
EXACT = 64


def quantised(ids: pa.ChunkedArray | pa.Array, vectors: pa.ChunkedArray | pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Row ids and floor(scale * x) as doubles, a row each; rows with a null or non-finite component or a null id are left out.

    Shorter vectors are padded with zeros, which add nothing to a product.
    """
    ids, vectors = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (ids, vectors))
    if len(ids) == 0:
        return np.zeros(0, np.int64), np.zeros((0, 0))
    there = np.asarray(vectors.is_valid()) & np.asarray(ids.is_valid())
    lengths = np.asarray(vectors.value_lengths().fill_null(0), dtype=np.int64)
    flat = vectors.flatten().cast(pa.float64())
    values = np.asarray(flat.fill_null(np.nan), dtype=np.float64)
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    wide = np.zeros((len(lengths), int(lengths.max(initial=0))))
    wide[owner, np.arange(len(values)) - np.repeat(ends - lengths, lengths)] = values
    there &= np.isfinite(wide).all(axis=1) if wide.size else True
    return np.asarray(ids.fill_null(0), dtype=np.int64)[there], np.floor(scale * wide[there])


def _same_width(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x[:, :width]


def _best(row: np.ndarray, vid: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k best of each row: highest score, then smallest id."""
    order = np.lexsort((vid, -score, row))
    at = row[order]
    first = np.searchsorted(at, at)
    return order[np.arange(len(at)) - first < k]


class Search:
    """One block of queries against batches of candidates."""

    def __init__(self, qid: np.ndarray, q: np.ndarray, k: int):
        self.qid, self.k = qid, k
        self.order = np.argsort(-np.square(q).sum(axis=0), kind="stable") if q.size else np.arange(q.shape[1])
        self.q = q[:, self.order]
        self.floor = np.full(len(qid), -np.inf)
        self.row, self.vid, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.by_id = np.argsort(qid, kind="stable")

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        if not len(ids) or not len(self.qid):
            return
        width = max(x.shape[1], self.q.shape[1])
        if width > self.q.shape[1]:  # dimensions that no query has add nothing
            width = self.q.shape[1]
        x = np.ascontiguousarray(_same_width(x, max(width, int(self.order.max(initial=-1)) + 1))[:, self.order].T)
        top = np.sqrt(np.square(self.q).sum(axis=1)).max(initial=0) * np.sqrt(np.square(x).sum(axis=0)).max(initial=0)
        kind = np.float32 if top < 2**23 else np.float64 if top < 2**52 else None
        found = [self._exact(a, x, ids) for a in range(0, len(self.qid), EXACT)] if kind is None else [self._tile(a, x.astype(kind), ids, kind) for a in range(0, len(self.qid), TILE)]
        row, col, score = (np.concatenate([f[i] for f in found]) for i in range(3))
        row, vid, score = np.concatenate([self.row, row]), np.concatenate([self.vid, ids[col]]), np.concatenate([self.score, score])
        keep = _best(row, vid, score, self.k)
        self.row, self.vid, self.score = row[keep], vid[keep], score[keep]
        full = np.bincount(self.row, minlength=len(self.qid)) >= self.k
        least = np.full(len(self.qid), np.inf)
        np.minimum.at(least, self.row, self.score)
        self.floor = np.maximum(self.floor, np.where(full, least, -np.inf))

    def _own(self, a: int, b: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a query and a candidate that carry the same id."""
        order = self.by_id
        lo, hi = np.searchsorted(self.qid[order], ids, "left"), np.searchsorted(self.qid[order], ids, "right")
        col = np.repeat(np.arange(len(ids)), hi - lo)
        start = np.repeat(lo, hi - lo) + np.arange(len(col)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
        row = order[start]
        inside = (row >= a) & (row < b)
        return row[inside] - a, col[inside]

    def _tile(self, a: int, x: np.ndarray, ids: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, floor = self.q[a : a + TILE].astype(kind), self.floor[a : a + TILE, None]
        dims, cols = q.shape[1], np.arange(x.shape[1])
        rest_q = np.sqrt(np.square(q.astype(np.float64))[:, ::-1].cumsum(axis=1)[:, ::-1])
        rest_x = np.sqrt(np.square(x.astype(np.float64))[::-1].cumsum(axis=0)[::-1])
        own = self._own(a, a + len(q), ids)
        s, row, pairs = np.zeros((len(q), len(cols)), kind), None, None
        for d in range(0, max(dims, 1), DIMS):
            block = slice(d, min(d + DIMS, dims))
            left = d + DIMS < dims
            if pairs is None:
                s += q[:, block] @ x[block][:, cols]
                bound = s + (rest_q[:, d + DIMS, None] * rest_x[d + DIMS, cols] * (1 + 1e-6) + 1e-3 if left else 0)
                alive = bound >= floor
                if d == 0:
                    alive[own] = False
                    s[own] = -np.inf
                if left and alive.mean() > 0.1:
                    some = alive.any(axis=0)
                    if some.mean() < 0.7:
                        s, cols = s[:, some], cols[some]
                    continue
                row, pairs = np.nonzero(alive)
                score, pairs = s[row, pairs], cols[pairs]
                fine = score > -np.inf
                row, pairs, score = row[fine], pairs[fine], score[fine].astype(np.float64)
            else:
                score = score + np.einsum("ij,ji->i", q[row, block], x[block][:, pairs], dtype=np.float64)
                alive = score + (rest_q[row, d + DIMS] * rest_x[d + DIMS, pairs] * (1 + 1e-6) + 1e-3 if left else 0) >= floor[row, 0]
                row, pairs, score = row[alive], pairs[alive], score[alive]
        return row + a, pairs, np.rint(score).astype(np.int64)

    def _exact(self, a: int, x: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For components too large for doubles, a few queries at a time: whole numbers of any size, held within 64 bits at the end."""
        whole = lambda m: np.array([[int(v) for v in r] for r in m], dtype=object).reshape(m.shape)
        some = self.q[a : a + EXACT]
        s = np.clip(whole(some).dot(whole(x)), LOW, -1 - LOW)
        row, col = np.divmod(np.arange(s.size), max(len(ids), 1))
        out = np.ones(s.size, bool)
        r, c = self._own(a, a + len(some), ids)
        out[r * len(ids) + c] = False
        row, col, score = row[out], col[out], s.reshape(-1)[out].astype(np.int64)
        best = _best(row, ids[col], score, self.k)
        return row[best] + a, col[best], score[best]


def _regrouped(pieces: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors, BLOCK rows at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def joined() -> tuple[np.ndarray, np.ndarray]:
        width = max(x.shape[1] for _, x in held)
        return np.concatenate([i for i, _ in held]), np.concatenate([_same_width(x, width) for _, x in held])

    for piece in pieces:
        held.append(piece)
        if sum(len(i) for i, _ in held) >= BLOCK:
            ids, x = joined()
            whole = len(ids) // BLOCK * BLOCK
            yield from ((ids[a : a + BLOCK], x[a : a + BLOCK]) for a in range(0, whole, BLOCK))
            held = [(ids[whole:], x[whole:])]
    if any(len(i) for i, _ in held):
        yield joined()


def _narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers in two bytes each where they fit."""
    return x.astype(np.int16) if not x.size or np.abs(x).max() < 2**15 else x


def _unpacked(b: pa.RecordBatch, r: int, side: str) -> tuple[np.ndarray, np.ndarray]:
    ids, width = np.frombuffer(b[f"{side}ids"][r].as_py(), np.int64), b[f"{side}width"][r].as_py()
    raw = b[f"{side}values"][r].as_py()
    kind = np.int16 if len(raw) == 2 * len(ids) * width else np.float64
    return ids, np.frombuffer(raw, kind).astype(np.float64).reshape(len(ids), width)


def _seeded(qid: np.ndarray, q: np.ndarray, k: int) -> Search:
    """A block of queries whose first thresholds come from some of its own rows."""
    seed, search = Search(qid, q, k), Search(qid, q, k)
    some = np.linspace(0, len(qid) - 1, min(len(qid), SEEDS)).astype(np.int64)
    seed.add(qid[some], q[some])
    search.floor = seed.floor
    return search


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """Each query's k highest integer inner products among all rows but those with its own id; ties go to the smaller id.

    Components become floor(scale * x). Rows with a null id, a null vector or a null or non-finite component take no part; a shorter
    vector counts as padded with zeros; rows that share an id are candidates each, and an id queried twice is answered once for each of its
    rows' best. Fewer than k candidates give fewer rows, an empty table none; vectors of any width take part with all their components; other columns, whatever their names, are not read. A score beyond 64 bits is held at their end.

    Rows are packed into blocks of a few thousand whole-number vectors; every block of queries meets every block of candidates by a Cartesian product, which reads both
    sides from the executors' shuffle files, so no vector passes the driver. A task holds QUERIES queries or so, with k rows for each, and one block of candidates at a time.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    queries = vectors.filter(is_query).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rounds = max(1, -(-queries.select("vec_id").count() // QUERIES))
    parts = max(1, partitions(spark))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for n, (ids, x) in enumerate(_regrouped(quantised(b["vec_id"], b["v"], scale) for b in batches)):
            yield pa.RecordBatch.from_pydict({"block": [f"{part}-{n}"], "width": pa.array([x.shape[1]], pa.int32()), "ids": [ids.tobytes()], "values": [_narrow(x).tobytes()]})

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches: dict[str, Search] = {}
        block, ids, x = None, None, None
        for b in batches:
            for r in range(b.num_rows):
                q, c = b["q_block"][r].as_py(), b["block"][r].as_py()
                if q not in searches:
                    searches[q] = _seeded(*_unpacked(b, r, "q_"), k)
                if c != block:
                    block, (ids, x) = c, _unpacked(b, r, "")
                searches[q].add(ids, x)
        for s in searches.values():
            yield pa.RecordBatch.from_pydict({"query_id": s.qid[s.row] if len(s.qid) else s.row, "vec_id": s.vid, "score": s.score})

    blocks = "block string, width int, ids binary, values binary"
    asked = queries.coalesce(parts).mapInArrow(packed, blocks).repartition(rounds).toDF("q_block", "q_width", "q_ids", "q_values")
    every = rows.mapInArrow(packed, blocks).repartition(parts)
    found = every.crossJoin(asked.hint("shuffle_replicate_nl")).mapInArrow(scan, "query_id long, vec_id long, score long")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
