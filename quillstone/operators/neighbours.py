"""Exact nearest vectors of streamed scopes: a task holds some queries, candidates pass by in the order of their ids, and k of them stay for each query.

Matrix products of unit vectors tell which pairs can be among the k best. Scores are rounded to six places and ties go to the candidate that came first; where a
product is too near to a half for that, the pair's sum is taken in the order of its components, as SQL does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Queries and candidates of one matrix product, fewer candidates in a scope's first; pairs summed at a time.
TILE, PIECE, FIRST, SUMMED = 256, 4096, 512, 16_384
#: A score of 1 in whole numbers; what stands for NaN, which ranks first, and, negative, for null, which ranks last; how near to a half a rounding is in doubt.
SCALE, NAN, DOUBT = 1e6, 1e12, 1e-4
#: Norms beyond which products may leave the range of doubles.
LEAST, MOST = 1e-100, 1e100
#: Rows of a batch that is passed on.
PASSED = 10_000


def _in_order(p: np.ndarray) -> np.ndarray:
    """The sum of each row, component by component."""
    return np.add.accumulate(p, axis=1)[:, -1] if p.shape[1] else np.zeros(len(p))


def _rounded(t: np.ndarray) -> np.ndarray:
    """Halves away from zero."""
    whole = np.trunc(t)
    return whole + (np.abs(t - whole) >= 0.5) * np.sign(t)


class Vectors:
    """Vectors as a matrix for each width, with norms; -1 is the width of a vector that is null or holds null."""

    def __init__(self, v: pa.Array):
        lengths, flat = np.asarray(v.value_lengths().fill_null(0), dtype=np.int64), v.flatten()
        self.width = lengths.copy()
        self.width[np.asarray(v.is_null())] = -1
        if flat.null_count:
            self.width[np.repeat(np.arange(len(v)), lengths)[np.asarray(flat.is_null())]] = -1
        values, starts = np.asarray(flat.fill_null(0.0)), np.cumsum(lengths) - lengths
        self.norm, self.place = np.zeros(len(v)), np.zeros(len(v), np.int64)
        self.rows = {int(w): np.flatnonzero(self.width == w) for w in np.unique(self.width)}
        self.x = {w: values[starts[rows][:, None] + np.arange(w)] for w, rows in self.rows.items() if w >= 0}
        with np.errstate(all="ignore"):
            for w, x in self.x.items():
                self.place[self.rows[w]] = np.arange(len(x))
                self.norm[self.rows[w]] = np.sqrt(_in_order(np.square(x, dtype=np.float64)))
            self.wild = ~((self.norm == 0) | ((self.norm > LEAST) & (self.norm < MOST)))

    def unit(self, w: int) -> np.ndarray:
        """The vectors of a width over their norms; zero where that is zero or out of range."""
        n = self.norm[self.rows[w]]
        fine = (n > 0) & ~self.wild[self.rows[w]]
        return np.divide(self.x[w], n[:, None], out=np.zeros(self.x[w].shape), where=fine[:, None])


def _quotients(x: np.ndarray, y: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Scores of all pairs of rows of x and y by sums in order, whatever their components are."""
    s = np.zeros((len(x), len(y)))
    with np.errstate(all="ignore"):
        for d in range(x.shape[1]):
            s += x[:, d, None].astype(np.float64) * y[None, :, d]
        s = np.where(both <= 0, 0.0, s / both)
        return np.where(np.isfinite(s), s * SCALE, NAN)


def _scores(a: Vectors, b: Vectors, units: dict[int, np.ndarray]) -> np.ndarray:
    """Scores of all pairs, not rounded. units: those of b. Null, partly null and zero vectors score 0; vectors of different widths score null."""
    if list(a.rows) == list(b.rows) and len(a.rows) == 1 and -1 not in a.rows and not a.wild.any() and not b.wild.any():
        (w,) = a.rows
        return (a.unit(w) * SCALE) @ units[w].T
    out = np.zeros((len(a.norm), len(b.norm)))
    for w, x in a.x.items():
        for v, y in b.x.items():
            rows, cols = a.rows[w], b.rows[v]
            with np.errstate(all="ignore"):
                both = a.norm[rows][:, None] * b.norm[cols]
            if v != w:
                out[np.ix_(rows, cols)] = np.where(both <= 0, 0.0, -NAN)
                continue
            part, wild, other = (a.unit(w) * SCALE) @ units[w].T, a.wild[rows], b.wild[cols]
            if wild.any():
                part[wild] = _quotients(x[wild], y, both[wild])
            if other.any():
                part[:, other] = _quotients(x, y[other], both[:, other])
            out[np.ix_(rows, cols)] = part
    return out


class Tile:
    """Some queries and the k best candidates that have passed: row, score and key, by row and falling score."""

    def __init__(self, ids: pa.Array, vectors: pa.Array, kind: pa.DataType, k: int):
        self.ids, self.v, self.k = ids, Vectors(vectors), k
        self.row, self.score, self.keys = np.zeros(0, np.int64), np.zeros(0), pa.nulls(0, kind)
        self.floor = np.full(len(ids), -np.inf)
        self.named = np.asarray(pc.index_in(ids, value_set=ids).fill_null(-1))

    def add(self, keys: pa.Array, c: Vectors, units: dict[int, np.ndarray], own: bool) -> None:
        s = _scores(self.v, c, units)
        if own:  # a vector is no neighbour of its own
            found = np.asarray(pc.index_in(keys, value_set=self.ids).fill_null(-2))
            cols = np.flatnonzero(found >= 0)
            s[:, cols] = np.where(self.named[:, None] == found[cols], -np.inf, s[:, cols])
        hit = s > (self.floor + (0.5 - DOUBT))[:, None]  # an equal score comes too late
        many = np.flatnonzero(np.count_nonzero(hit, axis=1) > 16 * self.k)
        if len(many):
            some = s[many]
            least = np.partition(some, -self.k, axis=1)[:, -self.k]
            hit[many] &= some >= (least - 1 - 2 * DOUBT)[:, None]
        row, col = np.nonzero(hit)
        if len(row):
            self._keep(row, self._settled(s[row, col], row, col, c), keys.take(pa.array(col)))

    def _settled(self, s: np.ndarray, row: np.ndarray, col: np.ndarray, c: Vectors) -> np.ndarray:
        """The scores s of pairs in whole numbers."""
        out = _rounded(s)
        doubt = np.flatnonzero(np.abs(np.abs(s - np.trunc(s)) - 0.5) < DOUBT)
        for w in np.unique(self.v.width[row[doubt]]):
            of = doubt[self.v.width[row[doubt]] == w]
            for k in range(0, len(of), SUMMED):
                at = of[k : k + SUMMED]
                r, o = row[at], col[at]
                p = self.v.x[w][self.v.place[r]].astype(np.float64) * c.x[w][c.place[o]]
                out[at] = _rounded(_in_order(p) / (self.v.norm[r] * c.norm[o]) * SCALE)
        return out

    def _keep(self, row: np.ndarray, score: np.ndarray, keys: pa.Array) -> None:
        row, score = np.concatenate([self.row, row]), np.concatenate([self.score, score])
        order = np.lexsort((-score, row))  # keeps the order of arrival among equals
        at = row[order]
        kept = order[np.arange(len(at)) - np.searchsorted(at, at) < self.k]
        self.row, self.score, self.keys = row[kept], score[kept], pa.concat_arrays([self.keys, keys]).take(pa.array(kept))
        counts = np.bincount(self.row, minlength=len(self.floor))
        full = counts >= self.k
        self.floor[full] = self.score[np.cumsum(counts)[full] - 1]

    def result(self) -> tuple[pa.Array, pa.Array, pa.Array]:
        score = np.where(self.score == NAN, np.nan, self.score / SCALE + 0.0)
        return self.ids.take(pa.array(self.row)), self.keys, pa.array(score, pa.float64(), mask=self.score == -NAN)


class Search:
    """The queries of one unit of work."""

    def __init__(self, held: list[tuple[pa.Array, pa.Array]], kind: pa.DataType, k: int, own: bool):
        ids, vectors = (pa.concat_arrays(x) for x in zip(*held, strict=True))
        self.tiles = [Tile(ids.slice(a, TILE), vectors.slice(a, TILE), kind, k) for a in range(0, len(ids), TILE)]
        self.own, self.seen = own, 0

    def add(self, keys: pa.Array, vectors: pa.Array) -> None:
        at = 0
        while at < len(keys):
            size = PIECE if self.seen else FIRST
            some, c = keys.slice(at, size), Vectors(vectors.slice(at, size))
            units = {w: c.unit(w) for w in c.x}
            for tile in self.tiles:
                tile.add(some, c, units, self.own)
            at, self.seen = at + size, self.seen + len(some)


def _runs(b: pa.RecordBatch, by: list[str]) -> list[int]:
    """Where rows begin that differ from the row before."""
    new = np.zeros(b.num_rows, bool)
    new[:1] = True
    for name in by:
        new[1:] |= np.asarray(pc.not_equal(b[name].slice(1), b[name].slice(0, max(b.num_rows - 1, 0))))
    return [*np.flatnonzero(new).tolist(), b.num_rows]


def best(batches: Iterator[pa.RecordBatch], unit: list[str], key: str, k: int, own: bool) -> Iterator[pa.RecordBatch]:
    """(query_id, key, score): the k best candidates of each query of a unit. Rows come by unit, side (0: queries, 1: candidates) and id; own: a query does not meet its own id."""
    now, held, search = None, [], None
    out: list[tuple[pa.Array, pa.Array, pa.Array]] = []

    def passed() -> pa.RecordBatch:
        columns = [pa.concat_arrays(x) for x in zip(*out, strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, ["query_id", key, "score"])

    for b in batches:
        cuts = _runs(b, [*unit, "side"])
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            some = b.slice(lo, hi - lo)
            if (first := tuple(some[c][0].as_py() for c in unit)) != now:
                out.extend(t.result() for t in (search.tiles if search else []))
                now, held, search = first, [], None
            if some["side"][0].as_py() == 0:
                held.append((some["query_id"], some["embedding"]))
            elif held:
                search = search or Search(held, some[key].type, k, own)
                search.add(some[key], some["embedding"])
            if sum(len(o[0]) for o in out) >= PASSED:
                yield passed()
    out.extend(t.result() for t in (search.tiles if search else []))
    if out:
        yield passed()
