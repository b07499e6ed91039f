"""Exact Jaccard join on word shingles with set-relation skipping, answered as links and components.

1. One pass turns every text into its set of 64-bit shingle hashes, names the set by 128 bits of it, and asks, chunk by chunk, how frequent each hash is.
   The questions go to ranges of hashes, which count exactly; the answers, but for hashes that stand in one set, come back to the chunks.
2. Each set's rarest hashes (the prefix that any linked set must meet) enter index lists, but for those of one set. A list is skipped in blocks: sets of
   one size enter once, and only sizes that can link are chained. The chains' components hold every pair that can link.
3. The sets of those components are brought together, and the join runs inside: lists are cut by position and size, and the
   overlaps of a set that is much like one already answered are derived from that one's by the few hashes in which they differ.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import brief, kept, modest_batches, partitions, settle

#: Documents hashed together; words and set names that a task remembers.
TOGETHER, KNOWN, SEEN = 256, 250_000, 50_000
#: Hashes and sets of a chunk; occurrences in a chunk from which a hash asks once for all its sets; hashes of a range; chunks answered together.
CHUNK_HASHES, CHUNK_SETS, OFTEN, RANGE, ANSWERED = 1 << 18, 1 << 15, 4, 500_000, 8
#: What one unit of the join holds at most: hashes and sets. A larger component is joined block against block.
UNIT_HASHES, UNIT_SETS = 4_000_000, 20_000
#: Reference rows kept; similarity from which a row is derived; nodes of many edges that are broadcast at most.
REFERENCES, ALIKE, HUBS = 32, 0.8, 50_000
#: Bits of the filter that tells which sets are brought together: 2 MiB.
PLACES = 1 << 24
GOLD = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Whole texts to sorted arrays of distinct 64-bit shingle hashes. Words are runs of bytes other than space and tab to carriage return."""

    def __init__(self, n: int):
        self.n, self.known = n, {}
        self.by = [np.uint64((GOLD * (2 * k + 1)) & MASK) for k in range(n)]

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode().lower().split()  # on bytes: A-Z and ASCII white space alone
        known = self.known
        if len(known) > KNOWN:
            known.clear()
        try:
            ids = [known[w] for w in words]
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            ids = [known[w] for w in words]
        a, n = np.array(ids, np.uint64), self.n
        if len(a) == 0:
            return a
        if len(a) < n:
            return _mix(sum((a[k : k + 1] * self.by[k] for k in range(len(a))), np.uint64(0) + np.full(1, len(a), np.uint64)))
        last = len(a) - n + 1
        s = a[:last] * self.by[0]
        for k in range(1, n):
            s = s + a[k : k + last] * self.by[k]
        return np.unique(_mix(s))


def _name(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for the set, as two signed longs."""
    return tuple(int.from_bytes(h, "little", signed=True) for h in (lambda d: (d[:8], d[8:]))(xxhash.xxh3_128_digest(s.tobytes())))


def _needed(n: np.ndarray | int, num: int, den: int) -> np.ndarray | int:
    """The least overlap that a set of n needs with any set it links to."""
    return (num * n + den - 1) // den


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, str]]:
    for a in range(0, batch.num_rows, TOGETHER):
        some = batch.slice(a, TOGETHER)
        yield from zip(some["doc_id"].to_pylist(), some["text"].to_pylist(), strict=True)


PROFILE = "doc_id long, same long, n int, hi long, lo long, chunk long, bucket int, request binary"
FACTS = "chunk", "bucket", "request"
OWN = "doc_id", "same", "n", "hi", "lo"
ANSWER = np.dtype([("key", "<u8"), ("set", "<u2"), ("df", "<u4")])
ALL = 0xFFFF  # in an answer: for all sets of the chunk that hold the hash


def _join_bytes(*arrays: np.ndarray) -> bytes:
    """Arrays with their lengths before them."""
    return np.array([len(x) for x in arrays], "<u4").tobytes() + b"".join(x.tobytes() for x in arrays)


def _split_bytes(data: bytes, *kinds: str) -> list[np.ndarray]:
    sizes, at, out = np.frombuffer(data, "<u4", len(kinds)), 4 * len(kinds), []
    for n, kind in zip(sizes.tolist(), kinds, strict=True):
        out.append(np.frombuffer(data, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def _requests(sets: list[np.ndarray], names: list[tuple[int, int]], buckets: int) -> tuple[list[int], list[bytes]]:
    """A chunk's questions by range of hashes, and under -1 what the chunk itself needs: its sets, and which of them hold the hashes that ask for all.

    A hash's key is its range and 24 more bits. Keys that meet by chance only make a hash look more frequent than it is.
    """
    size = np.array([len(s) for s in sets], "<u4")
    h, of = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype="<u2"), size)
    key = (h & np.uint64(0xFFFFFFFF)) % np.uint64(buckets) << np.uint64(24) | h >> np.uint64(40)
    order = np.argsort(key, kind="stable")
    by = key[order]
    start = np.flatnonzero(np.append(True, by[1:] != by[:-1]))
    times = np.diff(np.append(start, len(by)))
    often = times >= OFTEN
    many = np.zeros(len(key), bool)
    many[order] = np.repeat(often, times)
    own = np.array(names, "<i8").reshape(-1, 2)
    facts = _join_bytes(size, own[:, 0], own[:, 1], key[many], of[many])
    all_, count = by[start[often]], times[often].astype("<u4")
    lone, lone_of = key[~many], of[~many]
    into = np.argsort((lone >> np.uint64(24)).astype(np.int32), kind="stable")  # within a range by set
    lone, lone_of = lone[into], lone_of[into]
    bucket = np.unique(np.concatenate([lone >> np.uint64(24), all_ >> np.uint64(24)]))
    edge = np.append(bucket, bucket[-1:] + np.uint64(1))
    i, j = np.searchsorted(lone >> np.uint64(24), edge).tolist(), np.searchsorted(all_ >> np.uint64(24), edge).tolist()
    three = lone.view(np.uint8).reshape(-1, 8)[:, :3]
    all_ = (all_ & np.uint64(0xFFFFFF)).astype("<u4")
    steps = lambda a, b: np.frombuffer(zlib.compress(np.diff(lone_of[a:b], prepend=lone_of.dtype.type(0)).astype("<u2").tobytes(), 1), np.uint8)
    return [*bucket.tolist(), -1], [*(_join_bytes(three[i[k] : i[k + 1]].ravel(), steps(i[k], i[k + 1]), all_[j[k] : j[k + 1]], count[j[k] : j[k + 1]]) for k in range(len(bucket))), facts]


def _profile(docs: DataFrame, n: int, buckets: int) -> DataFrame:
    """A row for each document, and rows of questions about the sets that a task meets first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, seen = kept(Shingler, n), set()
        part, seq = TaskContext.get().partitionId(), 0
        sets: list[np.ndarray] = []
        names: list[tuple[int, int]] = []
        held = 0

        def asked() -> pa.RecordBatch:
            bucket, data = _requests(sets, names, buckets)
            none = pa.nulls(len(bucket), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, pa.nulls(len(bucket), pa.int32()), none, none, pa.array([part << 32 | seq] * len(bucket), pa.int64()), pa.array(bucket, pa.int32()), pa.array(data, pa.binary())], [*OWN, *FACTS])

        for batch in batches:
            ids, sizes, his, los = [], [], [], []
            for doc_id, text in _texts(batch):
                s = make(text or "")
                name = _name(s) if len(s) else (None, None)
                ids.append(doc_id)
                sizes.append(len(s))
                his.append(name[0])
                los.append(name[1])
                if len(s) and name not in seen:
                    if len(seen) > SEEN:
                        seen.clear()
                    seen.add(name)
                    sets.append(s)
                    names.append(name)
                    held += len(s)
                    if held > CHUNK_HASHES or len(sets) >= CHUNK_SETS:
                        yield asked()
                        sets, names, held, seq = [], [], 0, seq + 1
            k = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), batch["same"], pa.array(sizes, pa.int32()), pa.array(his, pa.int64()), pa.array(los, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], [*OWN, *FACTS])
        if sets:
            yield asked()

    return docs.mapInArrow(run, PROFILE)


def _answered(asked: DataFrame) -> DataFrame:
    """(chunk, data): for each chunk its hashes that stand in more than one set, and in how many. A range holds at most OFTEN entries of a hash for each chunk."""

    def run(rows: pa.Table) -> pa.Table:
        bucket = np.uint64(rows["bucket"][0].as_py()) << np.uint64(24)
        parts = []
        for x in rows["request"]:
            three, steps, all_, count = _split_bytes(x.as_py(), "u1", "u1", "<u4", "<u4")
            three = three.reshape(-1, 3).astype(np.uint32)
            parts.append((three[:, 0] | three[:, 1] << 8 | three[:, 2] << 16, np.cumsum(np.frombuffer(zlib.decompress(steps), "<u2"), dtype=np.uint16), all_, count))
        lone, of, all_, count = (np.concatenate([p[k] for p in parts]) for k in range(4))
        _, at = np.unique(np.concatenate([lone, all_]), return_inverse=True)
        df = np.bincount(at, np.concatenate([np.ones(len(lone), np.int64), count]))[at]
        out = np.zeros(len(lone) + len(all_), ANSWER)
        out["key"], out["set"], out["df"] = np.concatenate([lone, all_]).astype(np.uint64) | bucket, np.append(of, np.full(len(all_), ALL)), np.minimum(df, 0xFFFFFFFF)
        one, two = out[: len(lone)], out[len(lone) :]
        i, j = np.cumsum([len(p[0]) for p in parts]), np.cumsum([len(p[2]) for p in parts])
        shared = one["df"] > 1
        data = [a[b].tobytes() + c.tobytes() for a, b, c in zip(np.split(one, i[:-1]), np.split(shared, i[:-1]), np.split(two, j[:-1]), strict=True)]
        return pa.Table.from_arrays([rows["chunk"], pa.array(data, pa.binary())], ["chunk", "data"])

    return asked.filter("bucket >= 0").select(*FACTS).groupBy("bucket").applyInArrow(run, "chunk long, data binary").filter(F.length("data") > 0)


POSTING = np.dtype([("token", "<u8"), ("n", "<u4"), ("hi", "<i8"), ("lo", "<i8")])
EDGE = "a_hi long, a_lo long, b_hi long, b_lo long"


def _edges(p: np.ndarray, q: np.ndarray) -> list[pa.Array]:
    return [pa.array(np.ascontiguousarray(x[c]), pa.int64()) for x in (p, q) for c in ("hi", "lo")]


def _distinct(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(np.rec.fromarrays([p["hi"], p["lo"], q["hi"], q["lo"]], names="a,b,c,d"))
    name = np.dtype([("hi", "<i8"), ("lo", "<i8")])
    one, two = np.zeros(len(both), name), np.zeros(len(both), name)
    one["hi"], one["lo"], two["hi"], two["lo"] = both["a"], both["b"], both["c"], both["d"]
    return one, two


def _prefixes(facts: bytes, answers: np.ndarray, num: int, den: int) -> np.ndarray:
    """A chunk's index entries: of each set's prefix, from rare to frequent, the hashes that other sets hold too."""
    size, hi, lo, key, of = _split_bytes(facts, "<u4", "<i8", "<i8", "<u8", "<u2")
    lone, wide = answers[answers["set"] != ALL], np.sort(answers[answers["set"] == ALL], order="key")
    owner = np.concatenate([lone["set"], of]).astype(np.int64)
    token = np.concatenate([lone["key"], key])
    df = np.concatenate([lone["df"], wide["df"][np.searchsorted(wide["key"], key)]])
    order = np.lexsort((token, df, owner))
    owner, token = owner[order], token[order]
    there = np.bincount(owner, minlength=len(size))
    n = size.astype(np.int64)
    position = np.arange(len(owner)) - np.repeat(np.cumsum(there) - there, there) + np.repeat(n - there, there)  # hashes of one set come first
    keep = position < np.repeat(n - _needed(n, num, den) + 1, there)
    owner, p = owner[keep], np.zeros(int(keep.sum()), POSTING)
    p["token"], p["n"], p["hi"], p["lo"] = token[keep], size[owner], hi[owner], lo[owner]
    return p


def _postings(asked: DataFrame, num: int, den: int, buckets: int) -> DataFrame:
    """Index entries by bucket of their hash; and, for sets of one size in a list of some chunks, a chain to the one that enters."""

    def run(rows: pa.Table) -> pa.Table:
        facts, answers = {}, {}
        for chunk, fact, data in zip(rows["chunk"].to_pylist(), rows["request"], rows["data"], strict=True):
            if fact.is_valid:
                facts[chunk] = fact.as_py()
            else:
                answers.setdefault(chunk, []).append(np.frombuffer(data.as_py(), ANSWER))
        p = np.concatenate([_prefixes(facts[c], np.concatenate(answers[c]), num, den) for c in facts if c in answers] or [np.zeros(0, POSTING)])
        p = p[np.lexsort((p["lo"], p["hi"], p["n"], p["token"]))]
        first = np.append(True, (p["token"][1:] != p["token"][:-1]) | (p["n"][1:] != p["n"][:-1]))[: len(p)]
        lead = np.flatnonzero(first)[np.cumsum(first) - 1]
        a, b = _distinct(p[lead[~first]], p[~first])
        p = p[first]
        bucket = ((p["token"] * np.uint64(GOLD)) >> np.uint64(33)).astype(np.int64) % buckets
        order = np.argsort(bucket, kind="stable")
        p, bucket = p[order], bucket[order]
        cut = np.flatnonzero(np.diff(bucket)) + 1
        parts = [x.tobytes() for x in np.split(p, cut) if len(x)]
        none, nothing = pa.nulls(len(parts), pa.int64()), pa.nulls(len(a), pa.binary())
        own = pa.array(bucket[np.append(0, cut)] if len(p) else [], pa.int32())
        return pa.Table.from_arrays([*(pa.concat_arrays([x, none]) for x in _edges(a, b)), pa.concat_arrays([pa.nulls(len(a), pa.int32()), own]), pa.concat_arrays([nothing, pa.array(parts, pa.binary())])], ["a_hi", "a_lo", "b_hi", "b_lo", "bucket", "data"])

    facts = asked.filter("bucket = -1").select("chunk", "request", F.lit(None).cast("binary").alias("data"))
    both = facts.unionByName(_answered(asked).select("chunk", F.lit(None).cast("binary").alias("request"), "data"))
    return both.withColumn("some", F.floor(F.col("chunk") / ANSWERED)).groupBy("some").applyInArrow(run, f"{EDGE}, bucket int, data binary")


def _chained(postings: DataFrame, num: int, den: int) -> DataFrame:
    """Edges along each list in order of size, as far as neighbours can link: any pair that can link is joined by them."""

    def run(rows: pa.Table) -> pa.Table:
        p = np.concatenate([np.frombuffer(x.as_py(), POSTING) for x in rows["data"]])
        p = np.unique(p)  # by hash, size, name
        near = (p["token"][1:] == p["token"][:-1]) & (np.int64(den) * p["n"][:-1] >= np.int64(num) * p["n"][1:])
        a, b = _distinct(p[:-1][near], p[1:][near])
        return pa.Table.from_arrays(_edges(a, b), ["a_hi", "a_lo", "b_hi", "b_lo"])

    return postings.filter(F.col("bucket").isNotNull()).select("bucket", "data").groupBy("bucket").applyInArrow(run, EDGE)


def _pair(hi: str, lo: str) -> Column:
    return F.struct(F.col(hi).alias("hi"), F.col(lo).alias("lo"))


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one task as a forest of stars: each node and the least node it reaches there."""
    for batch in batches:
        if not batch.num_rows:
            continue
        a = np.stack([np.asarray(batch[c]) for c in ("a_hi", "a_lo")], axis=1)
        b = np.stack([np.asarray(batch[c]) for c in ("b_hi", "b_lo")], axis=1)
        nodes = np.concatenate([a, b]).copy().view([("hi", "<i8"), ("lo", "<i8")]).ravel()
        name, at = np.unique(nodes, return_inverse=True)
        root = _roots(len(name), at[: len(a)], at[len(a) :])
        keep = root != np.arange(len(name))
        yield pa.RecordBatch.from_arrays(_edges(name[keep], name[root[keep]]), ["a_hi", "a_lo", "b_hi", "b_lo"])


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of each node's component."""
    up = np.arange(n)
    while len(a):
        ra, rb = up[a], up[b]
        lo, hi = np.minimum(ra, rb), np.maximum(ra, rb)
        open_ = lo != hi
        a, b, lo, hi = a[open_], b[open_], lo[open_], hi[open_]
        np.minimum.at(up, hi, lo)
        while True:
            over = up[up]
            if (over == up).all():
                break
            up = over
    return up


def _with_least(edges: DataFrame, least: DataFrame, degree: int) -> DataFrame:
    """edges with the least neighbour m of their u. Nodes of more than ``degree`` edges, HUBS at most, are broadcast, so that none gathers its edges in a task."""
    hubs = least.filter(F.col("n") > degree).select("u", "m")
    rest = least.filter(F.col("n") <= degree).select("u", "m")
    far = edges.join(F.broadcast(hubs), "u", "left_anti").join(rest, "u")
    return edges.join(F.broadcast(hubs), "u").unionByName(far)


def components(edges: DataFrame) -> DataFrame:
    """(u, v): every node of the edges but the least of each component, and that least node. Nodes are structs (hi, lo).

    Large-star and small-star rounds, each written to the shared folder; a node's neighbours are only ever reduced to their minimum. The rounds end when
    every node has one edge to a lesser one that has none itself: then these stars are the components.
    """
    e = edges.mapInArrow(_forest, EDGE).select(_pair("a_hi", "a_lo").alias("u"), _pair("b_hi", "b_lo").alias("v"))
    e = settle(e.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
    while True:
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        ends = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        with brief(e.sparkSession):
            count, open_ = ends.agg(F.coalesce(F.sum("up"), F.lit(0)), F.coalesce(F.sum(((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).cast("int")), F.lit(0))).first()
        if not open_:
            return e
        degree = max(1000, 2 * count // HUBS)  # the edges have 2 * count ends, so HUBS nodes at most have more
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"), F.count("*").alias("n"))
        large = _with_least(both, least, degree).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _with_least(large, low, degree).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x")).select(F.col("x.v").alias("u"), F.col("x.m").alias("v"))
        e = settle(small.filter("u <> v").distinct(), "stars")


def link(sets: list[np.ndarray], weight: np.ndarray, num: int, den: int, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each set's component (its least index) and the summed weights of the sets that it links to.

    side: where given, only sets of different sides link here. Sets must be in ascending order of size and distinct.
    """
    g = len(sets)
    links = np.zeros(g, np.int64)
    if g < 2:
        return np.arange(g), links
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    _, inv, df = np.unique(flat, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(g), size)
    start = np.cumsum(size) - size
    # A set's hashes from rare to frequent; position in that order.
    order = np.lexsort((inv, df[inv], owner))
    inv = inv[order]
    position = np.arange(len(inv)) - np.repeat(start, size)
    in_prefix = position < np.repeat(size - _needed(size, num, den) + 1, size)
    by = np.argsort(inv, kind="stable")  # lists, each ascending by set and so by size
    lists, ends = owner[by], np.cumsum(df)
    begin = ends - df
    front = by[in_prefix[by]]  # the lists' blocks of prefix positions
    f_owner, f_position = owner[front], position[front]
    f_end = np.cumsum(np.bincount(inv[front], minlength=len(df)))
    f_begin = np.append(0, f_end[:-1])
    low = np.searchsorted(size, _needed(size, num, den))  # the first set that is large enough
    rows: list[tuple[int, np.ndarray]] = []
    pairs_a, pairs_b = [], []
    for x in range(g):
        a, b = start[x], start[x] + size[x]
        mine = inv[a:b]
        # Block skip: in the lists of the prefix, no set too small, and none whose positions leave too few hashes.
        hit = low[x] < x and _meets(mine[: size[x] - _needed(size[x], num, den) + 1], x, low[x], size, f_begin, f_end, f_owner, f_position, num, den)
        if not hit:
            continue
        row = None
        for y, other in reversed(rows):
            if other[x] >= ALIKE * max(size[x], size[y]):  # derive the answers from those of a set much like it
                row = other.copy()
                theirs = inv[start[y] : start[y] + size[y]]
                for t in np.setdiff1d(mine, theirs, assume_unique=True):
                    row[lists[begin[t] : ends[t]]] += 1
                for t in np.setdiff1d(theirs, mine, assume_unique=True):
                    row[lists[begin[t] : ends[t]]] -= 1
                break
        if row is None:
            row = np.bincount(np.concatenate([lists[begin[t] : ends[t]] for t in mine[df[mine] > 1]] or [np.zeros(0, np.int64)]), minlength=g)
            row[x] = size[x]
            rows = [*rows[-REFERENCES + 1 :], (x, row)]
        o = row[low[x] : x]
        good = den * o >= num * (size[x] + size[low[x] : x] - o)
        if side is not None:
            good &= side[low[x] : x] != side[x]
        y = np.flatnonzero(good) + low[x]
        if len(y):
            links[x] += weight[y].sum()
            links[y] += weight[x]
            pairs_a.append(y)
            pairs_b.append(np.full(len(y), x))
            if len(pairs_a) > 500:  # keep a forest of what has been found
                root = _roots(g, np.concatenate(pairs_a), np.concatenate(pairs_b))
                pairs_a, pairs_b = [np.arange(g)], [root]
    return _roots(g, np.concatenate(pairs_a), np.concatenate(pairs_b)) if pairs_a else np.arange(g), links


def _meets(prefix, x, low, size, begin, end, owner, position, num, den) -> bool:
    for i, t in enumerate(prefix):
        a, b = begin[t], end[t]
        if b - a < 2:
            continue
        a = a + np.searchsorted(owner[a:b], low)
        b = a + np.searchsorted(owner[a:b], x)
        if b > a:
            y, j = owner[a:b], position[a:b]
            most = 1 + np.minimum(size[x] - i - 1, size[y] - j - 1)
            if (den * most >= num * (size[x] + size[y] - most)).any():
                return True
    return False


UNITS = "hi long, lo long, root_hi long, root_lo long, links long"


def _joined(units: DataFrame, num: int, den: int) -> DataFrame:
    def run(rows: pa.Table) -> pa.Table:
        c = {k: np.asarray(rows[k].combine_chunks()) for k in ("c_hi", "c_lo", "hi", "lo", "copies", "block", "one", "two")}
        blobs = rows["data"].combine_chunks()
        order = np.lexsort((c["lo"], c["hi"], c["c_lo"], c["c_hi"]))
        same = lambda names: np.append(True, np.logical_or.reduce([c[k][order][1:] != c[k][order][:-1] for k in names]))
        order = order[same(("c_hi", "c_lo", "hi", "lo"))]  # a set that several tasks brought
        cut = np.flatnonzero(same(("c_hi", "c_lo")))
        out = []
        for part in np.split(order, cut[1:]):
            sets = [np.frombuffer(blobs[int(k)].as_py(), "<u8") for k in part]
            by = np.argsort([len(s) for s in sets], kind="stable")
            part, sets = part[by], [sets[k] for k in by]
            apart = c["one"][part[0]] != c["two"][part[0]]
            root, links = link(sets, c["copies"][part], num, den, c["block"][part] if apart else None)
            out.append((part, part[root], links))
        own, root, links = (np.concatenate([o[k] for o in out]) for k in range(3))
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in (c["hi"][own], c["lo"][own], c["hi"][root], c["lo"][root], links)], ["hi", "lo", "root_hi", "root_lo", "links"])

    return units.groupBy("unit", "one", "two").applyInArrow(run, UNITS)


def _first(*also: str) -> Column:
    """What orders the rows of a component: those with a doc_id before others, then by doc_id and a hash of the text."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "same", *also)


def _linked(docs: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """(doc_id, same: a hash of the text, n, first: the first row of its component as _first() orders them, links), a row for each document."""
    spark = docs.sparkSession
    modest_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("same"))
    count, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    whole = settle(_profile(rows, shingle, max(1, min(partitions(spark), 64), size // (6 * RANGE))), "profile")
    profile = whole.filter(F.col("chunk").isNull()).select(*OWN)
    sets = settle(profile.filter("n > 0").groupBy("hi", "lo").agg(F.max("n").alias("n"), F.min(_first()).alias("least"), F.count("*").alias("copies")), "sets")

    postings = settle(_postings(whole.filter(F.col("chunk").isNotNull()).select(*FACTS), num, den, max(partitions(spark), count * 64 // 500_000)), "postings", "snappy")
    near = postings.filter(F.col("bucket").isNull()).select("a_hi", "a_lo", "b_hi", "b_lo").unionByName(_chained(postings, num, den))
    stars = components(near)
    roots = stars.select(F.col("v").alias("u"), "v").distinct()
    groups = stars.unionByName(roots).select(F.col("u.hi").alias("hi"), F.col("u.lo").alias("lo"), F.col("v.hi").alias("c_hi"), F.col("v.lo").alias("c_lo")).join(sets.select("hi", "lo", "n", "copies"), ["hi", "lo"])
    groups = settle(groups, "groups")
    large = groups.groupBy("c_hi", "c_lo").agg(F.greatest(F.ceil(F.sum("n") / (UNIT_HASHES // 2)), F.ceil(F.count("*") / (UNIT_SETS // 2))).alias("blocks"), F.sum("n").alias("total"), F.count("*").alias("sets"))
    large = settle(large, "large")
    wide = (F.col("total") > UNIT_HASHES) | (F.col("sets") > UNIT_SETS)
    total, many = large.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum(wide.cast("int")), F.lit(0))).first()
    bins = max(partitions(spark), int(total) // (UNIT_HASHES // 4))

    brought = _brought(rows, shingle, groups).join(groups.drop("n").join(large, ["c_hi", "c_lo"]), ["hi", "lo"])
    brought = brought.withColumn("block", F.when(wide, F.pmod(F.xxhash64("hi", "lo"), F.col("blocks"))).otherwise(F.lit(0)))
    other = F.explode(F.when(wide, F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array(F.lit(0).cast("long"))))
    units = brought.withColumn("other", other).select(
        F.when(wide, F.xxhash64("c_hi", "c_lo")).otherwise(F.pmod(F.xxhash64("c_hi", "c_lo"), F.lit(bins))).alias("unit"), F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"),
        "c_hi", "c_lo", "hi", "lo", "copies", "block", "data",
    )
    found = settle(_joined(units, num, den), "links")
    if many:
        own = found.select(F.col("hi").alias("a_hi"), F.col("lo").alias("a_lo"), F.col("root_hi").alias("b_hi"), F.col("root_lo").alias("b_lo"))
        joined = components(own).select(F.col("u.hi").alias("hi"), F.col("u.lo").alias("lo"), F.col("v.hi").alias("root_hi"), F.col("v.lo").alias("root_lo"))
        found = found.groupBy("hi", "lo").agg(F.sum("links").alias("links")).join(joined, ["hi", "lo"], "left")
    else:
        found = found.select("hi", "lo", "root_hi", "root_lo", "links")
    # Sets without a candidate are their own component; the others' first row is found on the few sets that link.
    mine = sets.join(found, ["hi", "lo"], "left").withColumn("root_hi", F.coalesce("root_hi", "hi")).withColumn("root_lo", F.coalesce("root_lo", "lo"))
    least = mine.groupBy("root_hi", "root_lo").agg(F.min("least").alias("first"))
    named = mine.join(least, ["root_hi", "root_lo"]).select("hi", "lo", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    return profile.join(named, ["hi", "lo"], "left").select("doc_id", "same", "n", "first", F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def join(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Per document: doc_id, n_shingles (size of its set), component_id (least doc_id reachable by links) and n_links (documents it links to).

    Two documents link when den * (size of the intersection) >= num * (size of the union) of their sets of distinct shingles of ``shingle``
    words; a text with fewer words is one shingle; a null, empty or blank text has none and links with nothing. Copies link with each other
    and are handled as one set, so repeated rows stay in the result. Rows without a doc_id take part but name no component; one whose
    component has no doc_id gets null. Shingles are 64-bit hashes of words' hashes, so two different ones are told apart but for chance. Other columns are not read. A text of any length is hashed whole, in one task. An empty table gives no rows.
    """
    out = _linked(docs, shingle, num, den)
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("first.doc_id")).otherwise(F.col("doc_id")).alias("component_id"), F.col("links").alias("n_links"))


def keep_one(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs, with all their columns, but for all rows of a component save its first: the one with the least doc_id (null last), then by a hash of the text.

    Rows are told apart by doc_id and text, so rows that share a doc_id but not their text are judged each for itself; of rows that share both one stays.
    Texts without a shingle stay, however often.
    """
    rows = settle(_linked(docs, shingle, num, den).filter("n > 0").select("doc_id", "same", "first"), "linked")
    # Written, so that Spark knows their size and broadcasts them where they are small.
    lost = settle(rows.filter(_first() != F.col("first")).select("doc_id", "same").distinct(), "lost")
    twice = settle(rows.filter(_first() == F.col("first")).groupBy("doc_id", "same").count().filter("count > 1").select("doc_id", "same"), "twice")
    own = docs.select(F.struct(*docs.columns).alias("own"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("same"))
    of = lambda some: own["doc_id"].eqNullSafe(some["doc_id"]) & (own["same"] == some["same"])
    left = own.join(lost, of(lost), "left_anti")
    if twice.isEmpty():
        return left.select("own.*")
    left = own.join(lost.unionByName(twice).alias("gone"), own["doc_id"].eqNullSafe(F.col("gone.doc_id")) & (own["same"] == F.col("gone.same")), "left_anti")
    return left.select("own").unionByName(own.join(twice, of(twice), "left_semi").groupBy("doc_id", "same").agg(F.first("own").alias("own")).select("own")).select("own.*")


def _brought(docs: DataFrame, n: int, groups: DataFrame) -> DataFrame:
    """(hi, lo, data): the sets that stand in a group, perhaps some more and some of them repeated."""

    def pack(rows: pa.Table) -> pa.Table:
        bits = np.zeros(1 << 16, np.uint8)
        bits[np.asarray(rows["bit"])] = 1
        return pa.Table.from_pydict({"block": rows["block"].slice(0, 1).cast(pa.int64()), "bits": [np.packbits(bits).tobytes()]})

    where = F.col("lo").bitwiseAND(F.lit(PLACES - 1))
    marked = groups.select(F.shiftright(where, 16).cast("long").alias("block"), where.bitwiseAND(F.lit(0xFFFF)).cast("int").alias("bit")).distinct()
    got = marked.groupBy("block").applyInArrow(pack, "block long, bits binary").toArrow()  # PLACES bits at most, whatever the input
    bits = np.zeros(PLACES >> 3, np.uint8)
    for block, some in zip(got["block"].to_pylist(), got["bits"].to_pylist(), strict=True):
        bits[block << 13 : (block + 1) << 13] = np.frombuffer(some, np.uint8)
    held = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, bits, seen = kept(Shingler, n), held.value, set()
        for batch in batches:
            names, data = [], []
            for _, text in _texts(batch):
                s = make(text or "")
                if not len(s):
                    continue
                name = _name(s)
                at = name[1] & (PLACES - 1)
                if bits[at >> 3] >> (7 - (at & 7)) & 1 and name not in seen:
                    if len(seen) > SEEN:
                        seen.clear()
                    seen.add(name)
                    names.append(name)
                    data.append(s.astype("<u8").tobytes())
            own = np.array(names, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(own[:, 0]), pa.array(own[:, 1]), pa.array(data, pa.binary())], ["hi", "lo", "data"])

    return docs.mapInArrow(run, "hi long, lo long, data binary")
