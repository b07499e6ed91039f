"""Quality scores by a factorisation machine.

Inputs of a score: hashed words, statistics of the text's structure, and the length column as metadata. Every input has a weight and a
short factor vector; a pair of inputs interacts by the product of its factors. The sum over all pairs is
half of (square of the sum - sum of the squares), so scoring is linear in the inputs that are there.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import kept, modest_batches

#: Hash buckets for words, factors of an input, passes, rows of a step, labelled rows learned from at most, documents featurised together.
BUCKETS, FACTORS, EPOCHS, STEP, SAMPLE, TOGETHER = 1 << 15, 8, 6, 128, 6000, 512
#: The bins' edges for standardised statistics.
EDGES = np.array([-1.5, -0.75, -0.25, 0.25, 0.75, 1.5, 3.0])
MARKS = "#$%&*|<>{}[]\\^~_=+@"
STATS = 18
KNOWN = 250_000


def statistics(text: str, words: list[str], counts: Counter, length: int | None) -> list[float]:
    """Numbers about the text's structure; all finite for any text."""
    n, w = len(text), len(words)
    lines = text.split("\n")
    most = counts.most_common(1)[0][1] if counts else 0
    marks = sum(text.count(c) for c in MARKS)
    letters = sum(map(len, counts))
    upper = 0 if text.islower() else sum(c for x, c in counts.items() if len(x) > 1 and x.isupper())
    return [
        np.log1p(n), np.log1p(w), n / (w + 1), letters / (len(counts) + 1), len(counts) / (w + 1), most / (w + 1), marks / (n + 1), upper / (w + 1),
        sum(text.count(d) for d in "0123456789") / (n + 1), text.count("!") / (w + 1), text.count(".") / (w + 1), text.count(",") / (w + 1), counts.get("|", 0) / (w + 1),
        len(lines) / (w + 1), len(set(lines)) / len(lines), max(map(len, counts), default=0) / 20.0, sum(1 for x in counts if len(x) > 25) / (len(counts) + 1), np.log1p(n if length is None else max(length, 0)),
    ]


class Featuriser:
    """Texts to hashed words with weights, in compressed rows, and statistics."""

    def __init__(self) -> None:
        self.bucket: dict[str, int] = {}

    def __call__(self, texts: list[str], lengths: list[int | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        index, value, stats, size, bucket = [], [], [], [], self.bucket
        if len(bucket) > KNOWN:
            bucket.clear()
        for text, length in zip(texts, lengths, strict=True):
            words = text.split()
            counts = Counter(words)
            stats.append(statistics(text, words, counts, length))
            for x in counts:
                if x not in bucket:
                    bucket[x] = zlib.crc32(x.lower().encode()) % BUCKETS
            index.append(np.fromiter(map(bucket.__getitem__, counts), np.int64, len(counts)))
            v = np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))
            value.append(v / max(np.sqrt(np.square(v).sum()), 1e-9))
            size.append(len(counts))
        return np.concatenate(index) if index else np.zeros(0, np.int64), np.concatenate(value) if value else np.zeros(0), np.array(size, np.int64), np.array(stats, np.float64).reshape(-1, STATS)


@dataclass
class Machine:
    """Weights and factors; inputs are the word buckets, then the standardised statistics, then their bins."""

    mean: np.ndarray
    spread: np.ndarray
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def inputs(self, index: np.ndarray, value: np.ndarray, size: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs and their values a row after the other, and the rows' starts. Every row has its statistics, so none is empty."""
        z = np.clip((stats - self.mean) / self.spread, -4, 4)
        bins = np.searchsorted(EDGES, z)
        own = np.concatenate([np.broadcast_to(BUCKETS + np.arange(STATS), z.shape), BUCKETS + STATS + np.arange(STATS) * (len(EDGES) + 1) + bins], axis=1)
        val = np.concatenate([z * 0.3, np.full(z.shape, 0.3)], axis=1)
        each = size + 2 * STATS
        start = np.cumsum(each) - each
        at = np.ones(int(each.sum()), bool)
        at[(start[:, None] + np.arange(2 * STATS)).ravel()] = False
        i, v = np.empty(len(at), np.int64), np.empty(len(at))
        i[at], v[at], i[~at], v[~at] = index, value, own.ravel(), val.ravel()
        return i, v, start

    def logits(self, i: np.ndarray, v: np.ndarray, start: np.ndarray) -> np.ndarray:
        if not len(start):
            return np.zeros(0)
        x = self.factor[i] * v[:, None]
        s, q = np.add.reduceat(x, start), np.add.reduceat(np.square(x), start)
        return self.bias + np.add.reduceat(self.weight[i] * v, start) + 0.5 * (np.square(s) - q).sum(axis=1)

    def score(self, *features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(*self.inputs(*features)), -30, 30)))


def fit(index: np.ndarray, value: np.ndarray, size: np.ndarray, stats: np.ndarray, y: np.ndarray, seed: int = 5) -> Machine:
    """Adaptive gradient steps on the logistic loss. Without both labels every score is the labels' share, or one half without any."""
    rng = np.random.default_rng(seed)
    inputs = BUCKETS + STATS + STATS * (len(EDGES) + 1)
    mean = stats.mean(axis=0) if len(y) else np.zeros(STATS)
    spread = np.maximum(stats.std(axis=0), 1e-6) if len(y) else np.ones(STATS)
    share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
    m = Machine(mean, spread, float(np.log(share / (1 - share))), np.zeros(inputs), rng.normal(0, 0.02, (inputs, FACTORS)))
    if len(y) == 0 or y.min() == y.max():
        m.factor[:] = 0
        return m
    i, v, start = m.inputs(index, value, size, stats)
    end = np.append(start[1:], len(i))
    gw, gv, gb = np.full(inputs, 1e-2), np.full((inputs, FACTORS), 1e-2), 1e-2
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for a in range(0, len(y), STEP):
            rows = order[a : a + STEP]
            n = end[rows] - start[rows]
            at = np.repeat(start[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())
            bi, bv, bs = i[at], v[at], np.cumsum(n) - n
            x = m.factor[bi] * bv[:, None]
            s, q = np.add.reduceat(x, bs), np.add.reduceat(np.square(x), bs)
            z = m.bias + np.add.reduceat(m.weight[bi] * bv, bs) + 0.5 * (np.square(s) - q).sum(axis=1)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) / len(rows)
            each, to, slot = np.repeat(g, n), *np.unique(bi, return_inverse=True)
            dw = np.bincount(slot, each * bv, len(to)) + 1e-5 * m.weight[to]
            part = (each * bv)[:, None] * (np.repeat(s, n, axis=0) - x)
            dv = np.stack([np.bincount(slot, part[:, k], len(to)) for k in range(FACTORS)], axis=1) + 1e-4 * m.factor[to]
            gw[to] += np.square(dw)
            gv[to] += np.square(dv)
            gb += g.sum() ** 2
            m.weight[to] -= 0.15 * dw / np.sqrt(gw[to])
            m.factor[to] -= 0.03 * dv / np.sqrt(gv[to])
            m.bias -= 0.05 * g.sum() / np.sqrt(gb)
    return m


def is_held_out(doc_id: Column) -> Column:
    """Rows that labels are never learned from: crc32 of the doc_id as text, modulo 3, is 1. A null doc_id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _inputs(docs: DataFrame) -> list[Column]:
    """doc_id, text, length, and nothing else of the documents."""
    length = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return [F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), length.alias("length")]


def sample_of(docs: DataFrame, labels: DataFrame, column: str, sample: int, usable: Column | None = None) -> DataFrame:
    """At most ``sample`` labelled rows of docs (with doc_id and text), with their label y: those whose doc_ids have the smallest hashes, one row for each.

    Labels other than 0 and 1 and null doc_ids are left out; a doc_id labelled twice has its larger label. Of rows that share a doc_id the one whose
    text has the smallest hash is taken.
    """
    known = labels.filter(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(column).cast("int").alias("y"))
    picked = (known if usable is None else known.filter(usable)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.join(F.broadcast(picked), "doc_id")  # at most `sample` rows of two numbers
    return rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), *[c for c in rows.columns if c != "doc_id"])).alias("row")).select("doc_id", "row.*")


def fitted(features: DataFrame, make: Callable[[pa.Table], Any]) -> Any:
    """A model that one task fits to all rows of features, a bounded sample in ascending doc_id order; only the model reaches the driver."""
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.list_({"int": pa.int32(), "float": pa.float32(), "double": pa.float64()}[t[6:-1]]) if t.startswith("array") else pa.int32() if t == "int" else pa.int64()) for c, t in features.dtypes if c != "doc_id")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches([b.select(schema.names) for b in batches], schema)
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(make(rows.sort_by("doc_id").combine_chunks()))], pa.binary())})

    return pickle.loads(features.repartition(1).mapInArrow(run, "model binary").first()["model"])


def flat(rows: pa.Table, column: str, kind: type) -> np.ndarray:
    return np.asarray(rows[column].combine_chunks().flatten(), kind) if len(rows) else np.zeros(0, kind)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Learns from at most ``sample`` labelled rows that are not held out, as sample_of() picks them."""
    modest_batches(docs.sparkSession)
    rows = sample_of(docs.select(*_inputs(docs)), labels, "quality", sample, ~is_held_out(F.col("doc_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = kept(Featuriser)
        for batch in batches:
            for a in range(0, batch.num_rows, TOGETHER):
                b = batch.slice(a, TOGETHER)
                index, value, size, stats = make(b["text"].to_pylist(), b["length"].to_pylist())
                cut = pa.array(np.append(0, np.cumsum(size)), pa.int32())
                yield pa.RecordBatch.from_arrays([b["doc_id"], pa.ListArray.from_arrays(cut, pa.array(index, pa.int32())), pa.ListArray.from_arrays(cut, pa.array(value, pa.float32())), pa.array(list(stats), pa.list_(pa.float64())), b["y"]], ["doc_id", "i", "v", "s", "y"])

    def make(got: pa.Table) -> Machine:
        size = np.asarray(got["i"].combine_chunks().value_lengths(), np.int64) if len(got) else np.zeros(0, np.int64)
        return fit(flat(got, "i", np.int64), flat(got, "v", np.float64), size, flat(got, "s", np.float64).reshape(-1, STATS), np.asarray(got["y"], np.float64))

    return fitted(rows.select("doc_id", "text", "length", "y").mapInArrow(run, "doc_id long, i array<int>, v array<float>, s array<double>, y int"), make)


def score(docs: DataFrame, machine: Machine, keep: bool = False) -> DataFrame:
    """Per document: doc_id, held_out, score from 0 to 1 (label 1 likelier when higher) and predicted (1 from 0.5 on).

    keep: return the documents' rows whole, as the struct own, and predicted. Null and empty texts are scored by their statistics alone. Rows keep their
    repeats; an empty table gives none; a very long text is read whole, in one task. Only doc_id, text and n_chars are read for a score, whatever other columns are called.
    """
    held = docs.sparkSession.sparkContext.broadcast(machine)  # a fixed number of inputs and factors
    modest_batches(docs.sparkSession)
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("own")) if keep else docs.select(*_inputs(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = kept(Featuriser)
        for batch in batches:
            for a in range(0, batch.num_rows, TOGETHER):
                b = batch.slice(a, TOGETHER)
                of = dict(zip(b.schema.field("own").type.names, b["own"].flatten(), strict=True)) if keep else {"text": b["text"], "n_chars": b["length"]}
                texts = [t or "" for t in of["text"].to_pylist()]
                lengths = of["n_chars"].to_pylist() if "n_chars" in of else [None] * len(texts)
                score = pa.array(held.value.score(*make(texts, lengths)), pa.float64())
                yield pa.RecordBatch.from_arrays([b["own" if keep else "doc_id"], score], ["own" if keep else "doc_id", "score"])

    scored = rows.mapInArrow(run, T.StructType([rows.schema["own"] if keep else T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())]))
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return scored.select("own", predicted) if keep else scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", predicted)
