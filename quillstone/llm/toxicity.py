"""Toxicity by a classifier chain.

One linear model for each category, in a fixed order; each sees the words and the probabilities that earlier models of the chain
gave. While training, those probabilities come from models that have not seen the row (out of fold), so a later model learns how
reliable the earlier ones are on new text. The last link is the label itself.

Labels only say toxic or not. The categories are found in the toxic rows themselves: a non-negative factorisation of the words that tell toxic rows from
others groups words that stand together, and a row belongs to the categories that make up much of it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain as chained

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import kept, modest_batches
from .quality import fitted, flat, sample_of

#: Categories looked for, words that they are told by at most, share of a row from which it belongs to a category, steps of the factorisation.
CATEGORIES, MARKS, PART, STEPS = 4, 400, 0.3, 200
LAST = "toxic"
BUCKETS, FOLDS, SAMPLE, TOGETHER, KNOWN = 1 << 18, 5, 8000, 512, 200_000
#: A word is an input if it is in so many training rows at least and its log odds are so many standard errors from none.
SUPPORT, ERRORS = 4, 3.5
WORD = regex.compile(r"[\p{L}\p{M}]+")


class Words:
    """Texts to the distinct hashed words of each; remembers tokens."""

    def __init__(self) -> None:
        self.bucket: dict[str, tuple[int, ...]] = {}

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.bucket) > KNOWN:
            self.bucket.clear()
        out, bucket = [], self.bucket
        for t in texts:
            seen = set(t.split())
            for x in seen:
                if x not in bucket:
                    bucket[x] = tuple(zlib.crc32(w.encode()) % BUCKETS for w in WORD.findall(x.lower()))
            out.append(np.unique(np.fromiter(chained.from_iterable(map(bucket.__getitem__, seen)), np.int64)))
        return out


@dataclass
class Link:
    """A linear model: chosen buckets in ascending order, their weights, the weights of the chain's earlier probabilities, the bias."""

    bucket: np.ndarray
    weight: np.ndarray
    chain: np.ndarray
    bias: float

    def probability(self, row: np.ndarray, inputs: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        """Rows' distinct buckets laid end to end, with the row of each; earlier: a column for each link before."""
        at = np.searchsorted(self.bucket, inputs)
        at[at == len(self.bucket)] = 0
        hit = self.bucket[at] == inputs if len(self.bucket) else np.zeros(len(inputs), bool)
        z = self.bias + np.bincount(row[hit], self.weight[at[hit]], len(earlier)) + earlier @ self.chain
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _telling(row: np.ndarray, inputs: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct buckets, each input's place among them, their log odds, and which of them tell the classes apart."""
    n, pos = len(y), float(y.sum())
    bucket, slot, df = np.unique(inputs, return_inverse=True, return_counts=True)
    with_y = np.bincount(slot, y[row], len(bucket))
    a, b, c, d = with_y + 0.5, pos - with_y + 0.5, df - with_y + 0.5, n - pos - df + with_y + 0.5
    odds = np.log(a * d / (b * c))
    return bucket, slot, odds, (df >= SUPPORT) & (np.abs(odds) > ERRORS * np.sqrt(1 / a + 1 / b + 1 / c + 1 / d))


def categories(row: np.ndarray, inputs: np.ndarray, toxic: np.ndarray, seed: int = 11) -> np.ndarray:
    """A column of labels for each category, the most frequent first: a toxic row's shares in the factors of its telling words. Without such words all are 0."""
    y = np.zeros((len(toxic), CATEGORIES))
    if not len(toxic) or not 0 < toxic.sum() < len(toxic):
        return y
    _, slot, odds, keep = _telling(row, inputs, toxic)
    keep &= odds > 0
    chosen = np.flatnonzero(keep)[np.argsort(-odds[keep], kind="stable")[:MARKS]]
    to = np.full(len(keep), -1)
    to[chosen] = np.arange(len(chosen))
    used = (to[slot] >= 0) & (toxic[row] > 0)
    if not used.any():
        return y
    rows, r = np.unique(row[used], return_inverse=True)
    x = np.zeros((len(rows), len(chosen)))
    x[r, to[slot[used]]] = 1
    rng = np.random.default_rng(seed)
    w, h = rng.random((len(rows), CATEGORIES)) + 0.1, rng.random((CATEGORIES, len(chosen))) + 0.1
    for _ in range(STEPS):  # multiplicative updates for the squared error
        h *= (w.T @ x) / (w.T @ w @ h + 1e-9)
        w *= (x @ h.T) / (w @ (h @ h.T) + 1e-9)
    part = w * h.sum(axis=1)
    part /= np.maximum(part.sum(axis=1, keepdims=True), 1e-12)
    y[rows] = part >= PART
    return y[:, np.argsort(-y.sum(axis=0), kind="stable")]


def learn(row: np.ndarray, inputs: np.ndarray, earlier: np.ndarray, y: np.ndarray, steps: int = 150) -> Link:
    """Logistic regression on the words that tell the classes apart, by Adam's steps over all rows, with a ridge."""
    n, pos = len(y), float(y.sum())
    share = (pos + 0.5) / (n + 1)
    base = float(np.log(share / (1 - share)))
    none = Link(np.zeros(0, np.int64), np.zeros(0), np.zeros(earlier.shape[1]), base)
    if n == 0 or pos in (0, n):
        return none
    bucket, slot, _, keep = _telling(row, inputs, y)
    to = np.cumsum(keep) - 1
    used = keep[slot]
    r, s = row[used], to[slot[used]]
    k = int(keep.sum())
    theta, m, v = np.concatenate([np.zeros(k + earlier.shape[1]), [base]]), 0.0, 0.0
    for t in range(1, steps + 1):
        w, earlier_w = theta[:k], theta[k:-1]
        p = 1 / (1 + np.exp(-np.clip(theta[-1] + np.bincount(r, w[s], n) + earlier @ earlier_w, -30, 30)))
        e = (p - y) / n
        g = np.concatenate([np.bincount(s, e[r], k), earlier.T @ e, [e.sum()]]) + 1e-5 * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Link(bucket[keep], theta[:k], theta[k:-1], float(theta[-1]))


@dataclass
class Chain:
    names: list[str]
    links: list[Link]
    threshold: float

    def probabilities(self, words: list[np.ndarray]) -> np.ndarray:
        row = np.repeat(np.arange(len(words)), [len(w) for w in words])
        inputs = np.concatenate(words) if words else np.zeros(0, np.int64)
        p = np.zeros((len(words), len(self.links)))
        for k, link in enumerate(self.links):
            p[:, k] = link.probability(row, inputs, p[:, :k])
        return p


def fit(words: list[np.ndarray], y: np.ndarray, fold: np.ndarray) -> Chain:
    """y: a column for each link. The threshold is the lowest that gives the best F1 of out-of-fold probabilities."""
    n, links = y.shape
    row = np.repeat(np.arange(n), [len(w) for w in words])
    inputs = np.concatenate(words) if words else np.zeros(0, np.int64)
    apart = np.zeros((n, links))
    made = []
    for k in range(links):
        made.append(learn(row, inputs, apart[:, :k], y[:, k]))
        for f in range(FOLDS):
            own = fold == f
            if own.any():
                to = np.cumsum(~own) - 1
                rest = ~own[row]
                link = learn(to[row[rest]], inputs[rest], apart[~own, :k], y[~own, k])
                mine = own[row]
                apart[own, k] = link.probability((np.cumsum(own) - 1)[row[mine]], inputs[mine], apart[own, :k])
    best, threshold = -1.0, 0.5
    if n and 0 < y[:, -1].sum() < n:
        for t in np.arange(0.2, 0.81, 0.05):
            said, true = apart[:, -1] >= t, y[:, -1] > 0
            f1 = 2 * (said & true).sum() / max(said.sum() + true.sum(), 1)
            if f1 > best + 1e-12 or f1 > best - 1e-12 and abs(t - 0.5) < abs(threshold - 0.5):
                best, threshold = max(best, f1), float(t)
    return Chain([f"category_{k + 1}" for k in range(links - 1)] + [LAST], made, threshold)


def _inputs(docs: DataFrame) -> list[Column]:
    return [F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Chain:
    """Learns from at most ``sample`` labelled rows, as quality.sample_of() picks them. Folds are dealt by a hash of the text, so copies share one."""
    modest_batches(docs.sparkSession)
    rows = sample_of(docs.select(*_inputs(docs)), labels, "toxic", sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = kept(Words)
        for batch in batches:
            for a in range(0, batch.num_rows, TOGETHER):
                b = batch.slice(a, TOGETHER)
                yield pa.RecordBatch.from_arrays([b["doc_id"], b["y"], b["hash"], pa.array([x.astype(np.int32) for x in make(b["text"].to_pylist())], pa.list_(pa.int32()))], ["doc_id", "y", "hash", "words"])

    def make(got: pa.Table) -> Chain:
        size = np.asarray(got["words"].combine_chunks().value_lengths(), np.int64) if len(got) else np.zeros(0, np.int64)
        inputs, toxic = flat(got, "words", np.int64), np.asarray(got["y"], np.float64)
        words = np.split(inputs, np.cumsum(size)[:-1]) if len(size) else []
        y = np.column_stack([categories(np.repeat(np.arange(len(size)), size), inputs, toxic), toxic])
        return fit(words, y, np.asarray(got["hash"], np.int64) % FOLDS)

    return fitted(rows.select("doc_id", "text", "y", "hash").mapInArrow(run, "doc_id long, y int, hash long, words array<int>"), make)


def score(docs: DataFrame, chain: Chain, keep: bool = False) -> DataFrame:
    """Per document: doc_id, p_category_1 and so on, score (the chain's last probability) and toxic (1 from the threshold on).

    keep: return the documents' rows whole, as the struct own, and toxic. A null or empty text has the probabilities of no words. Rows keep their repeats;
    an empty table gives none; a very long text is read whole, in one task; only doc_id and text are read for a score, whatever other columns are called.
    """
    held = docs.sparkSession.sparkContext.broadcast(chain)  # the chosen words of a bounded sample
    names = [f"p_{x}" for x in chain.names[:-1]] + ["score"]
    modest_batches(docs.sparkSession)
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("own")) if keep else docs.select(*_inputs(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = kept(Words)
        for batch in batches:
            for a in range(0, batch.num_rows, TOGETHER):
                b = batch.slice(a, TOGETHER)
                texts = b["own"].flatten()[b.schema.field("own").type.names.index("text")] if keep else b["text"]
                p = held.value.probabilities(make([t or "" for t in texts.to_pylist()]))
                if keep:
                    yield pa.RecordBatch.from_arrays([b["own"], pa.array(p[:, -1], pa.float64())], ["own", "score"])
                else:
                    yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(p[:, k], pa.float64()) for k in range(len(names)))], ["doc_id", *names])

    given = [rows.schema["own"], T.StructField("score", T.DoubleType())] if keep else [T.StructField("doc_id", T.LongType()), *(T.StructField(x, T.DoubleType()) for x in names)]
    scored = rows.mapInArrow(run, T.StructType(given)).withColumn("toxic", (F.col("score") >= chain.threshold).cast("int"))
    return scored.select("own", "toxic") if keep else scored
