"""URL filters: host and path rules, and beside them a ratio of two character models.

Two variable-order Markov models, of accepted and of rejected URLs, give each character of host and path a probability from up to three
characters before it. Orders are interpolated by Witten-Bell smoothing: the more kinds of characters followed a context, the more its shorter
context counts. A URL is judged by the mean difference of log-likelihood for each character, against a threshold calibrated on labelled URLs
that neither model has seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The characters told apart; all others are one kind, and the edge of a URL is another.
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789./-_?=&%#:"
OTHER, EDGE = len(LETTERS), len(LETTERS) + 1
KINDS, ORDER = len(LETTERS) + 2, 4
#: Bins of scores for the calibration, to either side of zero, and their width.
BINS, WIDTH = 2000, 0.005


@dataclass(frozen=True)
class Rule:
    """``host/path`` to allow or block: fits the host and its subdomains where the URL's path starts with the rule's."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.split("/", 1)[0]

    @property
    def path(self) -> str:
        return "/" + self.text.split("/", 1)[1]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lowered; empty without one or for null."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    lowered = F.translate(F.regexp_extract(rest, r"\A[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.instr(url, "://") > 0, lowered).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def ruled(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds rule (the longest that fits, or null) and rule_verdict. Of equally long rules the first in the order of their text is taken."""
    hit = [(r, ((F.col("host") == r.host) | F.endswith(F.col("host"), F.lit(f".{r.host}"))) & F.startswith(F.col("path"), F.lit(r.path))) for r in sorted(rules, key=lambda r: (-len(r.text), r.text))]
    pick = lambda of: F.coalesce(*[F.when(c, F.lit(of(r))) for r, c in hit]) if hit else F.lit(None).cast("string")
    return df.withColumn("rule", pick(lambda r: r.text)).withColumn("rule_verdict", pick(lambda r: r.verdict))


_KIND = np.full(256, OTHER, np.int64)
for _k, _c in enumerate(LETTERS):
    _KIND[ord(_c)] = _k
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _KIND[_c] = _c - 65


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of each character with the three before it, text after text, and how many each text has (its length and an end)."""
    raw = [t.encode() for t in texts]
    size = np.array([len(r) + 1 for r in raw], np.int64)
    flat = np.full(int(size.sum()) + (ORDER - 1) * len(raw), EDGE, np.int64)
    start = np.cumsum(size + ORDER - 1) - (size + ORDER - 1)
    at = np.repeat(start + ORDER - 1, size - 1) + np.arange(int((size - 1).sum())) - np.repeat(np.cumsum(size - 1) - (size - 1), size - 1)
    flat[at] = _KIND[np.frombuffer(b"".join(raw), np.uint8)]
    code = np.zeros(max(len(flat) - ORDER + 1, 0), np.int64)
    for k in range(ORDER):
        code = code * KINDS + flat[k : len(flat) - ORDER + 1 + k]
    keep = np.repeat(start, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    return code[keep], size


def smoothed(counts: np.ndarray) -> np.ndarray:
    """log P(character | three before) for all contexts, from counts of shape (KINDS,) * ORDER."""
    p = np.full(KINDS, 1.0 / KINDS, counts.dtype)
    for order in range(ORDER):
        n = counts.sum(axis=tuple(range(ORDER - 1 - order))).reshape((KINDS,) * (order + 1))
        total, kinds = n.sum(axis=-1, keepdims=True), (n > 0).sum(axis=-1, keepdims=True).astype(counts.dtype)
        p = np.where(total > 0, (n + kinds * p) / np.maximum(total + kinds, 1e-12), p)
    return np.log(p, out=p)


def score_of(table: np.ndarray, texts: list[str]) -> np.ndarray:
    code, size = grams(texts)
    if not len(size):
        return np.zeros(0)
    return np.add.reduceat(table[code].astype(np.float64), np.cumsum(size) - size) / size


def _scored(df: DataFrame, table: np.ndarray) -> DataFrame:
    held = df.sparkSession.sparkContext.broadcast(table)  # KINDS ** ORDER floats, whatever the input
    names = [c for c in df.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [x + y for x, y in zip(b["host"].to_pylist(), b["path"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score_of(held.value, text), pa.float64())], [*names, "score"])

    return df.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in df.dtypes) + ", score double")


def learn(labelled: DataFrame) -> np.ndarray:
    """The table of log-likelihood differences (accepted less rejected) from all rows of (host, path, accepted)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yes = np.asarray(b["accepted"].to_pylist(), bool)
            code, size = grams([x + y for x, y in zip(b["host"].to_pylist(), b["path"].to_pylist(), strict=True)])
            both, n = np.unique(code * 2 + np.repeat(yes, size), return_counts=True)
            yield pa.RecordBatch.from_pydict({"code": both, "n": n.astype(np.int64)})

    got = labelled.mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()  # 2 * KINDS ** ORDER rows at most
    code, n = np.asarray(got["code"], np.int64), np.asarray(got["n"], np.float64)

    def model(accepted: int) -> np.ndarray:
        counts = np.zeros(KINDS**ORDER)
        own = code % 2 == accepted
        counts[code[own] // 2] = n[own]
        return smoothed(counts.reshape((KINDS,) * ORDER)).ravel().astype(np.float32)

    return model(1) - model(0)


def calibrate(labelled: DataFrame, table: np.ndarray) -> float:
    """The threshold with the best mean of both classes' hit rates, the nearest to zero of equals; zero unless both classes are there."""
    at = F.least(F.greatest(F.floor(F.col("score") / WIDTH), F.lit(-BINS)), F.lit(BINS - 1)).cast("int")
    got = _scored(labelled, table).groupBy(at.alias("at")).agg(F.sum(F.col("accepted").cast("long")).alias("yes"), F.sum((~F.col("accepted")).cast("long")).alias("no")).toArrow()
    yes, no = np.zeros(2 * BINS), np.zeros(2 * BINS)
    where = np.asarray(got["at"], np.int64) + BINS
    yes[where], no[where] = np.asarray(got["yes"], np.float64), np.asarray(got["no"], np.float64)
    if not yes.sum() or not no.sum():
        return 0.0
    rate = (yes[::-1].cumsum()[::-1] / yes.sum() + np.append(0, no.cumsum()[:-1]) / no.sum()) / 2
    edge = (np.arange(2 * BINS) - BINS) * WIDTH
    best = np.flatnonzero(rate >= rate.max() - 1e-12)
    return float(edge[best[np.argmin(np.abs(edge[best]))]])


def judge(pages: DataFrame, rules: list[Rule], labelled: DataFrame | None = None) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict (the rule's, else the models'), score and threshold.

    URLs that a rule decides are the models' labelled rows, and those of ``labelled`` (url string, accepted boolean; nulls are left out) beside them: four
    fifths (by a hash of host and path) are counted, all of them whatever their number, and the rest set the threshold. A null URL or one without
    ``://`` has empty host and path and is judged by the models alone. Rows keep their repeats; other columns are not read. An empty table gives no rows.
    """
    rows = ruled(_placed(pages, F.col("page_id").cast("long").alias("page_id")), rules)
    known = _labelled(rows, labelled)
    table = learn(known.filter("not apart").drop("apart"))
    threshold = calibrate(known.filter("apart").drop("apart"), table)
    verdict = F.coalesce("rule_verdict", F.when(F.col("score") >= threshold, "allow").otherwise("block"))
    return _scored(rows, table).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score", F.lit(threshold).alias("threshold"))


def _placed(df: DataFrame, *also: Column) -> DataFrame:
    url = F.col("url").cast("string")
    return df.select(*also, host_of(url).alias("host"), path_of(url).alias("path")).na.fill("", ["host", "path"])


def _labelled(rows: DataFrame, labelled: DataFrame | None) -> DataFrame:
    known = rows.filter("rule_verdict is not null").select("host", "path", (F.col("rule_verdict") == "allow").alias("accepted"))
    if labelled is not None:
        known = known.unionByName(_placed(labelled.filter("url is not null and accepted is not null"), F.col("accepted")))
    return known.withColumn("apart", F.pmod(F.xxhash64("host", "path"), F.lit(5)) == 0)


def measured(pages: DataFrame, rules: list[Rule], labelled: DataFrame | None = None) -> DataFrame:
    """One row on labelled URLs that neither model counted: urls, and the shares of accepted and of rejected ones that the models judge so. They set the threshold."""
    known = _labelled(ruled(_placed(pages), rules), labelled)
    table = learn(known.filter("not apart").drop("apart"))
    apart = known.filter("apart").drop("apart")
    said = F.col("score") >= calibrate(apart, table)
    return _scored(apart, table).agg(F.count("*").alias("urls"), F.avg(F.when(F.col("accepted"), said.cast("int"))).alias("accepted_right"), F.avg(F.when(~F.col("accepted"), (~said).cast("int"))).alias("rejected_right"))
