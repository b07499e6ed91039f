"""Exact neighbours without a row for each pair."""

import math
import random

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillstone.functions import vectors
from quillstone.operators import retrieval as R


def _by_pairs(queries, candidates, k, key):
    """The same by a row for each pair, in Spark's own expressions."""
    q, c = queries.withColumn("qn", vectors.norm(F.col("embedding"))).withColumnRenamed("embedding", "q"), candidates.withColumn("cn", vectors.norm(F.col("embedding"))).withColumnRenamed("embedding", "c")
    pairs = q.join(c, "label")
    pairs = pairs.filter(F.col("query_id") != F.col(key)) if key == "vec_id" else pairs
    both = F.col("qn") * F.col("cn")
    scored = pairs.select("query_id", key, F.round(F.when(both > 0, vectors.dot(F.col("q"), F.col("c")) / both).otherwise(0.0), 6).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)


def _rows(df):
    return sorted(((r[0], r.rank, r[1], repr(r.score)) for r in df.collect()))


def _scored(spark):
    """Rows that the last query's Python steps handed on."""
    store = spark._jsparkSession.sharedState().statusStore()
    last = store.executionsList().last().executionId()
    values, found = store.executionMetrics(last), []
    nodes = store.planGraph(last).allNodes().iterator()
    while nodes.hasNext():
        node = nodes.next()
        if node.name() == "MapInArrow":
            metrics = node.metrics().iterator()
            while metrics.hasNext():
                m = metrics.next()
                if m.name() == "number of output rows":
                    found.append(int(values.apply(m.accumulatorId()).replace(",", "")))
    return sum(found)


def test_no_row_for_each_pair(spark):
    """F1: a label's 400 queries and 4,000 vectors are 1.6 million pairs; they were rows that Spark sorted, and beyond memory wrote to disk."""
    x = np.random.default_rng(3).normal(size=(4000, 16)).astype(np.float32)
    e = spark.createDataFrame([(k, 0, v) for k, v in enumerate(x.tolist())], "vec_id long, label int, embedding array<float>")
    got = R.nearest(e.filter("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id"), e, ["label"], 5, "vec_id").collect()
    parts = 2 * spark.sparkContext.defaultParallelism + 1
    assert 2000 <= _scored(spark) <= 2000 * parts
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    s = unit[::10] @ unit.T
    s[np.arange(400), np.arange(0, 4000, 10)] = -2
    want = np.argsort(-s, axis=1)[:, :5]
    assert len(got) == 2000 and all(r.vec_id == want[r.query_id // 10, r.rank - 1] and abs(r.score - s[r.query_id // 10, r.vec_id]) < 6e-7 for r in got)


def test_ties_copies_and_divided_scopes(spark, monkeypatch):
    """F1: equal rounded scores go to the smaller id wherever the rows are; scopes of any size, whose queries or candidates are divided or not, answer alike."""
    rng = random.Random(4)
    few = [[rng.choice((-1.0, 0.0, 1.0, 0.3)) for _ in range(6)] for _ in range(40)]
    rows = [(k, None if k % 97 == 0 else 0 if k % 5 else 1 + k % 50, rng.choice(few)) for k in range(1500)]
    rows += [(k, 0, few[0]) for k in range(10, 30)]  # ids that stand twice
    e = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(7)
    q = e.filter("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id")
    want = _rows(_by_pairs(q, e, 5, "vec_id"))
    assert _rows(R.nearest(q, e, ["label"], 5, "vec_id")) == want
    monkeypatch.setattr(R, "HELD", 40)
    assert _rows(R.nearest(q, e, ["label"], 5, "vec_id")) == want
    c = e.select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("label").cast("string").alias("label"), "embedding").filter("vec_id >= 30")
    q = q.withColumn("label", F.col("label").cast("string")).dropDuplicates(["query_id"])
    assert _rows(R.nearest(q, c, ["label"], 24, "chunk_id")) == _rows(_by_pairs(q, c, 24, "chunk_id"))
    assert R.nearest(q.limit(0), c, ["label"], 5, "chunk_id").count() == R.nearest(q, c.limit(0), ["label"], 5, "chunk_id").count() == 0


def test_odd_vectors(spark):
    """vectors that are null, empty, zero, of other widths, not finite or beyond the range of doubles' squares rank as their pairs' products do."""
    nan, inf = math.nan, math.inf
    odd = [None, [], [0.0] * 4, [None] * 4, [1.0, None, 2.0, 3.0], [nan, 0.0, 1.0, 2.0], [inf, 1.0, 1.0, 1.0], [-inf, inf, 0.0, 0.0], [1.0, 2.0], [0.0, 0.0], [nan, 1.0], [1e200, 1.0, 1.0, 1.0], [1e-200, 0.0, 0.0, 0.0], [1e-120, 1e-120, 0.0, 0.0]]
    rng = random.Random(5)
    rows = [(k, k % 2, odd[k // 2 % len(odd)] if k < 90 else [rng.uniform(-1, 1) for _ in range(4)]) for k in range(180)]
    for kind, keep in (("double", rows), ("float", [r for r in rows if not r[2] or None in r[2] or max(abs(x) for x in r[2]) != 1e200])):
        e = spark.createDataFrame(keep, f"vec_id long, label int, embedding array<{kind}>")
        q = e.filter("vec_id % 3 = 0").withColumnRenamed("vec_id", "query_id")
        assert _rows(R.nearest(q, e, ["label"], 99, "vec_id")) == _rows(_by_pairs(q, e, 99, "vec_id"))
