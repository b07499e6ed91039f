"""Ingest jobs, numbered rows and plans on small tables."""

import io
import random
import re
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from quillstone.operators import jobs, retrieval


def test_numbered_like_sorting(spark):
    rng = random.Random(3)
    rows = [(rng.choice("abc"), rng.choice([rng.randint(-50, 50), rng.randint(-(10**12), 10**12)]), k) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, key long, k long").repartition(7)
    got = {(r.g, r.key, r.k): r.place for r in retrieval.numbered(df, "g", "key", "place", ("k",), each=40).collect()}
    for g in "abc":
        assert [got[r] for r in sorted(x for x in rows if x[0] == g)] == list(range(sum(x[0] == g for x in rows)))
    assert retrieval.numbered(df.limit(0), "g", "key", "place").count() == 0


def test_tick(spark):
    units = [(1, 1, "parsing", 50, 0, 0), (1, 2, "ocr", 60, 0, 0), (1, 3, "embedding", 10, 0, 0), (2, 1, "parsing", 5, 0, 0), (3, 1, "ocr", 5, 4, 0), (4, 1, "ocr", 5, 0, 99)]
    got = {r.job: (r.done, r.stage, r.error) for r in jobs.ticked(spark.createDataFrame(units, "job int, unit int, stage string, ms long, attempts int, spent_ms long"), 100, 4, 50).collect()}
    assert got == {1: (2, "embedding", None), 2: (1, "ready", None), 3: (0, "error", "INGEST_INTERRUPTED"), 4: (0, "error", "PDF_UNREADABLE")}


def plainly(kinds):
    out, row, stops, over = [], 0, 0, False
    for k in kinds:
        if over:
            out.append("skipped")
            continue
        row = 0 if k == "read" else row + 1
        stops += k == "stop"
        out.append("read" if k == "read" else "failed")
        over = row >= jobs.FAILURES or stops >= jobs.STOPS
    return out


def test_read_outcomes(spark):
    rng = random.Random(1)
    docs = {d: rng.choices(["read", "failed", "stop"], [5, 5, 1 + d % 2], k=rng.randint(1, 30)) for d in range(40)}
    df = spark.createDataFrame([(d, p, k) for d, ks in docs.items() for p, k in enumerate(ks)], "doc int, page int, kind string")
    got = {}
    for r in jobs.read_outcomes(df).orderBy("doc", "page").collect():
        got.setdefault(r.doc, []).append(r.outcome)
    assert got == {d: plainly(ks) for d, ks in docs.items()}


def test_outline_and_settings(spark):
    said = '[{"title":" A  b ","page":1,"items":[{"title":"","page":2,"items":[{"title":"C","page":3,"items":[{"title":"D","page":4}]}]}]},{"title":"E"}]'
    got = spark.createDataFrame([(said,), (None,), ("broken",), ("[]",)], "c string").select(jobs.outline(F.col("c")).alias("o")).collect()
    assert [(e.title, e.page) for e in got[0].o] == [("A b", 1), ("C", 3)] and all(not r.o for r in got[1:])
    rows = [(1, "PORT", "80"), (1, "REVEAL", "true"), (2, "PORT", "70000"), (2, "RAG_TOP_K", "x"), (2, "OLD", "1"), (2, "COSINE_FLOOR", "0.5")]
    got = {r.deployment: r.errors for r in jobs.configured(spark.createDataFrame(rows, "deployment int, key string, value string")).collect()}
    assert got == {1: [], 2: ["OLD: unknown", "PORT: not 1 to 65535: 70000", "RAG_TOP_K: no int: x"]}


@pytest.mark.parametrize("name", ["rt_lexical", "rt_coverage", "topk_lex", "agg_idfsum", "prj_outline", "smp_even", "win_budget"])
def test_no_text_in_an_exchange(spark, name):
    from quillstone.plans import catalog

    out = io.StringIO()
    with redirect_stdout(out):
        catalog.queries()[name](spark, "/root/testdata/sf0.001").explain("formatted")
    moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", out.getvalue())
    assert moved and not any(re.search(r"\b(content|text)#", x) for x in moved)
