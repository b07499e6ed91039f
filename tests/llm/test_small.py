"""Search, sharding, URL filter, classifiers, extraction and decontamination on small tables, against plain Python."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm import decontam, extract, quality, shards, topk, toxicity, urls


def brute_top(rows, k, scale=256):
    fine = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for q, v in fine:
        if q % 5 == 0:
            best = sorted(((-dot(v, w), i) for i, w in fine if i != q))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("seeds", [4096, 3])
def test_top_k(spark, monkeypatch, seeds):
    monkeypatch.setattr(topk, "SEEDS", seeds)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 40)]) for i in range(400)]
    rows += [(1000, rows[7][1]), (1001, rows[7][1]), (1003, None), (None, rows[1][1]), (1006, [float("nan")] * 40), (1007, [float("inf"), *[0.0] * 39]), (1008, [None, *[0.1] * 39]), (1010, []), (1011, [0.5] * 7)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int").repartition(4)
    assert sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 5 == 0).collect()) == brute_top(rows, 5)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 5 == 0).collect() == []


def test_top_k_in_rounds_and_with_large_components(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERIES", 10)
    rows = [(i, [float(i) * 1e7, -3.5, float(i % 7)]) for i in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 5 == 0, k=3, scale=1).collect()) == brute_top(rows, 3, 1)


def test_top_k_keeps_vectors_out_of_the_driver(spark, monkeypatch):
    """Blocks of a few rows give the same pairs, and nothing is gathered or broadcast."""
    monkeypatch.setattr(topk, "BLOCK", 7)
    monkeypatch.setattr(topk, "QUERIES", 10)

    def refused(*_, **__):
        raise AssertionError("vectors pass the driver")

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", refused)
    monkeypatch.setattr(type(spark.range(1)), "toArrow", refused)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 20)]) for i in range(150)] + [(150, [0.4] * 9), (155, None), (160, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 5 == 0).collect()) == brute_top(rows, 5)


def test_permutation():
    for n in (1, 2, 3, 5, 24, 97, 1000):
        assert sorted(shards.permute_int(x, n, 5) for x in range(n)) == list(range(n))


def test_shards(spark):
    rows = [(i, f"text {i % 9}" * (i % 4)) for i in range(500)] + [(None, None), (None, None), (3, "é"), (3, "é"), (7, "")]
    got = shards.shard(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, slot int").repartition(7)).collect()
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=str) == sorted(((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows), key=str)
    of = {s: sorted(r.slot for r in got if r.shard == s) for s in range(24)}
    assert all(v == list(range(len(v))) for v in of.values()) and max(map(len, of.values())) - min(map(len, of.values())) <= 1
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode())))
    at = {(r.doc_id, r.text_crc32): r.slot * 24 + r.shard for r in got if r.doc_id is not None and r.doc_id > 7}
    for k, (i, t) in enumerate(order):
        if i is not None and i > 7:
            assert at[i, zlib.crc32((t or "").encode())] == shards.permute_int(k, len(rows), 20260101)
    assert shards.shard(spark.createDataFrame([], "doc_id long, text string")).collect() == []


RULES = [urls.Rule("com/en/", "block"), urls.Rule("example.com/en/7", "allow"), urls.Rule("net/de/", "allow")]


def test_rules(spark):
    cases = {
        "http://A.Example.COM/en/71?x": ("a.example.com", "/en/71", "example.com/en/7", "allow"), "https://x.com/en/7": ("x.com", "/en/7", "com/en/", "block"), "https://notexample.com/en/7": ("notexample.com", "/en/7", "com/en/", "block"),
        "http://net/de/": ("net", "/de/", "net/de/", "allow"), "http://x.net/de": ("x.net", "/de", None, None), "http://planet/de/1": ("planet", "/de/1", None, None), "http://x.com?u=/en/": ("x.com", "", None, None), "ftp://Ü.net#/de/": ("Ü.net", "", None, None),
        "no scheme.com/en/": ("", "", None, None), None: ("", "", None, None), "": ("", "", None, None), "a://b://c/d": ("b:", "//c/d", None, None),
    }
    df = spark.createDataFrame([(k, u, "x") for k, u in enumerate(cases)] * 2, "page_id long, url string, verdict string")
    got = urls.judge(df, RULES).collect()
    assert len(got) == 2 * len(cases)
    for r in got:
        host, path, rule, verdict = list(cases.values())[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule) and (r.verdict == verdict if verdict else r.verdict in ("allow", "block"))
    assert urls.judge(df.limit(0), RULES).collect() == []


def test_character_models(spark):
    good, bad = [f"http://site{k % 7}.net/de/{k}" for k in range(200)], [f"http://zzqx{k % 5}.com/en/buy/{k}" for k in range(200)]
    rest = [f"http://site{k}.org/de/{k}" for k in range(20)] + [f"http://zzqx{k}.org/buy/{k}" for k in range(20)]
    got = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(list(enumerate(good + bad + rest)), "page_id long, url string"), RULES).collect()}
    assert [got[400 + k] for k in range(40)] == ["allow"] * 20 + ["block"] * 20


def test_smoothed_probabilities_sum_to_one():
    counts = np.random.default_rng(1).poisson(0.02, (urls.KINDS,) * urls.ORDER).astype(float)
    assert np.allclose(np.exp(urls.smoothed(counts)).sum(axis=-1), 1)


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for i in range(900):
        bad, toxic = i % 4 == 0, i % 6 == 1
        text = [str(x) for x in rng.choice(words, 60)]
        if bad:
            text = [x + "###" for x in text]
        if toxic:
            text[5], text[20] = str(rng.choice(["idiot", "moron", "stupid"])), str(rng.choice(["trash", "scum"]))
        rows.append((i, " ".join(text), len(text), 9.5))
        labels.append((i, int(not bad), int(toxic)))
    rows += [(None, None, None, 1.0), (5000, "", 0, 1.0), (5001, "x" * 200_000, 200_000, 1.0), (5001, "x" * 200_000, 200_000, 1.0)]
    labels += [(None, 1, 1), (3, None, None), (6000, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_chars long, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality(spark, labelled):
    docs, labels = labelled
    got = quality.score(docs, quality.train(docs, labels)).collect()
    assert len(got) == 904 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    apart = [r for r in got if r.held_out and r.doc_id < 900]
    assert np.mean([r.predicted == (r.doc_id % 4 != 0) for r in apart]) > 0.97
    hidden = labels.withColumn("quality", F.when(quality.is_held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality.score(docs, quality.train(docs, hidden)).collect()}
    assert all(again[r.doc_id] == r.score for r in got)  # held-out labels change nothing
    assert quality.score(docs, quality.train(docs, labels), keep=True).columns == ["own", "predicted"]
    assert {r.score for r in quality.score(docs, quality.train(docs, labels.limit(0))).collect()} == {0.5}
    assert quality.score(docs.limit(0), quality.train(docs.limit(0), labels)).collect() == []


def test_pairs_by_sum_of_squares():
    rng = np.random.default_rng(0)
    m = quality.Machine(np.zeros(1), np.ones(1), 0.3, rng.normal(size=9), rng.normal(size=(9, 4)))
    i, v = np.array([1, 4, 7, 2, 5]), rng.normal(size=5)
    pairs = sum(m.factor[i[a]] @ m.factor[i[b]] * v[a] * v[b] for a in range(3) for b in range(a))
    assert np.isclose(m.logits(i, v, np.array([0, 3]))[0], 0.3 + m.weight[i[:3]] @ v[:3] + pairs)


def test_toxicity(spark, labelled):
    docs, labels = labelled
    got = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(got) == 904
    assert all(bool(r.toxic) == (r.doc_id is not None and r.doc_id < 900 and r.doc_id % 6 == 1) for r in got)
    most = [max(r.p_category_1, r.p_category_2, r.p_category_3, r.p_category_4) for r in got if r.toxic]
    assert min(most) > 0.3 and all(0 <= r.score <= 1 for r in got)
    assert {r.toxic for r in toxicity.score(docs, toxicity.train(docs, labels.limit(0))).collect()} <= {0, 1}
    assert toxicity.score(docs.limit(0), toxicity.train(docs, labels)).collect() == []


PAGE = """<!DOCTYPE html><html lang="en"><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body class="has-sidebar"><header>Site <h1>name</h1></header>
<nav><ul><li><a href="/a">a</a></li></ul></nav><!-- ad <p>no</p> --><div class="ad">Buy</div><div id="cookie-notice">We use cookies</div><aside>Side</aside>
<article><header><h1>A &amp; B</h1><p>by me</p></header><p><b>One<br>two &#8211; three<p>Four&nbsp;
 five <script>x("<p>")</script>six</p><form><input><p>f</p></form><div class="share-buttons"><div>s</div></div><ul><li>l1<li>l2</ul>tail</article>
<section id="comments"><article class="comment"><p>c</p></article></section><footer>&copy; x</footer></body></html>"""


def test_markup():
    kept = lambda page: [(t, m == extract.INSIDE) for t, m in extract.lines(page) if m != extract.OUTSIDE]
    assert kept(PAGE) == [(t, True) for t in ("A & B", "One two – three", "Four five six", "l1", "l2", "tail")]
    assert kept("") == [] and kept("plain  text") == [("plain text", False)]
    assert kept("<p>a<!-- never closed <p>b") == [("a", False)]
    assert kept("<p>1 < 2 & 3 > 2</p>") == [("1 < 2 & 3 > 2", False)]
    assert kept("<div class='ad'>x<div>y</div></div>z<p class=ad>p<p>q") == [("z", False), ("q", False)]


def test_longest_common_subsequence():
    def longest(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rng = np.random.default_rng(4)
    for _ in range(300):
        a, b = (["abcd"[k] for k in rng.integers(0, 4, rng.integers(0, 12))] for _ in range(2))
        got = [a[k] for k, _ in extract.shared(a, b)]
        assert len(got) == longest(a, b) and longest(got, b) == len(got)


def test_differencing(spark, monkeypatch):
    monkeypatch.setattr(extract, "UNIT", 3)
    frame = "<div>Site name</div><div>Welcome to the site</div><p>{}</p><p>{}</p><div>All about us</div>"
    rows = [(k, f"http://h.org/a/{k:03d}?q", frame.format(f"Story number {k} is about things " * 3, f"and it ends {k}")) for k in range(20)]
    rows += [(100, None, frame.format("x y", "z")), (101, "http://alone.org/", frame.format("x y", "z")), (102, "http://null.org/", None), (103, "http://h.org/a/copy", PAGE), (103, "http://h.org/a/copy", PAGE)]
    got = {}
    for r in extract.extract(spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string").repartition(4)).collect():
        assert r.n_chars == len(r.text)
        got.setdefault(r.page_id, []).append(r.text)
    for k in range(20):
        assert got[k] == [f"{('Story number %d is about things ' % k * 3).strip()}\n\nand it ends {k}"]
    assert got[100] == got[101] == ["Site name\n\nWelcome to the site\n\nx y\n\nz\n\nAll about us"] and got[102] == [""] and len(got[103]) == 2
    assert extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_contamination(spark):
    item = "If Tom has 12 apples and gives Anna 5 apples, then how many apples does Tom have left at the end of the day"
    short = "Name the capital of France please"
    docs = [
        (1, f"Some words before. {item}. And some after it."), (2, item.replace("Tom", "Karl").replace("12", "99").upper().lower()), (3, item.replace("Tom", "Karl").replace("Anna", "Mia").replace("12", "31")),
        (4, "If Tom has 12 apples and gives Anna 5 apples, then how many apples does Karl have left at the end of the day".replace("Tom", "Ben", 1)), (5, "nothing of the sort is here at all, only other words that go on and on"), (6, None), (7, ""),
        (8, "x " * 50 + short + " y" * 50), (None, item), (1, f"Some words before. {item}. And some after it."), (9, "the end of the day"), (10, "5 kg 6 kg 7 kg 8 kg 9 kg 10 kg"),
    ]
    bench = spark.createDataFrame([(0, item, 1), (1, short, 1), (2, None, 1), (3, "", 1), (None, item, 1), (4, "1 kg 2 kg 3 kg 4 kg 5 kg", 1), (0, item, 1)], "item_id long, text string, windows int")
    got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(spark.createDataFrame([(*d, "z") for d in docs], "doc_id long, text string, item_id string"), bench).collect()}
    assert set(got) == {(1, 0), (2, 0), (3, 0), (8, 1)} and got[1, 0].exact and not got[3, 0].exact  # 2: other names and numbers, all in lower case
    left = decontam.clean(spark.createDataFrame(docs, "doc_id long, text string"), bench)
    assert sorted((r.doc_id for r in left.collect()), key=str) == sorted([4, 5, 6, 7, 9, 10], key=str)  # the item itself goes without a doc_id too
    assert decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string").limit(0), bench).collect() == []
