"""Folds over ranges against plain Python, with a hot group and outlying keys; cover density against a sweep; languages by trigrams."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from quillstone.operators import answers, languages, ordered
from quillstone.operators import retrieval as R


def test_folds(spark):
    rng = random.Random(3)
    rows = [("hot", k, rng.choice([None, "a", "b"]), rng.randint(0, 5)) for k in range(3000)] + [("hot", 2**60, "z", 1), ("hot", -(2**60), None, 2)]
    rows += [(rng.choice(["x", "y", None]), k * 7, rng.choice([None, "c"]), 1) for k in range(200)]
    order = sorted(rows, key=lambda r: (r[0] or "", r[1]))
    want, held = {}, {}
    for g, k, v, n in order:
        last, total, before = held.get(g, (None, 0, None))
        want[g, k] = (total + n, v if v is not None else last, before)
        held[g] = (v if v is not None else last, total + n, n)
    rng.shuffle(rows)
    key = ["g"], ["k"]
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else so few rows are one range
    try:
        df = ordered.ranged(spark.createDataFrame(rows, "g string, k long, v string, n int").repartition(6), *key)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert df.select("_part").distinct().count() > 1
    assert df.filter("g = 'hot'").groupBy("_part").count().agg(F.max("count")).first()[0] < 2500  # no range holds the hot group or the outliers' neighbours
    got = ordered.folded(df, *key, sums={"total": F.col("n")}, last={"section": F.col("v")}, former={"before": F.col("n")}).collect()
    assert {(r.g, r.k): (r.total, r.section, r.before) for r in got} == want and len(got) == len(rows)
    numbered = ordered.numbered(spark.createDataFrame(rows, "g string, k long, v string, n int"), "g", "k", "place").collect()
    count = Counter()
    places = {}
    for g, k, _, _ in order:
        places[g, k] = count[g]
        count[g] += 1
    assert {(r.g, r.k): r.place for r in numbered} == places
    assert ordered.numbered(spark.createDataFrame([], "g string, k long"), "g", "k", "place").collect() == []


def covers(positions):
    """Minimal covers of an any-of query, by a sweep over the merged position lists: (weight) of each, as an extent of e entries over n places weighs e / sum / (1 + noise)."""
    merged = sorted({p for ps in positions for p in ps[:255]})
    out, at = 0.0, 0
    while at < len(merged):
        end = next(k for k in range(at, len(merged)))  # the first entry satisfies the query
        begin = next(k for k in range(end, at - 1, -1))  # and so does it alone, read backwards
        size, noise = end - begin + 1, merged[end] - merged[begin] - (end - begin)
        out += size / (size / 0.1) / (1 + noise)
        at = begin + 1
    return out


def test_cover_density(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(12)]
    parts = [("d", k, " ".join(rng.choices(words, k=rng.randint(1, 40)))) for k in range(120)] + [("other", 500, "w1 w2 w3")]
    asked = [(i, "d", " ".join(rng.sample(words, 3))) for i in range(15)]
    got = {}
    for r in R.lexical(spark.createDataFrame(asked, "item_id long, doc string, question string"), spark.createDataFrame(parts, "doc string, chunk_id long, content string")).collect():
        got.setdefault(r.item_id, []).append((r.rank, r.chunk_id))
    texts = {k: t.split() for d, k, t in parts if d == "d"}
    for i, _, q in asked:
        df = {w: sum(w in t for t in texts.values()) for w in q.split()}
        idf = {w: math.log(1 + (len(texts) - n + 0.5) / (n + 0.5)) for w, n in df.items() if n and (n <= len(texts) / 2 or re.search("[0-9]", w))}
        ranked = sorted((-round(sum(x for w, x in idf.items() if w in t), 6), -round(covers([[p for p, y in enumerate(t) if y == w] for w in idf]), 6), k) for k, t in texts.items() if set(idf) & set(t))
        assert [k for _, k in sorted(got[i])] == [k for _, _, k in ranked[:24]]


def brute_told(text, profiles):
    words = re.sub(r"[\W\d_]+", " ", text.lower()).split()
    if sum(map(len, words)) < languages.LEAST:
        return "und"
    grams = Counter(f" {w} "[i : i + 3] for w in words for i in range(len(w)))
    top = [g for g, _ in sorted(grams.items(), key=lambda x: (-x[1], [ord(c) for c in x[0]]))[: languages.RANKS]]
    far = {}
    for lang, ranks in profiles.items():
        far[lang] = sum(abs(ranks[g] - i) if g in ranks else languages.RANKS for i, g in enumerate(top)) / len(top)
    (a, x), (b, y) = sorted((d, k) for k, d in far.items())[:2]
    return x if (b - a) / max(a, 1e-9) >= languages.MARGIN else "und"


def test_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    train = F.col("doc_id") % 3 != 1
    model = languages.train(docs, train)
    rows = {r.doc_id: r for r in docs.collect()}
    counts = {}
    for r in rows.values():
        if r.doc_id % 3 != 1:
            words = re.sub(r"[\W\d_]+", " ", (r.text or "").lower()).split()
            counts.setdefault(r.lang, Counter()).update(f" {w} "[i : i + 3] for w in words for i in range(len(w)))
    profiles = {k: {g: i for i, (g, _) in enumerate(sorted(c.items(), key=lambda x: (-x[1], [ord(y) for y in x[0]]))[: languages.RANKS])} for k, c in counts.items()}
    got = {r.doc_id: r for r in languages.detect(docs, model).collect()}
    assert {k: r.lang for k, r in got.items()} == {k: brute_told(r.text, profiles) for k, r in rows.items()}
    told = [(r.lang, rows[k].lang) for k, r in got.items() if k % 3 == 1 and len(rows[k].text) > 80]
    assert sum(a == b for a, b in told) >= 0.95 * len(told) and len(told) > 40
    few = spark.createDataFrame([(1, None), (2, ""), (3, "12 34"), (4, "ab")], "doc_id long, text string")
    assert {(r.lang, r.confidence) for r in languages.detect(few, model).collect()} == {("und", 0.0)}
    assert {r.lang for r in languages.detect(docs, languages.train(docs.limit(0), train)).collect()} == {"und"}


def test_page_references(spark):
    cases = {
        "pages 3 and 5 please": ([3, 5], "please"), "page no. 7": ([7], ""), "ماذا في صفحة ١٢": ([12], "ماذا في"), "الصفحة رقم ٥ إلى ٧": ([5, 6, 7], ""), "map 3": ([], "map 3"), "page 3-5 & page 9": ([3, 4, 5, 9], "&"), "pp. 3–4": ([3, 4], ""),
        "pages 1 to 40": ([1, 40], ""), "page 999": ([], ""), "Seiten 2 und 3": ([2, 3], ""), "page 12th": ([], "page 12th"), "p.8": ([8], ""), "ص ٤": ([4], ""), None: (None, None),
    }
    df = spark.createDataFrame([(k,) for k in cases], "said string")
    got = {r.said: (r.p, r.rest) for r in df.select("said", answers.page_references(F.col("said"), F.lit(50)).alias("p"), answers.without_pages(F.col("said")).alias("rest")).collect()}
    assert got == cases


def test_nearest_of_odd_vectors(spark):
    """pairs are scored a batch at a time, outside Catalyst's lambdas; null, short, zero and partly null vectors score as before."""
    rng = random.Random(9)
    vecs = [(k, k % 3, [rng.uniform(-1, 1) for _ in range(8)]) for k in range(60)]
    odd = [(60, 0, None), (61, 0, [0.0] * 8), (62, 0, [1.0, None] * 4), (63, 0, [1.0] * 3)]
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b))
    for rows in (vecs, vecs + odd):
        e = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
        near = R.nearest(e.filter("vec_id % 10 = 0 and vec_id < 60").withColumnRenamed("vec_id", "query_id"), e, ["label"], 99, "vec_id")
        assert "zip_with(cast(q" not in near._jdf.queryExecution().optimizedPlan().toString() and "MapInArrow" in near._jdf.queryExecution().optimizedPlan().toString()
        got = {(r.query_id, r.vec_id): r.score for r in near.collect()}
        want = {(q, c): cos(a, b) for q, g, a in vecs if q % 10 == 0 for c, h, b in vecs if g == h and c != q}
        assert {k for k in got if k[1] < 60} == set(want) and all(abs(got[k] - x) < 1e-5 for k, x in want.items())
        if rows is not vecs:
            assert (got[0, 60], got[0, 61], got[0, 62], got[0, 63]) == (0.0, 0.0, 0.0, None)
