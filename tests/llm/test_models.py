"""The trained operators against plain Python, and what they reach on rows that they have not learned from."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstone.llm import quality, toxicity, urls
from quillstone.llm.queries import RULES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return {n: spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels", "pages")}


# op2 ---------------------------------------------------------------------------------------------------------------


def kind(c):
    return c.lower() if c.lower() in urls.LETTERS and c.isascii() else "?"


class PlainModel:
    """Witten-Bell by recursion over contexts of up to three characters."""

    def __init__(self, texts):
        self.n = [defaultdict(Counter) for _ in range(urls.ORDER)]
        for t in texts:
            s = "^^^" + "".join(kind(c) if len(c.encode()) == 1 else "?" * len(c.encode()) for c in t) + "^"
            for i in range(3, len(s)):
                for k in range(urls.ORDER):
                    self.n[k][s[i - k : i]][s[i]] += 1

    def p(self, context, c):
        if len(context) == 0:
            lower = 1 / urls.KINDS
        else:
            lower = self.p(context[1:], c)
        seen = self.n[len(context)].get(context)
        return lower if not seen else (seen[c] + len(seen) * lower) / (sum(seen.values()) + len(seen))

    def score(self, t):
        s = "^^^" + "".join(kind(c) if len(c.encode()) == 1 else "?" * len(c.encode()) for c in t) + "^"
        return [math.log(self.p(s[i - 3 : i], s[i])) for i in range(3, len(s))]


def test_url_scores_like_plain_python(spark, tables):
    pages = tables["pages"].limit(120).unionByName(spark.createDataFrame([(9001, "http://É.com/en/x?y", ""), (9002, None, ""), (9003, "no host", "")], tables["pages"].schema))
    got = urls.judge(pages, RULES).withColumn("apart", F.pmod(F.xxhash64("host", "path"), F.lit(5)) == 0).collect()
    known = [r for r in got if r.rule]
    yes, no = (PlainModel([r.host + r.path for r in known if not r.apart and r.verdict == v]) for v in ("allow", "block"))
    mean = {}
    for r in got:
        a, b = yes.score(r.host + r.path), no.score(r.host + r.path)
        mean[r.page_id] = sum(x - y for x, y in zip(a, b, strict=True)) / len(a)
        assert r.score == pytest.approx(mean[r.page_id], abs=1e-4)
    threshold = got[0].threshold
    assert all((r.verdict == "allow") == (r.score >= threshold) for r in got if not r.rule)
    apart = [(r.score, r.verdict == "allow") for r in known if r.apart]
    right = lambda t: (sum(s >= t for s, y in apart if y) / sum(y for _, y in apart) + sum(s < t for s, y in apart if not y) / sum(not y for _, y in apart)) / 2
    assert right(threshold) >= max(right(t) for t in np.arange(-5, 5, 0.05)) - 1e-9


def test_url_models_on_urls_that_they_have_not_counted(spark):
    r = urls.measured(spark.read.parquet("/root/testdata/sf0.1/pages.parquet"), RULES).first()
    assert r.urls > 100 and r.accepted_right >= 0.95 and r.rejected_right >= 0.95


def test_more_labelled_urls(spark):
    pages = spark.createDataFrame([(k, f"http://zz{k}.org/w/{k}") for k in range(20)], "page_id long, url string")
    own = spark.createDataFrame([(f"http://zz{k}.org/w/{k * 7}", False) for k in range(60)] + [(f"http://aa{k}.org/b/{k}", True) for k in range(60)] + [(None, True), ("http://x.org", None)], "url string, accepted boolean")
    assert {r.verdict for r in urls.judge(pages, RULES, own).collect()} == {"block"}
    assert urls.judge(pages.limit(0), RULES, own).count() == 0


def test_very_long_url(spark):
    assert urls.judge(spark.createDataFrame([(1, "http://a.org/" + "x/" * 200_000)], "page_id long, url string"), RULES).count() == 1


# op3 ---------------------------------------------------------------------------------------------------------------


def test_quality_scores_like_plain_pairs():
    """The linear-time score of a real text equals the sum over all pairs of its inputs."""
    rng = np.random.default_rng(2)
    inputs = quality.BUCKETS + quality.STATS * (len(quality.EDGES) + 2)
    m = quality.Machine(rng.normal(size=quality.STATS), np.full(quality.STATS, 2.0), 0.1, rng.normal(size=inputs) * 0.1, rng.normal(size=(inputs, quality.FACTORS)) * 0.1)
    texts = ["Some words, more of them | and 12 numbers!\nA line, of line", "", "ÜBER alles ## ***"]
    features = quality.Featuriser()(texts, [None, 0, 17])
    i, v, start = m.inputs(*features)
    ends = [*start[1:].tolist(), len(i)]
    for k, t in enumerate(texts):
        a, b = int(start[k]), ends[k]
        words = Counter(t.split())  # no two of a text are alike but for case
        own = dict(zip(i[a + 2 * quality.STATS : b].tolist(), v[a + 2 * quality.STATS : b].tolist(), strict=True))
        norm = math.sqrt(sum(math.log1p(n) ** 2 for n in words.values())) or 1
        assert len({zlib.crc32(w.lower().encode()) % quality.BUCKETS for w in words}) == len(own)
        assert all(own[zlib.crc32(w.lower().encode()) % quality.BUCKETS] == pytest.approx(math.log1p(n) / norm) for w, n in words.items())
        z = m.bias + sum(m.weight[i[x]] * v[x] for x in range(a, b)) + sum(m.factor[i[x]] @ m.factor[i[y]] * v[x] * v[y] for x in range(a, b) for y in range(a, x))
        assert m.score(*features)[k] == pytest.approx(1 / (1 + math.exp(-z)))


def test_quality_on_held_out_rows(tables):
    got = quality.score(tables["documents"], quality.train(tables["documents"], tables["labels"])).join(tables["labels"], "doc_id").filter("held_out").collect()
    y, s = np.array([r.quality for r in got]), np.array([r.score for r in got])
    auc = (s[y == 1][:, None] > s[y == 0][None, :]).mean()
    assert len(got) > 100 and auc >= 0.97 and ((s >= 0.5) == y).mean() >= 0.95


# op4 ---------------------------------------------------------------------------------------------------------------


def test_chain_like_plain_python():
    """Each link is a logistic model of its words and of the earlier links' probabilities."""
    rng = np.random.default_rng(6)
    words = [np.unique(rng.integers(0, 200, rng.integers(3, 12))) for _ in range(3000)]
    toxic = np.array([float((w < 8).any()) for w in words])
    row, inputs = np.repeat(np.arange(len(words)), [len(w) for w in words]), np.concatenate(words)
    own = toxicity.categories(row, inputs, toxic)
    assert own.shape == (3000, toxicity.CATEGORIES) and not own[toxic == 0].any() and own.sum(axis=1)[toxic == 1].min() >= 0 and (np.diff(own.sum(axis=0)) <= 0).all()
    chain = toxicity.fit(words, np.column_stack([own, toxic]), np.arange(3000) % toxicity.FOLDS)
    p = chain.probabilities(words)
    for k in range(0, 3000, 290):
        before = []
        for link in chain.links:
            z = link.bias + sum(w for b, w in zip(link.bucket, link.weight, strict=True) if b in set(words[k].tolist())) + sum(a * b for a, b in zip(before, link.chain, strict=True))
            before.append(1 / (1 + math.exp(-max(-30, min(30, z)))))
        assert p[k].tolist() == pytest.approx(before)
    assert ((p[:, -1] >= chain.threshold) == (toxic > 0)).mean() >= 0.95


def test_toxicity_on_rows_not_learned_from(spark, tables):
    """Every third labelled row is kept from the training."""
    tables = {n: spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in tables}
    labels = tables["labels"].withColumn("apart", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1)
    chain = toxicity.train(tables["documents"], labels.filter("not apart"))
    got = toxicity.score(tables["documents"], chain).withColumnRenamed("toxic", "said").join(labels.filter("apart"), "doc_id").collect()
    assert np.mean([r.said == r.toxic for r in got]) >= 0.95 and len(got) > 100
    assert np.mean([r.said for r in got if r.toxic]) >= 0.8


def test_repeated_labelled_rows_count_once(spark):
    """A labelled doc_id that stands on many rows gives one row to learn from, whichever task reads it."""
    docs = spark.createDataFrame([(1, f"text {k % 3}") for k in range(300)] + [(2, "another"), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, 0, 0), (None, 1, 1), (2, 7, None)], "doc_id long, quality int, toxic int")
    rows = quality.sample_of(docs.repartition(7), labels, "toxic", 10).orderBy("doc_id").collect()
    assert [(r.doc_id, r.y) for r in rows] == [(1, 1), (2, 0)] and len({r.hash for r in rows}) == 2
    assert rows[0].text == quality.sample_of(docs, labels, "toxic", 10).orderBy("doc_id").first().text
    model = quality.fitted(spark.createDataFrame([(3, 5), (1, 7)], "doc_id long, y int"), lambda t: t["doc_id"].to_pylist())
    assert model == [1, 3] and quality.fitted(spark.createDataFrame([], "doc_id long, y int"), lambda t: t.num_rows) == 0
    assert isinstance(pa.array([1]), pa.Array)
