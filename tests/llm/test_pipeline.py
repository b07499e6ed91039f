"""The pipeline against plain Python that applies the stages' own models and brute-force rules to all rows."""

import hashlib
import re

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from quillstone.llm import bpe, decontam, quality, toxicity


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = np.random.default_rng(11)
    words = [f"wort{k}" for k in range(400)]
    item = " ".join(f"bench{k}" for k in range(30)) + "."
    docs, labels = [], []
    for i in range(400):
        text = [str(x) for x in rng.choice(words, rng.integers(20, 60))]
        if i % 7 == 0:
            text = [x + "%%%" for x in text]
        if i % 9 == 1:
            text[3:3] = ["idiot", "scum", "moron"]
        if i % 50 == 2:
            text[5:5] = item.split()
        docs.append([i, " ".join(text), "en", f"src{i % 3}", 0])
        labels.append((i, int(i % 7 != 0), int(i % 9 == 1)))
    for k in range(60):  # near copies: a word in forty changes
        i = 100 + k
        text = docs[i][1].split()
        if k % 2:
            text[0] = "changed"
        docs.append([1000 + k, " ".join(text), "en", "src0", 0])
    docs += [[5000, None, None, None, None], [5001, "", "en", "src1", 0], [None, "wort1 wort2 wort3", "en", "src1", 17], [5002, "wort5 " * 3000, "en", "src1", 18000]]
    docs = [(*r[:4], len(r[1]) if r[1] is not None and r[4] == 0 else r[4]) for r in docs]
    d = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, item), (1, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, docs, item


def near(a, b):
    def shingles(t):
        w = t.encode().lower().split()
        return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    x, y = shingles(a or ""), shingles(b or "")
    return bool(x and y) and 100 * len(x & y) >= 80 * len(x | y)


def test_pipeline(spark, tables):
    d, docs, item = tables
    read = lambda name: spark.read.parquet(f"{d}/{name}.parquet")
    of = {r[0]: r for r in docs}
    machine = quality.train(read("documents"), read("labels"))
    good = {r.doc_id for r in quality.score(read("documents"), machine).collect() if r.predicted == 1}
    assert all((i in good) == (i % 7 != 0) for i in range(400))
    left = spark.createDataFrame([r for r in docs if r[0] in good], "doc_id long, text string, lang string, source string, n_chars long")
    chain = toxicity.train(left, read("labels"))
    clean = {r.doc_id for r in toxicity.score(left, chain).collect() if r.toxic == 0}
    assert all((i in clean) == (i % 9 != 1) for i in range(400) if i in good)
    ids = sorted(i for i in clean if i is not None)
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if near(of[i][1], of[j][1]):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    single = {i for i in ids if top(i) == i} | ({None} & clean)
    kept = {i for i in single if item not in (of[i][1] or "")}
    assert len(kept) < len(single) < len(clean) < len(good) < len(docs)
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read()), special_tokens={})
    want = []
    for i in kept:
        t = theirs.encode_ordinary(of[i][1] or "")
        want.append((i, len(t), hashlib.sha256(np.array(t, "<u4").tobytes()).hexdigest(), hashlib.sha256((of[i][1] or "").encode()).hexdigest()))
    got = [tuple(r) for r in corpus_pipeline.run(spark, d).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert not re.search("collect", corpus_pipeline.run.__doc__) and decontam.WINDOW == 8


def test_stages_keep_columns_and_empty_tables(spark, tables):
    d, _, _ = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "decontamination", "encoding"]
    odd = docs.selectExpr("*", "1 AS predicted", "2 AS toxic", "3 AS score", "4 AS component_id", "5 AS own", "6 AS hash")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), d)
        assert out.count() == 0 and (name == "encoding" or out.columns == docs.columns)
        out = stage(spark, odd, d)
        assert out.count() > 0 and (name == "encoding" or out.columns == odd.columns)
