"""Periodic runs against plain Python."""

import hashlib
import random
import zlib

import numpy as np

from quillstone.llm import periods, queries


def brute(w):
    """All maximal runs, every period tried from left to right."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            smaller = any(all(w[k] == w[k + d] for k in range(i, i + length - d)) for d in range(1, q))
            if length >= max(6, 4 * q) and not smaller:
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, found):
    gone = {k for i, length, q in found for k in range(i + q, i + length)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def texts(rng, n):
    for _ in range(n):
        w = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.choice([0, 1, 5, 6, 8, 20, 60]))]
        if rng.random() < 0.6:
            p = [rng.randrange(3) for _ in range(rng.randrange(1, 9))]
            w = w[: rng.randrange(len(w) + 1)] + p * rng.choice([3, 4, 5, 9]) + p[: rng.randrange(len(p))] + w
        if rng.random() < 0.2:
            w = [*w, *w, 7, *w * 4]
        yield w


def test_refinement():
    rng = random.Random(5)
    for _ in range(400):
        some = list(texts(rng, rng.choice([1, 3, 8])))
        got = periods.runs(np.array([x for w in some for x in w], np.int64), np.array([len(w) for w in some]))
        assert [tuple(map(int, g)) for g in got] == [(k, *r) for k, w in enumerate(some) for r in brute(w)]


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(periods, "TOGETHER", 300)
    rng = random.Random(6)
    rows = [(k, rng.choice([" ", "\n", "\t \x0b"]).join(f"é{x}" for x in w)) for k, w in enumerate(texts(rng, 150))]
    rows += [(7, rows[7][1]), (7, "other words"), (None, "a b " * 9), (None, None), (900, None), (901, ""), (902, " \n\x0c "), (903, "x\xa0y " * 7), (904, "w " * 30_000), (905, " ".join(f"w{k % 4000}" for k in range(21_000)))]
    df = spark.createDataFrame([(*r, "extra", 1) for r in rows], "doc_id long, text string, runs string, period int").repartition(5)
    got = sorted(((r.doc_id, r.n_words, tuple(tuple(x) for x in r.runs), r.collapsed) for r in periods.find(df).collect()), key=str)
    want = []
    for k, t in rows:
        w = [x.decode() for x in (t or "").encode().split()]
        found = brute(w) if len(w) < 1000 else [(0, len(w), 1 if k == 904 else 4000)]
        want.append((k, len(w), tuple(found), collapsed(w, found)))
    assert got == sorted(want, key=str)
    assert periods.find(df.limit(0)).collect() == []


def test_query(spark, tmp_path):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choices("a b c d e f".split(), k=rng.choice([0, 3, 40, 90])))) for k in range(250)] + [(None, "x y " * 20)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    planted = 0
    want = {}
    for k, t in rows:
        w = t.split()
        h = zlib.crc32(str(k).encode())
        g, n = h // 10, len(w)
        if k is not None and h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            planted += 1
        found = brute(w)
        best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        lines = "".join(f"{i},{m},{q}\n" for i, m, q in found)
        want[k] = (len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(w, found).encode()).hexdigest())
    got = {r.doc_id: tuple(r)[1:] for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()}
    assert planted > 10 and got == want
