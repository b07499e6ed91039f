"""Near-duplicate vectors and vector codes against plain Python."""

import hashlib
import math

import numpy as np
import pytest

from quillstone.llm import codes, collisions

VEC = "vec_id long, embedding array<double>, label int"


def fine(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute_links(rows):
    use = [k for k, (_, v, lab) in enumerate(rows) if lab is not None and fine(v) and any(v)]
    unit = {k: [x / max(map(abs, rows[k][1])) for x in rows[k][1]] for k in use}
    unit = {k: [x / math.sqrt(sum(y * y for y in v)) for x in v] for k, v in unit.items()}
    up, n = list(range(len(rows))), [0] * len(rows)

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in use:
        for b in use:
            if a < b and rows[a][2] == rows[b][2] and sum(x * y for x, y in zip(unit[a], unit[b])) >= 0.98:
                n[a] += 1
                n[b] += 1
                up[top(a)] = top(b)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    return [(i, n[k], least.get(top(k)), i is None or i == least.get(top(k))) for k, (i, _, _) in enumerate(rows)]


def cloud(seed, n):
    """Vectors, many of them near another one: at cosines around the threshold and above."""
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        v = rng.normal(size=32)
        if k > 20 and k % 2:
            base = np.array(rows[int(rng.integers(0, k))][1])
            other = rng.normal(size=32)
            other -= base * (base @ other) / (base @ base)
            c = rng.choice([0.97, 0.981, 0.985, 0.99, 0.999])
            v = c * base / np.linalg.norm(base) + math.sqrt(1 - c * c) * other / np.linalg.norm(other)
        rows.append((k, [float(x) for x in v * 10.0 ** rng.integers(-3, 4)], int(rng.integers(0, 3))))
    return rows


@pytest.mark.parametrize("block", [2048, 16])
def test_links(spark, monkeypatch, block):
    monkeypatch.setattr(collisions, "BLOCK", block)
    rows = cloud(3, 400)
    rows += [(1000 + k, rows[5][1], rows[5][2]) for k in range(40)] + [(2000, rows[5][1], None), (2001, None, 1), (2002, [0.0] * 32, 1), (2003, [float("nan")] * 32, 1), (2004, [None, *[1.0] * 31], 1), (2005, [float("inf"), *[1.0] * 31], 1)]
    rows += [(None, rows[9][1], rows[9][2]), (None, [9.0] * 32, 2), (7, rows[7][1], rows[7][2]), (2006, rows[11][1][:20], 0), (2007, [1e200, *[0.0] * 31], 1), (2008, [1e-200], 1), (2009, [], 1)]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], VEC + ", n_links int, cell string").repartition(4)
    got = sorted((tuple(r) for r in collisions.near_duplicates(df).collect()), key=str)
    assert got == sorted(brute_links(rows), key=str) and sum(r[1] > 0 for r in got) > 100
    assert collisions.near_duplicates(df.limit(0)).collect() == []


def test_recall_at_the_threshold(spark):
    """Pairs at a cosine of just 0.98 among many far ones: the index is measured against brute force."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(1500, 48))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    other = rng.normal(size=base.shape)
    other -= base * (base * other).sum(axis=1, keepdims=True)
    near = 0.98001 * base + math.sqrt(1 - 0.98001**2) * other / np.linalg.norm(other, axis=1, keepdims=True)
    rows = [(k, [float(x) for x in v], 1) for k, v in enumerate(np.concatenate([base, near]))]
    got = {r.vec_id: r for r in collisions.near_duplicates(spark.createDataFrame(rows, VEC)).collect()}
    assert sum(got[1500 + k].component_id == k for k in range(1500)) >= 0.99 * 1500


def test_collisions_counted():
    rng = np.random.default_rng(1)
    cell = np.sort(rng.integers(0, 9, 300))
    places = rng.integers(-128, 128, (300, collisions.LINES)).astype(np.int8)
    places[5:40] = places[5] + rng.integers(-6, 7, (35, collisions.LINES)).astype(np.int8)
    a, b = collisions.collided(cell, places, 11, 12)
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if cell[i] == cell[j] and (abs(places[i].astype(int) - places[j]) <= 11).sum() >= 12}
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == want and len(a) == len(want)


def brute_codes(rows, parts, entries, rounds, scale):
    use = [(i, [max(-(1 << 60), min(1 << 60, math.floor(scale * x))) for x in v], lab) for i, v, lab in rows if fine(v)]
    width = -(-max(len(v) for _, v, _ in use) // parts)
    use = [(i, v + [0] * (width * parts - len(v)), lab, raw) for (i, v, lab), raw in zip(use, [r[1] for r in rows if fine(r[1])], strict=True)]
    seeds = [v for _, v, _, _ in sorted(use, key=lambda r: (r[0] is None, r[0] or 0, r[3]))[:entries]]
    books = [[s[p * width : (p + 1) * width] for s in seeds] for p in range(parts)]

    def best(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for _, v, _, _ in use:
                x = v[p * width : (p + 1) * width]
                own.setdefault(best(x, books[p])[1], []).append(x)
            books[p] = [[sum(c) // len(own[j]) for c in zip(*own[j], strict=True)] if j in own else e for j, e in enumerate(books[p])]
    out, total = [], {}
    for i, v, lab, _ in use:
        found = [best(v[p * width : (p + 1) * width], books[p]) for p in range(parts)]
        e = min(sum(f[0] for f in found), (1 << 63) - 1)
        total[lab] = total.get(lab, 0) + e
        out.append((i, "".join(f"{f[1]:02x}" for f in found), e, lab))
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, min(total[lab], (1 << 63) - 1)) for i, c, e, lab in out), key=str), sha


@pytest.mark.parametrize("kind", ["floats", "ties", "large", "few"])
def test_codes(spark, kind):
    rng = np.random.default_rng(4)
    n = 5 if kind == "few" else 200
    values = {"floats": rng.normal(0, 0.2, (n, 16)), "ties": rng.integers(-2, 3, (n, 16)) / 4, "large": rng.normal(0, 1, (n, 16)) * 10.0 ** rng.integers(0, 22, (n, 1)), "few": rng.normal(0, 0.2, (n, 16))}[kind]
    rows = [(k * 3 % 211, [float(x) for x in v], int(k % 3) if k % 7 else None) for k, v in enumerate(values)]
    rows += [(500, None, 1), (501, [float("nan")] * 16, 1), (502, [None] * 16, None), (None, rows[1][1], 2), (None, rows[2][1], None), (rows[0][0], rows[3][1], 1), (503, rows[0][1][:7], 0), (504, [], 0)]
    df = spark.createDataFrame([(*r, 1) for r in rows], VEC + ", code int").repartition(3)
    books = codes.train(df, parts=4, entries=16)
    got = sorted(((r.vec_id, bytes(r.code).hex(), r.error, r.label_error) for r in codes.coded(df, books).collect()), key=str)
    want, sha = brute_codes(rows, 4, 16, 2, 256)
    assert got == want and books.sha256() == sha


def test_no_vectors(spark):
    none = spark.createDataFrame([(1, None, 1)], VEC)
    for df in (none, none.limit(0)):
        assert codes.coded(df, codes.train(df)).collect() == []
    books = codes.train(spark.createDataFrame([(1, [1.0] * 32, 1)], VEC))
    assert codes.coded(none, books).collect() == []
    long = spark.createDataFrame([(2, [1.0] * 40, 1)], VEC)
    assert [r.error for r in codes.coded(long, books).collect()] == [0]


def test_intervals_hold_the_rounding():
    """Entries a rounding apart in float32: the exact comparison decides, ties to the lower index."""
    rng = np.random.default_rng(0)
    x = rng.integers(-(1 << 26), 1 << 26, (300, 4))
    entries = np.concatenate([x[:20] + 1, x[:20] - 1, x[:20] + 1])
    best, error = codes.nearest(x, entries)
    far = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (best == far.argmin(axis=1)).all() and (error == far.min(axis=1)).all()
