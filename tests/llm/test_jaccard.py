"""The Jaccard join, against all pairs."""

import random

import pytest

from quillstone.llm import jaccard


def brute(rows, n, num, den):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    sets = [shingles(t) for _, t in rows]
    up, links = list(range(len(rows))), [0] * len(rows)

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return sorted(((d, len(sets[i]), least.get(top(i)) if sets[i] else d, links[i]) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["the", "of", "and"] * 6
    rows = [(0, None), (1, ""), (2, " \t\n "), (3, "One two"), (4, "one TWO"), (5, "one\x0btwo\xa0"), (5, "one two"), (None, "one two"), (None, None)]
    base = [" ".join(rng.choices(words, k=rng.choice([5, 12, 40, 200, 900]))) for _ in range(25)]
    for k in range(260):
        w = rng.choice(base).split(" ")
        for _ in range(rng.choice([0, 0, 1, 1, 2, 5, 15])):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.choice([0, 1, 1])] = rng.choices(words, k=rng.choice([0, 1]))
        rows.append((10 + k, " ".join(w)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("n", "num"), [(4, 85), (5, 80), (2, 60)])
def test_all_pairs(spark, n, num):
    rows = corpus(n)
    got = sorted((tuple(r) for r in jaccard.join(spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, n int").repartition(3), n, num, 100).collect()), key=str)
    assert got == brute(rows, n, num, 100)


def test_blocks_of_a_large_component(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "UNIT_SETS", 20)
    rows = corpus(1)
    got = sorted((tuple(r) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100).collect()), key=str)
    assert got == brute(rows, 4, 85, 100)


def test_nothing(spark):
    assert jaccard.join(spark.createDataFrame([], "doc_id long, text string")).collect() == []
