"""Ordered folds against plain Python, and stage tables under replays and broken writes."""

import random
from collections import deque

from pyspark.sql import functions as F

from quillstone.operators import walks as W
from quillstone.sources.store import Store


def test_admission(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice(["a", "a", "a", "b", None]), rng.randint(0, 4000)) for k in range(900)] + [(900, "a", None)]
    df = spark.createDataFrame(rows, "id long, who string, at long").repartition(5)
    waits, tries, begun, young = {}, {}, {}, {}
    for k, who, at in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[0])):
        b = begun.setdefault(who, [])
        t = max([at, *b[-1:], *([b[-3] + 100] if len(b) >= 3 else [])])
        b.append(t)
        waits[k] = (t, t - at)
        y = young.setdefault(who, deque())
        while y and y[0] <= at - 100:
            y.popleft()
        if len(y) < 3:
            y.append(at)
            tries[k] = (True, 0)
        else:
            tries[k] = (False, max(1, y[0] + 100 - at))
    got = {r.id: (r.begins, r.waits) for r in W.admitted(df, ["who"], "at", 3, 100, ("id",)).collect()}
    assert got == waits | {900: (None, None)}
    for who, b in begun.items():
        assert all(b[i + 3] - b[i] >= 100 for i in range(len(b) - 3)) and b == sorted(b), who
    assert {r.id: (r.allowed, r.retry) for r in W.tried(df, ["who"], "at", 3, 100, ("id",)).collect()} == tries | {900: (False, None)}
    assert W.admitted(df.limit(0), ["who"], "at", 3, 100).collect() == []


def test_budgets(spark):
    rng = random.Random(2)
    rows = [(k, f"d{rng.randint(0, 3)}", rng.choice([["llm"], ["llm", "embed"], ["embed", "embed"], [], None, ["free", "llm"]])) for k in range(300)]
    budget, used, want = {"llm": 30, "embed": 25, "none": 0}, {}, {}
    for k, day, kinds in rows:
        short = next((x for x in dict.fromkeys(kinds or []) if budget.get(x) and used.get((day, x), 0) + kinds.count(x) > budget[x]), None)
        if short is None:
            for x in kinds or []:
                used[day, x] = used.get((day, x), 0) + 1
        want[k] = (short is None, short)
    df = spark.createDataFrame(rows, "id long, day string, kinds array<string>").repartition(4)
    assert {r.id: (r.allowed, r.short) for r in W.reserved(df, "day", "kinds", ["id"], budget).collect()} == want
    assert not all(a for a, _ in want.values())


def test_ledger(spark):
    say = lambda doc, *said: [(doc, n, p, r) for n, (p, r) in enumerate(said)]
    rows = say("a", (1, None), (1, "crash"), (2, "crash"), (2, None), (3, "timeout"), (4, None), (5, "error"))
    rows += say("b", *[(p, "crash") for p in range(1, 6)], (6, None), (7, None)) + say("c", (1, "timeout"), (2, None), (3, "memory"), (4, None)) + say("d", (None, None))
    df = spark.createDataFrame(rows, "doc string, n long, page long, reason string").repartition(3)
    got = {r.doc: (r.read, r.failed, r.ignored_after_giving_up) for r in W.settled(df, "doc", ["n"]).collect()}
    assert got == {"a": (2, 3, False), "b": (0, 5, True), "c": (2, 2, False), "d": (0, 0, False)}
    assert {r.doc: r.read for r in W.settled(df, "doc", ["n"], most_stops=2).collect()}["c"] == 1


def test_trial(spark):
    line = lambda page, lang, n, text, c: (page, lang, n, text, float(c), lang == "ara")
    rows = [line(1, "eng", 0, "hello there", 90), line(1, "eng", 1, "xq zv", 45), line(1, "ara", 0, "هه", 41), line(1, "ara", 1, "كتاب جميل", 88)]
    rows += [line(2, "eng", 0, "only english", 80), line(2, "ara", 0, "زز", 20), line(3, "eng", 0, "bad words", 60), line(3, "ara", 0, "كتاب قديم", 58), line(4, "eng", 0, "one", 70), line(4, "fra", 0, "two", 75)]
    df = spark.createDataFrame(rows, "page long, lang string, line long, text string, confidence double, arabic boolean")
    got = {(r.page, r.line): (r.lang, r.text) for r in W.trial(df).collect()}
    assert got == {(1, 0): ("eng", "hello there"), (1, 1): ("ara", "كتاب جميل"), (2, 0): ("eng", "only english"), (3, 0): ("eng", "bad words"), (4, 0): ("fra", "two")}


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/stage", "doc string, kind string, item long, data string", ["doc", "kind", "item"])
    rows = lambda *r: spark.createDataFrame([("d", "page", i, x) for i, x in r], "doc string, kind string, item long, data string")
    read = lambda: sorted((r.item, r.data) for r in store.read().collect())
    assert read() == []
    store.put(rows((1, "a"), (2, "b")), 1)
    store.put(rows((2, "c"), (3, "d")), 2)
    assert read() == [(1, "a"), (2, "c"), (3, "d")]
    store.put(rows((1, "a"), (2, "b")), 1)  # replayed after its successor
    store.put(rows((9, "z")), 2)  # a committed number is never written again
    assert read() == [(1, "a"), (2, "c"), (3, "d")]
    whole = rows((1, "half")).select("*", F.lit(False).alias("gone"), F.lit(3).cast("long").alias("batch"))
    store._write(whole, "rows")  # a try that broke off before its commit
    assert read() == [(1, "a"), (2, "c"), (3, "d")]
    store.put(rows((1, "full"), (4, "e")), 3)
    assert read() == [(1, "full"), (2, "c"), (3, "d"), (4, "e")]
    store.remove(rows((2, None), (4, None)).drop("data"), 4)
    store.put(rows(), 5)
    assert read() == [(1, "full"), (3, "d")]
    store.put(rows((2, "again")), 6)
    assert read() == [(1, "full"), (2, "again"), (3, "d")]


def test_refusals_however_they_are_cut(spark):
    from quillstone.functions import fixed
    from quillstone.operators import refusals as R

    rng = random.Random(7)
    texts = [f"{rng.choice(['', '**', '> ', ' «'])}{rng.choice([str, str.upper])(s)}{rng.choice(['', ' and more', '. More', '[S1]'])}" for s in fixed.NOT_FOUND.values() for _ in range(6)]
    texts += ["[[NO_ANSWER]]", "(not in document)", "Not found", "Not founded until 1963", "NOT_IN_DOCUMENTATION", "not", "The uploaded document lists", "", None, "…", "It is so. Not found", "No answer was given"[:9] + "ing"]
    for t in fixed.NOT_FOUND.values():
        assert R.refuses(t) and not R.refuses(t[: len(t) // 2]) and not R.refuses("x " + t)
    want = {k: ("" if R.refuses(t) else t or "", R.refuses(t)) for k, t in enumerate(texts)}
    assert not want[len(fixed.NOT_FOUND) * 6 + 3][1] and not want[len(fixed.NOT_FOUND) * 6 + 4][1] and want[len(fixed.NOT_FOUND) * 6 + 2][1]
    rows = []
    for k, t in enumerate(texts):
        at, seq = 0, 0
        while at < len(t or "") or not seq:
            n = rng.randint(0, 6)
            rows.append((k, seq, t[at : at + n] if t is not None else None))
            at, seq = at + n, seq + 1
    rng.shuffle(rows)
    got = {}
    for r in R.held(spark.createDataFrame(rows, "id long, seq long, text string").repartition(4), ["id"]).orderBy("id", "seq").collect():
        shown, refused = got.get(r.id, ("", False))
        got[r.id] = (shown + r.shown, refused or r.refused)
    assert got == want
