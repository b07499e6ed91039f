"""The block chunker against a plain fold over a whole document, its invariants, the token window and highlights."""

import random
import re

import pytest

from quillstone.functions import tokens
from quillstone.operators import blocks as B
from quillstone.operators import chunking, layout

BLOCK = "doc string, page long, block long, text string, char_start long, heading boolean, title string, language string"
LIMITS = {"target": 400, "most": 600, "least": 100, "overlap": 120}


def ends(text):
    t = text.rstrip()
    last = t.split("\n")[-1].strip()
    if re.search(r"[.!?…][\"')\]]*$", t):
        return True
    return len(last) <= 48 and bool(re.fullmatch(r"[\W_]*(?:(?:page|pg|p)[\s.:]*)?\d{1,4}(?:\s*(?:/|of)\s*\d{1,4})?[\W_]*", last, re.I) or re.fullmatch(r".{0,40}[|—–·•/-]\s*\d{1,4}|\d{1,4}\s*[|—–·•/-].{0,40}", last))


def sentence_spans(text):
    return [(a + len(text[a:b]) - len(text[a:b].lstrip()), a + len(text[a:b].rstrip())) for a, b in chunking.sentences(text, LIMITS["most"]) if text[a:b].strip()]


def parts(text):
    if len(text) <= LIMITS["most"]:
        return [(0, len(text))]
    out = []
    for a, b in sentence_spans(text):
        if out and b - out[-1][0] <= LIMITS["target"]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def fold(pages):
    """The rules over one document, front to back. pages: number -> (text, [(block, start, text, heading, title)])."""
    units, drafts, section = [], [], None
    for number in sorted(pages):
        text, rows = pages[number]
        for block, start, body, heading, title in rows:
            if not body.strip():
                continue
            name = title if title is not None else body if heading else None
            for k, (a, b) in enumerate(parts(body)):
                units.append((number, start + a, start + b, k == 0 and name is not None and " ".join(name.split())[:160] or None, block == 0 and k == 0, ends(body)))
    said = lambda spans: "\n\n".join(pages[p][0][a:b] for p, a, b in spans)
    grown = lambda spans, p, a, b: [*spans[:-1], (p, spans[-1][1], b)] if spans[-1][0] == p else [*spans, (p, a, b)]
    for p, a, b, title, first, over in units:
        now = drafts[-1] if drafts else None
        if title:
            section = title
        if title or now is None:
            opens = True
        else:
            whole = said(grown(now["spans"], p, a, b))
            cross = now["spans"][-1][0] != p
            opens = (now["over"] or not first or len(whole) > LIMITS["most"]) if cross else (now["closed"] or len(whole) > LIMITS["target"])
        if opens:
            drafts.append({"section": section, "spans": [(p, a, b)], "titled": bool(title), "closed": False, "over": over})
        else:
            now["closed"] |= now["spans"][-1][0] != p
            now["spans"], now["over"] = grown(now["spans"], p, a, b), over
    kept = []
    for d in drafts:
        p = kept[-1] if kept else None
        if p and len(said(d["spans"])) < LIMITS["least"] and not d["titled"] and len(d["spans"]) == len(p["spans"]) == 1 and p["spans"][0][0] == d["spans"][0][0] and p["section"] == d["section"]:
            merged = [(p["spans"][0][0], p["spans"][0][1], d["spans"][0][2])]
            if len(said(merged)) <= LIMITS["most"]:
                p["spans"] = merged
                continue
        kept.append(d)
    out = []
    for k, d in enumerate(kept):
        own, tail = said(d["spans"]), ""
        if k and kept[k - 1]["section"] == d["section"]:
            before = said(kept[k - 1]["spans"])
            for a, _ in sentence_spans(before):
                if len(before) - a <= LIMITS["overlap"] and len(before[a:]) + 2 + len(own) <= LIMITS["most"]:
                    tail = before[a:].strip() + "\n\n"
                    break
        out.append((k, d["spans"][0][0], d["spans"][-1][0], d["section"], d["spans"][0][1], d["spans"][-1][2], len(tail), tail + own))
    return out


def corpus(seed):
    rng = random.Random(seed)
    docs = {}
    for d in range(12):
        pages = {}
        for number in sorted(rng.sample(range(1, 30), rng.randint(1, 9))):
            text, rows = "", []
            for block in range(rng.randint(0, 6)):
                kind = rng.random()
                if kind < 0.15:
                    body, heading = f"Heading {rng.randint(1, 9)}", True
                elif kind < 0.2:
                    body, heading = rng.choice(["Page 12", "- 7 -", "The Ledger | 12", "14 — Saltmarsh"]), False
                elif kind < 0.25:
                    body, heading = "", False
                else:
                    n = rng.choice([1, 2, 4, 9, 25])
                    body = " ".join(f"Sentence {rng.randint(1, 99)} says {'something ' * rng.randint(1, 6)}plain{rng.choice('.!?.')}" for _ in range(n))
                    body, heading = body if rng.random() < 0.6 else body[: -rng.randint(1, 9)].rstrip(" .!?") + " and", False
                if block:
                    text += "\n\n"
                rows.append((block, len(text), body, heading, "Outline title" if rng.random() < 0.04 else None))
                text += body
            pages[number] = (text, rows)
        docs[f"d{d}"] = pages
    return docs


def frame(spark, docs):
    rows = [(d, n, b, t, s, h, title, "en" if b % 3 else "fr") for d, pages in docs.items() for n, (_, blocks) in pages.items() for b, s, t, h, title in blocks]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, BLOCK).repartition(5)


@pytest.mark.parametrize("seed", [1, 2])
def test_fold(spark, seed):
    docs = corpus(seed)
    got = {}
    for r in B.chunked(frame(spark, docs), **LIMITS).orderBy("doc", "chunk_index").collect():
        got.setdefault(r.doc, []).append((r.chunk_index, r.page_start, r.page_end, r.section, r.char_start, r.char_end, r.overlap_chars, r.content))
        assert r.token_count == tokens.estimate(r.content)
        own = "\n\n".join(docs[r.doc][s.page][0][s.start : s.end] for s in r.spans)
        assert r.content[r.overlap_chars :] == own and len(r.content) <= LIMITS["most"]
    want = {d: fold(p) for d, p in docs.items()}
    assert got == {d: w for d, w in want.items() if w}
    assert any(a != b for w in want.values() for _, a, b, *_ in w) and any(x[6] for w in want.values() for x in w)
    for d, pages in docs.items():  # nothing is lost but blank space
        covered = {(s.page, k) for r in B.chunked(frame(spark, {d: pages}), **LIMITS).collect() for s in r.spans for k in range(s.start, s.end)} if d == "d0" else None
        if covered is not None:
            assert all((n, k) in covered or not c for n, (text, rows) in pages.items() for _, s, body, *_ in rows for k, c in zip(range(s, s + len(body)), map(str.strip, body), strict=True))


def test_window(spark):
    docs = corpus(5)
    df = frame(spark, docs)
    chunks = B.chunked(df, **LIMITS)
    assert chunks.filter("token_count > 60").count()
    cut = B.windowed(chunks, df, 60, **LIMITS).orderBy("doc", "chunk_index").collect()
    before = {(r.doc, s.page, k): r.section for r in chunks.collect() for s in r.spans for k in range(s.start, s.end)}
    index = {}
    for r in cut:
        assert r.token_count == tokens.estimate(r.content) <= 60
        assert r.chunk_index == index.get(r.doc, 0)
        index[r.doc] = r.chunk_index + 1
        assert r.content[r.overlap_chars :] == "\n\n".join(docs[r.doc][s.page][0][s.start : s.end] for s in r.spans)
        assert {before[r.doc, s.page, k] for s in r.spans for k in range(s.start, s.end)} == {r.section}
    after = {(r.doc, s.page, k) for r in cut for s in r.spans for k in range(s.start, s.end)}
    assert all(k in after for k in before if docs[k[0]][k[1]][0][k[2]].strip())


def test_nothing_and_one_long_word(spark):
    assert B.chunked(spark.createDataFrame([], BLOCK)).collect() == []
    got = B.chunked(spark.createDataFrame([(None, 1, 0, "x" * 1000, 0, None, None, None), (None, 1, 1, " ", 1002, None, None, None)], BLOCK), **LIMITS).collect()
    assert sum(len(r.content) - r.overlap_chars for r in got) == 1000 and max(len(r.content) for r in got) <= 600 and {r.language for r in got} == {"und"}


def test_highlights(spark):
    chunks = spark.createDataFrame([("d", 0, [(1, 0, 50), (2, 0, 10)]), ("d", 1, [(2, 10, 900)])], "doc string, chunk_index long, spans array<struct<page: long, start: long, end: long>>")
    lines = [("d", 1, k * 10, k * 10 + 10, 0.1, k / 100, 0.5, 0.01) for k in range(8)] + [("d", 2, k * 10, k * 10 + 10, 0.1, k / 100, 0.5, 0.01) for k in range(90)] + [("d", 1, 0, 10, 0.1, 0.0, 0.5, 0.01)]
    got = {(r.chunk_index, r.page): r.rects for r in B.highlights(chunks, spark.createDataFrame(lines, "doc string, page long, char_start long, char_end long, x double, y double, w double, h double")).collect()}
    assert [len(got[k]) for k in ((0, 1), (0, 2), (1, 2))] == [5, 1, 1]
    assert got[1, 2][0].y == 0.01 and abs(got[1, 2][0].h - 0.89) < 1e-9


def test_highlights_of_a_long_page(spark):
    """lines and chunks of a page meet in its cells, not each with each, and every pair that overlaps is found once."""
    rng, lines, spans, at = random.Random(4), [], [], 0
    for k in range(600):
        n = rng.choice([0, 1, 60, 80, 2500])
        lines.append(("d", k % 2, at, at + n, rng.random(), float(k), 0.5, 0.01))
        at += n + rng.choice([0, 1, 2])
    cuts = sorted(rng.sample(range(at), 120))
    spans = [(k, p, a, b) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) for p in (0, 1)]
    chunks = spark.createDataFrame([("d", k, [(p, a, b)]) for k, p, a, b in spans], "doc string, chunk_index long, spans array<struct<page: long, start: long, end: long>>")
    found = B.highlights(chunks, spark.createDataFrame(lines, "doc string, page long, char_start long, char_end long, x double, y double, w double, h double"))
    want = {(k, p): sorted(y for _, q, s, e, _, y, _, _ in lines if q == p and e > a and s < b) for k, p, a, b in spans}
    assert {(r.chunk_index, r.page): [x.y for x in r.rects] for r in found.collect()} == {k: v for k, v in want.items() if v}
    assert "cell" in found._jdf.queryExecution().optimizedPlan().toString()


def test_tokens_agree(spark):
    texts = ["Hello, world 12345!", "مرحبا بالعالم ١٢٣ ،", "漢字かな交じり文 x", "a b-c  — «d»", "\t\n x😀y  é", "", "12 345 abc9def", "ـــ، ؟"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [tokens.estimate(t) for t in texts] == [r.n for r in df.select(layout.token_estimate("text").alias("n")).collect()]


def test_ranges_hand_on(spark):
    """F2, F7, F8, F9, F10, F20: texts are in no window and no sort of a fold, and many ranges give the same chunks as one."""
    docs = corpus(7)
    one = sorted(map(str, B.chunked(frame(spark, docs), **LIMITS).collect()))
    cut = sorted(map(str, B.windowed(B.chunked(frame(spark, docs), **LIMITS), frame(spark, docs), 60, **LIMITS).collect()))
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "23"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        many = B.chunked(frame(spark, docs), **LIMITS)
        plan = many._jdf.queryExecution().optimizedPlan().toString()
        assert not [x for x in plan.splitlines() if "Window" in x and ("own#" in x or "text#" in x)]
        assert sorted(map(str, many.collect())) == one
        assert sorted(map(str, B.windowed(many, frame(spark, docs), 60, **LIMITS).collect())) == cut
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_stretches_count_as_texts():
    rng = random.Random(2)
    for _ in range(3000):
        t = "".join(rng.choice("ab c.d!1 2\n\té漢ا٣😀 \x0b ") for _ in range(rng.randint(0, 30)))
        a, b = sorted((rng.randint(0, len(t)), rng.randint(0, len(t))))
        assert tokens.Counted(t).hundredths(a, b) == tokens.hundredths(t[a:b])
        assert tokens.hundredths(t) + 2 * 10 + tokens.hundredths(t[::-1], True) == tokens.hundredths(t + "\n\n" + t[::-1])
