"""Page geometry against plain Python: direction of lines, blocks and offsets, headings, recognised columns."""

import random
import re
import statistics

from quillstone.operators import geometry as G

ITEM = "page long, x0 double, x1 double, baseline double, size double, bold boolean, horizontal boolean, text string"
AR = re.compile("[؀-ۿݐ-ݿא-ת]")
MIRROR = str.maketrans("()[]{}<>«»", ")(][}{><»«")


def side(t):
    rtl = sum(c.isalpha() for c in AR.findall(t))
    letters = sum(c.isalpha() for c in t)
    if rtl or letters:
        return "R" if rtl > letters - rtl else "L"
    return "L" if any(c.isdigit() for c in t) else None


def read(items, base):
    """A line's words in reading order, by groups of equal direction."""
    items = sorted(items, key=lambda i: (i[0], i[1], i[3]))
    sides = [side(i[3]) for i in items]
    said = []
    for k, s in enumerate(sides):
        left = next((x for x in reversed(sides[:k]) if x), None)
        right = next((x for x in sides[k + 1 :] if x), None)
        said.append(s or (left if left == right and left else base))
    groups = []
    for i, s in zip(items, said, strict=True):
        if groups and groups[-1][0] == s:
            groups[-1][1].append(i)
        else:
            groups.append((s, [i]))
    order = [(s, sorted(g, key=lambda i: i[0], reverse=s == "R"), min(i[0] for i in g), max(i[1] for i in g)) for s, g in (reversed(groups) if base == "R" else groups)]
    out, last = "", None
    for n, (s, g, lo, hi) in enumerate(order):
        for i in g:
            if last:
                m, j, jlo, jhi = last
                gap = (j[0] - i[1] if s == "R" else i[0] - j[1]) if m == n else (jlo - hi if base == "R" else lo - jhi)
                if gap > 0.25 * max(i[2], j[2]) and not j[3][-1].isspace() and not i[3][0].isspace():
                    out += " "
            out += i[3].translate(MIRROR) if s == "R" else i[3]
            last = n, i, lo, hi
    return out


def test_direction(spark):
    rng = random.Random(4)
    words = ["abc", "De", "12", "٤٥", "שלום", "كتاب", "(", ")", "-", "،", "قلم(", "x9", "[كتب", "..."]
    lines, rows = {}, []
    for n in range(300):
        x, items = 0.0, []
        for _ in range(rng.randint(1, 9)):
            w = rng.choice(words)
            items.append((x, x + 4.0 * len(w), rng.choice([10.0, 12.0]), w))
            x += 4.0 * len(w) + rng.choice([0.0, 1.0, 2.0, 4.0, 9.0])
        base = rng.choice("RL")
        lines[n] = read(items, base)
        rows += [(1, n, *i, base) for i in items]
    rng.shuffle(rows)
    got = G.assembled(spark.createDataFrame(rows, "page long, line long, x0 double, x1 double, size double, text string, base string")).collect()
    assert {r.line: r.text for r in got} == lines


def placed(page, y, x, texts, size=10.0, bold=False, gap=4.0):
    out, x = [], float(x)
    for t in texts:
        out.append((page, x, x + 5.0 * len(t), float(y), size, bold, True, t))
        x += 5.0 * len(t) + gap
    return out


def test_page(spark):
    rows = placed(1, 20, 50, ["Chapter", "1"], size=10.0) + placed(1, 32, 50, ["one", "two", "three", "four", "five", "infor-"]) + placed(1, 44, 50, ["mation", "six", "seven", "eight", "nine", "ten"])
    rows += placed(1, 70, 50, ["Big", "title"], size=14.0) + placed(1, 90, 50, ["eleven", "twelve", "thirteen", "and", "fourteen"]) + placed(1, 102, 50, ["cell"]) + placed(1, 102, 300, ["far"])
    rows += placed(1, 114, 50, ["Bold", "words"], bold=True) + placed(1, 126, 50, ["again", "plain", "text", "to", "the", "end"])
    rows += placed(1, 160, 50, ["1.", "first"]) + placed(1, 180, 50, ["2.", "second"]) + [(1, 5.0, 9.0, 300.0, 10.0, False, False, "rotated")]
    rows += [(2, 10.0, 20.0, 5.0, 10.0, False, True, ""), (2, 10.0, 20.0, 5.0, 10.0, False, True, "  ")]
    got = G.page(spark.createDataFrame(rows, ITEM).repartition(5))
    blocks = sorted(got.blocks.collect(), key=lambda r: (r.page, r.block))
    text = "\n\n".join(b.text for b in blocks)
    assert [b.text for b in blocks] == ["Chapter 1", "one two three four five information six seven eight nine ten", "Big title", "eleven twelve thirteen and fourteen\ncell far", "Bold words", "again plain text to the end", "1. first", "2. second", "rotated"]
    assert [b.heading for b in blocks] == [True, False, True, False, False, False, False, False, False]
    assert all(text[b.char_start : b.char_end] == b.text for b in blocks)
    lines = got.lines.collect()
    assert {text[r.char_start : r.char_end] for r in lines if r.block == 1} == {"one two three four five infor", "mation six seven eight nine ten"}
    assert G.page(spark.createDataFrame([], ITEM)).blocks.collect() == []


def test_lines_and_leading(spark):
    """Random pages: lines by heights, blocks by the low quantile of ways."""
    rng, rows, want = random.Random(8), [], {}
    for page in range(20):
        y, blocks, ways = 30.0, [], []
        for b in range(rng.randint(2, 6)):
            for k in range(rng.randint(1, 7)):
                way = 12.0 if k else 30.0
                y += way
                words = [rng.choice(["alpha", "beta", "gamma", "delta."]) for _ in range(rng.randint(3, 8))]
                rows += [(*r[:3], r[3] + rng.choice([0.0, 0.5, -0.5]), *r[4:]) for r in placed(page, y, 40, words)]
                blocks.append((b, " ".join(words)))
                ways.append(way)
        low = sorted(ways[1:])[int(0.25 * (len(ways) - 2))] if len(ways) > 2 else 12.0
        if low > 12.0 * 1.05 or len(ways) < 4:  # too few lines in paragraphs: every line's way is usual
            continue
        want[page] = ["\n".join(t for c, t in blocks if c == b) for b in dict.fromkeys(c for c, _ in blocks)]
    rng.shuffle(rows)
    got = {}
    for r in G.page(spark.createDataFrame(rows, ITEM)).blocks.orderBy("page", "block").collect():
        got.setdefault(r.page, []).append(r.text)
    assert len(want) > 8 and all(got[p] == t for p, t in want.items())


def test_recognised(spark):
    """Two columns in the engine's order, specks between."""
    rows, seq, want = [], 0, []
    for column in range(2):
        y = 100
        for paragraph in range(3):
            lines = []
            for k in range(4):
                text = f"column {column}  paragraph {paragraph} line {k}"
                rows += [(1, seq, text, 90.0 - k, 100.0 + 500 * column, float(y), 500.0 + 500 * column, y + 20.0), (1, seq + 1, "~ -", 80.0, 0.0, y + 1.0, 900.0, y + 9.0), (1, seq + 2, "speck", 14.9, 0.0, y + 1.0, 900.0, y + 9.0)]
                seq += 3
                y += 24
                lines.append(" ".join(text.split()))
            want.append("\n".join(lines))
            y += 30
    schema = "page long, seq long, text string, confidence double, x0 double, y0 double, x1 double, y1 double"
    got = G.recognised(spark.createDataFrame(rows, schema).repartition(3))
    blocks = got.blocks.orderBy("block").collect()
    text = "\n\n".join(b.text for b in blocks)
    assert [b.text for b in blocks] == want and all(text[b.char_start : b.char_end] == b.text for b in blocks)
    kept = [(len(re.sub(r"\s", "", r[2])), r[3]) for r in rows if "column" in r[2]]
    mean = G.confidence(got.lines).first().confidence
    assert abs(mean - sum(n * c for n, c in kept) / sum(n for n, _ in kept)) < 1e-9 and statistics.median(c for _, c in kept) < 90
    assert G.recognised(spark.createDataFrame([], schema)).blocks.collect() == []


def test_plain(spark):
    rows = [(1, "One line-\nwrapped here.\r\n\r\n \n* * *\n\nTwo\n  three  "), (2, ""), (3, None), (4, "\n\nx")]
    got = {}
    for r in G.plain(spark.createDataFrame(rows, "page long, text string")).orderBy("page", "block").collect():
        got.setdefault(r.page, []).append((r.text, r.char_start, r.char_end))
    assert got == {1: [("One linewrapped here.", 0, 21), ("Two\nthree", 23, 32)], 4: [("x", 0, 1)]}


def test_plain_in_one_pass(spark):
    """blocks of plain pages take no shuffle, keep the pages' other columns, and lose nothing at their ends."""
    texts = [(1, "00 first 0\n\n1 second\t \x0b line 1\n  more-\nover 2\n\n...\n\n0"), (2, None), (3, ""), (4, "é 😀-\nx\r\n\r\n y\tz ")]
    df = G.plain(spark.createDataFrame([(p, t, f"d{p}") for p, t in texts], "page long, text string, doc string"))
    assert "Exchange" not in df._jdf.queryExecution().toString()
    assert [(r.page, r.block, r.text, r.char_start, r.char_end, r.doc) for r in df.orderBy("page", "block").collect()] == [
        (1, 0, "00 first 0", 0, 10, "d1"), (1, 1, "1 second line 1\nmoreover 2", 12, 38, "d1"), (1, 2, "0", 40, 41, "d1"), (4, 0, "é 😀-\nx", 0, 6, "d4"), (4, 1, "y z", 8, 11, "d4"),
    ]


def test_lines_across_batches(spark):
    """F3, F16: words are in no window, and lines that Arrow batches cut are read whole."""
    rng, rows = random.Random(11), []
    for page in (None, 1, 2):
        for k in range(30):
            words = [rng.choice(["alpha", "שלום", "(", "12", "كتاب", "-", "delta."]) for _ in range(rng.randint(1, 9))]
            rows += [(page, *r[1:3], r[3] + rng.choice([0.0, 0.4]), rng.choice([10.0, 10.0, 13.0]), *r[5:]) for r in placed(1, 20 + 12 * k, 40, words)]
    rows += [(2, 3.0 * k, 3.0 * k + 2, 500.0, 9.0, False, False, f"turned{k}") for k in range(4)] + [(1, 40.0, 45.0, 20.0, 10.0, False, True, t) for t in "ba"]
    rng.shuffle(rows)
    layout = G.page(spark.createDataFrame(rows, ITEM))
    want = sorted(map(str, layout.lines.collect())), sorted(map(str, layout.blocks.collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        layout = G.page(spark.createDataFrame(rows, ITEM).repartition(7))
        assert (sorted(map(str, layout.lines.collect())), sorted(map(str, layout.blocks.collect()))) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    said = G.assembled(spark.createDataFrame([(1, 0, 0.0, 5.0, 10.0, "a", "L")], "page long, line long, x0 double, x1 double, size double, text string, base string"))
    assert "Window" not in said._jdf.queryExecution().toString()


def test_read_in_the_first_pass(spark):
    """a line whose ends agree is read where it is measured; only lines that wait for their base keep words, and a page's measures come in a row of its own."""
    rows = placed(1, 20, 50, ["plain", "words"]) + placed(1, 32, 50, ["(", "12"]) + placed(2, 20, 50, ["كتاب", "(a", "שלום"]) + placed(2, 32, 50, ["left", "كتاب"]) + placed(2, 44, 50, ["شرح", "كتاب"])
    facts = {(r.page, r.line): r for r in G._facts(spark.createDataFrame(rows, ITEM)).collect()}
    assert {k for k, r in facts.items() if r.words is not None} == {(1, 1), (2, 1)}
    assert facts[1, 0].text == "plain words" and facts[2, 0].text == read([(r[1], r[2], r[4], r[7]) for r in rows[4:7]], "R")
    assert [facts[p, -1].body for p in (1, 2)] == [10.0, 10.0] and [facts[p, -1].leading for p in (1, 2)] == [12.0, 12.0]
    got = {(r.page, r.line): r.text for r in G.page(spark.createDataFrame(rows, ITEM)).lines.collect()}
    assert got[1, 1] == "( 12" and got[2, 1] == read([(r[1], r[2], r[4], r[7]) for r in rows[7:9]], "R")


def test_sizes_round_half_up(spark):
    """a page's sizes are told apart to one decimal, as Spark rounds them."""
    from pyspark.sql import functions as F

    sizes = [9.95, 10.04, 10.05, 10.25, 9.949999, 0.05, 1e7, 12.0]
    got = [r.x for r in spark.createDataFrame([(s,) for s in sizes], "s double").select(F.round("s", 1).alias("x")).collect()]
    assert G._rounded(G.np.array(sizes)).tolist() == got
