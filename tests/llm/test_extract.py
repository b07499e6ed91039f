"""Page differencing: against plain Python on random sites, and what markup, copies and broken pages do to it."""

import random
import time

from pyspark.sql import functions as F

from quillstone.llm import extract


def longest(a, b):
    """Plain dynamic programming: the length of a longest common subsequence."""
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    return rows[-1][-1]


def test_common_subsequence(monkeypatch):
    rng = random.Random(1)
    for bits in (1 << 28, 20):
        monkeypatch.setattr(extract, "BITS", bits)
        for _ in range(500):
            a, b = ([rng.choice("abcde") for _ in range(rng.randint(0, 14))] for _ in range(2))
            pairs = extract.shared(a, b)
            assert all(a[i] == b[j] for i, j in pairs) and all(p < q and r < s for (p, r), (q, s) in zip(pairs, pairs[1:], strict=False)) and len(pairs) == longest(a, b)


def run(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.page_id: r.text for r in extract.extract(pages).collect()}


def site(rng, host, k, own):
    """One template for a host: lines of their own between the site's; every third page has an article element, every fifth a menu element."""
    body = "".join(f"<p>{x}</p>" for x in own)
    body = f"<article>{body}</article>" if k % 3 == 0 else f"<div>{body}</div>"
    menu = f"<nav><li>{host} menu</li></nav>" if k % 5 == 0 else f"<div>{host} menu</div>"
    return f"<body>{menu}<div>{host} head</div>{body}<script>x({k})</script><div>{host} foot</div></body>"


def test_random_sites_like_plain_python(spark, monkeypatch):
    monkeypatch.setattr(extract, "UNIT", 7)  # many units, so that neighbours lie in others
    rng, rows, own = random.Random(3), [], {}
    for h in range(3):
        for k in range(25):
            lines = [f"line {h} {k} {x} " + "word " * rng.randint(10, 20) for x in range(rng.randint(1, 5))]
            if k % 4 == 0:
                lines.insert(0, f"a paragraph that pages of host {h} repeat, again and again")
            rows.append((len(rows), f"http://h{h}.org/{rng.randint(100, 999)}", site(rng, f"h{h}", k, lines)))
            own[rows[-1][0]] = [" ".join(x.split()) for x in lines]
    got = run(spark, rows)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").select("page_id", F.regexp_extract("url", "//([^/]*)", 1), F.regexp_extract("url", "//[^/]*(/.*)", 1), F.xxhash64("html"), "html")
    seq = sorted((r[1], r[2], r[3], r[0], r[4]) for r in pages.collect())
    for at, (host, _, _, k, html) in enumerate(seq):
        near = [extract.lines(seq[j][4]) for j in (at - 1, at + 1) if 0 <= j < len(seq) and seq[j][0] == host]
        want = []
        for t, m in extract.lines(html):
            # A template's lines stand in one order, so sharing a line is sharing it in a longest common subsequence.
            if m == 1 or m == 0 and not any(t == u and v < 1 for other in near for u, v in other):
                want.append(t)
        assert got[k] == "\n\n".join(want)
        if "<article>" in html:
            assert got[k].split("\n\n") == own[k]
        else:
            assert not {f"{host.split('.')[0]} {x}" for x in ("head", "foot", "menu")} & set(got[k].split("\n\n"))


def test_a_page_without_article_between_pages_with_one(spark):
    page = lambda body: f"<div>Site head</div>{body}<div>Site foot</div>"
    rows = [(1, "http://a.org/1", page("<article><p>One of its own</p><p>Shared</p></article>")), (2, "http://a.org/2", page("<p>hi there</p><p>Shared</p>")), (3, "http://a.org/3", page("<article><p>Three of its own</p></article>"))]
    assert run(spark, rows) == {1: "One of its own\n\nShared", 2: "hi there\n\nShared", 3: "Three of its own"}


def test_short_page_in_a_large_template(spark):
    head, foot = "<div>" + "menu words " * 30 + "</div>", "<div>" + "foot words " * 30 + "</div>"
    rows = [(k, f"http://b.org/{k}", f"{head}<p>hi there {k}</p>{foot}") for k in range(4)]
    assert run(spark, rows) == {k: f"hi there {k}" for k in range(4)}
    assert run(spark, rows[:2]) == {k: f"hi there {k}" for k in range(2)}


def test_copies_keep_their_text(spark):
    body = "".join(f"<p>Paragraph {k} of the text, some words long</p>" for k in range(8))
    rows = [(k, f"http://c.org/{k}", f"<div>Menu</div>{body}<script>{k}</script>") for k in range(3)] + [(9 + k, f"http://c.org/x{k}", f"<div>Menu</div><p>Other page {k}, and quite another text</p>") for k in range(6)]
    got = run(spark, rows)
    assert all(got[k].count("Paragraph") == 8 for k in range(3)) and "Menu" not in got[1]


def test_short_pages_and_runs_of_copies(spark):
    site = [f"A long line of the site's own menu, number {k}, that stands on all of its pages" for k in range(12)]
    page = lambda *own: "".join(f"<div>{t}</div>" for t in [*site[:6], *own, *site[6:]])
    rows = [(k, f"http://short.org/{k:03d}", page(f"story {k}")) for k in range(8)]
    rows += [(100 + k, f"http://runs.org/{k:03d}", page(f"The story is number {k // 5} of them. " * 60)) for k in range(20)]
    got = {r.page_id: r.text for r in extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == {k: f"story {k}" for k in range(8)} | {100 + k: ("The story is number %d of them. " % (k // 5) * 60).strip() for k in range(20)}


def test_repeated_rows_get_the_same_text(spark):
    rows = [(1, "http://a.org/1", "<p>head</p><p>one</p>")] * 3 + [(None, "http://a.org/1", "<p>head</p><p>one</p>"), (2, "http://a.org/2", "<p>head</p><p>two</p>"), (3, None, None), (3, None, "<p>x</p>")]
    got = sorted((str(r.page_id), r.text, r.n_chars) for r in extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == sorted([("1", "one", 3)] * 3 + [("None", "one", 3), ("2", "two", 3), ("3", "", 0), ("3", "x", 1)])


def test_main_element_is_differenced(spark):
    rows = [(k, f"http://d.org/{k}", f"<p>around {k}</p><main><p>Share this page</p><p>Text {k} of some length here</p></main>") for k in range(4)]
    assert run(spark, rows) == {k: f"Text {k} of some length here" for k in range(4)}


def test_broken_pages_take_linear_time():
    for page in ("<a " * 333_000, '<a b=" ' * 150_000, "<!-- " * 200_000, "<![CDATA[" * 100_000, "<" * 1_000_000, "<script>" * 120_000, "<p>" * 300_000):
        began = time.perf_counter()
        assert not [t for t, m in extract.lines(page) if "a b" in t and m > 0 and "script" in t]
        assert time.perf_counter() - began < 5
    assert extract.lines('<p>a <b title="x>y">c</b> &lt;d&gt;</p>') == [("a c <d>", 0)]


def test_markup_marks():
    page = "<nav>menu</nav><h1>Top</h1><article><header>by me<h2>Title</h2></header><p>Text</p><aside>also</aside><div class='comments'><p>reply</p></div></article><footer>foot</footer>"
    assert extract.lines(page) == [("menu", -1), ("Top", -1), ("by me", -1), ("Title", 1), ("Text", 1), ("also", -1), ("reply", -1), ("foot", -1)]
    assert extract.lines("") == []


def test_main_before_cards(spark):
    page = "<body><div>Menu</div><main><h1>Big news</h1><p>The whole story…</p></main><article><h2>Other story</h2><p>Teaser text</p></article><article><h2>Third</h2><p>Teaser two</p></article></body>"
    assert run(spark, [(1, "http://n.org/1", page)]) == {1: "Big news\n\nThe whole story…"}
    cards = "<body><div>Menu</div><main><article><p>First of the blog</p></article><article><p>Next of the blog</p></article></main></body>"
    assert run(spark, [(1, "http://n.org/1", cards)]) == {1: "First of the blog\n\nNext of the blog"}


def test_telling_words_in_class_names_leave_it_to_the_neighbours(spark):
    body = '<article><p>Story {k}</p><p class="notice-of-birth">Born {k}</p><div class="author-side-note">A note on {k}</div><div id="social-history"><p>History of {k}</p></div><div class="share-row"><p>Share this story with friends</p></div><div class="ad">Buy</div></article>'
    got = run(spark, [(k, f"http://c.org/{k}", body.replace("{k}", str(k))) for k in range(4)])
    assert got == {k: f"Story {k}\n\nBorn {k}\n\nA note on {k}\n\nHistory of {k}" for k in range(4)}


def test_lone_hosts_meet_others_of_their_template(spark):
    page = lambda name, text: f'<body><div class="top">Home</div><div>Shop now</div><p>{text}</p><div class="bottom">Powered by Templates</div><div>Copyright 2020 {name}</div></body>'
    rows = [(k, f"http://lone{k}.org/x", page(f"L{k}", f"Alone in the world {k}")) for k in range(3)] + [(9, "http://other.org/", "<section>Home</section><p>Nothing like it</p>")]
    got = run(spark, rows)
    assert got == {k: f"Alone in the world {k}\n\nCopyright 2020 L{k}" for k in range(3)} | {9: "Home\n\nNothing like it"}


def test_like_a_tree_parser(spark):
    """Well-formed random pages, read by the standard library's parser and plain rules over its tree."""
    from html.parser import HTMLParser

    class Tree(HTMLParser):
        def __init__(self):
            super().__init__()
            self.root = self.now = {"tag": "root", "attrs": {}, "kids": [], "up": None}

        def handle_starttag(self, tag, attrs):
            new = {"tag": tag, "attrs": dict(attrs), "kids": [], "up": self.now}
            self.now["kids"].append(new)
            if tag not in ("br", "img"):
                self.now = new

        def handle_endtag(self, tag):
            self.now = self.now["up"]

        def handle_data(self, data):
            self.now["kids"].append(data)

    inline = {"b", "i", "a", "span", "em"}
    gone = {"nav", "footer", "aside", "form", "script", "style", "head", "button"}

    def blocks(node, out):
        for kid in node["kids"]:
            if isinstance(kid, str):
                out[-1] += kid
            elif kid["tag"] in gone or kid["attrs"].get("class") in ("ad", "comments", "sidebar") or kid["attrs"].get("role") == "navigation":
                out.append("")
            elif kid["tag"] == "br":
                out[-1] += " "
            elif kid["tag"] in inline:
                blocks(kid, out)
            else:
                out.append("")
                blocks(kid, out)
                out.append("")
        return out

    rng = random.Random(12)

    def inner(depth):
        out = ""
        for _ in range(rng.randint(1, 4)):
            kind = rng.choice(["p", "p", "text", "div", "ul", "b", "br", "gone", "note"]) if depth else "p"
            word = f"w{rng.randint(0, 10**9)} &amp; &#233;  \n x"
            if kind == "p":
                out += f"<p>{word} <b>bold</b><br>more</p>"
            elif kind == "text":
                out += word
            elif kind == "b":
                out += f"<b>{word}</b>"
            elif kind == "br":
                out += "<br>"
            elif kind == "ul":
                out += f"<ul><li>{word}</li><li>{word}</li></ul>"
            elif kind == "div":
                out += f'<div class="x{rng.randint(0, 9)}">{inner(depth - 1)}</div>'
            elif kind == "note":
                out += f'<div class="birth-notice">{word}</div>'
            else:
                out += rng.choice([f"<nav><ul><li>{word}</li></ul></nav>", f"<aside>{word}</aside>", f'<div class="ad"><p>{word}</p></div>', f'<div class="comments"><p>{word}</p></div>', f"<script>{word.replace('&', '')}</script>", f'<div role="navigation">{word}</div>', f"<form><p>{word}</p></form>"])
        return out

    rows, want = [], {}
    for k in range(60):
        tag = rng.choice(["article", "main"])
        page = f"<html><head><title>t</title></head><body><nav>menu</nav><div>top {k}</div><{tag}><h1>Title {k}</h1>{inner(3)}</{tag}><footer>foot</footer></body></html>"
        tree = Tree()
        tree.feed(page)
        body = tree.root["kids"][0]["kids"][1]
        part = next(x for x in body["kids"] if not isinstance(x, str) and x["tag"] == tag)
        rows.append((k, f"http://t{k % 6}.org/{k}", page))
        want[k] = "\n\n".join(t for t in (" ".join(b.split()) for b in blocks(part, [""])) if t)
    assert run(spark, rows) == want


def test_pages_that_differencing_decides(spark):
    """Pages without an article element: how many lose lines by their neighbours alone. The README names the figure."""
    rng = random.Random(9)
    rows = [(k, f"http://d{k % 20}.org/{k:04d}", f"<div>d{k % 20} home</div><div class='links'><a>About us</a></div><p>own {rng.random()} text</p><p>and {rng.random()} more</p><div>All rights reserved</div>") for k in range(400)]
    got = run(spark, rows)
    assert sum(t.count("\n\n") == 1 and "home" not in t and "rights" not in t and "About" not in t for t in got.values()) == 400
