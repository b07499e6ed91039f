"""Main text of web pages by page differencing, beside what the markup says.

Every page's text lines are aligned with those of the nearest pages by URL path of the same host, by their longest common subsequence; lines that a page
shares with such a neighbour are the site's, not the page's, and go. Markup is evidence about a line: one inside an article element is the page's
even where another page repeats it; one in a menu, form, advert, notice or comment is not the page's, but still helps to align. Where a neighbour is
mostly a copy of the page, only those shared lines go that stand on most different pages of the host.
"""

from __future__ import annotations

import bisect
import hashlib
import html as entities
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import urls
from ._shared import modest_batches, settle

#: Elements without reader's text; elements that are never an article's; elements that end a block; elements without an end.
RAW = frozenset("script style noscript template iframe svg object math canvas".split())
OUT = frozenset("nav footer aside form button select textarea input dialog menu head title label fieldset".split()) | RAW
BLOCK = frozenset("p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table thead tbody tr blockquote pre section article main figure figcaption hr body html header address center details summary caption".split()) | OUT
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
SHORT = frozenset("p li dt dd tr td th option h1 h2 h3 h4 h5 h6".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Class names and ids, whole, of what is no article.
BAD = frozenset(
    "ad ads ad-slot adsbygoogle advert advertisement banner-ad sponsored cookie-notice cookie-banner cookie-consent gdpr newsletter newsletter-signup sidebar site-header site-footer navbar main-nav breadcrumb breadcrumbs menu "
    "comment comments comment-list commentlist respond disqus_thread share-buttons share-links social-share social-links related-posts pagination search-form login-form skip-link popup modal".split()
)
#: Words inside class names and ids that make their lines suspect, so that neighbours decide; and those that mark an article.
SUSPECT = frozenset(
    "ad ads advert advertisement advertising banner promo promotion sponsor sponsored cookie cookies consent notice alert popup modal overlay newsletter subscribe subscription signup sidebar side rail menu nav navigation breadcrumb "
    "header masthead footer comment comments reply replies discussion share sharing social related recommended recommendations pagination widget toolbar login search skip form copyright disclaimer".split()
)
GOOD = frozenset("article content main post entry story text maincontent articlebody".split())
OPEN = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|(/?)([A-Za-z][A-Za-z0-9:-]*+))")
#: The rest of a tag, with quoted values that may hold its end.
REST = re.compile(r"""[^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+>""")
NAMES = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
PARTS = re.compile(r"[A-Za-z]+")
HIDDEN = re.compile(r"""\bhidden\b(?!\s*=\s*["']?until)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
#: Roles of what is no article.
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: A line's mark: inside an article element; undecided; left out by the markup.
INSIDE, OPEN_, OUTSIDE = 1, 0, -1
#: Pages of one unit of differencing, units at most, pages parsed together, share of a page's undecided characters from which a neighbour is a copy of it.
UNIT, UNITS, TOGETHER, COPY = 2000, 1 << 16, 128, 0.6
#: Different pages from which a host's usual lines are told; hosts whose usual lines are broadcast at most (beyond it Spark joins by shuffle); bits of
#: an alignment's table that are held at once.
PAGES, BROADCAST, BITS = 3, 20_000, 1 << 28


class Tags:
    """A page's tags from left to right in linear time. A tag, comment or declaration without an end takes the rest of the page with it."""

    def __init__(self, page: str):
        self.page, self.quotes = page, True

    def next(self, at: int) -> tuple[int, int, str | None, bool, str]:
        """Where the next tag begins and ends, its name (None for what is no tag), whether it closes, its attributes. At the end of the page it begins there."""
        page = self.page
        m = OPEN.search(page, at)
        if not m:
            return len(page), len(page), None, False, ""
        start, end = m.span()
        if m[2] is None:
            close = {"<!--": "-->", "<![CDATA[": "]]>"}.get(m[0], ">")
            to = page.find(close, end - 2 if m[0] == "<!--" and page.startswith(">", end) else end)
            return start, len(page) if to < 0 else to + len(close), None, False, ""
        if self.quotes:
            r = REST.match(page, end)
            if r:
                return start, r.end(), m[2].lower(), m[1] == "/", page[end : r.end() - 1]
            self.quotes = False  # a quote that never ends: from here on, a tag ends at its first >
        to = page.find(">", end)
        if to < 0:
            return start, len(page), None, False, ""
        return start, to + 1, m[2].lower(), m[1] == "/", page[end:to]


def _marks(tag: str, attrs: str) -> str:
    """'out', 'suspect', 'main', 'in' or '' by an element's attributes."""
    if not attrs or tag in ("html", "body"):
        return ""
    if HIDDEN.search(attrs):
        return "out"
    words: set[str] = set()
    for m in NAMES.finditer(attrs):
        said = m[1] or m[2] or m[3] or ""
        if said.lower() == "main":
            return "main"
        if said.lower() in ROLES or BAD.intersection(said.lower().split()):
            return "out"
        words |= {w.lower() for w in PARTS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", said))}
    if words & {"article", "maincontent", "articlebody"} or {"main", "content"} <= words or {"post", "content"} <= words or {"entry", "content"} <= words:
        return "in"
    return "suspect" if words & SUSPECT and not words & GOOD else ""


class _Region:
    """The part of a page inside one kind of element, counted by its tag: which of them a line stands in, or none."""

    def __init__(self) -> None:
        self.tag, self.depth, self.count = "", 0, 0

    def open(self, tag: str) -> None:
        self.tag, self.depth, self.count = tag, 1, self.count + 1

    def tagged(self, tag: str, closing: bool) -> None:
        if self.depth and tag == self.tag:
            self.depth += -1 if closing else 1

    @property
    def at(self) -> int:
        return self.count if self.depth else 0


Line = tuple[str, bool, bool, int, int, bool]


def _settled(out: list[Line]) -> list[tuple[str, int]]:
    """Each line's mark. out: text, left out, suspect, number of its article element, of its main part, whether that is a main element."""
    size: dict[int, int] = {}
    inner: dict[int, int] = {}
    own = {True: 0, False: 0}
    for t, gone, _, article, main, real in out:
        if gone:
            continue
        if article:
            size[article] = size.get(article, 0) + len(t)
            if main and real:
                inner[article] = size[article]
        elif main:
            own[real] += len(t)
    if own[True] or inner:  # a main element: article elements outside it are cards, and so are those inside it if it says more itself
        chosen = {} if own[True] > sum(inner.values()) else inner
        around = True
    else:
        chosen, around = size, False
    most = max(chosen.values(), default=0)
    if 3 * most > 2 * sum(chosen.values()):  # one article among cards
        chosen = {k: n for k, n in chosen.items() if n == most}
    found = []
    for t, gone, suspect, article, main, real in out:
        if chosen:
            mark = OUTSIDE if article not in chosen else OPEN_ if suspect else INSIDE
        elif around:
            mark = OPEN_ if main and real and not article else OUTSIDE
        else:
            mark = OUTSIDE if own[False] and not main else OPEN_
        found.append((t, OUTSIDE if gone else mark))
    return found


def lines(page: str) -> list[tuple[str, int]]:
    """The page's blocks of text in their order, each with its mark. Scripts, styles and their like are no text.

    Where there is a main element, everything around it is left out, article elements too; inside it, article elements are the text if they say more than the rest of
    it. Without one, article elements are the text, and else a part whose class says so. Of several article elements one that holds more than two thirds
    of their text is the article and the others are cards. Inside the text only elements, roles and whole class names known to be none of it are left out; a
    class name that merely holds a telling word leaves its lines undecided.
    """
    out: list[Line] = []
    held: list[str] = []
    article, main, suspect = _Region(), _Region(), _Region()
    header = heading = real = False  # inside a header of the text, or a heading; whether the main part is a main element
    skip, depth = "", 0
    tags, at = Tags(page), 0

    def end() -> None:
        text = " ".join(entities.unescape("".join(held)).split())
        held.clear()
        if text:
            gone = bool(skip) or header and not heading and bool(article.at or main.at)
            out.append((text, gone, bool(suspect.at), article.at, main.at, real))

    while at < len(page):
        start, to, tag, closing, attrs = tags.next(at)
        held.append(page[at:start])
        if start == len(page):
            break
        at = to
        if tag is None:
            if page.startswith("<![CDATA[", start):
                held.append(entities.escape(page[start + 9 : to - 3]))
            continue
        if tag in RAW and not closing:
            m = re.compile(f"</{re.escape(tag)}(?![A-Za-z0-9])[^>]*>?", re.I).search(page, at)
            at = m.end() if m else len(page)
            continue
        if skip:
            if tag == skip:
                depth += -1 if closing else 0 if skip in SHORT else 1
                if depth <= 0 or not closing and skip in SHORT:
                    end()
                    skip = ""
                    if closing:
                        continue
                else:
                    if tag in BLOCK:
                        end()
                    continue
            elif skip in SHORT and (closing and tag in BLOCK or tag in BLOCK and tag not in SHORT and skip == "p"):
                end()
                skip = ""
            else:
                if tag in BLOCK:
                    end()
                elif tag in ("br", "td", "th"):
                    held.append(" ")
                continue
        if closing:
            if tag in BLOCK:
                end()
            if tag == "header":
                header = False
            if tag in HEADING:
                heading = False
            for region in (article, main, suspect):
                region.tagged(tag, True)
            continue
        if tag in BLOCK:
            end()
        elif tag in ("br", "td", "th"):
            held.append(" ")
        if tag in VOID:
            continue
        mark = _marks(tag, attrs)
        if tag == "header":
            if article.at or main.at:
                header, heading = True, False
                continue
            mark = "out"
        if tag in HEADING:
            heading = True
        if tag in OUT or mark == "out":
            if not attrs.rstrip().endswith("/"):
                skip, depth = tag, 1
            continue
        if suspect.at and suspect.tag in SHORT and tag in BLOCK:
            suspect.depth = 0  # such an element ends where the next block begins
        for region in (article, main, suspect):
            region.tagged(tag, False)
        if tag == "article" and not article.at:
            article.open(tag)
        elif (tag == "main" or mark == "main") and not (main.at and real):
            main.open(tag)
            real = True
        elif mark == "in" and not main.at and not article.at:
            main.open(tag)
            real = False
        elif mark == "suspect" and not suspect.at:
            suspect.open(tag)
    end()
    return _settled(out)


def shared(a: list, b: list) -> list[tuple[int, int]]:
    """A longest common subsequence of both as pairs of indices, ascending. Equal ends are matched first; the rest by whole numbers whose bits are b's items."""
    n, m = len(a), len(b)
    head = 0
    while head < min(n, m) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(n, m) - head and a[n - 1 - tail] == b[m - 1 - tail]:
        tail += 1
    know, have = set(b[head : m - tail]), set(a[head : n - tail])
    x = [k for k in range(head, n - tail) if a[k] in know]
    y = [k for k in range(head, m - tail) if b[k] in have]
    inner = _common([a[k] for k in x], [b[k] for k in y])
    return [(k, k) for k in range(head)] + [(x[i], y[j]) for i, j in inner] + [(n - k, m - k) for k in range(tail, 0, -1)]


def _rows(a: list, b: list) -> Iterator[int]:
    """For each prefix of a, the bits of b: a zero where the longest common subsequence with b's prefix grows."""
    where: dict = {}
    for k, t in enumerate(b):
        where[t] = where.get(t, 0) | 1 << k
    full = (1 << len(b)) - 1
    v = full
    for t in a:
        u = v & where.get(t, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def _common(a: list, b: list) -> list[tuple[int, int]]:
    if not a or not b:
        return []
    if len(a) * len(b) <= BITS or len(a) == 1:
        rows = [(1 << len(b)) - 1, *_rows(a, b)]
        out, i, j = [], len(a), len(b)
        zeros = lambda v, j: j - (v & (1 << j) - 1).bit_count()
        left = zeros(rows[i], j)
        while left:
            while zeros(rows[i - 1], j) == left:
                i -= 1
            j = (~rows[i] & (1 << j) - 1).bit_length() - 1
            i, left = i - 1, left - 1
            out.append((i, j))
        return out[::-1]
    # Too large a table: halve a, and cut b where both halves together have most in common.
    mid = len(a) // 2
    last = lambda a, b: list(np.append(0, np.cumsum(1 - np.unpackbits(np.frombuffer(_last(a, b).to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)].astype(np.int64))))
    one, two = np.array(last(a[:mid], b)), np.array(last(a[mid:][::-1], b[::-1]))[::-1]
    cut = int(np.argmax(one + two))
    return _common(a[:mid], b[:cut]) + [(i + mid, j + cut) for i, j in _common(a[mid:], b[cut:])]


def _last(a: list, b: list) -> int:
    v = 0
    for v in _rows(a, b):
        pass
    return v


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


Page = list[tuple[str, int]]


def differenced(own: Page, near: list[Page], usual: frozenset[int] = frozenset()) -> tuple[list[str], bool]:
    """The lines of own that its markup does not leave out, without those undecided ones that it shares with a neighbour; and whether a neighbour is mostly a copy.

    A line that the neighbour holds as its text stays. Of a neighbour that shares more than COPY of the undecided characters only the host's usual lines
    count, where the host has enough different pages to tell; where it has not, all of them, unless nothing would be left.
    """
    text = [t for t, _ in own]
    whole = sum(len(t) for t, m in own if m == OPEN_)
    gone: set[int] = set()
    copy = False
    for other in near if whole else ():
        both = {i for i, j in shared(text, [t for t, _ in other]) if own[i][1] == OPEN_ and other[j][1] != INSIDE}
        if sum(len(text[i]) for i in both) > COPY * whole:
            copy = True
            if usual:
                both = {i for i in both if _hash(text[i]) in usual}
            elif all(i in both for i, (_, m) in enumerate(own) if m != OUTSIDE):
                continue
        gone |= both
    return [t for i, (t, m) in enumerate(own) if m != OUTSIDE and i not in gone], copy


def _usual(rows: DataFrame) -> DataFrame:
    """Per host the hashes of undecided lines that stand on more than half of its different pages with such lines; hosts of fewer than PAGES such pages have none."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for host, page in zip(batch["host"].to_pylist(), batch["html"], strict=True):
                open_ = sorted({_hash(t) for t, m in lines(page.as_py()) if m == OPEN_})
                if open_:
                    out.append({"host": host, "page": _hash(repr(open_)), "lines": open_})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("host", pa.string()), ("page", pa.int64()), ("lines", pa.list_(pa.int64()))]))

    different = rows.filter("host <> ''").select("host", "html").mapInArrow(listed, "host string, page long, lines array<long>").groupBy("host", "page").agg(F.first("lines").alias("lines"))
    different = settle(different, "lines")
    of = different.groupBy("host").agg(F.count("*").alias("of")).filter(F.col("of") >= PAGES)
    often = different.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).filter("n > 1")
    return settle(often.join(of, "host").filter("2 * n > of").groupBy("host").agg(F.collect_list("line").alias("usual")), "usual")


def _pack(page: Page) -> bytes:
    """The separator is white space, which no line holds but single spaces."""
    return zlib.compress("\x1e".join(f"{m + 1}{t}" for t, m in page).encode(errors="surrogatepass"), 1) if page else b""


def _unpack(data: bytes) -> Page:
    return [(x[1:], int(x[0]) - 1) for x in zlib.decompress(data).decode(errors="surrogatepass").split("\x1e")] if data else []


KEY = ["host", "path", "sum"]
WHOLE = "page_id long, url string, host string, path string, sum long"
#: What became of a page: settled; a neighbour is mostly a copy of it; it has undecided lines and no neighbour.
SETTLED, COPIED, ALONE = 0, 1, 2
#: Opening tags with the class or id that they begin with: a page's template is the set of them.
SKELETON = r"""<[a-zA-Z][a-zA-Z0-9]*(?:\s+(?:class|id)\s*=\s*(?:"[^"]*"|'[^']*'))?"""


def _differenced(rows: DataFrame, usual: DataFrame | None = None) -> DataFrame:
    """(page_id, url, host, path, sum, text, state): one row for each different page, differenced with the pages before and after it in (host, path, sum)."""
    spark = rows.sparkSession
    keys = settle(rows.select(*KEY).distinct(), "keys")
    units = max(1, min(UNITS, keys.count() // UNIT))
    # The first and last key of each range: as many as units, whatever the input.
    ranged = keys.select(*KEY).repartitionByRange(units, *KEY).groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct(*KEY)).alias("a"), F.max(F.struct(*KEY)).alias("b"))
    held = spark.sparkContext.broadcast(sorted((tuple(r.a), tuple(r.b)) for r in ranged.collect()))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Parsed pages with their unit, and with a neighbouring one at its ends. Of rows with one URL and html a task passes on the first."""
        ends = held.value
        firsts, lasts = [a for a, _ in ends], {b: k for k, (_, b) in enumerate(ends)}
        seen: set[tuple] = set()
        for batch in batches:
            for a in range(0, batch.num_rows, TOGETHER):
                b, row, unit, core, data = batch.slice(a, TOGETHER), [], [], [], []
                for k, key in enumerate(zip(*(b[c].to_pylist() for c in KEY), strict=True)):
                    if key in seen:
                        continue
                    if len(seen) > 50_000:
                        seen.clear()
                    seen.add(key)
                    u = max(0, bisect.bisect_right(firsts, key) - 1)
                    also = [u - 1] * (u > 0 and key == firsts[u]) + [u + 1] * (key in lasts and u + 1 < len(ends))
                    row += [k] * (1 + len(also))
                    unit += [u, *also]
                    core += [True, *[False] * len(also)]
                    data += [_pack(lines(b["html"][k].as_py()))] * (1 + len(also))
                own = b.select(["page_id", "url", *KEY]).take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(unit, pa.int32()), pa.array(core, pa.bool_()), *own.columns, pa.array(data, pa.binary())], ["unit", "core", *own.schema.names, "data"])

    def difference(table: pa.Table) -> pa.Table:
        keys = list(zip(*(table[c].to_pylist() for c in KEY), strict=True))
        seq = sorted(range(len(keys)), key=lambda k: keys[k])
        seq = [k for at, k in enumerate(seq) if at == 0 or keys[k] != keys[seq[at - 1]]]  # what several tasks brought
        data, core = table["data"], table["core"].to_pylist()
        known = table["usual"] if "usual" in table.schema.names else None
        page = lambda k: _unpack(data[k].as_py())
        own, text, state, window = [], [], [], {}
        for at, k in enumerate(seq):
            near = [seq[j] for j in (at - 1, at + 1) if 0 <= j < len(seq) and keys[k][0] and keys[seq[j]][0] == keys[k][0]]
            window = {j: window[j] if j in window else page(j) for j in (k, *near)}
            if core[k]:
                said, copy = differenced(window[k], [window[j] for j in near], frozenset(known[k].as_py() or ()) if known is not None else frozenset())
                own.append(k)
                text.append("\n\n".join(said))
                state.append(COPIED if copy else ALONE if not near and any(m == OPEN_ for _, m in window[k]) else SETTLED)
        kept = table.select(["page_id", "url", *KEY]).take(pa.array(own, pa.int64()))
        return pa.Table.from_arrays([*kept.columns, pa.array(text, pa.string()), pa.array(state, pa.int32())], [*kept.schema.names, "text", "state"])

    units_of = rows.select("page_id", "url", *KEY, "html").mapInArrow(dealt, f"unit int, core boolean, {WHOLE}, data binary")
    if usual is not None:
        usual = usual.withColumnRenamed("host", "of")
        usual = F.broadcast(usual) if usual.count() <= BROADCAST else usual
        units_of = units_of.join(usual, F.col("host") == F.col("of"), "left").drop("of")
    return units_of.groupBy("unit").applyInArrow(difference, f"{WHOLE}, text string, state int")


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text (blocks joined by an empty line; empty if none) and n_chars.

    Different pages (by host, path and a hash of the html) are sorted by host, path and hash into units of about UNIT; a unit also gets the last page before it
    and the first after it, so a page's two neighbours are the same however the rows are dealt. A large host spans many units, and copies of a page are
    differenced once: rows with the same URL and html get the same text. A page is parsed once, unless a neighbour is mostly a copy of it (then its host is
    differenced again with the lines that are usual there) or its host has no other page and its markup leaves lines undecided: then its
    neighbours are the pages of other such hosts with the same set of tags and classes; without any it keeps those lines. Pages of any length are read
    whole, a page being one task's; beyond UNIT * UNITS pages units grow. A null html is empty; a null URL or one without a host has no neighbours. Rows keep
    their repeats; an empty table gives no rows; other columns, whatever their names, are not read.
    """
    spark = pages.sparkSession
    modest_batches(spark)
    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.select("*", F.coalesce(urls.host_of(url), F.lit("")).alias("host"), F.coalesce(urls.path_of(url), F.lit("")).alias("path"), F.xxhash64("html").alias("sum"))
    repeated = settle(rows.groupBy(*KEY).agg(F.count("*").alias("rows")).filter("rows > 1").select(*KEY), "repeated")  # written, so that Spark knows its size
    first = settle(_differenced(rows), "first")
    states = {r.state for r in first.select("state").distinct().collect()}
    texts = first.filter(F.col("state") == SETTLED) if states - {SETTLED} else first
    if COPIED in states:
        some = rows.join(settle(first.filter(F.col("state") == COPIED).select("host").distinct(), "hosts"), "host", "left_semi")
        texts = texts.unionByName(_differenced(some, _usual(some)).filter(F.col("state") == COPIED))
    if ALONE in states:
        lone = settle(first.filter((F.col("state") == ALONE) & (F.col("host") != "")).select(*KEY), "lone")
        skeleton = F.concat(F.lit("<"), F.hex(F.xxhash64(F.array_sort(F.array_distinct(F.regexp_extract_all("html", F.lit(SKELETON), F.lit(0)))))))
        # A template's pages are sorted by host and path; <, which no host holds, tells templates from hosts.
        again = rows.join(lone, KEY, "left_semi").select("page_id", "url", "html", skeleton.alias("host"), F.concat_ws("/", "host", "path").alias("path"), "sum", F.col("host").alias("own_host"), F.col("path").alias("own_path"))
        names = again.select(*KEY, "own_host", "own_path").distinct()
        met = _differenced(again).drop("state").join(names, KEY).select("page_id", "url", F.col("own_host").alias("host"), F.col("own_path").alias("path"), "sum", "text", F.lit(ALONE).alias("state"))
        texts = texts.unionByName(met).unionByName(first.filter((F.col("state") == ALONE) & (F.col("host") == "")))
    out = texts.select("page_id", "url", "text")
    if not repeated.isEmpty():  # a page's copies get its text by a join, so that no unit holds them all
        copies = rows.select("page_id", "url", *KEY).join(repeated, KEY, "left_semi").join(texts.select(*KEY, "text").join(repeated, KEY, "left_semi"), KEY)
        out = texts.join(repeated, KEY, "left_anti").select("page_id", "url", "text").unionByName(copies.select("page_id", "url", "text"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
