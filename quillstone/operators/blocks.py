"""Chunks from a document's blocks: whole blocks packed inside a page, sections, paragraphs that run over a page's end, overlaps, and a second pass for a token window.

What a block needs to know of those before it (its section, whether the page before ends unfinished) comes from folds over ranges. They cut a document into
chains: pages that a paragraph joins, mostly one. A chain is packed in one ordered pass that holds a chunk at a time, so a document of any number of pages
is many small tasks' work.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text, tokens
from ..sources.stages import staged
from . import chunking
from .ordered import folded, ranged

# What ends a paragraph, a line that is a page number, a running footer, its longest form; a section title's length; rectangles of a highlight.
TERMINAL = r"[.!?؟。！？…][\"'”’)\]»]*$"
PAGE_NUMBER = r"(?iu)^[\s\p{P}\p{S}]*(?:(?:page|pg|p|صفحة|ص)[\s.:]*)?\p{Nd}{1,4}(?:\s*(?:/|of|من)\s*\p{Nd}{1,4})?[\s\p{P}\p{S}]*$"
FOOTER = r"^(?:.{0,40}[|—–·•/-]\s*\p{Nd}{1,4}|\p{Nd}{1,4}\s*[|—–·•/-].{0,40})$"
FURNITURE, TITLE, RECTS = 48, 160, 60
GAP = "\n\n"
#: What ends a sentence before its white space.
ENDING = ".!?؟。…'\")]"
LETTERS = re.compile(r"[^\W\d_]+")


def ends_paragraph(c: Column) -> Column:
    """Whether a block's text ends as paragraphs do: with a final mark, or with a short line that is a page number or a running footer, as scans have them."""
    whole = F.regexp_replace(c, r"\s+$", "")
    last = F.trim(F.substring_index(whole, "\n", -1))
    return whole.rlike(TERMINAL) | ((F.length(last) <= FURNITURE) & (last.rlike(PAGE_NUMBER) | last.rlike(FOOTER)))


def chained(blocks: DataFrame) -> DataFrame:
    """Blocks with text, with the section that their page begins in and the chain of pages that they stand in.

    Both are a page's matter, so the folds run over a row for each page and no text is in them.
    """
    title = F.when(F.col("heading"), F.coalesce("title", "text")).otherwise(F.col("title"))
    clean = F.substring(F.trim(F.regexp_replace(title, r"\s+", " ")), 1, TITLE)
    rows = staged(blocks.filter(F.col("text").rlike(r"\S")).withColumns({"title": clean, "ends": ends_paragraph(F.col("text"))}).drop("heading"), "blocks")
    titled = F.max_by("title", F.when(F.col("title").isNotNull(), F.col("block")))
    pages = rows.groupBy("doc", "page").agg(F.min(F.struct("block", F.col("title").isNotNull().alias("named"))).alias("first"), titled.alias("titled"), F.max(F.struct("block", "ends")).alias("end"))
    key = ["doc"], ["page"]
    pages = folded(ranged(pages, *key, "pages"), *key, last={"upto": F.col("titled")}, former={"was": F.col("end.ends")})
    runs_on = ~F.col("was") & (F.col("first.block") == 0) & ~F.col("first.named")
    pages = folded(pages, *key, sums={"chain": (F.col("was").isNull() | ~runs_on).cast("int")}, former={"section": F.col("upto")})
    of = pages.select(F.col("doc").alias("_doc"), F.col("page").alias("_page"), "chain", "section")
    return rows.join(of, F.col("doc").eqNullSafe(F.col("_doc")) & F.col("page").eqNullSafe(F.col("_page"))).drop("_doc", "_page")


class _Limits:
    def __init__(self, target: int, most: int, least: int, overlap: int, window: int | None):
        self.target, self.most, self.least, self.overlap, self.window = target, most, least, overlap, window

    def count(self, text: str) -> tokens.Counted | None:
        """The tokens of a text's stretches, where a window asks for them."""
        return None if self.window is None else tokens.Counted(text)

    def fit(self, a: int, b: int, counted: tokens.Counted | None) -> bool:
        """Whether a stretch of a text fits."""
        return b - a <= self.most and (counted is None or self.small(counted.hundredths(a, b)))

    def small(self, hundredths: int) -> bool:
        return self.window is None or hundredths <= 100 * self.window


def _trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    part = text[a:b]
    return a + len(part) - len(part.lstrip()), b - len(part) + len(part.rstrip())


def _fitting(text: str, a: int, b: int, limits: _Limits, counted: tokens.Counted | None) -> Iterator[tuple[int, int]]:
    """A stretch halved, at a clause or space if it has one, until its parts fit."""
    if b - a < 2 or limits.fit(a, b, counted):
        yield a, b
        return
    for x, y in chunking.pieces(text, a, b, max(1, min(limits.most, (b - a + 1) // 2))):
        yield from _fitting(text, x, y, limits, counted)


def _parts(text: str, limits: _Limits, counted: tokens.Counted | None) -> list[tuple[int, int]]:
    """A block that does not fit as parts of whole sentences up to the target."""
    if limits.fit(0, len(text), counted):
        return [(0, len(text))]
    out: list[tuple[int, int]] = []
    for a, b in chunking.sentences(text, limits.most):
        for x, y in _fitting(text, *_trimmed(text, a, b), limits, counted):
            x, y = _trimmed(text, x, y)
            if x == y:
                continue
            if out and y - out[-1][0] <= limits.target and limits.fit(out[-1][0], y, counted):
                out[-1] = (out[-1][0], y)
            else:
                out.append((x, y))
    return out


class _Draft:
    """A chunk in the making: its stretches, one a page, with their texts, the units of each language and, where a window asks for them, its hundredths of a token."""

    __slots__ = ("closed", "ends", "languages", "lead", "section", "size", "spans", "titled")

    def __init__(self, section: str | None, titled: bool, lead: str):
        self.section, self.titled, self.closed, self.ends = section, titled, False, True
        self.lead = lead  # the white space between the draft before and this one, on one page
        self.size = 0
        self.spans: list[tuple[int, int, int, str]] = []
        self.languages: dict[str, list[str]] = {}

    def text(self) -> str:
        return GAP.join(s[3] for s in self.spans)

    def with_unit(self, unit: tuple[int, int, int, str], lead: str) -> list[tuple[int, int, int, str]]:
        """The stretches with one more unit: on the same page the last one grows over the white space ``lead`` between."""
        page, a, b, text = unit
        if self.spans and self.spans[-1][0] == page:
            _, start, _, held = self.spans[-1]
            return [*self.spans[:-1], (page, start, b, held + lead + text)]
        return [*self.spans, (page, a, b, text)]

    def joined(self, spans: list[tuple[int, int, int, str]]) -> str:
        return GAP.join(s[3] for s in spans)

    def size_with(self, lead: str, text: str, size: int, whole: str) -> int:
        """The hundredths with one more text behind ``lead``: a sum, as blanks part runs."""
        return self.size + len(lead) * fixed.BLANK + size + tokens.lead(text) if tokens.blank(lead) else tokens.hundredths(whole)

    def language(self) -> str:
        """The known language of most letters, the first of equals; letters are counted only where there are several."""
        known = {k: v for k, v in self.languages.items() if k != "und"}
        if len(known) < 2:
            return next(iter(known), "und")
        return max(known, key=lambda k: sum(len(w) for text in known[k] for w in LETTERS.findall(text)))


def packed(rows: Iterator[dict], limits: _Limits) -> Iterator[_Draft]:
    """The drafts of one chain, whose blocks come in order.

    A titled block opens a chunk. Blocks are packed while the target holds; another page opens a chunk unless the paragraph before is unfinished, the block is its
    page's first and both fit together: then the chunk takes it and is closed. A chunk shorter than the least joins the one before if both stand on one page
    and in one section.
    """
    last: _Draft | None = None  # complete, but a small one may still join it
    now: _Draft | None = None

    def done(new: _Draft) -> Iterator[_Draft]:
        nonlocal last
        if last is not None:
            same = len(new.spans) == len(last.spans) == 1 and new.spans[0][0] == last.spans[0][0] and new.section == last.section
            if same and not new.titled and len(new.text()) < limits.least:
                spans = last.with_unit(new.spans[0], new.lead)
                whole = last.joined(spans)
                size = last.size if limits.window is None else last.size_with(new.lead, new.text(), new.size, whole)
                if len(whole) <= limits.most and limits.small(size):
                    last.spans, last.size = spans, size
                    for language, texts in new.languages.items():
                        last.languages.setdefault(language, []).extend(texts)
                    return
            yield last
        last = new

    at = (None, 0)  # page and end of the last unit
    on, section = (), None
    for r in rows:
        if on != (r["page"],):
            on, section = (r["page"],), r["section"]
        if r["title"] is not None:
            section = r["title"]
        counted = limits.count(r["text"])
        for k, (a, b) in enumerate(_parts(r["text"], limits, counted)):
            unit_start = r["char_start"] + a
            lead = r["text"][at[1] - r["char_start"] : a] if k else "\n" * (unit_start - at[1]) if at[0] == r["page"] else ""
            at = r["page"], r["char_start"] + b
            piece, titled = r["text"][a:b], k == 0 and r["title"] is not None
            unit = (r["page"], unit_start, r["char_start"] + b, piece)
            own = counted.hundredths(a, b) if counted is not None else 0
            opens = now is None or titled
            if not opens:
                spans = now.with_unit(unit, lead)
                whole = now.joined(spans)
                crosses = now.spans[-1][0] != r["page"]
                opens = now.ends or r["block"] != 0 or k > 0 if crosses else now.closed or len(whole) > limits.target
                size = 0 if opens or counted is None else now.size_with(GAP if crosses else lead, piece, own, whole)
                opens = opens or len(whole) > limits.most or not limits.small(size)
                if not opens:
                    now.spans, now.size, now.closed = spans, size, now.closed or crosses
            if opens:
                if now is not None:
                    yield from done(now)
                now = _Draft(section, titled, lead)
                now.spans, now.size = [unit], own
            now.ends = r["ends"]
            now.languages.setdefault(r["language"] or "und", []).append(piece)
    if now is not None:
        yield from done(now)
    if last is not None:
        yield last


def _tails(text: str, limits: _Limits) -> list[str]:
    """The ends of a text that are whole sentences and no longer than the overlap, longest first."""
    if limits.overlap <= 0:
        return []
    at = max(0, len(text) - limits.overlap)
    while at and (text[at - 1].isspace() or text[at - 1] in ENDING):  # so that no sentence's end lies across
        at -= 1
    cuts = [at, *(m.end() for m in chunking.SENTENCE.finditer(text, at)), len(text)]
    starts = [a for a, b in (_trimmed(text, *s) for s in zip(cuts, cuts[1:], strict=False)) if a < b and len(text) - a <= limits.overlap]
    # The first stretch begins no sentence unless the text does.
    return [t for t in (text[a:].strip() for a in starts if not at or a >= cuts[1]) if t]


def _room(tails: list[str], own: str, size: int, limits: _Limits) -> list[dict]:
    """The first tail that a chunk of ``size`` hundredths has room for, if any."""
    for t in tails:
        if len(t) + len(GAP) + len(own) <= limits.most:
            n = tokens.hundredths(t)
            if limits.small(size + tokens.lead(own) + n + 2 * fixed.BLANK):
                return [{"text": t, "tokens": n}]
    return []


_SPAN = pa.struct([("page", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
_TAIL = pa.struct([("text", pa.string()), ("tokens", pa.int64())])
_OUT = {
    "section": pa.string(), "language": pa.string(), "page_start": pa.int64(), "page_end": pa.int64(), "char_start": pa.int64(), "char_end": pa.int64(), "spans": pa.list_(_SPAN), "own": pa.string(),
    "tokens": pa.int64(), "set_off": pa.int64(), "tails": pa.list_(_TAIL), "ending": pa.list_(_TAIL), "place": pa.int64(),
}
#: Drafts handed on at a time.
DRAFTS = 500


def _drafts(chains: DataFrame, key: str, group: list[str], limits: _Limits) -> DataFrame:
    """Each chain's drafts, with ``key`` and ``doc``, in ranges of (doc, key) that are read in order, a chain after another.

    ``place`` counts the drafts of a group inside a range, ``tails`` holds the one of the draft before, of the same section, that there is room for, and ``ending`` are the own ones of a range's last draft.
    """
    kind = chains.schema[key].dataType.simpleString()
    doc = chains.schema["doc"].dataType.simpleString()
    rows = chains.select("doc", key, "page", "block", "text", "char_start", "title", "section", "ends", "language")
    rows = rows.repartitionByRange("doc", key).sortWithinPartitions("doc", key, "page", "block")
    tails = "array<struct<text: string, tokens: long>>"
    schema = f"doc {doc}, {key} {kind}, section string, language string, page_start long, page_end long, char_start long, char_end long, spans array<struct<page: long, start: long, end: long>>, own string, tokens long, set_off long, tails {tails}, ending {tails}, place long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: dict[str, pa.DataType] = {}

        def each() -> Iterator[dict]:
            for batch in batches:
                types.update({"doc": batch["doc"].type, key: batch[key].type})
                for k in range(0, batch.num_rows, 256):
                    yield from batch.slice(k, 256).to_pylist()

        def chain(first: dict, rest: Iterator[dict], ahead: list[dict]) -> Iterator[dict]:
            yield first
            for r in rest:
                if (r["doc"], r[key]) != (first["doc"], first[key]):
                    ahead.append(r)
                    return
                yield r

        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            own = {**types, **_OUT}
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in own.items()], list(own))

        rest, out = each(), []
        ahead = [r for r in [next(rest, None)] if r is not None]
        was: _Draft | None = None
        of, place, own = (), 0, ""
        while ahead:
            first = ahead.pop()
            for d in packed(chain(first, rest, ahead), limits):
                here = tuple(first[c] for c in group)
                tails = _tails(own, limits) if was is not None and here == of and was.section == d.section else []
                own, place = d.text(), place + 1 if here == of and was is not None else 1
                was, of = d, here
                size = tokens.hundredths(own) if limits.window is None else d.size
                if len(out) >= DRAFTS:
                    yield batch_of(out)
                    out = []
                out.append({
                    "doc": first["doc"], key: first[key], "section": d.section, "language": d.language(), "page_start": d.spans[0][0], "page_end": d.spans[-1][0], "char_start": d.spans[0][1], "char_end": d.spans[-1][2],
                    "spans": [{"page": p, "start": a, "end": b} for p, a, b, _ in d.spans], "own": own, "tokens": size, "set_off": tokens.lead(own),
                    "tails": _room(tails, own, size, limits), "ending": None, "place": place,
                })
        if out:
            out[-1]["ending"] = [{"text": t, "tokens": tokens.hundredths(t)} for t in _tails(own, limits)]
            yield batch_of(out)

    return rows.mapInArrow(run, schema)


def _finished(drafts: DataFrame, group: list[str], limits: _Limits) -> DataFrame:
    """Drafts with their index, and the longest tail of the chunk before, of the same section, that the limits leave room for."""
    rows = staged(drafts.withColumn("_part", F.spark_partition_id()), "drafts")
    # What a range hands on to the next one of its last group: how many drafts, and the last one's section and tails. A row for each range at most.
    parts = Window.partitionBy(*group).orderBy("_part")
    ends = rows.groupBy("_part", *group).agg(F.max("place").alias("n"), F.max_by(F.struct("section", "ending"), "place").alias("was"))
    before = F.sum("n").over(parts.rowsBetween(Window.unboundedPreceding, -1))
    carry = ends.select(F.col("_part").alias("_p"), *[F.col(g).alias(f"_{g}") for g in group], before.alias("before"), F.lag("was").over(parts).alias("was")).filter("before IS NOT NULL")
    same = F.col("_part") == F.col("_p")
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"_{g}"))
    rows = rows.join(F.broadcast(carry), same, "left")
    cost = lambda t: F.ceil((F.col("tokens") + F.col("set_off") + t["tokens"] + 2 * fixed.BLANK) / 100)
    room = lambda t: (F.length(t["text"]) + len(GAP) + F.length("own") <= limits.most) & (F.lit(True) if limits.window is None else cost(t) <= limits.window)
    carried = F.when(F.col("was").isNotNull() & F.col("was.section").eqNullSafe(F.col("section")), F.col("was.ending"))
    tail = F.get(F.filter(F.when(F.col("place") == 1, carried).otherwise(F.col("tails")), room), 0)
    rows = rows.withColumn("tail", tail)
    prefix = F.coalesce(F.concat("tail.text", F.lit(GAP)), F.lit(""))
    whole = F.when(F.col("tail").isNotNull(), cost(F.col("tail"))).otherwise(F.ceil(F.col("tokens") / 100))
    index = F.col("place") + F.coalesce("before", F.lit(0)) - 1
    rows = rows.withColumns({"chunk_index": index.cast("long"), "content": F.concat(prefix, "own"), "overlap_chars": F.length(prefix).cast("long"), "token_count": whole.cast("long")})
    return rows.drop("was", "before", "tail", "tails", "ending", "place", "_part", "_p", *[f"_{g}" for g in group], "tokens", "set_off")


CHUNK = ["doc", "chunk_index", "page_start", "page_end", "section", "language", "char_start", "char_end", "overlap_chars", "token_count", "spans", "content"]


def _blocks(blocks: DataFrame) -> DataFrame:
    """The columns of blocks, those that may be missing filled in."""
    empty = {"heading": F.lit(False), "title": F.lit(None).cast("string"), "language": F.lit("und")}
    have = {c: F.col(c) if c in blocks.columns else v for c, v in empty.items()}
    return blocks.select("doc", F.col("page").cast("long").alias("page"), F.col("block").cast("long").alias("block"), "text", F.col("char_start").cast("long").alias("char_start"), F.coalesce(have["heading"], F.lit(False)).alias("heading"), have["title"].alias("title"), F.coalesce(have["language"], F.lit("und")).alias("language"))


def chunked(blocks: DataFrame, target: int = fixed.CHUNK_TARGET, most: int = fixed.CHUNK_MAX, least: int = fixed.CHUNK_MIN, overlap: int = fixed.CHUNK_OVERLAP, window: int | None = None) -> DataFrame:
    """Chunks of documents' blocks (doc, page, block from 0 on each page, text, char_start in the page's text; heading, title and language if there are any).

    Returns doc, chunk_index, page_start, page_end, section, language, char_start, char_end (own text, in its first and last page), overlap_chars, token_count, spans
    (own text, a stretch a page) and content: the overlap, a blank line and the own text. A block with ``title`` that is no heading starts a section too.
    Between the blocks of a page stand newlines alone. No chunk is longer than ``most`` characters or, where given, ``window`` tokens, but a single character. Blocks
    without text are left out, documents without any have no chunks; a null doc is a document.
    """
    limits = _Limits(target, most, least, overlap, window)
    drafts = _drafts(chained(_blocks(blocks)), "chain", ["doc"], limits)
    return _finished(drafts.drop("chain"), ["doc"], limits).select(*CHUNK)


def windowed(chunks: DataFrame, blocks: DataFrame, window: int, target: int = fixed.CHUNK_TARGET, most: int = fixed.CHUNK_MAX, least: int = fixed.CHUNK_MIN, overlap: int = fixed.CHUNK_OVERLAP) -> DataFrame:
    """chunks with those of more than ``window`` tokens cut again, by sentences that fit it, and all renumbered.

    A cut chunk's blocks are clipped to its stretches and chunked anew, each piece with the chunk's section; the first keeps the chunk's own overlap if that still fits.
    """
    limits = _Limits(target, most, least, overlap, window)
    held = staged(chunks, "chunks")
    large = held.filter(F.col("token_count") > window)
    stretch = large.select("doc", F.col("chunk_index").alias("of"), "section", F.explode("spans").alias("s")).select("doc", "of", "section", F.col("s.page").alias("page"), F.col("s.start").alias("from"), F.col("s.end").alias("to"))
    parts = stretch.join(_blocks(blocks), ["doc", "page"]).filter((F.col("char_start") < F.col("to")) & (F.col("char_start") + F.length("text") > F.col("from")))
    start = F.greatest("char_start", "from")
    clipped = F.substring("text", (start - F.col("char_start") + 1).cast("int"), (F.least(F.col("char_start") + F.length("text"), "to") - start).cast("int"))
    first = F.col("char_start") <= F.col("from")  # a stretch begins inside a block
    clean = parts.select("doc", "of", "page", F.when(first, 0).otherwise(F.col("block") + 1).alias("block"), clipped.alias("text"), start.alias("char_start"), F.lit(None).cast("string").alias("title"), "section", ends_paragraph(clipped).alias("ends"), "language")
    pieces = _finished(_drafts(clean, "of", ["doc", "of"], limits), ["doc", "of"], limits)
    keep = large.select("doc", F.col("chunk_index").alias("of"), F.substring("content", F.lit(1), F.col("overlap_chars").cast("int")).alias("prefix"))
    pieces = pieces.join(keep, ["doc", "of"])
    whole = F.concat("prefix", "content")
    heads = (F.col("chunk_index") == 0) & (F.length("prefix") > 0) & (F.length(whole) <= most)
    counted = pieces.withColumn("whole", F.when(heads, whole))
    counted = counted.mapInArrow(_recounted(window), counted.schema)
    pieces = counted.withColumns({"overlap_chars": F.when(F.col("whole").isNotNull(), F.length("prefix") + F.col("overlap_chars")).otherwise(F.col("overlap_chars")).cast("long"), "content": F.coalesce("whole", "content"), "piece": F.col("chunk_index")})
    pieces = staged(pieces, "pieces")
    # How many chunks come of each: new numbers are sums of these, without the texts.
    counts = pieces.groupBy("doc", "of").agg(F.count("*").alias("n"))
    old = held.select("doc", F.col("chunk_index").alias("of"), (F.col("token_count") > window).alias("cut"))
    key = ["doc"], ["of"]
    counts = old.join(counts.withColumnsRenamed({"doc": "_doc", "of": "_of"}), F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("of") == F.col("_of")), "left")
    size = F.when(F.col("cut"), F.coalesce("n", F.lit(0))).otherwise(1)
    upto = folded(ranged(counts.select("doc", "of", size.alias("n")), *key, "windowed"), *key, sums={"upto": F.col("n")})
    first = upto.select(F.col("doc").alias("_doc"), F.col("of").alias("_of"), (F.col("upto") - F.col("n")).alias("first"))
    rest = held.filter(F.col("token_count") <= window).withColumns({"of": F.col("chunk_index"), "piece": F.lit(0).cast("long")})
    names = [c for c in CHUNK if c != "chunk_index"]
    every = rest.select("of", "piece", *names).unionByName(pieces.select("of", "piece", *names))
    every = every.join(first, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("of") == F.col("_of")))
    return every.withColumn("chunk_index", (F.col("first") + F.col("piece")).cast("long")).select(*CHUNK)


def _recounted(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``whole`` and its tokens where they fit the window, else null and the piece's own."""
        for batch in batches:
            whole, count = batch["whole"].to_pylist(), batch["token_count"].to_pylist()
            for k, t in enumerate(whole):
                if t is not None:
                    n = tokens.estimate(t)
                    whole[k], count[k] = (t, n) if n <= window else (None, count[k])
            columns = {n: batch[n] for n in batch.schema.names} | {"whole": pa.array(whole, pa.string()), "token_count": pa.array(count, pa.int64())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def searchable(chunks: DataFrame) -> DataFrame:
    """chunks with direction and search_text of their own text."""
    own = F.substring("content", (F.col("overlap_chars") + 1).cast("int"), F.length("content"))
    return chunks.withColumns({"direction": text.direction(own), "search_text": text.match_form(own)})


#: Characters of a page in which lines and chunks meet.
CELL = 1000


def highlights(chunks: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc, chunk_index, page, rects): rectangles x, y, w, h of the lines (doc, page, char_start, char_end, x, y, w, h) that a chunk covers, each once; beyond 60 their union.

    Lines meet chunks in the cells of their page that both touch, so a page's lines are not all compared with all its chunks.
    """
    cell = lambda c: F.floor(F.col(c) / CELL)
    celled = lambda rows, a, b: rows.withColumn("cell", F.explode(F.sequence(cell(a), F.greatest(cell(a), F.floor((F.col(b) - 1) / CELL)))))
    spans = chunks.select("doc", "chunk_index", F.explode("spans").alias("s")).select("doc", "chunk_index", F.col("s.page").alias("page"), F.col("s.start").alias("from"), F.col("s.end").alias("to"))
    met = celled(lines, "char_start", "char_end").join(celled(spans, "from", "to"), ["doc", "page", "cell"])
    # A pair that shares several cells counts in the first of them.
    hit = met.filter((F.col("char_end") > F.col("from")) & (F.col("char_start") < F.col("to")) & (F.col("cell") == F.greatest(cell("char_start"), cell("from"))))
    found = hit.groupBy("doc", "chunk_index", "page").agg(F.sort_array(F.collect_set(F.struct("y", "x", "w", "h"))).alias("r"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + F.col("w")).alias("x1"), F.max(F.col("y") + F.col("h")).alias("y1"))
    each = F.transform("r", lambda r: F.struct(r["x"].alias("x"), r["y"].alias("y"), r["w"].alias("w"), r["h"].alias("h")))
    one = F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y"), (F.col("x1") - F.col("x0")).alias("w"), (F.col("y1") - F.col("y0")).alias("h")))
    return found.select("doc", "chunk_index", "page", F.when(F.size("r") > RECTS, one).otherwise(each).alias("rects"))
