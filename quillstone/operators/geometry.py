"""Pages from placed text: words into lines, lines into logical text of either direction, lines into blocks with exact offsets, headings; and recognised lines likewise.

Lines are found, measured and read in one ordered pass over their words; windows and an aggregate inside a page find the blocks. The columns of placed words are page, x0, x1,
baseline, size, bold, horizontal, text.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import text as T
from ..sources.stages import staged

# Fixed values, in font sizes: a line's height tolerance, the gap of a space, of a table; leading by default and at least; and its quantile.
BASELINE, WORD_GAP, TABLE_GAP, LEADING, LEAST_LEADING, QUANTILE = 0.5, 0.25, 3.0, 1.2, 0.9, 0.25
# Leadings to a new paragraph and above a bold heading; a change of size; a heading's size, lines, characters and width as a share of the body's.
PARAGRAPH, BOLD_GAP, SIZE_CHANGE, HEADING_SIZE, HEADING_LINES, HEADING_CHARS, SHORT, BOLD = 1.4, 1.5, 1.15, 1.2, 2, 120, 0.6, 0.8
# A heading's first word, a list's marker, and from which confidence a recognised line counts.
NAMED = r"(?iu)^(?:chapter|part|section|appendix|الفصل|الباب|المبحث|مقدمة|خاتمة)(?![\p{L}\p{N}_])"
MARKER = r"^(?:\(?[0-9٠-٩۰-۹]+[.)]\s|[•●▪◦*\-–—]\s)"
CONFIDENT = 15
RTL = r"\p{IsArabic}\p{IsHebrew}\p{IsSyriac}\p{IsThaana}\p{IsNko}"


def _towards(rtl: Column, ltr: Column) -> Column:
    """R or L by the more letters, null without any."""
    return F.when(rtl + ltr == 0, F.lit(None)).when(rtl > ltr, "R").otherwise("L")


def _lettered(words: DataFrame) -> DataFrame:
    """words with text, with their letters, those of the right-to-left scripts, and whether they have a digit; all null where they are ASCII, as ``_sides`` counts those."""
    wide = F.octet_length("text") != F.length("text")
    counts = {"letters": T.count_of(F.col("text"), r"\p{L}"), "rtl": T.count_of(F.col("text"), RTL), "digit": F.col("text").rlike(r"\p{Nd}")}
    return words.filter("text <> ''").withColumns({k: F.when(wide, c) for k, c in counts.items()})


_CODES = np.arange(256)
_LETTER = (_CODES >= 65) & (_CODES <= 90) | (_CODES >= 97) & (_CODES <= 122)
_DIGIT = (_CODES >= 48) & (_CODES <= 57)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 of all texts, and where each begins and the last ends."""
    texts = texts.cast(pa.string())
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], (at - at[0]).astype(np.int64)


def _sides(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word's letters of right-to-left scripts and of others, and its direction: R or L by its letters, L if it has digits alone, else None."""
    data, at = _bytes(batch["text"])
    count = lambda kind: np.diff(np.append(0, np.cumsum(kind[data]))[at])
    wide = batch["letters"].is_valid().to_numpy(zero_copy_only=False)
    told = lambda c, own: np.where(wide, pc.fill_null(batch[c].cast(pa.int64()), 0).to_numpy(), own)
    letters, rtl, digits = told("letters", count(_LETTER)), told("rtl", 0), told("digit", count(_DIGIT))
    ltr = letters - rtl
    return rtl, ltr, np.where(letters > 0, np.where(rtl > ltr, "R", "L"), np.where(digits > 0, "L", None))


def _differs(c: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before; nulls are equal."""
    a, b = c.slice(1), c.slice(0, max(0, len(c) - 1))
    return (pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False) | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))).astype(bool)


def _lined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words down their pages with ``line``: a line ends where the next word's baseline is lower by more than half the smaller of the two sizes; a rotated word is a line of its own."""
    page, was, small, number = (), np.nan, np.nan, -1
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        y, size = (batch[c].to_numpy(zero_copy_only=False).astype(float) for c in ("baseline", "size"))
        new = np.append(page != (batch["page"][0].as_py(),), _differs(batch["page"]))
        before = np.append(small, size[:-1])
        lower = y - np.append(was, y[:-1]) > BASELINE * np.fmin(size, before)
        opens = new | np.isnan(before) | ~pc.fill_null(batch["horizontal"], True).to_numpy(zero_copy_only=False).astype(bool) | lower
        count = np.cumsum(opens)
        start = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        line = count - np.where(start >= 0, count[start], -number)
        page, was, small, number = (batch["page"][n - 1].as_py(),), y[-1], size[-1], int(line[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(line, pa.int64())], [*batch.schema.names, "line"])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Whole lines of words, each from left to right, and where each line begins."""
    held = None

    def ordered(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray]:
        new = np.append(True, _differs(batch["page"]) | _differs(batch["line"]))
        x0, x1, line = batch["x0"].to_numpy(zero_copy_only=False), batch["x1"].to_numpy(zero_copy_only=False), np.cumsum(new)
        order = np.lexsort((x1, x0, line))
        a, b = order[:-1], order[1:]
        if ((line[a] == line[b]) & (x0[a] == x0[b]) & (x1[a] == x1[b])).any():
            text = batch["text"].to_pylist()
            order = np.array(sorted(order.tolist(), key=lambda k: (line[k], x0[k], x1[k], text[k])))
        return batch if (order[:-1] < order[1:]).all() else batch.take(pa.array(order)), np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        held = batch if held is None else pa.concat_batches([held, batch])
        new = np.flatnonzero(_differs(held["page"]) | _differs(held["line"]))
        if len(new):
            cut = int(new[-1]) + 1
            yield ordered(held.slice(0, cut))
            held = held.slice(cut)
    if held is not None:
        yield ordered(held)


def assembled(words: DataFrame) -> DataFrame:
    """(page, line, text): the words of each line in the order they are read. Needs ``line`` and ``base``, the line's direction, R or L.

    A word is R or L by its letters; digits alone are L. A neutral word takes the direction of its neighbours where both sides agree, else the base. Words of
    one direction form runs; runs follow each other in the base's direction, an R run's words from right to left. The words' own characters are in logical
    order already; brackets of R runs were drawn mirrored and are turned back. A gap wider than a quarter of the size is a space.
    """
    rows = _lettered(words).select("page", "line", "base", *PLACED, *LETTERS).repartition("page", "line").sortWithinPartitions("page", "line")
    schema = StructType([rows.schema["page"], rows.schema["line"], StructField("text", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, first in _gathered(batches):
            said = _texts([*[batch[c] for c in PLACED], pa.array(_sides(batch)[2], pa.string())], [*first.tolist(), batch.num_rows], batch["base"].take(pa.array(first)).to_pylist())
            yield pa.RecordBatch.from_arrays([batch["page"].take(pa.array(first)), batch["line"].take(pa.array(first)), pa.array(said, pa.string())], ["page", "line", "text"])

    return rows.mapInArrow(run, schema)


#: What the reading of a line asks of its words.
PLACED, LETTERS = ["x0", "x1", "size", "text"], ["letters", "rtl", "digit"]
WORD = [*PLACED, "strong"]


def _texts(columns: list[pa.Array], cuts: list[int], bases: list[str | None]) -> list[str]:
    rows = list(zip(*[c.to_numpy(zero_copy_only=False).tolist() for c in columns], strict=True))
    return [_said(rows[a:b], base) for a, b, base in zip(cuts, cuts[1:], bases, strict=False)]


def _read(lines: DataFrame) -> DataFrame:
    """Lines with ``words``, ``base`` and any other columns: the words give way to their text."""
    schema = StructType([*[f for f in lines.schema.fields if f.name != "words"], StructField("text", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, cuts = batch["words"].flatten(), np.cumsum([0, *pc.list_value_length(batch["words"]).to_pylist()]).tolist()
            said = _texts([words.field(words.type.get_field_index(n)) for n in WORD], cuts, batch["base"].to_pylist())
            names = [n for n in batch.schema.names if n != "words"]
            yield pa.RecordBatch.from_arrays([*[batch[n] for n in names], pa.array(said, pa.string())], [*names, "text"])

    return lines.mapInArrow(run, schema)


def _straight(batch: pa.RecordBatch, first: np.ndarray) -> pa.Array:
    """The texts of lines as they read from left to right: what ``_said`` gives without a word to the left, for all lines of a batch at once."""
    data, at = _bytes(batch["text"])
    x0, x1, size = (batch[n].to_numpy(zero_copy_only=False) for n in ("x0", "x1", "size"))
    blank = np.isin(np.arange(256), [ord(c) for c in _BLANK])
    ends, begins = blank[data[at[1:] - 1]], blank[data[at[:-1]]]
    apart = np.append(False, (x0[1:] - x1[:-1] > WORD_GAP * np.maximum(size[1:], size[:-1])) & ~ends[:-1] & ~begins[1:])
    apart[first] = False
    moved = np.cumsum(apart)
    out = np.full(len(data) + int(moved[-1]), 32, np.uint8)
    out[np.arange(len(data)) + np.repeat(moved, np.diff(at))] = data
    cuts = np.append(at[first] + moved[first], len(out)).astype(np.int32)
    return pa.StringArray.from_buffers(len(first), pa.py_buffer(cuts), pa.py_buffer(out))


_MIRRORED = str.maketrans("()[]{}<>«»", ")(][}{><»«")
_BLANK = " \t\n\x0b\f\r"


def _said(words: list[tuple], base: str | None) -> str:
    """A line's words (x0, x1, size, text, direction), from left to right, as they are read."""
    right = None
    after = []  # the next direction to the right of each word
    for w in reversed(words):
        after.append(right)
        right = w[4] or right
    runs: list[tuple[str | None, list[tuple]]] = []
    left = None
    for w, right in zip(words, reversed(after), strict=True):
        side = w[4] or (left if left is not None and left == right else base)
        left = w[4] or left
        if runs and runs[-1][0] == side:
            runs[-1][1].append(w)
        else:
            runs.append((side, [w]))
    out: list[str] = []
    was = edge = None
    for side, run in reversed(runs) if base == "R" else runs:
        ends = min(w[0] for w in run), max(w[1] for w in run)
        for k, w in enumerate(reversed(run) if side == "R" else run):
            if was is not None:
                gap = (was[0] - w[1] if side == "R" else w[0] - was[1]) if k else edge[0] - ends[1] if base == "R" else ends[0] - edge[1]
                if gap > WORD_GAP * max(was[2], w[2]) and was[3][-1] not in _BLANK and w[3][0] not in _BLANK:
                    out.append(" ")
            out.append(w[3].translate(_MIRRORED) if side == "R" else w[3])
            was = w
        edge = ends
    return "".join(out)


def _quantile(values: Column, q: float) -> Column:
    """The value at the lower of the places of a quantile."""
    return F.get(F.array_sort(values), F.floor(q * (F.size(values) - 1)).cast("int"))


def _facts(words: DataFrame) -> DataFrame:
    """Lines with their geometry: size of most characters, extent, share of bold, whether they hold a table's gap, and their letters of both directions with their ends'.

    Lines are numbered down the page; rotated words come after all others, each a line of its own, from left to right. A line whose ends agree is read, others are read
    from the left and keep their words. Each page has a row of line -1 with its measures: body, the size of most characters; leading, a low quantile of the ways from line
    to line, so that paragraphs' gaps don't count; and body_width, a high one of its lines' widths.
    """
    rows = _lettered(words).withColumn("bold", F.coalesce("bold", F.lit(False))).select("page", *PLACED, "baseline", "horizontal", "bold", *LETTERS)
    level = F.when(F.col("horizontal"), F.col("baseline")).otherwise(F.col("x0"))
    rows = rows.repartition("page").sortWithinPartitions("page", F.desc("horizontal"), level, F.when(F.col("horizontal"), F.col("x0")).otherwise(F.col("baseline")), "x1", "text")
    own = "size double, baseline double, x0 double, x1 double, top double, bottom double, horizontal boolean, chars long, bold boolean, rtl long, ltr long, left string, right string, tabular boolean"
    facts = StructType.fromDDL(f"line long, words array<struct<x0: double, x1: double, size: double, text: string, strong: string>>, text string, {own}, body double, leading double, body_width double")
    return rows.mapInArrow(lambda batches: _paged(_measured(_gathered(_lined(batches)))), StructType([rows.schema["page"], *facts.fields]))


def _rounded(sizes: np.ndarray) -> np.ndarray:
    """Sizes to one decimal, half up."""
    each, of = np.unique(sizes, return_inverse=True)
    return np.array([float(Decimal(repr(s)).quantize(Decimal("0.1"), ROUND_HALF_UP)) if np.isfinite(s) else s for s in each.tolist()], float)[of]


def _measured(lines: Iterator[tuple[pa.RecordBatch, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """The facts of a batch's lines by sums, least and greatest values over stretches of one array."""
    for batch, first in lines:
        count = np.diff(np.append(first, batch.num_rows))
        line = np.repeat(np.arange(len(count)), count)
        x0, x1, size, baseline, bold, horizontal = (batch[n].to_numpy(zero_copy_only=False) for n in ("x0", "x1", "size", "baseline", "bold", "horizontal"))
        shown, chars = _rounded(size), pc.utf8_length(batch["text"]).to_numpy(zero_copy_only=False).astype(np.int64)
        filled = pc.not_equal(pc.utf8_trim(batch["text"], " "), "").to_numpy(zero_copy_only=False)
        rtl, ltr, strong = _sides(batch)
        least, most, add = (lambda v, f=f: f.reduceat(v, first) for f in (np.minimum, np.maximum, np.add))
        middle, usual = least(baseline), least(shown)
        for k in np.flatnonzero(middle != most(baseline)):
            middle[k] = np.median(baseline[first[k] : first[k] + count[k]])
        for k in np.flatnonzero(usual != most(shown)):
            here, n = slice(first[k], first[k] + count[k]), {}
            for s, c, x in zip(shown[here].tolist(), chars[here].tolist(), x0[here].tolist(), strict=True):
                c0, x_0 = n.get(s, (0, x))
                n[s] = c0 + c, min(x_0, x)
            usual[k] = max(n, key=lambda s: (n[s][0], -n[s][1]))
        at = np.flatnonzero(filled)
        wide = (line[at[1:]] == line[at[:-1]]) & (x0[at[1:]] - x1[at[:-1]] > TABLE_GAP * np.maximum(size[at[1:]], size[at[:-1]]))
        tabular = np.bincount(line[at[1:]][wide], minlength=len(count)) > 0
        # The directions of the outermost words with letters.
        sided = rtl + ltr > 0
        place = np.arange(len(line))
        low, high, none = least(np.where(sided, place, len(line))), most(np.where(sided, place, -1)), ~np.logical_or.reduceat(sided, first)
        of = np.where(rtl > ltr, "R", "L")
        left, right = (np.where(none, None, of[np.where(none, 0, k)]) for k in (low, high))
        # Lines without a word to the left read as they stand, unless their base is R; those of unlike ends, or of none, wait for their base.
        turned = np.logical_or.reduceat(strong == "R", first)
        waits = none | (left != right)
        text = _straight(batch, first)
        words = [*[batch[c] for c in PLACED], pa.array(strong, pa.string())]
        if (turns := np.flatnonzero(turned & ~waits)).size:
            said = text.to_pylist()
            for k in turns.tolist():
                a, n = int(first[k]), int(count[k])
                said[k] = _texts([c.slice(a, n) for c in words], [0, n], [left[k]])[0]
            text = pa.array(said, pa.string())
        kept = pa.array(np.flatnonzero(np.repeat(waits, count)))
        cuts = pa.array(np.append(0, np.cumsum(np.where(waits, count, 0))), pa.int32(), mask=np.append(~waits, False))
        found = {
            "text": text, "size": usual, "baseline": middle, "x0": least(x0), "x1": most(x1), "top": least(baseline - size), "bottom": most(baseline + size / 4), "horizontal": horizontal[first].astype(bool), "chars": add(chars),
            "bold": add(np.where(bold.astype(bool), chars, 0)) >= BOLD * add(chars), "rtl": add(rtl), "ltr": add(ltr), "left": pa.array(left, pa.string()), "right": pa.array(right, pa.string()), "tabular": tabular,
        }
        at = pa.array(first)
        words = pa.ListArray.from_arrays(cuts, pa.StructArray.from_arrays([c.take(kept) for c in words], WORD))
        own = [v if isinstance(v, pa.Array) else pa.array(v) for v in found.values()]
        yield pa.RecordBatch.from_arrays([batch["page"].take(at), batch["line"].take(at), words, *own], ["page", "line", "words", *found])


class _Measures:
    """What a page's row says of its lines; two numbers a line are held."""

    def __init__(self):
        self.sizes: dict[float, list] = {}
        self.ways: list[np.ndarray] = []
        self.widths: list[np.ndarray] = []
        self.was, self.rtl = np.nan, 0
        self.lines = 0

    def add(self, size: np.ndarray, chars: np.ndarray, baseline: np.ndarray, width: np.ndarray, rtl: int) -> None:
        """Lines in their order: size and chars of all of them, the baselines of those that are horizontal, the widths of those with text."""
        each, first, of = np.unique(size, return_index=True, return_inverse=True)
        for s, k, n in zip(each.tolist(), first.tolist(), np.bincount(of, chars).tolist(), strict=True):
            own = self.sizes.setdefault(s if s == s else np.nan, [0, -(self.lines + k)])
            own[0] += n
        if len(baseline):
            self.ways.append(np.diff(baseline, prepend=self.was) if self.ways else np.diff(baseline))
            self.was = baseline[-1]
        self.widths.append(width)
        self.lines += len(size)
        self.rtl += rtl

    def row(self) -> tuple[float, float, float | None, int]:
        """body, leading, body_width, and the letters of right-to-left scripts."""
        body = max(self.sizes, key=lambda s: self.sizes[s])
        ways = np.concatenate(self.ways) if self.ways else np.zeros(0)
        ways = np.sort(ways[(ways > 0.2 * body) | (np.isnan(ways) & ~np.isnan(body))])
        usual = np.maximum(ways[int(QUANTILE * (len(ways) - 1))], LEAST_LEADING * body) if len(ways) >= 2 else LEADING * body
        widths = np.sort(np.concatenate(self.widths))
        return body, float(usual), float(widths[int(0.75 * (len(widths) - 1))]) if len(widths) else None, self.rtl


def _paged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines as they come, and after each page's last one a row of line -1 with its measures."""
    now, names, page = None, ["body", "leading", "body_width"], None

    def measures(rows: list[tuple[pa.Scalar, _Measures]], like: pa.RecordBatch) -> pa.RecordBatch:
        found = [m.row() for _, m in rows]
        own = {"line": [-1] * len(rows), "rtl": [r[3] for r in found]} | {n: [r[k] for r in found] for k, n in enumerate(names)}
        fields = [*like.schema, *[pa.field(n, pa.float64()) for n in names]]
        pages = pa.array([p.as_py() for p, _ in rows], like["page"].type)
        return pa.RecordBatch.from_arrays([pages if f.name == "page" else pa.array(own[f.name], f.type) if f.name in own else pa.nulls(len(rows), f.type) for f in fields], [f.name for f in fields])

    like = None
    for batch in batches:
        n, like = batch.num_rows, batch
        size, chars, baseline, x0, x1, rtl = (batch[c].to_numpy(zero_copy_only=False) for c in ("size", "chars", "baseline", "x0", "x1", "rtl"))
        level = batch["horizontal"].to_numpy(zero_copy_only=False)
        text = pc.not_equal(pc.utf8_trim(batch["text"], " \t\x0b\f\r"), "").to_numpy(zero_copy_only=False)
        starts = [0, *(np.flatnonzero(_differs(batch["page"])) + 1).tolist()]
        ended = []
        for a, b in zip(starts, [*starts[1:], n], strict=True):
            if now is None or a or page != batch["page"][0]:
                if now is not None:
                    ended.append((page, now))
                now, page = _Measures(), batch["page"][a]
            here = slice(a, b)
            now.add(size[here], chars[here], baseline[here][level[here]], (x1 - x0)[here][text[here]], int(rtl[here].sum()))
        yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.nulls(n, pa.float64())] * 3], [*batch.schema.names, *names])
        if ended:
            yield measures(ended, batch)
    if now is not None:
        yield measures([(page, now)], like)


def _based(placed: DataFrame) -> DataFrame:
    """(page, line, base, said): the lines of two directions' pages that wait for their base, read by it. The base is their block's, else their page's, else left to right."""
    waits = placed.filter("words IS NOT NULL")
    # Without a letter of the right-to-left scripts a page's lines all read from the left.
    mixed = placed.filter("line < 0 AND rtl > 0").select("page").join(waits.select("page").distinct(), "page", "left_semi")
    rows = placed.drop("words", "text").join(mixed, "page", "left_semi")
    down = Window.partitionBy("page").orderBy("line")
    was = F.lag(F.when(F.col("line") >= 0, F.struct("size", "baseline", "horizontal"))).over(down)
    rough = rows.withColumns({"was": was, "leading": F.first("leading").over(down)}).filter("line >= 0")
    rough = rough.withColumn("rough", F.sum(_breaks(F.col("was")).cast("int")).over(down))
    block, whole = Window.partitionBy("page", "rough"), Window.partitionBy("page")
    total = lambda w: _towards(F.sum("rtl").over(w), F.sum("ltr").over(w))
    rough = rough.withColumn("base", F.coalesce(total(block), total(whole), F.lit("L"))).select("page", "line", "base")
    return _read(rough.join(waits.select("page", "line", "words"), ["page", "line"])).withColumnRenamed("text", "said")


def _breaks(of: Column) -> Column:
    """Whether geometry puts a block's start between the former line ``of`` and this one."""
    sizes = F.greatest("size", of["size"]) / F.greatest(F.least("size", of["size"]), F.lit(1e-6))
    return of.isNull() | ~F.col("horizontal") | ~of["horizontal"] | (F.col("baseline") - of["baseline"] > PARAGRAPH * F.col("leading")) | (sizes > SIZE_CHANGE)


class Layout(NamedTuple):
    """lines: page, block, line, text, direction, char_start, char_end, x0, top, x1, bottom; blocks: page, block, text, char_start, char_end, lines, direction, heading, ...; offsets are in the page's text, its blocks joined by a blank line."""

    lines: DataFrame
    blocks: DataFrame


def _pieces(lines: DataFrame) -> DataFrame:
    """Lines with ``cut``, whether their last character is a hyphen that the next one goes on from, ``gap``, the newlines before them in the page's text, and their offsets there."""
    down = Window.partitionBy("page").orderBy("line")
    hyphen = (F.contains("text", F.lit("-")) | F.contains("text", F.lit("‐"))) & F.col("text").rlike(r"\p{IsLatin}[-‐]$")
    rows = lines.withColumns({"hyphen": hyphen, "goes_on": F.col("text").rlike(r"^(?=\p{IsLatin})\p{Ll}")})
    # Flags alone go from line to line, not texts.
    rows = rows.withColumns({"then": F.lead(F.struct("block", "goes_on")).over(down), "before": F.lag(F.struct("block", "hyphen")).over(down)})
    cut = F.coalesce((F.col("then.block") == F.col("block")) & F.col("hyphen") & F.col("then.goes_on"), F.lit(False))
    # A newline inside a block, unless a word goes on; two between blocks.
    gap = F.when(F.col("before").isNull(), 0).when(F.col("before.block") != F.col("block"), 2).when(F.col("before.hyphen") & F.col("goes_on"), 0).otherwise(1)
    rows = rows.withColumns({"cut": cut, "gap": gap}).withColumn("size_here", F.length("text") - F.col("cut").cast("int")).drop("then", "before", "hyphen", "goes_on")
    return rows.withColumn("char_end", F.sum(F.col("gap") + F.col("size_here")).over(down)).withColumn("char_start", F.col("char_end") - F.col("size_here")).drop("size_here")


def _joined(pieces: DataFrame, held: list[str], *more: Column) -> DataFrame:
    """The blocks that lines with their pieces make, and ``held``, their lines in order with these columns."""
    lines = F.array_sort(F.collect_list(F.struct("line", "text", "gap", "cut", *held))).alias("held")
    blocks = pieces.groupBy("page", "block").agg(lines, F.count("*").alias("lines"), F.min("line").alias("line"), F.max("line").alias("last"), F.min("char_start").alias("char_start"), F.max("char_end").alias("char_end"), *more)
    own = lambda x: F.when(x["cut"], F.substring(x["text"], F.lit(1), F.length(x["text"]) - 1)).otherwise(x["text"])
    return blocks.withColumn("text", F.array_join(F.transform("held", lambda x: F.concat(F.when(x["gap"] == 1, "\n").otherwise(""), own(x))), ""))


def offsets(lines: DataFrame) -> Layout:
    """Lines (page, block, line, text, ...), blocks following each other as their lines do, joined into blocks, and blocks into the page, with the offsets of both. Hyphenation at Latin line ends is undone."""
    rows = _pieces(lines)
    return Layout(rows.drop("cut", "gap"), _joined(rows, []).drop("held"))


def page(words: DataFrame) -> Layout:
    """Pages of placed words in two passes.

    The first finds lines and their page's measures, and reads each line in its own direction: that of its two ends where they agree, else that of its block by geometry
    alone, else its page's, else left to right. The second finds the blocks by geometry, by a change to or from bold and by short lines that name a chapter; lines
    without text are gone by then. Blocks of at most two lines are headings if they are large, bold and set off, or named; tables and lists never are.
    The second pass deals the lines to their pages once: windows and blocks follow in the same order, and blocks are written with their lines.
    """
    placed = staged(_facts(words.filter("page IS NOT NULL")), "lines")
    based = staged(_based(placed), "read")
    rows = placed.drop("words").join(based, ["page", "line"], "left")
    rows = rows.withColumn("text", F.coalesce("said", "text")).filter((F.col("line") < 0) | F.col("text").rlike(r"[^ \t\x0B\f\r]")).drop("said").repartition("page")  # before its columns grow
    clean = F.trim(F.regexp_replace("text", r"[^\S\n ][^\S\n]*| [^\S\n]+", " "))  # single blanks stay untouched
    rows = rows.withColumns({"text": clean, "base": F.coalesce("base", F.when(F.col("left") == F.col("right"), F.col("left")), F.lit("L"))})
    rows = rows.drop("left", "right", "chars", "rtl", "ltr")
    down = Window.partitionBy("page").orderBy("line")
    rows = rows.withColumns({"named": (F.length("text") <= HEADING_CHARS) & F.col("text").rlike(NAMED), "width": F.col("x1") - F.col("x0"), "marker": F.col("text").rlike(MARKER)})
    # A page's own row comes first.
    was = F.lag(F.when(F.col("line") >= 0, F.struct("size", "baseline", "horizontal", "bold", "named", "width", "marker"))).over(down)
    rows = rows.withColumns({c: F.first(c).over(down) for c in ("body", "leading", "body_width")} | {"was": was, "marked_after": F.lead("marker").over(down)}).filter("line >= 0")
    alone = lambda named, width: named & (width <= SHORT * F.col("body_width"))
    opens = _breaks(F.col("was")) | (F.col("bold") != F.col("was.bold")) | alone(F.col("named"), F.col("width")) | alone(F.col("was.named"), F.col("was.width"))
    drafts = rows.withColumns({"block": F.sum(opens.cast("int")).over(down) - 1, "marked_before": F.col("was.marker"), "way": F.col("baseline") - F.col("was.baseline")})
    kept = ["page", "block", "line", "text", F.when(F.col("base") == "R", "rtl").otherwise("ltr").alias("direction"), "x0", "top", "x1", "bottom", "size", "bold", "tabular", "marker", "marked_before", "marked_after", "way", "body", "leading"]
    held = ["direction", "char_start", "char_end", "x0", "top", "x1", "bottom"]
    own = ["size", "way", "marker", "marked_before", "marked_after"]
    blocks = _joined(_pieces(drafts.select(*kept)), [*held, *own], F.min("bold").alias("bold"), F.max("tabular").alias("tabular"), F.first("body").alias("body"), F.first("leading").alias("leading"))
    first, last = F.get("held", F.lit(0)), F.get("held", F.size("held") - 1)
    blocks = blocks.withColumns({c: first[c] for c in ("size", "way", "marker", "marked_before")} | {"marked_after": last["marked_after"]})
    listed = F.col("marker") & (F.coalesce("marked_before", F.lit(False)) | F.coalesce("marked_after", F.lit(False)))
    large = (F.col("body") > 0) & (F.col("size") >= HEADING_SIZE * F.col("body"))
    set_off = F.col("bold") & (F.coalesce("way", F.lit(float("inf"))) >= BOLD_GAP * F.col("leading"))
    short = (F.col("lines") <= HEADING_LINES) & (F.length("text") <= HEADING_CHARS) & F.col("text").rlike(r"[\p{L}\p{N}]") & ~F.col("tabular") & ~listed
    blocks = blocks.withColumn("heading", short & (large | set_off | F.col("text").rlike(NAMED))).withColumn("direction", T.direction(F.col("text")))
    shown = ["line", "text", *held]
    slim = F.transform("held", lambda x: F.struct(*[x[c].alias(c) for c in shown])).alias("held")
    blocks = staged(blocks.select("page", "block", "text", "char_start", "char_end", "lines", "direction", "heading", "size", "bold", slim), "pages")
    return Layout(blocks.select("page", "block", F.inline("held")).select("page", "block", *shown), blocks.drop("held"))


def recognised(lines: DataFrame) -> Layout:
    """Pages of recognised lines (page, seq, text, confidence, x0, y0, x1, y1), in the order the engine reads them, which follows columns.

    Lines without letters or digits or below a confidence of 15 are left out. A block starts where the next line stands no lower (the next column), further down than
    1.4 of the page's leading, or beside the former line. Headings are not guessed.
    """
    clean = F.trim(F.regexp_replace("text", r"\s+", " "))
    usable = lines.withColumn("text", clean).filter(F.col("text").rlike(r"[\p{L}\p{N}]") & (F.col("confidence") >= CONFIDENT))
    usable = usable.withColumns({"centre": (F.col("y0") + F.col("y1")) / 2, "height": F.greatest(F.lit(1.0), F.col("y1") - F.col("y0"))})
    order = Window.partitionBy("page").orderBy("seq")
    held = usable.withColumn("was", F.lag(F.struct("centre", "x0", "x1")).over(order)).withColumn("line", F.row_number().over(order) - 1)
    held = held.withColumn("way", F.col("centre") - F.col("was.centre"))
    body = held.groupBy("page").agg(F.median("height").alias("body"))
    ways = held.join(body, "page").groupBy("page", "body").agg(F.collect_list(F.when(F.col("way") > 0.2 * F.col("body"), F.col("way"))).alias("ways"))
    usual = F.greatest(_quantile(F.col("ways"), QUANTILE), LEAST_LEADING * F.col("body"))
    leading = ways.select("page", F.when(F.size("ways") >= 2, usual).otherwise(1.2 * F.col("body")).alias("leading"))
    beside = F.least("x1", "was.x1") <= F.greatest("x0", "was.x0")
    opens = F.col("was").isNull() | (F.col("way") <= 0) | (F.col("way") > PARAGRAPH * F.col("leading")) | beside
    rows = held.join(leading, "page").withColumn("block", F.sum(opens.cast("int")).over(order) - 1)
    found = offsets(rows.select("page", "block", "line", "text", "x0", F.col("y0").alias("top"), "x1", F.col("y1").alias("bottom"), "confidence"))
    return Layout(found.lines.withColumn("direction", T.direction(F.col("text"))), found.blocks.withColumn("direction", T.direction(F.col("text"))).drop("line", "last"))


def confidence(lines: DataFrame) -> DataFrame:
    """(page, confidence): the mean over a page's recognised lines, each weighted by its characters other than spaces, within 0 and 100."""
    chars = F.length(F.regexp_replace("text", r"\s", ""))
    mean = F.sum(chars * F.col("confidence")) / F.sum(chars)
    return lines.groupBy("page").agg(F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(100.0), mean)), F.lit(0.0)).alias("confidence"))


#: A hyphen at a Latin line's end that the next line goes on from.
HYPHEN = r"[-‐]\n(?<=\p{IsLatin}[-‐]\n)(?=\p{IsLatin})(?=\p{Ll})"


def plain(pages: DataFrame) -> DataFrame:
    """(page, block, text, char_start, char_end) and the pages' other columns: blocks of plain texts (page, text), cut at blank lines, with offsets in the blocks joined by blank lines.

    A page is a row, so its blocks are found in it and nothing is shuffled.
    """
    clean = F.regexp_replace(F.regexp_replace("text", r"\r\n?", "\n"), r"[^\S\n ][^\S\n]*| [^\S\n]+", " ")  # single blanks stay untouched
    paragraphs = F.split(clean, r"\n[^\S\n]*\n\s*")
    lines = lambda p: F.array_join(F.filter(F.transform(F.split(p, "\n"), lambda x: F.trim(x)), lambda x: x.rlike(r"[\p{L}\p{N}]")), "\n")
    whole = lambda b: F.when(F.contains(b, F.lit("\n")), F.regexp_replace(b, HYPHEN, "")).otherwise(b)
    blocks = F.filter(F.transform(F.transform(paragraphs, lines), whole), lambda b: b != "")
    others = [f for f in pages.schema.fields if f.name not in ("page", "text")]
    rows = pages.filter(F.col("text").isNotNull()).select("page", *[f.name for f in others], blocks.alias("blocks"))
    schema = StructType([pages.schema["page"], *others, *StructType.fromDDL("block long, text string, char_start long, char_end long").fields])
    return rows.mapInArrow(_placed, schema).select("page", "block", "text", "char_start", "char_end", *[f.name for f in others])


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page's blocks as rows, with their number and offsets: running sums over all texts of a batch."""
    for batch in batches:
        texts = batch["blocks"].flatten()
        count = pc.list_value_length(batch["blocks"]).to_numpy()
        first = np.cumsum(count) - count
        end = np.cumsum(pc.utf8_length(texts).to_numpy().astype(np.int64) + 2)
        own = end - np.repeat(np.append(0, end)[first], count) - 2
        of = pa.array(np.repeat(np.arange(len(count)), count))
        names = [n for n in batch.schema.names if n != "blocks"]
        found = {"block": pa.array(np.arange(len(texts)) - np.repeat(first, count)), "text": texts, "char_start": pa.array(own - pc.utf8_length(texts).to_numpy()), "char_end": pa.array(own)}
        yield pa.RecordBatch.from_arrays([*[batch[n].take(of) for n in names], *found.values()], [*names, *found])
