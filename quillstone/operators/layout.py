"""Page layout from positioned items, representative sampling and streamed replies: ordered work inside one page, document or turn."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..sources.stages import staged
from .ordered import numbered

LINE, SPACE, TABLE = 0.5, 0.25, 3.0


_LINE = {"page": pa.int64(), "line": pa.int64(), "text": pa.string(), "size": pa.float64(), "y": pa.float64(), "tabular": pa.bool_()}


def _line(items: list[tuple]) -> tuple:
    """Text, size, y and whether a table's gap is in it, of one line's items (page, y, x, width, size, text)."""
    y = items[0][1]
    items.sort(key=lambda r: r[2])
    parts, blank, end, tabular = [], False, None, False
    for _, _, x, width, size, text in items:
        if end is not None:
            gap = x - end
            tabular |= gap > TABLE * size
            if gap > SPACE * size and not blank:
                parts.append(" ")
                blank = True
        if text:
            parts.append(text)
            blank = text.endswith(" ")
        end = x + width
    return "".join(parts), max(r[4] for r in items), y, tabular


def page_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items in the order of page, y and x as lines: baselines within half an em of a line's first join it, gaps over a quarter em become spaces, over three em mark a table."""
    held: list[tuple] = []
    n = 0
    for batch in batches:
        out: list[tuple] = []
        number = lambda name, batch=batch: batch[name].to_numpy(zero_copy_only=False).tolist()
        for r in zip(batch["page"].to_pylist(), number("y"), number("x"), number("width"), number("size"), batch["text"].to_pylist()):
            if held and held[0][0] == r[0] and abs(r[1] - held[0][1]) <= LINE * max(r[4], held[0][4]):
                held.append(r)
                continue
            if held:
                out.append((held[0][0], n, *_line(held)))
                n = n + 1 if held[0][0] == r[0] else 0
            held = [r]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out) if out else [()] * len(_LINE), _LINE.values())], list(_LINE))
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((held[0][0], n, *_line(held)), _LINE.values())], list(_LINE))


def lines(items: DataFrame) -> DataFrame:
    """Needs (page, x, y, width, size, text). Pages are dealt by hash and read in order, a line at a time."""
    number = [F.col(c).cast("double").alias(c) for c in ("y", "x", "width", "size")]
    rows = items.select(F.col("page").cast("long").alias("page"), *number, "text").repartition("page")
    return rows.sortWithinPartitions("page", F.asc_nulls_last("y"), F.asc_nulls_last("x")).mapInArrow(page_lines, "page long, line long, text string, size double, y double, tabular boolean")


def body_size(items: DataFrame) -> DataFrame:
    """The font size with most characters on each page, the larger of equals."""
    per = items.groupBy("page", "size").agg(F.sum(F.length("text")).alias("n"))
    return per.groupBy("page").agg(F.max_by("size", F.struct("n", "size")).alias("body"))


def outlined(titles: DataFrame, blocks: DataFrame) -> DataFrame:
    """The first block of its page that each outline title equals, begins or is begun by. Needs (doc, page, title) and (doc, page, block, text); one title of equal ones is kept.

    Titles meet blocks on equal keys: a block's beginnings of the lengths that titles have, and a title's own beginnings. Of blocks that begin alike only the first is
    kept, so a page of many titles and blocks is not a product of both.
    """
    keys = ["doc", "page"]
    cut = lambda text, n: F.substring(text, F.lit(1), n)
    rest = F.struct("block", F.struct(*[c for c in blocks.columns if c not in (*keys, "block")]).alias("rest"))
    t = titles.filter(F.col("title").isNotNull()).dropDuplicates([*keys, "title"]).withColumn("_t", F.lower("title"))
    b = blocks.filter(F.col("text").isNotNull()).withColumn("_b", F.lower("text"))
    first = lambda of: of.groupBy(*keys, "_k").agg(F.min_by(rest, "block").alias("_hit"))
    # One row for each length that a title has, whatever the number of titles.
    lengths = t.select(F.char_length("_t").alias("_n")).distinct()
    begun = first(b.join(F.broadcast(lengths), F.col("_n") <= F.char_length("_b")).withColumn("_k", cut(F.col("_b"), F.col("_n"))))
    whole = first(b.withColumn("_k", F.col("_b")))
    starts = t.withColumn("_k", F.explode(F.transform(F.sequence(F.lit(0), F.char_length("_t")), lambda n: cut(F.col("_t"), n))))
    hit = t.withColumn("_k", F.col("_t")).join(begun, [*keys, "_k"]).unionByName(starts.join(whole, [*keys, "_k"]))
    best = hit.groupBy(*keys, "title").agg(F.min_by(F.struct("_hit", *[c for c in titles.columns if c not in (*keys, "title")]), "_hit.block").alias("_x"))
    others = [F.col(f"_x.{c}").alias(c) for c in titles.columns if c not in (*keys, "title")]
    return best.select(*keys, "title", *others, "_x._hit.block", "_x._hit.rest.*")


def _near(rows: DataFrame, slots: DataFrame, most: int) -> DataFrame:
    """For each slot of a document its nearest rows by pages between, then by place: as many as can be needed, since each of the others takes one at most."""
    page = F.col("page")
    away = F.when(page.between(F.col("page_start"), F.col("page_end")), 0).otherwise(F.least(F.abs(page - F.col("page_start")), F.abs(page - F.col("page_end"))))
    rank = F.row_number().over(Window.partitionBy("doc", "slot").orderBy("away", "k"))
    return rows.join(slots, "doc").select("doc", "slot", "k", away.cast("long").alias("away")).withColumn("near", rank).filter(F.col("near") <= most + 1).drop("near")


def sampled(chunks: DataFrame, most: int = 8) -> DataFrame:
    """Chunks that stand for each document: (doc, chunk_index). Needs (doc, chunk_index, page_start, page_end, section).

    The pages of a document are divided evenly by ``most`` targets; the first is the first chunk, every other takes the nearest start of a section if one is within
    half a step (a page at least), else the nearest chunk, of those that are free. What targets leave over is filled up evenly. Rows are numbered by ranges and
    only a few candidates for each target meet in one row, so a document's size doesn't matter.
    """
    keys = numbered(chunks, "doc", "chunk_index", "k")
    before = keys.select("doc", (F.col("k") + 1).alias("k"), F.col("section").alias("before"))
    rows = keys.join(before, ["doc", "k"], "left").withColumn("starts", F.col("section").isNotNull() & ~F.col("section").eqNullSafe(F.col("before"))).drop("before")
    rows = staged(rows.select("doc", "k", "chunk_index", "page_start", "page_end", "starts"), "places")
    targets = max(most, 2)
    whole = rows.groupBy("doc").agg(F.count("*").alias("n"), F.min_by("page_start", "k").alias("first"), F.max_by("page_end", "k").alias("last"))
    whole = whole.withColumn("step", (F.col("last") - F.col("first")) / (targets - 1))
    slots = whole.filter(F.col("n") > most).select("doc", F.explode(F.sequence(F.lit(1), F.lit(targets - 1))).alias("slot"), "first", "step").select("doc", "slot", F.floor(F.col("first") + F.col("slot") * F.col("step") + 0.5).alias("page"))
    few = lambda of, name: of.groupBy("doc", "slot").agg(F.sort_array(F.collect_list(F.struct("away", "k"))).alias(name))
    near = few(_near(rows, slots, most), "any").join(few(_near(rows.filter("starts"), slots, most), "start"), ["doc", "slot"], "left")
    per = near.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("slot", F.coalesce("start", F.array().cast("array<struct<away:bigint,k:bigint>>")).alias("start"), "any"))).alias("slots"))
    free = lambda of, taken: F.get(F.filter(of, lambda x: ~F.array_contains(taken, x["k"])), 0)
    close = F.greatest(F.lit(1.0), F.col("step") / 2)

    def take(taken: Column, slot: Column) -> Column:
        start = free(slot["start"], taken)
        return F.array_append(taken, F.when(start["away"] <= close, start["k"]).otherwise(free(slot["any"], taken)["k"]))

    chosen = per.join(whole, "doc").withColumn("taken", F.aggregate("slots", F.array(F.lit(0).cast("long")), take))
    # The r-th row that is not taken: r moved on by every taken row at or before it.
    gap, left = F.lit(most) - F.size("taken"), F.col("n") - F.size("taken")
    fill = F.when(gap > 0, F.transform(F.sequence(F.lit(0), gap - 1), lambda s: F.aggregate(F.array_sort("taken"), F.floor(s * (left - 1) / F.greatest(gap - 1, F.lit(1)) + 0.5).cast("long"), lambda r, t: F.when(t <= r, r + 1).otherwise(r)))).otherwise(F.array().cast("array<long>"))
    picked = chosen.select("doc", F.explode(F.slice(F.array_sort(F.array_union("taken", fill)), 1, most)).alias("k"))
    small = rows.join(whole.filter(F.col("n") <= most).select("doc"), "doc", "left_semi").select("doc", "k")
    return rows.join(picked.unionByName(small), ["doc", "k"]).select("doc", "chunk_index")


def held_stream(parts: pd.DataFrame, marks: tuple[str, ...] = ("[[NO_ANSWER]]",)) -> pd.DataFrame:
    """A streamed reply with its opening held back while it may still become a refusal, and unfinished markers held until they end."""
    held, out, refused = "", [], False
    for r in parts.sort_values("seq").to_dict("records"):
        if refused:
            continue
        held += r["text"]
        start = held.lstrip()
        if not out and any(m.startswith(start[: len(m)]) for m in marks):
            refused = any(start.startswith(m) for m in marks)
            continue
        cut = held.rfind("[")
        keep = cut if cut >= 0 and "]" not in held[cut:] and len(held) - cut < 8 else len(held)
        if held[:keep]:
            out.append((r["seq"], held[:keep]))
        held = held[keep:]
    if held and not refused:
        out.append((int(parts["seq"].max()) + 1, held))
    turn = parts["turn_id"].iloc[0]
    return pd.DataFrame([(turn, s, t, refused) for s, t in out] or [(turn, 0, "", refused)], columns=["turn_id", "seq", "text", "refused"])


def streamed(parts: DataFrame) -> DataFrame:
    return parts.groupBy("turn_id").applyInPandas(lambda p: held_stream(p), "turn_id long, seq long, text string, refused boolean")


LETTER, ARABIC, DIGIT, CJK, BLANK, ASTRAL, SYMBOL = fixed.LETTER, fixed.ARABIC, fixed.DIGIT, fixed.CJK, fixed.BLANK, fixed.ASTRAL, fixed.SYMBOL
_CJK = r"\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{ac00}-\x{d7af}\x{f900}-\x{faff}\x{20000}-\x{2fa1f}"
_ARABIC = r"[\x{600}-\x{6ff}&&[\p{L}\p{M}]]\x{750}-\x{77f}\x{fb50}-\x{feff}"
_SPACE = r"\t\n\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
_LETTER = rf"[[\p{{L}}\p{{M}}]&&[^{_ARABIC}]&&[^{_CJK}]&&[\x{{0}}-\x{{ffff}}]]"
_OTHER = rf"[[\x{{0}}-\x{{ffff}}]&&[^\p{{L}}\p{{M}}]&&[^{_ARABIC}]&&[^{_CJK}]&&[^{_SPACE}]&&[^0-9]]"


def token_estimate(column: str) -> Column:
    """Tokens of a text by runs of letters and digits and by single characters of other kinds, rounded up."""
    c = F.col(column)
    count = lambda p: F.regexp_count(c, F.lit(p)) if isinstance(p, str) else p
    runs = lambda p, each: F.aggregate(F.regexp_extract_all(c, F.lit(p), F.lit(0)), F.lit(0), lambda n, x: n + F.greatest(F.lit(100), F.char_length(x) * each))
    other = count(_OTHER) * SYMBOL + count(rf"(?<=[{_SPACE}])[{_OTHER}&&[^\x{{660}}-\x{{669}}\x{{6f0}}-\x{{6f9}}]]") * (SYMBOL - BLANK)
    whole = runs(f"{_LETTER}+", LETTER) + runs(f"[{_ARABIC}]+", ARABIC) + runs("[0-9]+", DIGIT) + count(f"[{_CJK}]") * CJK + count(f"[{_SPACE}]") * BLANK + count(rf"[[\x{{10000}}-\x{{10ffff}}]&&[^\x{{20000}}-\x{{2fa1f}}]]") * ASTRAL + other
    return F.ceil(whole / 100).cast("long")
