"""Page quality, OCR decisions and document languages as column expressions and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import count_of, once
from .ordered import folded, ranged

# Limits of a trusted page, and how sure or how complete a reading must be to replace its text.
FEW, IMAGE_CHARS, IMAGE, DRAWN, GARBAGE, UNMAPPED, MOJIBAKE, ARABIC_SHARE = 25, 200, 0.5, 20, 0.3, 0.005, 0.2, 0.05
WORD, COVERED, GAIN, UNSURE = 5, 0.8, 1.5, 40
# Scripts by ranges of letters, for telling scattered ones; other letters count by blocks of 256.
BUCKETS = {
    "latin": r"\x{0}-\x{24f}", "arabic": r"\x{600}-\x{6ff}\x{750}-\x{77f}\x{fb50}-\x{feff}", "cyrillic": r"\x{400}-\x{52f}", "greek": r"\x{370}-\x{3ff}", "hebrew": r"\x{590}-\x{5ff}",
    "kana": r"\x{3040}-\x{30ff}", "han": r"\x{4e00}-\x{9fff}", "hangul": r"\x{ac00}-\x{d7af}",
}
DAMAGED = ("garbage", "unmapped-glyphs", "mojibake", "sandwiched-ascii", "script-scatter", "arabic-font-without-arabic")
WORTHLESS = ("mojibake", "script-scatter", "garbage", "arabic-font-without-arabic")


def _scattered(c: Column, n: Column) -> Column:
    """Whether more than half of 20 letters or more stand outside the two largest kinds of script."""
    known = F.regexp_replace(c, r"\P{L}+", "")
    rest = known
    for r in BUCKETS.values():
        rest = F.regexp_replace(rest, f"[{r}]+", "")
    blocks = F.transform(F.filter(F.split(rest, ""), lambda x: x != ""), lambda x: F.floor(F.ascii(x) / 256))
    sizes = F.concat(F.array(*[count_of(known, r) for r in BUCKETS.values()]), F.transform(F.array_distinct(blocks), lambda b: F.size(F.filter(blocks, lambda x: x == b))))
    top, all_ = F.sort_array(sizes, asc=False), F.char_length(known)
    # Half of the letters in one kind of script settle it, without a look at the others.
    return F.when((n["letters"] < 20) | (n["latin"] * 2 >= n["letters"]), False).otherwise((all_ >= 20) & ((all_ - top[0] - top[1]) * 2 > all_))


ODD = r"\x{e000}-\x{f8ff}\x{fffd}"


def counted(c: Column) -> Column:
    """A text's characters by kind: a struct. Most classes are only looked for in what is left without the printable ASCII characters."""
    plain = count_of(c, "A-Za-z")
    return once(F.regexp_replace(c, r"[\t\n\r\x20-\x7e]+", ""), lambda rest: F.struct(
        F.char_length(c).alias("chars"), (F.char_length(c) - count_of(c, r"\s\x{a0}") - count_of(rest, r"\x{feff}")).alias("solid"),
        (plain + count_of(rest, r"\p{L}")).alias("letters"), (plain + count_of(rest, rf"\p{{L}}&&[{BUCKETS['latin']}]")).alias("latin"), count_of(rest, r"\p{IsArabic}&&\p{L}").alias("arabic"), count_of(rest, ODD).alias("odd"),
        count_of(rest, rf"\x{{1}}-\x{{8}}\x{{b}}\x{{c}}\x{{e}}-\x{{1f}}\x{{7f}}-\x{{9f}}\x{{c0}}-\x{{ff}}{ODD}").alias("moji"),
        F.when(~rest.rlike(r"\p{IsArabic}"), 0).otherwise(F.regexp_count(c, F.lit(r"(?<=\p{IsArabic})[0-9@#$%&*+=<>^_~|\\/]+(?=\p{IsArabic})"))).alias("sandwiched"),
    ))


def ratios(c: Column, raw: Column, unmapped: Column, controls: Column, fonts: Column, counts: Column | None = None) -> dict[str, Column]:
    """What speaks for and against a page's own text: the cleaned text, and of before the cleaning the counts of characters, of glyphs without a character and of
    control characters; fonts: whether one of the page's fonts is an Arabic one. counts: counted(c), where it is a column already."""
    n = counted(c) if counts is None else counts
    of = n["solid"] + unmapped + controls
    share = lambda x, n: F.when(n > 0, F.round(x / n, 6)).otherwise(0.0)
    return {
        "char_count": n["chars"].cast("long"), "garbage_ratio": share(n["odd"] + unmapped, of), "unmapped_ratio": share(unmapped, raw), "mojibake_ratio": share(n["moji"] + unmapped + controls, of),
        "sandwiched": n["sandwiched"].cast("long"), "arabic_share": share(n["arabic"], n["letters"]), "scattered": _scattered(c, n), "arabic_fonts": fonts,
    }


def blank(pages: DataFrame) -> Column:
    return (F.col("char_count") == 0) & (F.col("image_coverage") == 0) & (F.col("vector_paths") < DRAWN)


def reasons() -> Column:
    """Why a page's own text is not trusted, in fixed order."""
    say = lambda cond, name: F.when(cond, F.lit(name))
    few = F.col("char_count") < FEW
    return F.array_compact(F.array(
        say(few, "few-characters"), say((F.col("char_count") < IMAGE_CHARS) & (F.col("image_coverage") > IMAGE), "image-page"), say(F.col("garbage_ratio") > GARBAGE, "garbage"),
        say(F.col("unmapped_ratio") > UNMAPPED, "unmapped-glyphs"), say(F.col("mojibake_ratio") > MOJIBAKE, "mojibake"), say((F.col("sandwiched") >= 2) & (F.col("arabic_share") > 0), "sandwiched-ascii"),
        say(F.col("scattered"), "script-scatter"), say(F.col("arabic_fonts") & (F.col("arabic_share") < ARABIC_SHARE) & ~few, "arabic-font-without-arabic"),
    ))


def assessed(pages: DataFrame) -> DataFrame:
    """Adds reasons, needs_ocr, low_quality and unreliable."""
    has = lambda names: F.arrays_overlap("reasons", F.array(*[F.lit(x) for x in names]))
    return pages.withColumn("reasons", reasons()).withColumn("needs_ocr", F.size("reasons") > 0).withColumn("low_quality", has(DAMAGED)).withColumn("unreliable", has(WORTHLESS))


def score() -> Column:
    """0 to 100: the share of words without a damaged character, as told by the worst ratio; none where the text is unreliable."""
    worst = F.least(F.lit(1.0), F.greatest("garbage_ratio", "unmapped_ratio", "mojibake_ratio", F.when(F.col("char_count") > 0, F.col("sandwiched") / F.col("char_count")).otherwise(0.0)))
    return F.when(F.col("unreliable"), F.lit(0)).otherwise(F.floor(100 * F.pow(1 - worst, WORD) + 0.5)).cast("int")


def decided(pages: DataFrame) -> DataFrame:
    """Where each page's text comes from (text, ocr, empty) and its warnings. Needs assessed(), ocr_kind, ocr_chars and ocr_confidence (null: not reported)."""
    text, ocr, sure = F.col("char_count"), F.col("ocr_chars"), F.col("ocr_confidence")
    has = lambda name: F.array_contains("reasons", name)
    adequate = (text > 0) & ~F.col("low_quality") & ~has("few-characters")
    # A reading replaces worthless text whatever it is; little text when it is much longer; other text when it covers most of it and is better.
    longer = (ocr >= GAIN * text) & (~adequate | sure.isNull() | (sure >= UNSURE))
    better = (ocr >= COVERED * text) & (sure.isNull() | (sure > score()))
    replaces = (text == 0) | F.col("unreliable") | F.when(has("few-characters") | has("image-page"), longer).otherwise(better)
    read = F.col("ocr_kind") == "read"
    taken = F.col("needs_ocr") & read & (ocr > 0) & replaces
    own = F.when(text > 0, "text").otherwise("empty")
    low = F.lit("LOW_TEXT_QUALITY")
    absent = F.when(F.col("ocr_kind") == "unavailable", "OCR_UNAVAILABLE").otherwise("OCR_PARTIAL")
    said = F.array(
        F.when(F.col("needs_ocr") & ~read & ~blank(pages) & ~adequate, absent),
        F.when(taken, F.when(sure < UNSURE, low)).when(~F.col("needs_ocr"), None).when(text > 0, F.when(F.col("low_quality"), low)).when(read & (ocr == 0) & ~blank(pages), low),
    )
    return pages.withColumn("source", F.when(~F.col("needs_ocr"), "text").when(taken, "ocr").otherwise(own)).withColumn("warnings", F.array_compact(said))


def warnings(pages: DataFrame) -> DataFrame:
    """Warnings by document and code with their pages in order."""
    return pages.select("doc", "page", F.explode("warnings").alias("warning")).groupBy("doc", "warning").agg(F.sort_array(F.collect_set("page")).alias("pages"))


def confidence(lines: DataFrame) -> DataFrame:
    """Mean confidence by characters, within 0 and 100."""
    mean = F.sum(F.col("chars") * F.col("confidence")) / F.sum("chars")
    return lines.groupBy("doc").agg(F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), mean)), 4).alias("confidence"))


def shares(pages: DataFrame) -> DataFrame:
    """Each document's languages by letters; und only where nothing else is known; largest first, then by code. A document has a row for each language by then."""
    per = pages.groupBy("doc", "lang").agg(F.sum("letters").alias("letters"))
    w = Window.partitionBy("doc")
    known = per.withColumn("known", F.max(F.col("lang") != "und").over(w)).filter(~F.col("known") | (F.col("lang") != "und"))
    order = Window.partitionBy("doc").orderBy(F.desc("letters"), "lang")
    return known.withColumn("share", F.round(F.col("letters") / F.sum("letters").over(w), 4)).withColumn("place", F.row_number().over(order).cast("long")).select("doc", "lang", "share", "place")


def carried(rows: DataFrame) -> DataFrame:
    """The last heading before or at each row, and whether a section starts there."""
    key = ["doc"], ["page"]
    held = folded(ranged(rows, *key), *key, last={"section": F.col("title")})
    held = folded(held, *key, former={"_before": F.col("section")})
    return held.withColumn("starts", F.col("section").isNotNull() & ~F.col("section").eqNullSafe(F.col("_before"))).drop("_part", "_before")


def blocks(lines: DataFrame) -> DataFrame:
    """Numbers lines' blocks: a new one where the advance exceeds 1.4 leadings or sizes differ by over 15 %."""
    key = ["doc"], ["line"]
    held = folded(ranged(lines, *key), *key, former={"_size": F.col("size"), "_y": F.col("y")})
    breaks = (F.col("y") - F.col("_y") > 1.4 * F.col("leading")) | (F.greatest("size", "_size") / F.least("size", "_size") > 1.15)
    broke = held.withColumn("broke", F.coalesce(breaks.cast("int"), F.lit(0)))
    return folded(broke, *key, sums={"block": F.col("broke")}).drop("_part", "_size", "_y")
