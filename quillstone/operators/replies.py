"""Smaller reply, prompt and reading rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text
from . import answers

# Letters that only Urdu, or only Persian and Urdu, write.
URDU, PERSIAN = "ٹڈڑںےھ", "پچژگ"
# Accents and look-alikes folded before instruction rules.
FOLD_FROM, FOLD_TO = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿаеорсух", "aaaaaaceeeeiiiinooooouuuuyyaeopcyx"


def arabic_language(c: Column) -> Column:
    """ur by letters of its own, fa by Persian letters or more Persian than Arabic kaf and yaa, else ar."""
    n = lambda s: F.regexp_count(c, F.lit(f"[{s}]"))
    return F.when(n(URDU) > 0, "ur").when((n(PERSIAN) > 0) | (n("کی") > n("كي")), "fa").otherwise("ar")


def folded(c: Column) -> Column:
    return text.match_form(F.translate(F.lower(c), FOLD_FROM, FOLD_TO))


def clean_line(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[\p{Cc}\p{Cf}&&[^\t\n]]", ""), r"\s+", " "))


def rewritten(c: Column) -> Column:
    """A rewritten question: first line, no quotes, label or markers, 300 characters at a space."""
    line = F.trim(F.regexp_replace(F.regexp_replace(F.element_at(F.split(F.trim(c), "\n"), 1), r"(?i)^(?:query|question|rewritten(?: question)?)\s*:\s*", ""), r"\[S[0-9]+\]", ""))
    bare = F.regexp_replace(line, "^[\"'“”«»]+|[\"'“”«»]+$", "")
    return F.when(F.length(bare) <= 300, bare).otherwise(F.regexp_replace(F.substring(bare, 1, 300), r"\s+\S*$", ""))


def cited_points(c: Column) -> Column:
    """Bullets that cite something, and lines that are no bullets."""
    lines = F.filter(F.split(c, "\n"), lambda x: ~x.rlike(r"^\s*[-*•]") | x.rlike(r"\[S[0-9]{1,3}\]"))
    return F.array_join(lines, "\n")


def refusal(c: Column) -> Column:
    """Whether a reply opens with the sentinel or a mandated sentence of any language, however it is written."""
    said = text.match_form(c)
    mandated = [F.startswith(said, text.match_form(F.lit(x))) for x in fixed.NOT_FOUND.values()]
    return reduce(lambda a, b: a | b, mandated) | c.rlike(r"^\s*(?:\[\[NO_ANSWER\]\]|(?i:the (?:uploaded )?document does not (?:provide|contain) (?:enough )?information))")


def prompt(question: Column, block: Column, lang: Column) -> Column:
    return F.concat(F.lit("Answer in "), lang, F.lit(" from the excerpts alone and cite them as [S1].\n"), block, F.lit("\nQuestion: "), question)


def parsed_error(body: Column) -> Column:
    """Status, retry seconds and quota kind out of a provider's JSON error, nested as a string or not."""
    outer = F.from_json(body, "error struct<code:int,message:string,status:string>")["error"]
    inner = F.from_json(outer["message"], "error struct<code:int,message:string,status:string>")["error"]
    said = F.coalesce(inner["message"], outer["message"], body)
    delay = F.regexp_extract(said, r"([0-9]+(?:\.[0-9]+)?)(ms|s)\b", 1)
    seconds = F.when(delay != "", delay.cast("double") / F.when(F.regexp_extract(said, r"[0-9](ms|s)\b", 1) == "ms", 1000).otherwise(1))
    return F.struct(F.coalesce(inner["code"], outer["code"]).alias("status"), seconds.alias("retry_s"), said.rlike("PerDay|Daily").alias("daily"))


def recognised_text(c: Column) -> Column:
    """The text in a recogniser's answer: the ``text`` of its JSON object, in a fence, among words or alone; an answer without one is the text itself."""
    body = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    return F.coalesce(F.get_json_object(body, "$.text"), c)


def received(c: DataFrame) -> DataFrame:
    """The first upload rule that is broken: one file, its field, its ending, its type."""
    rule = F.when(F.col("files") != 1, "ONE_FILE").when(F.col("field") != "file", "FIELD").when(~F.lower("name").endswith(".pdf"), "NOT_PDF").when(~F.col("mime").isin("application/pdf", "application/x-pdf", "application/octet-stream"), "MIME")
    return c.withColumn("broken", rule)


def combined_runs(runs: DataFrame) -> DataFrame:
    """The reading of each page with the best confidence; within three points the one whose script fits."""
    top = F.max("confidence").over(Window.partitionBy("page"))
    near = runs.withColumn("near", F.col("confidence") >= top - 3).filter("near")
    return near.groupBy("page").agg(F.max_by("lang", F.struct("fits", "confidence", "lang")).alias("lang"))


def highlights(lines: DataFrame, most: int = 60) -> DataFrame:
    """Distinct line rectangles of a chunk by page, or their union if there are too many."""
    rect = F.struct("x", "y", "w", "h")
    per = lines.groupBy("chunk_id", "page").agg(F.array_sort(F.collect_set(rect)).alias("rects"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + F.col("w")).alias("x1"), F.max(F.col("y") + F.col("h")).alias("y1"))
    union = F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y"), (F.col("x1") - F.col("x0")).alias("w"), (F.col("y1") - F.col("y0")).alias("h")))
    return per.select("chunk_id", "page", F.when(F.size("rects") > most, union).otherwise(F.col("rects")).alias("rects"))


def sentences(df: DataFrame, column: str) -> DataFrame:
    """Adds the sentences of a line; abbreviations end none."""
    return df.withColumn("sentences", answers.sentences(F.col(column)))
