"""Hybrid retrieval for all questions and documents at once: postings, idf ranking, nearest neighbours, fusion, budget, evidence.

Everything joins on equal keys (document, term, page); document text is read once for its postings, and joined only for the few chunks that are kept.
Chunks of a document are in the order of their ids; only what shows a chunk's place numbers them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import fixed, text
from ..sources import stages
from . import answers, neighbours
from .ordered import numbered

#: Question terms that are broadcast to the scan of the chunks at most.
BROADCAST_TERMS = 500_000
#: Query vectors of a scope that a task holds: some ten megabytes at 64 components.
HELD = 32_768


def chunks(docs: DataFrame) -> DataFrame:
    """Documents as chunks of their source: (doc, chunk_id, content), straight from the scan."""
    return docs.select(F.col("source").alias("doc"), F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))


def indexed(docs: DataFrame) -> DataFrame:
    """Where each chunk stands in its document: (doc, chunk_id, chunk_index); no text is read."""
    return numbered(docs.select(F.col("source").alias("doc"), F.col("doc_id").alias("chunk_id")), "doc", "chunk_id", "chunk_index")


def questions(benchmark: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, doc, question): each whole item, asked of the manuscript that holds the document of its number; items without such a document are not asked."""
    asked = benchmark.select("item_id", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("question"))
    return asked.join(docs.select(F.col("doc_id").alias("item_id"), F.col("source").alias("doc")), "item_id").select("item_id", "doc", "question")


def terms(asked: DataFrame) -> DataFrame:
    return asked.select("item_id", "doc", F.explode(text.query_tokens(F.col("question"))).alias("term"))


def _place(parts: DataFrame) -> str:
    """What orders a document's chunks."""
    return "chunk_index" if "chunk_index" in parts.columns else "chunk_id"


def vocabulary(parts: DataFrame) -> DataFrame:
    """(doc, term, df): how many chunks of a document hold each of its words."""
    return parts.select("doc", F.explode(F.array_distinct(text.surface_words(F.col("content")))).alias("term")).groupBy("doc", "term").agg(F.count("*").alias("df"))


def postings(parts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc, chunk_id, term, tf) of the wanted (doc, term), with chunk_index where parts have one; tf counts the places of the term in the chunk.

    Chunks of other documents are not read for words, and nothing else is shuffled.
    """
    keys = ["doc", *dict.fromkeys(["chunk_id", _place(parts)]), "term"]
    words = lambda of: of.select(*keys[:-1], F.explode(text.surface_words(F.col("content"))).alias("term"))
    few = wanted.select("doc", "term").distinct()
    few = F.broadcast(few) if few.count() <= BROADCAST_TERMS else few
    return words(parts.join(few.select("doc").distinct(), "doc", "left_semi")).join(few, ["doc", "term"], "left_semi").groupBy(*keys).agg(F.count("*").alias("tf"))


def frequencies(asked: DataFrame, posted: DataFrame) -> DataFrame:
    """Of every asked (doc, term) the count of chunks that have it, zero included."""
    counted = posted.groupBy("doc", "term").agg(F.count("*").alias("df"))
    return terms(asked).join(counted, ["doc", "term"], "left").select("item_id", "doc", "term", F.coalesce("df", F.lit(0)).alias("df"))


def weighed(asked: DataFrame, parts: DataFrame, posted: DataFrame) -> DataFrame:
    """Asked terms, those that no chunk has included, with df, n (chunks of the document), informative and idf."""
    sizes = parts.groupBy("doc").agg(F.count("*").alias("n"))
    rows = frequencies(asked, posted).join(sizes, "doc")
    informative = (F.col("n") < fixed.LEAST_CHUNKS) | (F.col("df") <= F.col("n") * fixed.DROP_RATIO) | F.col("term").rlike("[0-9]")
    return rows.withColumn("informative", informative).withColumn("idf", F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))


def asked_postings(asked: DataFrame, parts: DataFrame) -> DataFrame:
    """Postings of the asked terms as a stage table: texts are read once for the counts and for the hits."""
    return stages.staged(postings(parts, terms(asked)), "postings")


def hits(asked: DataFrame, parts: DataFrame, posted: DataFrame | None = None) -> DataFrame:
    """Chunks and the informative asked terms that they hold: (item_id, doc, term, idf, chunk_id). The asked terms with their weights are the small side."""
    posted = asked_postings(asked, parts) if posted is None else posted
    return posted.join(weighed(asked, parts, posted).filter("informative and df > 0"), ["doc", "term"])


def matched(asked: DataFrame, parts: DataFrame, posted: DataFrame | None = None) -> DataFrame:
    """Chunks that hold an informative asked term: (item_id, doc, chunk_id, score, hits, density), with chunk_index where parts have one.

    density is the cover density of the terms, any of which will do: then every place of a term is a minimal cover of one word, of weight COVER,
    and of a term's places the first PLACES count.
    """
    keys = ["item_id", "doc", *dict.fromkeys(["chunk_id", _place(parts)])]
    places = F.sum(F.least("tf", F.lit(fixed.PLACES)))
    return hits(asked, parts, posted).groupBy(*keys).agg(F.round(F.sum("idf"), 6).alias("score"), F.count("*").alias("hits"), F.round(places * fixed.COVER, 1).alias("density"))


def lexical(asked: DataFrame, parts: DataFrame, k: int = fixed.CANDIDATES) -> DataFrame:
    """The k best chunks by summed idf; ties go to the denser covers, then to the earlier chunk."""
    order = Window.partitionBy("item_id", "doc").orderBy(F.desc("score"), F.desc("density"), _place(parts))
    return matched(asked, parts).withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k).drop("hits", "density")


def coverage(asked: DataFrame, parts: DataFrame) -> DataFrame:
    """How much of the asked weight the best chunk holds, and whether any term or any term with a digit occurs."""
    posted = asked_postings(asked, parts)
    known, scored = weighed(asked, parts, posted), matched(asked, parts, posted)
    counts = F.col("informative") & ~((F.col("df") == 0) & F.col("term").isin(fixed.TASK_WORDS.split()))
    whole = known.groupBy("item_id", "doc").agg(F.sum(F.when(counts, F.col("idf"))).alias("whole"), F.max(F.col("df") > 0).alias("lexical_hit"), F.max((F.col("df") > 0) & F.col("term").rlike("[0-9]")).alias("identifier_hit"))
    top = scored.groupBy("item_id", "doc").agg(F.max("score").alias("top"))
    rate = F.when(F.coalesce("whole", F.lit(0.0)) > 0, F.least(F.lit(1.0), F.coalesce("top", F.lit(0.0)) / F.col("whole"))).otherwise(0.0)
    return whole.join(top, ["item_id", "doc"], "left").select("item_id", "doc", F.round(rate, 4).alias("coverage"), "lexical_hit", "identifier_hit")


def named(asked: DataFrame, parts: DataFrame) -> DataFrame:
    """(item_id, doc) of questions that hold a proper name which the document itself writes with a capital. Capitalised words of asked documents are extracted once and joined by equality."""
    names = asked.select("item_id", "doc", F.explode(answers.proper_names(F.col("question"))).alias("name"))
    keys = names.select("doc", "name").distinct()
    words = parts.join(keys.select("doc").distinct(), "doc", "left_semi").select("doc", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"\p{Lu}[\p{L}\p{M}'’-]{2,}"), F.lit(0)))).alias("word"))
    written = words.select("doc", F.lower("word").alias("name")).join(keys, ["doc", "name"], "left_semi").distinct()
    return names.join(written, ["doc", "name"], "left_semi").select("item_id", "doc").distinct()


def spoken(asked: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, doc, same_language): whether the question is in its document's language, that of most letters of its pages (source, lang, n_chars); null where either is not known."""
    of = docs.filter("lang is not null and lang <> 'und'").groupBy(F.col("source").alias("doc"), "lang").agg(F.sum("n_chars").alias("n"))
    of = of.groupBy("doc").agg(F.max_by("lang", F.struct("n", "lang")).alias("lang"))
    said = asked.select("item_id", "doc", F.explode(F.array(text.question_language(F.col("question")))).alias("said")).join(of, "doc", "left")
    return said.select("item_id", "doc", F.when((F.col("said") == "und") | F.col("lang").isNull(), None).otherwise(F.col("said") == F.col("lang")).alias("same_language"))


def nearest(queries: DataFrame, candidates: DataFrame, scope: list[str], k: int, key: str) -> DataFrame:
    """Exact k nearest by cosine inside a scope: (query_id, key, score, rank).

    No pair is a row. A scope's queries and candidates meet in one sorted partition, where the queries are held and the candidates stream past, and only k rows of each
    query leave it. A scope of more than its share of the pairs has its candidates divided and its queries copied to each part, to no more rows than it has candidates;
    more than HELD queries are divided, too.
    """
    units = 2 * queries.sparkSession.sparkContext.defaultParallelism
    own, names = key == "vec_id", [f"scope{n}" for n in range(len(scope))]
    kind = "array<float>" if {df.schema["embedding"].dataType.simpleString() for df in (queries, candidates)} == {"array<float>"} else "array<double>"

    def side(df: DataFrame, n: int, name: str) -> DataFrame:
        ids = {c: F.col(c) if c == name else F.lit(None).cast(of.schema[c].dataType) for c, of in (("query_id", queries), (key, candidates))}
        keys = [((F.col(c) + 0.0).cast("string") if dict(df.dtypes)[c] in ("float", "double") else F.col(c)).alias(a) for c, a in zip(scope, names, strict=True)]  # NaN and -0.0 are equal to themselves and 0.0
        df = df.select(*keys, F.lit(n).alias("side"), *[x.alias(c) for c, x in ids.items()], F.col("embedding").cast(kind).alias("embedding"))
        return df.filter(" and ".join(f"{c} is not null" for c in [*names, *([name] if own else [])]))

    rows = side(queries, 0, "query_id").unionByName(side(candidates, 1, key))
    sizes = rows.groupBy(*names).agg(F.count_if(F.col("side") == 0).alias("q"), F.count_if(F.col("side") == 1).alias("c")).filter("q > 0 and c > 0").withColumn("pairs", F.col("q").cast("double") * F.col("c"))
    large = sizes.crossJoin(F.broadcast(sizes.agg(F.sum("pairs").alias("all")))).filter((F.col("pairs") * units > F.col("all")) | (F.col("q") > HELD))
    many = F.ceil(F.col("q") / HELD)
    parts = F.least(F.ceil(F.col("pairs") * units / F.col("all") / many), F.greatest(F.lit(1), F.floor(F.col("c") / F.col("q"))))
    rows = rows.join(F.broadcast(large.select(*names, many.alias("many"), parts.alias("parts"))), names, "left")

    many, parts = (F.coalesce(c, F.lit(1)).cast("int") for c in ("many", "parts"))
    copies = lambda n, part: F.transform(F.sequence(F.lit(0), n - 1), part)
    drawn = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    asked, held = copies(parts, lambda n: drawn("query_id", many) * parts + n), copies(many, lambda n: n * parts + drawn(key, parts))
    rows = rows.select(*names, F.explode(F.when(F.col("side") == 0, asked).otherwise(held)).alias("part"), "side", "query_id", key, "embedding")
    dealt = rows.repartition(2 * units, *names, "part").sortWithinPartitions(*names, "part", "side", "query_id", key)

    schema = StructType([*[f for f in dealt.schema.fields if f.name in ("query_id", key)], StructField("score", DoubleType())])
    scored = dealt.mapInArrow(lambda batches: neighbours.best(batches, [*names, "part"], key, k, own), schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)


def semantic(asked: DataFrame, parts: DataFrame, embeddings: DataFrame, k: int = fixed.CANDIDATES) -> DataFrame:
    """Ranked chunks by the question's vector (the one stored under the question's id)."""
    q = asked.join(embeddings.select(F.col("vec_id").alias("item_id"), "embedding"), "item_id").select(F.col("item_id").alias("query_id"), "doc", "embedding")
    c = parts.select("doc", "chunk_id").join(embeddings.select(F.col("vec_id").alias("chunk_id"), "embedding"), "chunk_id")
    return nearest(q, c, ["doc"], k, "chunk_id").select(F.col("query_id").alias("item_id"), "chunk_id", "score", "rank")


def paged(asked: DataFrame, index: DataFrame, pages: Column) -> DataFrame:
    """Chunks on named pages, by equality of exploded pages, in page order. index: (doc, chunk_id, chunk_index)."""
    named = asked.select("item_id", "doc", F.explode(pages).alias("page"))
    hit = index.withColumn("page", F.col("chunk_index") + 1).join(named, ["doc", "page"])
    order = Window.partitionBy("item_id").orderBy("chunk_index")
    return hit.select("item_id", "chunk_id", "page", F.row_number().over(order).cast("long").alias("rank"))


def fuse(lists: dict[str, tuple[DataFrame, float]], keep: int = max(3 * fixed.TOP_K, 12)) -> DataFrame:
    """Weighted reciprocal ranks of (item_id, chunk_id, rank) lists; an id counts once in a list, ties go to lexical, semantic and best rank."""
    rows = None
    for name, (ranked, weight) in lists.items():
        one = ranked.groupBy("item_id", "chunk_id").agg(F.min("rank").alias("rank")).select("item_id", "chunk_id", "rank", F.lit(name).alias("list"), F.lit(float(weight)).alias("weight"))
        rows = one if rows is None else rows.unionByName(one)
    ranks = [F.min(F.when(F.col("list") == n, F.col("rank"))).alias(f"{n}_rank") for n in lists]
    scored = rows.groupBy("item_id", "chunk_id").agg(F.round(F.sum(F.col("weight") / (fixed.RRF_K + F.col("rank"))), 12).alias("score"), F.min("rank").alias("best"), *ranks)
    ties = [F.asc_nulls_last(f"{n}_rank") for n in ("lexical", "semantic") if n in lists]
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), *ties, "best", "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= keep).drop("best")


def budgeted(ranked: DataFrame, budget: int = fixed.CONTEXT_CHARS, top: int = fixed.TOP_K, least: int = fixed.CUT_LEAST) -> DataFrame:
    """In rank order, whole chunks while they fit; the first that does not is cut if enough room is left or it is the first; nothing after it.

    Needs (item_id, rank, chars). Adds kept_chars and truncated; the walk's stop is the first row where the running sum exceeds the budget.
    """
    w = Window.partitionBy("item_id").orderBy("rank")
    used = F.coalesce(F.sum("chars").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = ranked.withColumn("used", used).filter((F.col("rank") <= top) & (F.col("used") <= budget))
    fits = F.col("used") + F.col("chars") <= budget
    earlier = F.coalesce(F.max((~fits).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = (F.col("rank") == 1) | (budget - F.col("used") >= least)
    rows = rows.withColumn("stopped", earlier).filter((F.col("stopped") == 0) & (fits | cut))
    return rows.withColumn("kept_chars", F.when(fits, F.col("chars")).otherwise(F.greatest(budget - F.col("used"), F.lit(1)))).withColumn("truncated", ~fits).drop("used", "stopped")


def evidence(signals: DataFrame) -> DataFrame:
    """none, weak or strong from cosine, coverage, hits, same_language and the flags found, page_only and degraded."""
    floor = F.when(F.col("same_language").isNull(), min(fixed.FLOOR, fixed.SAME_FLOOR)).when(F.col("same_language"), fixed.SAME_FLOOR).otherwise(fixed.FLOOR)
    mark = F.when(F.col("same_language").isNull(), min(fixed.STRONG, fixed.CROSS_STRONG)).when(F.col("same_language"), fixed.STRONG).otherwise(fixed.CROSS_STRONG)
    informative = F.col("lexical_hit") & (F.col("identifier_hit") | F.col("proper_name_hit") | (F.col("coverage") >= fixed.INFORMATIVE))
    cosine = F.coalesce("cosine", F.lit(-1e9))
    said = (
        F.when(~F.col("found"), "none").when(F.col("page_only"), "strong").when(F.col("degraded"), "weak").when(~informative & (cosine < floor), "none")
        .when(cosine >= mark, "strong").when(informative & (F.col("coverage") >= fixed.STRONG_COVERAGE) & (cosine >= floor), "strong").otherwise("weak")
    )
    return signals.withColumn("informative", informative).withColumn("evidence", said)


def majority(blocks: DataFrame) -> DataFrame:
    """The language of most letters of each document: needs (doc, block, lang, letters); und is ignored, the one that comes first wins among equals."""
    per = blocks.filter("lang <> 'und'").groupBy("doc", "lang").agg(F.sum("letters").alias("letters"), F.min("block").alias("first"))
    return per.groupBy("doc").agg(F.max_by("lang", F.struct("letters", -F.col("first"))).alias("lang"))


def spread(n: Column, most: int) -> Column:
    """Evenly spaced indices of n items, first and last among them."""
    return F.when(n <= most, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.floor(k * (n - 1) / (most - 1) + 0.5).cast("long")))
