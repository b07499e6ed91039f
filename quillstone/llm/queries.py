"""The thin queries opN_<name>: each applies its operator with production parameters to its whole table."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, codes, collisions, decontam, extract, jaccard, periods, quality, shards, tokenfile, topk, toxicity, urls

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def _vocabulary(name: str) -> bytes:
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


#: The rules of the URL filter.
RULES = [urls.Rule("com/en/", "block"), urls.Rule("example.com/en/7", "allow"), urls.Rule("net/de/", "allow"), urls.Rule("example.net/de/8", "block"), urls.Rule("org/es/", "block")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"), RULES)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(_table(spark, sf_dir, "pages"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_table(spark, sf_dir, "documents"), shingle=4, num=85, den=100)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, remembered=1_200_000)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.read(*tokenfile.write(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json").decode(), end=0))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(_table(spark, sf_dir, "documents"))


def _planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Fixed rule of op11: the words of a tenth of the documents repeat from some word on. A document without an id stays as it is."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.find(_table(spark, sf_dir, "documents"), edit=_planted)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    found = found.withColumns({"best": best, "lines": F.array_join(lines, "")})
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collisions.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    books = codes.train(vectors)
    return codes.coded(vectors, books).select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def queries() -> dict[str, Query]:
    return {"op1_exact_topk": op1_exact_topk, "op2_url_filter": op2_url_filter, "op3_quality": op3_quality, "op4_toxicity": op4_toxicity, "op5_html_extract": op5_html_extract, "op6_ngram_jaccard": op6_ngram_jaccard, "op7_byte_bpe": op7_byte_bpe, "op8_decontamination": op8_decontamination, "op9_token_files": op9_token_files, "op10_sharding": op10_sharding, "op11_periodic_runs": op11_periodic_runs, "op12_embedding_neardup": op12_embedding_neardup, "op13_vector_codes": op13_vector_codes}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_topk": topk.ORACLE_SQL, "op10_sharding": shards.oracle(), "op11_periodic_runs": periods.oracle(), "op12_embedding_neardup": collisions.ORACLE_SQL, "op13_vector_codes": codes.ORACLE_SQL}
