"""The corpus pipeline: quality, toxicity, near-duplicates, benchmark contamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of documents, all of them, whatever others they
are called. Null and empty texts are judged like any other by the models, have no shingle and no benchmark item, and encode to nothing; texts of any length are read
whole; repeated rows are judged alike, of near-duplicates one stays; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import bpe, decontam, jaccard, quality, toxicity
from quillstone.llm._shared import settle


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _judged(docs: DataFrame, verdicts: Callable[[DataFrame], DataFrame], column: str, kept: int) -> DataFrame:
    """The rows whose own verdict is ``kept``: the row rides along as a struct, so no join, no shuffle and no clash of names."""
    return verdicts(docs).filter(F.col(column) == kept).select("own.*")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine predicts to be good."""
    machine = quality.train(docs, _table(spark, sf_dir, "labels"))
    return _judged(docs, lambda d: quality.score(d, machine, keep=True), "predicted", 1)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the chain's threshold."""
    chain = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    return _judged(docs, lambda d: toxicity.score(d, chain, keep=True), "toxic", 0)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents linked on shingles of five words at 0.8, the one with the least doc_id.

    Rows that share a doc_id but not their text are judged each for itself; of rows that share both one stays.
    """
    return jaccard.keep_one(docs, shingle=5, num=80, den=100)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in whose texts no benchmark item is found."""
    return decontam.clean(docs, _table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its count of ids and the digests of ids and decoded bytes."""
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return bpe.digests(docs, f.read(), public_tokenizers.PATTERN)


STAGES = [("quality", keep_quality), ("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_benchmark), ("encoding", encode)]

#: Two stages are learned and one finds components: SQL can't express the rows. tests/llm/test_pipeline.py holds them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
