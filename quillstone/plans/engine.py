"""The engine as an API: ingest pages, ask questions, sample a document, clean up. Every method returns a lazy DataFrame over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import answers, chunking, layout, retrieval
from ..sources import embeddings


class Engine:
    """``pages``: (doc_id, source, text). ``provider``: how texts are embedded; without a model answers are passages."""

    def __init__(self, spark: SparkSession, provider: embeddings.Provider | None = None):
        self.spark, self.provider = spark, provider or embeddings.Trigrams()

    def ingest(self, pages: DataFrame, **options: int) -> DataFrame:
        """Chunks of all pages: (doc, chunk_id, chunk_index, page, content); chunk_index orders a document's chunks by page, 16 million of a page at most."""
        pages = text.nfkc(pages.select("doc_id", "source", "text"), "text")
        cut = chunking.chunked(pages, **options).join(pages.select("doc_id", F.col("source").alias("doc")), "doc_id")
        key = F.xxhash64("doc_id", "chunk_index")
        return cut.select("doc", key.alias("chunk_id"), (F.shiftleft(F.col("doc_id"), 24) + F.col("chunk_index")).alias("chunk_index"), F.col("doc_id").alias("page"), "content")

    def embed(self, chunks: DataFrame) -> DataFrame:
        return embeddings.embedded(chunks, "chunk_id", "content", self.provider)

    def ask(self, questions: DataFrame, chunks: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
        """(item_id, rank, chunk_id, page, snippet, flagged, evidence) of questions (item_id, doc, question)."""
        questions = text.nfkc(questions.select("item_id", "doc", "question"), "question")
        lists = {"lexical": (retrieval.lexical(questions, chunks), 1.0)}
        signals = retrieval.coverage(questions, chunks)
        if vectors is not None:
            q = embeddings.embedded(questions, "item_id", "question", self.provider).join(questions.select("item_id", "doc"), "item_id").withColumnRenamed("item_id", "query_id")
            near = retrieval.nearest(q, chunks.select("doc", "chunk_id").join(vectors, "chunk_id"), ["doc"], 24, "chunk_id").withColumnRenamed("query_id", "item_id")
            lists["semantic"] = (near, 1.0)
            signals = signals.join(near.groupBy("item_id").agg(F.max("score").alias("cosine")), "item_id", "left")
        else:
            signals = signals.withColumn("cosine", F.lit(None).cast("double"))
        flags = {"same_language": F.lit(None).cast("boolean"), "proper_name_hit": F.lit(False), "found": F.col("lexical_hit") | F.col("cosine").isNotNull(), "page_only": F.lit(False), "degraded": F.lit(vectors is None)}
        said = retrieval.evidence(signals.withColumns(flags)).select("item_id", "evidence")
        fused = retrieval.fuse(lists).join(chunks.select("chunk_id", "page", "content", F.length("content").cast("long").alias("chars")), "chunk_id")
        kept = retrieval.budgeted(fused)
        shown = text.flagged(kept, "content").select("item_id", "rank", "chunk_id", "page", text.snippet(F.col("content")).alias("snippet"), (F.size("signals") > 0).alias("flagged"))
        return shown.join(said, "item_id")

    def overview(self, chunks: DataFrame, most: int = 8) -> DataFrame:
        """Representative chunks of every document."""
        rows = chunks.select("doc", "chunk_index", F.col("page").alias("page_start"), F.col("page").alias("page_end"), F.lit(None).cast("string").alias("section"))
        return layout.sampled(rows, most).join(chunks, ["doc", "chunk_index"])

    def reveal(self, replies: DataFrame) -> DataFrame:
        """Finished replies with valid markers only: needs (reply, excerpt_count)."""
        return answers.replies(replies)
