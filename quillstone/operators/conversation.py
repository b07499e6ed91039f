"""Conversations: recent turns, history within a budget, alternation, pairing of questions and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed

BY = ("conv_id", "turn")


def recent(messages: DataFrame, n: int = fixed.HISTORY_MESSAGES) -> DataFrame:
    """The newest n question and answer turns of each conversation, numbered oldest first."""
    kept = messages.filter(F.col("role").isin("user", "assistant"))
    down = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    up = Window.partitionBy("conv_id").orderBy("turn")
    return kept.withColumn("back", F.row_number().over(down)).filter(F.col("back") <= n).withColumn("place", F.row_number().over(up).cast("long")).drop("back")


def history(messages: DataFrame, n: int = fixed.HISTORY_MESSAGES, chars: int = fixed.HISTORY_CHARS) -> DataFrame:
    """Newest turns that fit the budget; the turn that crosses it keeps its beginning, older ones go."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    used = F.coalesce(F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = recent(messages, n).withColumn("used", used).filter(F.col("used") < chars)
    return rows.withColumn("kept", F.substring("text", F.lit(1), (chars - F.col("used")).cast("int"))).drop("used")


def alternating(turns: DataFrame) -> DataFrame:
    """Neighbours of one role joined by an empty line; a leading assistant turn goes: (conv_id, place, role, text)."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    marked = turns.withColumn("new", F.when(F.lag("role").over(w) == F.col("role"), 0).otherwise(1)).withColumn("place", F.sum("new").over(w))
    joined = marked.groupBy("conv_id", "place", "role").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    return joined.filter(~((F.col("place") == 1) & (F.col("role") == "assistant")))


def paired(messages: DataFrame) -> DataFrame:
    """Each question with the first answer before the next question, or null."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = messages.withColumn("q", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w)).filter("q > 0")
    return rows.groupBy("conv_id", "q").agg(F.min(F.when(F.col("role") == "user", F.col("turn"))).alias("question_turn"), F.min(F.when(F.col("role") == "assistant", F.col("turn"))).alias("answer_turn"))


def last_grounded(messages: DataFrame) -> DataFrame:
    """The newest answer that cites and the newest question at or before it."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    rows = messages.withColumn("asked", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w))
    return rows.filter((F.col("role") == "assistant") & F.col("grounded")).groupBy("conv_id").agg(F.max("turn").alias("answer_turn"), F.max_by("asked", "turn").alias("question_turn"))


def folded(events: DataFrame) -> DataFrame:
    """Stream events of a turn as one row: its tokens joined, its last status."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == "token", F.struct("seq", "value")))), lambda x: x["value"]), "")
    return events.groupBy("turn_id").agg(text.alias("answer"), F.max_by("value", F.when(F.col("kind") == "status", F.col("seq"))).alias("status"), F.max(F.col("kind") == "error").alias("failed"))
