"""What each row decides for the rows after it: admission, budgets, a page ledger. One ordered pass over each key that holds its state alone, never its rows.

Keys are dealt by hash and sorted in their tasks, so a task streams through its keys one after another. A key's own order can't be divided: its next decision needs the
last one.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows turned into Python values at a time.
ROWS = 1024


def walked(rows: DataFrame, key: list[str], order: list[str], start: Callable[[], Any], step: Callable[[Any, dict], dict], adds: str) -> DataFrame:
    """rows with the columns ``adds`` (a schema), made by ``step`` from the key's state and the row, in order. ``start`` makes a key's first state; ``step`` may change it."""
    new = StructType.fromDDL(adds)
    kinds = {f.name: pa.array([], _ARROW[f.dataType.simpleString()]).type for f in new.fields}
    schema = StructType([*rows.schema.fields, *new.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for whole in batches:
            for k in range(0, whole.num_rows, ROWS):
                batch = whole.slice(k, ROWS)
                made = []
                for row in batch.to_pylist():
                    own = tuple(row[c] for c in key)
                    if own != at or state is None:
                        at, state = own, start()
                    made.append(step(state, row))
                yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array([m[n] for m in made], t) for n, t in kinds.items()]], [*batch.schema.names, *kinds])

    return rows.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(run, schema)


_ARROW = {"bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "double": pa.float64(), "int": pa.int32()}


def admitted(calls: DataFrame, key: list[str], at: str, limit: int, window: int, order: tuple[str, ...] = ()) -> DataFrame:
    """calls with ``begins`` and ``waits``: when each may begin if no more than ``limit`` of its key begin in any ``window``, first come, first served. Times are whole numbers of one unit.

    A call begins when it arrives, when the one before it has begun, and when the one ``limit`` before it is a whole window old, whichever is last.
    """

    def step(begun: deque, row: dict) -> dict:
        now = row[at]
        if now is None:
            return {"begins": None, "waits": None}
        begins = max(now, begun[-1] if begun else now, begun[0] + window if len(begun) == limit else now)
        begun.append(begins)
        return {"begins": begins, "waits": begins - now}

    return walked(calls, key, [at, *order], lambda: deque(maxlen=limit), step, "begins long, waits long")


def tried(calls: DataFrame, key: list[str], at: str, limit: int, window: int, order: tuple[str, ...] = ()) -> DataFrame:
    """calls with ``allowed`` and ``retry``: a call is allowed while fewer than ``limit`` allowed ones are younger than ``window``; a refused one takes nothing and is told how long to wait."""

    def step(young: deque, row: dict) -> dict:
        now = row[at]
        if now is None:
            return {"allowed": False, "retry": None}
        while young and young[0] <= now - window:
            young.popleft()
        if len(young) < limit:
            young.append(now)
            return {"allowed": True, "retry": 0}
        return {"allowed": False, "retry": max(1, young[0] + window - now)}

    return walked(calls, key, [at, *order], deque, step, "allowed boolean, retry long")


def reserved(requests: DataFrame, day: str, kinds: str, order: list[str], budgets: dict[str, int]) -> DataFrame:
    """requests with ``allowed`` and ``short``: one unit of the day's budget of each of the array ``kinds``, or of none; ``short`` is the first kind that has run out.

    A kind without a budget, or one of 0, has no limit. A kind named twice takes two units. Needs (day, kinds) and an order inside the day.
    """

    def step(used: dict[str, int], row: dict) -> dict:
        wanted: dict[str, int] = {}
        for kind in row[kinds] or []:
            wanted[kind] = wanted.get(kind, 0) + 1
        short = next((k for k, n in wanted.items() if budgets.get(k, 0) > 0 and used.get(k, 0) + n > budgets[k]), None)
        if short is None:
            for k, n in wanted.items():
                used[k] = used.get(k, 0) + n
        return {"allowed": short is None, "short": short}

    return walked(requests, [day], order, dict, step, "allowed boolean, short string")


# Failures one after another that end a document's reading; failures that the limits of time or memory made.
GIVE_UP, STOPS = 5, ("timeout", "memory")


def ledger(outcomes: DataFrame, doc: str, order: list[str], most_stops: int | None = None) -> DataFrame:
    """outcomes (doc, page, reason: null if read) with ``counts`` and ``over``: whether each settled its page, and whether the document had been given up before it.

    A page is settled once; later words on it count for nothing. Five failures one after another, or ``most_stops`` of time or memory, end the document.
    The state holds the numbers of settled pages.
    """

    def step(s: dict, row: dict) -> dict:
        over = s["row"] >= GIVE_UP or most_stops is not None and s["stops"] >= most_stops
        counts = not over and row["page"] is not None and row["page"] not in s["pages"]
        if counts:
            s["pages"].add(row["page"])
            s["row"] = 0 if row["reason"] is None else s["row"] + 1
            s["stops"] += row["reason"] in STOPS
        return {"counts": counts, "over": over}

    return walked(outcomes, [doc], order, lambda: {"pages": set(), "row": 0, "stops": 0}, step, "counts boolean, over boolean")


def settled(outcomes: DataFrame, doc: str, order: list[str], most_stops: int | None = None) -> DataFrame:
    """(doc, read, failed, gave_up): what ledger() comes to for each document."""
    rows = ledger(outcomes, doc, order, most_stops)
    read = F.col("counts") & F.col("reason").isNull()
    last = F.max(F.col("over"))
    return rows.groupBy(doc).agg(F.count_if(read).alias("read"), F.count_if(F.col("counts") & F.col("reason").isNotNull()).alias("failed"), last.alias("ignored_after_giving_up"))


# Confidence from which two languages' readings are joined, how much less sure the joined one may be, and how near readings are told apart by their script.
COMBINE, TOLERANCE, NEAR = 40, 2, 3


def trial(lines: DataFrame) -> DataFrame:
    """(page, line, lang, text): of every line the reading to keep, from lines (page, lang, line, text, confidence, arabic).

    A page's best language is the one of the highest mean confidence by characters; of those within three points, one whose share of Arabic letters fits its script.
    The second best takes part if both are above 40 and of another script; then each line is the surer reading's.
    """
    from pyspark.sql import Window

    chars = F.length(F.regexp_replace("text", r"\s", ""))
    rtl = F.regexp_count("text", F.lit(r"\p{IsArabic}")) / F.greatest(F.regexp_count("text", F.lit(r"\p{L}")), F.lit(1))
    runs = lines.groupBy("page", "lang", "arabic").agg((F.sum(chars * F.col("confidence")) / F.greatest(F.sum(chars), F.lit(1))).alias("mean"), (F.sum(rtl * chars) / F.greatest(F.sum(chars), F.lit(1))).alias("share"))
    page = Window.partitionBy("page")
    fits = (F.col("arabic") == (F.col("share") >= 0.5)).cast("int")
    ranked = runs.withColumn("near", F.col("mean") >= F.max("mean").over(page) - NEAR).withColumn("fits", fits)
    order = page.orderBy(F.desc("near"), F.desc(F.when(F.col("near"), F.col("fits")).otherwise(0)), F.desc("mean"), "lang")
    best = ranked.withColumn("rank", F.row_number().over(order)).withColumns({"top": F.first("arabic").over(order), "top_mean": F.first("mean").over(order)})
    other = best.filter((F.col("rank") > 1) & (F.col("arabic") != F.col("top")) & (F.col("mean") > COMBINE) & (F.col("top_mean") > COMBINE))
    second = other.groupBy("page").agg(F.min("rank").alias("rank"))
    used = best.filter("rank = 1").select("page", "lang", "rank").unionByName(best.join(second, ["page", "rank"], "left_semi").select("page", "lang", "rank"))
    kept = lines.join(used, ["page", "lang"]).groupBy("page", "line").agg(F.max_by(F.struct("lang", "text"), F.struct("confidence", -F.col("rank"))).alias("x"))
    return kept.select("page", "line", "x.lang", "x.text")
