"""Queries of ordered folds: events as calls, requests and page outcomes. DuckDB walks the same rows by recursion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import refusals as R
from ..operators import walks as W
from ..operators.limits import quota_day
from .registry import query, table

CALLS = "c AS MATERIALIZED (SELECT event_id, user_id, epoch_us(ts) AS t0, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"


def _calls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))


@query(f"""WITH RECURSIVE {CALLS}, w AS (
  SELECT user_id, 1 AS n, event_id, t0 AS begins, [t0] AS last, 0::BIGINT AS waits FROM c WHERE n = 1
  UNION ALL SELECT user_id, n, event_id, begins, (CASE WHEN len(last) = 2 THEN last[2:] ELSE last END) || [begins], begins - t0 FROM (
    SELECT c.user_id, c.n, c.event_id, c.t0, w.last, greatest(c.t0, w.last[-1], CASE WHEN len(w.last) = 2 THEN w.last[1] + 7200000000 ELSE c.t0 END) AS begins FROM w JOIN c ON c.user_id = w.user_id AND c.n = w.n + 1))
SELECT event_id, begins, waits FROM w""")
def st_admit(spark: SparkSession, d: str) -> DataFrame:
    """When each user's calls begin if two may begin in any two hours, first come, first served."""
    return W.admitted(_calls(spark, d), ["user_id"], "at", 2, 7_200_000_000, ("event_id",)).select("event_id", "begins", "waits")


@query(f"""WITH RECURSIVE {CALLS}, w AS (
  SELECT user_id, 1 AS n, event_id, true AS allowed, 0::BIGINT AS retry, [t0] AS young FROM c WHERE n = 1
  UNION ALL SELECT user_id, n, event_id, len(young) < 2, CASE WHEN len(young) < 2 THEN 0 ELSE greatest(1, young[1] + 36000000000 - t0) END, CASE WHEN len(young) < 2 THEN young || [t0] ELSE young END FROM (
    SELECT c.user_id, c.n, c.event_id, c.t0, list_filter(w.young, lambda t: t > c.t0 - 36000000000) AS young FROM w JOIN c ON c.user_id = w.user_id AND c.n = w.n + 1))
SELECT event_id, allowed, retry FROM w""")
def st_try(spark: SparkSession, d: str) -> DataFrame:
    """Which of each user's calls are allowed, two in any ten hours, and how long the refused wait; a refused one takes nothing."""
    return W.tried(_calls(spark, d), ["user_id"], "at", 2, 36_000_000_000, ("event_id",)).select("event_id", "allowed", "retry")


@query("""WITH RECURSIVE r AS MATERIALIZED (SELECT event_id, date_trunc('day', ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/Los_Angeles') AS day, event_type IN ('click', 'view', 'purchase') AS llm, event_type IN ('click', 'error') AS embed, event_type = 'purchase' AS aux FROM events),
k AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY day ORDER BY event_id) AS n FROM r),
w AS (SELECT day, 0::BIGINT AS n, NULL::BIGINT AS event_id, NULL::BOOLEAN AS allowed, NULL::VARCHAR AS short, 0 AS ul, 0 AS ue, 0 AS ua FROM (SELECT DISTINCT day FROM k)
  UNION ALL SELECT day, n, event_id, short IS NULL, short, ul + (short IS NULL AND llm)::INTEGER, ue + (short IS NULL AND embed)::INTEGER, ua + (short IS NULL AND aux)::INTEGER FROM (
    SELECT k.day, k.n, k.event_id, llm, embed, aux, ul, ue, ua, CASE WHEN llm AND ul >= 90 THEN 'llm' WHEN embed AND ue >= 60 THEN 'embed' WHEN aux AND ua >= 20 THEN 'aux' END AS short FROM w JOIN k ON k.day = w.day AND k.n = w.n + 1))
SELECT event_id, allowed, short FROM w WHERE n > 0""")
def st_reserve(spark: SparkSession, d: str) -> DataFrame:
    """Each event takes a unit of every budget that its kind needs, or of none, by Pacific days."""
    need = lambda kind, *types: F.when(F.col("event_type").isin(*types), F.lit(kind))
    kinds = F.array_compact(F.array(need("llm", "click", "view", "purchase"), need("embed", "click", "error"), need("aux", "purchase")))
    rows = table(spark, d, "events").select("event_id", quota_day(F.col("ts")).alias("day"), kinds.alias("kinds"))
    return W.reserved(rows, "day", "kinds", ["event_id"], {"llm": 90, "embed": 60, "aux": 20}).select("event_id", "allowed", "short")


@query("""WITH RECURSIVE k AS MATERIALIZED (SELECT user_id, event_id, event_id % 61 AS page, event_type IN ('error', 'click') AS failed, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
w AS (SELECT user_id, 0::BIGINT AS n, []::BIGINT[] AS pages, 0 AS lost, 0 AS read, 0 AS bad, false AS ignored FROM (SELECT DISTINCT user_id FROM k)
  UNION ALL SELECT user_id, n, CASE WHEN counts THEN pages || [page] ELSE pages END, CASE WHEN NOT counts THEN lost WHEN failed THEN lost + 1 ELSE 0 END, read + (counts AND NOT failed)::INTEGER, bad + (counts AND failed)::INTEGER, ignored OR lost >= 5 FROM (
    SELECT k.user_id, k.n, page, failed, pages, lost, read, bad, ignored, lost < 5 AND NOT list_contains(pages, page) AS counts FROM w JOIN k ON k.user_id = w.user_id AND k.n = w.n + 1))
SELECT user_id, arg_max(read, n)::BIGINT AS read, arg_max(bad, n)::BIGINT AS failed, arg_max(ignored, n) AS ignored_after_giving_up FROM w GROUP BY user_id""")
def ocr_settled(spark: SparkSession, d: str) -> DataFrame:
    """Page outcomes of every user's document: settled once, given up after five failures one after another."""
    reason = F.when(F.col("event_type") == "error", "timeout").when(F.col("event_type") == "click", "crash")
    rows = table(spark, d, "events").select("user_id", "event_id", (F.col("event_id") % 61).alias("page"), reason.alias("reason"))
    return W.settled(rows, "user_id", ["event_id"])


@query(None)
def ocr_joined(spark: SparkSession, d: str) -> DataFrame:
    """Every line of every document as two languages' packs read it, one of them in another script, and the reading that stays."""
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("line", "text"))
    sure = F.pmod(F.xxhash64("text"), F.lit(60)) + 35.0
    latin = lines.select("page", "line", F.lit("lat").alias("lang"), "text", sure.alias("confidence"), F.lit(False).alias("arabic"))
    arabic = lines.select("page", "line", F.lit("ara").alias("lang"), F.translate(F.lower("text"), "abcdefghij", "ابتثجحخدذر").alias("text"), (115 - sure).alias("confidence"), F.lit(True).alias("arabic"))
    return W.trial(latin.unionByName(arabic))


@query("SELECT doc_id, text FROM documents WHERE source <> 'src3' AND doc_id % 10 <> 0 UNION ALL SELECT doc_id, lang || ' ' || text FROM documents WHERE source <> 'src3' AND doc_id % 10 = 0")
def snk_batches(spark: SparkSession, d: str) -> DataFrame:
    """All documents staged, a tenth of them staged again with another text, the first batch replayed, and one source removed."""
    from ..sources.stages import path
    from ..sources.store import Store

    docs = table(spark, d, "documents")
    store = Store(spark, path(spark, "store"), "doc_id long, text string", ["doc_id"])
    first = docs.select("doc_id", "text")
    store.put(first, 1)
    store.put(docs.filter("doc_id % 10 = 0").select("doc_id", F.concat("lang", F.lit(" "), "text").alias("text")), 2)
    store.put(first, 1)
    store.remove(docs.filter("source = 'src3'").select("doc_id"), 3)
    return store.read()


MANDATED = (*fixed.NOT_FOUND.values(), "**[[NOT_IN_DOCUMENT]]**", "> not found", "[[NO_ANSWER]]")


@query(f"SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN '' ELSE text END AS text, conv_id % 2 = 0 AS refused FROM conversations WHERE turn % 2 = 0 UNION ALL SELECT conv_id, turn, 'Not in ' || text, false FROM conversations WHERE turn % 2 = 1")
def st_hold_all(spark: SparkSession, d: str) -> DataFrame:
    """All turns as streams of five characters: every second conversation's even turns refuse, in all languages and in capitals; odd turns only begin like a refusal."""
    k = F.col("conv_id")
    head = F.get(F.array(*[F.upper(F.lit(m)) if i % 2 else F.lit(m) for i, m in enumerate(MANDATED)]), (F.floor(k / 2) % len(MANDATED)).cast("int"))
    said = F.when(F.col("turn") % 2 == 1, F.concat(F.lit("Not in "), "text")).when(k % 2 == 0, F.concat(head, F.lit(" "), "text")).otherwise(F.col("text"))
    whole = table(spark, d, "conversations").select("conv_id", "turn", said.alias("said"))
    cuts = F.sequence(F.lit(0).cast("long"), F.greatest(F.floor((F.length("said") - 1) / 5), F.lit(0)).cast("long"))
    parts = whole.select("conv_id", "turn", "said", F.explode(cuts).alias("seq")).select("conv_id", "turn", "seq", F.substring("said", (F.col("seq") * 5 + 1).cast("int"), F.lit(5)).alias("text"))
    shown = R.held(parts, ["conv_id", "turn"])
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "shown"))), lambda x: x["shown"]), "")
    return shown.groupBy("conv_id", "turn").agg(joined.alias("text"), F.max("refused").alias("refused"))
