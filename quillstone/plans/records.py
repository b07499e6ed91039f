"""Queries over conversations, events and tables of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..operators import conversation as C
from ..operators import limits as L
from ..operators.retrieval import numbered
from .registry import query, table

NOW = "2024-01-20 12:00:00"
RECENT = "r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE role IN ('user', 'assistant')) WHERE back <= 6)"


def _messages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations")


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query(f"WITH {RECENT} SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM r")
def win_recent(spark: SparkSession, d: str) -> DataFrame:
    return C.recent(_messages(spark, d)).select("conv_id", "turn", "role", "place")


@query(f"""WITH {RECENT}, u AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used FROM r)
SELECT conv_id, turn, role, substring(text, 1, 600 - used) AS kept FROM u WHERE used < 600""")
def win_history(spark: SparkSession, d: str) -> DataFrame:
    return C.history(_messages(spark, d), chars=600).select("conv_id", "turn", "role", "kept")


@query(f"""WITH {RECENT}, m AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role THEN 0 ELSE 1 END AS new FROM r))
SELECT conv_id, place::BIGINT AS place, role, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM m GROUP BY conv_id, place, role HAVING NOT (place = 1 AND role = 'assistant')""")
def win_alternate(spark: SparkSession, d: str) -> DataFrame:
    return C.alternating(C.recent(_messages(spark, d)))


@query("""WITH q AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS q FROM conversations)
SELECT conv_id, q::BIGINT AS q, min(turn) FILTER (role = 'user') AS question_turn, min(turn) FILTER (role = 'assistant') AS answer_turn FROM q WHERE q > 0 GROUP BY ALL""")
def jn_pairing(spark: SparkSession, d: str) -> DataFrame:
    return C.paired(_messages(spark, d))


@query("""WITH a AS (SELECT *, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS asked FROM conversations)
SELECT conv_id, max(turn) AS answer_turn, arg_max(asked, turn) AS question_turn FROM a WHERE role = 'assistant' AND length(text) % 2 = 0 GROUP BY conv_id""")
def jn_prev_question(spark: SparkSession, d: str) -> DataFrame:
    return C.last_grounded(_messages(spark, d).withColumn("grounded", F.length("text") % 2 == 0))


@query("""WITH e AS (SELECT user_id AS turn_id, event_id AS seq, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'status' ELSE 'token' END AS kind, event_type AS value FROM events)
SELECT turn_id, string_agg(value, '' ORDER BY seq) FILTER (kind = 'token') AS answer, arg_max(value, seq) FILTER (kind = 'status') AS status, max(kind = 'error') AS failed FROM e GROUP BY turn_id""")
def st_fold_turn(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "status").otherwise("token")
    return C.folded(_events(spark, d).select(F.col("user_id").alias("turn_id"), F.col("event_id").alias("seq"), kind.alias("kind"), F.col("event_type").alias("value")))


@query("SELECT conv_id, turn, role, CASE WHEN role = 'assistant' AND length(text) % 5 = 0 THEN 'evidence' END AS refused_by FROM conversations")
def prj_message(spark: SparkSession, d: str) -> DataFrame:
    return _messages(spark, d).select("conv_id", "turn", "role", F.when((F.col("role") == "assistant") & (F.length("text") % 5 == 0), "evidence").alias("refused_by"))


@query("""SELECT event_id, user_id, (row_number() OVER (PARTITION BY user_id, floor(epoch(ts))::BIGINT // 3600 ORDER BY ts, event_id)) <= 1 AS admitted FROM events""")
def st_window(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).withColumn("w", L.window_start(F.col("ts"), 3600))
    return L.admitted(rows, ["user_id", "w"], 1, ["ts", "event_id"]).select("event_id", "user_id", "admitted")


@query("""SELECT event_type, count(*) FILTER (n <= 3) AS admitted, count(*) FILTER (n > 3) AS refused FROM (
  SELECT event_type, row_number() OVER (PARTITION BY user_id, event_type, floor(epoch(ts))::BIGINT // 86400 ORDER BY ts, event_id) AS n FROM events) GROUP BY event_type""")
def st_limits(spark: SparkSession, d: str) -> DataFrame:
    rows = L.admitted(_events(spark, d).withColumn("w", L.window_start(F.col("ts"), 86400)), ["user_id", "event_type", "w"], 3, ["ts", "event_id"])
    return rows.groupBy("event_type").agg(F.count_if("admitted").alias("admitted"), F.count_if(~F.col("admitted")).alias("refused"))


@query(None)
def st_amounts(spark: SparkSession, d: str) -> DataFrame:
    """Admission of calls with amounts; tests hold it against a plain loop."""
    rows = _events(spark, d).select("event_id", "user_id", "ts", L.window_start(F.col("ts"), 86400).alias("w"), (F.col("event_id") % 4 + 1).alias("amount"))
    return L.admitted_amounts(rows, ["user_id", "w"], 5, ["ts", "event_id"]).select("event_id", "admitted")


@query("""SELECT user_id, (SELECT NULL::BIGINT) AS none, sum(CASE WHEN event_type = 'error' THEN -1 ELSE 1 END)::BIGINT AS signed, greatest(0, sum(CASE WHEN event_type = 'error' THEN -1 ELSE 1 END))::BIGINT AS used FROM events GROUP BY user_id""")
def st_counter_ops(spark: SparkSession, d: str) -> DataFrame:
    signed = F.sum(F.when(F.col("event_type") == "error", -1).otherwise(1))
    return _events(spark, d).groupBy("user_id").agg(signed.alias("signed"), F.greatest(F.lit(0), signed).alias("used")).withColumn("none", F.lit(None).cast("long"))


@query("""SELECT day, event_type, n, greatest(0, n - 60)::BIGINT AS refused FROM (
  SELECT timezone('UTC', timezone('America/Los_Angeles', date_trunc('day', timezone('America/Los_Angeles', timezone('UTC', ts))))) AS day, event_type, count(*) AS n FROM events GROUP BY ALL)""")
def st_quota(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).groupBy(L.quota_day(F.col("ts")).alias("day"), "event_type").agg(F.count("*").alias("n"))
    return rows.withColumn("refused", F.greatest(F.lit(0), F.col("n") - 60)).withColumn("day", F.col("day").cast("timestamp_ntz"))


@query("""SELECT request, reserved, used, refused, CASE WHEN refused THEN 0 ELSE greatest(used, 0) END AS net FROM (
  SELECT event_id // 5 AS request, round(sum(CASE WHEN event_type = 'view' THEN value ELSE 0 END), 4) AS reserved, round(sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END), 4) AS used, max(event_type = 'error') AS refused FROM events GROUP BY ALL)""")
def st_spend(spark: SparkSession, d: str) -> DataFrame:
    of = lambda t: F.when(F.col("event_type") == t, F.col("value")).otherwise(0.0)
    rows = L.settled(_events(spark, d).select(F.floor(F.col("event_id") / 5).alias("request"), of("view").alias("reserved"), of("purchase").alias("used"), (F.col("event_type") == "error").alias("refused")))
    return rows.select("request", F.round("reserved", 4).alias("reserved"), F.round("used", 4).alias("used"), "refused", F.round("net", 4).alias("net"))


@query("""SELECT event_id, recent, recent > 2 AS over FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY floor(epoch(ts))::BIGINT RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) AS recent FROM events)""")
def st_pacer(spark: SparkSession, d: str) -> DataFrame:
    return L.paced(_events(spark, d), ["user_id"], 2, 3600).select("event_id", "recent", "over")


@query("""SELECT user_id, min(event_id) AS first, max(event_id) AS last, count(*) AS length FROM (
  SELECT user_id, event_id, n - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE event_type = 'error') GROUP BY user_id, island""")
def win_failrun(spark: SparkSession, d: str) -> DataFrame:
    return L.runs(_events(spark, d).withColumn("bad", F.col("event_type") == "error"), ["user_id"], "event_id", "bad")


@query("""SELECT user_id, max(length) AS longest, max(length) >= 2 AS gave_up FROM (SELECT user_id, island, count(*) AS length FROM (
  SELECT user_id, n - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE event_type IN ('error', 'click')) GROUP BY ALL) GROUP BY user_id""")
def ocr_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Readers that failed twice in a row are given up."""
    found = L.runs(_events(spark, d).withColumn("bad", F.col("event_type").isin("error", "click")), ["user_id"], "event_id", "bad")
    return found.groupBy("user_id").agg(F.max("length").alias("longest"), (F.max("length") >= 2).alias("gave_up"))


@query("SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS position FROM events WHERE value > 50")
def win_queue(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).filter("value > 50").select("event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return numbered(rows, "event_type", "at", "n", ("event_id",)).select("event_id", "event_type", (F.col("n") + 1).alias("position"))


JOBS = "j AS (SELECT event_id, user_id % 10 AS pool, CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 4 DAY END AS lease_until, CASE WHEN event_id % 4 = 0 THEN ts + INTERVAL 3 DAY END AS parked_until, event_id % 5 AS attempts FROM events)"


@query(f"""WITH {JOBS}, l AS (SELECT *, sum(CASE WHEN lease_until > TIMESTAMP '{NOW}' THEN 1 ELSE 0 END) OVER (PARTITION BY pool) AS live FROM j),
o AS (SELECT *, CASE WHEN lease_until > TIMESTAMP '{NOW}' THEN 'held' WHEN parked_until > TIMESTAMP '{NOW}' THEN 'parked' WHEN live >= 45 THEN 'busy' ELSE 'acquired' END AS outcome FROM l)
SELECT event_id, outcome, attempts + CASE WHEN outcome = 'acquired' AND lease_until IS NOT NULL THEN 1 ELSE 0 END AS attempts_after FROM o""")
def st_lease(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    jobs = _events(spark, d).select("event_id", (F.col("user_id") % 10).alias("pool"), F.when(e % 3 == 0, F.expr("ts + INTERVAL 4 DAY")).alias("lease_until"), F.when(e % 4 == 0, F.expr("ts + INTERVAL 3 DAY")).alias("parked_until"), (e % 5).alias("attempts"))
    return L.lease(jobs, F.lit(NOW).cast("timestamp"), 45).select("event_id", "outcome", "attempts_after")


@query(f"""SELECT user_id, created, CASE WHEN epoch(new) - epoch(expires) > 60 THEN new ELSE expires END AS expires FROM (
  SELECT *, least(TIMESTAMP '{NOW}' + INTERVAL 24 HOUR, created + INTERVAL 72 HOUR) AS new FROM (SELECT user_id, max(ts) AS created, max(ts) + INTERVAL 24 HOUR AS expires FROM events GROUP BY user_id))""")
def st_expiry(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).groupBy("user_id").agg(F.max("ts").alias("created")).withColumn("expires", F.expr("created + INTERVAL 24 HOUR"))
    return rows.select("user_id", F.col("created").cast("timestamp_ntz").alias("created"), L.slid(F.col("created"), F.col("expires"), F.lit(NOW).cast("timestamp")).cast("timestamp_ntz").alias("expires"))


@query(f"""SELECT (SELECT count(*) FROM events WHERE ts < TIMESTAMP '{NOW}' - INTERVAL 72 HOUR) AS expired,
  (SELECT count(*) FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)) AS orphans,
  (SELECT count(DISTINCT user_id) FROM events e WHERE NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'purchase')) AS stale""")
def st_retention(spark: SparkSession, d: str) -> DataFrame:
    """Counts of what a clean-up removes; each is an aggregate of its own, joined as single rows."""
    e, docs, labels = _events(spark, d), table(spark, d, "documents"), table(spark, d, "labels")
    expired = e.filter(F.col("ts") < F.expr(f"TIMESTAMP '{NOW}' - INTERVAL 72 HOUR")).agg(F.count("*").alias("expired"))
    orphans = docs.select("doc_id").join(labels.select("doc_id"), "doc_id", "left_anti").agg(F.count("*").alias("orphans"))
    stale = e.groupBy("user_id").agg(F.max(F.col("event_type") == "purchase").alias("bought")).agg(F.count_if(~F.col("bought")).alias("stale"))
    one = lambda x: x.withColumn("_one", F.lit(1))
    return one(expired).join(one(orphans), "_one").join(one(stale), "_one").drop("_one")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type <> 'error') WHERE n = 1")
def flt_latest(spark: SparkSession, d: str) -> DataFrame:
    return L.latest(_events(spark, d).filter("event_type <> 'error'"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query(f"SELECT event_id, user_id FROM events WHERE user_id = 7 AND ts > TIMESTAMP '{NOW}' - INTERVAL 72 HOUR")
def flt_owned(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).filter((F.col("user_id") == 7) & (F.col("ts") > F.expr(f"TIMESTAMP '{NOW}' - INTERVAL 72 HOUR"))).select("event_id", "user_id")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events WHERE event_type = 'view'")
def flt_list(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return _events(spark, d).filter("event_type = 'view'").select("user_id", "event_id", F.row_number().over(w).cast("long").alias("place"))


@query("SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase' ORDER BY ts, event_id LIMIT 25")
def topk_due(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).filter("event_type = 'purchase'").orderBy("ts", "event_id").limit(25).select("event_id", "user_id", "value")


@query("SELECT doc_id, quality, toxic FROM labels UNION ALL SELECT doc_id, -1, -1 FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def snk_keep(spark: SparkSession, d: str) -> DataFrame:
    new = table(spark, d, "documents").select("doc_id", F.lit(-1).alias("quality"), F.lit(-1).alias("toxic"))
    return L.kept(table(spark, d, "labels"), new, ["doc_id"])


@query("SELECT o_custkey, max(o_orderdate) AS version, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def snk_upsert(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", F.col("o_orderdate").alias("version"), "o_orderkey")
    cut = F.col("o_orderkey") % 2 == 0
    joined = o.filter(cut).unionByName(o.filter(~cut))
    return L.latest(joined, ["o_custkey"], [F.desc("version"), F.desc("o_orderkey")])


@query("SELECT source, count(*) AS documents, count(DISTINCT lang) AS langs, sum(n_chars)::BIGINT AS chars, coalesce(sum(CASE WHEN lang = 'xx' THEN n_chars END), 0)::BIGINT AS none FROM documents GROUP BY source")
def agg_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("documents"), F.countDistinct("lang").alias("langs"), F.sum("n_chars").alias("chars"), F.coalesce(F.sum(F.when(F.col("lang") == "xx", F.col("n_chars"))), F.lit(0)).alias("none"))


@query("SELECT coalesce(sum(octet_length(encode(text))), 0)::BIGINT AS bytes FROM documents")
def agg_bytes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"))


@query("SELECT d.doc_id, CASE WHEN l.quality = 0 AND EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id) THEN 'failed' ELSE 'ready' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)")
def upd_guarded(spark: SparkSession, d: str) -> DataFrame:
    held = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("held")).distinct()
    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left").join(held, "doc_id", "left")
    return rows.select("doc_id", F.when((F.col("quality") == 0) & F.col("held"), "failed").otherwise("ready").alias("status"))


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)")
def del_expired(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").filter("toxic = 1").select("doc_id"), "doc_id", "left_anti")


@query("SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey) AND c_acctbal < 5000")
def jn_anti_stale(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").filter("c_acctbal < 5000").select("c_custkey", "c_name").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def prj_props(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select("event_id", F.from_json("props", "k long")["k"].alias("k"))


TUMBLE = "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL"


@query(TUMBLE)
def st_tumbling(spark: SparkSession, d: str) -> DataFrame:
    w = F.window("ts", "1 hour")
    return _events(spark, d).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
  SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def st_sessions(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).groupBy(F.session_window("ts", "6 hours").alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("""SELECT (TIMESTAMP '1970-01-01' + to_seconds(s * 1800)) AS start, count(*) AS n FROM (SELECT unnest([floor(epoch(ts))::BIGINT // 1800, floor(epoch(ts))::BIGINT // 1800 - 1]) AS s FROM events) GROUP BY s""")
def st_sliding(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).groupBy(F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query(TUMBLE)
def st_streamed(spark: SparkSession, d: str) -> DataFrame:
    """The tumbling counts by a stream that reads the table once, with a watermark and a checkpoint."""
    from ..streaming import counters

    return counters.hourly(spark, f"{d}/events.parquet").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query(f"SELECT item_id, coalesce(m, 'I could not find this information in the document. The provided PDF does not appear to cover this topic.') AS message FROM (SELECT item_id, CASE item_id % 5 WHEN 1 THEN '{fixed.NOT_FOUND['fr']}' WHEN 2 THEN '{fixed.NOT_FOUND['es']}' WHEN 3 THEN '{fixed.NOT_FOUND['de']}' END AS m FROM benchmark)")
def msg_notfound(spark: SparkSession, d: str) -> DataFrame:
    lang = F.element_at(F.array(*[F.lit(x) for x in ("en", "fr", "es", "de", "xx")]), (F.col("item_id") % 5 + 1).cast("int"))
    known = spark.createDataFrame(sorted(fixed.NOT_FOUND.items()), "lang string, message string")
    rows = table(spark, d, "benchmark").select("item_id", lang.alias("lang")).join(F.broadcast(known), "lang", "left")  # a row for each language
    return rows.select("item_id", F.coalesce("message", F.lit(fixed.NOT_FOUND["en"])).alias("message"))


@query("SELECT doc_id, text <> '' AS has_text, sha256(text) AS sha256, octet_length(encode(text))::BIGINT AS bytes, contains(substring(text, 1, 1024), '%PDF-') AS is_pdf FROM documents")
def src_upload(spark: SparkSession, d: str) -> DataFrame:
    raw = F.col("text").cast("binary")
    return table(spark, d, "documents").select("doc_id", (F.col("text") != "").alias("has_text"), F.sha2(raw, 256).alias("sha256"), F.octet_length("text").cast("long").alias("bytes"), F.contains(F.substring("text", 1, 1024), F.lit("%PDF-")).alias("is_pdf"))


@query(r"SELECT page_id, CASE WHEN length(b) = 0 THEN 'document' ELSE b END AS name FROM (SELECT page_id, trim(regexp_replace(regexp_replace(string_split_regex(url, '[/\\]')[-1], '[<>:\"|?*]', '', 'g'), '\s+', ' ', 'g')) AS b FROM pages)")
def src_filename(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.file_name(F.col("url")).alias("name"))
