"""Rules that the tables hold no text for, over all rows of a table: what a rule looks for stands before, behind or between what the row says itself."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..operators import answers as A
from ..operators import ingest as I  # noqa: E741
from ..operators import languages
from ..operators import limits as L
from ..operators import replies as P
from ..operators import silences
from .registry import norm_sql, query, table

LATIN = "abcdefghijklmnopqrstuvwxyz"
#: Letters of three languages of one script that Latin ones become.
SCRIPTS = ("ابتثجحخدذرزسشصضطظعغفقكلمنه", "ابتثجحخدذرزسشپچژگظعغفقکلمنه", "ابتثجحخدذرزسشٹڈڑںےعغفقکلمنه")


def _of(k: Column, values: list[str] | tuple[str, ...]) -> Column:
    return F.get(F.array(*map(F.lit, values)), (k % len(values)).cast("int"))


def _sql(k: str, values: list[str] | tuple[str, ...]) -> str:
    said = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"[{said}][{k} % {len(values)} + 1]"


@query(f"""SELECT doc_id, CASE WHEN regexp_matches(t, '[ٹڈڑںےھ]') THEN 'ur' WHEN regexp_matches(t, '[پچژگ]') OR length(t) - length(translate(t, 'کی', '')) > length(t) - length(translate(t, 'كي', '')) THEN 'fa' ELSE 'ar' END AS lang
FROM (SELECT doc_id, translate(lower(text), '{LATIN}', {_sql('doc_id', SCRIPTS)}) AS t FROM documents)""")
def lang_arabic(spark: SparkSession, d: str) -> DataFrame:
    """Every document written in Arabic, Persian or Urdu letters."""
    said = F.expr("CASE doc_id % 3 " + " ".join(f"WHEN {k} THEN translate(lower(text), '{LATIN}', '{s}')" for k, s in enumerate(SCRIPTS)) + " END")
    return table(spark, d, "documents").select("doc_id", F.explode(F.array(said)).alias("said")).select("doc_id", P.arabic_language(F.col("said")).alias("lang"))


PREFIXES = ("", "ال", "وال", "بال", "فلل", "كال")


@query(f"""SELECT DISTINCT word, CASE WHEN length(x) >= 3 AND x <> word THEN x ELSE word END AS stem FROM (SELECT word, regexp_replace(word, '^(?:[وف]?[بكل]?ال|[وف]?لل)', '') AS x FROM (
  SELECT {_sql('length(w)', PREFIXES)} || translate(w, '{LATIN}', '{SCRIPTS[0]}') AS word FROM (SELECT unnest(string_split({norm_sql('text')}, ' ')) AS w FROM documents) WHERE w <> ''))""")
def fn_light_stem(spark: SparkSession, d: str) -> DataFrame:
    """Every word of every document in Arabic letters behind a particle or article."""
    words = table(spark, d, "documents").select(F.explode(text.surface_words(F.col("text"))).alias("w"))
    word = F.concat(_of(F.length("w"), PREFIXES), F.translate("w", LATIN, SCRIPTS[0]))
    return words.select(word.alias("word")).distinct().withColumn("stem", text.light_stem(F.col("word")))


@query(f"SELECT doc_id, {norm_sql(chr(116) + 'ranslate(lower(text), ' + repr(P.FOLD_FROM) + ', ' + repr(P.FOLD_TO) + ')')} AS folded FROM documents")
def inj_fold(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", P.folded(F.col("text")).alias("folded"))


LABELS = ("Query: ", "question : ", "Rewritten question: ", "")


@query(rf"""SELECT item_id, CASE WHEN length(b) <= 300 THEN b ELSE regexp_replace(b[1:300], '\s+\S*$', '') END AS question FROM (SELECT item_id, regexp_replace(trim(regexp_replace(line, '\[S[0-9]+\]', '', 'g')), '^["''“”«»]+|["''“”«»]+$', '', 'g') AS b
FROM (SELECT item_id, '"' || string_split(trim(text), chr(10))[1] || ' [S' || item_id || ']"' AS line FROM benchmark))""")
def fn_rewrite_clean(spark: SparkSession, d: str) -> DataFrame:
    """Every item as a model rewrites it: labelled, quoted, with a marker, and with its other lines after it."""
    said = F.concat(_of(F.col("item_id"), LABELS), F.lit('"'), F.element_at(F.split(F.trim("text"), "\n"), 1), F.lit(" [S"), F.col("item_id").cast("string"), F.lit(']"\n'), "text")
    return table(spark, d, "benchmark").select("item_id", P.rewritten(said).alias("question"))


ASKED_PAGES = (
    ("See page 3 and p. 7", "[3, 7]"), ("pages 2-4", "[2, 3, 4]"), ("pages 3 and 5", "[3, 5]"), ("pages 1 to 9", "[1, 9]"), ("page no. 7", "[7]"), ("Seite 12", "[12]"), ("صفحة ١٢", "[12]"), ("الصفحة رقم ٥ و ٨", "[5, 8]"), ("páginas 4 y 6", "[4, 6]"), ("page 400", "[]::INTEGER[]"), ("homepage 3", "[]::INTEGER[]"),
    ("pp. 4–5 & p 9", "[4, 5, 9]"),
)


@query(f"SELECT item_id, [{', '.join(p + '::BIGINT[]' for _, p in ASKED_PAGES)}][item_id % {len(ASKED_PAGES)} + 1] AS pages, regexp_replace(trim(text), '\\s+', ' ', 'g') || CASE WHEN item_id % {len(ASKED_PAGES)} = 0 THEN ' See and' WHEN item_id % {len(ASKED_PAGES)} = 10 THEN ' homepage 3' WHEN item_id % {len(ASKED_PAGES)} = 11 THEN ' &' ELSE '' END AS remainder FROM benchmark")
def fn_page_refs(spark: SparkSession, d: str) -> DataFrame:
    """Every item asked of named pages, and what is left of the question without them."""
    said = F.concat("text", F.lit(" "), _of(F.col("item_id"), [s for s, _ in ASKED_PAGES]))
    return table(spark, d, "benchmark").select("item_id", A.page_references(said, F.lit(50)).alias("pages"), A.without_pages(said).alias("remainder"))


@query("SELECT item_id, item_id % 2 = 0 AS bare FROM benchmark")
def rt_pageonly(spark: SparkSession, d: str) -> DataFrame:
    """Every second item asked of a page; the others name a page and a task alone."""
    said = F.concat(_of(F.col("item_id"), ("summarize page 2 please", "what does page 2 say about ", "Seite 3 read", "page 4: ")), F.when(F.col("item_id") % 2 == 1, F.col("text")).otherwise(""))
    rest = F.filter(text.query_tokens(A.without_pages(F.col("said"))), lambda w: ~w.isin(*fixed.TASK_WORDS.split()))
    return table(spark, d, "benchmark").select("item_id", said.alias("said")).select("item_id", ((F.size(A.page_references(F.col("said"), F.lit(9))) > 0) & (F.size(rest) == 0)).alias("bare"))


@query(r"""WITH w AS (SELECT item_id, string_split(text || ', said Anna Karlsson, Peter', ' ') AS w, len(regexp_extract_all(text || ', said Anna Karlsson, Peter', '[\p{L}\p{N}]+')) AS n FROM (SELECT item_id, regexp_replace(text, '\s+', ' ', 'g') AS text FROM benchmark)),
f AS (SELECT item_id, n, list_filter(list_transform(w, lambda x, i: CASE WHEN i > 1 AND regexp_matches(w[i - 1], '[\p{Ll}\p{N},;]$') THEN regexp_extract(x, '^\p{Lu}[\p{L}\p{M}''’-]{2,}') ELSE '' END), lambda x: x <> '') AS found FROM w)
SELECT item_id, CASE WHEN len(found) * 2 <= n THEN list_sort(list_distinct(list_transform(found, lambda x: lower(x)))) ELSE [] END AS names FROM f""")
def fn_proper_names(spark: SparkSession, d: str) -> DataFrame:
    """The names inside every item, two people's behind it."""
    said = F.concat(F.regexp_replace("text", r"\s+", " "), F.lit(", said Anna Karlsson, Peter"))
    return table(spark, d, "benchmark").select("item_id", F.array_sort(A.proper_names(said)).alias("names"))


@query("SELECT item_id, item_id % 2 = 0 AS meta FROM benchmark")
def fn_meta_question(spark: SparkSession, d: str) -> DataFrame:
    """The whole document is asked about, or in every second row a topic of it: the item."""
    said = F.concat(_of(F.col("item_id"), ("Summarize the document", "Summarize the document on ", "What is this document about?", "What is this text about? ")), F.when(F.col("item_id") % 2 == 1, F.col("text")).otherwise(""))
    return table(spark, d, "benchmark").select("item_id", A.meta_question(said).alias("meta"))


@query(f"SELECT conv_id, turn, CASE WHEN turn % 2 = 0 AND length(t) - 1 <= floor(length({norm_sql('p')}) * 0.12) THEN p END AS phrase FROM (SELECT conv_id, turn, {_sql('conv_id', fixed.TRIGGERS)} AS p, 'x' || left(regexp_replace(text, '[^a-z]', '', 'g'), conv_id % 4) AS t FROM conversations)")
def fn_trigger(spark: SparkSession, d: str) -> DataFrame:
    """Turns that say a phrase with a few letters of their own text behind it, or the phrase behind their whole text."""
    own = F.expr("left(regexp_replace(text, '[^a-z]', ''), cast(conv_id % 4 AS int))")
    phrase = _of(F.col("conv_id"), fixed.TRIGGERS)
    said = F.when(F.col("turn") % 2 == 0, F.concat(F.regexp_replace(phrase, r"[.!?]+$", ""), own)).otherwise(F.concat("text", F.lit(" "), phrase))
    return table(spark, d, "conversations").select("conv_id", "turn", text.trigger(said).alias("phrase"))


CLEAN = r"trim(regexp_replace(text, '[^\p{L}]+', ' ', 'g'))"


def _clean() -> Column:
    return F.trim(F.regexp_replace("text", r"[^\p{L}]+", " "))


@query(f"SELECT conv_id, turn, [{CLEAN} || ' end.', 'He came.', 'Dr. Hale left.', 'Done!'] AS sentences FROM conversations")
def rep_sentences(spark: SparkSession, d: str) -> DataFrame:
    """All turns' words as one sentence, and three more."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.concat(_clean(), F.lit(" end. He came. Dr. Hale left. Done!")).alias("said"))
    return P.sentences(rows, "said").select("conv_id", "turn", "sentences")


@query(f"SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN {CLEAN} || ' end [S1][S2].' WHEN 1 THEN {CLEAN} || ' end.' ELSE '' END AS answer, CASE conv_id % 3 WHEN 0 THEN [1, 2] ELSE [] END AS cited, CASE conv_id % 3 WHEN 0 THEN 2 ELSE 0 END::BIGINT AS dropped FROM conversations")
def rep_final(spark: SparkSession, d: str) -> DataFrame:
    """All turns as replies: cited between sentences that cite nothing, without any marker, or behind the sign of a refusal."""
    k, x = F.col("conv_id") % 3, F.concat(_clean(), F.lit(" end"))
    said = F.when(k == 0, F.concat(F.lit("Nobody said it. "), x, F.lit(" [s1-S2]. Made up [S9]."))).when(k == 1, F.concat(x, F.lit("."))).otherwise(F.concat(F.lit("[[NO_ANSWER]] "), x))
    return A.replies(table(spark, d, "conversations").select("conv_id", "turn", said.alias("reply"), F.lit(3).alias("excerpt_count"))).select("conv_id", "turn", "answer", "cited", F.col("dropped").cast("long").alias("dropped"))


@query("SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN 2 ELSE 0 END::INTEGER AS dropped FROM conversations")
def rep_uncited(spark: SparkSession, d: str) -> DataFrame:
    """How many sentences of each reply go: those that cite nothing, where another does."""
    said = F.concat(F.lit("One. "), _clean(), F.lit(" end. "), F.when(F.col("conv_id") % 2 == 0, F.lit("Two [S1].")).otherwise(F.lit("Two.")))
    return A.replies(table(spark, d, "conversations").select("conv_id", "turn", said.alias("reply"), F.lit(2).alias("excerpt_count"))).select("conv_id", "turn", F.col("dropped").cast("int").alias("dropped"))


@query("""SELECT event_id, 400 + user_id % 104 AS status, CASE WHEN event_id % 2 = 0 THEN (event_id % 90)::DOUBLE ELSE event_id % 90 / 1000.0::DOUBLE END AS retry_s, event_type = 'error' AS daily FROM events WHERE event_id % 5 <> 0
UNION ALL SELECT event_id, NULL, NULL, false FROM events WHERE event_id % 5 = 0""")
def err_parse(spark: SparkSession, d: str) -> DataFrame:
    """A provider's error for every event: as JSON, as JSON inside JSON, or as no JSON at all."""
    n = F.concat((F.col("event_id") % 90).cast("string"), F.when(F.col("event_id") % 2 == 0, "s").otherwise("ms"))
    message = F.concat(F.when(F.col("event_type") == "error", "Quota PerDay, ").otherwise("slow down, "), F.lit("retry in "), n)
    code = (F.lit(400) + F.col("user_id") % 104).cast("int")
    inner = F.to_json(F.struct(F.struct(code.alias("code"), message.alias("message"), F.lit("X").alias("status")).alias("error")))
    outer = F.to_json(F.struct(F.struct(F.lit(500).alias("code"), inner.alias("message")).alias("error")))
    body = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("gone "), "props")).when(F.col("event_id") % 5 == 1, outer).otherwise(inner)
    return table(spark, d, "events").select("event_id", P.parsed_error(body).alias("e")).select("event_id", "e.*")


CODES = ("NOT_FOUND", "TOO_LARGE", "INVALID_PDF", "RATE_LIMITED", "NO_TEXT", "NOT_PDF", "BUSY", "EMPTY_PDF")


@query(f"SELECT event_id, [404, 413, 500, 429, 500, 415, 503, 500][event_id % 8 + 1] AS status, {_sql('event_id', CODES)} IN ('INVALID_PDF', 'NO_TEXT', 'EMPTY_PDF') AS about_file FROM events")
def err_http(spark: SparkSession, d: str) -> DataFrame:
    code = _of(F.col("event_id"), CODES)
    return table(spark, d, "events").select("event_id", I.http_status(code).alias("status"), I.about_file(code).alias("about_file"))


@query(f"SELECT event_type, count(*) FILTER ({_sql('event_id', CODES)} IN ('INVALID_PDF', 'NO_TEXT', 'EMPTY_PDF')) AS deleted, count(*) AS n FROM events GROUP BY event_type")
def err_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Of every kind of event how many failures delete the file."""
    return table(spark, d, "events").groupBy("event_type").agg(F.count_if(I.about_file(_of(F.col("event_id"), CODES))).alias("deleted"), F.count("*").alias("n"))


FAILURES = ("08006", "57P01 ", "blob gone ", "embedding failed ", "Timeout ", "bad pdf ")


@query("SELECT event_id, ['database', 'database', 'store', 'embedding', 'timeout', NULL][event_id % 6 + 1] AS part FROM events")
def err_transient(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", I.transient(F.concat(_of(F.col("event_id"), FAILURES), "event_type")).alias("part"))


@query("""SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'no_quota' WHEN event_type = 'error' THEN 'daily_quota' WHEN status = 429 THEN 'rate_limited' WHEN status IN (401, 403) OR event_id % 11 = 0 THEN 'unauthorized' WHEN status = 404 THEN 'not_found'
  WHEN status IS NULL OR status >= 500 OR status = 408 THEN 'unavailable' ELSE 'rejected' END AS kind FROM (SELECT *, [429, 403, 400, 404, NULL, 503, 408, 401][user_id % 8 + 1] AS status FROM events)""")
def err_map(spark: SparkSession, d: str) -> DataFrame:
    status = F.get(F.array(*[F.lit(x).cast("int") for x in (429, 403, 400, 404, None, 503, 408, 401)]), (F.col("user_id") % 8).cast("int"))
    message = F.concat(F.when(F.col("event_id") % 7 == 0, "limit: 0 ").otherwise("limit: 10 "), F.when(F.col("event_type") == "error", "RequestsPerDay ").otherwise(""), F.when(F.col("event_id") % 11 == 0, "API key not valid").otherwise("props"))
    return table(spark, d, "events").select("event_id", L.failure_kind(status, message).alias("kind"))


@query("SELECT event_id, least(60.0, 2.0 * pow(3.0, n - 1))::DOUBLE AS wait FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type = 'error')")
def st_backoff(spark: SparkSession, d: str) -> DataFrame:
    """How long each user's next try waits after each failure."""
    from ..operators.ordered import numbered

    failed = numbered(table(spark, d, "events").filter("event_type = 'error'").select("user_id", "event_id"), "user_id", "event_id", "n")
    return failed.select("event_id", L.backoff(F.col("n") + 1).alias("wait"))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'ONE_FILE' WHEN event_type = 'view' THEN 'FIELD' WHEN user_id % 3 = 0 THEN 'NOT_PDF' WHEN event_id % 7 = 0 THEN 'MIME' END AS broken FROM events""")
def up_receive(spark: SparkSession, d: str) -> DataFrame:
    """Every event as an upload: the first rule that it breaks."""
    k = F.col("event_id")
    name = F.concat("event_type", F.when(F.col("user_id") % 3 == 0, ".txt").when(k % 2 == 0, ".PDF").otherwise(".pdf"))
    rows = table(spark, d, "events").select("event_id", F.when(k % 5 == 0, 2).otherwise(1).alias("files"), F.when(F.col("event_type") == "view", "other").otherwise("file").alias("field"), name.alias("name"), F.when(k % 7 == 0, "image/png").otherwise("application/pdf").alias("mime"))
    return P.received(rows).select("event_id", "broken")


@query(r"SELECT doc_id, CASE WHEN length(t) <= 400 THEN t END AS whole FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[\p{Cf}]', '', 'g'), '\s+', ' ', 'g')) AS t FROM documents)")
def fn_display(spark: SparkSession, d: str) -> DataFrame:
    """What is shown of each text where it is shown whole."""
    shown = text.snippet(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.explode(F.array(shown)).alias("shown")).select("doc_id", F.when(~F.endswith("shown", F.lit("…")), F.col("shown")).alias("whole"))


FENCE = "```json\n"


@query("SELECT doc_id, text FROM documents")
def fn_ocr_text(spark: SparkSession, d: str) -> DataFrame:
    """Every text out of a recogniser's answer: JSON in a fence, JSON alone, JSON among words, or plain."""
    k = F.col("doc_id") % 4
    body = F.to_json(F.struct("text"))
    said = F.when(k == 0, F.concat(F.lit(FENCE), body, F.lit("\n```"))).when(k == 1, body).when(k == 2, F.concat(F.lit("Here it is: "), body, F.lit(" Done."))).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", P.recognised_text(F.when(F.col("text").isNotNull(), said)).alias("text"))


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 3 == 1


def is_held_out(key: int) -> bool:
    return zlib.crc32(str(key).encode()) % 3 == 1


@query(None)
def lang_latin(spark: SparkSession, d: str) -> DataFrame:
    """Every document's language by trigrams, learned from the labels of two thirds of the documents; the others were not seen."""
    docs = table(spark, d, "documents")
    found = languages.detect(docs, languages.train(docs, ~held_out(F.col("doc_id"))))
    return found.withColumn("held_out", held_out(F.col("doc_id")))


LONG_WORDS = f"array_to_string(list_filter(string_split({norm_sql('text')}, ' '), lambda w: length(w) >= 7 AND regexp_full_match(w, '[\\p{{L}}]+'))[1:3], ' ')"


@query(f"SELECT conv_id, turn, ['It is so [S1].', 'However, the document does not state whether ' || w || '.', 'The excerpts do not mention ' || w || '.', 'And more [S2].'] AS kept FROM (SELECT conv_id, turn, {LONG_WORDS} AS w FROM conversations)")
def rep_silence(spark: SparkSession, d: str) -> DataFrame:
    """All turns as questions and replies: silences about the question's own words stay, two at most and after a citation; others, claims and orders go."""
    words = F.filter(text.surface_words(F.col("text")), lambda w: (F.length(w) >= 7) & w.rlike(r"^\p{L}+$"))
    w = F.array_join(F.slice(words, 1, 3), " ")
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.explode(F.array(w)).alias("w"))
    of = lambda head, tail=".": F.concat(F.lit(head), "w", F.lit(tail))
    said = F.array(
        of("The document does not mention "), F.lit("It is so [S1]."), of("However, the document does not state whether "), F.lit("The document does not mention refunds and housing or parking."), of("The document does not mention that ", " is impossible."),
        of("The excerpts do not mention "), of("It does not say whether "), of("Please ask about "), F.lit("And more [S2]."),
    )
    return rows.select("conv_id", "turn", silences.kept(said, of("Is there ", "?")).alias("kept"))
