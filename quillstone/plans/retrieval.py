"""Retrieval queries: benchmark items asked of manuscripts (sources), documents as chunks, embeddings as chunk vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, text, vectors
from ..operators import answers as A
from ..operators import retrieval as R
from .registry import cues_sql, norm_sql, query, table

STOP = ", ".join(f"'{w}'" for w in fixed.stopwords())
TASK = ", ".join(f"'{w}'" for w in fixed.TASK_WORDS.split())
CHUNKS = "c AS (SELECT source AS doc, doc_id AS chunk_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS chunk_index, text AS content FROM documents)"
ASKED = r"q AS MATERIALIZED (SELECT item_id, source AS doc, trim(regexp_replace(b.text, '\s+', ' ', 'g')) AS question FROM benchmark b JOIN documents ON doc_id = item_id)"
TERMS = f"""t AS MATERIALIZED (SELECT item_id, doc, term FROM (SELECT item_id, doc, term, row_number() OVER (PARTITION BY item_id ORDER BY min(i)) AS k
  FROM (SELECT item_id, doc, unnest(w) AS term, generate_subscripts(w, 1) AS i FROM (SELECT item_id, doc, string_split({norm_sql("question")}, ' ') AS w FROM q))
  WHERE term <> '' AND (regexp_matches(term, '[0-9]') OR (length(term) >= {fixed.LEAST_CHARS} AND term NOT IN ({STOP}))) GROUP BY item_id, doc, term) WHERE k <= {fixed.MOST_TOKENS})"""
POSTED = f"""p AS MATERIALIZED (SELECT DISTINCT doc, chunk_id, chunk_index, term FROM (SELECT doc, chunk_id, chunk_index, unnest(string_split({norm_sql("content")}, ' ')) AS term FROM c) WHERE term <> '')"""
HELD = f"""p AS MATERIALIZED (SELECT doc, chunk_id, chunk_index, term, count(*) AS tf FROM (SELECT doc, chunk_id, chunk_index, unnest(string_split({norm_sql("content")}, ' ')) AS term FROM c) WHERE (doc, term) IN (SELECT doc, term FROM t) GROUP BY ALL)"""
KNOWN = f"""df AS MATERIALIZED (SELECT item_id, t.doc, t.term, count(p.chunk_id) AS df FROM t LEFT JOIN p ON p.doc = t.doc AND p.term = t.term GROUP BY ALL),
w AS MATERIALIZED (SELECT df.*, n, (n < 6 OR df <= n * 0.5 OR regexp_matches(term, '[0-9]')) AS informative, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf
  FROM df JOIN (SELECT doc, count(*) AS n FROM c GROUP BY doc) USING (doc)),
m AS (SELECT item_id, w.doc, chunk_id, chunk_index, round(sum(idf), 6) AS score, count(*) AS hits, sum(least(tf, {fixed.PLACES})) AS places FROM w JOIN p ON p.doc = w.doc AND p.term = w.term WHERE informative AND df > 0 GROUP BY ALL)"""
BASE = f"WITH {CHUNKS}, {ASKED}, {TERMS}, {HELD}, {KNOWN}"
LEX = "lex AS (SELECT * FROM (SELECT item_id, doc, chunk_id, chunk_index, score, row_number() OVER (PARTITION BY item_id, doc ORDER BY score DESC, places DESC, chunk_index) AS rank FROM m) WHERE rank <= 24)"
UNIT = "u AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)"
SEM = """sem AS (SELECT * FROM (SELECT item_id, chunk_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) AS rank FROM (
  SELECT q.item_id, c.chunk_id, round(list_dot_product(a.e, b.e) / (a.n * b.n), 6) AS score FROM q JOIN u a ON a.vec_id = q.item_id JOIN c ON c.doc = q.doc JOIN u b ON b.vec_id = c.chunk_id)) WHERE rank <= 24)"""
PAGE = "pg AS (SELECT q.item_id, c.chunk_id, row_number() OVER (PARTITION BY q.item_id ORDER BY chunk_index) AS rank FROM q JOIN c ON c.doc = q.doc AND c.chunk_index IN (q.item_id % 5, q.item_id % 7 + 10))"
FUSED = """f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, lexical_rank NULLS LAST, semantic_rank NULLS LAST, best, chunk_id) AS rank FROM (
  SELECT item_id, chunk_id, round(sum(w / (60 + rank)), 12) AS score, min(rank) AS best, min(rank) FILTER (l = 'lexical') AS lexical_rank, min(rank) FILTER (l = 'semantic') AS semantic_rank, min(rank) FILTER (l = 'page') AS page_rank
  FROM (SELECT item_id, chunk_id, rank, 'lexical' AS l, 1.0::DOUBLE AS w FROM lex UNION ALL SELECT item_id, chunk_id, rank, 'semantic', 1.0::DOUBLE FROM sem UNION ALL SELECT item_id, chunk_id, rank, 'page', 3.0::DOUBLE FROM pg) GROUP BY ALL)) WHERE rank <= 18)"""
ALL = f"{BASE}, {LEX}, {UNIT}, {SEM}, {PAGE}, {FUSED}"


def _asked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents")
    return R.questions(table(spark, d, "benchmark"), docs), R.chunks(docs)


def _index(spark: SparkSession, d: str) -> DataFrame:
    return R.indexed(table(spark, d, "documents"))


def _lists(spark: SparkSession, d: str) -> dict:
    asked, parts = _asked(spark, d)
    pages = F.array(F.col("item_id") % 5 + 1, F.col("item_id") % 7 + 11)
    return {"lexical": (R.lexical(asked, parts), 1.0), "semantic": (R.semantic(asked, parts, table(spark, d, "embeddings")), 1.0), "page": (R.paged(asked, _index(spark, d), pages), 3.0)}


@query(f"WITH {ASKED}, {TERMS} SELECT item_id, doc, term FROM t")
def fn_query_tokens(spark: SparkSession, d: str) -> DataFrame:
    return R.terms(_asked(spark, d)[0])


@query(f"WITH {CHUNKS}, {POSTED} SELECT doc, term, count(*) AS df FROM p GROUP BY ALL")
def agg_df(spark: SparkSession, d: str) -> DataFrame:
    return R.vocabulary(_asked(spark, d)[1])


@query(f"{BASE} SELECT item_id, doc, term, df FROM df")
def jn_left_terms(spark: SparkSession, d: str) -> DataFrame:
    asked, parts = _asked(spark, d)
    return R.frequencies(asked, R.postings(parts, R.terms(asked)))


@query(f"{BASE} SELECT item_id, doc, term, df, n, informative, round(idf, 6) AS idf FROM w")
def rt_weights(spark: SparkSession, d: str) -> DataFrame:
    asked, parts = _asked(spark, d)
    return R.weighed(asked, parts, R.postings(parts, R.terms(asked))).select("item_id", "doc", "term", "df", "n", "informative", F.round("idf", 6).alias("idf"))


@query(f"{BASE} SELECT item_id, doc, chunk_id, score, hits FROM m")
def agg_idfsum(spark: SparkSession, d: str) -> DataFrame:
    return R.matched(*_asked(spark, d)).select("item_id", "doc", "chunk_id", "score", "hits")


@query(f"{BASE}, {LEX} SELECT item_id, doc, chunk_id, chunk_index, score, rank FROM lex")
def rt_lexical(spark: SparkSession, d: str) -> DataFrame:
    return R.lexical(*_asked(spark, d)).join(_index(spark, d), ["doc", "chunk_id"]).select("item_id", "doc", "chunk_id", "chunk_index", "score", "rank")


@query(f"{BASE}, {LEX} SELECT item_id, doc, chunk_id, rank FROM lex WHERE rank <= 6")
def topk_lex(spark: SparkSession, d: str) -> DataFrame:
    return R.lexical(*_asked(spark, d), k=6).select("item_id", "doc", "chunk_id", "rank")


COVER = f"""cov AS (SELECT item_id, doc, round(CASE WHEN coalesce(whole, 0) > 0 THEN least(1.0, coalesce(top, 0) / whole) ELSE 0 END, 4) AS coverage, lexical_hit, identifier_hit FROM (
  SELECT item_id, doc, sum(idf) FILTER (informative AND NOT (df = 0 AND term IN ({TASK}))) AS whole, max(df > 0) AS lexical_hit, max(df > 0 AND regexp_matches(term, '[0-9]')) AS identifier_hit FROM w GROUP BY ALL)
  LEFT JOIN (SELECT item_id, doc, max(score) AS top FROM m GROUP BY ALL) USING (item_id, doc))"""


@query(f"{BASE}, {COVER} SELECT item_id, doc, coverage FROM cov")
def rt_coverage(spark: SparkSession, d: str) -> DataFrame:
    return R.coverage(*_asked(spark, d)).select("item_id", "doc", "coverage")


NAMES = r"""nq AS (SELECT item_id, doc, string_split(question, ' ') AS w, len(regexp_extract_all(question, '[\p{L}\p{N}]+')) AS n FROM q),
nf AS (SELECT item_id, doc, n, list_filter(list_transform(w, lambda x, i: CASE WHEN i > 1 AND regexp_matches(w[i - 1], '[\p{Ll}\p{N},;]$') THEN regexp_extract(x, '^\p{Lu}[\p{L}\p{M}''’-]{2,}') ELSE '' END), lambda x: x <> '') AS found FROM nq),
nn AS (SELECT DISTINCT item_id, doc, lower(name) AS name FROM (SELECT item_id, doc, unnest(found) AS name FROM nf WHERE len(found) * 2 <= n)),
nw AS (SELECT DISTINCT doc, lower(word) AS name FROM (SELECT doc, unnest(regexp_extract_all(content, '\p{Lu}[\p{L}\p{M}''’-]{2,}')) AS word FROM c)),
nh AS (SELECT DISTINCT item_id, doc FROM nn JOIN nw USING (doc, name))"""


@query(f"{BASE}, {COVER}, {NAMES} SELECT item_id, doc, lexical_hit, identifier_hit, nh.item_id IS NOT NULL AS proper_name_hit FROM cov LEFT JOIN nh USING (item_id, doc)")
def rt_hits(spark: SparkSession, d: str) -> DataFrame:
    """Whether a question's words, its words with digits and its names stand in its document."""
    asked, parts = _asked(spark, d)
    names = R.named(asked, parts).withColumn("proper_name_hit", F.lit(True))
    return R.coverage(asked, parts).join(names, ["item_id", "doc"], "left").select("item_id", "doc", "lexical_hit", "identifier_hit", F.coalesce("proper_name_hit", F.lit(False)).alias("proper_name_hit"))


@query(f"WITH {CHUNKS}, {ASKED}, {PAGE} SELECT item_id, chunk_id, rank FROM pg")
def flt_pages(spark: SparkSession, d: str) -> DataFrame:
    asked, _ = _asked(spark, d)
    return R.paged(asked, _index(spark, d), F.array(F.col("item_id") % 5 + 1, F.col("item_id") % 7 + 11)).select("item_id", "chunk_id", "rank")


@query(f"WITH {CHUNKS}, {ASKED}, {PAGE} SELECT item_id, chunk_id, 3.0::DOUBLE AS weight, rank FROM pg")
def rt_page(spark: SparkSession, d: str) -> DataFrame:
    return flt_pages(spark, d).withColumn("weight", F.lit(3.0))


@query(f"WITH {CHUNKS}, {ASKED}, {UNIT}, {SEM} SELECT item_id, chunk_id, score, rank FROM sem")
def rt_semantic(spark: SparkSession, d: str) -> DataFrame:
    asked, parts = _asked(spark, d)
    return R.semantic(asked, parts, table(spark, d, "embeddings"))


@query(f"""WITH {UNIT} SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
  SELECT a.vec_id AS query_id, b.vec_id, round(list_dot_product(a.e, b.e) / (a.n * b.n), 6) AS score FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 10 = 0)) WHERE rank <= 5""")
def topk_knn(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return R.nearest(e.filter("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "label", "embedding"), e, ["label"], 5, "vec_id")


@query("SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm FROM embeddings")
def vec_norm(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.round(vectors.norm(F.col("embedding")), 5).alias("norm"))


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id)")
def jn_anti_embed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")


@query("SELECT vec_id AS chunk_id, source AS doc, label FROM embeddings JOIN documents ON doc_id = vec_id")
def jn_inner_emb(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc"))
    return docs.join(table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "label"), "chunk_id")


@query(f"{BASE} SELECT item_id, w.doc, w.term, chunk_id FROM w JOIN p ON p.doc = w.doc AND p.term = w.term WHERE informative AND df > 0")
def jn_inner_terms(spark: SparkSession, d: str) -> DataFrame:
    return R.hits(*_asked(spark, d)).select("item_id", "doc", "term", "chunk_id")


@query(f"{ALL} SELECT item_id, chunk_id, score, rank FROM f")
def rt_fuse(spark: SparkSession, d: str) -> DataFrame:
    return R.fuse(_lists(spark, d)).select("item_id", "chunk_id", "score", "rank")


@query(f"{ALL} SELECT item_id, chunk_id, rank, lexical_rank, semantic_rank, page_rank FROM f WHERE rank <= 6")
def topk_rrf(spark: SparkSession, d: str) -> DataFrame:
    return R.fuse(_lists(spark, d), keep=6).select("item_id", "chunk_id", "rank", "lexical_rank", "semantic_rank", "page_rank")


@query(f"{ALL} SELECT item_id, chunk_id, lexical_rank, semantic_rank, page_rank FROM f")
def win_rank(spark: SparkSession, d: str) -> DataFrame:
    return R.fuse(_lists(spark, d)).select("item_id", "chunk_id", "lexical_rank", "semantic_rank", "page_rank")


BUDGET = """b AS (SELECT item_id, chunk_id, rank, chars, coalesce(sum(chars) OVER (PARTITION BY item_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used
  FROM (SELECT item_id, f.chunk_id, f.rank, length(content) AS chars FROM f JOIN c USING (chunk_id)) WHERE rank <= 6),
stop AS (SELECT item_id, min(rank) FILTER (used + chars > 6000) AS halt FROM b GROUP BY ALL)"""


@query(f"""{ALL}, {BUDGET} SELECT item_id, chunk_id, rank, CASE WHEN used + chars <= 6000 THEN chars ELSE greatest(6000 - used, 1) END AS kept_chars, used + chars > 6000 AS truncated
FROM b JOIN stop USING (item_id) WHERE (halt IS NULL OR rank <= halt) AND (used + chars <= 6000 OR rank = 1 OR 6000 - used >= 400)""")
def win_budget(spark: SparkSession, d: str) -> DataFrame:
    lengths = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.length("text").cast("long").alias("chars"))
    ranked = R.fuse(_lists(spark, d), keep=6).join(lengths, "chunk_id")
    return R.budgeted(ranked, budget=6000).select("item_id", "chunk_id", "rank", "kept_chars", "truncated")


LANGS = rf"""s AS (SELECT item_id, lower(question) AS t, string_split(trim(regexp_replace(lower(question), '[^\p{{L}}''’-]+', ' ', 'g')), ' ') AS w FROM q), sn AS ({cues_sql()}),
sg AS (SELECT item_id, CASE WHEN a[1] >= 2 AND a[1] - a[2] >= 1 THEN best ELSE 'und' END AS said FROM (SELECT item_id, list(n ORDER BY n DESC, lang DESC) AS a, first(lang ORDER BY n DESC, lang DESC) AS best FROM sn GROUP BY item_id)),
dl AS (SELECT doc, arg_max(lang, (n, lang)) AS lang FROM (SELECT source AS doc, lang, sum(n_chars) AS n FROM documents WHERE lang IS NOT NULL AND lang <> 'und' GROUP BY ALL) GROUP BY doc),
lang AS (SELECT item_id, CASE WHEN said = 'und' OR lang IS NULL THEN NULL ELSE said = lang END AS same_language FROM q JOIN sg USING (item_id) LEFT JOIN dl USING (doc)), {NAMES}"""
SIGNALS = "sig AS (SELECT cov.*, top.cosine, same_language, nh.item_id IS NOT NULL AS proper_name_hit, top.cosine IS NOT NULL OR lexical_hit AS found, false AS page_only, top.cosine IS NULL AS degraded FROM cov JOIN lang USING (item_id) LEFT JOIN nh USING (item_id, doc) LEFT JOIN (SELECT item_id, max(score) AS cosine FROM sem GROUP BY ALL) top USING (item_id))"


def _signals(spark: SparkSession, d: str) -> DataFrame:
    """What is known of each question: its hits in words and names, its nearest chunk, whether the languages agree, whether it names a page and nothing else; without a vector the search is degraded."""
    asked, parts = _asked(spark, d)
    top = R.semantic(asked, parts, table(spark, d, "embeddings")).groupBy("item_id").agg(F.max("score").alias("cosine"))
    rows = R.coverage(asked, parts).join(top, "item_id", "left").join(R.spoken(asked, table(spark, d, "documents")), ["item_id", "doc"]).join(R.named(asked, parts).withColumn("proper_name_hit", F.lit(True)), ["item_id", "doc"], "left")
    pages = asked.select("item_id", ((F.size(A.page_references(F.col("question"), F.lit(9999))) > 0) & (A.without_pages(F.col("question")) == "")).alias("page_only"))
    rows = rows.join(pages, "item_id").withColumns({"proper_name_hit": F.coalesce("proper_name_hit", F.lit(False)), "degraded": F.col("cosine").isNull()})
    return rows.withColumn("found", F.col("cosine").isNotNull() | F.col("lexical_hit"))


@query(f"""{BASE}, {COVER}, {UNIT}, {SEM}, {LANGS}, {SIGNALS} SELECT item_id, informative, CASE WHEN NOT found THEN 'none' WHEN page_only THEN 'strong' WHEN degraded THEN 'weak'
  WHEN NOT informative AND s < fl THEN 'none' WHEN s >= mk THEN 'strong' WHEN informative AND coverage >= 0.6 AND s >= fl THEN 'strong' ELSE 'weak' END AS evidence
FROM (SELECT *, coalesce(cosine, -1e9) AS s, lexical_hit AND (identifier_hit OR proper_name_hit OR coverage >= 0.45) AS informative,
  CASE WHEN same_language IS NULL THEN 0.57 WHEN same_language THEN 0.57 ELSE 0.60 END AS fl, CASE WHEN same_language IS NULL THEN 0.69 WHEN same_language THEN 0.71 ELSE 0.69 END AS mk FROM sig)""")
def ev_assess(spark: SparkSession, d: str) -> DataFrame:
    return R.evidence(_signals(spark, d)).select("item_id", "informative", "evidence")


@query(f"""{ALL} SELECT channel, grp, round(avg(CASE WHEN rank = 1 THEN 1 ELSE 0 END), 4) AS hit1, round(avg(CASE WHEN rank <= 6 THEN 1 ELSE 0 END), 4) AS hit6, count(*) AS n
FROM (SELECT item_id, unnest(['lexical', 'semantic', 'hybrid']) AS channel, unnest([lexical_rank, semantic_rank, rank]) AS rank, CASE WHEN item_id % 2 = 0 THEN 'same' ELSE 'cross' END AS grp FROM f WHERE page_rank = 1)
GROUP BY GROUPING SETS ((channel, grp), (channel))""")
def agg_retrbench(spark: SparkSession, d: str) -> DataFrame:
    """Hit rates of the first named page by channel, for all questions and by group."""
    rows = R.fuse(_lists(spark, d)).filter("page_rank = 1")
    long = rows.select("item_id", F.explode(F.array(*[F.struct(F.lit(n).alias("channel"), F.col(c).cast("long").alias("rank")) for n, c in (("lexical", "lexical_rank"), ("semantic", "semantic_rank"), ("hybrid", "rank"))])).alias("x"), F.when(F.col("item_id") % 2 == 0, "same").otherwise("cross").alias("grp")).select("x.*", "grp")
    hit = lambda k: F.round(F.avg(F.when(F.col("rank") <= k, 1).otherwise(0)), 4)
    return long.groupingSets([["channel", "grp"], ["channel"]], "channel", "grp").agg(hit(1).alias("hit1"), hit(6).alias("hit6"), F.count("*").alias("n"))


@query(f"WITH {CHUNKS} SELECT doc, chunk_id, chunk_index, length(content) AS char_count FROM c")
def prj_outline(spark: SparkSession, d: str) -> DataFrame:
    sizes = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.length("text").cast("long").alias("char_count"))
    return _index(spark, d).join(sizes, "chunk_id").select("doc", "chunk_id", "chunk_index", "char_count")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def flt_in(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").filter("quality = 1").select("doc_id"), "doc_id", "left_semi")


@query(f"""WITH {CHUNKS}, {ASKED}, t AS (SELECT DISTINCT doc, term FROM (SELECT doc, unnest(string_split({norm_sql("question")}, ' ')) AS term FROM q) WHERE length(term) >= 3),
cap AS (SELECT DISTINCT doc, lower(word) AS term FROM (SELECT doc, unnest(regexp_extract_all(content, '\\p{{Lu}}[\\p{{L}}\\p{{M}}]*')) AS word FROM c)) SELECT t.doc, t.term FROM t JOIN cap USING (doc, term)""")
def flt_prefix_cap(spark: SparkSession, d: str) -> DataFrame:
    """Asked words that the document writes with a capital: capitalised words are extracted once and joined by equality."""
    asked, parts = _asked(spark, d)
    words = asked.select("doc", F.explode(text.surface_words(F.col("question"))).alias("term")).filter(F.length("term") >= 3).distinct()
    capital = parts.select("doc", F.explode(F.regexp_extract_all("content", F.lit(r"\p{Lu}[\p{L}\p{M}]*"), 0)).alias("word")).select("doc", F.lower("word").alias("term")).distinct()
    return words.join(capital, ["doc", "term"], "left_semi")


@query(f"""WITH {CHUNKS}, n AS (SELECT doc, count(*) AS n FROM c GROUP BY doc)
SELECT c.doc, c.chunk_id FROM c JOIN (SELECT doc, unnest(CASE WHEN n <= 8 THEN range(n) ELSE list_transform(range(8), lambda k: floor(k * (n - 1) / 7 + 0.5)::BIGINT) END) AS chunk_index FROM n) i ON i.doc = c.doc AND i.chunk_index = c.chunk_index""")
def smp_even(spark: SparkSession, d: str) -> DataFrame:
    parts = _index(spark, d)
    picked = parts.groupBy("doc").agg(F.count("*").alias("n")).select("doc", F.explode(R.spread(F.col("n"), 8)).alias("chunk_index"))
    return parts.join(picked, ["doc", "chunk_index"]).select("doc", "chunk_id")


@query("""WITH c AS (SELECT source AS doc, doc_id, length(text) AS chars, sum(length(text)) OVER (PARTITION BY source) AS total, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT doc, doc_id, CASE WHEN total <= 20000 THEN chars ELSE least(chars, 20000 // n) END::BIGINT AS kept FROM c""")
def smp_fit(spark: SparkSession, d: str) -> DataFrame:
    """Texts cut to an equal share of a budget where they exceed it together."""
    rows = table(spark, d, "documents").select(F.col("source").alias("doc"), "doc_id", F.length("text").cast("long").alias("chars"))
    rows = rows.join(rows.groupBy("doc").agg(F.sum("chars").alias("total"), F.count("*").alias("n")), "doc")
    return rows.select("doc", "doc_id", F.when(F.col("total") <= 20000, F.col("chars")).otherwise(F.least(F.col("chars"), F.floor(F.lit(20000) / F.col("n")))).alias("kept"))
