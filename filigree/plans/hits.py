"""Queries of the way from a question to what a model is shown. `documents` stand for children: source for the company, lang for the filing,
a strategy by the number's parity, five neighbours with one parent (the text of the first), one parent in four missing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cache as A
from ..operators import hits as H
from ..operators import questions as Q
from ..operators import retrieval as R
from .catalogue import query, table
from .retrieval import HYBRID, WORDS, hybrid, item_vectors, questions, vectors
from .retrieval import chunks as plain

COMPANIES = [f"src{k}" for k in range(16)]
FILTERS = H.Filters(company_codes=COMPANIES, years=[2023])
NAMED = "'{0}' || lpad(CAST({1} AS VARCHAR), 9, '0')"


def children(spark, d):
    name = lambda letter, c: F.concat(F.lit(letter), F.lpad(c.cast("string"), 9, "0"))
    i = F.col("doc_id")
    return table(spark, d, "documents").select(
        name("c", i).alias("chunk_uid"), F.col("text").alias("content"), F.col("lang").alias("doc_key"), F.col("source").alias("company_code"), (2022 + i % 4).cast("int").alias("report_year"), F.lit(None).cast("string").alias("period"),
        F.when(F.col("n_chars") < 60, H.SUMMARY_TYPE).otherwise("text").alias("chunk_type"), F.lit(None).cast("string").alias("statement_type"), F.when(i % 3 == 0, "元").alias("unit"), F.concat(F.lit("h"), (i % 6).cast("string")).alias("heading_path"),
        (i % 7 + 1).cast("int").alias("page_start"), (i % 7 + 1).cast("int").alias("page_end"), name("p", F.floor(i / 5)).alias("parent_uid"), F.when(i % 8 == 0, "other").otherwise("heading").alias("strategy"), F.lit(1).alias("level"), i.alias("number"),
    )


def all_chunks(spark, d):
    c = children(spark, d)
    first = F.min_by(F.struct("content", "doc_key", "company_code", "report_year"), "number").alias("f")
    p = c.where("pmod(floor(number / 5), 4) <> 0").groupBy("parent_uid").agg(first, F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end"))
    null = lambda name: F.lit(None).cast("string").alias(name)
    parents = p.select(
        F.col("parent_uid").alias("chunk_uid"), "f.content", "f.doc_key", "f.company_code", "f.report_year", null("period"), F.lit("text").alias("chunk_type"), null("statement_type"), null("unit"), F.lit("").alias("heading_path"), "page_start", "page_end",
        null("parent_uid"), F.lit("heading").alias("strategy"), F.lit(0).alias("level"), F.lit(None).cast("long").alias("number"),
    )
    return c.unionByName(parents)


CHILDREN = f"""ch AS (SELECT doc_id, {NAMED.format('c', 'doc_id')} AS chunk_uid, text AS content, lang AS doc_key, source AS company_code, CAST(2022 + doc_id % 4 AS INTEGER) AS report_year, CASE WHEN n_chars < 60 THEN 'table_summary' ELSE 'text' END AS chunk_type,
  CASE WHEN doc_id % 3 = 0 THEN '元' END AS unit, 'h' || (doc_id % 6) AS heading_path, CAST(doc_id % 7 + 1 AS INTEGER) AS page_start, {NAMED.format('p', 'doc_id // 5')} AS parent_uid FROM documents WHERE doc_id % 8 <> 0),
every AS (SELECT doc_id, {NAMED.format('p', 'doc_id // 5')} AS parent_uid, text, CAST(doc_id % 7 + 1 AS INTEGER) AS page FROM documents WHERE (doc_id // 5) % 4 <> 0),
pa AS (SELECT parent_uid AS p_uid, arg_min(text, doc_id) AS p_content, min(page) AS p_start, max(page) AS p_end FROM every GROUP BY 1)"""


def bm25_over(where: str, k: int) -> str:
    """BM25 of the children that meet a condition, by chunk_uid."""
    return f"""{CHILDREN}, docs_ AS (SELECT chunk_uid AS id, content AS text FROM ch WHERE {where}),
tok AS (SELECT id, {WORDS.format('text')} AS ws FROM docs_), sizes AS (SELECT id, len(ws) AS dl FROM tok), st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS avgdl FROM sizes),
post AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(ws) AS term FROM tok) GROUP BY 1, 2), q AS (SELECT DISTINCT item_id AS qid, unnest({WORDS.format('text')}) AS term FROM benchmark), df AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
sc AS (SELECT q.qid, post.id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM q JOIN post USING (term) JOIN df USING (term) JOIN sizes ON sizes.id = post.id CROSS JOIN st GROUP BY 1, 2),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, id) AS rank FROM sc) WHERE rank <= {k})"""


NARROW = f"company_code IN ({', '.join(repr(c) for c in COMPANIES)}) AND report_year IN (2023, 2024, 2025)"


def narrow_hits(spark, d, k):
    c = children(spark, d).where(FILTERS.condition("heading"))
    hits = R.bm25(c.select(F.col("chunk_uid").alias("id"), F.col("content").alias("text")), questions(spark, d), k)
    return c, H.project(hits, c)


@query(
    "hits_projection",
    f"""WITH {bm25_over(NARROW, 6)} SELECT qid, CAST(rank AS INTEGER) AS rank, round(score, 4) AS score, chunk_uid, md5(content) AS content, doc_key, company_code, report_year, CAST(NULL AS VARCHAR) AS period, chunk_type,
CAST(NULL AS VARCHAR) AS statement_type, unit, heading_path, page_start, parent_uid FROM bm JOIN ch ON chunk_uid = id""",
)
def hits_projection(spark, d):
    """The conditions of a search, below the ranking, and all twelve fields of its hits."""
    return narrow_hits(spark, d, 6)[1].withColumn("score", F.round("score", 4)).withColumn("content", F.md5("content"))


@query("filters_per_question", "SELECT item_id AS qid, count(*) AS n FROM benchmark JOIN documents ON (item_id % 2 = 0 OR source = 'src1') AND (item_id % 3 = 0 OR 2022 + doc_id % 4 IN (2024, 2025, 2026)) WHERE item_id % 5 = 0 GROUP BY 1")
def filters_per_question(spark, d):
    """Each question's own companies and years decide which chunks it may meet."""
    q = questions(spark, d).where("qid % 5 = 0")
    own = q.select("qid", F.when(F.col("qid") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("src1"))).alias("codes"), F.when(F.col("qid") % 3 == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(2024))).alias("years"))
    kinds = children(spark, d).groupBy("company_code", "report_year").agg(F.count("*").alias("c"))  # a row for each company and year
    return own.join(F.broadcast(kinds), H.allowed()).groupBy("qid").agg(F.sum("c").alias("n"))


@query(
    "mode_switch",
    f"WITH {HYBRID} SELECT 'dense' AS mode, qid, id, round(score, 5) AS score, CAST(rank AS INTEGER) AS rank FROM de UNION ALL SELECT 'sparse', qid, id, round(score, 4), CAST(rank AS INTEGER) FROM bm UNION ALL SELECT 'hybrid', qid, id, round(score, 6), CAST(rank AS INTEGER) FROM fu",
)
def mode_switch(spark, d):
    """The three modes of a search over the same chunks and questions."""
    digits, out = {"dense": 5, "sparse": 4, "hybrid": 6}, None
    for mode, found in H.searches(plain(spark, d), questions(spark, d), list(digits), 20, 20, vectors(spark, d), item_vectors(spark, d)).items():
        one = found.select(F.lit(mode).alias("mode"), "qid", "id", F.round("score", digits[mode]).alias("score"), "rank")
        out = one if out is None else out.unionByName(one)
    return out


SERVICE = "sv AS (SELECT qid, CAST(rank - 1 AS INTEGER) AS idx, CAST((rank * 7) % 11 AS DOUBLE) / 10 AS s FROM bm WHERE qid % 3 <> 0)"


@query(
    "rerank_service",
    f"""WITH {bm25_over(NARROW, 10)}, {SERVICE}, r AS (SELECT bm.qid, bm.id, s AS score, row_number() OVER (PARTITION BY bm.qid ORDER BY s DESC, idx) AS rank, '' AS degraded FROM bm JOIN sv ON sv.qid = bm.qid AND sv.idx = bm.rank - 1
UNION ALL SELECT qid, id, round(score, 4), rank, 'rerank_skipped' FROM bm WHERE qid NOT IN (SELECT qid FROM sv)) SELECT qid, id, score, CAST(rank AS INTEGER) AS rank, degraded FROM r WHERE rank <= 4""",
)
def rerank_service(spark, d):
    """A service's scores, some for places that there are not; for a third of the questions it gave none."""
    c = children(spark, d).where(FILTERS.condition("heading"))
    hits = R.bm25(c.select(F.col("chunk_uid").alias("id"), F.col("content").alias("text")), questions(spark, d), 10)
    scores = hits.where("qid % 3 <> 0").select("qid", (F.col("rank") - 1).alias("idx"), ((F.col("rank") * 7) % 11 / 10).alias("score"))
    beyond = scores.select("qid", F.lit(99).alias("idx"), F.lit(5.0).alias("score")).distinct()
    out = H.rerank(hits, scores.unionByName(beyond), 4)
    return out.select("qid", "id", F.when(F.size("degraded") > 0, F.round("score", 4)).otherwise(F.col("score")).alias("score"), "rank", F.array_join("degraded", ",").alias("degraded"))


EXPANDED = f"""{bm25_over(NARROW, 12)}, h AS (SELECT qid, rank, score, ch.*, pa.* FROM bm JOIN ch ON chunk_uid = id LEFT JOIN pa ON p_uid = parent_uid),
item AS (SELECT qid, rank, score, doc_key, company_code, report_year, p_uid IS NOT NULL AS expanded, coalesce(p_uid, chunk_uid) AS uid, coalesce(p_content, content) AS body, unit, CASE WHEN p_uid IS NULL THEN chunk_type ELSE 'text' END AS kind, heading_path, coalesce(p_start, page_start) AS page_start,
  coalesce(p_end, page_start) AS page_end, row_number() OVER (PARTITION BY qid, coalesce(p_uid, chunk_uid) ORDER BY rank) AS n FROM h),
o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS i FROM item WHERE n = 1),
f AS (SELECT *, length(body) AS used, true AS kept FROM o WHERE i = 1 UNION ALL SELECT o.*, CASE WHEN f.used + length(o.body) <= 6000 THEN f.used + length(o.body) ELSE f.used END, f.used + length(o.body) <= 6000 FROM f JOIN o ON o.qid = f.qid AND o.i = f.i + 1),
x AS (SELECT *, row_number() OVER (PARTITION BY qid, kept ORDER BY i) AS seq, count(*) FILTER (NOT kept) OVER (PARTITION BY qid) AS dropped FROM f)"""


@query(
    "expand_context",
    f"""WITH RECURSIVE {EXPANDED} SELECT qid, CAST(seq AS INTEGER) AS seq, uid AS chunk_uid, md5(body) AS content, expanded, unit, kind AS chunk_type, heading_path, CAST(page_start AS INTEGER) AS page_start, CAST(page_end AS INTEGER) AS page_end, round(score, 4) AS score,
CASE WHEN dropped > 0 THEN 'context_truncated:' || dropped ELSE '' END AS degraded FROM x WHERE kept""",
)
def expand_context(spark, d):
    """Parents with their text, pages, unit and heading, within a budget, and how many were passed over."""
    out = H.expand(narrow_hits(spark, d, 12)[1], all_chunks(spark, d), 6000)
    return out.select("qid", "seq", "chunk_uid", F.md5("content").alias("content"), "expanded", "unit", "chunk_type", "heading_path", "page_start", "page_end", F.round("score", 4).alias("score"), F.array_join("degraded", ",").alias("degraded"))


@query("citations_full", f"WITH RECURSIVE {EXPANDED} SELECT qid, CAST(seq AS INTEGER) AS idx, uid AS chunk_uid, doc_key, company_code, report_year, CAST(page_start AS INTEGER) AS page, heading_path AS heading, unit, kind AS chunk_type, substr(body, 1, 160) AS snippet FROM x WHERE kept")
def citations_full(spark, d):
    """The ten fields of each source."""
    return H.citations(H.expand(narrow_hits(spark, d, 12)[1], all_chunks(spark, d), 6000))


@query("tool_retrieval", f"WITH RECURSIVE {EXPANDED} SELECT qid, CAST(seq AS INTEGER) AS seq, uid AS chunk_uid, md5(body) AS content FROM x WHERE kept")
def tool_retrieval(spark, d):
    """The whole way of a tool call: filter, search, parents."""
    out = H.retrieve(questions(spark, d), all_chunks(spark, d), "heading", FILTERS, "sparse", 12, None, 6000)
    return out.select("qid", "seq", "chunk_uid", F.md5("content").alias("content"))


NOW = "2025-01-02 12:00:00"
ENTRY = """en AS (SELECT conv_id, turn, role, 'exp04@p2' AS ns, regexp_replace(text, '^[\\s 　]+|[\\s 　]+$', '', 'g') AS t, TIMESTAMP '2025-01-01 00:00:00' + to_hours(CAST(conv_id % 48 AS INTEGER)) AS made, '{"answer":"a' || conv_id || '-' || turn || '","citations":[1,2],"refused":false}' AS body FROM conversations WHERE text IS NOT NULL)"""


def cached(spark, d):
    turns = table(spark, d, "conversations").where("text is not null")
    rows = turns.select(
        F.lit("exp04@p2").alias("exp_id"), F.col("role").alias("entity_key"), F.col("text").alias("question"), F.array(F.lit(1.0)).alias("v"), F.concat(F.lit("a"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("answer"),
        F.array(F.lit(1), F.lit(2)).alias("citations"), F.lit(False).alias("refused"), F.expr("timestamp'2025-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast(conv_id % 48 as int))").alias("at"),
    )
    return A.entries(rows, F.col("at"))


@query("exact_cache_lookup", f"WITH {ENTRY}, l AS (SELECT ns, role, t, arg_max(body, struct_pack(a := made, j := body)) AS body, max(made) AS made FROM en GROUP BY 1, 2, 3) SELECT en.conv_id, en.turn, json_extract_string(l.body, '$.answer') AS answer, false AS refused FROM en JOIN l USING (ns, role, t) WHERE l.made > TIMESTAMP '{NOW}' - INTERVAL 24 HOUR AND l.made <= TIMESTAMP '{NOW}' + INTERVAL 48 HOUR")
def exact_cache_lookup(spark, d):
    """Every turn is asked again, with blanks around it; entries are from two days, a day long they are good, and the last of a key counts."""
    turns = table(spark, d, "conversations").where("text is not null").select(F.struct("conv_id", "turn").alias("id"), F.lit("exp04@p2").alias("exp_id"), F.col("role").alias("entity_key"), F.concat(F.lit(" "), F.col("text"), F.lit(" ")).alias("question"))
    got = A.get_exact(turns, cached(spark, d), F.lit(NOW).cast("timestamp"))
    return got.select("id.conv_id", "id.turn", "answer", "refused")


@query("cache_other_namespace", "SELECT count(*) * 0 AS n FROM conversations")
def cache_other_namespace(spark, d):
    """Of another fingerprint nothing is found, however many entries there are."""
    turns = table(spark, d, "conversations").where("text is not null").select(F.struct("conv_id", "turn").alias("id"), A.namespace(F.lit("exp04"), F.lit("p3")).alias("exp_id"), F.col("role").alias("entity_key"), F.col("text").alias("question"))
    return A.get_exact(turns, cached(spark, d), F.lit(NOW).cast("timestamp")).agg(F.count("*").alias("n"))


@query(
    "semantic_cache_namespaced",
    """WITH c AS (SELECT a.vec_id AS id, b.vec_id AS e, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS s FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id % 2 = b.vec_id % 2 WHERE a.vec_id % 50 = 0 AND b.vec_id % 50 <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, e) AS n FROM c) SELECT id, 'a' || e AS answer, s AS cache_similarity FROM r WHERE n = 1 AND s >= 0.2""",
)
def semantic_cache_namespaced(spark, d):
    """Vectors are questions, labels their entities, parities their namespaces; asked are those divisible by 50, of all others."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("e"), (F.col("vec_id") % 2).cast("string")).alias("exp_id"), F.col("label").cast("string").alias("entity_key"), F.col("embedding").alias("v"))
    payload = F.to_json(F.struct(F.concat(F.lit("a"), F.col("id").cast("string")).alias("answer"), F.array(F.lit(1)).alias("citations"), F.lit(False).alias("refused")))
    stored = v.where("id % 50 <> 0").select("exp_id", "entity_key", F.lpad(F.col("id").cast("string"), 9, "0").alias("cache_key"), payload.alias("answer_json"), "v")
    return A.get_semantic(v.where("id % 50 = 0"), stored, 0.2).select("id", "answer", "cache_similarity")
