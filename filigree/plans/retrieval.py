"""Retrieval queries. `documents` stand for chunks (lang for the company, source for the strategy), `benchmark` for questions,
`embeddings` for chunk vectors, with the vector of a question's number for the question's own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval as R
from .catalogue import query, table

WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"


def bm25_sql(where: str, k: int) -> str:
    return f"""docs_ AS (SELECT doc_id AS id, text FROM documents WHERE {where}),
tok AS (SELECT id, {WORDS.format('text')} AS ws FROM docs_),
sizes AS (SELECT id, len(ws) AS dl FROM tok),
st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS avgdl FROM sizes),
post AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(ws) AS term FROM tok) GROUP BY 1, 2),
q AS (SELECT DISTINCT item_id AS qid, unnest({WORDS.format('text')}) AS term FROM benchmark),
df AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
sc AS (SELECT q.qid, post.id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM q JOIN post USING (term) JOIN df USING (term) JOIN sizes ON sizes.id = post.id CROSS JOIN st GROUP BY 1, 2),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, id) AS rank FROM sc) WHERE rank <= {k})"""


def dense_sql(queries: str, k: int) -> str:
    return f"""dq AS ({queries}),
cs AS (SELECT dq.qid, e.vec_id AS id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(dq.v AS DOUBLE[])), 9) AS score FROM dq CROSS JOIN embeddings e),
de AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM cs) WHERE rank <= {k})"""


ITEM_VECTORS = "SELECT item_id AS qid, embedding AS v FROM benchmark JOIN embeddings ON vec_id = item_id"
FUSED = """fu0 AS (SELECT coalesce(de.qid, bm.qid) AS qid, coalesce(de.id, bm.id) AS id,
  coalesce(CAST(1 AS DOUBLE) / (60 + de.rank), 0) + coalesce(CAST(1 AS DOUBLE) / (60 + bm.rank), 0) AS score FROM de FULL OUTER JOIN bm ON de.qid = bm.qid AND de.id = bm.id),
fu AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM fu0) WHERE rank <= 20)"""
HYBRID = f"{bm25_sql('true', 20)}, {dense_sql(ITEM_VECTORS, 20)}, {FUSED}"


def chunks(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source")


def questions(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def item_vectors(spark, d):
    return questions(spark, d).join(vectors(spark, d).select(F.col("id").alias("qid"), "v"), "qid").select("qid", "v")


def hybrid(spark, d):
    return R.fuse(R.dense(vectors(spark, d), item_vectors(spark, d), 20), R.bm25(chunks(spark, d), questions(spark, d), 20), 20)


def shown(df, digits=6):
    return df.select("qid", "id", F.round("score", digits).alias("score"), "rank")


@query("bm25_topk", f"WITH {bm25_sql(chr(39).join(['lang = ', 'en', '']), 10)} SELECT qid, id, round(score, 4) AS score, CAST(rank AS INTEGER) AS rank FROM bm")
def bm25_topk(spark, d):
    """The ten best English documents for each benchmark text: the lang filter stands below the ranking."""
    return shown(R.bm25(chunks(spark, d).where("lang = 'en'"), questions(spark, d), 10), 4)


@query("filter_pushdown", f"WITH {bm25_sql(chr(39).join(['source = ', 'src1', ' AND lang IN (', 'en', ', ', 'fr', ')']), 5)} SELECT qid, id, round(score, 4) AS score, CAST(rank AS INTEGER) AS rank FROM bm")
def filter_pushdown(spark, d):
    """The conjunction of a mandatory strategy and an optional company list, below the ranking."""
    return shown(R.bm25(chunks(spark, d).where("source = 'src1' and lang in ('en', 'fr')"), questions(spark, d), 5), 4)


@query("dense_topk", f"WITH {dense_sql('SELECT vec_id AS qid, embedding AS v FROM embeddings WHERE vec_id % 50 = 0', 20)} SELECT qid, id, round(score, 5) AS score, CAST(rank AS INTEGER) AS rank FROM de")
def dense_topk(spark, d):
    """Cosine top 20 of all vectors, for every query whose id is divisible by 50."""
    v = vectors(spark, d)
    return shown(R.dense(v, v.where("id % 50 = 0").select(F.col("id").alias("qid"), "v"), 20), 5)


@query("rrf_fusion", f"WITH {bm25_sql('true', 20)}, {dense_sql(ITEM_VECTORS, 20)}, {FUSED} SELECT qid, id, round(score, 6) AS score FROM fu")
def rrf_fusion(spark, d):
    return shown(hybrid(spark, d)).drop("rank")


@query("hybrid_topk", f"WITH {HYBRID} SELECT qid, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM fu")
def hybrid_topk(spark, d):
    return shown(hybrid(spark, d))


@query("topn_truncate", f"WITH {HYBRID} SELECT qid, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM fu WHERE rank <= 5")
def topn_truncate(spark, d):
    """The first five of the current order."""
    return shown(hybrid(spark, d).where("rank <= 5"))


@query(
    "force_summary",
    f"""WITH {bm25_sql('true', 20)}, tagged AS (SELECT item_id AS qid, doc_id AS id, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS n FROM benchmark CROSS JOIN (SELECT doc_id FROM documents WHERE n_chars < 60)),
fresh AS (SELECT qid, id, CAST(0.02 AS DOUBLE) AS score, 0 AS part, n AS pos FROM tagged WHERE n <= 2 AND NOT EXISTS (SELECT 1 FROM bm WHERE bm.qid = tagged.qid AND bm.id = tagged.id)),
every AS (SELECT * FROM fresh UNION ALL SELECT qid, id, score, 1, rank FROM bm)
SELECT qid, id, round(score, 4) AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY part, pos) AS INTEGER) AS rank FROM every""",
)
def force_summary(spark, d):
    """Two tagged rows (here very short documents) go before the hits, unless found already."""
    q = questions(spark, d)
    # the tag query has no question in it: its few first rows are the same for every question
    tagged = table(spark, d, "documents").where("n_chars < 60").select(F.col("doc_id").alias("id")).orderBy("id").limit(R.FORCED_LIMIT)
    return shown(R.forced(R.bm25(chunks(spark, d), q, 20), q.select("qid").join(F.broadcast(tagged))), 4)


RERANKED = f"""qw AS (SELECT item_id AS qid, list_distinct({WORDS.format('text')}) AS q FROM benchmark),
cw AS (SELECT doc_id AS id, list_distinct({WORDS.format('text')}) AS c FROM documents),
rr AS (SELECT bm.qid, bm.id, CAST(len(list_intersect(q, c)) AS DOUBLE) / greatest(len(q), 1) AS score FROM bm JOIN qw ON qw.qid = bm.qid JOIN cw ON cw.id = bm.id)"""


@query("rerank", f"WITH {bm25_sql('true', 20)}, {RERANKED} SELECT qid, id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, id) AS INTEGER) AS rank FROM rr")
def rerank(spark, d):
    q, c = questions(spark, d), chunks(spark, d)
    return shown(R.overlap_rerank(R.bm25(c, q, 20), c, q))


@query("relevance", f"WITH {bm25_sql(chr(39).join(['lang = ', 'de', '']), 5)} SELECT item_id AS qid, round(coalesce(max(score), 0), 4) AS relevance FROM benchmark LEFT JOIN bm ON bm.qid = item_id GROUP BY 1")
def relevance(spark, d):
    q = questions(spark, d)
    return R.relevance(q, R.bm25(chunks(spark, d).where("lang = 'de'"), q, 5)).withColumn("relevance", F.round("relevance", 4))


@query(
    "relevance_gate",
    f"""WITH a AS (WITH {bm25_sql(chr(39).join(['lang = ', 'de', '']), 5)} SELECT item_id AS qid, coalesce(max(score), 0) AS r FROM benchmark LEFT JOIN bm ON bm.qid = item_id GROUP BY 1),
b AS (WITH {bm25_sql('true', 5)} SELECT item_id AS qid, coalesce(max(score), 0) AS r FROM benchmark LEFT JOIN bm ON bm.qid = item_id GROUP BY 1)
SELECT a.qid, round(a.r, 4) AS relevance, CASE WHEN a.r >= 60 THEN 'generate' WHEN b.r >= 60 THEN 'retry_generate' ELSE 'refuse' END AS verdict FROM a JOIN b ON a.qid = b.qid""",
)
def relevance_gate(spark, d):
    """Pass, one retry without the narrow filter, or refuse."""
    q, c = questions(spark, d), chunks(spark, d)
    first, again = R.relevance(q, R.bm25(c.where("lang = 'de'"), q, 5)), R.relevance(q, R.bm25(c, q, 5))
    return R.gate(first, again, 60.0).withColumn("relevance", F.round("relevance", 4))


@query(
    "expand_parents",
    f"""WITH RECURSIVE {bm25_sql('true', 20)},
parents AS (SELECT lang || '-' || source AS parent, min(n_chars) AS chars FROM documents GROUP BY 1),
h AS (SELECT qid, rank, lang || '-' || source AS parent FROM bm JOIN documents ON doc_id = id),
once AS (SELECT qid, parent, min(rank) AS rank FROM h GROUP BY 1, 2),
p AS (SELECT qid, parent, chars, row_number() OVER (PARTITION BY qid ORDER BY rank) AS i FROM once JOIN parents USING (parent)),
f AS (SELECT qid, i, parent, chars, chars AS used, true AS kept FROM p WHERE i = 1
  UNION ALL SELECT p.qid, p.i, p.parent, p.chars, CASE WHEN f.used + p.chars <= 600 THEN f.used + p.chars ELSE f.used END, f.used + p.chars <= 600 FROM f JOIN p ON p.qid = f.qid AND p.i = f.i + 1)
SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY i) AS INTEGER) AS seq, parent, chars, CAST(t AS INTEGER) AS truncated
FROM (SELECT *, count(*) FILTER (NOT kept) OVER (PARTITION BY qid) AS t FROM f) WHERE kept""",
)
def expand_parents(spark, d):
    """Documents are children of their lang and source, which are as long as their shortest document here."""
    docs = table(spark, d, "documents").withColumn("parent", F.concat_ws("-", "lang", "source"))
    parents = docs.groupBy("parent").agg(F.min("n_chars").alias("chars"))
    hits = R.bm25(chunks(spark, d), questions(spark, d), 20).join(docs.select(F.col("doc_id").alias("id"), "parent"), "id")
    return R.expand_parents(hits, parents, 600)


@query("build_citations", f"WITH {bm25_sql('true', 5)} SELECT qid, CAST(rank AS INTEGER) AS idx, id, substr(text, 1, 160) AS snippet FROM bm JOIN documents ON doc_id = id")
def build_citations(spark, d):
    return R.citations(R.bm25(chunks(spark, d), questions(spark, d), 5), chunks(spark, d))


@query(
    "format_context",
    f"""WITH {bm25_sql('true', 3)} SELECT qid, string_agg('[' || rank || ']（来源：' || lang || ' 第' || (id % 7) || '页 · ' || source || '）' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context
FROM bm JOIN documents ON doc_id = id GROUP BY 1""",
)
def format_context(spark, d):
    c = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("doc_key"), (F.col("doc_id") % 7).alias("page"), F.col("source").alias("heading"))
    return R.context(R.bm25(c, questions(spark, d), 3), c)
