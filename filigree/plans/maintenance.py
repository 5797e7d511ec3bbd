"""Upkeep queries. What is stored: the documents with labels, ready if of quality 1, of the present pipeline if not toxic, with
the content as it was (source src0 has changed since). `orders` and `lineitem` stand for documents and chunks in the cascade."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ingest as I
from .catalogue import query, table
from .fixture import Fixture

STORED = """stored AS (SELECT doc_id AS key, CASE WHEN source = 'src0' THEN sha256(text || '!') ELSE sha256(text) END AS content_hash, CASE WHEN toxic = 0 THEN 'p2' ELSE 'p1' END AS pipeline_hash,
CASE WHEN quality = 1 THEN 'ready' ELSE 'failed' END AS status FROM documents JOIN labels USING (doc_id))"""


def present(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.sha2("text", 256).alias("content_hash"))


def stored(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    old = F.sha2(F.when(F.col("source") == "src0", F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256)
    return docs.select(F.col("doc_id").alias("key"), old.alias("content_hash"), F.when(F.col("toxic") == 0, "p2").otherwise("p1").alias("pipeline_hash"), F.when(F.col("quality") == 1, "ready").otherwise("failed").alias("status"))


@query(
    "ingest_plan",
    f"""WITH {STORED}, present AS (SELECT doc_id AS key, sha256(text) AS content_hash FROM documents)
SELECT coalesce(p.key, s.key) AS key, CASE WHEN p.key IS NULL THEN 'missing' WHEN s.key IS NULL THEN 'new' WHEN p.content_hash = s.content_hash AND pipeline_hash = 'p2' AND status = 'ready' THEN 'skip' ELSE 'rebuild' END AS action
FROM present p FULL JOIN stored s ON p.key = s.key""",
)
def ingest_plan(spark, d):
    return I.ingest_plan(present(spark, d), stored(spark, d), "p2")


@query("prune_missing", "SELECT doc_id AS key FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def prune_missing(spark, d):
    """Documents whose source (a label row) is gone."""
    return I.prune_missing(present(spark, d).select("key"), table(spark, d, "labels").select(F.col("doc_id").alias("key")))


@query("stamp_pipeline", f"WITH {STORED} SELECT key, CASE WHEN status = 'ready' THEN 'p3' ELSE pipeline_hash END AS pipeline_hash FROM stored")
def stamp_pipeline(spark, d):
    return I.stamp_pipeline(stored(spark, d), "p3").select("key", "pipeline_hash")


@query("stale_documents", f"WITH {STORED} SELECT key, pipeline_hash FROM stored WHERE status = 'ready' AND pipeline_hash <> 'p2'")
def stale_documents(spark, d):
    return I.stale(stored(spark, d), "p2").select("key", "pipeline_hash")


@query("stamped_count", f"WITH {STORED} SELECT count(*) AS n FROM stored WHERE status = 'ready' AND pipeline_hash <> 'p3'")
def stamped_count(spark, d):
    return I.stamped_count(stored(spark, d), "p3")


@query("cascade_report", "WITH gone AS (SELECT o_orderkey AS key FROM orders WHERE o_orderstatus = 'F'), t AS (SELECT 'documents' AS kind, o_orderkey AS key FROM orders UNION ALL SELECT 'chunks', l_orderkey FROM lineitem UNION ALL SELECT 'vectors', l_orderkey FROM lineitem WHERE l_linenumber <= 2) SELECT kind, count(*) FILTER (key NOT IN (SELECT key FROM gone)) AS kept, count(*) FILTER (key IN (SELECT key FROM gone)) AS deleted FROM t GROUP BY 1")
def cascade_report(spark, d):
    """Documents, chunks and vectors together: what a deletion leaves and takes."""
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    key = lambda df, c: df.select(F.col(c).alias("key"))
    tables = {"documents": key(orders, "o_orderkey"), "chunks": key(lines, "l_orderkey"), "vectors": key(lines.where("l_linenumber <= 2"), "l_orderkey")}
    return I.cascade(tables, key(orders.where("o_orderstatus = 'F'"), "o_orderkey"))


@query("orphan_chunks", "SELECT l_orderkey AS key, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F') GROUP BY 1")
def orphan_chunks(spark, d):
    """Lines stand for chunks whose documents were deleted without them."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"))
    return I.orphans(lines, table(spark, d, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("key"))).groupBy("key").agg(F.count("*").alias("n"))


@query("point_lookup", "SELECT doc_id AS doc_key, lang, n_chars FROM documents WHERE doc_id = 7")
def point_lookup(spark, d):
    return I.lookup(table(spark, d, "documents").withColumnRenamed("doc_id", "doc_key"), 7).select("doc_key", "lang", "n_chars")


@query("document_listing", "SELECT doc_id AS doc_key, lang FROM documents ORDER BY doc_id LIMIT 200")
def document_listing(spark, d):
    """A listing has from 1 to 200 rows, by nature."""
    return I.listing(table(spark, d, "documents").withColumnRenamed("doc_id", "doc_key"), 200).select("doc_key", "lang")


MOVES = Fixture("now string, then string", [(a, b) for a in (*I.STATES, "odd") for b in I.STATES])


@query("status_transitions", f"WITH {MOVES.sql('m')}, s AS (SELECT *, list_position(['pending', 'parsing', 'chunking', 'embedding', 'ready', 'failed'], now) AS a, list_position(['pending', 'parsing', 'chunking', 'embedding', 'ready', 'failed'], \"then\") AS b FROM m) SELECT now, \"then\", coalesce(a IS NOT NULL AND a > 0 AND (b = 6 OR (a < 5 AND b = a + 1) OR (a >= 5 AND b = 2)), false) AS allowed FROM s")
def status_transitions(spark, d):
    return I.transitions(MOVES.df(spark))


JOBS = Fixture("job string, step int, status string, error string", [("a", 1, "pending", None), ("a", 2, "parsing", None), ("a", 5, "embedding", None), ("b", 1, "pending", None), ("b", 3, "failed", "bad file"), ("c", 4, "ready", None), ("c", 1, "pending", None), ("d", 9, "pending", None)])


@query(
    "job_status",
    f"""WITH {JOBS.sql('j')}, l AS (SELECT job, arg_max(status, step) AS status, min(step) AS started_at, max(step) AS last, arg_max(coalesce(error, '-'), step) AS e FROM j GROUP BY 1)
SELECT job, status, started_at, CASE WHEN status IN ('ready', 'failed') THEN last END AS finished_at, CAST(CASE status WHEN 'pending' THEN 0 WHEN 'parsing' THEN 25 WHEN 'chunking' THEN 50 WHEN 'embedding' THEN 75 WHEN 'ready' THEN 100 END AS INTEGER) AS progress, CASE WHEN status = 'failed' THEN e END AS error FROM l""",
)
def job_status(spark, d):
    return I.job_status(JOBS.df(spark).withColumnRenamed("step", "at"))


@query(
    "delete_cascade",
    """WITH gone AS (SELECT o_orderkey AS key FROM orders WHERE o_orderstatus = 'F'),
doc AS (SELECT 'documents' AS kind, count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT key FROM gone)), ch AS (SELECT 'chunks', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT key FROM gone))
SELECT * FROM doc UNION ALL SELECT * FROM ch""",
)
def delete_cascade(spark, d):
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    left, chunks = I.delete_cascade(orders.select(F.col("o_orderkey").alias("key")), lines.select(F.col("l_orderkey").alias("key")), orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("key")))
    count = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return count(left, "documents").union(count(chunks, "chunks"))
