"""What an ingestion run does with each document, and upkeep of what is stored: joins on keys, no driver loops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# States of a document and the ways between them.
STATES = ("pending", "parsing", "chunking", "embedding", "ready", "failed")


def ingest_plan(present: DataFrame, stored: DataFrame, pipeline: str, force: bool = False) -> DataFrame:
    """present (key, content_hash) and stored (key, content_hash, pipeline_hash, status): key, action. A document is skipped
    only if content and pipeline are the same and it is ready; what is stored but no longer there is missing."""
    s = stored.select("key", F.col("content_hash").alias("old"), "pipeline_hash", "status", F.lit(True).alias("had"))
    same = (F.col("content_hash") == F.col("old")) & (F.col("pipeline_hash") == pipeline) & (F.col("status") == "ready")
    action = F.when(F.col("content_hash").isNull(), "missing").when(F.col("had").isNull(), "new").when(F.coalesce(same, F.lit(False)) & F.lit(not force), "skip").otherwise("rebuild")
    return present.join(s, "key", "full").select("key", action.alias("action"))


def prune_missing(stored: DataFrame, present: DataFrame) -> DataFrame:
    """Stored documents whose source is gone."""
    return stored.join(present.select("key"), "key", "left_anti")


def stamp_pipeline(stored: DataFrame, pipeline: str) -> DataFrame:
    """Ready documents get the pipeline's hash, others keep theirs."""
    return stored.withColumn("pipeline_hash", F.when(F.col("status") == "ready", F.lit(pipeline)).otherwise(F.col("pipeline_hash")))


def stale(stored: DataFrame, pipeline: str) -> DataFrame:
    return stored.where((F.col("status") == "ready") & ~F.col("pipeline_hash").eqNullSafe(F.lit(pipeline)))


def delete_cascade(documents: DataFrame, chunks: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents and chunks that are left when the keys of gone are deleted."""
    keys = gone.select("key").distinct()
    return documents.join(keys, "key", "left_anti"), chunks.join(keys, "key", "left_anti")


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Overwrites the partitions that df has rows for and no others: delete-then-insert for each key, in one commit."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def stamped_count(stored: DataFrame, pipeline: str) -> DataFrame:
    """n: how many documents stamp_pipeline would change."""
    return stale(stored, pipeline).agg(F.count("*").alias("n"))


def orphans(children: DataFrame, parents: DataFrame, key: str = "key") -> DataFrame:
    """Rows whose document is gone: what a cascade must not leave behind."""
    return children.join(parents.select(key).distinct(), key, "left_anti")


def cascade(tables: dict[str, DataFrame], gone: DataFrame, key: str = "key") -> DataFrame:
    """For each table (documents, chunks, vectors, ...) what a deletion of gone leaves and takes: kind, kept, deleted."""
    keys = gone.select(key).distinct().withColumn("_gone", F.lit(True))
    count = lambda df, kind: df.join(keys, key, "left").agg(F.lit(kind).alias("kind"), F.count_if(F.col("_gone").isNull()).alias("kept"), F.count_if(F.col("_gone").isNotNull()).alias("deleted"))
    out = None
    for kind, df in tables.items():
        one = count(df, kind)
        out = one if out is None else out.unionByName(one)
    return out


def vector_rows(chunks: DataFrame, vectors: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows of the vectors table: children alone are searched, each with what filters need. vectors (chunk_uid, v)."""
    owned = chunks.where("level = 1").join(documents.select("doc_key", "company_code", "report_year"), "doc_key")
    return owned.join(vectors, "chunk_uid").select("chunk_uid", "strategy", "doc_key", "company_code", "report_year", "chunk_type", "statement_type", F.col("v").cast("array<float>").alias("v"))


def lookup(documents: DataFrame, key: str) -> DataFrame:
    """The document of a key, or no row; the key is a literal, so the filter reaches the scan."""
    return documents.where(F.col("doc_key") == key)


def listing(documents: DataFrame, limit: int = 50) -> DataFrame:
    """The first documents by key; the limit is from 1 to 200."""
    if not 1 <= limit <= 200:
        raise ValueError("a listing has from 1 to 200 rows")
    return documents.orderBy("doc_key").limit(limit)


def transitions(moves: DataFrame) -> DataFrame:
    """moves (now, then, ...) and whether each may be: the rules of may_follow as columns."""
    place = lambda c: F.array_position(F.array(*(F.lit(s) for s in STATES)), F.col(c))
    on = (place("now") < 5) & (place("then") == place("now") + 1)
    again = F.col("now").isin("ready", "failed") & (F.col("then") == "parsing")
    return moves.withColumn("allowed", F.coalesce((place("now") > 0) & ((F.col("then") == "failed") | on | again), F.lit(False)))


def job_status(steps: DataFrame) -> DataFrame:
    """steps (job, at, status, error): of each job the last status, when it began and ended, how far it is (per cent of the states), its error if it failed."""
    last = steps.groupBy("job").agg(F.max(F.struct("at", "status", "error")).alias("l"), F.min("at").alias("started_at"))
    place = F.array_position(F.array(*(F.lit(s) for s in STATES[:5])), F.col("l.status"))
    over = F.col("l.status").isin("ready", "failed")
    return last.select("job", F.col("l.status").alias("status"), "started_at", F.when(over, F.col("l.at")).alias("finished_at"), F.when(F.col("l.status") == "failed", F.lit(None).cast("int")).otherwise(((place - 1) * 25).cast("int")).alias("progress"), F.when(F.col("l.status") == "failed", F.col("l.error")).alias("error"))


def may_follow(now: str, then: str) -> bool:
    """Whether a document may go from one state to another: on by one, from anywhere to failed, from an end to parsing again."""
    k = STATES.index(now)
    return then == "failed" or (k < 4 and STATES[k + 1] == then) or (now in ("ready", "failed") and then == "parsing")
