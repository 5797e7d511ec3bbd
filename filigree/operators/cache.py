"""Answers that may be given again: an exact store with a time to live, a semantic one under hard constraints, both apart for each namespace.

Entries are rows of schema.TABLES["cache"]; a namespace (exp_id) is an experiment and the fingerprint of what answers it. Writing is adding
rows: of one key the last one counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import questions as Q
from .nearest import nearest

NAMESPACE_BYTES, ENTITY_CHARS = 32, 256
#: What an answer is stored as.
PAYLOAD = "answer string, citations array<int>, refused boolean"


def namespace(experiment: Column, fingerprint: Column) -> Column:
    """experiment@fingerprint, cut to what the index takes."""
    return F.substring(F.concat(experiment, F.lit("@"), fingerprint), 1, NAMESPACE_BYTES)


def entries(answers: DataFrame, now: Column) -> DataFrame:
    """answers (exp_id, entity_key, question, v, and those of PAYLOAD) as rows of the cache; what may not be cached is the caller's to leave out."""
    names = [c.split(" ")[0] for c in PAYLOAD.split(", ")]
    key = Q.exact_key(F.col("exp_id"), F.col("entity_key"), F.col("question"))
    return answers.select(key.alias("cache_key"), "exp_id", F.substring("entity_key", 1, ENTITY_CHARS).alias("entity_key"), F.col("v").cast("array<float>").alias("v"), F.to_json(F.struct(*names)).alias("answer_json"), F.lit(0).alias("hit_count"), now.alias("created_at"))


def live(cache: DataFrame, now: Column, seconds: int = Q.CACHE_SECONDS) -> DataFrame:
    """Of each key the last entry, if it is not older than `seconds`."""
    last = cache.groupBy("exp_id", "cache_key").agg(F.max(F.struct("created_at", "answer_json", "entity_key", "v")).alias("e"))
    age = now.cast("timestamp").cast("double") - F.col("e.created_at").cast("timestamp").cast("double")
    return last.where(age < seconds).select("exp_id", "cache_key", "e.*")


def get_exact(asked: DataFrame, cache: DataFrame, now: Column, seconds: int = Q.CACHE_SECONDS) -> DataFrame:
    """asked (id, exp_id, entity_key, question): id and the stored answer, where there is one that lives."""
    keyed = asked.select("id", "exp_id", Q.exact_key(F.col("exp_id"), F.col("entity_key"), F.col("question")).alias("cache_key"))
    found = keyed.join(live(cache, now, seconds), ["exp_id", "cache_key"])
    return found.select("id", F.from_json("answer_json", PAYLOAD).alias("a")).select("id", "a.*")


def get_semantic(asked: DataFrame, cache: DataFrame, threshold: float = Q.SEMANTIC) -> DataFrame:
    """asked (id, exp_id, entity_key, v): the answer to the nearest question of the same namespace and entities, if it is as near as threshold, with
    cache_similarity. Only entries under the same constraints are compared, in tiles where they are read; a task passes on one row a question. The semantic store has no time to live."""
    own = lambda entity: F.when(F.col("exp_id").isNotNull() & entity.isNotNull(), F.to_json(F.struct("exp_id", entity.alias("e")))).alias("key")
    questions = asked.select(F.col("id").alias("qid"), own(F.substring("entity_key", 1, ENTITY_CHARS)), "v")
    near = nearest(cache.select(F.col("cache_key").alias("id"), own(F.col("entity_key")), "v", "answer_json"), questions, 1, 4, key=True)
    first = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    best = near.withColumn("n", F.row_number().over(first)).where(F.col("n") == 1).select(F.col("qid").alias("id"), "answer_json", F.col("score").alias("cache_similarity"))
    good = best.where(F.col("cache_similarity") >= threshold)
    return good.select("id", F.from_json("answer_json", PAYLOAD).alias("a"), "cache_similarity").select("id", "a.*", "cache_similarity")


def upsert(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """The cache with fresh entries in place of former ones of their keys."""
    kept = cache.join(fresh.select("exp_id", "cache_key"), ["exp_id", "cache_key"], "left_anti")
    return kept.select(*fresh.columns).unionByName(fresh)
