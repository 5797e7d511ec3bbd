"""The tables of an engine instance, and the rules that their rows keep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = {
    "documents": "doc_key string, company_code string, company_name string, report_year int, report_type string, source_url string, file_path string, content_hash string, pipeline_hash string, page_count int, chunk_count int, index_cost decimal(10,6), status string, error_code string, error_msg string, created_at timestamp, updated_at timestamp",
    "chunks": "chunk_uid string, doc_key string, parent_uid string, level int, chunk_type string, heading_path string, page_start int, page_end int, token_count int, content string, strategy string, unit string, currency string, period string, statement_type string, table_flags array<string>",
    "vectors": "chunk_uid string, strategy string, doc_key string, company_code string, report_year int, chunk_type string, statement_type string, v array<float>",
    "financial_metrics": "company_code string, report_year int, period string, metric_code string, value decimal(20,4), unit string, raw_unit string, source_doc_key string, page int, chunk_uid string, confidence decimal(4,3), verify_status string, verify_source string",
    "eval_runs": "run_id long, exp_id string, config_snapshot string, metrics string, git_sha string, total_cost decimal(12,6), status string, started_at timestamp, finished_at timestamp",
    "eval_results": "run_id long, item_id long, answer string, refused boolean, retrieved_uids array<string>, is_correct boolean, numeric_ok boolean, unit_ok boolean, recall_at_k decimal(5,4), page_recall decimal(5,4), latency_ms int, cost decimal(12,6), error string",
    "cache": "cache_key string, exp_id string, entity_key string, v array<float>, answer_json string, hit_count int, created_at timestamp",
}
PARTITIONS = {"chunks": ["strategy", "doc_key"], "vectors": ["strategy", "doc_key"], "cache": ["exp_id"], "eval_results": ["run_id"]}
KEYS = {"documents": ["doc_key"], "chunks": ["chunk_uid"], "vectors": ["chunk_uid"], "financial_metrics": ["company_code", "report_year", "period", "metric_code"], "eval_results": ["run_id", "item_id"]}
#: What a column may hold.
ALLOWED = {
    "documents": {"status": ["pending", "parsing", "chunking", "embedding", "ready", "failed"]},
    "chunks": {"chunk_type": ["text", "table", "table_summary"], "level": [0, 1]},
}
#: Limits of the index in bytes.
BYTES = {"chunks": {"content": 8192, "heading_path": 1024, "unit": 32}, "cache": {"answer_json": 16384}}


def create(spark: SparkSession, database: str, drop: bool = False) -> None:
    """The tables that are not there yet; with drop, all anew."""
    spark.sql(f"create database if not exists {database}")
    for name, columns in TABLES.items():
        if drop:
            spark.sql(f"drop table if exists {database}.{name}")
        by = f" partitioned by ({', '.join(PARTITIONS[name])})" if name in PARTITIONS else ""
        spark.sql(f"create table if not exists {database}.{name} ({columns}) using parquet{by}")


def violations(table: str, rows: DataFrame) -> DataFrame:
    """rule, key for each broken rule: a null or repeated key, a value that is not allowed, a text too long for the index."""
    keys = KEYS.get(table, [])
    key = F.to_json(F.struct(*keys)) if keys else F.lit(None).cast("string")
    rules = [(F.col(c).isNull(), f"null {c}") for c in keys]
    rules += [(F.col(c).isNotNull() & ~F.col(c).isin(values), f"value of {c}") for c, values in ALLOWED.get(table, {}).items()]
    rules += [(F.octet_length(F.encode(F.col(c), "UTF-8")) > n, f"length of {c}") for c, n in BYTES.get(table, {}).items()]
    broken = rows.select(key.alias("key"), F.explode(F.array_compact(F.array(*(F.when(rule, name) for rule, name in rules)))).alias("rule")) if rules else rows.select(key.alias("key"), F.lit("").alias("rule")).limit(0)
    if not keys:
        return broken.select("rule", "key")
    repeated = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(F.lit("repeated key").alias("rule"), F.to_json(F.struct(*keys)).alias("key"))
    return broken.select("rule", "key").unionByName(repeated)
