"""A training corpus from raw documents, in five stages. Each takes (spark, docs, sf_dir), works on all that its predecessor
kept, and returns a DataFrame; it is written as Parquet and read again for the next.

    toxicity            rejects documents that the learned grammar scores 0.5 or more
    near-dedup          keeps one document (the smallest doc_id) of each group of near copies: five-word shingles, 0.8
    decontamination     drops documents that hold a benchmark item, also a re-parameterised one
    mixing              puts all that is left into the Pfair order of the sources' target weights; the order is that of the
                        files and of the rows in them
    token output        encodes in that order into Arrow stream files and returns their index

Rows with a null doc_id or text pass the first four stages, but for what the operators themselves define.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.llm import decontaminate, minhash_dedup, mixing, token_output, toxicity
from filigree.llm.shared import fresh_path, materialise, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    grammar = toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.TRAINING)
    return toxicity.without_toxic(docs, grammar)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_dedup.representatives(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    order = None
    try:  # the order of the files that the mixing stage wrote; a table that is not read from files goes by doc_id
        place = docs.metadataColumn("_metadata")
        docs = docs.select("doc_id", "text", F.regexp_extract(place["file_name"], r"part-(\d+)", 1).cast("int").alias("file"), place["file_name"].alias("name"), place["row_index"].alias("row"))
        order = ["file", "name", "row"]
    except AnalysisException:
        pass
    folder = fresh_path(spark, "tokens")
    files = token_output.write_tokens(docs, folder, token_output.default_tokenizer(), order=order)
    return token_output.read_index(spark, folder, files)


STAGES = [
    ("toxicity", reject_toxic),
    ("minhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources to target weights", mix_sources),
    ("token-ID output", write_tokens),
]

#: SQL cannot express the learned grammar, the sketches and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
