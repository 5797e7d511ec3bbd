"""What comes in: question sets as JSONL, configuration as YAML, filings by file name, words of PDF pages by an adapter."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.questions import file_meta

#: A question of an evaluation set.
EVAL_ITEM = (
    "question string, category string, difficulty string, ground_truth string, numeric_value decimal(24,4), unit string, metric_name string, "
    "expected_doc_keys array<string>, expected_pages array<int>, source string, verified boolean, note string"
)
CATEGORIES = ("fact", "table", "multihop", "scope", "refuse")
WORD = "path string, page int, x0 double, y0 double, x1 double, y1 double, word string"


def eval_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of a JSONL file, in its own schema; a line that is none fails the read."""
    return spark.read.schema(EVAL_ITEM).option("mode", "FAILFAST").json(path)


def violations(items: DataFrame) -> DataFrame:
    """Items that break a rule of the schema, with the rule."""
    rule = F.when(F.col("question").isNull() | (F.trim("question") == ""), "no question").when(~F.coalesce(F.col("category").isin(*CATEGORIES), F.lit(False)), "unknown category")
    return items.withColumn("violation", rule).where("violation is not null")


def replace_dataset(items: DataFrame, path: str, name: str) -> None:
    """Writes the items as the data set of that name, in place of the one before, and touches no other."""
    items.withColumn("dataset", F.lit(name)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset").parquet(path)


def config(path: str) -> dict:
    """A YAML file, where a YAML library is installed."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def lookup(tree: dict, dotted: str, default=None):
    """The value under a.b.c of nested dictionaries."""
    for key in dotted.split("."):
        if not isinstance(tree, dict) or key not in tree:
            return default
        tree = tree[key]
    return tree


def filings(spark: SparkSession, path: str) -> DataFrame:
    """path, code, company, year, content_hash, length for each PDF file; a name that says nothing of them is an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    meta = file_meta(name)
    known = F.when(meta.isNull(), F.raise_error(F.concat(F.lit("not a filing's name: "), name)).cast("struct<code:string,company:string,year:int>")).otherwise(meta)
    return files.select("path", known.alias("m"), F.sha2("content", 256).alias("content_hash"), "length").select("path", "m.*", "content_hash", "length")


def pdf_lines(spark: SparkSession, path: str, reader: Callable[[bytes, int], Iterator[tuple[int, int, str]]], max_pages: int | None = None) -> DataFrame:
    """path, page, line_no, text of the first max_pages pages, by a reader (content, pages or 0 for all) that the caller brings."""

    def of(frames):
        import pandas as pd

        for frame in frames:
            rows = [(p, *x) for p, content in zip(frame["path"], frame["content"]) for x in reader(content, max_pages or 0) if max_pages is None or x[0] <= max_pages]
            yield pd.DataFrame(rows, columns=["path", "page", "line_no", "text"]).astype({"page": "int32", "line_no": "int32"})

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "content").mapInPandas(of, "path string, page int, line_no int, text string")


def mismatched(filings: DataFrame, lines: DataFrame, pages: int = 3) -> DataFrame:
    """filings (path, code, company) whose first pages (path, page, line_no, text) name neither their code nor their company: fetched wrongly, to be
    deleted."""
    head = lines.where(F.col("page") <= pages).groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "line_no", "text"))), lambda x: x["text"]), "").alias("head"))
    bare = F.regexp_replace(F.coalesce("head", F.lit("")), r"\s", "")
    return filings.join(head, "path", "left").where(~F.contains(bare, F.col("code")) & ~F.contains(bare, F.col("company"))).select("path", "code", "company")


def pdf_words(spark: SparkSession, path: str, reader: Callable[[bytes], Iterator[tuple[int, float, float, float, float, str]]]) -> DataFrame:
    """Words with their boxes, by a reader that the caller brings (no PDF library is part of this package)."""

    def of(frames):
        import pandas as pd

        for frame in frames:
            rows = [(p, *w) for p, content in zip(frame["path"], frame["content"]) for w in reader(content)]
            yield pd.DataFrame(rows, columns=["path", "page", "x0", "y0", "x1", "y1", "word"]).astype({"page": "int32"})

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "content").mapInPandas(of, WORD)
