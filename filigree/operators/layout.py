"""Pages as rows of words and rectangles: what is text, what is a table, and in which order they are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .tables import X_TOLERANCE, multi_value_rows

LOOK_UP, NUMBERS_OF_A_TABLE, LEAST_TEXT, LEAST_MERGED_ROWS = 140.0, 12, 8, 3


def numeric_band(words: DataFrame, least: int = NUMBERS_OF_A_TABLE) -> DataFrame:
    """page, top, bottom of the grouped numbers of pages that have enough of them: a table without lines is there, and the
    titles above it stay text."""
    numbers = words.where(F.col("word").rlike(T.GROUPED_NUMBER))
    return numbers.groupBy("page").agg(F.count("*").alias("n"), F.min("y0").alias("top"), F.max("y1").alias("bottom")).where(F.col("n") >= least).select("page", "top", "bottom")


def header_from_above(words: DataFrame, columns: DataFrame, tops: DataFrame, height: float = LOOK_UP, tolerance: float = X_TOLERANCE) -> DataFrame:
    """page, col, text of the words above a table (tops: page, top), put into the table's own columns (the first that a word's middle lies in, or 0); only
    where they name two years."""
    middle = (F.col("x0") + F.col("x1")) / 2
    above = words.join(tops, "page").where((F.col("y0") < F.col("top")) & (F.col("y1") > F.col("top") - height))
    c = columns.select(F.col("page").alias("cp"), "col", "left", "right")
    placed = above.join(c, (F.col("page") == F.col("cp")) & (middle >= F.col("left") - tolerance) & (middle <= F.col("right") + tolerance), "left")
    one = placed.groupBy("page", "x0", "y0", "word").agg(F.coalesce(F.min("col"), F.lit(0)).alias("col"))
    cells = one.groupBy("page", "col").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "y0", "word"))), lambda w: w["word"]), " ").alias("text"))
    years = cells.withColumn("years", F.sum(T.count_matches(F.col("text"), T.YEAR_LABEL)).over(Window.partitionBy("page")))
    return years.where("years >= 2").select("page", "col", "text")


def choose_table(candidates: DataFrame) -> DataFrame:
    """candidates (page, tier: ruled, text or words; rows): for each page the tables of the first tier that reads well: words are asked only
    where what the others give has several numbers in one cell, in three rows or more."""
    order = F.when(F.col("tier") == "ruled", 1).when(F.col("tier") == "text", 2).otherwise(3)
    scored = candidates.withColumn("order", order).withColumn("bad", (multi_value_rows(F.col("rows")) >= LEAST_MERGED_ROWS).cast("int"))
    best = F.dense_rank().over(Window.partitionBy("page").orderBy("bad", "order"))
    return scored.withColumn("r", best).where("r = 1").select("page", "tier", "rows")


def text_blocks(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """blocks (page, seq, x0, y0, x1, y1, text) that are prose: longer than a few characters, no contents line, and outside every
    table (page, x0, y0, x1, y1)."""
    t = tables.select(F.col("page").alias("tp"), *(F.col(c).alias(f"t{c}") for c in ("x0", "y0", "x1", "y1")))
    prose = blocks.where((F.length(T.stripped(F.col("text"))) > LEAST_TEXT) & ~F.col("text").rlike(T.TOC))
    crossing = (F.col("page") == F.col("tp")) & (F.col("x0") < F.col("tx1")) & (F.col("x1") > F.col("tx0")) & (F.col("y0") < F.col("ty1")) & (F.col("y1") > F.col("ty0"))
    return prose.join(t, crossing, "left_anti")


def reading_order(parts: DataFrame) -> DataFrame:
    """parts (page, y0, seq, ...) numbered within their document as they are read: by page, height, then as they came."""
    return parts.withColumn("n", F.row_number().over(Window.partitionBy("doc").orderBy("page", "y0", "seq")))
