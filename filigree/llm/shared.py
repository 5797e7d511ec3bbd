"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import discard, fresh_path, materialise, shared_dir, spread

__all__ = ["by_bytes", "discard", "fresh_path", "materialise", "shared_dir", "spread", "table"]

#: Tables of long texts.
TEXTS = ("documents", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus; texts that come in few parts are dealt to all cores."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in TEXTS else rows


def by_bytes(batch: pa.RecordBatch, column: str, most: int = 4 << 20, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about so many bytes of a text column, and so many rows, at most; a longer text is alone."""
    ends = pc.cumulative_sum(pc.fill_null(pc.cast(pc.binary_length(batch.column(column)), pa.int64()), 0)).to_pylist()
    k, done = 0, 0
    while k < batch.num_rows:
        e = k + 1
        while e < batch.num_rows and e - k < rows and ends[e] - done <= most:
            e += 1
        yield batch.slice(k, e - k)
        k, done = e, ends[e - 1]
