"""Folds over the rows of a key in order, where each step needs the state that the one before has left.

Rows are dealt by key and sorted; a task reads them in Arrow batches and carries the state over, so time is linear in the rows and
memory that of a batch, however many rows a key has."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType, _parse_datatype_string


def running(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], start: Any, step: Callable[..., tuple[Any, Any]], name: str, kind: str) -> DataFrame:
    """rows with one more column: step(state, *columns) gives the next state and the row's value; each key begins with start."""
    given = _parse_datatype_string(kind)
    value, schema = to_arrow_type(given), StructType([*rows.schema.fields, StructField(name, given)])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last = start, None
        for batch in batches:
            out = []
            for own, *given in zip(zip(*(batch.column(k).to_pylist() for k in keys)), *(batch.column(c).to_pylist() for c in columns)):
                if own != last:
                    state, last = start, own
                state, made = step(state, *given)
                out.append(made)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, value)], [*batch.schema.names, name])

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(of, schema)
