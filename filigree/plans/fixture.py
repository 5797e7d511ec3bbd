"""Literal tables that both engines can read: a DataFrame for Spark, a VALUES list for DuckDB."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


def literal(value, kind: str) -> str:
    """SQL text of a value for DuckDB; kind is Spark's type name."""
    if value is None:
        return f"CAST(NULL AS {duck_type(kind)})"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (list, tuple)):
        inner = kind[6:-1]
        return f"CAST([{', '.join(literal(x, inner) for x in value)}] AS {duck_type(kind)})"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return f"CAST({value} AS {duck_type(kind)})"


def duck_type(kind: str) -> str:
    if kind.startswith("array<"):
        return duck_type(kind[6:-1]) + "[]"
    return {"int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}[kind]


@dataclass(frozen=True)
class Fixture:
    """schema: 'name type, name type', as Spark writes it."""

    schema: str
    rows: list

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(r) for r in self.rows], self.schema)

    @property
    def columns(self) -> list[tuple[str, str]]:
        return [tuple(c.strip().split(" ", 1)) for c in self.schema.split(",")]

    def sql(self, name: str) -> str:
        """`name(columns) AS (...)`, for a WITH clause."""
        kinds = [k for _, k in self.columns]
        rows = ", ".join("(" + ", ".join(literal(v, k) for v, k in zip(r, kinds)) + ")" for r in self.rows)
        return f"{name}({', '.join(f'{chr(34)}{c}{chr(34)}' for c, _ in self.columns)}) AS (VALUES {rows})"
