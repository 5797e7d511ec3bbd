"""Order statistics of large groups, exactly, with no group in one task.

Cut points of each group come from a mergeable sketch and only say where to look: rows are counted by interval, and the one
interval that holds a wanted rank is ranked. An interval holds about 1/CUTS of its group.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CUTS = 64


def order_statistics(df: DataFrame, group: str, value: str, wanted: dict[str, Callable[[int], int]]) -> DataFrame:
    """group, n, and for each name the value at wanted[name](n) (from 0) in ascending order; nulls take no part. Groups are few:
    the driver holds CUTS numbers for each."""
    spark = df.sparkSession
    rows = df.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).where("v is not null")
    shares = [k / CUTS for k in range(1, CUTS)]
    cuts = {r.g: sorted(set(r.cuts)) for r in rows.groupBy("g").agg(F.percentile_approx("v", shares, 1000).alias("cuts")).collect()}
    if not cuts:
        return spark.createDataFrame([], f"{group} string, n long, " + ", ".join(f"{k} double" for k in wanted))
    kind = rows.schema["g"].dataType.simpleString()
    bounds = spark.createDataFrame(list(cuts.items()), f"g {kind}, cuts array<double>")
    part = rows.join(F.broadcast(bounds), rows["g"].eqNullSafe(bounds["g"])).select(rows["g"], "v", F.size(F.filter("cuts", lambda c: c <= F.col("v"))).alias("part"))
    counts: dict = {}
    for r in part.groupBy("g", "part").agg(F.count("*").alias("c")).collect():
        counts.setdefault(r.g, {})[r.part] = r.c
    targets = []
    for g, own in counts.items():
        n, before, starts = sum(own.values()), 0, []
        for p in sorted(own):
            starts.append((before, p))
            before += own[p]
        for name, at in wanted.items():
            start, p = starts[bisect_right([s for s, _ in starts], at(n)) - 1]
            targets.append((g, n, name, p, at(n) - start + 1))
    asked = spark.createDataFrame(targets, f"tg {kind}, n long, name string, tp int, k long")
    near = part.join(F.broadcast(asked.select("tg", "tp").distinct()), F.expr("g <=> tg and part = tp"), "left_semi")
    ranked = near.withColumn("k", F.expr("row_number() over (partition by g, part order by v)").cast("long"))
    hit = ranked.join(F.broadcast(asked.withColumnRenamed("k", "tk")), F.expr("g <=> tg and part = tp and k = tk"))
    return hit.groupBy(F.col("g").alias(group), "n").agg(*(F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in wanted))
