"""Connected components of an edge table by randomised contraction, all in shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialise


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(id, component) for every id in edges(a, b) of long ids; component is the smallest id that can be reached.

    Each round gives every id the name of that neighbour (or itself) which comes first in an order drawn anew for the
    round, and renames the edges; loops go. A round leaves a fraction of the ids, whatever the shape, so the rounds grow
    with the logarithm of the longest path. Names are joined back in turn at the end.
    """
    edges = materialise(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").distinct(), "edges")
    named, names = None, []
    for k in range(rounds):
        both = edges.union(edges.select("b", "a"))
        order = F.struct(F.xxhash64("b", F.lit(k)).alias("o"), F.col("b").alias("id"))
        best = both.groupBy("a").agg(F.min(order).alias("m"))
        own = F.struct(F.xxhash64("a", F.lit(k)).alias("o"), F.col("a").alias("id"))
        name = materialise(best.select(F.col("a").alias("id"), F.least(F.col("m"), own)["id"].alias("name")), "names")
        names.append(name)
        before = edges
        edges = (
            edges.join(name.select(F.col("id").alias("a"), F.col("name").alias("x")), "a")
            .join(name.select(F.col("id").alias("b"), F.col("name").alias("y")), "b")
            .where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct()
        )
        edges = materialise(edges, "edges")
        discard(before)
        if named is None:
            named = name
        else:
            later = name.select(F.col("id").alias("name"), F.col("name").alias("next"))
            named = named.join(later, "name", "left").select("id", F.coalesce("next", "name").alias("name"))
        if edges.isEmpty():
            break
    else:
        raise RuntimeError("components: more rounds than any graph should need")
    named = materialise(named, "named")
    discard(edges, *names)
    least = named.groupBy("name").agg(F.min("id").alias("component"))
    return named.join(least, "name").select("id", "component")
