"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks of `block` rows, in the order of doc_id. Time goes in slots, one block in each. A source of
weight w releases its block i (from 0) at floor(i / w) and has to have it placed by ceil((i + 1) / w); in each slot that
released block is placed whose deadline is earliest (ties: the source first in order). As the weights add up to one, every
deadline is kept, and after any number T of slots each source has had w T blocks, give or take less than one, until it runs out.

Weights are taken as exact fractions and the schedule is that of the whole run, so nothing is rounded and no error adds up.
A source that has run out leaves its slots to others' released blocks or empty; the others go on at their pace: every row is
placed once, none is dropped or repeated. Sources of weight zero, and those without a weight, come after all others, in equal
shares among themselves.

Where no weights are given they follow size to the power ALPHA, between proportional (1) and equal (0).

Scale. Places within a source come from a range partitioning by (source, doc_id) and running sums in two levels, so a
source with a third of all rows is spread over its share of the partitions. The driver holds a row for each source, each
range and each block, so rows / `block` of them; the schedule is joined as a table of as many rows.

Defined cases: a null source is a source of its own, first in order; null doc_ids come first within a source; rows with one
source and doc_id stand together; if no weight is above zero, all sources count as without one; other columns go along; an empty table
gives an empty result.
"""

from __future__ import annotations

import heapq
from fractions import Fraction
from math import lcm

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise, table

BLOCK, ALPHA = 64, 0.7


def shares(weights: list[float], cycle: int) -> list[int]:
    """Whole shares of the cycle, one at least, by largest remainders; the sum is cycle. For callers that want such; the
    schedule is of the exact weights."""
    total = sum(weights)
    free = cycle - len(weights)
    exact = [w / total * cycle - 1 if total else 0.0 for w in weights]
    exact = [max(0.0, x) for x in exact]
    scale = free / sum(exact) if sum(exact) else 0.0
    exact = [x * scale for x in exact] if scale else [free / len(weights)] * len(weights)
    out = [int(x) for x in exact]
    rest = sorted(range(len(out)), key=lambda k: (out[k] - exact[k], k))
    for k in rest[: free - sum(out)]:
        out[k] += 1
    return [x + 1 for x in out]


def schedule(parts: list[int], blocks: list[int] | None = None, start: int = 0) -> list[tuple[int, int, int, int, int]]:
    """(source number, block, release, deadline, slot) by earliest deadline first, of sources with parts of sum(parts) as
    weights and so many blocks (as their parts: one cycle). start is the first slot."""
    cycle, blocks = sum(parts), blocks or parts
    # of each source the next block only: not released yet (by release), or ready (by deadline)
    waiting = [(0, s, 0) for s, n in enumerate(blocks) if n]
    ready: list[tuple[int, int, int, int]] = []
    out, slot = [], 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            r, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * cycle // parts[s]), s, i, r))
        deadline, s, i, r = heapq.heappop(ready)
        out.append((s, i, start + r, start + deadline, start + slot))
        if i + 1 < blocks[s]:
            heapq.heappush(waiting, ((i + 1) * cycle // parts[s], s, i + 1))
        slot += 1
    return out


def whole(weights: list[float]) -> list[int]:
    """Whole numbers in exactly the proportions of the weights."""
    exact = [Fraction(w) for w in weights]
    scale = lcm(*(x.denominator for x in exact))
    return [int(x * scale) for x in exact]


def run(weights: list[float], blocks: list[int]) -> list[tuple[int, int, int, int, int]]:
    """The schedule of all blocks: of the sources with a weight, then of the others."""
    out: list[tuple[int, int, int, int, int]] = []
    for some in ([s for s, w in enumerate(weights) if w > 0], [s for s, w in enumerate(weights) if not w > 0]):
        if some:
            own = schedule(whole([weights[s] if weights[s] > 0 else 1 for s in some]), [blocks[s] for s in some], out[-1][-1] + 1 if out else 0)
            out += [(some[s], *rest) for s, *rest in own]
    return out


def interleave(docs: DataFrame, weights: dict[str | None, float] | None = None, block: int = BLOCK, cycle: int | None = None, alpha: float = ALPHA) -> DataFrame:
    """For each (source, doc_id) of docs: source, doc_id, block, release, deadline, slot. cycle has no effect any more."""
    spark = docs.sparkSession
    keys = docs.select(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id")).groupBy("source", "doc_id").agg(F.count("*").alias("c"))
    ranged = materialise(keys.repartitionByRange("source", "doc_id").withColumn("part", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy("source", "part").agg(F.sum("c").alias("c")).collect()  # a row for each range, and a few more
    size: dict[str | None, int] = {}
    before = []
    for source, part, c in sorted(sums, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        before.append((source, part, size.get(source, 0)))
        size[source] = size.get(source, 0) + c
    sources = list(size)
    plan = run([weights.get(s, 0.0) if weights else size[s] ** alpha for s in sources], [-(-size[s] // block) for s in sources])
    columns = list(zip(*plan)) or [()] * 5
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    columns[0] = [sources[s] for s in columns[0]]
    offsets = spark.createDataFrame(before, "source string, part int, before long")
    places = spark.createDataFrame(pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], ["source", "i", "release", "deadline", "slot"]))
    before_own = F.expr("sum(c) over (partition by source, part order by doc_id nulls first rows between unbounded preceding and 1 preceding)")
    same = lambda a, b, *more: [a["source"].eqNullSafe(b["source"]), *more]
    ranked = ranged.withColumn("own", F.coalesce(before_own, F.lit(0)))
    ranked = ranked.join(offsets, same(ranked, offsets, ranked["part"] == offsets["part"])).select(ranked["source"], "doc_id", F.expr(f"cast(floor((own + before) / {block}) as long)").alias("block"))
    return ranked.join(places, same(ranked, places, ranked["block"] == places["i"])).select(ranked["source"], "doc_id", "block", "release", "deadline", "slot")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """docs with all their columns, sorted into the mixed order: of slots, and within a slot by doc_id. Written to files, the
    order is that of the files' numbers and of the rows in them."""
    plan = interleave(docs, **how).select(F.col("source").alias("_s"), F.col("doc_id").alias("_d"), F.col("slot").alias("_slot"))
    joined = docs.join(plan, [docs["source"].cast("string").eqNullSafe(plan["_s"]), docs["doc_id"].cast("long").eqNullSafe(plan["_d"])])
    return joined.orderBy(plan["_slot"], plan["_d"].asc_nulls_first()).select(*(docs[c] for c in docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    return interleave(table(spark, sf_dir, "documents"))
