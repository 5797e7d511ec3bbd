"""Deterministic judging of answers, and the figures of a run. Verdicts that do not apply are null and stay out of every mean."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPOKEN_SCALE, stripped

# How answers state amounts, refuse, and tell of a decrease.
AMOUNT = r"(-?[0-9,，]+(?:\.[0-9]+)?)\s*(百万元|千元|万元|亿元|亿|万|元)?"
REFUSAL = r"(未|没有|无法|不能|不予|查不到|找不到)\s*(披露|提供|找到|检索到|查到|给出|回答|收录|包含|提及|公布|列示|存在)"
CANNOT_JUDGE = r"(无法|不能|不便)[^。！？\n]{0,30}?(?:做出|给出|进行)?\s*(判断|评估|比较|推荐|预测|建议)"
REFUSAL_MARKERS = "未找到 没有找到 未检索到 没有检索到 无法给出 无法提供 无法回答 无法计算 我无法 不能提供 不提供投资建议 资料中未 不包含 无相关信息 未收录 未在已收录 属于未来 我目前没有 尚未发布 暂无 没有相关 不存在".split()
DECREASE_WORDS = "下降 减少 下滑 降低 负增长 减少了 下跌".split()
TRANSIENT = r"(?i)connection|timeout|timed out|temporarily"
TOLERANCE, PAGE_TOLERANCE = 0.005, 1


def amounts(answer: Column) -> Column:
    """array<struct<value double, unit string>> of the numbers of a text in order, each with the unit right after it (or null)."""
    numbers, units = F.regexp_extract_all(answer, F.lit(AMOUNT), F.lit(1)), F.regexp_extract_all(answer, F.lit(AMOUNT), F.lit(2))
    each = F.zip_with(numbers, units, lambda n, u: F.struct(F.regexp_replace(n, "[,，]", "").try_cast("double").alias("value"), F.nullif(u, F.lit("")).alias("unit")))
    return F.filter(each, lambda x: x["value"].isNotNull())


def spoken_scale(unit: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in SPOKEN_SCALE.items() for x in pair))
    return F.element_at(known, unit)


def to_yuan(value: Column, unit: Column) -> Column:
    return F.when(unit.isNotNull(), value * spoken_scale(unit))


def numeric_match(answer: Column, expected: Column, unit: Column, tolerance: float = TOLERANCE, strict: bool = False) -> Column:
    """Whether some number of the answer is the expected one, within the tolerance: in yuan, or (unless strict) as it
    stands. For a negative percentage a number whose direction a word tells counts with a minus too."""
    target = F.coalesce(to_yuan(expected, unit), expected)
    decrease = F.lit(False)
    for w in DECREASE_WORDS:
        decrease = decrease | answer.contains(w)
    close = lambda v: F.coalesce(F.when(target == 0, F.abs(v) <= tolerance).otherwise(F.abs(v - target) <= F.abs(target) * tolerance), F.lit(False))
    hit = lambda v, u: close(to_yuan(v, u)) | (close(v) if not strict else F.lit(False))
    plain = F.exists(amounts(answer), lambda a: hit(a["value"], a["unit"]))
    signed = F.exists(amounts(answer), lambda a: hit(-F.abs(a["value"]), a["unit"]))
    return plain | (F.coalesce(unit == "%", F.lit(False)) & (target < 0) & decrease & signed)


def is_refusal(answer: Column, flag: Column) -> Column:
    """Only the first sentence counts: a refusal says so at once, an answer may add what it cannot do at its end."""
    first = F.element_at(F.split(stripped(answer), r"[。！？\n]"), 1)
    marked = F.lit(False)
    for m in REFUSAL_MARKERS:
        marked = marked | first.contains(m)
    return flag | first.rlike(REFUSAL) | first.rlike(CANNOT_JUDGE) | marked


def fact_match(answer: Column, truth: Column) -> Column:
    keys = F.filter(F.transform(F.split(truth, r"[、,，;；/]"), stripped), lambda k: F.length(k) >= 2)
    return F.when(F.size(keys) == 0, answer.contains(stripped(truth))).otherwise(F.forall(keys, lambda k: answer.contains(k)))


def unit_declared(answer: Column, unit: Column) -> Column:
    """The expected unit, or any that is as large; a unit without a scale counts as 1."""
    least = F.coalesce(spoken_scale(unit), F.lit(1.0))
    larger = F.lit(False)
    for name, factor in SPOKEN_SCALE.items():
        larger = larger | (answer.contains(name) & (F.lit(factor) >= least))
    return F.when(F.coalesce(unit, F.lit("")) == "", True).otherwise(answer.contains(unit) | larger)


def doc_recall(uids: Column, keys: Column) -> Column:
    hit = F.size(F.filter(keys, lambda k: F.exists(uids, lambda u: u.contains(k))))
    return F.when(F.coalesce(F.size(keys), F.lit(0)) <= 0, None).when(F.coalesce(F.size(uids), F.lit(0)) <= 0, 0.0).otherwise(hit / F.size(keys))


def page_list(chunks: Column) -> Column:
    """Of chunks (start, end) all pages, once each, ascending."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(chunks, lambda c: F.sequence(c["start"], F.greatest(c["start"], c["end"]))))))


def page_recall(pages: Column, expected: Column, tolerance: int = PAGE_TOLERANCE) -> Column:
    hit = F.size(F.filter(expected, lambda p: F.exists(pages, lambda r: F.abs(p - r) <= tolerance)))
    return F.when(F.coalesce(F.size(expected), F.lit(0)) <= 0, None).when(F.coalesce(F.size(pages), F.lit(0)) <= 0, 0.0).otherwise(hit / F.size(expected))


def judge(category: Column, answer: Column, refused: Column, value: Column, unit: Column, truth: Column) -> Column:
    """Right, wrong, or null where nothing can be judged."""
    refusal = is_refusal(answer, refused)
    return (
        F.when(category == "refuse", refusal)
        .when(refusal, False)
        .when(value.isNotNull(), numeric_match(answer, value, unit) & unit_declared(answer, unit))
        .when(truth.isNotNull(), fact_match(answer, truth))
    )


def summary(results: DataFrame, category: str, verdicts: list[str]) -> DataFrame:
    """Overall and by category, in one pass: means of each verdict over its non-null rows, and how many there are."""
    aggs = [f"avg(cast({v} as double)) as {v}, count({v}) as n_{v}" for v in verdicts]
    return results.sparkSession.sql(f"select {category}, count(*) as n, {', '.join(aggs)} from {{r}} group by grouping sets (({category}), ())", r=results)


#: Different values that a bootstrap holds as cumulated counts.
DISTINCT = 1000


def bootstrap_ci(values: DataFrame, rounds: int = 1000, alpha: float = 0.05) -> DataFrame:
    """values (v): mean, lo, hi, n. Draw j of a round is the value at the place, in ascending order, that a hash of round and
    j gives, so any engine draws the same; bounds are order statistics of the rounds' means. Verdicts have few values: a place is looked up in
    their cumulated counts, draws are added up where they are made, and a row for each round and value is shuffled. With more than DISTINCT
    values places are joined with ranges of values."""
    spark = values.sparkSession
    schema = "mean double, lo double, hi double, n long"
    counts = values.select(F.col("v").cast("double").alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("c"))
    held = sorted(counts.limit(DISTINCT + 1).collect())
    if not held:
        return spark.createDataFrame([(0.0, 0.0, 0.0, 0)], schema)
    if len(held) > DISTINCT:
        before = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)  # of the different values
        ranges = counts.withColumn("from", F.coalesce(F.sum("c").over(before), F.lit(0)))
        n = counts.agg(F.sum("c")).first()[0]
        at = ranges.select("v", F.explode(F.sequence(F.col("from"), F.col("from") + F.col("c") - 1)).alias("i"))
        pick = lambda draws: draws.join(at, "i").groupBy("round", "v").agg(F.sum("c").alias("c"))
    else:
        n, ends = 0, []
        for v, c in held:
            n += c
            ends.append(n)
        cumulated, shown = F.array(*(F.lit(e).cast("long") for e in ends)), F.array(*(F.lit(v) for v, _ in held))
        pick = lambda draws: draws.withColumn("v", F.get(shown, F.size(F.filter(cumulated, lambda e: e <= F.col("i"))))).groupBy("round", "v").agg(F.sum("c").alias("c"))
    draws = spark.range(n).withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    place = F.conv(F.substring(F.md5(F.concat_ws("-", "round", "id")), 1, 12), 16, 10).cast("long") % n
    drawn = draws.select("round", place.alias("i"), F.lit(1).alias("c"))
    if len(held) > DISTINCT:
        drawn = drawn.groupBy("round", "i").agg(F.sum("c").alias("c"))
    means = pick(drawn).groupBy("round").agg((F.sum(F.col("c") * F.col("v")) / n).alias("m"))
    sorted_means = means.agg(F.array_sort(F.collect_list("m")).alias("ms"))  # `rounds` numbers
    bound = lambda q: F.element_at("ms", min(rounds - 1, int(rounds * q)) + 1)
    mean = counts.agg((F.sum(F.col("c") * F.col("v")) / n).alias("mean"))
    return sorted_means.join(F.broadcast(mean)).select("mean", bound(alpha / 2).alias("lo"), bound(1 - alpha / 2).alias("hi"), F.lit(n).cast("long").alias("n"))  # one row each


def bootstrap_mt(values: list[float], rounds: int = 1000, alpha: float = 0.05, seed: int = 42) -> tuple[float, float, float, int]:
    """The replay with Python's own generator, for a run's few items: mean, lo, hi, n."""
    n = len(values)
    if n == 0:
        return 0.0, 0.0, 0.0, 0
    mean = sum(values) / n
    if n == 1:
        return mean, mean, mean, 1
    rng = random.Random(seed)
    means = sorted(sum(values[rng.randrange(n)] for _ in range(n)) / n for _ in range(rounds))
    return mean, means[int(rounds * alpha / 2)], means[min(rounds - 1, int(rounds * (1 - alpha / 2)))], n


def overlap(lo: Column, hi: Column, other_lo: Column, other_hi: Column) -> Column:
    return ~((hi < other_lo) | (other_hi < lo))


def merge_usage(rows: DataFrame, key: str, usage: str) -> DataFrame:
    """Adds up maps entry by entry: key, usage (map, six decimals)."""
    entries = rows.select(key, F.explode(usage).alias("profile", "cost")).groupBy(key, "profile").agg(F.round(F.sum("cost"), 6).alias("cost"))
    return entries.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("profile", "cost")))).alias(usage))
