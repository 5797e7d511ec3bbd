"""Evaluation queries. `labels` stand for judged items (correct: not toxic, verified: of quality 1, category: the document's
lang), `events` for the latencies and costs of answers; what depends on the wording of answers runs on literal ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators.ranks import order_statistics
from .catalogue import query, table
from .fixture import Fixture

RESULTS = "results AS (SELECT doc_id, lang AS category, toxic = 0 AS is_correct, CASE WHEN quality = 1 THEN toxic = 0 END AS unit_ok FROM labels JOIN documents USING (doc_id))"


def results(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("category"))
    right = F.col("toxic") == 0
    return table(spark, d, "labels").join(docs, "doc_id").select("doc_id", "category", right.alias("is_correct"), F.when(F.col("quality") == 1, right).alias("unit_ok"))


@query("eval_items_verified", "SELECT doc_id AS item_id, (SELECT count(*) FROM labels WHERE quality <> 1) AS unverified FROM labels WHERE quality = 1")
def eval_items_verified(spark, d):
    items = table(spark, d, "labels")
    left_out = items.agg(F.count_if(F.col("quality") != 1).alias("unverified"))
    return items.where("quality = 1").select(F.col("doc_id").alias("item_id")).join(F.broadcast(left_out))


@query(
    "eval_summary",
    f"WITH {RESULTS} SELECT category, count(*) AS n, round(avg(is_correct::INT), 6) AS is_correct, count(is_correct) AS n_is_correct, round(avg(unit_ok::INT), 6) AS unit_ok, count(unit_ok) AS n_unit_ok FROM results GROUP BY GROUPING SETS ((category), ())",
)
def eval_summary(spark, d):
    return E.summary(results(spark, d), "category", ["is_correct", "unit_ok"]).withColumns({c: F.round(c, 6) for c in ("is_correct", "unit_ok")})


@query("wrong_answer_rate", f"WITH {RESULTS} SELECT round(avg(1 - is_correct::INT), 6) AS rate, count(*) AS n FROM results WHERE category = 'de'")
def wrong_answer_rate(spark, d):
    """German items stand for those that ought to be refused."""
    return results(spark, d).where("category = 'de'").agg(F.round(F.avg(1 - F.col("is_correct").cast("int")), 6).alias("rate"), F.count("*").alias("n"))


BOOTSTRAP = """v AS (SELECT row_number() OVER (ORDER BY toxic = 0, doc_id) - 1 AS i, CAST(toxic = 0 AS INT)::DOUBLE AS v FROM labels WHERE toxic IS NOT NULL), n AS (SELECT count(*) AS n FROM v),
draws AS (SELECT r.round, CAST('0x' || substr(md5(r.round || '-' || i), 1, 12) AS BIGINT) % n AS i FROM v CROSS JOIN range(1000) AS r(round) CROSS JOIN n),
means AS (SELECT draws.round, sum(v) / any_value(n) AS m FROM draws JOIN v USING (i) CROSS JOIN n GROUP BY 1),
ms AS (SELECT list(m ORDER BY m) AS ms FROM means)"""


@query("bootstrap_ci", f"WITH {BOOTSTRAP} SELECT round(avg(v), 6) AS mean, round(any_value(ms[26]), 6) AS lo, round(any_value(ms[976]), 6) AS hi, count(*) AS n FROM v CROSS JOIN ms")
def bootstrap_ci(spark, d):
    """A thousand rounds over the verdicts of all labels."""
    values = table(spark, d, "labels").select(F.expr("double(toxic = 0)").alias("v"))
    return E.bootstrap_ci(values).withColumns({c: F.round(c, 6) for c in ("mean", "lo", "hi")})


@query("bootstrap_mt")
def bootstrap_mt(spark, d):
    """Rows only: the replay of Python's generator over the literal verdicts of a run."""
    return spark.createDataFrame([E.bootstrap_mt([1.0, 0.0, 1.0, 1.0, 1.0, 0.0, 1.0, 1.0])], "mean double, lo double, hi double, n int")


INTERVALS = f"iv AS (SELECT category, avg(is_correct::INT) - 1.96 * sqrt(avg(is_correct::INT) * (1 - avg(is_correct::INT)) / count(*)) AS lo, avg(is_correct::INT) + 1.96 * sqrt(avg(is_correct::INT) * (1 - avg(is_correct::INT)) / count(*)) AS hi FROM results GROUP BY 1)"


@query("ci_overlap", f"WITH {RESULTS}, {INTERVALS} SELECT a.category AS a, b.category AS b, NOT (a.hi < b.lo OR b.hi < a.lo) AS overlap FROM iv a JOIN iv b ON a.category < b.category")
def ci_overlap(spark, d):
    """Categories are few, so their pairs are."""
    p, n = F.avg(F.col("is_correct").cast("int")), F.count("*")
    half = 1.96 * F.sqrt(p * (1 - p) / n)
    iv = results(spark, d).groupBy("category").agg((p - half).alias("lo"), (p + half).alias("hi"))
    a, b = iv.toDF("a", "alo", "ahi"), iv.toDF("b", "blo", "bhi")
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", E.overlap(F.col("alo"), F.col("ahi"), F.col("blo"), F.col("bhi")).alias("overlap"))


@query("latency_stats", "SELECT event_type, count(value) AS n, list(value ORDER BY value)[count(value) // 2 + 1] AS median, list(value ORDER BY value)[least(count(value) - 1, CAST(floor(count(value) * 0.95::DOUBLE) AS BIGINT)) + 1] AS p95 FROM events WHERE value IS NOT NULL GROUP BY 1")
def latency_stats(spark, d):
    """The values at places n // 2 and int(0.95 n), not interpolated."""
    return order_statistics(table(spark, d, "events"), "event_type", "value", {"median": lambda n: n // 2, "p95": lambda n: min(n - 1, int(n * 0.95))})


@query("cost_stats", "SELECT event_type, round(sum(value), 4) AS total, round(sum(value) / greatest(count(*), 1), 6) AS per_question FROM events GROUP BY 1")
def cost_stats(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.sum("value"), 4).alias("total"), F.round(F.sum("value") / F.greatest(F.count("*"), F.lit(1)), 6).alias("per_question"))


@query("usage_merge", "WITH e AS (SELECT user_id, event_type AS profile, round(sum(value), 6) AS cost FROM events GROUP BY 1, 2) SELECT user_id, string_agg(profile || '=' || printf('%.4f', cost), ';' ORDER BY profile) AS usage FROM e GROUP BY 1")
def usage_merge(spark, d):
    """Each event is a usage map of one entry; maps are added entry by entry."""
    rows = table(spark, d, "events").select("user_id", F.create_map("event_type", "value").alias("usage"))
    merged = E.merge_usage(rows, "user_id", "usage")
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("usage")), lambda e: F.format_string("%s=%.4f", e["key"], e["value"])), ";")
    return merged.select("user_id", shown.alias("usage"))


PRICES = Fixture("profile string, price_in double, price_out double", [("click", 0.0008, 0.002), ("view", 0.00015, 0.0015), ("purchase", 0.0003, 0.0006), ("error", 0.0005, 0.0015)])


@query("llm_cost", f"WITH {PRICES.sql('prices')} SELECT event_id, round(value / 1000 * price_in + CAST(json_extract(props, '$.k') AS DOUBLE) / 1000 * price_out, 12) AS cost FROM events JOIN prices ON profile = event_type")
def llm_cost(spark, d):
    """value stands for the tokens read, props.k for those written; an unknown profile has no price and no row."""
    events = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    cost = F.col("value") / 1000 * F.col("price_in") + F.col("k") / 1000 * F.col("price_out")
    return events.join(F.broadcast(PRICES.df(spark)), F.col("event_type") == F.col("profile")).select("event_id", F.round(cost, 12).alias("cost"))


# --- wording of answers, on literal cases ---

ANSWERS = Fixture(
    "id int, answer string, value double, unit string, truth string, category string, refused boolean",
    [
        (1, "2025年营业收入为 22,146,581 千元（即 221.47 亿元）。", 22146581.0, "千元", None, "table", False),
        (2, "营业收入为221.47亿元", 22146581.0, "千元", None, "table", False),
        (3, "营业收入为 1,476.94", 1476.94, "元", None, "table", False),
        (4, "同比减少1.21%", -1.21, "%", None, "table", False),
        (5, "同比增长1.21%", -1.21, "%", None, "table", False),
        (6, "资料中未找到相关数据。", None, None, None, "refuse", False),
        (7, "贵州茅台的股票代码是600519。但无法提供实时行情。", None, None, "600519", "fact", False),
        (8, "我无法对该股票的未来走势做出判断。", None, None, None, "refuse", False),
        (9, "公司未对外提供担保，营业收入为 5.2 亿元", 5.2, "亿元", None, "table", False),
        (10, "注册地为贵州省仁怀市、主营白酒", None, None, "仁怀市、白酒", "fact", False),
        (11, "注册地为贵州省", None, None, "仁怀市，白酒；茅台", "fact", False),
        (12, "", None, None, None, "multihop", True),
        (13, "净利润 0 元", 0.0, "元", None, "table", False),
        (14, "约 300 万元", 3000000.0, "元", None, "table", False),
        (15, "该公司不存在第五季度。", None, None, None, "refuse", False),
        (16, "股东人数 12,345 人", 12345.0, "人", None, "table", False),
        (17, "没有数字的回答", 7.0, None, None, "table", False),
        (18, "完全无关", None, None, None, "multihop", False),
    ],
)
SCALES = "MAP {'元': 1.0::DOUBLE, '千元': 1e3, '万元': 1e4, '百万元': 1e6, '亿元': 1e8, '万': 1e4, '亿': 1e8}"
_NUM, _UNIT = "regexp_extract_all(answer, '{0}', 1)".format(E.AMOUNT), "regexp_extract_all(answer, '{0}', 2)".format(E.AMOUNT)
AMOUNTS = f"""ans AS (SELECT *, list_filter(list_transform(range(1, len({_NUM}) + 1), lambda i: {{'value': TRY_CAST(regexp_replace(({_NUM})[CAST(i AS BIGINT)], '[,，]', '', 'g') AS DOUBLE), 'unit': nullif(({_UNIT})[CAST(i AS BIGINT)], '')}}), lambda x: x.value IS NOT NULL) AS am FROM a)"""
_WORDS = "(" + " OR ".join(f"contains(answer, '{w}')" for w in E.DECREASE_WORDS) + ")"
_TARGET = f"coalesce(value * {SCALES}[unit], value)"
_CLOSE = "coalesce(CASE WHEN tg = 0 THEN abs({0}) <= 0.005 ELSE abs({0} - tg) <= abs(tg) * 0.005 END, false)"
MATCHED = f"""tgt AS (SELECT *, {_TARGET} AS tg, {_WORDS} AS dec FROM ans),
un AS (SELECT id, tg, unnest(am, max_depth := 1) AS x FROM tgt),
hits AS (SELECT id, bool_or({_CLOSE.format('x.value * ' + SCALES + '[x.unit]')} OR {_CLOSE.format('x.value')}) AS plain, bool_or({_CLOSE.format('(-abs(x.value))')} OR {_CLOSE.format('(-abs(x.value) * ' + SCALES + '[x.unit]' + ')')}) AS neg FROM un GROUP BY 1),
mt AS (SELECT tgt.*, CASE WHEN value IS NULL THEN NULL ELSE coalesce(plain, false) OR (coalesce(unit = '%', false) AND tg < 0 AND dec AND coalesce(neg, false)) END AS matched FROM tgt LEFT JOIN hits USING (id))"""
_FIRST = r"string_split_regex(regexp_replace(answer, '^[\s 　]+|[\s 　]+$', '', 'g'), '[。！？\n]')[1]"
REFUSAL = "(refused OR regexp_matches({0}, '{1}') OR regexp_matches({0}, '{2}') OR {3})".format(_FIRST, E.REFUSAL, E.CANNOT_JUDGE, " OR ".join(f"contains({_FIRST}, '{m}')" for m in E.REFUSAL_MARKERS))
_KEYS = "list_filter(list_transform(string_split_regex(truth, '[、,，;；/]'), lambda k: trim(k)), lambda k: length(k) >= 2)"
FACT = f"(CASE WHEN len({_KEYS}) = 0 THEN contains(answer, trim(truth)) ELSE len(list_filter({_KEYS}, lambda k: contains(answer, k))) = len({_KEYS}) END)"
DECLARED = "(CASE WHEN coalesce(unit, '') = '' THEN true ELSE contains(answer, unit) OR {} END)".format(" OR ".join(f"(contains(answer, '{u}') AND {f}::DOUBLE >= coalesce({SCALES}[unit], 1))" for u, f in E.SPOKEN_SCALE.items()))


@query("extract_amounts", f"WITH {ANSWERS.sql('a')}, {AMOUNTS}, un AS (SELECT id, unnest(am, max_depth := 1) AS x FROM ans), s AS (SELECT id, am FROM ans) SELECT id, x.value AS value, x.unit AS unit FROM un")
def extract_amounts(spark, d):
    return ANSWERS.df(spark).select("id", F.explode(E.amounts(F.col("answer"))).alias("x")).select("id", "x.value", "x.unit")


@query("numeric_match", f"WITH {ANSWERS.sql('a')}, {AMOUNTS}, {MATCHED} SELECT id, matched FROM mt WHERE value IS NOT NULL")
def numeric_match(spark, d):
    return ANSWERS.df(spark).where("value is not null").select("id", E.numeric_match(F.col("answer"), F.col("value"), F.col("unit")).alias("matched"))


@query("is_refusal", f"WITH {ANSWERS.sql('a')} SELECT id, {REFUSAL} AS refusal FROM a")
def is_refusal(spark, d):
    return ANSWERS.df(spark).select("id", E.is_refusal(F.col("answer"), F.col("refused")).alias("refusal"))


@query("fact_match", f"WITH {ANSWERS.sql('a')} SELECT id, {FACT} AS matched FROM a WHERE truth IS NOT NULL")
def fact_match(spark, d):
    return ANSWERS.df(spark).where("truth is not null").select("id", E.fact_match(F.col("answer"), F.col("truth")).alias("matched"))


@query("unit_declared", f"WITH {ANSWERS.sql('a')} SELECT id, {DECLARED} AS declared FROM a")
def unit_declared(spark, d):
    return ANSWERS.df(spark).select("id", E.unit_declared(F.col("answer"), F.col("unit")).alias("declared"))


@query("judge", f"WITH {ANSWERS.sql('a')}, {AMOUNTS}, {MATCHED} SELECT id, CASE WHEN category = 'refuse' THEN {REFUSAL} WHEN {REFUSAL} THEN false WHEN value IS NOT NULL THEN matched AND {DECLARED} WHEN truth IS NOT NULL THEN {FACT} END AS correct FROM mt")
def judge(spark, d):
    c = {k: F.col(k) for k in ("category", "answer", "refused", "value", "unit", "truth")}
    return ANSWERS.df(spark).select("id", E.judge(**c).alias("correct"))


RETRIEVED = Fixture(
    "id int, uids array<string>, keys array<string>, starts array<int>, ends array<int>, expected array<int>",
    [
        (1, ["600519_2025_annual-heading-L1-00001-a", "300750_2025_annual-heading-L1-00002-b"], ["600519_2025_annual"], [6, 10], [7, 10], [6]),
        (2, ["600519_2024_annual-heading-L1-00001-a"], ["600519_2025_annual", "600519_2024_annual"], [5], [3], [6, 9]),
        (3, [], ["600519_2025_annual"], [], [], [1]),
        (4, ["x"], None, [3], [4], None),
        (5, ["x"], [], [3], [4], []),
        (6, ["a", "b"], ["a", "c"], [1, 1], [4, 2], [5, 7]),
    ],
)


@query("doc_recall", f"WITH {RETRIEVED.sql('r')} SELECT id, CASE WHEN coalesce(len(keys), 0) = 0 THEN NULL WHEN len(uids) = 0 THEN 0 ELSE len(list_filter(keys, lambda k: len(list_filter(uids, lambda u: contains(u, k))) > 0))::DOUBLE / len(keys) END AS recall FROM r")
def doc_recall(spark, d):
    return RETRIEVED.df(spark).select("id", E.doc_recall(F.col("uids"), F.col("keys")).alias("recall"))


@query(
    "page_recall",
    f"""WITH {RETRIEVED.sql('r')}, c AS (SELECT id, expected, unnest(starts) AS s, unnest(ends) AS e FROM r), p AS (SELECT DISTINCT id, unnest(range(s, greatest(s, e) + 1)) AS page FROM c),
l AS (SELECT r.id, r.expected, coalesce(list(page ORDER BY page) FILTER (page IS NOT NULL), []) AS pages FROM r LEFT JOIN p ON p.id = r.id GROUP BY r.id, r.expected)
SELECT id, CASE WHEN coalesce(len(expected), 0) = 0 THEN NULL WHEN len(pages) = 0 THEN 0 ELSE len(list_filter(expected, lambda x: len(list_filter(pages, lambda q: abs(x - q) <= 1)) > 0))::DOUBLE / len(expected) END AS recall FROM l""",
)
def page_recall(spark, d):
    chunks = F.zip_with("starts", "ends", lambda s, e: F.struct(s.alias("start"), e.alias("end")))
    return RETRIEVED.df(spark).withColumn("pages", E.page_list(chunks)).select("id", E.page_recall(F.col("pages"), F.col("expected")).alias("recall"))


ERRORS = Fixture("id int, error string", [(1, "Connection reset by peer"), (2, "Request timed out"), (3, "ReadTimeout"), (4, "service temporarily unavailable"), (5, "KeyError: 'x'"), (6, None)])


@query("transient_errors", f"WITH {ERRORS.sql('e')} SELECT id, coalesce(regexp_matches(error, '{E.TRANSIENT}'), false) AS transient FROM e")
def transient_errors(spark, d):
    return ERRORS.df(spark).select("id", F.coalesce(F.col("error").rlike(E.TRANSIENT), F.lit(False)).alias("transient"))
