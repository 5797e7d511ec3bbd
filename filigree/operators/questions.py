"""Understanding questions by rule: companies, years, metrics, routes, cache keys, and the checks around an answer."""

from __future__ import annotations

import ast
import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stripped
from .nearest import nearest

# Words of questions and names.
FILLERS = "是多少 多少 是什么 请问 的具体数值 吗 呢 ？ ? ， ,".split()
CORPORATE = "股份有限公司|有限公司|集团|控股|科技|新能源|股份"
GENERIC = "中国 中华 国际 发展 实业 集团 股份 控股 银行 证券 保险 电力 能源 石油 医药 制药 生物 电器 科技 电子 通信 传媒 化工 汽车 食品 地产 环保 水泥 物流 建设 工业".split()
METRIC_WORDS = "营业总收入 营业收入 营业成本 利润总额 净利润 归母净利润 扣非 毛利率 净利率 经营活动产生的现金流量净额 现金流 总资产 资产总计 净资产 研发投入 研发费用 销售费用 管理费用 财务费用 存货 货币资金 股本 每股收益 分红 股利".split()
SUMMARY_HINT = "主要会计数据和财务指标"
SKIPPED_TITLES = "摘要|英文|已取消|更正|补充|问询|说明"
FILE_NAME = r"^([0-9]{6})_([^_]+)_.*?([0-9]{4})\s*年"
CODE = r"(?<![0-9])[0-9]{6}(?![0-9])"
YEAR = r"(20[0-9]{2})\s*年"
MAX_QUESTION = 500
ROUTE_CONFIDENCE, STEPS, ERRORS, COST = 0.7, 8, 3, 0.15
NOT_CACHED = "agent_forced_answer|agent_empty_answer"
CACHE_BYTES, CACHE_SECONDS, SEMANTIC = 16000, 86400, 0.97
#: Years that a filing reports, its own and those before.
COVERS = 3


def guard(question: Column) -> Column:
    """struct(question, refused): trimmed; empty and over-long questions are refused."""
    q = stripped(F.coalesce(question, F.lit("")))
    return F.struct(q.alias("question"), ((q == "") | (F.length(q) > MAX_QUESTION)).alias("refused"))


def sanitized(name: Column) -> Column:
    """The bare file name; null where nothing safe is left."""
    bare = F.trim(F.regexp_replace(name, r"^.*[/\\]", ""))
    return F.when((bare != "") & ~bare.startswith("."), bare)


def file_meta(name: Column) -> Column:
    """struct(code, company, year); null where the name is not of the form."""
    part = lambda k: F.regexp_extract(name, FILE_NAME, k)
    return F.when(name.rlike(FILE_NAME), F.struct(part(1).alias("code"), part(2).alias("company"), part(3).cast("int").alias("year")))


def wanted_report(title: Column) -> Column:
    return title.contains("年度报告") & ~title.rlike(SKIPPED_TITLES)


def report_years(years: Column) -> Column:
    """A filing covers its year and the two before, so a year is looked for in three filings."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(years, lambda y: F.sequence(y, y + (COVERS - 1))))))


def needs_summary(years: Column, filed: Column) -> Column:
    return F.coalesce((F.size(years) > 0) & (F.size(filed) > 0) & (F.array_min(years) <= F.array_max(filed) - 1), F.lit(False))


def aliases(name: Column) -> Column:
    """The name, the name without its corporate words, and of four characters or more its first and last two; generic parts
    and single characters are none."""
    base = F.trim(F.regexp_replace(name, CORPORATE, ""))
    short = F.when(F.length(base) >= 4, F.array(F.substring(base, -2, 2), F.substring(base, 1, 2))).otherwise(F.array().cast("array<string>"))
    generic = F.array(*(F.lit(g) for g in GENERIC))
    return F.array_sort(F.array_distinct(F.filter(F.concat(F.array(name, base), short), lambda a: (F.length(a) >= 2) & ~F.array_contains(generic, a))))


def own_aliases(corpus: DataFrame) -> DataFrame:
    """corpus (code, name): the aliases that name one company only, with its code."""
    each = corpus.where("name <> ''").select("code", F.explode(aliases(F.col("name"))).alias("alias")).distinct()
    return each.groupBy("alias").agg(F.min("code").alias("code"), F.count("*").alias("n")).where("n = 1").select("alias", "code")


def containing(texts: DataFrame, text: str, words: DataFrame, word: str) -> DataFrame:
    """texts with the rows of words whose word stands in their text, once each: the text's pieces of the lengths that words have meet them by
    hash, so nothing is compared with everything. Lengths are few."""
    lengths = sorted(r[0] for r in words.where(F.length(word) > 0).select(F.length(word)).distinct().collect())
    piece = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(F.col(text), i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    pieces = F.array_distinct(F.concat(F.array().cast("array<string>"), *(piece(n) for n in lengths)))
    return texts.withColumn("_piece", F.explode(pieces)).join(words.withColumn("_piece", F.col(word)), "_piece").drop("_piece")


def resolve(asked: DataFrame, corpus: DataFrame) -> DataFrame:
    """asked (id, question, history, codes, names; what a model took from the question): id, codes that the user's own words bear out. A code
    must be known and be written; a name counts as a code, as an alias, or by the first alias that it contains or is in; then
    some alias of the company (or its code) must stand in the question or the history."""
    known = corpus.select("code").distinct()
    alias = own_aliases(corpus)
    hay = F.concat_ws(" ", "question", "history")
    written = F.regexp_extract_all(hay, F.lit(CODE), F.lit(0))
    base = asked.withColumn("hay", hay).withColumn("written", written)
    by_code = base.select("id", "hay", "written", F.explode("codes").alias("code")).where(F.array_contains("written", F.col("code"))).join(known, "code", "left_semi")
    names = base.select("id", "hay", "written", F.explode("names").alias("name")).select("id", "hay", "written", F.trim("name").alias("name")).where("name <> ''")
    as_code = names.join(known, names["name"] == known["code"]).select("id", "hay", "written", "code")
    other = names.join(known.withColumnRenamed("code", "name"), "name", "left_anti")
    within = containing(other, "name", alias, "alias").select("id", "hay", "written", "name", "alias", "code")
    around = containing(alias, "alias", other.select("name").distinct(), "name").join(other, "name").select("id", "hay", "written", "name", "alias", "code")
    near = within.union(around).distinct()
    order = Window.partitionBy("id", "name").orderBy((F.col("name") != F.col("alias")), F.desc(F.length("alias")), "alias")
    by_name = near.withColumn("r", F.row_number().over(order)).where("r = 1").select("id", "hay", "written", "code")
    found = by_code.select("id", "hay", "written", "code").union(as_code).union(by_name).distinct()
    named = found.join(alias, "code").where(F.contains("hay", "alias")).select("id", "code")
    borne = named.union(found.where(F.array_contains("written", F.col("code"))).select("id", "code"))
    codes = borne.groupBy("id").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    return asked.select("id").join(codes, "id", "left").select("id", F.coalesce("codes", F.array().cast("array<string>")).alias("codes"))


def rule_analysis(questions: DataFrame, corpus: DataFrame) -> DataFrame:
    """questions (id, question), corpus (code, name, year): id, codes, years, route, confidence without a model. Asked years
    count if some filing of the corpus covers them; several companies or years, or a comparison, go to the agent."""
    alias = own_aliases(corpus.select("code", "name"))
    known = corpus.select("code").distinct()
    written = questions.select("id", F.explode(F.regexp_extract_all("question", F.lit(CODE), F.lit(0))).alias("code")).join(known, "code", "left_semi")
    named = containing(questions.select("id", "question"), "question", alias, "alias").select("id", "code")
    codes = written.select("id", "code").union(named).groupBy("id").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    covered = corpus.select(F.explode(F.sequence(F.col("year") - 2, F.col("year"))).alias("year")).distinct()
    years = questions.select("id", F.explode(F.regexp_extract_all("question", F.lit(YEAR), F.lit(1))).alias("y")).select("id", F.col("y").cast("int").alias("year")).join(covered, "year", "left_semi")
    per = years.groupBy("id").agg(F.array_sort(F.collect_set("year")).alias("years"))
    out = questions.join(codes, "id", "left").join(per, "id", "left")
    out = out.withColumn("codes", F.coalesce("codes", F.array().cast("array<string>"))).withColumn("years", F.coalesce("years", F.array().cast("array<int>")))
    agent = (F.size("codes") > 1) | (F.size("years") > 1) | F.col("question").rlike("对比|比较|增长|同比|差")
    return out.select("id", "codes", "years", F.when(agent, "agent").otherwise("rag").alias("route"), F.when(F.size("codes") > 0, 0.5).otherwise(0.3).alias("confidence"))


def route(route: Column, confidence: Column, names: Column, codes: Column) -> Column:
    """refuse where companies were named and none is known; low confidence goes to the agent, but for chat."""
    return F.when((F.size(names) > 0) & (F.size(codes) == 0), "refuse").when((confidence < ROUTE_CONFIDENCE) & (route != "chat"), "agent").otherwise(route)


def keyword_query(question: Column, names: Column, summary: Column) -> Column:
    """The question for BM25: companies that a filter handles go (longest alias first), fillers go, the hint comes."""
    longest = F.array_sort(names, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).otherwise(F.when(a < b, -1).when(a > b, 1).otherwise(0)))
    out = F.aggregate(longest, question, lambda q, n: F.replace(q, n, F.lit(" ")))
    for word in FILLERS:
        out = F.replace(out, F.lit(word), F.lit(" "))
    out = stripped(F.regexp_replace(out, "[\\s 　]+", " "))
    plain = F.when(F.size(names) == 0, question).when(out == "", question).otherwise(out)
    return F.concat(plain, F.when(summary, F.lit(" " + SUMMARY_HINT)).otherwise(F.lit("")))


def metric_words(question: Column) -> Column:
    return F.array_sort(F.filter(F.array(*(F.lit(w) for w in METRIC_WORDS)), lambda w: question.contains(w)))


def entity_key(codes: Column, years: Column, question: Column) -> Column:
    join = lambda a: F.array_join(F.array_sort(a), ",")
    return F.concat(F.lit("c="), join(codes), F.lit("|y="), join(F.transform(years, lambda y: y.cast("string"))), F.lit("|m="), F.array_join(metric_words(question), ","))


def exact_key(namespace: Column, entity: Column, question: Column) -> Column:
    return F.concat(F.lit("fc:ans:"), F.substring(F.sha2(F.concat_ws("|", namespace, entity, stripped(question)), 256), 1, 40))


def may_cache(answer: Column, cached: Column, refused: Column, degraded: Column) -> Column:
    bad = F.exists(degraded, lambda t: t.rlike("^(" + NOT_CACHED + ")"))
    return ~cached & ~refused & (F.coalesce(answer, F.lit("")) != "") & ~bad & (F.octet_length(F.encode(answer, "UTF-8")) <= CACHE_BYTES)


def semantic_hits(asked: DataFrame, cache: DataFrame, threshold: float = SEMANTIC) -> DataFrame:
    """asked (id, key, v) and cache (entry, key, v): the nearest entry of the same key, if it is as near as the threshold. Only entries of
    the same constraints are ever compared, in tiles where they are read; a task passes on one row a question."""
    near = nearest(cache.select(F.col("entry").alias("id"), "key", "v"), asked.select(F.col("id").alias("qid"), "key", "v"), 1, 9, key=True, apart=True)
    best = near.groupBy("qid").agg(F.max(F.struct("score", (-F.col("id")).alias("e"))).alias("b"))
    return best.select(F.col("qid").alias("id"), (-F.col("b.e")).alias("entry"), F.col("b.score").alias("score")).where(F.col("score") >= threshold)


def verify_citations(answer: Column, n: Column) -> Column:
    """struct(answer, kept, invalid): references beyond the sources go from the text; the sources referred to stay, or all if none is."""
    used = F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[([0-9]+)\]"), F.lit(1)), lambda x: x.cast("int")))
    valid = F.sequence(F.lit(1), n)
    invalid, cited = F.array_except(used, valid), F.array_sort(F.array_intersect(used, valid))
    text = F.aggregate(invalid, answer, lambda a, i: F.replace(a, F.concat(F.lit("["), i.cast("string"), F.lit("]")), F.lit("")))
    return F.struct(text.alias("answer"), F.when(F.size(cited) > 0, cited).otherwise(valid).alias("kept"), F.size(invalid).alias("invalid"))


def guardrail(steps: Column, errors: Column, cost: Column) -> Column:
    """Why the agent has to answer now, or null."""
    return F.when(steps >= STEPS, "max_steps").when(errors >= ERRORS, "max_errors").when(cost >= COST, "max_cost")


def calc_format(value: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.format_number(F.round(value, 4), 4), ",", ""), "0+$", ""), r"\.$", "")
    return F.when(F.abs(value) >= 1000, F.format_number(value, 2)).otherwise(plain)


_THOUSANDS = re.compile(r"(?<![\d.])\d{1,3}(?:,\d{3})+(?![\d])")
_BINARY = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: a / b, ast.FloorDiv: lambda a, b: a // b, ast.Mod: lambda a, b: a % b}
_CALLS = {"abs": abs, "round": round, "min": min, "max": max, "sum": sum, "sqrt": math.sqrt}


def calculate(expression: str) -> float:
    """Arithmetic over numbers and a few functions; anything else is an error. Grouped digits such as 1,234 are one number."""
    if len(expression) > 400:
        raise ValueError("too long")

    def value(node):
        match node:
            case ast.Constant(value=v) if type(v) in (int, float):
                return v
            case ast.UnaryOp(op=ast.USub(), operand=x):
                return -value(x)
            case ast.UnaryOp(op=ast.UAdd(), operand=x):
                return value(x)
            case ast.BinOp(left=a, op=ast.Pow(), right=b):
                x, y = value(a), value(b)
                if abs(y) > 64:
                    raise ValueError("exponent too large")
                return x**y
            case ast.BinOp(left=a, op=op, right=b) if type(op) in _BINARY:
                return _BINARY[type(op)](value(a), value(b))
            case ast.List(elts=xs) | ast.Tuple(elts=xs):
                return [value(x) for x in xs]
            case ast.Call(func=ast.Name(id=name), args=xs, keywords=[]) if name in _CALLS:
                return _CALLS[name](*(value(x) for x in xs))
        raise ValueError("not arithmetic")

    plain = _THOUSANDS.sub(lambda m: m[0].replace(",", ""), expression)
    return float(value(ast.parse(plain.strip(), mode="eval").body))


def _values(expressions):
    def one(x):
        try:
            return calculate(x)
        except (ValueError, SyntaxError, ZeroDivisionError, OverflowError, TypeError):
            return None

    return expressions.map(one).astype("float64")


def safe_eval(expression: Column) -> Column:
    """The calculator over a column; null where an expression is none."""
    return F.pandas_udf(_values, "double")(expression)
