"""Building question sets from parsed tables: metrics by year, checks against the page text, and the items themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# The metrics that make questions.
WANTED = "营业收入 营业总收入 利润总额 归属于上市公司股东的净利润 归属于本公司股东的净利润 归属于上市公司股东的扣除非经常性损益的净利润 经营活动产生的现金流量净额 归属于上市公司股东的净资产 总资产 资产总计".split()
RESTATED = r"调整[前后]|重述[前后]|重列[前后]"
NAME_SUFFIX = r"[（(][^）)]*[）)]\s*$"
GROUPED = r"^-?[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?$"
LEAST_GAP = 0.05


def filled_cells(line: Column) -> Column:
    """The cells of a Markdown row that are not empty, in order: merged cells shift columns, the order stays."""
    inner = F.regexp_replace(F.regexp_replace(F.trim(line), r"^\|+", ""), r"\|+$", "")
    return F.filter(F.transform(F.split(inner, r"\|"), lambda c: F.trim(c)), lambda c: c != "")


def metric_name(cell: Column) -> Column:
    return F.trim(F.regexp_replace(cell, NAME_SUFFIX, ""))


def header_years(line: Column) -> Column:
    """Of the cells from the first that names a year on: struct(year or null) for each."""
    cells = filled_cells(line)
    first = F.array_position(F.transform(cells, lambda c: c.rlike(T.YEAR)), True)
    values = F.when(first > 0, F.slice(cells, first.cast("int"), F.size(cells))).otherwise(F.array().cast("array<string>"))
    return F.transform(values, lambda c: F.when(c.rlike(T.YEAR) & ~c.rlike(T.NOT_A_YEAR_COLUMN), F.regexp_extract(c, T.YEAR, 1).cast("int")))


def extract_metrics(tables: DataFrame) -> DataFrame:
    """tables (id, lines array): id, metric, year, raw, mode for the rows of wanted metrics. The columns are those of the header
    if there are as many (exact); otherwise by shape, where grouped numbers are as many as years; under restated sub-headers
    the leftmost year alone is safe."""
    header = F.try_element_at(F.filter("lines", lambda x: x.rlike(T.YEAR) & ~F.exists(filled_cells(x), lambda c: c.rlike(GROUPED))), F.lit(1))
    restated = F.exists("lines", lambda x: x.rlike(RESTATED))
    base = tables.select("id", header_years(header).alias("cols"), restated.alias("restated"), F.explode("lines").alias("line"))
    years = F.filter("cols", lambda y: y.isNotNull())
    rows = base.select("id", "cols", years.alias("years"), "restated", filled_cells(F.col("line")).alias("cells")).where("size(cells) >= 2 and size(years) > 0")
    rows = rows.withColumn("metric", metric_name(F.element_at("cells", 1))).where(F.col("metric").isin(WANTED)).withColumn("values", F.slice("cells", 2, F.size("cells")))
    grouped = F.filter("values", lambda c: F.replace(c, F.lit(" "), F.lit("")).rlike(GROUPED))
    mode = F.when(F.size("values") == F.size("cols"), "exact").when(F.size(grouped) == F.size("years"), "shape").when(F.col("restated"), "leftmost")
    pairs = (
        F.when(F.col("mode") == "exact", F.zip_with("cols", "values", lambda y, v: F.struct(y.alias("year"), v.alias("raw"))))
        .when(F.col("mode") == "shape", F.zip_with("years", grouped, lambda y, v: F.struct(y.alias("year"), v.alias("raw"))))
        .otherwise(F.array(F.struct(F.element_at("years", 1).alias("year"), F.element_at("values", 1).alias("raw"))))
    )
    found = rows.withColumn("mode", mode).where("mode is not null").withColumn("pairs", pairs)
    out = found.select("id", "metric", "mode", F.explode("pairs").alias("p")).select("id", "metric", F.col("p.year").alias("year"), F.col("p.raw").alias("raw"), "mode")
    return out.where(F.col("year").isNotNull() & T.is_numeric(F.col("raw")))


def corroborated(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """rows (id, doc, first, last, raw): whether the number stands on one of the pages (doc, page, text), with or without its commas."""
    inside = (F.col("page") >= F.col("first")) & (F.col("page") <= F.greatest("first", "last"))
    plain = lambda c: F.replace(c, F.lit(","), F.lit(""))
    near = rows.join(pages, (rows["doc"] == pages["doc"]) & inside, "left")
    hit = F.coalesce(F.contains("text", "raw") | F.contains(plain(F.col("text")), plain(F.col("raw"))), F.lit(False))
    return near.groupBy("id").agg(F.max(hit).alias("corroborated"))


def usable(rows: DataFrame) -> DataFrame:
    """rows (doc, metric, year, value, unit, corroborated) that may make questions: borne out, with a unit, and of a metric whose values differ
    from year to year."""
    good = rows.where("corroborated and unit is not null")
    groups = good.groupBy("doc", "metric").agg(F.count("*").alias("n"), F.count_distinct("value").alias("k")).where("n = k").select("doc", "metric")
    return good.join(groups, ["doc", "metric"], "left_semi")


def year_over_year(rows: DataFrame) -> DataFrame:
    """rows (doc, metric, year, value): change against the year before, in per cent."""
    order = Window.partitionBy("doc", "metric").orderBy("year")
    before = rows.withColumn("before", F.lag("value").over(order)).withColumn("gap", F.col("year") - F.lag("year").over(order))
    return before.where("gap = 1 and before <> 0").select("doc", "metric", "year", F.round((F.col("value") - F.col("before")) / F.abs("before") * 100, 2).alias("change"))


def scope_pairs(rows: DataFrame, gap: float = LEAST_GAP) -> DataFrame:
    """rows (doc, metric, year, scope, value, unit, corroborated): metrics that have one value for the group (合并) and another for the parent (母公司), same unit,
    both borne out, apart by `gap` or more."""
    side = lambda scope, name: rows.where((F.col("scope") == scope) & F.col("corroborated")).select("doc", "metric", "year", "unit", F.col("value").alias(name))
    both = side("合并", "whole").join(side("母公司", "parent"), ["doc", "metric", "year", "unit"])
    return both.where(F.abs(F.col("whole") - F.col("parent")) >= gap * F.greatest(F.abs("whole"), F.abs("parent")))


def conflicting(items: DataFrame, question: list[str], truth: str) -> DataFrame:
    """Questions that have several truths."""
    return items.groupBy(*question).agg(F.array_sort(F.collect_set(truth)).alias("truths")).where("size(truths) > 1")


def merge(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """new, and what of old is not in it."""
    return new.unionByName(old.join(new.select(key), key, "left_anti").select(*new.columns))


def sample(items: DataFrame, by: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """n items of each group, drawn by hash: the same for any engine and partitioning."""
    order = Window.partitionBy(by).orderBy(F.md5(F.concat_ws("-", F.lit(seed), F.col(key).cast("string"))))
    return items.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n).drop("r")


def draw(items: DataFrame, caps: dict[str, int], by: str = "doc", key: str = "question", seed: int = 42) -> DataFrame:
    """Of each company's items of a category as many as its cap, drawn by hash; categories without a cap stay whole."""
    order = Window.partitionBy(by, "category").orderBy(F.md5(F.concat_ws("-", F.lit(seed), F.col(key).cast("string"))), key)
    cap = F.coalesce(*(F.when(F.col("category") == c, F.lit(n)) for c, n in caps.items()), F.lit(2**31 - 1))
    return items.withColumn("r", F.row_number().over(order)).where(F.col("r") <= cap).drop("r")


def subset(items: DataFrame, category: str | None = None, limit: int | None = None, key: str = "id") -> DataFrame:
    """Items of one category, and the first of them: a run over these is not comparable with one over all."""
    out = items if category is None else items.where(F.col("category") == category)
    return out if limit is None else out.orderBy(key).limit(limit)


#: How many table and multihop items a company gives at most.
CAPS = {"table": 12, "multihop": 4}
DIFFICULTY = {"table": "单表直读", "multihop": "跨列计算", "scope": "口径辨析", "refuse": "语料外公司"}
_ITEM = "question string, category string, difficulty string, ground_truth string, numeric_value double, unit string, metric_name string, expected_doc_keys array<string>, expected_pages array<int>, source string, verified boolean, note string"


def _item(df: DataFrame, category: str, **given: Column) -> DataFrame:
    """The twelve fields of an item, and doc, the company it is of."""
    given = {"category": F.lit(category), "difficulty": F.lit(DIFFICULTY[category]), "source": F.lit("auto_extracted"), "verified": F.lit(True), **given}
    return df.select(*(given.get(c, F.lit(None)).cast(k).alias(c) for c, k in (x.split(" ", 1) for x in _ITEM.split(", "))), F.col("doc"))


def full_items(rows: DataFrame, scopes: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """Items of three kinds with all their fields. rows (doc, code, metric, year, value, raw, unit, page, heading): usable ones; scopes (doc, code, metric, year, unit,
    whole, parent, whole_raw, parent_raw, page, page_end). A multihop item is of the last two years that a metric has; a scope item names the whole range of pages of its table."""
    last = rows.withColumn("doc_year", F.max("year").over(Window.partitionBy("code")))
    key = F.array(F.format_string("%s_%d_annual", "code", "doc_year"))
    table = _item(
        last, "table", question=F.format_string("%s%d年%s是多少？", "doc", "year", "metric"), ground_truth=F.concat("raw", "unit"), numeric_value=F.col("value"), unit=F.col("unit"), metric_name=F.col("metric"),
        expected_doc_keys=key, expected_pages=F.array("page"), note=F.format_string("%s 第%d页，列头年份 %d", "heading", "page", "year"),
    )
    order = Window.partitionBy("code", "metric").orderBy("year")
    two = last.withColumn("b", F.lag(F.struct("value", "raw", "page", "year")).over(order)).withColumn("n", F.row_number().over(Window.partitionBy("code", "metric").orderBy(F.desc("year")))).where("n = 1 and b is not null and b.value <> 0")
    change = F.round((F.col("value") - F.col("b.value")) / F.abs("b.value") * 100, 2)
    shown = F.concat(change.cast("string"), F.lit("%"))
    multihop = _item(
        two, "multihop", question=F.format_string("%s%d年%s比%d年变化了百分之多少？", "doc", "year", "metric", "b.year"), ground_truth=F.concat(F.lit("约"), shown), numeric_value=change, unit=F.lit("%"), metric_name=F.concat("metric", F.lit("同比")),
        expected_doc_keys=key, expected_pages=F.array_sort(F.array_distinct(F.array("page", "b.page"))), note=F.concat(F.format_string("(%s - %s) / %s = ", "raw", "b.raw", "b.raw"), shown),
    )
    side = lambda name, other: F.struct(F.lit("合并" if name == "whole" else "母公司").alias("s"), F.col(name).alias("v"), F.col(f"{name}_raw").alias("raw"), F.lit("母公司" if name == "whole" else "合并").alias("o"), F.col(f"{other}_raw").alias("other"))
    each = scopes.withColumn("x", F.explode(F.array(side("whole", "parent"), side("parent", "whole"))))
    scope = _item(
        each, "scope", question=F.format_string("%s%d年%s报表口径的%s是多少？", "doc", "year", "x.s", "metric"), ground_truth=F.concat("x.raw", "unit"), numeric_value=F.col("x.v"), unit=F.col("unit"), metric_name=F.concat("x.s", "metric"),
        expected_doc_keys=F.array(F.format_string("%s_%d_annual", "code", "year")), expected_pages=F.sequence(F.col("page"), F.greatest("page", F.coalesce("page_end", F.lit(0)))), note=F.format_string("第%d页；另一口径为 %s，两者不可混用", "page", "x.other"),
    )
    return draw(table.unionByName(multihop), CAPS if caps is None else caps).unionByName(scope)


def refuse_items(asked: DataFrame, names: DataFrame) -> DataFrame:
    """asked (company, what): items about companies that are not in the corpus (names: name); one that has come in since gives none."""
    outside = asked.join(names.select(F.col("name").alias("company")).distinct(), "company", "left_anti").withColumn("doc", F.col("company"))
    nothing = {"expected_doc_keys": F.array(), "expected_pages": F.array()}
    return _item(outside, "refuse", question=F.format_string("%s%s是多少？", "company", "what"), ground_truth=F.lit("（应拒答）"), source=F.lit("manual"), note=F.concat("company", F.lit(" 不在已入库语料中，应明确说明未收录")), **nothing)


def questions(rows: DataFrame, changes: DataFrame, scopes: DataFrame) -> DataFrame:
    """Items of three kinds: category, question, value, unit. rows, changes and scopes carry the company's name as doc."""
    table = rows.select(F.lit("table").alias("category"), F.format_string("%s%d年%s是多少？", "doc", "year", "metric").alias("question"), "value", "unit")
    multihop = changes.select(F.lit("multihop").alias("category"), F.format_string("%s%d年%s同比变动百分之多少？", "doc", "year", "metric").alias("question"), F.col("change").alias("value"), F.lit("%").alias("unit"))
    each = F.explode(F.array(F.struct(F.lit("合并").alias("s"), F.col("whole").alias("v")), F.struct(F.lit("母公司").alias("s"), F.col("parent").alias("v"))))
    scope = scopes.select("doc", "year", "metric", "unit", each.alias("x")).select(F.lit("scope").alias("category"), F.format_string("%s%d年%s口径的%s是多少？", "doc", "year", "x.s", "metric").alias("question"), F.col("x.v").alias("value"), "unit")
    return table.unionByName(multihop).unionByName(scope)
