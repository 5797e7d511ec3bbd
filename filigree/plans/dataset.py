"""Question-set queries: yearly sums over `orders` stand for metrics of filings, literal tables for their wording."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import YEAR
from ..operators import dataset as S
from .catalogue import query, table
from .fixture import Fixture

METRICS = "m AS (SELECT o_orderpriority AS doc, o_orderstatus AS metric, year(o_orderdate) AS year, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY 1, 2, 3)"


def metrics(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("doc"), F.col("o_orderstatus").alias("metric"), F.year("o_orderdate").alias("year")).agg(F.count("*").cast("double").alias("value"))


@query("yoy_change", f"WITH {METRICS}, l AS (SELECT *, lag(value) OVER w AS b, year - lag(year) OVER w AS g FROM m WINDOW w AS (PARTITION BY doc, metric ORDER BY year)) SELECT doc, metric, CAST(year AS INTEGER) AS year, round((value - b) / abs(b) * 100, 2) AS change FROM l WHERE g = 1 AND b <> 0")
def yoy_change(spark, d):
    return S.year_over_year(metrics(spark, d))


@query("usable_rows", f"WITH {METRICS}, g AS (SELECT *, value >= 10 AS ok, CASE WHEN metric <> 'P' THEN 'x' END AS unit FROM m), c AS (SELECT * FROM g WHERE ok AND unit IS NOT NULL) SELECT doc, metric, CAST(year AS INTEGER) AS year, value FROM c WHERE (doc, metric) IN (SELECT (doc, metric) FROM c GROUP BY doc, metric HAVING count(*) = count(DISTINCT value))")
def usable_rows(spark, d):
    rows = metrics(spark, d).withColumn("corroborated", F.col("value") >= 10).withColumn("unit", F.when(F.col("metric") != "P", "x"))
    return S.usable(rows).select("doc", "metric", "year", "value")


@query("conflicting_items", "SELECT o_custkey AS cust, o_orderpriority AS priority, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS truths FROM orders GROUP BY 1, 2 HAVING count(DISTINCT o_orderstatus) > 1")
def conflicting_items(spark, d):
    items = table(spark, d, "orders").select(F.col("o_custkey").alias("cust"), F.col("o_orderpriority").alias("priority"), "o_orderstatus")
    return S.conflicting(items, ["cust", "priority"], "o_orderstatus").withColumn("truths", F.array_join("truths", ","))


@query("merge_eval_sets", "SELECT text, 'new' AS origin FROM (SELECT DISTINCT text FROM conversations WHERE role = 'user') UNION ALL SELECT text, 'old' FROM benchmark WHERE text NOT IN (SELECT text FROM conversations WHERE role = 'user')")
def merge_eval_sets(spark, d):
    new = table(spark, d, "conversations").where("role = 'user'").select("text").distinct().withColumn("origin", F.lit("new"))
    return S.merge(new, table(spark, d, "benchmark").select("text", F.lit("old").alias("origin")), "text")


FULL = Fixture(
    "doc string, code string, metric string, year int, value double, raw string, unit string, page int, heading string",
    [("甲公司", "600001", m, y, v, r, "元", p, "主要会计数据") for m, y, v, r, p in (("总资产", 2023, 100.0, "100", 6), ("总资产", 2024, 125.0, "125", 7), ("总资产", 2025, 150.0, "150", 6), ("营业收入", 2025, 30.5, "30.5", 6), ("营业收入", 2023, 20.0, "20", 6), ("利润总额", 2024, 0.0, "0", 6), ("利润总额", 2025, 9.0, "9", 6))] + [("乙公司", "000002", "总资产", 2024, 50.0, "50", "万元", 3, "摘要")],
)
BOTH = Fixture("doc string, code string, metric string, year int, unit string, whole double, parent double, whole_raw string, parent_raw string, page int, page_end int", [("甲公司", "600001", "净利润", 2025, "元", 10.0, 7.0, "10", "7", 64, 66), ("乙公司", "000002", "净利润", 2024, "元", 5.0, 4.0, "5", "4", 30, None)])
_FIELDS = "question, category, difficulty, ground_truth, numeric_value, unit, metric_name, array_to_string(expected_doc_keys, ',') AS expected_doc_keys, array_to_string(expected_pages, ',') AS expected_pages, source, verified, note"


@query(
    "full_items",
    f"""WITH {FULL.sql('r')}, {BOTH.sql('s')}, l AS (SELECT *, max(year) OVER (PARTITION BY code) AS doc_year FROM r),
w AS (SELECT *, lag(value) OVER x AS bv, lag(raw) OVER x AS br, lag(page) OVER x AS bp, lag(year) OVER x AS b_y, row_number() OVER (PARTITION BY code, metric ORDER BY year DESC) AS n FROM l WINDOW x AS (PARTITION BY code, metric ORDER BY year)),
m AS (SELECT *, round((value - bv) / abs(bv) * 100, 2) AS pct FROM w WHERE n = 1 AND bv IS NOT NULL AND bv <> 0),
z AS (SELECT *, '合并' AS sc, whole AS v, whole_raw AS raw, parent_raw AS other FROM s UNION ALL SELECT *, '母公司', parent, parent_raw, whole_raw FROM s),
i AS (SELECT doc || year || '年' || metric || '是多少？' AS question, 'table' AS category, '单表直读' AS difficulty, raw || unit AS ground_truth, value AS numeric_value, unit, metric AS metric_name, [code || '_' || doc_year || '_annual'] AS expected_doc_keys, [page] AS expected_pages, 'auto_extracted' AS source, true AS verified, heading || ' 第' || page || '页，列头年份 ' || year AS note FROM l
UNION ALL SELECT doc || year || '年' || metric || '比' || b_y || '年变化了百分之多少？', 'multihop', '跨列计算', '约' || pct || '%', pct, '%', metric || '同比', [code || '_' || doc_year || '_annual'], list_sort(list_distinct([page, bp])), 'auto_extracted', true, '(' || raw || ' - ' || br || ') / ' || br || ' = ' || pct || '%' FROM m
UNION ALL SELECT doc || year || '年' || sc || '报表口径的' || metric || '是多少？', 'scope', '口径辨析', raw || unit, v, unit, sc || metric, [code || '_' || year || '_annual'], range(page, greatest(page, coalesce(page_end, 0)) + 1), 'auto_extracted', true, '第' || page || '页；另一口径为 ' || other || '，两者不可混用' FROM z)
SELECT {_FIELDS} FROM i""",
)
def full_items(spark, d):
    """Items with their twelve fields; caps are beyond what there is here (see draw_items)."""
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return S.full_items(FULL.df(spark), BOTH.df(spark)).withColumn("expected_doc_keys", join("expected_doc_keys")).withColumn("expected_pages", join("expected_pages")).drop("doc")


OUTSIDE = Fixture("company string, what string", [("甲公司", "2025年的营业收入"), ("丙公司", "2025年的净利润"), ("丁公司", "2025年的研发投入")])


@query("refuse_items", f"WITH {OUTSIDE.sql('o')}, {FULL.sql('r')} SELECT company || what || '是多少？' AS question, 'refuse' AS category, '（应拒答）' AS ground_truth, 'manual' AS source, company || ' 不在已入库语料中，应明确说明未收录' AS note FROM o WHERE company NOT IN (SELECT doc FROM r)")
def refuse_items(spark, d):
    return S.refuse_items(OUTSIDE.df(spark), FULL.df(spark).select(F.col("doc").alias("name"))).select("question", "category", "ground_truth", "source", "note")


@query("draw_items", "SELECT doc_id, lang, category FROM (SELECT doc_id, lang, source AS category, row_number() OVER (PARTITION BY lang, source ORDER BY md5('42-' || doc_id), doc_id) AS r FROM documents) WHERE r <= CASE category WHEN 'src0' THEN 12 WHEN 'src1' THEN 4 ELSE 2147483647 END")
def draw_items(spark, d):
    """Languages stand for companies, sources for categories: two of these have a cap, the others stay whole."""
    items = table(spark, d, "documents").select("doc_id", "lang", F.col("source").alias("category"))
    return S.draw(items, {"src0": 12, "src1": 4}, "lang", "doc_id")


@query("item_subset", "SELECT doc_id FROM documents WHERE lang = 'de' ORDER BY doc_id LIMIT 25")
def item_subset(spark, d):
    """A category and a limit are the operator."""
    return S.subset(table(spark, d, "documents").select("doc_id", F.col("lang").alias("category")), "de", 25, "doc_id").select("doc_id")


@query("sample_items", "SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5('42-' || doc_id)) AS r FROM documents) WHERE r <= 12")
def sample_items(spark, d):
    """A seeded sample of twelve a group is the operator."""
    return S.sample(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 12)


SHEETS = Fixture(
    "id int, lines array<string>",
    [
        (1, ["| 主要会计数据 | 2025年 | 2024年 | 本期比上年同期增减(%) | 2023年 |", "| --- | --- | --- | --- | --- |", "| 营业收入（元） | 4,321,098,765.40 | 4,000,111,222.33 | 8.02 | 3,777,666,555.44 |", "| 无关 | 1 | 2 | 3 | 4 |"]),
        (2, ["|  |  | 2025 年 |  | 2024 年 | 2023 年 |", "|  | 总资产（千元） |  | 345,678,901 | 14.96 | 400,000,000 | 350,000,000 |"]),
        (3, ["| 项目 | 2025年 | 2024年 |", "|  |  | 调整后 | 调整前 |", "| 利润总额 | 1,000 | 900 | 890 |"]),
        (4, ["| 项目 | 本期 | 上期 |", "| 营业收入 | 1,000 | 900 |"]),
    ],
)
_CELLS = r"list_filter(list_transform(string_split(regexp_replace(regexp_replace(trim(l), '^\|+', ''), '\|+$', ''), '|'), lambda c: trim(c)), lambda c: c <> '')"


@query(
    "extract_metrics",
    f"""WITH {SHEETS.sql('s')}, ln AS (SELECT id, unnest(lines) AS l, generate_subscripts(lines, 1) AS k FROM s), c AS (SELECT id, k, l, {_CELLS} AS cells FROM ln),
hd AS (SELECT id, arg_min(cells, k) AS hc FROM c WHERE regexp_matches(l, '{YEAR}') AND len(list_filter(cells, lambda x: regexp_matches(x, '{S.GROUPED}'))) = 0 GROUP BY 1),
h1 AS (SELECT id, hc[list_position(list_transform(hc, lambda x: regexp_matches(x, '{YEAR}')), true):] AS v FROM hd),
h2 AS (SELECT id, list_transform(v, lambda x: CASE WHEN regexp_matches(x, '{YEAR}') AND NOT regexp_matches(x, '增减|增长|变动|幅度|%|％') THEN CAST(regexp_extract(x, '{YEAR}', 1) AS INT) END) AS cols FROM h1),
h AS (SELECT id, cols, list_filter(cols, lambda y: y IS NOT NULL) AS years FROM h2),
rs AS (SELECT id, bool_or(regexp_matches(l, '{S.RESTATED}')) AS restated FROM ln GROUP BY 1),
r AS (SELECT c.id, trim(regexp_replace(cells[1], '{S.NAME_SUFFIX}', '')) AS metric, cells[2:] AS vs, cols, years, restated FROM c JOIN h ON h.id = c.id JOIN rs ON rs.id = c.id WHERE len(cells) >= 2 AND len(years) > 0),
w AS (SELECT *, list_filter(vs, lambda x: regexp_matches(replace(x, ' ', ''), '{S.GROUPED}')) AS gr FROM r WHERE metric IN ({', '.join(f"'{x}'" for x in S.WANTED)})),
mo AS (SELECT *, CASE WHEN len(vs) = len(cols) THEN 'exact' WHEN len(gr) = len(years) THEN 'shape' WHEN restated THEN 'leftmost' END AS mode FROM w),
p AS (SELECT id, metric, mode, unnest(CASE mode WHEN 'exact' THEN cols WHEN 'shape' THEN years ELSE years[1:1] END) AS year, unnest(CASE mode WHEN 'exact' THEN vs WHEN 'shape' THEN gr ELSE vs[1:1] END) AS raw FROM mo WHERE mode IS NOT NULL)
SELECT id, metric, year, raw, mode FROM p WHERE year IS NOT NULL AND regexp_matches(replace(raw, ' ', ''), '^[-－(（]?[0-9,，]+(\\.[0-9]+)?[)）%]?$')""",
)
def extract_metrics(spark, d):
    return S.extract_metrics(SHEETS.df(spark))


CLAIMS = Fixture("id int, doc string, first int, last int, raw string", [(1, "a", 64, 66, "1,234.50"), (2, "a", 64, 0, "1,234.50"), (3, "a", 1, 2, "999"), (4, "b", 64, 66, "1,234.50"), (5, "a", 65, 65, "77")])
SEEN = Fixture("doc string, page int, text string", [("a", 64, "合并现金流量表"), ("a", 65, "经营活动 1234.50 元"), ("a", 1, "无"), ("b", 70, "1,234.50"), ("a", 66, "77")])


@query("corroborate", f"WITH {CLAIMS.sql('c')}, {SEEN.sql('s')} SELECT c.id, coalesce(bool_or(contains(text, raw) OR contains(replace(text, ',', ''), replace(raw, ',', ''))), false) AS corroborated FROM c LEFT JOIN s ON s.doc = c.doc AND s.page BETWEEN c.first AND greatest(c.first, c.last) GROUP BY 1")
def corroborate(spark, d):
    return S.corroborated(CLAIMS.df(spark), SEEN.df(spark))


SCOPES = Fixture(
    "doc string, metric string, year int, scope string, value double, unit string, corroborated boolean",
    [("茅台", "现金流", 2025, "合并", 615.0, "亿元", True), ("茅台", "现金流", 2025, "母公司", 326.0, "亿元", True), ("茅台", "总资产", 2025, "合并", 100.0, "亿元", True), ("茅台", "总资产", 2025, "母公司", 98.0, "亿元", True), ("格力", "净利润", 2025, "合并", 10.0, "亿元", True), ("格力", "净利润", 2025, "母公司", 5.0, "万元", True), ("格力", "营收", 2025, "合并", 10.0, "亿元", False), ("格力", "营收", 2025, "母公司", 5.0, "亿元", True)],
)
PAIRS = "pr AS (SELECT a.doc, a.metric, a.year, a.unit, a.value AS whole, b.value AS parent FROM s a JOIN s b USING (doc, metric, year, unit) WHERE a.scope = '合并' AND b.scope = '母公司' AND a.corroborated AND b.corroborated AND abs(a.value - b.value) >= 0.05::DOUBLE * greatest(abs(a.value), abs(b.value)))"


@query("scope_pairs", f"WITH {SCOPES.sql('s')}, {PAIRS} SELECT * FROM pr")
def scope_pairs(spark, d):
    return S.scope_pairs(SCOPES.df(spark))


@query(
    "generate_items",
    f"""WITH {SCOPES.sql('s')}, {PAIRS}, {METRICS}, l AS (SELECT *, lag(value) OVER w AS b, year - lag(year) OVER w AS g FROM m WINDOW w AS (PARTITION BY doc, metric ORDER BY year))
SELECT 'table' AS category, doc || year || '年' || metric || '是多少？' AS question, value, 'x' AS unit FROM m
UNION ALL SELECT 'multihop', doc || year || '年' || metric || '同比变动百分之多少？', round((value - b) / abs(b) * 100, 2), '%' FROM l WHERE g = 1 AND b <> 0
UNION ALL SELECT 'scope', doc || year || '年合并口径的' || metric || '是多少？', whole, unit FROM pr UNION ALL SELECT 'scope', doc || year || '年母公司口径的' || metric || '是多少？', parent, unit FROM pr""",
)
def generate_items(spark, d):
    rows = metrics(spark, d)
    return S.questions(rows.withColumn("unit", F.lit("x")), S.year_over_year(rows), S.scope_pairs(SCOPES.df(spark)))
