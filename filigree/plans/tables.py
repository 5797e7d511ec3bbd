"""Table queries, on literal tables and lines, as the driver's text has no CJK and no grouped numbers. Folds are recursive in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import tables as O
from .catalogue import query
from .fixture import Fixture

CELLS = Fixture("id int, cell string", [(1, "归属于上市公司\n股东的净利润"), (2, "  a　b  "), (3, None), (4, "1,234 \n 567"), (5, "x\t\t y"), (6, ""), (7, "单 位")])
LINES = Fixture(
    "doc int, seq int, line string",
    [
        (1, 1, "第一节 重要提示"), (1, 2, "正文"), (1, 3, "一、公司信息"), (1, 4, "（一）基本情况"), (1, 5, "营业收入........................ 12"), (1, 6, "二、主要会计数据"), (1, 7, "正文二"), (1, 8, "第二章 管理层讨论"), (1, 9, "2.1 本集团主要会计数据"), (1, 10, "2.1.1 分部数据"), (1, 11, "2.1"),
        (2, 1, "（二）先有条目"), (2, 2, "第十节 财务报告"), (2, 3, "单位：元 币种：人民币"), (2, 4, "（人民币百万元，特别注明除外）"), (2, 5, "人民币1,234,567百万元，占总资产的43.21%"),
    ],
)
THREE_YEARS = [["会计数据一览", "2025年", "2024年", "本期比上年同期增减(%)", "2023年"], ["营业收入", "4,321,098,765.40", "4,000,111,222.33", "8.02", "3,777,666,555.44"]]
GRIDS = Fixture(
    "id int, rows array<array<string>>, above array<string>, page string, inherited string, heading string, caption string",
    [
        (1, THREE_YEARS, ["六、主要会计数据", "单位：元 币种：人民币"], "", "千元", "六、主要会计数据与指标一览", None),
        (2, [["项目", "本期发生额", "上期发生额"], ["营业收入", "1,000.00", "900.00"], ["利润", "3.5", "2.5"]], ["（人民币百万元，特别注明除外）"], "单位：万元", None, "利润表", "合并利润表"),
        (3, [["是否适用", "2025年", "2024年", "2023年"], ["是", "", "", ""]], ["□适用√不适用", "近三年 数据"], "", "元", "", None),
        (4, [["项目", "2025年12月31日", "2025年1月1日", "2024年12月31日"], ["总资产", "1,000", "900", "800"]], [], "单位：股", "元", "资产负债表", None),
        (5, [["单位：股", "", ""], ["姓名", "期初", "期末"], ["张三", "100", "200"], ["李四", "300", "400"]], ["单位：元"], "", "元", "持股", None),
        (6, [["项目（单位：万元）", "金额"], ["a", "1,234"], ["b", "120,450,780,912"]], [], "", None, "", None),
        (7, [["合计", "1"]], ["目录........ 3"], "（货币单位：人民币千元）", "元", "现金流量表", ""),
        (8, [["科目", "x"], ["210,987,654,321 12.34 187,654,321,098", "1,000 2,000"], ["甲 1,000 2,000", "3"]], [], "", "亿元", "", None),
        (9, [["主要财务数据"], ["2025 年", "2024 年", "2023 年"], ["1", "2", "3"]], [], "", None, "", None),
        (10, [["", ""], ["备查文件", "目录"]], [], "", "元", "第十节 > 备查文件目录", None),
    ],
)
UNIT_RE, CURRENCY_RE = T.UNIT, T.CURRENCY
NORM = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce({0}, ''), '[　 ]', ' ', 'g'), '\s*\n\s*', '', 'g'), '[ \t]+', ' ', 'g'), '^[\s 　]+|[\s 　]+$', '', 'g')"
FLAT = f"flat AS (SELECT id, rows, list_transform(flatten(rows), lambda c: {NORM.format('c')}) AS cs FROM g)"
IS_NUM = f"regexp_matches(replace(c, ' ', ''), '{T.NUMERIC_CELL}')"
NUMERIC = f"(len(list_filter(cs, lambda c: c <> '')) >= 4 AND len(list_filter(cs, lambda c: {IS_NUM}))::DOUBLE / greatest(len(list_filter(cs, lambda c: c <> '')), 1) >= 0.2)"


def years_of(x: str) -> str:
    return f"list_sum(list_transform({x}, lambda c: len(regexp_extract_all({NORM.format('c')}, '{T.YEAR_LABEL}'))))"


def merged(x: str) -> str:
    return f"len(list_filter({x}, lambda c: len(regexp_extract_all({NORM.format('c')}, '{T.GROUPED_NUMBER}')) >= 2))"


LABELS = f"coalesce(list_max(list_transform(rows[1:3], lambda r: {years_of('r')})), 0)"


@query("normalize_cell", f"WITH {CELLS.sql('c')} SELECT id, {NORM.format('cell')} AS cell FROM c")
def normalize_cell(spark, d):
    return CELLS.df(spark).select("id", T.normalize_cell(F.col("cell")).alias("cell"))


@query("toc_line", f"WITH {LINES.sql('l')} SELECT doc, seq, regexp_matches(line, '{T.TOC}') AS toc FROM l")
def toc_line(spark, d):
    return LINES.df(spark).select("doc", "seq", F.col("line").rlike(T.TOC).alias("toc"))


@query(
    "heading_path",
    f"""WITH {LINES.sql('l')}, k AS (SELECT *, substr(line, 1, 40) AS s, CASE WHEN regexp_matches(line, '{T.SECTION}') THEN 'section' WHEN regexp_matches(line, '{T.SUBSECTION}') THEN 'subsection' WHEN regexp_matches(line, '{T.ITEM}') THEN 'item'
  WHEN regexp_matches(line, '{T.DECIMAL_SECTION}') THEN CASE WHEN regexp_matches(line, '{T.DECIMAL_DEEP}') THEN 'item' ELSE 'subsection' END END AS kind FROM l),
n AS (SELECT *, count(*) FILTER (kind = 'section') OVER w AS ns, count(*) FILTER (kind IN ('section', 'subsection')) OVER w AS nb FROM k WINDOW w AS (PARTITION BY doc ORDER BY seq)),
p AS (SELECT doc, seq, kind, last_value(CASE WHEN kind = 'section' THEN s END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY seq) AS a,
  last_value(CASE WHEN kind = 'subsection' THEN s END IGNORE NULLS) OVER (PARTITION BY doc, ns ORDER BY seq) AS b, last_value(CASE WHEN kind = 'item' THEN s END IGNORE NULLS) OVER (PARTITION BY doc, ns, nb ORDER BY seq) AS c FROM n)
SELECT doc, seq, kind, concat_ws(' > ', a, b, c) AS path FROM p""",
)
def heading_path(spark, d):
    return O.heading_path(LINES.df(spark))


@query("is_numeric_table", f"WITH {GRIDS.sql('g')}, {FLAT} SELECT id, {NUMERIC} AS numeric FROM flat")
def is_numeric_table(spark, d):
    return GRIDS.df(spark).select("id", O.is_numeric_table(F.col("rows")).alias("numeric"))


@query(
    "statement_type",
    f"""WITH {GRIDS.sql('g')}, j AS (SELECT id, concat_ws(' ', heading, caption) AS s FROM g)
SELECT id, CASE WHEN contains(s, '资产负债表') THEN 'balance' WHEN contains(s, '现金流量表') THEN 'cashflow' WHEN regexp_matches(s, '利润表|损益|综合收益') THEN 'income' WHEN regexp_matches(s, '所有者权益变动|股东权益变动') THEN 'equity' END AS kind FROM j""",
)
def statement_type(spark, d):
    return GRIDS.df(spark).select("id", T.statement_type(F.concat_ws(" ", "heading", "caption")).alias("kind"))


_ROW = "array_to_string(list_transform(rows[{0}], lambda c: " + NORM.format("c") + "), ' ')"
INLINE = f"""il AS (SELECT id, coalesce({_ROW.format(1)}, '') AS a, coalesce({_ROW.format(2)}, '') AS b FROM g),
im AS (SELECT id, CASE WHEN regexp_matches(a, '{UNIT_RE}|{CURRENCY_RE}') THEN 1 WHEN regexp_matches(b, '{UNIT_RE}|{CURRENCY_RE}') THEN 2 ELSE 0 END AS k, a, b FROM il),
ix AS (SELECT id, k, CASE k WHEN 1 THEN a WHEN 2 THEN b ELSE '' END AS s FROM im),
inl AS (SELECT id, nullif(regexp_extract(s, '{UNIT_RE}', 1), '') AS unit, nullif(regexp_extract(s, '{CURRENCY_RE}', 1), '') AS currency,
  CASE WHEN k > 0 AND length(regexp_replace(regexp_replace(regexp_replace(s, '{CURRENCY_RE}', '', 'g'), '{UNIT_RE}', '', 'g'), '^[ |　]+|[ |　]+$', '', 'g')) < 4 THEN k ELSE 0 END AS skip FROM ix)"""


@query("inline_unit", f"WITH {GRIDS.sql('g')}, {INLINE} SELECT id, unit, currency, skip FROM inl")
def inline_unit(spark, d):
    return GRIDS.df(spark).select("id", O.inline_unit(F.col("rows")).alias("u")).select("id", "u.unit", "u.currency", "u.skip")


def _near(pattern: str) -> str:
    return f"list_filter(list_transform(list_reverse(above), lambda x: nullif(regexp_extract(x, '{pattern}', 1), '')), lambda x: x IS NOT NULL)[1]"


CASCADE = f"""st AS (SELECT g.id, inl.unit AS a, {_near(UNIT_RE)} AS b, CASE WHEN {NUMERIC} THEN {_near(T.PROSE_UNIT)} END AS c, CASE WHEN {NUMERIC} THEN nullif(regexp_extract(page, '{T.AMOUNT_UNIT}', 1), '') END AS d,
  CASE WHEN {NUMERIC} THEN nullif(regexp_extract(page, '{T.PROSE_UNIT}', 1), '') END AS e, CASE WHEN {NUMERIC} THEN inherited END AS f FROM g JOIN flat ON flat.id = g.id JOIN inl ON inl.id = g.id),
u AS (SELECT id, coalesce(a, b, c, d, e, f) AS unit, CASE WHEN a IS NOT NULL THEN 'table_inline' WHEN b IS NOT NULL THEN 'above' WHEN c IS NOT NULL THEN 'prose_above' WHEN d IS NOT NULL THEN 'page' WHEN e IS NOT NULL THEN 'prose_page' WHEN f IS NOT NULL THEN 'inherited' END AS source FROM st)"""


@query("unit_cascade", f"WITH {GRIDS.sql('g')}, {FLAT}, {INLINE}, {CASCADE} SELECT id, unit, source FROM u")
def unit_cascade(spark, d):
    return GRIDS.df(spark).select("id", O.resolve_unit(F.col("rows"), F.col("above"), F.col("page"), F.col("inherited")).alias("u")).select("id", "u.unit", "u.source")


@query("caption_pick", f"WITH {GRIDS.sql('g')} SELECT id, substr(list_filter(list_reverse(above), lambda x: NOT regexp_matches(x, '{UNIT_RE}|{CURRENCY_RE}|适用|{T.TOC}') AND length(x) >= 4)[1], 1, 60) AS caption FROM g")
def caption_pick(spark, d):
    return GRIDS.df(spark).select("id", O.caption(F.col("above")).alias("caption"))


@query("looks_tabular", f"WITH {GRIDS.sql('g')} SELECT id, len(regexp_extract_all(repeat(array_to_string(flatten(rows), ' ') || ' ', 4), '{T.GROUPED_NUMBER}')) >= 12 AS tabular FROM g")
def looks_tabular(spark, d):
    """Twelve grouped numbers or more; each page here is its table four times over."""
    return GRIDS.df(spark).select("id", (T.count_matches(F.repeat(F.concat(F.array_join(F.flatten("rows"), " "), F.lit(" ")), 4), T.GROUPED_NUMBER) >= 12).alias("tabular"))


UNITS = Fixture("id int, value double, unit string", [(1, 1.5, "元"), (2, 2.0, "千元"), (3, 3.0, "万元"), (4, 4.25, "百万元"), (5, 1476.94, "亿元"), (6, 5.0, "股"), (7, 6.0, None)])


@query("scale_to_yuan", f"WITH {UNITS.sql('u')} SELECT id, value * CASE unit WHEN '元' THEN 1 WHEN '千元' THEN 1e3 WHEN '万元' THEN 1e4 WHEN '百万元' THEN 1e6 WHEN '亿元' THEN 1e8 END AS yuan FROM u")
def scale_to_yuan(spark, d):
    return UNITS.df(spark).select("id", (F.col("value") * T.scale(F.col("unit"))).alias("yuan"))


@query(
    "year_breakdown",
    f"""WITH {GRIDS.sql('g')}, h AS (SELECT id, unnest(rows[1]) AS c, generate_subscripts(rows[1], 1) AS i FROM g),
y AS (SELECT id, i, CAST(regexp_extract(c, '{T.YEAR}', 1) AS INT) AS year FROM h WHERE regexp_matches(c, '{T.YEAR}') AND NOT regexp_matches(c, '{T.NOT_A_YEAR_COLUMN}')),
ok AS (SELECT id FROM y GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT year) = count(*)),
b AS (SELECT id, unnest(rows[2:]) AS r, generate_subscripts(rows[2:], 1) AS n FROM g WHERE id IN (SELECT id FROM ok)),
p AS (SELECT b.id, b.n, b.r, y.year, b.r[y.i] AS v FROM b JOIN y ON y.id = b.id WHERE n <= 24 AND regexp_matches(replace(coalesce(b.r[y.i], ''), ' ', ''), '{T.NUMERIC_CELL}')),
nm AS (SELECT *, list_filter(r, lambda c: c <> '')[1] AS name FROM p)
SELECT id, '【按年份】' || any_value(name) || '：' || string_agg(year || '年=' || v, '；' ORDER BY year DESC) AS line FROM nm WHERE NOT regexp_matches(name, '{T.YEAR}') GROUP BY id, n HAVING count(*) >= 2""",
)
def year_breakdown(spark, d):
    rows = F.col("rows")
    lines = O.year_breakdown(F.element_at(rows, 1), F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))))
    return GRIDS.df(spark).select("id", F.explode(lines).alias("line"))


@query(
    "table_quality",
    f"""WITH {GRIDS.sql('g')}, {FLAT} SELECT id, len(list_filter(cs, lambda c: {IS_NUM}))::INT AS numeric, {merged('flatten(rows)')}::INT AS merged,
{merged('flatten(list_transform(rows, lambda r: r[2:]))')}::INT AS merged_right, {LABELS}::INT AS labels, len(list_filter(rows, lambda r: {merged('r')} > 0))::INT AS multi FROM flat""",
)
def table_quality(spark, d):
    r = F.col("rows")
    return GRIDS.df(spark).select("id", O.numeric_cells(r).alias("numeric"), O.merged_cells(r).alias("merged"), O.merged_cells(r, True).alias("merged_right"), O.year_labels(r).alias("labels"), O.multi_value_rows(r).alias("multi"))


@query("summary_table", f"WITH {GRIDS.sql('g')} SELECT id, regexp_matches(concat_ws(' ', coalesce(heading, ''), coalesce(caption, ''), array_to_string(flatten(rows[1:2]), ' ')), '{T.SUMMARY_TITLE}') AND {LABELS} >= 2 AS summary FROM g")
def summary_table(spark, d):
    return GRIDS.df(spark).select("id", O.is_summary(F.col("heading"), F.col("caption"), F.col("rows")).alias("summary"))


_LINE = "'| ' || array_to_string({0}, ' | ') || ' |'"


@query(
    "render_table",
    f"""WITH {GRIDS.sql('g')}, {FLAT}, {INLINE}, {CASCADE},
w AS (SELECT g.id, caption, heading, u.unit, list_transform(rows, lambda r: list_transform(r, lambda c: {NORM.format('c')})) AS rs, list_max(list_transform(rows, lambda r: len(r))) AS width FROM g JOIN u ON u.id = g.id),
f AS (SELECT *, list_transform(rs, lambda r: list_concat(r, list_transform(range(width - len(r)), lambda x: ''))) AS full_ FROM w),
h AS (SELECT *, len(list_filter(full_[1], lambda c: c <> '')) = 0 AS blank FROM f),
b AS (SELECT id, caption, heading, unit, width, CASE WHEN blank THEN list_transform(range(1, width + 1), lambda i: '列' || i) ELSE full_[1] END AS header, CASE WHEN blank THEN full_ ELSE full_[2:] END AS body FROM h),
hc AS (SELECT id, unnest(header) AS c, generate_subscripts(header, 1) AS i FROM b), y AS (SELECT id, i, TRY_CAST(regexp_extract(c, '{T.YEAR}', 1) AS INT) AS year FROM hc WHERE regexp_matches(c, '{T.YEAR}') AND NOT regexp_matches(c, '{T.NOT_A_YEAR_COLUMN}')),
ok AS (SELECT id FROM y GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT year) = count(*)), br AS (SELECT id, unnest(body[1:24]) AS r, generate_subscripts(body[1:24], 1) AS n FROM b WHERE id IN (SELECT id FROM ok)),
yl AS (SELECT br.id, n, list_filter(any_value(r), lambda c: c <> '')[1] AS name, string_agg(year || '年=' || r[i], '；' ORDER BY year DESC, i DESC) AS parts, count(*) AS k FROM br JOIN y ON y.id = br.id WHERE regexp_matches(replace(coalesce(r[i], ''), ' ', ''), '{T.NUMERIC_CELL}') GROUP BY 1, 2),
ys AS (SELECT id, list('【按年份】' || name || '：' || parts ORDER BY n) AS ls FROM yl WHERE k >= 2 AND name IS NOT NULL AND NOT regexp_matches(name, '{T.YEAR}') GROUP BY 1)
SELECT b.id, array_to_string(list_concat(list_filter(['【单位：' || unit || '】', coalesce(caption, CASE WHEN coalesce(heading, '') <> '' THEN string_split(heading, ' > ')[-1] END)], lambda x: x IS NOT NULL),
  [{_LINE.format('header')}, '|' || array_to_string(list_transform(range(width), lambda x: ' --- '), '|') || '|'], list_transform(body, lambda r: {_LINE.format('r')}), CASE WHEN ls IS NULL THEN [] ELSE list_concat([''], ls) END), chr(10)) AS text FROM b LEFT JOIN ys ON ys.id = b.id""",
)
def render_table(spark, d):
    """Markdown with unit, title and years; tests/test_tables.py has some of it written out."""
    g = GRIDS.df(spark).withColumn("u", O.resolve_unit(F.col("rows"), F.col("above"), F.col("page"), F.col("inherited")))
    return g.select("id", O.render(F.col("rows"), F.col("u.unit"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("caption"), F.col("heading")).alias("text"))


PLACES = Fixture("id int, columns int, top double, bottom double, height double, source string, summary boolean", [(1, 7, 100.0, 700.0, 760.0, "above", True), (2, 3, 200.0, 300.0, 760.0, None, False), (3, 6, 149.9, 681.0, 760.0, "page", None)])


@query("table_flags", f"WITH {PLACES.sql('p')} SELECT id, concat_ws(',', CASE WHEN columns > 6 THEN 'wide' END, CASE WHEN height - bottom < 80 THEN 'bottom' END, CASE WHEN top < 150 THEN 'top' END, 'unit_src:' || source, CASE WHEN summary THEN 'summary_table' END) AS flags FROM p")
def table_flags(spark, d):
    return PLACES.df(spark).select("id", F.array_join(O.flags(F.col("columns"), F.col("top"), F.col("bottom"), F.col("height"), F.col("source"), F.col("summary")), ",").alias("flags"))


WRAPPED = Fixture(
    "id int, rows array<array<string>>",
    [
        (1, [["项目", "2025年", "2024年"], ["调整前", "调整后", "调整后", "本期"], ["投资活动产生的现金流", "-1,234,567,890.12", "2,345,678,901.23"], ["量净额（元）", "", ""], ["总资产", "1,000", "900"]]),
        (2, [["项目", "金额"], ["调整前", ""], ["a", "-"], ["说明", ""]]),
    ],
)




_VALUE = f"regexp_matches(c, '{T.VALUE_CELL}')"
_WRAPPED = f"""len(list_filter(f.last, lambda c: {_VALUE})) > 0 AND len(list_filter(o.r, lambda c: c <> '')) BETWEEN 1 AND 2 AND len(list_filter(o.r, lambda c: c <> '' AND NOT regexp_matches(c, '{T.CJK}'))) = 0
  AND len(list_filter(o.r, lambda c: {_VALUE})) = 0 AND len(list_filter(f.last, lambda c: c <> '' AND NOT {_VALUE})) > 0"""
_LABEL = f"list_position(list_transform(f.last, lambda c: c <> '' AND NOT {_VALUE}), true)"


@query(
    "merge_wrapped_labels",
    f"""WITH RECURSIVE {WRAPPED.sql('t')}, o AS (SELECT id, list_transform(unnest(rows), lambda c: {NORM.format('c')}) AS r, generate_subscripts(rows, 1) AS i FROM t),
f AS (SELECT id, i, 1 AS n, r AS last FROM o WHERE i = 1 UNION ALL SELECT o.id, o.i, f.n + CASE WHEN {_WRAPPED} THEN 0 ELSE 1 END,
  CASE WHEN {_WRAPPED} THEN list_transform(f.last, lambda c, k: CASE WHEN k = {_LABEL} THEN c || array_to_string(list_filter(o.r, lambda x: x <> ''), '') ELSE c END) ELSE o.r END FROM f JOIN o ON o.id = f.id AND o.i = f.i + 1),
z AS (SELECT id, n, arg_max(last, i) AS r FROM f GROUP BY 1, 2) SELECT id, list(r ORDER BY n) AS rows FROM z GROUP BY 1""",
)
def merge_wrapped_labels(spark, d):
    """Labels that were broken over rows; tests/test_tables.py has some of the tables written out."""
    clean = WRAPPED.df(spark).withColumn("rows", O.clean_rows(F.col("rows")))
    return clean.select("id", O.merge_wrapped_labels("rows").alias("rows"))


LONG = "【单位：元】\n| 项目 | 金额 |\n| --- | --- |\n" + "\n".join(f"| 科目{k} | {k},000 |" for k in range(60))
TEXTS = Fixture("id int, text string", [(1, LONG), (2, "| a | b |\n| --- | --- |\n| 1 | 2 |"), (3, "plain\n" * 200)])


@query(
    "split_table",
    f"""WITH RECURSIVE {TEXTS.sql('t')}, s AS (SELECT id, text, string_split(text, chr(10)) AS ls FROM t), m AS (SELECT *, coalesce(list_position(list_transform(ls, lambda x: regexp_matches(x, '^\\s*[|\\- ]*\\s*$')), true), 0) AS k FROM s),
w AS (SELECT *, length(text) <= 300 OR len(ls) < 4 OR k < 2 AS whole, array_to_string(ls[1:greatest(k, 1)], chr(10)) AS head FROM m),
b AS (SELECT id, head, greatest(300 - length(head), 150) AS budget, unnest(ls[k + 1:]) AS line, generate_subscripts(ls[k + 1:], 1) AS i FROM w WHERE NOT whole),
f AS (SELECT id, i, line, budget, head, CAST(length(line) AS BIGINT) AS held, 0 AS part FROM b WHERE i = 1
UNION ALL SELECT b.id, b.i, b.line, b.budget, b.head, CAST(CASE WHEN f.held + 1 + length(b.line) > b.budget THEN length(b.line) ELSE f.held + 1 + length(b.line) END AS BIGINT), f.part + CASE WHEN f.held + 1 + length(b.line) > b.budget THEN 1 ELSE 0 END FROM f JOIN b ON b.id = f.id AND b.i = f.i + 1)
SELECT id, CAST(part AS INTEGER) AS seq, any_value(head) || chr(10) || string_agg(line, chr(10) ORDER BY i) AS piece FROM f GROUP BY 1, 2 UNION ALL SELECT id, 0, text FROM w WHERE whole""",
)
def split_table(spark, d):
    """Whole rows, with everything down to the separator row before each piece."""
    return TEXTS.df(spark).select("id", F.posexplode(O.split_table(F.col("text"), 300)).alias("seq", "piece"))


PAGES = Fixture("doc string, page int, text string", [("a", 1, "单位：元\n单位：千元"), ("a", 2, "单位：千元"), ("a", 61, "单位：元 单位：元 单位：元"), ("b", 1, "（人民币百万元，特别注明除外）"), ("b", 2, "单位：万元"), ("c", 1, "无")])


@query(
    "dominant_unit",
    f"""WITH {PAGES.sql('p')}, e AS (SELECT doc, page, unnest(us) AS unit, generate_subscripts(us, 1) AS k FROM (SELECT doc, page, list_concat(regexp_extract_all(text, '{T.AMOUNT_UNIT}', 1), regexp_extract_all(text, '{T.PROSE_UNIT}', 1)) AS us FROM p WHERE page <= 60)),
c AS (SELECT doc, unit, count(*) AS n, min(page * 100 + k) AS f FROM e GROUP BY 1, 2) SELECT doc, unit, n FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY n DESC, f) AS r FROM c) WHERE r = 1""",
)
def dominant_unit(spark, d):
    return O.dominant_unit(PAGES.df(spark))


WORDS = Fixture(
    "page int, x0 double, y0 double, x1 double, y1 double, word string",
    [(1, x, y + dy, x + w, y + 10, t) for y, row in ((100.0, [(10.0, 60.0, "营业收入", 0.0), (100.0, 50.0, "1,234,567", 0.5), (200.0, 50.0, "2,345,678", 1.0)]), (120.0, [(10.0, 40.0, "净利润", 0.0), (110.0, 40.0, "234,567", 3.5), (210.0, 40.5, "345,678", 0.0)]), (140.0, [(10.0, 40.0, "总资产", 0.0), (101.0, 49.0, "9,234,567", 0.0), (201.0, 49.0, "8,345,678", 0.0)])) for x, w, t, dy in row]
    + [(2, 10.0, 10.0, 40.0, 20.0, "仅文字"), (2, 60.0, 10.0, 90.0, 20.0, "1,000")],
)
CLUSTERS = f"""nw AS (SELECT * FROM w WHERE regexp_matches(word, '^[-(（]?[0-9][0-9,]*\\.?[0-9]*[)）%]?$')), lg AS (SELECT *, coalesce((x1 - lag(x1) OVER (PARTITION BY page ORDER BY x1, y0, x0) > 3)::INT, 0) AS f FROM nw),
cl AS (SELECT *, sum(f) OVER (PARTITION BY page ORDER BY x1, y0, x0 ROWS UNBOUNDED PRECEDING) AS c FROM lg), nc AS (SELECT page, row_number() OVER (PARTITION BY page ORDER BY c)::INT AS col, min(x0) AS "left", max(x1) AS "right" FROM cl GROUP BY page, c HAVING count(*) >= 3)"""


@query("numeric_columns", f"WITH {WORDS.sql('w')}, {CLUSTERS} SELECT * FROM nc")
def numeric_columns(spark, d):
    return O.numeric_columns(WORDS.df(spark))


@query(
    "rebuild_table",
    f"""WITH RECURSIVE {WORDS.sql('w')}, {CLUSTERS}, pw AS (SELECT w.page, w.x0, w.y0, w.word, coalesce(min(nc.col), 0) AS col FROM w LEFT JOIN nc ON nc.page = w.page AND (w.x0 + w.x1) / 2 BETWEEN nc."left" - 3 AND nc."right" + 3 WHERE w.page IN (SELECT page FROM nc GROUP BY 1 HAVING count(*) >= 2) GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y0, x0, word, col) AS i FROM pw),
f AS (SELECT page, i, y0 AS y, 1 AS line, col, x0, word FROM o WHERE i = 1 UNION ALL SELECT o.page, o.i, CASE WHEN abs(o.y0 - f.y) > 4 THEN o.y0 ELSE f.y END, f.line + (abs(o.y0 - f.y) > 4)::INT, o.col, o.x0, o.word FROM f JOIN o ON o.page = f.page AND o.i = f.i + 1)
SELECT page, line, col, string_agg(word, ' ' ORDER BY x0, word) AS text FROM f GROUP BY 1, 2, 3""",
)
def rebuild_table(spark, d):
    words = WORDS.df(spark)
    return O.rebuild_table(words, O.numeric_columns(words))


SCOPED = Fixture(
    "doc int, seq int, page int, heading string, title string",
    [(1, 1, 64, "h1", "合并现金流量表"), (1, 2, 65, "h1", None), (1, 3, 67, "h1", "附注"), (1, 4, 69, "h1", None), (1, 5, 68, "h1", None), (1, 6, 70, "h2", "母公司利润表"), (1, 7, 71, "h3", None), (1, 8, 71, "h2", None), (2, 1, 1, "h1", None)],
)


@query(
    "scope_inheritance",
    f"""WITH RECURSIVE {SCOPED.sql('s')}, o AS (SELECT *, nullif(regexp_extract(coalesce(title, ''), '{T.STATEMENT_SCOPE}', 0), '') AS own, row_number() OVER (PARTITION BY doc ORDER BY seq) AS i FROM s),
f AS (SELECT doc, seq, i, own AS scope, CASE WHEN own IS NOT NULL THEN heading END AS heading, CASE WHEN own IS NOT NULL THEN page ELSE 0 END AS page FROM o WHERE i = 1
UNION ALL SELECT o.doc, o.seq, o.i, CASE WHEN own IS NOT NULL THEN own WHEN f.scope IS NOT NULL AND f.heading = o.heading AND o.page - f.page <= 4 THEN f.scope END,
  CASE WHEN own IS NOT NULL THEN o.heading WHEN f.scope IS NOT NULL AND f.heading = o.heading AND o.page - f.page <= 4 THEN f.heading END, CASE WHEN own IS NOT NULL THEN o.page WHEN f.scope IS NOT NULL AND f.heading = o.heading AND o.page - f.page <= 4 THEN f.page ELSE 0 END
  FROM f JOIN o ON o.doc = f.doc AND o.i = f.i + 1)
SELECT doc, seq, scope FROM f""",
)
def scope_inheritance(spark, d):
    return O.inherited_scope(SCOPED.df(spark))


_HEAD = "【单位：元】\n| 项目 | 金额 |\n| --- | --- |\n"
SHEETS = Fixture(
    "doc int, seq int, page int, columns int, rows int, text string, at_top boolean, at_bottom boolean, flags array<string>",
    [(1, 1, 5, 2, 2, _HEAD + "| 甲 | 1 |", False, True, ["bottom"]), (1, 2, 6, 2, 3, _HEAD + "| 乙 | 2 |\n| 丙 | 3 |", True, True, ["top", "bottom"]), (1, 3, 7, 2, 1, _HEAD.rstrip("\n"), True, False, ["top"]), (1, 4, 8, 2, 2, _HEAD + "| 丁 | 4 |", False, False, None), (2, 1, 1, 3, 2, "| a |", True, True, []), (2, 2, 2, 2, 2, _HEAD + "| 戊 | 5 |", True, False, ["top"])],
)


@query(
    "stitched_tables",
    f"""WITH {SHEETS.sql('p')}, l AS (SELECT *, coalesce(lag(at_bottom) OVER w AND at_top AND lag(columns) OVER w = columns AND page = lag(page) OVER w + 1, false) AS goes FROM p WINDOW w AS (PARTITION BY doc ORDER BY seq)),
c AS (SELECT *, sum((NOT goes)::INT) OVER (PARTITION BY doc ORDER BY seq) AS chain, array_to_string(string_split(text, chr(10))[4:], chr(10)) AS rest FROM l)
SELECT doc, min(seq) AS seq, min(page) AS page_start, max(page) AS page_end, arg_min(columns, seq) AS columns, CAST(sum(rows) AS INTEGER) AS rows,
array_to_string(list_concat(arg_min(coalesce(flags, []), seq), CASE WHEN count(*) > 1 THEN ['cross_page'] ELSE [] END), ',') AS flags,
string_agg(CASE WHEN goes THEN nullif(trim(rest), '') ELSE text END, chr(10) ORDER BY seq) AS text FROM c GROUP BY doc, chain""",
)
def stitched_tables(spark, d):
    """Parts on neighbouring pages become one table, with its flag."""
    return O.stitched(SHEETS.df(spark)).withColumn("flags", F.array_join("flags", ","))


PARTS = Fixture("doc int, seq int, page int, columns int, at_top boolean, at_bottom boolean", [(1, 1, 1, 3, False, True), (1, 2, 2, 3, True, True), (1, 3, 3, 3, True, False), (1, 4, 3, 3, False, True), (1, 5, 5, 3, True, False), (1, 6, 5, 4, False, True), (1, 7, 6, 3, True, False), (2, 1, 1, 2, True, False)])


@query(
    "cross_page_stitch",
    f"""WITH {PARTS.sql('p')}, l AS (SELECT *, coalesce(lag(at_bottom) OVER w AND at_top AND lag(columns) OVER w = columns AND page = lag(page) OVER w + 1, false) AS goes FROM p WINDOW w AS (PARTITION BY doc ORDER BY seq))
SELECT doc, seq, sum((NOT goes)::INT) OVER (PARTITION BY doc ORDER BY seq)::INT AS chain FROM l""",
)
def cross_page_stitch(spark, d):
    return O.stitch(PARTS.df(spark))
