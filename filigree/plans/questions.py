"""Question-side queries: literal questions and companies, as the rules are about Chinese wording; caches over `embeddings`
and `conversations`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import answering
from ..operators import questions as Q
from .catalogue import query, table
from .fixture import Fixture

CORPUS = Fixture(
    "code string, name string, year int",
    [("600519", "贵州茅台", 2025), ("600519", "贵州茅台", 2024), ("300750", "宁德时代新能源科技股份有限公司", 2025), ("600036", "招商银行", 2025), ("000001", "平安银行", 2025), ("601318", "中国平安", 2025), ("600900", "长江电力", 2024), ("600276", "恒瑞医药", 2025)],
)
ASKED = Fixture(
    "id int, question string, history string, codes array<string>, names array<string>, years array<int>",
    [
        (1, "贵州茅台2023年营业收入是多少？", "", ["600900"], ["贵州茅台"], [2023]),
        (2, "海天味业2025年营业收入", "", [], ["海康威视"], [2025]),
        (3, "它去年的净利润呢", "宁德时代2025年净利润是多少", [], ["宁德时代"], []),
        (4, "600036的银行业务收入", "", ["600036"], [], []),
        (5, "招商银行与茅台2024年、2025年总资产对比", "", [], ["招商银行", "茅台"], [2024, 2025]),
        (6, "  ", "", [], [], []),
        (7, "平安2025年净利润", "", [], ["平安"], [2025]),
        (8, "恒瑞2019年研发投入和销售费用是多少", "", [], ["恒瑞医药股份有限公司"], [2019]),
        (9, "问" * 501, "", [], [], []),
    ],
)
NAMES = Fixture("id int, name string", [(1, "600519_贵州茅台_贵州茅台2025年年度报告.pdf"), (2, "random.pdf"), (3, "../../etc/passwd"), (4, "C:\\x\\300750_宁德时代_2024 年报.pdf"), (5, ".hidden"), (6, "a/b/"), (7, "000001_平安银行_关于2023年年度报告.pdf")])
TITLES = Fixture("id int, title string", [(1, "2025年年度报告"), (2, "2025年年度报告摘要"), (3, "2025年年度报告（英文版）"), (4, "关于2025年年度报告的更正公告"), (5, "2025年半年度报告"), (6, "第一季度报告")])

_BASE = f"trim(regexp_replace(name, '{Q.CORPORATE}', '', 'g'))"
ALIASES = f"""al0 AS (SELECT DISTINCT code, unnest(list_concat([name, {_BASE}], CASE WHEN length({_BASE}) >= 4 THEN [right({_BASE}, 2), left({_BASE}, 2)] ELSE [] END)) AS alias FROM corpus WHERE name <> ''),
al AS (SELECT * FROM al0 WHERE length(alias) >= 2 AND alias NOT IN ({', '.join(f"'{g}'" for g in Q.GENERIC)})),
own AS (SELECT alias, min(code) AS code FROM al GROUP BY 1 HAVING count(*) = 1)"""
STRIP = r"regexp_replace({0}, '^[\s 　]+|[\s 　]+$', '', 'g')"
METRICS = "list_sort(list_filter([{}], lambda w: contains(question, w)))".format(", ".join(f"'{w}'" for w in Q.METRIC_WORDS))
ENTITY = f"'c=' || array_to_string(list_sort(codes), ',') || '|y=' || array_to_string(list_sort(list_transform(years, lambda y: CAST(y AS VARCHAR))), ',') || '|m=' || array_to_string({METRICS}, ',')"


@query("infer_meta", f"WITH {NAMES.sql('n')} SELECT id, nullif(regexp_extract(name, '{Q.FILE_NAME}', 1), '') AS code, nullif(regexp_extract(name, '{Q.FILE_NAME}', 2), '') AS company, TRY_CAST(regexp_extract(name, '{Q.FILE_NAME}', 3) AS INTEGER) AS year FROM n")
def infer_meta(spark, d):
    return NAMES.df(spark).select("id", Q.file_meta(F.col("name")).alias("m")).select("id", "m.code", "m.company", "m.year")


@query("pick_reports", f"WITH {TITLES.sql('t')} SELECT id, title FROM t WHERE contains(title, '年度报告') AND NOT regexp_matches(title, '{Q.SKIPPED_TITLES}')")
def pick_reports(spark, d):
    return TITLES.df(spark).where(Q.wanted_report(F.col("title")))


@query("sanitize_filename", f"WITH {NAMES.sql('n')}, b AS (SELECT id, trim(regexp_replace(name, '^.*[/\\\\]', '')) AS s FROM n) SELECT id, CASE WHEN s <> '' AND NOT starts_with(s, '.') THEN s END AS safe FROM b")
def sanitize_filename(spark, d):
    return NAMES.df(spark).select("id", Q.sanitized(F.col("name")).alias("safe"))


@query("guard_in", f"WITH {ASKED.sql('a')}, s AS (SELECT id, {STRIP.format('question')} AS question FROM a) SELECT id, question, question = '' OR length(question) > 500 AS refused FROM s")
def guard_in(spark, d):
    return ASKED.df(spark).select("id", Q.guard(F.col("question")).alias("g")).select("id", "g.question", "g.refused")


@query("expand_report_years", f"WITH {ASKED.sql('a')}, y AS (SELECT DISTINCT id, unnest(range(y, y + 3)) AS year FROM (SELECT id, unnest(years) AS y FROM a)) SELECT id, string_agg(year, ',' ORDER BY year) AS years FROM y GROUP BY 1")
def expand_report_years(spark, d):
    shown = F.array_join(F.transform(Q.report_years(F.col("years")), lambda y: y.cast("string")), ",")
    return ASKED.df(spark).where("size(years) > 0").select("id", shown.alias("years"))


FILED = Fixture("id int, years array<int>, filed array<int>", [(1, [2023], [2025, 2024]), (2, [2024, 2025], [2025]), (3, [2025], [2025]), (4, [], [2025]), (5, [2023], []), (6, [2026], [2025])])


@query("needs_summary", f"WITH {FILED.sql('f')} SELECT id, len(years) > 0 AND len(filed) > 0 AND coalesce(list_min(years) <= list_max(filed) - 1, false) AS needs FROM f")
def needs_summary(spark, d):
    return FILED.df(spark).select("id", Q.needs_summary(F.col("years"), F.col("filed")).alias("needs"))


@query("company_aliases", f"WITH {CORPUS.sql('corpus')}, {ALIASES} SELECT DISTINCT code, alias FROM al")
def company_aliases(spark, d):
    return CORPUS.df(spark).select("code", F.explode(Q.aliases(F.col("name"))).alias("alias")).distinct()


@query("unambiguous_aliases", f"WITH {CORPUS.sql('corpus')}, {ALIASES} SELECT alias, code FROM own")
def unambiguous_aliases(spark, d):
    return Q.own_aliases(CORPUS.df(spark))


CODES_OF = "regexp_extract_all(hay, '(?:^|[^0-9])([0-9]{6})(?:$|[^0-9])', 1)"


@query(
    "resolve_companies",
    f"""WITH {CORPUS.sql('corpus')}, {ALIASES}, {ASKED.sql('a')}, h AS (SELECT *, question || ' ' || history AS hay FROM a), w AS (SELECT *, {CODES_OF} AS written FROM h),
c1 AS (SELECT id, hay, written, unnest(codes) AS code FROM w), n AS (SELECT id, hay, written, trim(unnest(names)) AS name FROM w),
near AS (SELECT n.id, n.hay, n.written, own.code, row_number() OVER (PARTITION BY n.id, n.name ORDER BY n.name <> own.alias, length(own.alias) DESC, own.alias) AS r FROM n JOIN own ON contains(n.name, own.alias) OR contains(own.alias, n.name) WHERE n.name <> '' AND n.name NOT IN (SELECT code FROM corpus)),
f AS (SELECT id, hay, written, code FROM c1 WHERE list_contains(written, code) AND code IN (SELECT code FROM corpus) UNION SELECT id, hay, written, name FROM n WHERE name IN (SELECT code FROM corpus) UNION SELECT id, hay, written, code FROM near WHERE r = 1),
g AS (SELECT DISTINCT f.id, f.code FROM f LEFT JOIN own ON own.code = f.code AND contains(f.hay, own.alias) WHERE own.code IS NOT NULL OR list_contains(f.written, f.code))
SELECT a.id, coalesce(string_agg(g.code, ',' ORDER BY g.code), '') AS codes FROM a LEFT JOIN g ON g.id = a.id GROUP BY 1""",
)
def resolve_companies(spark, d):
    return Q.resolve(ASKED.df(spark), CORPUS.df(spark).select("code", "name")).withColumn("codes", F.array_join("codes", ","))


RULES = f"""h AS (SELECT *, question AS hay FROM a), c AS (SELECT DISTINCT id, code FROM (SELECT id, unnest({CODES_OF}) AS code FROM h) WHERE code IN (SELECT code FROM corpus) UNION SELECT a.id, own.code FROM a JOIN own ON contains(question, alias)),
y AS (SELECT DISTINCT id, CAST(y AS INT) AS year FROM (SELECT id, unnest(regexp_extract_all(question, '{Q.YEAR}', 1)) AS y FROM a) WHERE CAST(y AS INT) IN (SELECT unnest(range(year - 2, year + 1)) FROM corpus)),
ru AS (SELECT a.id, a.question, coalesce((SELECT list(code ORDER BY code) FROM c WHERE c.id = a.id), []) AS codes, coalesce((SELECT list(year ORDER BY year) FROM y WHERE y.id = a.id), []) AS years FROM a)"""


@query("rule_analysis", f"WITH {CORPUS.sql('corpus')}, {ALIASES}, {ASKED.sql('a')}, {RULES} SELECT id, array_to_string(codes, ',') AS codes, array_to_string(years, ',') AS years, CASE WHEN len(codes) > 1 OR len(years) > 1 OR regexp_matches(question, '对比|比较|增长|同比|差') THEN 'agent' ELSE 'rag' END AS route, CASE WHEN len(codes) > 0 THEN 0.5::DOUBLE ELSE 0.3::DOUBLE END AS confidence FROM ru")
def rule_analysis(spark, d):
    out = Q.rule_analysis(ASKED.df(spark).select("id", "question"), CORPUS.df(spark))
    return out.withColumn("codes", F.array_join("codes", ",")).withColumn("years", F.array_join(F.transform("years", lambda y: y.cast("string")), ","))


ROUTED = Fixture("id int, route string, confidence double, names array<string>, codes array<string>", [(1, "rag", 0.9, ["a"], ["1"]), (2, "rag", 0.6, ["a"], ["1"]), (3, "chat", 0.2, [], []), (4, "rag", 0.9, ["x"], []), (5, "agent", 0.7, [], [])])


@query("route", f"WITH {ROUTED.sql('r')} SELECT id, CASE WHEN len(names) > 0 AND len(codes) = 0 THEN 'refuse' WHEN confidence < 0.7 AND route <> 'chat' THEN 'agent' ELSE route END AS route FROM r")
def route(spark, d):
    c = [F.col(x) for x in ("route", "confidence", "names", "codes")]
    return ROUTED.df(spark).select("id", Q.route(*c).alias("route"))


_FILLED = "q"
for _w in Q.FILLERS:
    _FILLED = f"replace({_FILLED}, '{_w}', ' ')"


@query(
    "keyword_query",
    f"""WITH RECURSIVE {CORPUS.sql('corpus')}, {ALIASES}, {ASKED.sql('a')}, {RULES},
nm AS (SELECT ru.id, own.alias, row_number() OVER (PARTITION BY ru.id ORDER BY length(own.alias) DESC, own.alias) AS i FROM ru JOIN own ON list_contains(ru.codes, own.code)),
f AS (SELECT id, 0 AS i, question AS q FROM ru UNION ALL SELECT f.id, CAST(f.i + 1 AS INTEGER), replace(f.q, nm.alias, ' ') FROM f JOIN nm ON nm.id = f.id AND nm.i = f.i + 1),
l AS (SELECT id, arg_max(q, i) AS q FROM f GROUP BY 1), o AS (SELECT id, {STRIP.format(f"regexp_replace({_FILLED}, '[[:space:]]+', ' ', 'g')")} AS q FROM l)
SELECT ru.id, CASE WHEN len(codes) = 0 OR o.q = '' THEN question ELSE o.q END || CASE WHEN len(years) > 0 AND list_min(years) <= 2024 THEN ' {Q.SUMMARY_HINT}' ELSE '' END AS keywords FROM ru JOIN o ON o.id = ru.id""",
)
def keyword_query(spark, d):
    asked = ASKED.df(spark).select("id", "question")
    rules = Q.rule_analysis(asked, CORPUS.df(spark)).join(asked, "id")
    own = Q.own_aliases(CORPUS.df(spark).select("code", "name"))
    names = rules.select("id", F.explode("codes").alias("code")).join(own, "code").groupBy("id").agg(F.collect_set("alias").alias("names"))
    full = rules.join(names, "id", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    return full.select("id", Q.keyword_query(F.col("question"), F.col("names"), Q.needs_summary(F.col("years"), F.array(F.lit(2025)))).alias("keywords"))


@query("metric_words", f"WITH {ASKED.sql('a')} SELECT id, array_to_string({METRICS}, ',') AS metrics FROM a")
def metric_words(spark, d):
    return ASKED.df(spark).select("id", F.array_join(Q.metric_words(F.col("question")), ",").alias("metrics"))


@query("entity_key", f"WITH {ASKED.sql('a')} SELECT id, {ENTITY} AS entity FROM a")
def entity_key(spark, d):
    return ASKED.df(spark).select("id", Q.entity_key(F.col("codes"), F.col("years"), F.col("question")).alias("entity"))


@query("semantic_cache", "WITH c AS (SELECT a.vec_id AS id, b.vec_id AS entry, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS s FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0) SELECT id, arg_min(entry, struct_pack(s := -s, e := entry)) AS entry, round(max(s), 5) AS score FROM c GROUP BY 1 HAVING max(s) >= 0.3")
def semantic_cache(spark, d):
    """Vectors stand for cached questions and labels for entity keys; questions are those whose id is divisible by 50."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("key"), F.col("embedding").alias("v"))
    return Q.semantic_hits(v.where("id % 50 = 0"), v.withColumnRenamed("id", "entry"), 0.3).withColumn("score", F.round("score", 5))


STATES = Fixture("id int, answer string, cached boolean, refused boolean, degraded array<string>", [(1, "好", False, False, []), (2, "", False, False, []), (3, "好", True, False, []), (4, "好", False, True, []), (5, "好", False, False, ["agent_forced_answer:max_steps"]), (6, "好", False, False, ["rerank_skipped"]), (7, "长" * 5334, False, False, []), (8, None, False, False, ["agent_empty_answer"])])


@query("cache_admit", f"WITH {STATES.sql('s')} SELECT id, NOT cached AND NOT refused AND coalesce(answer, '') <> '' AND len(list_filter(degraded, lambda t: regexp_matches(t, '^({Q.NOT_CACHED})'))) = 0 AND coalesce(octet_length(encode(answer)), 0) <= 16000 AS admit FROM s")
def cache_admit(spark, d):
    return STATES.df(spark).select("id", F.coalesce(Q.may_cache(*(F.col(c) for c in ("answer", "cached", "refused", "degraded"))), F.lit(False)).alias("admit"))


CITED = Fixture("id int, answer string, n int", [(1, "营收 1 亿[1]，利润[3]。", 3), (2, "无引用", 2), (3, "越界[7][2][7]", 2), (4, "全越界[9]", 2), (5, "[1][1][2]", 5)])


@query(
    "verify_citations",
    f"""WITH RECURSIVE {CITED.sql('c')}, u AS (SELECT DISTINCT id, n, CAST(unnest(regexp_extract_all(answer, '\\[([0-9]+)\\]', 1)) AS INT) AS k FROM c),
bad AS (SELECT id, k, row_number() OVER (PARTITION BY id ORDER BY k) AS i FROM u WHERE k < 1 OR k > n),
f AS (SELECT id, 0 AS i, answer FROM c UNION ALL SELECT f.id, f.i + 1, replace(f.answer, '[' || bad.k || ']', '') FROM f JOIN bad ON bad.id = f.id AND bad.i = f.i + 1),
good AS (SELECT id, string_agg(k, ',' ORDER BY k) AS kept FROM u WHERE k BETWEEN 1 AND n GROUP BY 1)
SELECT c.id, (SELECT arg_max(answer, i) FROM f WHERE f.id = c.id) AS answer, coalesce(good.kept, array_to_string(range(1, n + 1), ',')) AS kept, (SELECT count(*) FROM bad WHERE bad.id = c.id)::INT AS invalid FROM c LEFT JOIN good ON good.id = c.id""",
)
def verify_citations(spark, d):
    v = CITED.df(spark).select("id", Q.verify_citations(F.col("answer"), F.col("n")).alias("v"))
    return v.select("id", "v.answer", F.array_join(F.transform("v.kept", lambda x: x.cast("string")), ",").alias("kept"), "v.invalid")


RUNS = Fixture("id int, steps int, errors int, cost double", [(1, 0, 0, 0.0), (2, 8, 0, 0.0), (3, 3, 3, 0.2), (4, 7, 2, 0.15), (5, 8, 3, 1.0)])


@query("agent_guardrails", f"WITH {RUNS.sql('r')} SELECT id, CASE WHEN steps >= 8 THEN 'max_steps' WHEN errors >= 3 THEN 'max_errors' WHEN cost >= 0.15::DOUBLE THEN 'max_cost' END AS forced FROM r")
def agent_guardrails(spark, d):
    return RUNS.df(spark).select("id", Q.guardrail(F.col("steps"), F.col("errors"), F.col("cost")).alias("forced"))


SAID = Fixture("id int, verdict string, answer string, citations array<long>", [(1, "generate", "营收 1 亿[1]。利润不变[2]！\n完", [7, 9]), (2, "refuse", "所提供资料中未找到相关数据。", []), (3, "retry_generate", "一句", [4]), (4, "generate", "", [])])
_EVENT = "struct_pack(event := '{0}', data := CAST(to_json(struct_pack({1} := {2})) AS VARCHAR))"


@query(
    "answer_events",
    f"""WITH {SAID.sql('s')}, e AS (SELECT id, list_concat([{', '.join(_EVENT.format('stage', 'stage', f"'{x}'") for x in ('analyse', 'retrieve', 'answer'))}],
  list_transform(list_filter(regexp_extract_all(answer, '[^。！？\n]+[。！？\n]*'), lambda x: x <> ''), lambda x: {_EVENT.format('token', 'text', 'x')}),
  CASE WHEN verdict <> 'refuse' AND len(citations) > 0 THEN [{_EVENT.format('citations', 'ids', 'citations')}] ELSE [] END, [{_EVENT.format('done', 'verdict', 'verdict')}]) AS es FROM s),
u AS (SELECT id, unnest(es) AS x, CAST(generate_subscripts(es, 1) AS INTEGER) AS seq FROM e) SELECT id, seq, x.event AS event, x.data AS data FROM u""",
)
def answer_events(spark, d):
    """What is sent to whoever asked, in order."""
    return answering.events(SAID.df(spark)).select("id", F.explode("events").alias("e")).select("id", "e.seq", "e.event", "e.data")


NUMBERS = Fixture("id int, value double", [(1, 1234567.891), (2, 999.99999), (3, 0.5), (4, -12.34567), (5, 1000.0), (6, 3.0), (7, 0.00004), (8, -98765.4)])


@query("calc_format", f"WITH {NUMBERS.sql('n')} SELECT id, CASE WHEN abs(value) >= 1000 THEN format('{{:,.2f}}', value) ELSE regexp_replace(regexp_replace(printf('%.4f', round(value, 4)), '0+$', ''), '\\.$', '') END AS shown FROM n")
def calc_format(spark, d):
    return NUMBERS.df(spark).select("id", Q.calc_format(F.col("value")).alias("shown"))


EXPRESSIONS = Fixture("id int, expression string", [(1, "(170,899,152,276.34 - 168,838,102,514.79) / 2"), (2, "round(3.14159,2)"), (3, "sum([1, 2, 3]) ** 2"), (4, "2 ** 100"), (5, "__import__('os')"), (6, "1 / 0"), (7, "max(1, sqrt(16)) % 3"), (8, "-7 // 2")])


@query("safe_eval")
def safe_eval(spark, d):
    """Rows only: SQL has no grammar for expressions in data; tests/test_questions.py has the values."""
    return EXPRESSIONS.df(spark).select("id", Q.safe_eval(F.col("expression")).alias("value"))
