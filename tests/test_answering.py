import pytest
from pyspark.sql import functions as F

from filigree import schema
from filigree.operators import answering, layout, providers
from filigree.operators.tables import numeric_columns
from filigree.plans import tables as P


def test_batch_of_questions(spark):
    corpus = spark.createDataFrame([("600519", "贵州茅台", 2025), ("300750", "宁德时代", 2025)], "code string, name string, year int")
    chunks = spark.createDataFrame([(1, "标题\n2024年 revenue 1,000", "600519", 2025), (2, "revenue of another", "300750", 2025), (3, "old revenue", "600519", 2020)], "id long, text string, company_code string, report_year int")
    asked = spark.createDataFrame([(1, "贵州茅台2024年 revenue"), (2, ""), (3, "nothing matches zzz"), (4, "宁德时代 revenue")], "id int, question string")
    got = {r.id: r for r in answering.answers(asked, chunks, corpus).collect()}
    assert got[1].answer == "2024年 revenue 1,000[1]" and got[1].citations == [1] and got[1].verdict == "generate"
    assert got[2].verdict == got[3].verdict == "refuse" and got[3].answer == answering.NOT_FOUND
    assert got[4].citations == [2]


def test_years_are_dropped_once_if_nothing_is_found(spark):
    corpus = spark.createDataFrame([("600519", "贵州茅台", 2024)], "code string, name string, year int")
    chunks = spark.createDataFrame([(1, "revenue", "600519", 2020)], "id long, text string, company_code string, report_year int")
    row = answering.answers(spark.createDataFrame([(1, "贵州茅台2024年 revenue")], "id int, question string"), chunks, corpus).first()
    assert row.verdict == "retry_generate" and row.citations == [1]


def test_filters_come_before_the_ranking(spark):
    """Any number of better chunks of other companies and years do not push out a question's own."""
    corpus = spark.createDataFrame([("600519", "贵州茅台", 2025), ("300750", "宁德时代", 2025)], "code string, name string, year int")
    others = [(k, "2024年 revenue", "300750", 2025) for k in range(100, 140)] + [(k, "2024年 revenue", "600519", 2020) for k in range(200, 240)] + [(k, "something else", "300750", 2025) for k in range(300, 500)]
    chunks = spark.createDataFrame([(1, "revenue among many other words of a longer text", "600519", 2025), *others], "id long, text string, company_code string, report_year int")
    row = answering.answers(spark.createDataFrame([(1, "贵州茅台2024年 revenue")], "id int, question string"), chunks, corpus, top_n=1).first()
    assert (row.verdict, row.citations) == ("generate", [1])


def scripted(*turns):
    left = list(turns)
    return lambda messages, may_call: left.pop(0) if left else answering.Turn("done")


def test_agent_limits_and_answers():
    call = answering.Turn(calls=[("add", {"a": 1})])
    out = answering.agent("q", scripted(call, answering.Turn("2")), {"add": lambda a: str(a + 1)})
    assert (out.answer, out.steps, out.degraded, out.pad) == ("2", 1, [], [("add", {"a": 1}, "2")])
    out = answering.agent("q", scripted(*[call] * 20), {"add": lambda a: "x"}, steps=3)
    assert out.degraded[0] == "agent_forced_answer:max_steps" and out.steps == 3 and out.answer == answering.NOT_FOUND
    out = answering.agent("q", scripted(*[answering.Turn(calls=[("none", {})])] * 3, answering.Turn("ok")), {})
    assert out.answer == "ok" and out.degraded == ["agent_forced_answer:max_errors"]
    out = answering.agent("q", scripted(answering.Turn(calls=[("add", {"a": 1})], cost=0.2), answering.Turn("")), {"add": lambda a: "x"})
    assert out.degraded == ["agent_forced_answer:max_cost", "agent_empty_answer"]


def test_excerpts_and_reports():
    text = answering.excerpt([{"page_start": 3, "unit": "元", "heading_path": "h", "content": "x" * 2000}] * 8)
    assert text.count("[第3页（单位：元） h]") == 6 and text.count("x") == 6 * 1200
    assert answering.report([{"category": "a", "right": 0.5}], {"p95": 3}, {}).startswith("| category | right |\n| --- | --- |\n| a | 50.0% |")


def test_embedding_retries_and_batches(spark):
    seen, waits = [], []

    def flaky(texts):
        seen.append(len(texts))
        if len(seen) < 3:
            raise ConnectionError
        return [[1.0]] * len(texts)

    assert providers.with_retries(flaky, ["a", "b"], wait=waits.append) == [[1.0], [1.0]] and waits == [1, 2]
    with pytest.raises(ZeroDivisionError):
        providers.with_retries(lambda t: [1 / 0], ["a"], wait=waits.append)
    chunks = spark.createDataFrame([(str(k), f"text {k}") for k in range(25)], "chunk_uid string, content string")
    rows = providers.embed(chunks, providers.hashed_embedding(8)).collect()
    assert len(rows) == 25 and all(abs(sum(x * x for x in r.v) - 1) < 1e-6 for r in rows)
    df = spark.createDataFrame([("strong", 1000, 500), ("none", 1, 1)], "p string, i int, o int")
    assert [r.c for r in df.select(providers.cost(F.col("p"), F.col("i"), F.col("o")).alias("c")).collect()] == [0.0018, None]


def test_fingerprints_follow_code_and_settings(tmp_path):
    a = tmp_path / "a.py"
    a.write_text("x")
    one = providers.pipeline_fingerprint([str(a)], {"size": 512}, "m:64")
    assert len(one) == 16 and one == providers.pipeline_fingerprint([str(a)], {"size": 512}, "m:64") != providers.pipeline_fingerprint([str(a)], {"size": 256}, "m:64")
    other = providers.answer_fingerprint(one, [str(a)], {"k": 1})
    a.write_text("y")
    assert len(other) == 12 and other != providers.answer_fingerprint(one, [str(a)], {"k": 1})


def test_layout(spark):
    words = P.WORDS.df(spark)
    assert [tuple(r) for r in layout.numeric_band(words, least=6).collect()] == [(1, 100.5, 150.0)]
    head = spark.createDataFrame([(1, 105.0, 80.0, 140.0, 90.0, "2025年"), (1, 205.0, 80.0, 240.0, 90.0, "2024年"), (1, 10.0, 80.0, 40.0, 90.0, "项目")], words.schema)
    tops = spark.createDataFrame([(1, 100.0)], "page int, top double")
    assert {r.col: r.text for r in layout.header_from_above(head, numeric_columns(words), tops).collect()} == {0: "项目", 1: "2025年", 2: "2024年"}
    merged = [["a", "1,000 2,000"]] * 3
    pick = layout.choose_table(spark.createDataFrame([(1, "ruled", merged), (1, "words", [["a", "1,000"]]), (2, "text", [["b"]]), (2, "words", [["c"]])], "page int, tier string, rows array<array<string>>"))
    assert {(r.page, r.tier) for r in pick.collect()} == {(1, "words"), (2, "text")}
    blocks = spark.createDataFrame([("d", 1, 1, 0.0, 0.0, 9.0, 9.0, "long enough text"), ("d", 1, 2, 0.0, 20.0, 9.0, 29.0, "inside the table"), ("d", 1, 3, 0.0, 40.0, 9.0, 49.0, "short"), ("d", 1, 4, 0.0, 50.0, 9.0, 59.0, "contents........ 12")], "doc string, page int, seq int, x0 double, y0 double, x1 double, y1 double, text string")
    rects = spark.createDataFrame([(1, 0.0, 15.0, 9.0, 35.0)], "page int, x0 double, y0 double, x1 double, y1 double")
    assert [r.seq for r in layout.text_blocks(blocks, rects).collect()] == [1]
    assert [r.n for r in layout.reading_order(blocks).orderBy("seq").collect()] == [1, 2, 3, 4]


def test_schema_and_violations(spark):
    schema.create(spark, "filigree_test", drop=True)
    schema.create(spark, "filigree_test")
    assert {r.tableName for r in spark.sql("show tables in filigree_test").collect()} == set(schema.TABLES)
    rows = spark.createDataFrame([("a", "ready"), ("a", "ready"), (None, "ready"), ("b", "odd")], "doc_key string, status string")
    assert sorted(r.rule for r in schema.violations("documents", rows).collect()) == ["null doc_key", "repeated key", "value of status"]
    spark.sql("drop database filigree_test cascade")
