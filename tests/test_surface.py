"""Assembly of chunks, the way of a search, caches, the agent's checks, registries and stores."""

import pytest
from pyspark.sql import functions as F

from filigree.operators import answering, cache, chunking, dataset, hits, ingest, providers
from filigree.operators import questions as Q
from filigree.operators import retrieval as R
from filigree.sources import readers, shared
from filigree.streaming import ingestion

TABLE = "【单位：元】\n| 项目 | 金额 |\n| --- | --- |\n" + "\n".join(f"| 科目{k} | {k},000 |" for k in range(40))


def blocks(spark, rows):
    return spark.createDataFrame(rows, chunking.BLOCK)


def test_assembly_groups_numbers_and_carries_fields(spark):
    rows = [
        ("d", 0, "text", "第一段。", "h1", 1, 1, None, None, None, []),
        ("d", 1, "text", "第二段。", "h1", 1, 2, "元", None, None, []),
        ("d", 2, "table", TABLE, "h1", 2, 3, "元", "人民币", "income", ["wide", "summary_table"]),
        ("d", 3, "text", "h1 第三段。", "h1", 3, 3, None, None, None, None),
        ("d", 4, "text", "另一节。" * 300, "h2", 4, 4, None, None, None, []),
        ("e", 0, "text", "", None, 1, 1, None, None, None, []),
        (None, 0, "text", "lost", "h", 1, 1, None, None, None, []),
    ]
    out = chunking.assemble(blocks(spark, rows), "heading", 100, 10).collect()
    parents = {r.seq: r for r in out if r.doc_key == "d" and r.level == 0}
    assert [parents[k].content.split("\n")[0] for k in sorted(parents)] == ["h1", "h1", "h1 第三段。", "h2"]
    assert parents[0].content == "h1\n第一段。\n第二段。" and (parents[0].page_start, parents[0].page_end, parents[0].unit) == (1, 2, None)
    assert (parents[1].chunk_type, parents[1].unit, parents[1].currency, parents[1].statement_type, parents[1].table_flags) == ("table_summary", "元", "人民币", "income", ["wide", "summary_table"])
    children = sorted((r for r in out if r.doc_key == "d" and r.level == 1), key=lambda r: r.seq)
    assert [r.seq for r in children] == list(range(len(children)))
    pieces = [r for r in children if r.parent_uid == parents[1].chunk_uid]
    assert len(pieces) > 1 and all("| --- | --- |" in r.content and r.content.startswith("h1\n【单位：元】") and r.chunk_type == "table_summary" for r in pieces)
    assert all(r.parent_uid == parents[3].chunk_uid for r in children[-3:]) and all(len(r.content) <= 103 for r in children if r.parent_uid == parents[3].chunk_uid)
    assert {r.chunk_uid for r in out} == {r.chunk_uid for r in chunking.assemble(blocks(spark, rows[::-1]), "heading", 100, 10).collect()}
    flat = chunking.assemble(blocks(spark, rows), "fixed", 100, 10, parent_child=False, table_atomic=False).collect()
    assert {r.level for r in flat} == {1} and {r.parent_uid for r in flat} == {None}
    assert chunking.assemble(blocks(spark, [])).count() == 0


def test_parents_keep_within_their_limit(spark):
    rows = [(1, k, "text", "h", 400) for k in range(20)] + [(1, 20, "text", "h", 5000), (1, 21, "text", "h", 10), (2, 0, "table", "h", 1)]
    got = {(r.doc, r.seq): r.parent for r in chunking.group_parents(spark.createDataFrame(rows, "doc int, seq int, kind string, heading string, chars int")).collect()}
    assert [got[1, k] for k in range(22)] == [k // 7 for k in range(20)] + [3, 4] and got[2, 0] == 0


def test_recursive_chunks_of_repeated_and_missing_ids(spark):
    df = spark.createDataFrame([(1, "一二三。" * 40), (1, "四五六。" * 40), (None, "七八九。" * 40), (2, None), (3, "")], "doc_id long, text string")
    got = chunking.chunk_recursive(df, 100, 10).collect()
    assert {r.doc_id for r in got} == {1, None} and sum(r.doc_id is None for r in got) == 2
    assert sorted(r.seq for r in got if r.doc_id == 1) == [0, 0, 1, 1]


CHUNK = "chunk_uid string, content string, doc_key string, company_code string, report_year int, period string, chunk_type string, statement_type string, unit string, heading_path string, page_start int, page_end int, parent_uid string, strategy string, level int"


def test_a_search_filters_before_it_ranks(spark):
    many = [(f"c{k}", "revenue revenue", "d", "300750", 2025, None, "text", None, None, "", 1, 1, None, "heading", 1) for k in range(10_000)]
    own = ("own", "revenue among other words", "d", "600519", 2025, None, "text", "income", "元", "h", 9, 9, "p", "heading", 1)
    parent = ("p", "the whole section", "d", "600519", 2025, None, "text", None, None, None, 8, 10, None, "heading", 0)
    chunks = spark.createDataFrame([*many, own, parent, (*own[:-2], "fixed", 1)], CHUNK)
    asked = spark.createDataFrame([(1, "revenue")], "qid long, text string")
    filters = hits.Filters(["600519"], [2024])
    assert not filters.is_empty() and hits.Filters().is_empty()
    row = hits.retrieve(asked, chunks, "heading", filters, "sparse", 1).first()
    assert (row.chunk_uid, row.content, row.expanded, row.unit, row.heading_path, row.page_start, row.page_end, row.seq) == ("p", "the whole section", True, "元", "h", 8, 10, 1)
    assert hits.retrieve(asked, chunks, "heading", hits.Filters(["600519"], [2026]), "sparse", 1).count() == 0
    assert hits.retrieve(asked, chunks, "heading", hits.Filters(["600519"], [], "balance"), "sparse", 1).count() == 0
    cited = hits.citations(hits.retrieve(asked, chunks, "heading", filters, "sparse", 1)).first()
    assert (cited.idx, cited.page, cited.heading, cited.snippet) == (1, 8, "h", "the whole section")
    assert hits.context(hits.retrieve(asked, chunks, "heading", filters, "sparse", 1)).first().context == "[1]（来源：d 第8页 · h）\nthe whole section"
    with pytest.raises(ValueError, match="no such mode"):
        hits.search(chunks, asked, "other")
    with pytest.raises(ValueError, match="needs vectors"):
        hits.search(chunks, asked, "dense")


def test_summary_tables_come_first(spark):
    rows = [("s1", "sum", "d", "a", 2025, None, "table_summary", None, None, "", 1, 1, None, "heading", 1), ("c", "revenue", "d", "a", 2025, None, "text", None, None, "", 1, 1, None, "heading", 1), ("s2", "sum", "d", "b", 2025, None, "table_summary", None, None, "", 1, 1, None, "heading", 1)]
    asked = spark.createDataFrame([(1, "revenue")], "qid long, text string")
    got = hits.retrieve(asked, spark.createDataFrame(rows, CHUNK), "heading", hits.Filters(["a"]), summary=True).orderBy("seq").collect()
    assert [(r.chunk_uid, r.expanded) for r in got] == [("s1", False), ("c", False)] and got[0].score == R.FORCED_SCORE


def test_reranking_degrades(spark):
    found = spark.createDataFrame([(1, "a", 0.9, 1), (1, "b", 0.8, 2), (2, "c", 0.7, 1)], "qid long, id string, score double, rank int")
    scores = spark.createDataFrame([(1, 1, 0.5), (1, 0, 0.4), (1, 7, 9.0), (1, -1, 9.0)], "qid long, idx int, score double")
    show = lambda df: sorted((r.qid, r.rank, r.id, r.score, tuple(r.degraded)) for r in df.collect())
    assert show(hits.rerank(found, scores)) == [(1, 1, "b", 0.5, ()), (1, 2, "a", 0.4, ()), (2, 1, "c", 0.7, ("rerank_skipped",))]
    assert show(hits.rerank(found, None, 1)) == [(1, 1, "a", 0.9, ("rerank_skipped",)), (2, 1, "c", 0.7, ("rerank_skipped",))]
    assert show(hits.rerank(found, scores, 1, enabled=False)) == [(1, 1, "a", 0.9, ()), (2, 1, "c", 0.7, ())]


def test_cache_lives_a_day_and_the_last_answer_counts(spark):
    made = lambda q, a, at, ns="e@f": (ns, "k", q, [1.0], a, [1], False, at)
    answers = spark.createDataFrame([made("q", "old", "2025-01-01 00:00:00"), made("q", "new", "2025-01-01 06:00:00"), made("r", "gone", "2025-01-01 00:00:00"), made("q", "other", "2025-01-01 07:00:00", "e@g")], "exp_id string, entity_key string, question string, v array<float>, answer string, citations array<int>, refused boolean, at string")
    stored = cache.entries(answers, F.col("at").cast("timestamp"))
    asked = spark.createDataFrame([(1, "e@f", "k", " q "), (2, "e@f", "k", "r"), (3, "e@f", "x", "q")], "id int, exp_id string, entity_key string, question string")
    got = cache.get_exact(asked, stored, F.lit("2025-01-02 03:00:00").cast("timestamp")).collect()
    assert [(r.id, r.answer, r.citations, r.refused) for r in got] == [(1, "new", [1], False)]
    fresh = stored.where("exp_id = 'e@g'").withColumn("answer_json", F.lit("{}"))
    assert cache.upsert(stored, fresh).where("answer_json = '{}'").count() == 1 and cache.upsert(stored, fresh).count() == 4
    assert spark.range(1).select(cache.namespace(F.lit("x" * 30), F.lit("abc")).alias("n")).first().n == "x" * 30 + "@a"


def test_semantic_cache_keeps_namespaces_apart(spark):
    rows = [("e@f", "k", "a1", '{"answer":"near","citations":[],"refused":false}', [1.0, 0.1]), ("e@g", "k", "a2", '{"answer":"other","citations":[],"refused":false}', [1.0, 0.0]), ("e@f", "x", "a3", "{}", [1.0, 0.0])]
    stored = spark.createDataFrame(rows, "exp_id string, entity_key string, cache_key string, answer_json string, v array<float>")
    asked = spark.createDataFrame([(1, "e@f", "k", [1.0, 0.0]), (2, "e@h", "k", [1.0, 0.0])], "id int, exp_id string, entity_key string, v array<float>")
    assert [(r.id, r.answer, r.cache_similarity) for r in cache.get_semantic(asked, stored).collect()] == [(1, "near", 0.995)]
    assert cache.get_semantic(asked, stored, 0.999).count() == 0


def scripted(*turns):
    left = list(turns)
    return lambda messages, may_call: left.pop(0) if left else answering.Turn("done")


def test_agent_sends_back_malformed_calls_and_mental_arithmetic():
    say, call = answering.Turn, lambda: answering.Turn(calls=[("calculate", {"expression": "1 + 1"})])
    tools = {"calculate": answering.calculate_tool}
    out = answering.agent("q", scripted(say('{"expression": "1"}</tool_call>'), call(), say("增长 2%")), tools)
    assert (out.answer, out.degraded, out.pad[0][2]) == ("增长 2%", [], "1 + 1 = 2")
    out = answering.agent("q", scripted(say("增长 2%"), say("增长 3%")), tools)
    assert (out.answer, out.degraded) == ("增长 3%", ["agent_mental_arithmetic"])
    out = answering.agent("q", scripted(*[say("调用 calculate 工具")] * 3, say("so")), tools)
    assert out.answer == "so" and out.degraded == ["agent_forced_answer:max_errors"]
    assert answering.calculate_tool("1 / 0") == "无法计算：除数为零" and answering.calculate_tool("1234.5 * 2").endswith("= 2,469.00")


def test_report_tool_finds_companies_by_name_and_code():
    seen = []
    rows = [{"page_start": 3, "unit": "元", "heading_path": "h", "content": "text"}]
    tool = answering.report_tool(lambda words, code, year: seen.append((words, code, year)) or (rows if code == "1" else []), [("1", "甲公司", 2025), ("2", "乙公司", 2025)])
    assert tool("甲公司股份", 2024, "营收") == "[第3页（单位：元） h]\ntext" and tool("1", 0, "营收").startswith("[第3页")
    assert seen == [("2024年营收", "1", 2024), ("营收", "1", 0)]
    assert tool("乙公司", 2024, "x").startswith("未检索到") and tool("丙", 2024, "x") == "未收录公司「丙」。已收录：甲公司(1)、乙公司(2)"


def test_events_are_numbered(spark):
    df = spark.createDataFrame([(1, "generate", "一句。二句[1]", [7]), (2, "refuse", answering.NOT_FOUND, [])], "id int, verdict string, answer string, citations array<long>")
    got = {r.id: [(e.seq, e.event) for e in r.events] for r in answering.events(df).collect()}
    assert [e for _, e in got[1]] == ["stage"] * 3 + ["token"] * 2 + ["citations", "done"] and [s for s, _ in got[1]] == list(range(1, 8))
    assert [e for _, e in got[2]] == ["stage"] * 3 + ["token", "done"]


def test_registry_names_what_it_has(spark):
    registry = providers.Registry({"profiles": {"a": {"kind": "chat", "model": "m", "price_in": 1, "price_out": 2}, "b": {"kind": "embedding", "model": "n"}}})
    assert registry["a"]["model"] == "m" and registry.of_kind("chat") == ["a"]
    with pytest.raises(providers.UnknownProfile, match="there are a, b"):
        registry["c"]
    with pytest.raises(ValueError, match="lacks model"):
        providers.Registry({"profiles": {"a": {"kind": "chat"}}})
    df = spark.createDataFrame([("a", 1000, 500)], "p string, i int, o int")
    assert df.select(providers.cost(F.col("p"), F.col("i"), F.col("o"), registry.prices()).alias("c")).first().c == 2.0
    with pytest.raises(Exception, match="no price for profile"):
        df.select(providers.cost(F.lit("zzz"), F.col("i"), F.col("o"), registry.prices(), strict=True)).collect()


def test_streams_of_turns_and_answers(spark, tmp_path):
    turns = str(tmp_path / "turns")
    spark.createDataFrame([(c, k, "user" if k % 2 == 0 else "assistant", f"{c}-{k}") for c in (1, 2) for k in range(16)], "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(turns)
    stream = ingestion.history_stream(spark.readStream.schema("conv_id long, turn long, role string, text string").parquet(turns))
    stream.writeStream.format("memory").queryName("turns").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination()
    assert {(r.conv_id, r.turn): r.history for r in spark.table("turns").collect()}[2, 14] == [f"2-{k}" for k in range(4, 15, 2)]
    drops, out = str(tmp_path / "answers"), str(tmp_path / "cache")
    kind = "cache_key string, exp_id string, entity_key string, v array<float>, answer_json string, hit_count int, created_at timestamp"
    for at, answer in (("2025-01-01 00:00:00", "old"), ("2025-01-01 01:00:00", "new")):
        spark.createDataFrame([("k", "e", "x", [1.0], answer, 0), ("l" + answer, "e", "x", [1.0], answer, 0)], kind.rpartition(",")[0]).withColumn("created_at", F.lit(at).cast("timestamp")).coalesce(1).write.mode("append").parquet(drops)
        ingestion.store_cache(spark.readStream.schema(kind).parquet(drops), out, str(tmp_path / "c2")).awaitTermination()
    last = ingestion.cache_versions(spark, out)[-1]
    assert {(r.cache_key, r.answer_json) for r in spark.read.parquet(f"{out}/version-{last}").collect()} == {("k", "new"), ("lold", "old"), ("lnew", "new")}


def test_reports_that_name_neither_code_nor_company(spark, tmp_path):
    for name in ("600001_甲公司_2025年年度报告.pdf", "600002_乙公司_2025年年度报告.pdf"):
        (tmp_path / name).write_bytes(name.encode())
    reader = lambda content, pages: [(1, 1, "甲 公 司 2025"), (9, 1, "600002 乙公司")]
    lines = readers.pdf_lines(spark, str(tmp_path), reader, 5)
    assert {r.page for r in lines.collect()} == {1}
    assert [r.company for r in readers.mismatched(readers.filings(spark, str(tmp_path)), lines).collect()] == ["乙公司"]


def test_vector_rows_listing_and_caps(spark):
    chunks = spark.createDataFrame([("p", "d", "heading", 0, "text", None), ("c", "d", "heading", 1, "text", None)], "chunk_uid string, doc_key string, strategy string, level int, chunk_type string, statement_type string")
    docs = spark.createDataFrame([("d", "600001", 2025)], "doc_key string, company_code string, report_year int")
    vectors = spark.createDataFrame([("p", [1.0]), ("c", [2.0])], "chunk_uid string, v array<double>")
    assert [(r.chunk_uid, r.company_code, r.v) for r in ingest.vector_rows(chunks, vectors, docs).collect()] == [("c", "600001", [2.0])]
    with pytest.raises(ValueError):
        ingest.listing(docs, 201)
    rows = spark.createDataFrame([("甲", "1", f"m{k}", 2025, float(k + 1), "1", "元", 1, "h") for k in range(30)], "doc string, code string, metric string, year int, value double, raw string, unit string, page int, heading string")
    none = spark.createDataFrame([], "doc string, code string, metric string, year int, unit string, whole double, parent double, whole_raw string, parent_raw string, page int, page_end int")
    assert dataset.full_items(rows, none).count() == 12 and Q.COVERS == 3


def test_shared_folder(spark, tmp_path):
    class Context:
        master, applicationId = "spark://far:7077", "far"

    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda *a: None)

        sparkContext = Context

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session)
    made = shared.materialise(spark.range(5), "t")
    path = made.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    import os

    assert made.count() == 5 and os.path.isdir(path)
    shared.discard(made)
    assert not os.path.exists(path)


def test_only_parents_of_hits_are_gathered(spark):
    """Parents that are made by grouping children were all made, with their texts."""
    rows = [(f"c{k}", "revenue" if k < 6 else "other", "d", "a", 2025, None, "text", None, None, "", 1, 1, f"p{k // 3}", "heading", 1) for k in range(600)]
    children = spark.createDataFrame(rows, CHUNK)
    made = children.groupBy("parent_uid").agg(F.min("content").alias("content"), *(F.first(c).alias(c) for c in ("doc_key", "company_code", "report_year", "period", "chunk_type", "statement_type", "unit", "heading_path", "page_start", "page_end", "strategy")))
    parents = made.withColumnRenamed("parent_uid", "chunk_uid").withColumn("parent_uid", F.lit(None).cast("string")).withColumn("level", F.lit(0))
    asked = spark.createDataFrame([(1, "revenue")], "qid long, text string")
    out = hits.retrieve(asked, children.unionByName(parents), "heading", hits.Filters(["a"]), "sparse", 5)
    assert [(r.chunk_uid, r.expanded) for r in out.orderBy("seq").collect()] == [("p0", True), ("p1", True)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan[plan.index("Aggregate [parent_uid") :]
