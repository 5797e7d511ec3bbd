import json

import pytest

from filigree.operators.ingest import delete_cascade
from filigree.sources import readers
from filigree.streaming import ingestion


def test_eval_items_are_read_checked_and_replaced(spark, tmp_path):
    item = dict(question="q", category="fact", difficulty=None, ground_truth="t", numeric_value=1.5, unit="元", metric_name=None, expected_doc_keys=["a"], expected_pages=[1], source="s", verified=True, note=None)
    (tmp_path / "v.jsonl").write_text("\n".join(json.dumps(x, ensure_ascii=False) for x in (item, item | {"category": "odd"}, item | {"question": " "})))
    items = readers.eval_items(spark, str(tmp_path / "v.jsonl"))
    assert sorted(r.violation for r in readers.violations(items).collect()) == ["no question", "unknown category"]
    out = str(tmp_path / "sets")
    readers.replace_dataset(items, out, "a")
    readers.replace_dataset(items.limit(1), out, "b")
    readers.replace_dataset(items.limit(2), out, "a")
    assert {(r.dataset, r["count"]) for r in spark.read.parquet(out).groupBy("dataset").count().collect()} == {("a", 2), ("b", 1)}


def test_filings_by_name(spark, tmp_path):
    (tmp_path / "600519_贵州茅台_贵州茅台2025年年度报告.pdf").write_bytes(b"x")
    row = readers.filings(spark, str(tmp_path)).first()
    assert (row.code, row.company, row.year, row.length) == ("600519", "贵州茅台", 2025, 1)
    words = readers.pdf_words(spark, str(tmp_path), lambda content: [(1, 0.0, 0.0, 1.0, 1.0, content.decode())])
    assert words.first().word == "x"
    (tmp_path / "random.pdf").write_bytes(b"y")
    with pytest.raises(Exception, match="not a filing's name"):
        readers.filings(spark, str(tmp_path)).collect()


def test_lookup():
    assert readers.lookup({"a": {"b": 1}}, "a.b") == 1 and readers.lookup({"a": 1}, "a.b", 2) == 2


def test_streamed_documents_replace_their_former_selves(spark, tmp_path):
    drops, chunks, checkpoint = (str(tmp_path / x) for x in ("in", "chunks", "checkpoint"))
    put = lambda *rows: spark.createDataFrame(list(rows), ingestion.INCOMING).coalesce(1).write.mode("append").parquet(drops)
    put(("d1", "h", "first " * 200), ("d2", "h", "other"))
    ingestion.ingest(spark, drops, chunks, checkpoint).awaitTermination()
    n = spark.read.parquet(chunks).where("doc_key = 'd1'").count()
    put(("d1", "h", "second"))
    ingestion.ingest(spark, drops, chunks, checkpoint).awaitTermination()
    rows = spark.read.parquet(chunks).collect()
    assert n > 2 and sorted((r.doc_key, r.level, r.content) for r in rows) == [("d1", 0, "h\nsecond"), ("d1", 1, "h\nsecond"), ("d2", 0, "h\nother"), ("d2", 1, "h\nother")]


def test_history_is_of_the_user_alone(spark):
    turns = spark.createDataFrame([(1, k, "user" if k % 2 == 0 else "assistant", str(k)) for k in range(20)], "conv_id long, turn long, role string, text string")
    got = {r.turn: r.history for r in ingestion.recent_turns(turns).collect()}
    assert got[0] == ["0"] and got[18] == ["8", "10", "12", "14", "16", "18"]


def test_cache_stream_keeps_one_answer_a_key(spark, tmp_path):
    src = str(tmp_path / "answers")
    spark.sql("select * from values ('k', 'a', timestamp'2024-01-01 00:00:00'), ('k', 'b', timestamp'2024-01-01 01:00:00'), ('l', 'c', timestamp'2024-01-01 00:30:00') as t(key, answer, created_at)").coalesce(1).write.parquet(src)
    stream = ingestion.exact_cache(spark.readStream.schema("key string, answer string, created_at timestamp").parquet(src))
    stream.writeStream.format("memory").queryName("cached").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert spark.sql("select count(*), count(distinct key) from cached").first() == (2, 2)


def test_cascade(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "key long")
    docs, chunks = delete_cascade(df, df.union(df), df.where("key = 2"))
    assert docs.count() == 2 and chunks.count() == 4
