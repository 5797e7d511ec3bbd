from pyspark.sql import functions as F

from filigree.operators import tables as O
from filigree.plans import tables as P


def collected(df, column="rows"):
    return {r.id: r[column] for r in df.collect()}


def test_broken_labels_are_joined(spark):
    got = collected(P.merge_wrapped_labels(spark, ""))
    assert [r[0] for r in got[1]] == ["项目", "调整前", "投资活动产生的现金流量净额（元）", "总资产"]
    assert got[1][1] == ["调整前", "调整后", "调整后", "本期"]  # a sub-header right after the header stays
    assert len(got[2]) == 4  # no value before it, no continuation


def test_rendered_table_says_unit_title_and_years(spark):
    text = collected(P.render_table(spark, ""), "text")[1]
    assert text.split("\n") == [
        "【单位：元】",
        "六、主要会计数据与指标一览",
        "| 会计数据一览 | 2025年 | 2024年 | 本期比上年同期增减(%) | 2023年 |",
        "| --- | --- | --- | --- | --- |",
        "| 营业收入 | 4,321,098,765.40 | 4,000,111,222.33 | 8.02 | 3,777,666,555.44 |",
        "",
        "【按年份】营业收入：2025年=4,321,098,765.40；2024年=4,000,111,222.33；2023年=3,777,666,555.44",
    ]


def test_blank_header_gets_column_names(spark):
    text = collected(P.render_table(spark, ""), "text")[10]
    assert "| 列1 | 列2 |" in text and text.startswith("备查文件目录")


def test_split_pieces_repeat_the_header_and_lose_no_row(spark):
    got = P.split_table(spark, "").collect()
    pieces = [r.piece for r in sorted(got, key=lambda r: r.seq) if r.id == 1]
    head = "\n".join(P.LONG.split("\n")[:3])
    assert len(pieces) > 1 and all(p.startswith(head + "\n") for p in pieces)
    assert [ln for p in pieces for ln in p.split("\n")[3:]] == P.LONG.split("\n")[3:]
    assert [r.piece for r in got if r.id == 2] == [P.TEXTS.rows[1][1]]


def test_rebuilt_table_needs_to_be_better(spark):
    old = [["科目", "x"], ["甲", "210,987,654,321 12.34 187,654,321,098"]]
    new = [["科目", "a", "b"], ["甲", "210,987,654,321", "187,654,321,098"]]
    df = spark.createDataFrame([(old, new), (new, old)], "old array<array<string>>, new array<array<string>>")
    assert [r.b for r in df.select(O.rebuilt_is_better(F.col("old"), F.col("new")).alias("b")).collect()] == [True, False]
