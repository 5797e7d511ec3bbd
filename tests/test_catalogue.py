import pytest

from compare import database, rows
from filigree.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return database(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, sf_dir, con, name):
    got = QUERIES[name](spark, sf_dir).toArrow()
    if name in SQL:
        assert rows(got) == rows(con.sql(SQL[name]).to_arrow_table())
    else:
        assert got.num_rows


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_filters_reach_the_scan_and_columns_are_pruned(spark, sf_dir):
    from pyspark.sql import functions as F

    from filigree.operators import retrieval

    chunks = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "text", "lang").where("lang = 'en'")
    text = plan(retrieval.postings(chunks))
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in text
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string>" in text


def test_rank_limits_stand_below_the_window(spark, sf_dir):
    assert "WindowGroupLimit" in plan(QUERIES["hybrid_topk"](spark, sf_dir))


def test_no_cartesian_products(spark, sf_dir):
    for name in ("bm25_topk", "hybrid_topk", "expand_parents", "semantic_cache", "delete_cascade"):
        assert "CartesianProduct" not in plan(QUERIES[name](spark, sf_dir)), name
