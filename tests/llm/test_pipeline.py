"""The pipeline against its operators, stage by stage, and the licence query against its SQL."""

import zlib

import numpy as np

import corpus_pipeline
from compare import database, rows
from filigree.llm import decontaminate, minhash_dedup, queries, token_output, toxicity
from filigree.llm.shared import materialise, table


def test_stages_keep_their_contract(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    names = docs.columns
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "test-stage")
        assert docs.columns == names, name
        seen[name] = docs
    first, near, clean, mixed = seen.values()
    grammar = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), toxicity.TRAINING)
    assert all(r.score < 0.5 for r in toxicity.score(first, grammar).collect())
    assert minhash_dedup.near_duplicates(near).where("doc_id <> component_id").count() == 0
    assert decontaminate.contamination(clean, table(spark, sf_dir, "benchmark")).count() == 0
    assert sorted(r.doc_id for r in mixed.collect()) == sorted(r.doc_id for r in clean.collect())
    # the last stage writes the tokens in the order of the mixing stage's files
    last = sorted(corpus_pipeline.write_tokens(spark, mixed, sf_dir).collect(), key=lambda r: r.start)
    part = mixed.metadataColumn("_metadata")
    order = [r.doc_id for r in mixed.select("doc_id", part["file_name"].alias("f"), part["row_index"].alias("r")).orderBy("f", "r").collect()]
    assert [r.doc_id for r in last] == order
    text = {r.doc_id: r.text for r in mixed.collect()}
    encoder = token_output.encoder(token_output.default_tokenizer())
    for r in last:
        ids = encoder.tokenizer.encode(text[r.doc_id], add_special_tokens=False).ids + [0]
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_tables_that_are_not_files_go_by_doc_id(spark, sf_dir):
    docs = spark.createDataFrame([(2, "b"), (1, "a"), (None, None)], "doc_id long, text string")
    got = sorted(corpus_pipeline.write_tokens(spark, docs, sf_dir).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 2]


def test_licence_query_equals_its_sql(spark, sf_dir):
    got = queries.queries()["op7_license_digests"](spark, sf_dir).toArrow()
    assert rows(got) == rows(database(sf_dir).sql(queries.oracle_sql()["op7_license_digests"]).to_arrow_table()) and got.num_rows


CLASH = "doc_id long, text string, lang string, source string, n_chars long, key long, h string, pos int, _s string, _d long, _slot int, _kept int, _bad int, id int, score double"


def test_stages_handle_what_may_come(spark, sf_dir):
    """Nulls in any column, repeated rows, a very long and an empty text, clashing columns; and no rows at all."""
    full = lambda i, t, s: (i, t, "en", s, len(t or ""), 1, "x", 2, "y", 3, 4, 5, 6, 7, 0.5)
    rows = [full(k, f"a text of its own, number {k}, with word{k} and other{k} and more{k} of it", "s") for k in range(12)]
    rows += [rows[3], rows[3], full(50, rows[4][1], "t"), full(51, "", "t"), full(52, None, None), full(None, "no number", "t"), full(None, None, None), full(53, "long " * 60_000, "s"), (54, "nothing else", *[None] * 13)]
    docs = spark.createDataFrame(rows, CLASH)
    for some in (docs, docs.limit(0)):
        kept = some
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = materialise(stage(spark, kept, sf_dir), "test-stage")
            assert kept.schema.names == docs.schema.names, name
        ids = sorted((r.doc_id is not None, r.doc_id or 0) for r in kept.collect())
        assert ids == ([] if some is not docs else [(False, 0)] * 2 + [(True, k) for k in (*range(12), 51, 52, 53, 54)])
        out = corpus_pipeline.write_tokens(spark, kept, sf_dir)
        assert out.count() == len(ids) and (some is not docs or out.agg({"n_tokens": "max"}).first()[0] > 60_000)
