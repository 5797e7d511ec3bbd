"""The k best of many: against numpy, and in the memory that a task needs."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from filigree.operators import nearest as N
from filigree.operators import cache, questions, retrieval


def ranked(ids, x, queries, k):
    unit = lambda a: a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-300)
    score = np.round(unit(queries) @ unit(x).T, 9)
    return [[int(ids[j]) for j in np.lexsort((ids, -s))[:k]] for s in score]


def asked(queries):
    return pa.table({"qid": np.arange(len(queries)), "key": np.zeros(len(queries), np.int32), "v": pa.array(list(queries), pa.list_(pa.float64()))})


def batches(x, rows):
    for a in range(0, len(x), rows):
        part = x[a : a + rows]
        yield pa.record_batch({"id": np.arange(a, a + len(part)), "key": np.zeros(len(part), np.int32), "v": pa.ListArray.from_arrays(np.arange(len(part) + 1, dtype=np.int32) * x.shape[1], part.ravel())})


def test_a_task_keeps_k_rows_of_a_question_in_bounded_memory():
    """2,048 questions, batches of 10,000 rows: a whole batch of scores is 164 MB, and each batch gave k rows of a question."""
    r = np.random.default_rng(1)
    x, queries = r.normal(size=(30_000, 16)), r.normal(size=(2048, 16))
    near = N._search(asked(queries), 20, 9, False, [])
    tracemalloc.start()
    got = pa.Table.from_batches(list(near(batches(x, 10_000))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6 and got.num_rows == 20 * 2048
    mine = got.to_pandas().sort_values(["qid", "score", "id"], ascending=[True, False, True])
    assert mine["id"].to_numpy().reshape(2048, 20).tolist() == ranked(np.arange(30_000), x, queries, 20)


def test_ties_go_to_the_smaller_id_and_unusable_vectors_take_no_part(spark):
    rows = [(k, [1.0, float(k % 3)]) for k in range(3000)] + [(9000, None), (9001, [float("nan"), 1.0]), (9002, [1.0]), (9003, [None, 1.0]), (9004, [0.0, 0.0]), (None, [1.0, 0.0])]
    vectors = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    got = retrieval.dense(vectors, spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 2.0]), (3, None)], "qid long, v array<double>"), 5).orderBy("qid", "rank").collect()
    assert [(r.qid, r.id, r.rank) for r in got] == [(1, 3 * i, i + 1) for i in range(5)] + [(2, 3 * i + 1, i + 1) for i in range(5)]


@pytest.mark.parametrize("total", [0, 5, 40])
def test_questions_go_in_blocks(spark, monkeypatch, total):
    monkeypatch.setattr(N, "QUERY_BLOCK", 16)
    r = np.random.default_rng(2)
    x = r.normal(size=(100, 4))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = retrieval.dense(vectors, vectors.where(f"id < {total}").selectExpr("id as qid", "v"), 3).orderBy("qid", "rank").collect()
    assert [g.id for g in got] == [i for row in ranked(np.arange(100), x, x[:total], 3) for i in row]


def test_semantic_lookups_compare_in_tiles_under_their_keys(spark):
    """All pairs of a key were rows of a join, each multiplied number by number; a key's rows met in one task."""
    r = np.random.default_rng(3)
    x = r.normal(size=(400, 3))
    keys = [None if i % 11 == 0 else "ab"[i % 2] for i in range(400)]
    rows = [(i, keys[i], (x[i] if i % 7 else x[i % 2]).tolist()) for i in range(400)]  # with ties
    v = spark.createDataFrame(rows, "id long, key string, v array<float>").repartition(3)
    v_of = {i: np.asarray(w, np.float32).astype(float) for i, _, w in rows}
    cos = lambda a, b: float(a @ b / np.sqrt((a @ a) * (b @ b)))
    want = {}
    for i in range(0, 400, 10):
        near = [(-round(cos(v_of[i], v_of[j]), 9), j) for j in range(400) if j != i and keys[j] is not None and keys[j] == keys[i]]
        if near and -min(near)[0] >= 0.5:
            want[i] = (min(near)[1], -min(near)[0])
    out = questions.semantic_hits(v.where("id % 10 = 0"), v.withColumnRenamed("id", "entry"), 0.5)
    assert {g.id: (g.entry, g.score) for g in out.collect()} == want
    stored = v.selectExpr("'ns' as exp_id", "key as entity_key", "lpad(id, 3, '0') as cache_key", "concat('{\"answer\":\"', id, '\"}') as answer_json", "v").where("id % 10 <> 0")
    found = cache.get_semantic(v.where("id % 10 = 0").selectExpr("id", "'ns' as exp_id", "key as entity_key", "v"), stored, 0.5)
    assert all("Join" not in df._jdf.queryExecution().optimizedPlan().toString() for df in (out, found))
    got = {g.id: (g.answer, g.cache_similarity) for g in found.collect()}
    for i in range(0, 400, 10):
        near = [(-round(cos(v_of[i], v_of[j]), 4), j) for j in range(400) if j % 10 and keys[j] is not None and keys[j] == keys[i]]
        assert got.get(i) == ((str(min(near)[1]), -min(near)[0]) if near else None)
