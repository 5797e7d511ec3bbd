"""BM25 by a row for each chunk: against plain Python, and how little of it is passed on."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from filigree.operators import hits, nearest, retrieval


def plain(chunks, questions, k):
    """{qid: [(id, score)]}"""
    words = {i: t.split() for i, t in chunks if t is not None}
    n, mean = len(chunks), sum(map(len, words.values())) / len(words)
    df = Counter(w for ws in words.values() for w in set(ws))
    asked = defaultdict(set)
    for q, t in questions:
        asked[q] |= set((t or "").split())
    idf = {w: math.log(1 + (n - d + 0.5) / (d + 0.5)) for w, d in df.items()}
    out = {}
    for q, terms in asked.items():
        score = {}
        for i, ws in words.items():
            tf = Counter(ws)
            if own := [idf[w] * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for w in sorted(terms & set(ws))]:
                score[i] = sum(own)
        out[q] = sorted(score.items(), key=lambda x: (-round(x[1], 6), x[0]))[:k]
    return {q: v for q, v in out.items() if v}


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(4)
    some = [f"w{k}" for k in range(30)]
    text = lambda: " ".join(r.choices(some, [1 / (j + 1) for j in range(30)], k=r.randint(0, 12)))
    chunks = [(f"c{i:03d}", text()) for i in range(300)] + [(f"d{i:03d}", "w1 w2 w3") for i in range(40)] + [("e1", None), ("e2", None), ("e3", "")]
    return chunks, [(q, text()) for q in range(40)] + [(3, "w29 w2"), (77, None), (78, "nothing like it")]


def found(df):
    out = defaultdict(list)
    for r in df.orderBy("qid", "rank").collect():
        assert r.rank == len(out[r.qid]) + 1
        out[r.qid].append((r.id, round(r.score, 9)))
    return dict(out)


@pytest.mark.parametrize("block", [2048, 8])
def test_the_same_as_in_plain_python(spark, monkeypatch, corpus, block):
    """A chunk without a text counts as one, as in SQL; equal chunks tie by id; a question may come in two rows."""
    monkeypatch.setattr(nearest, "QUERY_BLOCK", block)
    chunks, questions = spark.createDataFrame(corpus[0], "id string, text string").repartition(3), spark.createDataFrame(corpus[1], "qid int, text string")
    want = plain(*corpus, 7)
    assert found(retrieval.bm25(chunks, questions, 7)) == {q: [(i, round(s, 9)) for i, s in v] for q, v in want.items()}
    every = {(r.qid, r.id): round(r.score, 9) for r in retrieval.bm25_scores(chunks, questions).collect()}
    assert every == {(q, i): round(s, 9) for q, v in plain(*corpus, 10**6).items() for i, s in v}


def test_nobody_asks_or_nothing_is_there(spark, corpus):
    chunks, questions = spark.createDataFrame(corpus[0], "id string, text string"), spark.createDataFrame(corpus[1], "qid int, text string")
    assert retrieval.bm25(chunks, questions.limit(0), 7).count() == 0 == retrieval.bm25(chunks.where("id is null"), questions, 7).count()


def test_a_task_passes_on_k_rows_of_a_question(monkeypatch):
    """It passed on a row for each question and chunk that had a word in common."""
    for name, value in (("CELLS", 200), ("PAIRS", 16)):
        monkeypatch.setattr(retrieval, name, value)
        monkeypatch.setattr(nearest, name, value)
    words = pa.record_batch({"id": pa.array(range(5000)), "ws": pa.array([["a"] * (k % 5 + 1) + ["x", "b"][: k % 3] for k in range(5000)])})
    rows = list(retrieval._counted(pa.array(["a", "b"]))([words, words.slice(0, 0)]))
    assert sum(len(b) for b in rows) == 5000 and rows[0].column("terms")[2].as_py() == [0, 1] and rows[0].column("tfs")[2].as_py() == [3, 1]
    scored = retrieval._scored(pa.array([10, 20]), np.array([0, 2, 3]), np.array([0, 1, 1]), np.ones(2), 4.0, 3, 1.2, 0.75)  # both ask for a, one for b
    got = pa.Table.from_batches(list(scored(rows)))
    assert sorted(got["qid"].to_pylist()) == [10] * 3 + [20] * 3


def test_modes_share_their_searches(spark, monkeypatch):
    """The three modes searched the words twice."""
    calls = Counter()
    for name in ("bm25", "dense"):
        monkeypatch.setattr(retrieval, name, lambda *a, f=getattr(retrieval, name), n=name: calls.update([n]) or f(*a))
    texts, asked = spark.createDataFrame([(1, "a b"), (2, "b")], "id long, text string"), spark.createDataFrame([(1, "b")], "qid long, text string")
    vectors, own = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, v array<double>"), spark.createDataFrame([(1, [1.0, 0.5])], "qid long, v array<double>")
    got = hits.searches(texts, asked, hits.MODES, 2, 2, vectors, own)
    assert calls == {"bm25": 1, "dense": 1}
    for mode in hits.MODES:
        assert got[mode].orderBy("rank").collect() == hits.search(texts, asked, mode, 2, 2, vectors, own).orderBy("rank").collect()


def test_reranking_takes_apart_the_texts_of_hits_alone(spark, tmp_path):
    """Words of all texts were made, and shuffled where they are many."""
    spark.createDataFrame([(k, f"a b{k}") for k in range(3000)], "id long, text string").repartition(4).write.parquet(f"{tmp_path}/c")
    chunks, asked = spark.read.parquet(f"{tmp_path}/c"), spark.createDataFrame([(1, "a b7 b9")], "qid long, text string")
    out = retrieval.overlap_rerank(retrieval.bm25(chunks, asked, 3), chunks, asked)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    side = [x for x in plan.split("\n") if "regexp_extract_all" in x]
    assert [x for x in side if "AS c#" in x] and all("AS c#" not in x or plan.index(x) < plan.index("Join Inner, (id#") for x in side)  # above the join
    assert [(r.id, r.rank) for r in out.orderBy("rank").collect()] == [(7, 1), (9, 2), (0, 3)]
