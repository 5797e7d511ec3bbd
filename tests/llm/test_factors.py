"""The relative Lempel-Ziv parse: factors name words that are equal, and cover what brute force covers."""

import random

import numpy as np
import pyarrow as pa
from filigree.llm import substring_dedup as sd
from filigree.llm import words


def test_factors_repeat_their_references(spark):
    rng = random.Random(9)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop") + str(rng.randint(0, 9))
    pool = [[word() for _ in range(90)] for _ in range(4)]
    docs = []
    for i in range(40):
        w = [word() for _ in range(rng.choice([0, 10, 40]))]
        for p in rng.sample(pool, rng.randint(0, 3)):
            a = rng.randint(0, 60)
            w += p[a : a + rng.randint(20, 90)] + [word() for _ in range(rng.choice([0, 0, 3]))]
        docs.append(w * rng.choice([1, 1, 2]))
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    n, seen = 12, {}
    out = {r.doc_id: r for r in sd.substring_dedup(df, block=n, gram=4).collect()}
    for i, w in enumerate(docs):
        own = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        gone = {k + j for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in seen for j in range(n)}
        for g in own:
            seen.setdefault(g, i)
        covered, last = [], 0
        for f in out[i].factors:
            assert f.ref_doc < i and f.start >= last and w[f.start : f.end] == docs[f.ref_doc][f.ref_start : f.ref_start + f.end - f.start]
            covered += range(f.start, f.end)
            last = f.end
        assert set(covered) == gone and len(covered) == len(gone)
        assert [k for s in out[i].spans for k in range(s.start, s.end)] == covered
        assert out[i].kept == " ".join(x for k, x in enumerate(w) if k not in gone)
    assert any(f.end - f.start < n for r in out.values() for f in r.factors)  # the rest of a block over a boundary


def test_parse_takes_the_match_that_reaches_furthest():
    assert sd.parse([(0, 50, 1, 7), (10, 90, 2, 0), (20, 70, 3, 5), (85, 140, 4, 3), (200, 260, 1, 0)]) == [(0, 50, 1, 7), (50, 90, 2, 40), (90, 140, 4, 8), (200, 260, 1, 0)]
    assert sd.parse([]) == [] and sd.matches(np.zeros(0, int), np.zeros(0, int), np.zeros(0, int), 5) == []


def test_a_collision_of_one_hash_removes_nothing(monkeypatch):
    """Two different blocks with one first hash: the second tells them apart."""
    monkeypatch.setattr(words.Words, "spans", lambda self, start, end, lower: np.full(len(start), 5, np.uint64))
    text = " ".join(f"w{k}" for k in range(12))
    place = [pa.array([[0 << 32 | 3]], pa.list_(pa.int64())), pa.array([[1]], pa.list_(pa.int64()))]
    batch = pa.RecordBatch.from_arrays([pa.array([2]), pa.array([text]), *place, pa.array([None], pa.int64())], ["doc_id", "text", *sd.PLACE, "copy"])
    (out,) = sd._cut(4)(iter([batch]))
    assert out.column("spans").to_pylist() == [[{"start": 0, "end": 4}]]
