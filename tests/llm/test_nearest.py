"""Nearest neighbours by largest product: norms of any size, copies, and the fitted factor."""

import math

import numpy as np
from filigree.llm import vptree_ann


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(a) for a in v]) for i, v in zip(ids, x)], "id long, v array<double>")


def ranked(rows):
    found = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return found


def brute_force(x, queries, k):
    out = {}
    for q in queries:
        score = [(-sum(float(a) * float(b) for a, b in zip(x[q], v)), i) for i, v in enumerate(x) if i != q]
        out[q] = [(i, -s) for s, i in sorted(score)[:k]]
    return out


def test_norms_of_any_size(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 6)) * 10.0 ** rng.uniform(-8, 8, 600)[:, None]
    x[5], x[10], x[11], x[12] = x[5] * 1e120, x[10] * 1e130, x[11] * 1e-120, x[12] * 1e-150
    asked = [0, 5, 10, 11, 12, 100, 200]
    df = frame(spark, range(600), x)
    got = ranked(vptree_ann.search(df, df.where(f"id in ({', '.join(map(str, asked))})"), shard=64, block=3).collect())
    want = brute_force(x, asked, 20)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert all(math.isclose(a, b, rel_tol=1e-12) for q in asked for (_, a), (_, b) in zip(got[q], want[q]))


def test_products_beyond_doubles_are_infinite_and_zero(spark):
    x = [[1e200, 0.0], [1e200, 1.0], [1.0, 1.0], [1e-200, 0.0], [1e-200, 1e-200], [-1e200, 0.0]]
    df = frame(spark, range(6), x)
    got = ranked(vptree_ann.search(df, df.where("id in (0, 3)"), k=5).collect())
    assert [i for i, _ in got[0]] == [1, 2, 3, 4, 5] and got[0][0][1] == math.inf and got[0][-1][1] == -math.inf
    assert [i for i, _ in got[3]] == [0, 1, 2, 4, 5] and got[3][3][1] == 0.0


def test_copies_are_one_vector_with_many_ids(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([np.tile(rng.normal(size=(1, 5)), (400, 1)), rng.normal(size=(400, 5))])
    df = frame(spark, range(800), x)
    again = df.union(df.where("id < 30")).union(df.where("id = 40")).union(df.where("id = 40"))
    got = ranked(vptree_ann.search(again, again.where("id % 40 = 0"), k=6, shard=50).collect())
    twice = sorted([*range(800), *range(30), 40, 40])
    for q in range(0, 800, 40):
        score = sorted((-sum(float(a) * float(b) for a, b in zip(x[q], x[i])), i) for i in twice if i != q)[:6]
        assert [i for i, _ in got[q]] == [i for _, i in score]


def test_fitted_factor_prunes_and_finds(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.1, (250, 12)) for c in rng.normal(0, 1, (16, 12))])
    df = frame(spark, range(len(x)), x)
    rows = vptree_ann.search(df, df.where("id % 20 = 0"), relax=None).collect()
    asked = range(0, len(x), 20)
    found = {}
    for r in rows:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    near = {q: [i for i in np.argsort(-(x @ x[q]), kind="stable").tolist() if i != q][:20] for q in asked}
    assert np.mean([len(found[q] & set(near[q])) / 20 for q in asked]) >= 0.9
    assert np.mean([r.skipped for r in rows]) > 0.3
