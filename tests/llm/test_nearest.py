import math

import numpy as np

from tidemark.llm import nearest


def test_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 16)).astype("f4")
    x[50:60] = x[50]
    x[70] *= 1000
    rows = [(i, v.tolist(), i) for i, v in enumerate(x)]
    rows += [(900, None, 0), (1000, [0.0] * 16, 0), (1001, [float("nan")] + [1.0] * 15, 0), (1002, [None] + [1.0] * 15, 0), (1003, [float("inf")] * 16, 0), (1100, [1.0] * 5, 0), (1200, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int").repartition(4)
    for blocks in ((4096, 4096), (7, 50)):
        got = nearest.knn(df.where("vec_id % 50 = 0"), df, 10, query_block=blocks[0], candidate_block=blocks[1]).collect()
        want = []
        for q in range(0, 600, 50):
            d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
            order = [int(i) for i in np.lexsort((np.arange(600), d)) if i != q][:10]
            want += [(q, r + 1, i, d[i]) for r, i in enumerate(order)]
        got = sorted(map(tuple, got))
        assert [g[:3] for g in got] == [w[:3] for w in want]
        assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (0, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [tuple(r)[:3] for r in nearest.knn(df.where("vec_id = 0"), df, 10).collect()] == [(0, 1, 1)]
    assert nearest.knn(df.limit(0), df.limit(0), 10).count() == 0


def test_very_large_and_very_small_vectors(spark):
    rng = np.random.default_rng(3)
    sizes = rng.choice([1e-320, 1e-300, 1e-200, 1.0, 3.0, 1e200, 1e300], 300)
    x = rng.normal(size=(300, 8)) * sizes[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(None, [1.0] * 8)], "vec_id long, embedding array<double>")
    got = nearest.knn(df.where("vec_id % 7 = 0"), df, 10, query_block=20, candidate_block=60).collect()
    want = []
    for q in [i for i in range(0, 300, 7) if x[i].any()]:
        c = [i for i in range(300) if i != q and x[i].any()]
        d = {i: math.hypot(*(x[q] - x[i])) for i in c}
        want += [(q, d[i]) for i in sorted(c, key=lambda i: d[i])[:10]]
    got.sort()
    assert [g["query_id"] for g in got] == [w[0] for w in want]
    # equal distances up to rounding may be ordered otherwise, so the distances are compared
    assert np.allclose([g["score"] for g in got], [w[1] for w in want], rtol=1e-9, atol=0)


def test_bounds_hold():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 24)) * rng.choice([0.01, 1, 100], 200)[:, None]
    q = nearest.quantise(x)
    low, high = nearest.bounds(q, q)
    fine = nearest.both_codes(x)
    assert np.median(fine[5]) < 0.02 * np.median(fine[2])
    true = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert (low <= true).all() and (true <= high).all()
    assert np.median(high - low) < 0.05 * np.median(true)


def test_copies_and_near_copies_stay_few(spark):
    """A large group of equal rows and one of close vectors: what leaves a tile grows with k, not with the groups."""
    rng = np.random.default_rng(8)
    x = np.concatenate([np.repeat(rng.normal(size=(1, 24)), 700, axis=0), rng.normal(size=(1, 24)) + rng.normal(size=(700, 24)) * 0.05, rng.normal(size=(200, 24))])
    one = x[699:]  # the copies are one candidate
    found = nearest.survivors(np.arange(len(one)), nearest.both_codes(one), [{i} for i in range(len(one))], nearest.both_codes(one), 10)
    assert np.bincount(found[0]).max() <= 30
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(3, x[3].tolist())] * 15
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)
    got = {}
    for r in nearest.knn(df.where("vec_id in (0, 3, 650, 700, 1500)"), df, 10, query_block=2, candidate_block=300).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    ids = np.array([r[0] for r in rows])
    whole = np.array([r[1] for r in rows])
    for q in (0, 3, 650, 700, 1500):
        d = nearest.distances(np.repeat(x[q][None], len(ids), axis=0), whole)
        order = [int(ids[i]) for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        assert [v for _, v in sorted(got[q])] == order, q
