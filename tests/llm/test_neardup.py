import numpy as np

from tidemark.llm import neardup


def brute(ids, x, threshold=0.9):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (unit @ unit.T) >= threshold
    np.fill_diagonal(links, False)
    comp = np.array(ids)
    while True:
        new = np.array([min([comp[i], *comp[links[i]]]) for i in range(len(ids))])
        if (new == comp).all():
            return links.sum(axis=1), comp
        comp = new


def test_against_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(900, 32))
    near = np.repeat(base[:40], 12, axis=0) + rng.normal(size=(480, 32)) * 0.2
    hot = base[50] + rng.normal(size=(500, 32)) * 0.15
    x = np.concatenate([base, near, hot, base[60:70]]).astype("f4")
    ids = rng.permutation(len(x)) * 3
    rows = [(int(i), v.tolist(), 1) for i, v in zip(ids, x)] + [(9001, None, 1), (9002, [0.0] * 32, 1), (9003, [float("nan")] * 32, 1), (9004, [1.0, 2.0], 1), (9005, [2.0, 4.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n_links int").repartition(5)
    got = {r["vec_id"]: r for r in neardup.near_duplicates(df).collect()}
    n, comp = brute(ids.tolist(), x.astype(float))
    assert len(got) == len(rows)
    true = dict(zip(ids.tolist(), n.tolist()))
    assert all(got[i]["n_links"] <= true[i] for i in true)
    assert sum(got[i]["n_links"] for i in true) >= 0.95 * sum(true.values())
    same = sum(got[i]["component_id"] == c for i, c in zip(ids.tolist(), comp.tolist()))
    assert same >= 0.99 * len(ids)
    for i in (9001, 9002, 9003):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert got[9005]["component_id"] == 9004 and got[9005]["n_links"] == 1


def test_equal_vectors_and_nothing(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0, 3.0]) for i in range(50)] + [(99, [-1.0, 0.0, 0.0])], "vec_id long, embedding array<float>")
    rows = neardup.near_duplicates(df).collect()
    assert {(r["n_links"], r["component_id"]) for r in rows} == {(49, 0), (0, 99)}
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def two_groups():
    """Two groups of distinct near copies, each larger than the pool of a vertex, and pairs; one cluster."""
    rng = np.random.default_rng(11)
    far = rng.normal(size=(42, 32))
    hot = [far[i] + rng.normal(size=(300, 32)) * 0.1 for i in (0, 1)]
    pairs = np.repeat(far[2:], 2, axis=0) + rng.normal(size=(80, 32)) * 0.1
    return np.concatenate([*hot, pairs]).astype("f4")


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)


def test_one_cluster_is_audited(spark):
    x = two_groups()
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in neardup.near_duplicates(frame(spark, x)).collect()}
    n, comp = brute(list(range(len(x))), x.astype(float))
    assert n[600:].min() == 1
    assert got == {i: (n[i], comp[i]) for i in range(len(x))}


def test_compare_all_is_exact(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SHARD", 100)
    x = two_groups()
    vert = frame(spark, x).selectExpr("vec_id as id", "cast(embedding as array<double>) as v", "1L as w", "32 as dim")
    rows = neardup.compare_all(vert, len(x), 0.9).groupBy("id").agg({"n": "sum"}).collect()
    n, _ = brute(list(range(len(x))), x.astype(float))
    assert {r["id"]: r["sum(n)"] for r in rows} == {i: n[i] for i in range(len(x))}


def test_groups_larger_than_the_pool_are_reached():
    x = two_groups()
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lists = neardup.prune(x)
    graph = np.full((len(x), max(map(len, lists))), -1, np.int64)
    for i, near in enumerate(lists):
        graph[i, : len(near)] = near
    q, hit = neardup.range_search(x, graph, x, 0.9, neardup.BEAM)
    links = np.bincount(q, minlength=len(x)) - 1
    true = (x @ x.T >= 0.9 - 1e-4).sum(axis=1) - 1
    assert links[:300].sum() >= 0.99 * true[:300].sum() and links[300:600].sum() >= 0.99 * true[300:600].sum()
    # a member also starts at its own node
    q, _ = neardup.range_search(x, graph, x, 0.9, neardup.BEAM, own=np.arange(len(x)))
    assert (np.bincount(q, minlength=len(x)) - 1 == true)[600:].all()


def test_audit_sees_small_groups(spark):
    x = two_groups()
    vert = frame(spark, x).selectExpr("vec_id as id", "cast(embedding as array<double>) as v", "1L as w", "32 as dim")
    n, comp = brute(list(range(len(x))), x.astype(float))
    whole = [(i, int(comp[i]), int(n[i])) for i in range(len(x))]
    schema = "id long, root long, n long"
    assert neardup.audit(vert, spark.createDataFrame(whole, schema), 0.9) == 1
    # all of the large groups' links, none of the pairs'
    assert neardup.audit(vert, spark.createDataFrame(whole[:600], schema), 0.9) < 0.97


def test_vectors_of_any_size(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(20, 16))
    x = np.concatenate([base, base + rng.normal(size=base.shape) * 0.1, base * 2]) * np.repeat([1e-200, 1e-300, 1.0, 1e200, 1e300], 12)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(None, [1.0] * 16)], "vec_id long, embedding array<double>")
    unit = x / np.abs(x).max(axis=1)[:, None]
    n, comp = brute(list(range(len(x))), unit)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in neardup.near_duplicates(df).collect()}
    assert got == {i: (n[i], comp[i]) for i in range(len(x))}
