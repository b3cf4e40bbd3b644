import random

import numpy as np
import pytest

from tidemark.llm import ngramjoin


def shingles(text):
    w = ngramjoin.canonical((text or "").encode()).split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs, threshold=0.8):
    sets = {i: shingles(t) for i, t in docs.items()}
    ids = sorted(docs)
    links = {i: set() for i in ids}
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            same = docs[a] and docs[a] == docs[b]
            if same or (x and y and len(x & y) >= threshold * len(x | y) - 1e-9):
                links[a].add(b)
                links[b].add(a)
    comp = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            low = min([comp[i], *(comp[j] for j in links[i])])
            if low < comp[i]:
                comp[i], changed = low, True
    return {i: (comp[i], len(links[i])) for i in ids}


def corpus():
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(400)]
    docs = {}
    for g in range(30):
        base = [rng.choice(vocab) for _ in range(rng.randint(60, 200))]
        for _ in range(rng.randint(1, 12)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            docs[len(docs)] = " ".join(w)
    hot = [rng.choice(vocab) for _ in range(150)]
    for k in range(700):
        w = list(hot)
        w[rng.randrange(len(w))] = f"n{k}"
        docs[len(docs)] = ("Same, " if k % 2 else "same ") + " ".join(w)
    for t in [None, "", "", "!!!", "!!!", "???", "one two", "One TWO!", "a", "long " * 20_000]:
        docs[len(docs)] = t
    return docs


def test_against_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame([(i, t, 1) for i, t in docs.items()], "doc_id long, text string, class_id int").repartition(6)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngramjoin.jaccard_classes(df).collect()}
    want = brute(docs)
    assert got.keys() == want.keys()
    assert all(got[i][1] <= want[i][1] for i in want)
    assert sum(g[1] for g in got.values()) >= 0.99 * sum(w[1] for w in want.values())
    assert sum(got[i][0] == want[i][0] for i in want) >= 0.995 * len(want)
    assert ngramjoin.jaccard_classes(df.limit(0)).count() == 0


def test_prefixes_are_shortened(spark, monkeypatch):
    docs = dict(list(corpus().items())[:120])
    rng = random.Random(12)
    for k in range(200):  # pairs near the threshold, which whole labels lose some of
        w = [f"p{k}x{i}" for i in range(120)]
        docs[1000 + 2 * k] = " ".join(w)
        docs[1001 + 2 * k] = " ".join(w[: rng.randint(98, 103)])
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    tried = []
    plain = ngramjoin.candidates
    monkeypatch.setattr(ngramjoin, "candidates", lambda trie, count, vert, depth, *a: (tried.append(depth), plain(trie, count, vert, depth, *a))[1])
    rows = ngramjoin.jaccard_classes(df).collect()
    want = brute(docs)
    assert tried[0] == ngramjoin.DEPTH and len(tried) > 1 and tried == sorted(tried, reverse=True)
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in rows} == want
    assert ngramjoin.chance(0.8, 6) == pytest.approx(0.9923, abs=1e-3)


def test_hashes_follow_words():
    rng = np.random.default_rng(1)
    texts = [b" ".join(rng.choice([b"a", b"bb", b"\xc3\xa9", b"1"], rng.integers(1, 30))) for _ in range(50)]
    h, begin = ngramjoin.shingle_hashes(texts)
    seen = {}
    for t, a, b in zip(texts, begin, np.append(begin[1:], len(h)), strict=True):
        w = t.split()
        own = [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))]
        assert len(own) == b - a
        for s, x in zip(own, h[a:b].tolist(), strict=True):
            assert seen.setdefault(s, x) == x
    assert len(set(seen.values())) == len(seen)


def test_links_at_the_threshold_are_kept(spark):
    docs = {}
    for k in range(1500):
        w = [f"w{k}x{i}" for i in range(104)]
        docs[2 * k], docs[2 * k + 1] = " ".join(w[:84]), " ".join(w)  # 80 shingles of 100
    rows = ngramjoin.jaccard_classes(spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in rows} == {i: (i - i % 2, 1) for i in docs}


def test_tries_are_sorted_with_their_prefixes(spark):
    rng = np.random.default_rng(2)
    values = {i: rng.integers(0, 2, ngramjoin.TREES * ngramjoin.DEPTH).astype(">u2") for i in range(400)}
    vert = spark.createDataFrame([(i, bytearray(v.tobytes())) for i, v in values.items()], "id long, sig binary").repartition(7)
    d = ngramjoin.DEPTH
    for least in (1, 4):
        got = {(r["tree"], r["id"]): (r["lcp"], r["reach"]) for r in ngramjoin.tries(vert, least).collect()}
        borders = 0
        for tree in range(ngramjoin.TREES):
            order = sorted((v[tree * d : tree * d + d].tolist(), i) for i, v in values.items())
            same = lambda a, b: next((k for k in range(d) if a[k] != b[k]), d)
            lcp = [0] + [same(a, b) for (a, _), (b, _) in zip(order, order[1:], strict=False)] + [0]
            for k, (_, i) in enumerate(order):
                reach = max(lcp[k], lcp[k + 1])
                found = got.get((tree, i))
                if found != ((lcp[k], reach) if reach >= least else None):
                    assert found[1] == d and found[0] in (None, lcp[k])  # a neighbour in another task
                    borders += 1
        assert borders <= 2 * 8


def test_balls_need_no_pairs(spark, monkeypatch):
    """A large group of close copies is counted from its representative; what is further off by pairs."""
    rng = random.Random(3)
    base = [rng.choice([f"w{i}" for i in range(500)]) for _ in range(400)]
    docs = {}
    for k in range(500):
        w = list(base)
        for _ in range(1 if k < 400 else 6):
            w[rng.randrange(len(w))] = f"n{k}"
        docs[k] = " ".join(w)
    seen = []
    plain = ngramjoin.balls
    monkeypatch.setattr(ngramjoin, "balls", lambda *a: (seen.append(plain(*a)), seen[-1])[1])
    monkeypatch.setattr(ngramjoin, "drop_written", lambda df: None)
    rows = ngramjoin.jaccard_classes(spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)).collect()
    assert seen[0] is not None and seen[0].count() > 250
    want = brute(docs)
    found, true = sum(r["n_links"] for r in rows), sum(w[1] for w in want.values())
    assert all(r["n_links"] <= want[r["doc_id"]][1] for r in rows) and found >= 0.9999 * true
    assert {r["class_id"] for r in rows} == {0}


def test_repeated_and_null_ids(spark):
    long = " ".join(f"w{i}" for i in range(60))
    near = long.replace("w30", "x30")
    far = " ".join(f"v{i}" for i in range(60))
    rows = [(1, long), (2, near), (2, far), (3, "same words"), (3, "same words"), (3, "same words"), (None, long), (None, "only here"), (4, None), (4, None), (5, "")]
    df = spark.createDataFrame([(*r, 9, "d") for r in rows], "doc_id long, text string, uid int, digest string").repartition(3)
    got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in ngramjoin.jaccard_classes(df).collect())
    assert got == [(1, 1, 1), (2, 1, 1), (2, 2, 0), (3, 3, 2), (3, 3, 2), (3, 3, 2), (4, 4, 0), (4, 4, 0), (5, 5, 0)]
    kept = ngramjoin.single(df)
    assert kept.columns == df.columns
    left = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in kept.collect()))
    assert left == sorted([(False, 1, long), (False, 2, far), (False, 3, "same words"), (True, 0, "only here"), (False, 4, ""), (False, 4, ""), (False, 5, "")])


def test_components_with_hubs(spark, monkeypatch):
    from tidemark.llm import common

    monkeypatch.setattr(common, "HUBS", 10)
    edges = [(0, i) for i in range(1, 3000)] + [(5000 + i, 5001 + i) for i in range(40)] + [(2999, 9000), (9000, 9001)]
    got = {r["id"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in [*range(3000), 9000, 9001]}, **{5000 + i: 5000 for i in range(41)}}
