"""Mixing against a step-by-step version: the same hashes, sorting and loops instead of joins and windows."""

import re
from collections import Counter, defaultdict

import xxhash
from pyspark.sql import functions as F

from tidemark.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def h64(*numbers):
    seed = 42
    for n in numbers:
        seed = xxhash.xxh64(int(n).to_bytes(8, "little", signed=True), seed=seed).intdigest()
    return seed - (1 << 64) if seed >> 63 else seed


def permuted(x, n, *key):
    for r in range(mixing.ROUNDS):
        other = (h64(*key, r) % n - x) % n
        if h64(*key, r, max(x, other)) % 2 == 0:
            x = other
    return x


def brute_targets(sizes, weights=(1, 2, 3), repeat=3):
    """The contract's own words: what is above a stop is shared again until none is."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, stopped = sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in stopped]
        share = {s: (total - sum(stopped.values())) * w[s] / sum(w[x] for x in rest) for s in rest}
        above = [s for s in rest if share[s] > repeat * sizes[s]]
        if not above:
            return order, {**{s: float(v) for s, v in stopped.items()}, **share}
        stopped |= {s: repeat * sizes[s] for s in above}


def brute(rows, hashes, block, slots, repeat=3):
    """[(doc_id, size, source_size, target, taken)] for rows (doc_id, text, source) and their hashes."""
    size = [len(re.findall(mixing.WORD, t or "")) for _, t, _ in rows]
    sizes = defaultdict(int)
    for (_, _, s), n in zip(rows, size):
        sizes[s] += n
    order, target = brute_targets(sizes, repeat=repeat)
    taken = [0] * len(rows)
    slots_of, blocks_of, goal_of = {}, {}, {}
    for no, s in enumerate(order):
        own = [i for i, r in enumerate(rows) if r[2] == s]
        bins = max(1, -(-len(own) // mixing.BIN_ROWS))
        own.sort(key=lambda i: ((hashes[i] >> 20) % bins, hashes[i], -1 if rows[i][0] is None else rows[i][0], size[i]))
        stream = [i for i in own for _ in range(size[i])]
        blocks = blocks_of[no] = [stream[k : k + block] for k in range(0, len(stream), block)]
        goal_of[no] = goal = min(int(target[s] + 0.5), repeat * sizes[s])
        slots_of[no], got, j = [], 0, 0
        while got < goal:  # the slots in their order, until the target is met
            b = permuted(j % len(blocks), len(blocks), mixing.READ, no, j // len(blocks))
            part = blocks[b][: goal - got]
            slots_of[no].append((b, len(part)))
            got, j = got + len(part), j + 1
            for i in part:
                taken[i] += 1
    return [(r[0], n, sizes[r[2]], target[r[2]], k) for r, n, k in zip(rows, size, taken)], slots_of, size


def frame(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    order = [r["h"] for r in df.select(F.xxhash64("doc_id", "text").alias("h")).collect()]
    return df, order


def texts(n, seed=0):
    return [(i, " ".join(f"w{i}_{k}" for k in range((i * 7 + seed) % 40)), "abcde"[(i * i + seed) % 5] if i % 11 else None) for i in range(n)]


def same(got, want):
    key = lambda r: (str(r[0]), r[1], r[2], round(r[3], 3), r[4])
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_whole_mix_against_loops(spark):
    rows = texts(400)
    df, hashes = frame(spark, rows)
    mix = mixing.Mix(df, block=16, slots=64)
    want, slots, size = brute(rows, hashes, 16, 64)
    same([tuple(r) for r in mix.taken().collect()], want)
    own = defaultdict(dict)
    per_shard = Counter()
    for r in mix.slots.collect():
        own[r["no"]][r["j"]] = (r["block"], r["take"])
        per_shard[r["shard"]] += 1
    for no, s in slots.items():
        assert [own[no][j] for j in range(len(s))] == s
        assert len(own[no]) == len(s)
    total = sum(map(len, slots.values()))
    assert len(per_shard) == -(-total // 64) and all(per_shard[k] == 64 for k in range(total // 64))
    # every shard draws for itself: the counts of one source differ between shards, as multinomial ones do
    shares = defaultdict(set)
    for r in mix.slots.groupBy("shard", "no").count().collect():
        shares[r["no"]].add(r["count"])
    assert max(map(len, shares.values())) > 2


def test_draws_are_multinomial_about_their_targets(spark):
    rows = texts(3000)
    df, _ = frame(spark, rows)
    mix = mixing.Mix(df, block=8, slots=256)
    quota = {r["no"]: r["quota"] for r in mix.sources.collect()}
    total = sum(quota.values())
    counts = defaultdict(dict)
    for r in mix.slots.groupBy("shard", "no").count().collect():
        counts[r["no"]][r["shard"]] = r["count"]
    full = total // 256
    for no, q in quota.items():
        assert sum(counts[no].values()) == q
        p = q / total
        each = [counts[no].get(s, 0) for s in range(full)]
        mean = sum(each) / full
        spread = sum((x - mean) ** 2 for x in each) / full
        assert abs(mean - 256 * p) < 8
        assert 0.3 < spread / (256 * p * (1 - p)) < 2.5


def test_targets_stop_and_are_shared_again(spark):
    for sizes in ({"a": 1000, "b": 3, "c": 2, None: 10}, {"a": 0, "b": 5}, {None: 7}, {"b": 1, "a": 1, "é": 900, "z": 40, "Z": 2}, {str(i): (i * i) % 97 for i in range(40)}):
        rows = [(k, "x " * n, s) for k, (s, n) in enumerate(sizes.items())]
        got = {r["src"][1:] if r["src"] else None: r for r in mixing.targets(mixing.sized(spark.createDataFrame(rows, SCHEMA))).collect()}
        _, want = brute_targets(sizes)
        for s, n in sizes.items():
            assert got[s]["source_size"] == n
            assert abs(got[s]["target"] - want[s]) < 1e-6 * max(1, want[s]), (sizes, s)
            assert abs(got[s]["goal"] - want[s]) <= 0.5 + 1e-6


def test_permutation_is_one(spark):
    n = 37
    both = spark.range(n).select("id", mixing.shuffled(F.col("id"), F.lit(n).cast("long"), F.lit(5).cast("long")).alias("to"))
    back = both.select("id", "to", mixing.shuffled(F.col("to"), F.lit(n).cast("long"), F.lit(5).cast("long"), inverse=True).alias("back")).collect()
    assert sorted(r["to"] for r in back) == list(range(n)) and all(r["back"] == r["id"] for r in back)
    assert [r["to"] for r in sorted(back, key=lambda r: r["id"])] == [permuted(i, n, 5) for i in range(n)]
    assert sum(r["to"] == r["id"] for r in back) < 8


def test_odd_rows(spark):
    """Null ids, texts and sources, repeated rows and ids, one very long text, clashing columns, a hot source."""
    rows = [(None, "a b", "s"), (None, "a b", "s"), (4, "x", None), (4, "y z", None), (5, None, "t"), (6, "", "t"), (7, " \t\n", "u"), (8, "long " * 30_000, "hot")] + [(100 + i, "word " * (i % 9), "hot") for i in range(500)]
    df = spark.createDataFrame([r + (1, 2) for r in rows], SCHEMA + ", size long, taken long")
    _, hashes = frame(spark, rows)
    got = [tuple(r) for r in mixing.Mix(df).taken().collect()]
    want, _, _ = brute(rows, hashes, mixing.BLOCK, mixing.SLOTS)
    same(got, want)
    assert all(k <= 3 * n for _, n, _, _, k in got)
    assert mixing.Mix(df.limit(0)).taken().count() == 0
    blank = [tuple(r) for r in mixing.Mix(df.where("doc_id in (5, 6, 7)")).taken().collect()]
    assert sorted(blank) == [(5, 0, 0, 0.0, 0), (6, 0, 0, 0.0, 0), (7, 0, 0, 0.0, 0)]


def test_texts_hold_the_words_taken(spark):
    rows = texts(120, 3)
    df, _ = frame(spark, rows)
    mix = mixing.Mix(df, block=16, slots=32)
    taken = {r["doc_id"]: r["taken"] for r in mix.taken().collect()}
    words, slots = Counter(), defaultdict(list)
    for r in mix.texts(df).collect():
        got = r["text"].split()
        assert len(got) == r["n_words"] and got[0] == f"w{r['doc_id']}_{r['first_word']}"
        words[r["doc_id"]] += len(got)
        slots[r["shard"], r["slot"]].append((r["part"], len(got)))
    assert {i: n for i, n in taken.items() if n} == dict(words)
    for parts in slots.values():  # gapless in every slot
        at = 0
        for part, n in sorted(parts):
            assert part == at
            at += n
        assert at <= 16


def test_reruns_agree_whatever_the_layout(spark):
    rows = texts(500, 9)
    df, _ = frame(spark, rows)
    one = sorted(map(tuple, mixing.Mix(df.repartition(1)).taken().collect()))
    assert one == sorted(map(tuple, mixing.Mix(df.repartition(7, "text")).taken().collect()))


def test_only_dataframe_functions(spark):
    plan = mixing.Mix(frame(spark, texts(50))[0]).taken()._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
