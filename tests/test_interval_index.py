"""The interval index against comparing all points with all intervals."""

import random
from collections import Counter

from pyspark.sql import functions as F

from tidemark.operators import asof

MIN, YEAR = 60_000_000, 365 * 86_400_000_000


def frames(spark, points, intervals):
    p = spark.createDataFrame(points, "k long, us long, symbol string").select("k", "symbol", F.timestamp_micros("us").alias("time"))
    i = spark.createDataFrame(intervals, "n long, a long, b long, symbol string").select("n", F.timestamp_micros("a").alias("start"), F.timestamp_micros("b").alias("end"), F.col("symbol").alias("of"))
    return p, i


def test_short_and_long_intervals_together(spark):
    r = random.Random(1)
    points = [(k, r.randrange(2 * YEAR), "s") for k in range(300)] + [(900 + k, 77 * MIN, "s") for k in range(20)] + [(999, None, "s")]
    intervals = []
    for n in range(200):
        a = r.choice([r.randrange(2 * YEAR), 77 * MIN, r.choice(points[:300])[1]])
        intervals.append((n, a, a + r.choice([0, 1, MIN, 90 * MIN, 86_400_000_000, YEAR, -5]), "s"))
    intervals += [(500, None, 5, "s"), (501, 5, None, "s"), (502, -YEAR, 3 * YEAR, "s")]
    p, i = frames(spark, points, intervals)
    got = Counter((x["k"], x["n"]) for x in asof.in_interval(p, i).select("k", "n").collect())
    want = Counter((k, n) for k, t, _ in points for n, a, b, _ in intervals if None not in (t, a, b) and a <= t <= b)
    assert got == want
    assert asof.in_interval(p, i.limit(0)).count() == 0 and asof.in_interval(p.limit(0), i).count() == 0


def test_cells_are_few_and_candidates_near_the_matches(spark):
    """Intervals of a minute and of a year: cells grow with the logarithm, and points meet hardly any in vain."""
    r = random.Random(2)
    intervals = [(n, a := r.randrange(YEAR), a + (YEAR if n % 2 else MIN), "s") for n in range(300)]
    points = [(k, r.randrange(2 * YEAR), "s") for k in range(500)]
    p, i = frames(spark, points, intervals)
    us = lambda c: F.unix_micros(F.col(c))
    cells = i.select("n", F.explode(asof.interval_cells(us("start"), us("end"))).alias("c")).select("n", "c.level", "c.cell")
    most = cells.groupBy("n").count().agg(F.max("count")).first()[0]
    assert most <= 2 * asof.FAN * 6
    seen = cells.collect()
    # cells of an interval are disjoint and cover just its steps
    for n, a, b, _ in intervals[:40]:
        steps = sorted((x["cell"] * asof.FAN ** x["level"], (x["cell"] + 1) * asof.FAN ** x["level"]) for x in seen if x["n"] == n)
        assert steps[0][0] == a // asof.UNIT_US and steps[-1][1] == b // asof.UNIT_US + 1
        assert all(x[1] == y[0] for x, y in zip(steps, steps[1:]))
    of = Counter((x["level"], x["cell"]) for x in seen)
    candidates = sum(of[level, t // (asof.UNIT_US * asof.FAN**level)] for _, t, _ in points for level in range(asof.LEVELS))
    matches = sum(a <= t <= b for _, t, _ in points for _, a, b, _ in intervals)
    assert matches <= candidates <= 1.01 * matches + 10


def test_slices_give_the_pairs_and_cells_are_no_pairs(spark, monkeypatch):
    """Crowded windows and ticks: pairs grow with the square, rows that a stream writes don't."""
    monkeypatch.setattr(asof, "SLICE", 7)
    r = random.Random(3)
    points = [(k, r.randrange(300 * MIN), "s") for k in range(200)] + [(900 + k, 77 * MIN, "s") for k in range(40)] + [(999, None, "s")]
    intervals = [(n, a := r.choice([r.randrange(300 * MIN), 60 * MIN]), a + r.choice([0, 20 * MIN, 45 * MIN, 9000 * MIN, -5]), "s") for n in range(300)] + [(500, None, 5, "s"), (501, 5, None, "s")]
    p, i = frames(spark, points, intervals)
    slices = asof.interval_slices(i)
    assert slices.agg(F.max(F.size("_held"))).first()[0] == 7
    found = asof.points_in_cells(p, slices)
    pairs = Counter((x["k"], x["n"]) for x in asof.pairs_of(found, slices).select("k", "n").collect())
    assert pairs == Counter((k, n) for k, t, _ in points for n, a, b, _ in intervals if None not in (t, a, b) and a <= t <= b)
    assert found.count() <= len(points) * asof.LEVELS < sum(pairs.values()) / 5
    none = asof.interval_slices(i.limit(0))
    assert asof.pairs_of(asof.points_in_cells(p, none), none).count() == 0


def test_a_crowded_cell_is_dealt_to_tasks_by_its_pairs(spark, monkeypatch, tmp_path):
    """All points and intervals in one cell: few bytes, many pairs. Tasks follow the pairs, and chunks of points share out what one key holds."""
    for name, few in (("SLICE", 16), ("CHUNK", 20), ("SHARE", 256)):
        monkeypatch.setattr(asof, name, few, raising=False)
    points = [(k, 77 * MIN + k % 3, "s") for k in range(200)] + [(900, 99 * MIN, "s"), (999, None, "s")]
    intervals = [(n, 77 * MIN, 77 * MIN + n % 4, "s") for n in range(30)] + [(500, 99 * MIN, 99 * MIN, "s"), (501, None, 5, "s")]
    p, i = frames(spark, points, intervals)
    slices = asof.interval_slices(i)
    asof.interval_counts(slices).write.parquet(f"{tmp_path}/counts")
    counts = spark.read.parquet(f"{tmp_path}/counts")
    assert {(x["_n"]) for x in counts.collect()} == {30, 1}
    pairs = asof.pairs_of(asof.points_in_cells(p, slices, counts=counts), slices).select("k", "n", F.spark_partition_id().alias("task")).collect()
    want = Counter((k, n) for k, t, _ in points for n, a, b, _ in intervals if None not in (t, a, b) and a <= t <= b)
    assert Counter((x["k"], x["n"]) for x in pairs) == want
    of = Counter(x["task"] for x in pairs)
    # 20 units of 10 chunks and 2 slices, each some 1/20 of the pairs, dealt by hash to 24 tasks
    assert len(of) >= 8 and max(of.values()) < sum(want.values()) / 3
