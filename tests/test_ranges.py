"""Ranges of long symbols against whole symbols: same values, ranges of near equal size, borders anywhere."""

from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import indicators as ind
from tidemark.functions.frames import KEY, TIME
from tidemark.operators import ranges, sequential
from tidemark.operators.asof import asof
from tidemark.operators.scan import ewm

SCHEMA = "symbol string, time timestamp, close double, high double, low double, open double, volume long"


def bars(spark, sizes, seed=0, holes=0.0):
    r = np.random.default_rng(seed)
    out = []
    for s, n in sizes.items():
        # rows crowd: half of them lie in a fiftieth of the time
        at = np.unique(np.concatenate([r.integers(0, 50_000_000, n), r.integers(0, 1_000_000, n)]))[: n * 2]
        at = np.sort(r.choice(at, min(n, len(at)), replace=False))
        c = 100 + np.cumsum(r.normal(0, 1, len(at)))
        rows = pd.DataFrame({"symbol": s, "time": pd.Timestamp("2024-01-01") + pd.to_timedelta(at, unit="s"), "close": c, "high": c + 1, "low": c - 1, "open": c, "volume": 1})
        rows.loc[r.random(len(at)) < holes, "close"] = np.nan
        out.append(rows)
    df = spark.createDataFrame(pd.concat(out).sample(frac=1, random_state=2), SCHEMA)
    return df.withColumn("close", F.when(~F.isnan("close"), F.col("close")))


def frame(df, cols):
    return df.select("symbol", "time", *cols).orderBy("symbol", "time").toPandas()


def same(a, b):
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-9)


@pytest.mark.parametrize("fn, reach, cols", [
    (lambda d: ind.sma(d, n=20), 20, ["sma"]),
    (lambda d: ind.bbands(d, n=12), 12, ["bb_mid", "bb_up", "bb_low"]),
    (lambda d: ind.stoch(d, n=14, d=3), 20, ["stoch_k", "stoch_d"]),
    (lambda d: ind.roc(ind.wma(d, n=9), n=5), 20, ["wma", "roc"]),
])
def test_bounded_operators(spark, fn, reach, cols):
    df = bars(spark, {"A": 3000, "B": 700, "C": 5, "D": 1}, holes=0.05)
    same(frame(ranges.over_ranges(df, fn, reach, rows=150), cols), frame(fn(df), cols))


def test_means_cross_borders(spark):
    df = bars(spark, {"A": 2500, "B": 40, "C": 1}, 4, holes=0.3)
    want = {"fast": ("close", 0.2), "slow": (F.col("high") - F.col("low") + F.col("close"), 0.01)}
    same(frame(ranges.ewm_over_ranges(df, want, rows=100), list(want)), frame(ewm(df, want), list(want)))


def test_asof_crosses_borders(spark):
    left = bars(spark, {"A": 2000, "B": 30, "Z": 4}, 5)
    right = bars(spark, {"A": 25, "B": 3, "Y": 5}, 6).withColumn("volume", F.when(F.col("high") > 100, F.col("volume")))
    for tolerance in (None, 40_000_000_000):
        got = ranges.asof_over_ranges(left, right, ["close", "volume"], prefix="r_", tolerance_us=tolerance, rows=80)
        same(frame(got, ["r_close", "r_volume"]), frame(asof(left, right, ["close", "volume"], prefix="r_", tolerance_us=tolerance), ["r_close", "r_volume"]))


def test_ranges_are_even_in_order_and_large_enough(spark):
    df = ranges.cut(bars(spark, {"A": 20_000, "B": 10}, 7), 30, 1000)
    parts = df.groupBy("symbol", ranges.PART).agg(F.count("*").alias("n"), F.min("time").alias("a"), F.max("time").alias("z")).orderBy("symbol", ranges.PART).toPandas()
    a = parts[parts["symbol"] == "A"]
    assert 15 <= len(a) <= 25 and a["n"].max() < 2200 and a["n"].min() >= 30
    assert list(a[ranges.PART]) == list(range(len(a))) and (a["a"].iloc[1:].to_numpy() > a["z"].iloc[:-1].to_numpy()).all()


def test_odd_rows(spark):
    """One time for all rows, null times, null symbols, nothing."""
    day = datetime(2024, 1, 1)
    rows = [("A", day, float(i)) for i in range(50)] + [(None, day, 1.0), ("A", None, 2.0)]
    df = spark.createDataFrame([(s, t, c, c, c, c, 1) for s, t, c in rows], SCHEMA)
    assert ranges.cut(df, 1, 10).count() == 52
    assert ranges.cut(df, 1, 10).where("symbol = 'A'").select(ranges.PART).distinct().count() <= 2
    assert ranges.over_ranges(df, lambda d: ind.sma(d, n=3), 3, rows=10).count() == 52
    assert ranges.ewm_over_ranges(df.limit(0), {"x": ("close", 0.1)}).count() == 0


def test_one_symbol_of_a_million_rows_lies_in_many_tasks(spark):
    """Means and as-of joins of one symbol: at least eight ranges, none over twice the mean, and the values of a closed form."""
    n = 1_000_000
    df = spark.range(n).select(F.lit("A").alias(KEY), F.timestamp_seconds(F.col("id") * 60).alias(TIME), (F.col("id") % 7).cast("double").alias("close"))
    sizes = [r["count"] for r in ranges.cut(df, 20, 100_000).groupBy(ranges.PART).count().collect()]
    assert len(sizes) >= 8 and max(sizes) < 2 * n / len(sizes)
    sma = ranges.over_ranges(df, lambda d: ind.sma(d, n=7), 7, 100_000)
    assert sma.where("sma is null").count() == 6 and sma.where("abs(sma - 3) > 1e-9").count() == 0
    mean = ranges.ewm_over_ranges(df, {"e": ("close", 0.5)}, 100_000)
    i = F.unix_seconds(TIME) / 60
    again = mean.select(F.col("e"), i.cast("long").alias("i"), "close").where("i >= 100")
    # after a hundred rows the mean has the period of the values
    assert again.groupBy(F.col("i") % 7).agg((F.max("e") - F.min("e")).alias("d")).where("d > 1e-9").count() == 0
    right = df.where(F.col("close") == 0).withColumn("v", F.unix_seconds(TIME) / 60)
    found = ranges.asof_over_ranges(df, right, ["v"], rows=100_000)
    assert found.where(F.col("v") != F.floor(F.unix_seconds(TIME) / 60 / 7) * 7).count() == 0 and found.where("v is null").count() == 0


@pytest.mark.parametrize("warm", [3, 40, 400])
def test_speculated_blocks_equal_the_loop(spark, warm):
    """Short warm-ups guess wrong at many seams; those ranges run again."""
    df = bars(spark, {"A": 4000, "B": 300, "C": 2}, 11)
    same(frame(sequential.psar_over_ranges(df, warm=warm, rows=250), ["sar"]), frame(sequential.psar(df), ["sar"]))
    same(frame(sequential.supertrend_over_ranges(df, warm=warm, rows=250), ["supertrend"]), frame(sequential.supertrend(df), ["supertrend"]))


def test_only_wrong_seams_run_again(spark, monkeypatch):
    df, ran = bars(spark, {"A": 5000}, 12), []
    plain = sequential.stored
    monkeypatch.setattr(sequential, "stored", lambda d: (plain(d), ran.append(d.columns))[0])
    got = frame(sequential.psar_over_ranges(df, warm=400, rows=500), ["sar"])
    same(got, frame(sequential.psar(df), ["sar"]))
    assert sum("_round" in c for c in ran) <= 3  # one run, and few again
