"""Operators against step-by-step versions, and properties that hold for all of them."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import indicators as ind
from tidemark.operators import asof, learning, levels, news, scan, sequential, zigzag
from tidemark.operators.scan import affine_scan, ewm
from tidemark.plans import config, search, spec
from tidemark.sources import bars as src
from tidemark.sources import store
from tidemark.streaming import live, positions

T0 = dt.datetime(2024, 1, 1)


def walk(n, seed, symbol="a"):
    rng = random.Random(seed)
    rows, price = [], 100.0
    for i in range(n):
        o, c = price, price + rng.gauss(0, 1)
        rows.append((symbol, T0 + dt.timedelta(hours=4 * (i + 1)), o, max(o, c) + rng.random(), min(o, c) - rng.random(), c, rng.randint(1, 50)))
        price = c
    return rows


@pytest.fixture(scope="module")
def bars(spark):
    rows = walk(300, 1, "a") + walk(280, 2, "b")
    return spark.createDataFrame(rows, "symbol string, time timestamp, open double, high double, low double, close double, volume long").cache()


def series(df, cols, symbol="a"):
    return df.where(F.col("symbol") == symbol).orderBy("time").select(*cols).toPandas()


@pytest.mark.parametrize("block,fan,chunk", [(7, 3, 2), (40, 256, 16), (1000, 4, 5)])
def test_scan_equals_loop(spark, monkeypatch, block, fan, chunk):
    """Varying maps, resets, rows without a value, uneven times, several symbols and one of a single row."""
    monkeypatch.setattr(scan, "FAN", fan)
    monkeypatch.setattr(scan, "CHUNK", chunk)
    rng = random.Random(block)
    rows = []
    for symbol, n in (("a", 400), ("b", 57), ("c", 1)):
        at = T0
        for _ in range(n):
            at += dt.timedelta(minutes=rng.choice([1, 1, 1, 5, 3000]))
            rows.append((symbol, at, rng.choice([0.0, 0.5, 0.9, 1.0]), None if rng.random() < 0.2 else rng.gauss(0, 1), rng.gauss(0, 1)))
    df = spark.createDataFrame(rows, "symbol string, time timestamp, a double, b double, f double")
    got = {(r["symbol"], r["time"]): (r["y"], r["z"]) for r in affine_scan(df, {"y": (F.col("a"), F.col("b")), "z": (F.lit(0.3), F.col("b"), F.col("f"))}, block=block).collect()}
    assert len(got) == len(rows)
    y, z, last = None, None, None
    for symbol, at, a, b, f in rows:
        if symbol != last:
            y, z, last = None, None, symbol
        if b is not None:
            y, z = (b if y is None else a * y + b), (f if z is None else 0.3 * z + b)
        assert got[symbol, at] == (None, None) if y is None else got[symbol, at] == pytest.approx((y, z), abs=1e-12)


def test_scan_of_one_long_symbol(spark):
    """Two million rows of one symbol: 8,000 blocks, chained in groups."""
    n = 2_000_000
    df = spark.range(0, n, 1, 8).select(F.lit("a").alias("symbol"), F.timestamp_micros(F.col("id") * 1_000_000).alias("time"), F.col("id").cast("double").alias("x"))
    got = ewm(df, {"e": ("x", 0.1)}).agg(F.count("e").alias("n"), F.max_by("e", "time").alias("last"), F.sum("e").alias("s")).first()
    # the mean of a line lags behind it by (1 - alpha) / alpha
    assert got["n"] == n and got["last"] == pytest.approx(n - 1 - 9, abs=1e-6)


def test_means_of_several_operators_are_one_scan(bars, monkeypatch):
    asked = []
    plain = scan.ewm
    monkeypatch.setattr(scan, "ewm", lambda df, means: (asked.append(len(means)), plain(df, means))[1])
    f = spec.run_specs(bars, ["ema(close,20)", "ema(close,5)", "rsi(14)", "atr(14)", "macd(close,12,26,9)", "keltner(20)", "dema(close,10)"], "H4")
    # one scan for all first means, one for macd's signal and dema's second mean
    assert asked == [10, 2]
    alone = ind.macd(ind.rsi(ind.ema(bars, n=5)))
    want = series(alone, ["ema", "rsi", "macd_signal"])
    got = series(f, ["`__ema@H4__ema_close_5`", "`__rsi@H4__rsi_14`", "`__macd@H4__macd_signal_close_12_26_9`"])
    assert np.allclose(got.to_numpy(float), want.to_numpy(float), atol=1e-9, equal_nan=True)


def test_ewm_equals_pandas(bars):
    got = series(ewm(bars, {"e": ("close", 2 / 21)}), ["close", "e"])
    assert np.allclose(got["e"], got["close"].ewm(span=20, adjust=False).mean(), atol=1e-9)


def test_indicator_bounds(bars):
    df = ind.wr(ind.stoch(ind.rsi(ind.bbands(ind.macd(ind.atr(bars))))))
    p = series(df, ["rsi", "wr", "atr", "bb_low", "bb_mid", "bb_up", "macd", "macd_signal", "macd_hist", "stoch_k"]).dropna()
    assert len(p) > 200
    assert p["rsi"].between(0, 100).all() and p["wr"].between(-100, 0).all() and p["stoch_k"].between(0, 100).all() and (p["atr"] > 0).all()
    assert ((p["bb_low"] <= p["bb_mid"]) & (p["bb_mid"] <= p["bb_up"])).all()
    assert np.allclose(p["macd_hist"], p["macd"] - p["macd_signal"])


CAUSAL = [n for n, o in spec.REGISTRY.items() if o.causal and not o.aliases]


@pytest.mark.parametrize("part", range(12))
def test_later_bars_change_nothing(spark, bars, part):
    """Every operator tagged causal gives the same on a prefix; several are chained in one plan."""
    names = sorted(CAUSAL)[part::12]
    cut = T0 + dt.timedelta(hours=4 * 200)
    full = spec.run_specs(bars, names, "H4").where(F.col("time") <= cut).toPandas().sort_values(["symbol", "time"]).reset_index(drop=True)
    head = spec.run_specs(bars.where(F.col("time") <= cut), names, "H4").toPandas().sort_values(["symbol", "time"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(full, head[full.columns], check_exact=False, atol=1e-8, check_dtype=False)


def test_symbols_do_not_mix(bars):
    names = ["sma(20)", "rsi(14)", "sar", "supertrend(10,3)", "sr_fusion", "obv"]
    both = spec.run_specs(bars, names, "H4").where("symbol = 'b'").toPandas().sort_values("time").reset_index(drop=True)
    alone = spec.run_specs(bars.where("symbol = 'b'"), names, "H4").toPandas().sort_values("time").reset_index(drop=True)
    pd.testing.assert_frame_equal(both, alone[both.columns], check_dtype=False)


def test_all_specs_add_columns(bars):
    for name in spec.REGISTRY:
        p = spec.plan([name], "H4")
        out = spec.compute(bars, p.groups["H4"], "H4")
        assert [c for c in out.columns if c.startswith(f"__{name}@H4__")], name
    assert len(spec.REGISTRY) >= 76


def test_parser():
    s = spec.parse("bbands(close, 20, 2)@h1")
    assert (s.name, s.args, s.timeframe) == ("bbands", ("close", 20, 2), "H1")
    assert spec.bind(s) == {"col": "close", "n": 20, "k": 2}
    assert spec.bind(spec.parse("supertrend(10,3)")) == {"period": 10, "multiplier": 3}
    s = spec.parse("fib_cluster(tf=[H1,H4], tol_pct=0.1, ok=true, m='x,y')")
    assert dict(s.kwargs) == {"tf": ("H1", "H4"), "tol_pct": 0.1, "ok": True, "m": "x,y"} and s.timeframe is None
    for bad in ("", "1x", "sma(", "sma)@"):
        with pytest.raises(ValueError):
            spec.parse(bad)
    with pytest.raises(KeyError):
        spec.plan(["nonsense(3)"], "H4")
    assert spec.plan(["nonsense(3)", "sma(5)", "sma(5)"], "H4", strict=False).groups == {"H4": [spec.parse("sma(5)")]}
    assert spec.plan(["obv", "sma(5)"], "H4", has_volume=False).skipped == {"obv": "no volume"}


def test_higher_timeframe_is_closed_before_use(bars):
    """A higher bar's value appears at its end, so ticks after that change nothing before."""
    a = spec.run_specs(bars, ["sma(close,2)@D1"], "H4")
    changed = bars.withColumn("close", F.when(F.col("time") > T0 + dt.timedelta(days=20), F.col("close") + 50).otherwise(F.col("close")))
    b = spec.run_specs(changed, ["sma(close,2)@D1"], "H4")
    c = "__sma@D1__sma_close_2"
    before = F.col("time") <= T0 + dt.timedelta(days=20)
    x = series(a.where(before).withColumnRenamed(c, "v"), ["v"])["v"]
    y = series(b.where(before).withColumnRenamed(c, "v"), ["v"])["v"]
    assert x.equals(y)
    plan = a._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def slow_zigzag(high, low, depth, margin, backstep):
    """The same rules, one bar and one map at a time."""
    n = len(high)
    lows, highs = [0.0] * n, [0.0] * n
    for i in range(depth - 1, n):
        v = min(low[i - depth + 1 : i + 1])
        if low[i] - v <= margin:
            for j in range(max(0, i - backstep), i):
                if lows[j] and lows[j] > v:
                    lows[j] = 0.0
        if low[i] == v:
            lows[i] = v
        v = max(high[i - depth + 1 : i + 1])
        if v - high[i] <= margin:
            for j in range(max(0, i - backstep), i):
                if highs[j] and highs[j] < v:
                    highs[j] = 0.0
        if high[i] == v:
            highs[i] = v
    state, mode, at = [0] * n, 0, -1
    for i in range(depth - 1, n):
        h, lo = highs[i], lows[i]
        if mode == 0 and h:
            state[i], mode, at = -1, -1, i
        elif mode == 0 and lo:
            state[i], mode, at = 1, 1, i
        elif mode == 1 and lo and lo < low[at] and not h:
            state[at], state[i], at = 0, 1, i
        elif mode == 1 and h:
            state[i], mode, at = -1, -1, i
        elif mode == -1 and h and h > high[at] and not lo:
            state[at], state[i], at = 0, -1, i
        elif mode == -1 and lo:
            state[i], mode, at = 1, 1, i
    return state


def test_zigzag_rules(spark):
    """Against the step-by-step rules, on six walks and on one of few prices, which has many ties and bars that are both."""
    held = {f"s{seed}": walk(400, seed) for seed in range(6)}
    held["ties"] = [(*r[:3], *(float(round(x / 2)) for x in r[3:5]), *r[5:]) for r in walk(400, 9)]
    df = spark.createDataFrame([(k, T0 + dt.timedelta(hours=i), *map(float, r[2:6]), 1) for k, rows in held.items() for i, r in enumerate(rows)], "symbol string, time timestamp, open double, high double, low double, close double, volume long")
    for depth, backstep in ((5, 3), (12, 10), (3, 0)):
        got = zigzag.zigzag(df, depth, 5.0, backstep, 0.01).toPandas().sort_values("time").groupby("symbol")["zz_state"].apply(list)
        for k, rows in held.items():
            assert got[k] == slow_zigzag([float(r[3]) for r in rows], [float(r[4]) for r in rows], depth, 0.05, backstep), (k, depth)
    turns = [x for x in got["s0"] if x]
    assert len(turns) > 10 and all(a != b for a, b in zip(turns, turns[1:], strict=False))


def test_structure_labels(bars):
    p = series(zigzag.market_structure(zigzag.zigzag(bars, 5, 5.0, 3)), ["zz_state", "zz_high", "zz_low", "label", "bos_up", "choch_up", "regime"])
    last = {}
    for r in p[p["zz_state"] != 0].itertuples():
        x = r.zz_high if r.zz_state == -1 else r.zz_low
        want = None
        if r.zz_state in last and x != last[r.zz_state]:
            want = ("HH" if x > last[r.zz_state] else "LH") if r.zz_state == -1 else ("HL" if x > last[r.zz_state] else "LL")
        assert (r.label or None) == want
        last[r.zz_state] = x
    assert set(p["regime"]) <= {-1, 0, 1}


def test_leg_fill(bars):
    z = zigzag.zigzag(bars, 5, 5.0, 3)
    leg = zigzag.legs(z).where("symbol = 'a'").toPandas()
    p = series(zigzag.support_resistance(z), ["pos", "support", "resistance"])
    for r in p.itertuples():
        own = leg[(leg["start_pos"] <= r.pos) & (r.pos < leg["end_pos"])]
        want = own.iloc[-1] if len(own) else None
        assert (want is None and math.isnan(r.support) and math.isnan(r.resistance)) or (want["start_extr"] == (r.support if want["direction"] == 1 else r.resistance))


def slow_clusters(levels_, tol):
    out, left = [], sorted(levels_)
    while left:
        base = left[0]
        own = [p for p in left if abs(p - base) <= base * tol / 100]
        out.append((min(own), max(own), len(own)))
        left = left[len(own) :]
    return out


def test_clusters_are_anchored(spark):
    rng = random.Random(3)
    prices = [100 + rng.random() * 5 for _ in range(80)]
    df = spark.createDataFrame([("a", rng.choice(["H1", "H4"]), 0.618, p) for p in prices], "symbol string, tf string, ratio double, price double")
    got = sorted((r["price_min"], r["price_max"], r["members"]) for r in levels.clusters(df, 0.3).collect())
    assert got == slow_clusters(prices, 0.3)


def test_asof_keeps_nulls_of_the_matched_row(spark):
    left = spark.createDataFrame([("a", T0 + dt.timedelta(hours=h)) for h in (0, 1, 2, 3)], "symbol string, time timestamp")
    right = spark.createDataFrame([("a", T0 + dt.timedelta(hours=1), 5.0), ("a", T0 + dt.timedelta(hours=2), None)], "symbol string, time timestamp, v double")
    assert [r["v"] for r in asof.asof(left, right, ["v"]).orderBy("time").collect()] == [None, 5.0, None, None]


def test_sequential_warm_up(bars):
    p = series(sequential.psar(sequential.supertrend(bars, 10)), ["sar", "supertrend", "close"])
    assert p["sar"].isna().sum() == 2 and p["supertrend"].isna().sum() == 10


def test_resampling_right_closed(spark):
    rows = [("a", T0 + dt.timedelta(hours=h), 1.0 * h, 1.0 * h, 1.0 * h, 1.0 * h, 1) for h in (1, 4, 5, 8)]
    b = spark.createDataFrame(rows, "symbol string, time timestamp, open double, high double, low double, close double, volume long")
    got = src.resample(b, "H4").orderBy("time").collect()
    assert [(r["time"], r["open"], r["close"], r["volume"]) for r in got] == [(T0 + dt.timedelta(hours=4), 1.0, 4.0, 2), (T0 + dt.timedelta(hours=8), 5.0, 8.0, 2)]
    week = src.resample(b, "W1").first()["time"]
    assert week == dt.datetime(2024, 1, 7)  # a Sunday


def test_raw_files(spark, tmp_path):
    (tmp_path / "x.csv").write_text("Time,Open,High,Low,Close,Tick_Volume\n2024-01-01 00:00:00,1,2,0.5,bad,7\n2024-01-01 00:00:00,1,2,0.5,1.5,8\n,1,1,1,1,1\n")
    rows = src.read_raw(spark, f"file://{tmp_path}/x.csv", "EURUSD", "M1").collect()
    assert [(r["close"], r["volume"], r["spread"]) for r in rows] == [(1.5, 8, None)]
    src.write_candles(src.read_raw(spark, f"file://{tmp_path}/x.csv", "EURUSD", "M1"), f"file://{tmp_path}/store")
    assert spark.read.parquet(f"file://{tmp_path}/store/symbol=EURUSD/tf=M1").count() == 1
    with pytest.raises(ValueError):
        src.read_raw(spark, "x.txt", "EURUSD", "M1")
    src.write_json(spark, f"file://{tmp_path}/m.json", {"rows": 1})
    assert (tmp_path / "m.json").read_text() == '{"rows": 1}'


def test_calendar_forms(spark):
    raw = spark.createDataFrame([("A", "usd", "01-05-2024", "8:30am", "High"), ("B", "", "01-06-2024", "All Day", "Holiday"), ("C", "EUR", None, "8:30am", "Low")], "Title string, Country string, Date string, Time string, Impact string")
    rows = sorted(map(tuple, news.normalise(raw, "America/New_York").select("title", "time_utc", "currency", "impact", "window_before_min").collect()))
    assert rows == [("A", dt.datetime(2024, 1, 5, 13, 30), "USD", "high", 30), ("B", dt.datetime(2024, 1, 6, 5, 0), None, "low", 0)]
    assert news.currencies_of("EURUSD") == ["EUR", "USD"] and news.currencies_of("XAUUSD") == ["USD"]


def test_simulator_stops_and_costs():
    close = [100, 100, 101, 103, 90, 90, 90, 90]
    out = learning.simulate_one([c + 1 for c in close], [c - 1 for c in close], close, [1] * 8, [2.0] * 8, cooldown=2, cost=0.01, sl=1.5, tp=10.0)
    assert out[0][0] == 1 and out[0][1] == pytest.approx(-0.01)
    assert [o[5] for o in out][4] == "stop" and out[4][0] == 0
    assert [o[0] for o in out[4:7]] == [0, 0, 0] and out[7][0] == 1  # re-entry after the cooldown
    assert out[-1][2] == pytest.approx(sum(o[1] for o in out))


def test_representation_and_obs(spark):
    df = spark.createDataFrame([("a", T0 + dt.timedelta(hours=i), float(v)) for i, v in enumerate([1, 1, 1, 2, 3, 4, 5, 6, 7])], "symbol string, time timestamp, x double")
    got = [r["x"] for r in learning.representation(df, {"x": "ordinal3"}).orderBy("time").collect()]
    want = pd.qcut(pd.Series([1, 1, 1, 2, 3, 4, 5, 6, 7]), 3, labels=False, duplicates="drop").tolist()
    assert got == want
    first = learning.observation(df, ["x"], 3).orderBy("time").first()["obs"]
    assert first == [[0.0], [0.0], [1.0]]


def test_session_split(spark, bars):
    rows = learning.ratio_split(bars, 0.5, 0.25, "America/New_York").where("symbol = 'a'").orderBy("time").collect()
    first_val = next(r["time"] for r in rows if r["split"] == "val")
    assert (first_val.hour, first_val.minute) in ((0, 0),)  # 17:00 in New York is 22:00 UTC, the next H4 bar is midnight
    order = [r["split"] for r in rows]
    assert order == sorted(order, key=["train", "val", "test"].index)


def test_config():
    merged = config.layered({"a": {"x": 2}, "b": 1}, bases=[{"a": {"x": 1, "y": 1}}], overlays=[{"b": 3}])
    assert merged == {"a": {"x": 2, "y": 1}, "b": 3}
    assert config.env_overrides(merged, {"BOT_A_X": "7", "B": "off"}) == {"a": {"x": 7, "y": 1}, "b": "off"}
    assert config.deep_get(config.deep_set({}, "a.b", 1), "a.b") == 1
    assert config.validate(merged, {"a.x": int, "q": str}, strict=False) == ["q"]
    draw = config.sample({"n": {"type": "int", "low": 1, "high": 5}, "f": {"type": "float", "low": 0, "high": 1}, "c": {"type": "choice", "values": [3]}}, 1, {"m": "max(n, 2) * 2"})
    assert draw == config.sample({"n": {"type": "int", "low": 1, "high": 5}, "f": {"type": "float", "low": 0, "high": 1}, "c": {"type": "choice", "values": [3]}}, 1, {"m": "max(n, 2) * 2"}) and draw["m"] == max(draw["n"], 2) * 2
    with pytest.raises(ValueError):
        config.formula("__import__('os')", {})


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, T0 + dt.timedelta(minutes=rng.randrange(4000)), rng.choice("ab"), rng.random() * 100) for i in range(3000)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double")
    df.repartition(3).write.parquet(f"file://{tmp_path}/in")
    s = live.stream_bars(spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/in"), "H1", late="3 days")
    q = live.journal(s, f"file://{tmp_path}/out", f"file://{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    want = {tuple(r) for r in src.ticks_to_bars(df, "H1").select("symbol", "time", "open", "high", "low", "close", "volume").collect()}
    assert got <= want


def test_position_rules():
    """A long that reaches break-even, trails, never falls back, and is scaled out; decided every second step."""
    rules = {"every": 2, "even_r": 1.0, "trail": 1.0, "scale": ((2.0, 0.5),)}
    state, seen = None, []
    for price in (100, 104, 111, 112, 125, 126, 105, 105):
        state, r, event = positions.follow(state, float(price), 5.0, 1, 10.0, 1.0, **rules)
        seen.append((round(r, 2), state[1], state[2], event))
    assert seen == [(0.0, 90.0, 1.0, ""), (0.4, 90.0, 1.0, ""), (1.1, 106.0, 1.0, "breakeven,trail"), (1.2, 106.0, 1.0, ""), (2.5, 120.0, 0.5, "trail,scale"), (2.6, 120.0, 0.5, ""), (0.5, 120.0, 0.5, ""), (0.5, 120.0, 0.5, "")]
    short, _, event = positions.follow((100.0, 110.0, 1.0, False, 3, 0), 85.0, 5.0, -1, 10.0, 1.0, **rules)
    assert short[1] == 90.0 and event == "breakeven,trail"


def test_search_and_configuration(spark, tmp_path):
    best, trials = search.search(spark, lambda p: spark.createDataFrame([(float(p["n"]),)], "x double"), lambda df: df.agg((-F.abs(F.max("x") - 7)).alias("value")), {"n": {"type": "int", "low": 1, "high": 20}}, 12, 3)
    held = trials.collect()
    assert len(held) == 12 and max(r["value"] for r in held) == -abs(best["n"] - 7)
    assert search.tune(lambda v: v / 10, 9.0, 0.2, 0.3, 1.0, -1) == 3.0 and search.tune(lambda v: 0.25, 9.0, 0.2, 0.3, 1.0) == 9.0
    cfg = search.apply({}, {"pa.breakouts.range_window": 30, "pa.confluence.weights": [0.4, 0.3, 0.2, 0.1], "other": 1})
    assert cfg == {"features": {"price_action_params": {"breakouts": {"range_window": 30}, "confluence": {"weights": {"structure": 0.4, "zones": 0.3, "imbalance": 0.2, "mtf": 0.1}}}}}
    assert search.component(cfg, "breakouts", {"range_window": 9, "x": 1}) == {"range_window": 9, "x": 1}
    assert search.spread_of({"trading": {"costs": {"spread_pts": -3}}}) == {"use_series": False, "value": 0.0, "source": "config_costs"}
    assert search.spread_of({"evaluation": {"backtest": {"reuse_historical_spread": True}}}, ["time", "M1_Spread"])["column"] == "M1_Spread"
    assert search.news_windows({"safety": {"news_filter": {"medium_impact_freeze_minutes_before": 7}}})["medium"] == (7, 10)
    with pytest.raises(FileNotFoundError):
        store.read_processed(spark, f"file://{tmp_path}/none.parquet")
    df = spark.createDataFrame([("a", T0, 1.5)], "symbol string, time timestamp, pnl double")
    for form in ("csv", "json"):
        assert store.save_trades(df, f"file://{tmp_path}/{form}", form).collect() == df.collect()
    assert store.sidecar(df, f"file://{tmp_path}/side.json", symbol="a")["rows"] == 1


def test_calendar_headers_with_signs(spark):
    raw = spark.createDataFrame([("A", "usd", "2024-01-05", "8:30am", "***", "1", "2")], "`Event ` string, `CCY.` string, Date string, Time string, `Impact (Actual)` string, `Actual*` string, `Exp.` string")
    r = news.normalise(raw).first()
    assert (r["title"], r["currency"], r["impact"], r["actual"], r["forecast"]) == ("A", "USD", "high", "1", "2")


@pytest.mark.parametrize("text", ["", "(3)", "3x(1)", "sma(1", "sma(1)x", "sma@", "sma(1)@", "sma(1)@H 4", "sma)1(", "a b"])
def test_no_specification(text):
    with pytest.raises(ValueError):
        spec.parse(text)


def test_specifications():
    s = spec.parse(" SMA ( close , 20 ) @ h4 ")
    assert (s.name, s.args, s.timeframe) == ("sma", ("close", 20), "H4")
    assert spec.parse("x(a='(,)', b=[1, 2])").kwargs == (("a", "(,)"), ("b", (1, 2)))
    assert spec.parse("obv").args == () and spec.parse("obv@M5").timeframe == "M5"
