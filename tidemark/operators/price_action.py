"""Price action: regime, breakouts, microchannels, timeframe context, confluence, and their chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import by_time, clip, flag, nonzero, prev, rolling, rows, running, whole
from ..functions.indicators import true_range


def norm01(c: Column, causal: bool = False) -> Column:
    """Position between the smallest and the largest value of the whole series, or of the series so far."""
    w = running() if causal else whole()
    return (c - F.min(c).over(w)) / (F.max(c).over(w) - F.min(c).over(w) + 1e-9)


def _quantile(c: str, n: int, q: float, least: int) -> Column:
    return rolling(c, n, lambda x: F.percentile(x, F.lit(q)), least)


def _robust(df: DataFrame, c: str, out: str, n: int, least: int) -> DataFrame:
    """Distance from the rolling median in interquartile ranges."""
    return df.withColumn(out, (F.col(c) - _quantile(c, n, 0.5, least)) / nonzero(_quantile(c, n, 0.75, least) - _quantile(c, n, 0.25, least)))


def regime(df: DataFrame, atr_window: int = 14, width_window: int = 20, slope_window: int = 12, spike: float = 1.8, slope_thr: float = 0.20, lagged: bool = True, causal: bool = False) -> DataFrame:
    """Intensities of range, spike and channel in 0..1, the strongest as label.

    Norming by the whole series looks ahead, and so does filling a missing width with the median of
    all. causal=True norms by the series so far and fills with the last width.
    """
    half = lambda n: max(2, n // 2)
    df = df.withColumn("_tr", true_range()).withColumn("_atr", rolling("_tr", atr_window, F.avg, half(atr_window)))
    df = df.withColumn("_rel", (_quantile("close", width_window, 0.75, half(width_window)) - _quantile("close", width_window, 0.25, half(width_window))) / (F.col("_atr") + 1e-9))
    if causal:
        df = df.withColumn("_rel", F.last("_rel", True).over(running()))
    else:  # one number a symbol, from an aggregate instead of a window that holds the whole symbol
        middle = df.groupBy("symbol").agg(F.percentile("_rel", F.lit(0.5)).alias("_fill"))
        df = df.join(middle, "symbol").withColumn("_rel", F.coalesce("_rel", "_fill")).drop("_fill")
    df = df.withColumn("_ratio", F.col("_tr") / (F.col("_atr") + 1e-9)).withColumn("_d", F.col("close") - prev("close"))
    df = df.withColumn("_slope", rolling("_d", slope_window, F.sum, half(slope_window)))
    df = _robust(df, "_slope", "_z", slope_window, half(slope_window)).withColumn("_z", F.abs(clip(F.col("_z"), -2.0, 2.0)) / 2)
    df = df.withColumns({"_i0": clip(1 - norm01(F.col("_rel"), causal), 0.0, 1.0), "_i1": clip(clip(norm01(F.col("_ratio"), causal), 0.0, 1.0) + 0.25 * flag(F.col("_ratio") > spike), 0.0, 1.0), "_i2": clip(F.col("_z") + 0.15 * flag(F.col("_z") > slope_thr), 0.0, 1.0)})
    if lagged:
        df = df.withColumns({f"_i{k}": prev(f"_i{k}") for k in range(3)})
    names = ["range", "spike", "channel"]
    # a missing intensity wins, as the first of its kind
    first_null = F.coalesce(*[F.when(F.col(f"_i{k}").isNull(), F.lit(n)) for k, n in enumerate(names)])
    top = F.greatest("_i0", "_i1", "_i2")
    best = F.coalesce(*[F.when(F.col(f"_i{k}") == top, F.lit(n)) for k, n in enumerate(names)])
    df = df.withColumns({"regime_label": F.coalesce(first_null, best), "regime_confidence": F.coalesce(top, F.lit(0.0)), **{f"regime_{n}": F.coalesce(F.col(f"_i{k}"), F.lit(0.0)) for k, n in enumerate(names)}})
    return df.drop("_tr", "_atr", "_rel", "_ratio", "_d", "_slope", "_z", "_i0", "_i1", "_i2")


def breakouts(df: DataFrame, window: int = 20, least: int = 10, confirm: int = 1, retest: int = 10, fail: int = 5, lagged: bool = True) -> DataFrame:
    """Closes beyond the range of the bars before; later touches of and returns into the range look ahead."""
    hi, lo = rolling("high", window, F.max, least), rolling("low", window, F.min, least)
    df = df.withColumns({"range_upper": hi, "range_lower": lo})
    df = df.withColumns({"_u": prev("range_upper"), "_l": prev("range_lower")})
    df = df.withColumns({"_a": flag(F.col("close") > F.col("_u")), "_b": flag(F.col("close") < F.col("_l"))})
    df = df.withColumns({"breakout_up": flag(rolling("_a", confirm, F.min) == 1), "breakout_down": flag(rolling("_b", confirm, F.min) == 1)})
    up, down = F.col("breakout_up") == 1, F.col("breakout_down") == 1
    df = df.withColumns({
        "retest_up": flag(up & (F.min("low").over(rows(1, retest)) <= F.col("_u"))),
        "retest_down": flag(down & (F.max("high").over(rows(1, retest)) >= F.col("_l"))),
        "fail_break_up": flag(up & (F.min("close").over(rows(1, fail)) < F.col("_u"))),
        "fail_break_down": flag(down & (F.max("close").over(rows(1, fail)) > F.col("_l"))),
    })
    if lagged:
        df = df.withColumns({c: F.coalesce(prev(c), F.lit(0)) for c in ("breakout_up", "breakout_down", "retest_up", "retest_down", "fail_break_up", "fail_break_down")})
    return df.drop("_u", "_l", "_a", "_b")


def microchannels(df: DataFrame, min_len: int = 3, near: float = 0.2, lagged: bool = True) -> DataFrame:
    """Runs of bars that close near their extreme or keep moving it; quality is the mean of both signs over the run."""
    r = nonzero(F.col("high") - F.col("low"))
    df = df.withColumns({"_nh": flag((F.col("high") - F.col("close")) / r <= near), "_nl": flag((F.col("close") - F.col("low")) / r <= near), "_hl": flag(F.col("low") > prev("low")), "_lh": flag(F.col("high") < prev("high"))})
    df = df.withColumns({"_n": F.row_number().over(by_time()), "_up": F.greatest("_nh", "_hl"), "_dn": F.greatest("_nl", "_lh")})
    # the length of a run is the distance to the last row that broke it
    df = df.withColumns({f"_len{d}": F.col("_n") - F.coalesce(F.last(F.when(F.col(d) == 0, F.col("_n")), True).over(running()), F.lit(0)) for d in ("_up", "_dn")})
    df = df.withColumns({f"_s{a}": F.sum(a).over(running()) for a in ("_nh", "_hl", "_nl", "_lh")})
    up = (F.col("_len_up") >= min_len) & (F.col("_len_up") >= F.col("_len_dn"))
    down = ~up & (F.col("_len_dn") >= min_len)
    run_break = {d: F.struct(*[F.col(f"_s{a}").alias(a) for a in ("_nh", "_hl", "_nl", "_lh")]) for d in ("_up", "_dn")}
    df = df.withColumns({f"_at{d}": F.last(F.when(F.col(d) == 0, run_break[d]), True).over(running()) for d in ("_up", "_dn")})
    share = lambda d, a: (F.col(f"_s{a}") - F.coalesce(F.col(f"_at{d}")[a], F.lit(0))) / F.col(f"_len{d}")
    quality = F.when(up, 0.5 * share("_up", "_nh") + 0.5 * share("_up", "_hl")).when(down, 0.5 * share("_dn", "_nl") + 0.5 * share("_dn", "_lh")).otherwise(0.0)
    df = df.withColumns({"micro_channel_up": flag(up), "micro_channel_down": flag(down), "micro_channel_len": F.when(up, F.col("_len_up")).when(down, F.col("_len_dn")).otherwise(0), "micro_channel_quality": clip(quality, 0.0, 1.0)})
    if lagged:
        df = df.withColumns({c: F.coalesce(prev(c), F.lit(0)) for c in ("micro_channel_up", "micro_channel_down", "micro_channel_len", "micro_channel_quality")})
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def soft_bias(df: DataFrame, out: str, col: str = "close", window: int = 8, bound: float = 2.0) -> DataFrame:
    """Short slope in interquartile ranges, clipped to -1..1."""
    least = max(2, window // 2)
    df = df.withColumn("_d", F.col(col) - prev(col)).withColumn("_g", rolling("_d", window, F.sum, least))
    return _robust(df, "_g", "_z", window, least).withColumn(out, clip(F.col("_z"), -bound, bound) / bound).drop("_d", "_g", "_z")


def mtf_context(df: DataFrame, higher: DataFrame | None = None, base_window: int = 8, higher_window: int = 8, lagged: bool = True) -> DataFrame:
    """Bias of the base and of the higher timeframe (as of its bars' ends), conflict, confluence, strength."""
    from .asof import asof

    df = soft_bias(df, "mtf_bias_local", window=base_window)
    if higher is None:
        df = soft_bias(df, "mtf_bias", window=higher_window)
    else:
        df = asof(df, soft_bias(higher, "mtf_bias", window=higher_window).select("symbol", "time", "mtf_bias"), ["mtf_bias"])
    local, far = F.coalesce("mtf_bias_local", F.lit(0.0)), F.coalesce("mtf_bias", F.lit(0.0))
    df = df.withColumns({"mtf_conflict": flag(F.signum(local) * F.signum(far) < 0), "mtf_confluence_score": clip(1 - F.abs(local - far) / 2, 0.0, 1.0), "mtf_strength": clip(F.abs(F.col("mtf_bias")), 0.0, 1.0)})
    if lagged:
        df = df.withColumns({c: prev(c) for c in ("mtf_bias", "mtf_bias_local", "mtf_conflict", "mtf_confluence_score", "mtf_strength")})
    df = df.withColumns({"mtf_conflict": F.coalesce("mtf_conflict", F.lit(0)), "mtf_confluence_score": F.coalesce("mtf_confluence_score", F.lit(0.5)), "mtf_strength": F.coalesce("mtf_strength", F.lit(0.0))})
    return df.withColumn("mtf_meta_coverage", F.avg(F.when(F.col("mtf_bias").isNotNull() & F.col("mtf_bias_local").isNotNull(), 1.0).otherwise(0.0)).over(Window.partitionBy("symbol")))


#: Weights of a confluence score's baskets and of their columns.
BASKETS = {"structure": 0.30, "zones": 0.30, "imbalance": 0.20, "mtf": 0.20, "extras": 0.00}
STRUCTURE = {"bos_up": 0.5, "bos_down": 0.5, "choch_up": 0.35, "choch_down": 0.35}
EXTRAS = {
    "regime_channel": 0.45, "regime_spike": 0.25, "regime_range": -0.20,
    "breakout_up": 0.20, "breakout_down": 0.20, "retest_up": 0.10, "retest_down": 0.10,
    "fail_break_up": -0.15, "fail_break_down": -0.15,
    "micro_channel_up": 0.15, "micro_channel_down": 0.15, "micro_channel_quality": 0.20,
}


def near01(c: str) -> Column:
    """1 at distance 0, falling with the distance; 0 without one."""
    return F.coalesce(1.0 / (1.0 + F.abs(F.col(c))), F.lit(0.0))


def confluence(df: DataFrame, weights: dict[str, float] | None = None, strong: float = 0.7, keep: float = 0.35, lagged: bool = True, extras_mode: str = "shared") -> DataFrame:
    """Five baskets in 0..1 and their weighted score; a missing column counts as 0.

    extras_mode "shared" norms all weights to 1; "additive" norms the first four and adds the extras.
    """
    have = set(df.columns)
    total = lambda table: sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * w for c, w in table.items() if c in have), F.lit(0.0))
    unit = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    s = unit(total(STRUCTURE)) if set(STRUCTURE) <= have else F.lit(0.0)
    if "swing_type" in have:
        s = unit(s + F.when(F.col("swing_type").isin("HH", "LL"), 0.15).otherwise(0.0))
    z = unit(sum((near01(c) * 0.6 for c in ("dist_to_sd", "dist_to_ob") if c in have), F.lit(0.0)))
    i = unit(sum((near01(c) * 0.6 for c in ("dist_to_fvg_mid",) if c in have), F.lit(0.0)) + total({"sweep_up": 0.25, "sweep_down": 0.25}))
    m = F.coalesce(F.col("mtf_confluence_score"), F.lit(0.5)) * 0.8 if "mtf_confluence_score" in have else F.lit(0.0)
    if "mtf_conflict" in have:
        m = unit(m - F.when(F.col("mtf_conflict") > 0, 0.5).otherwise(0.0))
    if "mtf_strength" in have:
        m = unit(m + F.coalesce(F.col("mtf_strength"), F.lit(0.0)) * 0.2)
    parts = {"structure": s, "zones": z, "imbalance": i, "mtf": m, "extras": unit(total(EXTRAS))}
    df = df.withColumns({f"conf_components_{k}": v for k, v in parts.items()})
    w = BASKETS | (weights or {})
    norm = sum(w.values()) if extras_mode == "shared" else sum(v for k, v in w.items() if k != "extras")
    score = sum((F.col(f"conf_components_{k}") * (w[k] / max(1e-9, norm) if extras_mode == "shared" or k != "extras" else w[k]) for k in parts), F.lit(0.0))
    df = df.withColumn("conf_score", unit(score))
    df = df.withColumns({"conf_flag_strong_entry": flag(F.col("conf_score") >= strong), "conf_flag_filter_pass": flag(F.col("conf_score") >= keep)})
    if lagged:
        df = df.withColumns({c: prev(c) for c in [*[f"conf_components_{k}" for k in parts], "conf_score", "conf_flag_strong_entry", "conf_flag_filter_pass"]})
    return df.withColumns({"conf_score": F.coalesce("conf_score", F.lit(0.5)), "conf_flag_strong_entry": F.coalesce("conf_flag_strong_entry", F.lit(0)), "conf_flag_filter_pass": F.coalesce("conf_flag_filter_pass", F.lit(0))})


def confluence_signals(df: DataFrame, weights: dict[str, float] | None = None, strong: float = 0.7, keep: float = 0.5, lagged: bool = True) -> DataFrame:
    """Confluence of signals in 0..1 that are there already, with hard limits; a missing column counts as 0.

    The flags follow the score of their own row, score and components are those of the row before.
    """
    have, unit = set(df.columns), lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    total = lambda *names: sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names if c in have), F.lit(0.0))
    parts = {"structure": unit(total("pa_structure_1", "pa_structure_2", "pa_structure_3") / 3), "zones": unit(total("pa_zone_1", "pa_zone_2") / 2), "imbalance": unit(total("pa_imbalance")), "mtf": unit(total("pa_mtf")), "extras": F.greatest(total("rg_signal", "bo_signal", "mc_signal"), F.lit(0.0))}
    df = df.withColumns({f"conf_components_{k}": v for k, v in parts.items()})
    w = BASKETS | (weights or {})
    df = df.withColumn("conf_score", unit(sum((F.col(f"conf_components_{k}") * w[k] for k in parts), F.lit(0.0))))
    df = df.withColumns({"conf_flag_strong_entry": flag(F.col("conf_score") > strong), "conf_flag_filter_pass": flag(F.col("conf_score") > keep)})
    return df.withColumns({c: prev(c) for c in ["conf_score", *[f"conf_components_{k}" for k in parts]]}) if lagged else df


def zone_features(df: DataFrame) -> DataFrame:
    """Distances to supply/demand and order-block zones in ATR."""
    from .zones import lifecycle, order_block, supply_demand

    df = lifecycle(order_block(lifecycle(supply_demand(df), "sd")), "ob")
    mid = lambda n: (F.col(f"{n}_active_top") + F.col(f"{n}_active_bottom")) / 2
    return df.withColumns({f"dist_to_{n}": F.abs(F.col("close") - mid(n)) / nonzero(F.col("atr")) for n in ("sd", "ob")})


def imbalance_features(df: DataFrame) -> DataFrame:
    """Distance to the live gap's middle in ATR, and sweeps by side."""
    from .zones import fvg, lifecycle, liq_sweep

    df = liq_sweep(lifecycle(fvg(df), "fvg"))
    mid = (F.col("fvg_active_top") + F.col("fvg_active_bottom")) / 2
    side = prev(F.when(F.col("ls_top").isNotNull(), F.when(F.col("high") == F.col("ls_top"), -1).otherwise(1)))
    return df.withColumns({"dist_to_fvg_mid": F.abs(F.col("close") - mid) / nonzero(F.col("atr")), "sweep_up": flag((F.col("ls_born") == 1) & (side == 1)), "sweep_down": flag((F.col("ls_born") == 1) & (side == -1))})


def price_action(bars: DataFrame, higher: DataFrame | None = None, **zigzag_params) -> DataFrame:
    """All stages: structure, zones, imbalance, regime, breakouts, microchannels, context, confluence."""
    from ..functions.indicators import atr
    from .zigzag import market_structure, zigzag

    df = market_structure(zigzag(bars, **zigzag_params)).withColumnRenamed("label", "swing_type")
    df = imbalance_features(zone_features(atr(df, 14)))
    return confluence(mtf_context(microchannels(breakouts(regime(df))), higher))
