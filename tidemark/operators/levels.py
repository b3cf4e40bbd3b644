"""Price levels: pivots, round numbers, daily ranges, overlap scores, swings and Fibonacci levels."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import flag, nonzero, prev, rows

RATIOS = (0.236, 0.382, 0.5, 0.618, 0.786)
EXTENSIONS = (1.272, 1.618, 2.0)
#: Weights of timeframes in a cluster's score.
TF_WEIGHTS = {"M1": 1.0, "M5": 1.2, "M15": 1.4, "M30": 1.6, "H1": 1.8, "H4": 2.0, "D1": 2.3, "W1": 2.6, "MN1": 3.0}


def pivots(df: DataFrame) -> DataFrame:
    """Classic pivot and three supports and resistances from the bar before."""
    h, lo, c = prev("high"), prev("low"), prev("close")
    df = df.withColumns({"_h": h, "_lo": lo, "pv_p": (h + lo + c) / 3})
    p, hi, low = F.col("pv_p"), F.col("_h"), F.col("_lo")
    return df.withColumns({"pv_r1": 2 * p - low, "pv_s1": 2 * p - hi, "pv_r2": p + (hi - low), "pv_s2": p - (hi - low), "pv_r3": hi + 2 * (p - low), "pv_s3": low - 2 * (hi - p)}).drop("_h", "_lo")


def round_levels(df: DataFrame, step: float = 10.0, n: int = 5) -> DataFrame:
    """Nearest of 2n+1 levels around the round level next to the first close; a closed form, no level table."""
    first = F.first("close").over(Window.partitionBy("symbol").orderBy("time"))
    base = F.floor(first / step + 0.5) * step
    k = F.least(F.greatest(F.ceil((F.col("close") - base) / step - 0.5), F.lit(-n)), F.lit(n))
    df = df.withColumn("round_level", base + k * step)
    return df.withColumn("round_dist", F.abs(F.col("close") - F.col("round_level")))


def _day(c: str, tz: str) -> Column:
    return F.to_date(F.from_utc_timestamp(F.col(c).cast("timestamp"), tz))


def adr(df: DataFrame, window: int = 14, tz: str = "UTC") -> DataFrame:
    """Mean range of earlier days: one row a day and symbol, then as of each bar's day."""
    daily = df.groupBy("symbol", _day("time", tz).alias("_day")).agg((F.max("high") - F.min("low")).alias("_r"))
    w = Window.partitionBy("symbol").orderBy("_day").rowsBetween(-window, -1)
    daily = daily.withColumn("adr", F.when(F.count("_r").over(w) >= max(2, window // 2), F.avg("_r").over(w))).drop("_r")
    return df.withColumn("_day", _day("time", tz)).join(daily, ["symbol", "_day"], "left").drop("_day")


def adr_distance_to_open(df: DataFrame, window: int = 14, tz: str = "UTC") -> DataFrame:
    w = Window.partitionBy("symbol", _day("time", tz)).orderBy("time")
    df = adr(df, window, tz).withColumn("day_open", F.first("close").over(w))
    return df.withColumn("dist_abs", F.abs(F.col("close") - F.col("day_open"))).withColumn("dist_pct_of_adr", 100 * F.col("dist_abs") / nonzero(F.col("adr")))


def overlap_simple(price: Column, levels: Column, tol: float = 0.05) -> Column:
    """Nearness of the nearest level in 0..1, and a tenth for each further one within the tolerance."""
    width = F.abs(price) * tol
    dist = F.transform(levels, lambda v: F.abs(price - v))
    within = F.size(F.filter(dist, lambda d: d <= width))
    score = 1 - F.array_min(dist) / nonzero(width) + 0.1 * (within - 1)
    return F.when((F.coalesce(F.size(levels), F.lit(0)) > 0) & (within > 0) & (width > 0), F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))).otherwise(0.0)


def overlap(price: Column, levels: Column, tol: float = 0.05, weights: Column | None = None) -> Column:
    """A steep curve for the nearest level, plus the weighted nearness of the others within the tolerance."""
    width = F.abs(price) * tol
    w = weights if weights is not None else F.transform(levels, lambda _: F.lit(1.0))
    each = F.zip_with(levels, w, lambda v, k: F.struct(F.abs(price - v).alias("d"), k.alias("w")))
    each = F.transform(each, lambda x, i: F.struct(x["d"].alias("d"), i.alias("i"), x["w"].alias("w")))
    best = F.array_min(each)
    near = F.filter(each, lambda x: (x["d"] <= width) & (x["i"] != best["i"]))
    rest = F.aggregate(near, F.lit(0.0), lambda a, x: a + (1 - x["d"] / width) * x["w"])
    base = best["w"] / (1 + F.exp(-12 * ((1 - best["d"] / width) - 0.5)))
    return F.when((F.coalesce(F.size(levels), F.lit(0)) > 0) & (width > 0) & (best["d"] <= width), F.least(F.lit(1.0), F.greatest(F.lit(0.0), base + rest))).otherwise(0.0)


def sr_distance(df: DataFrame, level: str = "support", atr: str = "atr") -> DataFrame:
    return df.withColumn("sr_distance", (F.col("close") - F.col(level)) / (F.col(atr) + 1e-8))


def swings(df: DataFrame, k: int = 5, prominence: float | None = None, atr_mult: float | None = None, col: str = "close") -> DataFrame:
    """Rows (symbol, time, price, kind): extremes over k bars on both sides, ties included; not causal by k."""
    before, behind, p = rows(-k, -1), rows(1, k), F.col(col)
    whole = (F.count(p).over(before) == k) & (F.count(p).over(behind) == k)
    df = df.withColumns({"_hi": whole & (p >= F.max(p).over(before)) & (p >= F.max(p).over(behind)), "_lo": whole & (p <= F.min(p).over(before)) & (p <= F.min(p).over(behind)), "_pl": F.abs(p - prev(col)), "_pr": F.abs(p - prev(col, -1))})
    ok = F.lit(True)
    if prominence:
        ok = ok & (F.col("_pl") >= prominence) & (F.col("_pr") >= prominence)
    if atr_mult and "atr" in df.columns:
        ok = ok & F.coalesce(F.greatest("_pl", "_pr") >= atr_mult * F.col("atr"), F.lit(True))
    kinds = F.filter(F.array(F.when(F.col("_hi"), F.lit("H")), F.when(F.col("_lo"), F.lit("L"))), lambda x: x.isNotNull())
    cols = ["symbol", "time", p.alias("price"), *(["atr"] if "atr" in df.columns else [])]
    return df.where((F.col("_hi") | F.col("_lo")) & ok).select(*cols, F.explode(kinds).alias("kind"))


def swing_legs(sw: DataFrame, max_legs: int | None = None, min_length_pct: float = 0.0) -> DataFrame:
    """Legs between neighbouring swings of different kind, newest first if limited to max_legs."""
    w = Window.partitionBy("symbol").orderBy("time", "kind")
    leg = sw.select("symbol", F.lag("time").over(w).alias("from_time"), F.col("time").alias("to_time"), F.lag("price").over(w).alias("p0"), F.col("price").alias("p1"), F.lag("kind").over(w).alias("k0"), F.col("kind").alias("k1"))
    leg = leg.where("k0 is not null and k0 <> k1 and p0 <> p1").withColumn("leg_up", F.col("p1") > F.col("p0"))
    leg = leg.withColumn("length_pct", 100 * F.abs(F.col("p1") - F.col("p0")) / F.abs(F.col("p0"))).where(F.col("length_pct") >= min_length_pct)
    if max_legs:
        last = Window.partitionBy("symbol").orderBy(F.col("to_time").desc(), F.col("from_time").desc())
        leg = leg.withColumn("leg_rank", F.row_number().over(last)).where(F.col("leg_rank") <= max_legs)
    return leg.drop("k0", "k1")


def leg_levels(leg: DataFrame, ratios: tuple[float, ...] = RATIOS) -> DataFrame:
    """Retracement prices of legs: from the low up for rising ones, from the high down for falling ones."""
    r = leg.withColumn("ratio", F.explode(F.array(*[F.lit(float(x)) for x in ratios])))
    low, high = F.least("p0", "p1"), F.greatest("p0", "p1")
    return r.withColumn("price", F.when(F.col("leg_up"), high - F.col("ratio") * (high - low)).otherwise(low + F.col("ratio") * (high - low)))


def golden_zone(levels: DataFrame, ratios: tuple[float, float] = (0.382, 0.618)) -> DataFrame:
    """The prices nearest to two ratios in each symbol, as a band."""
    at = lambda r: F.min_by("price", F.struct(F.abs(F.col("ratio") - r), F.col("price")))
    out = levels.groupBy("symbol").agg(at(ratios[0]).alias("_a"), at(ratios[1]).alias("_b"))
    return out.select("symbol", F.least("_a", "_b").alias("golden_low"), F.greatest("_a", "_b").alias("golden_high"))


def ext_targets(leg: DataFrame, ratios: tuple[float, ...] = EXTENSIONS, sl_atr: Column | None = None, sl_mult: float = 1.5) -> DataFrame:
    """Extension targets of legs (p0, p1, leg_up) with entry at the leg's end, and reward over risk."""
    low, high = F.least("p0", "p1"), F.greatest("p0", "p1")
    x = leg.withColumn("ratio", F.explode(F.array(*[F.lit(float(r)) for r in ratios])))
    x = x.withColumn("target", F.when(F.col("leg_up"), high + F.col("ratio") * (high - low)).otherwise(low - F.col("ratio") * (high - low)))
    risk = sl_mult * sl_atr if sl_atr is not None else F.abs(F.col("p1") - F.col("p0"))
    return x.withColumn("rr", F.abs(F.col("target") - F.col("p1")) / nonzero(risk))


def abc_projections(sw: DataFrame, ratios: tuple[float, ...] = (0.618, 1.0, 1.272, 1.618)) -> DataFrame:
    """Projections of AB from C for each three neighbouring swings."""
    w = Window.partitionBy("symbol").orderBy("time", "kind")
    x = sw.select("symbol", F.col("time"), F.lag("price", 2).over(w).alias("a"), F.lag("price").over(w).alias("b"), F.col("price").alias("c")).where("a is not null")
    return x.withColumn("ratio", F.explode(F.array(*[F.lit(float(r)) for r in ratios]))).withColumn("price", F.col("c") + F.col("ratio") * (F.col("b") - F.col("a")))


CLUSTER = "symbol string, price_mean double, price_min double, price_max double, members int, tfs array<string>, ratios array<double>, score double, sr_score double, trend_score double"


def clusters(levels: DataFrame, tol_pct: float = 0.08, prefer: float = 0.618, weights: dict[str, float] | None = None, w_trend: float = 10.0, w_rsi: float = 10.0, w_sr: float = 10.0) -> DataFrame:
    """Greedy clusters of levels(symbol, tf, ratio, price[, trend, rsi, sr]) along the price.

    A cluster takes what lies within tol_pct of its first member, so neighbours don't chain: the
    walk depends on where the last cluster began, one small pandas function a symbol. trend, rsi
    (-1..1), sr (array of levels) and tol_pct, if there, are values of the symbol.
    """
    weights = weights or TF_WEIGHTS

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["price", "tf", "ratio"], kind="stable").reset_index(drop=True)
        n_tf = pdf["tf"].nunique()
        tol = pdf["tol_pct"].iloc[0] if "tol_pct" in pdf else tol_pct
        trend = pdf["trend"].dropna().iloc[0] if "trend" in pdf and pdf["trend"].notna().any() else None
        rsi = pdf["rsi"].dropna().iloc[0] if "rsi" in pdf and pdf["rsi"].notna().any() else None
        trend_score = math.tanh(abs(trend)) if trend is not None else 0.0
        rsi_score = (rsi + 1) / 2 if rsi is not None else 0.5
        out, price, start = [], pdf["price"].to_numpy(float), 0
        while start < len(pdf):
            end = start
            while end < len(pdf) and abs(price[end] - price[start]) <= price[start] * tol / 100:
                end += 1
            end = max(end, start + 1)
            part = pdf.iloc[start:end]
            tfs, ratios = list(dict.fromkeys(part["tf"])), sorted(set(part["ratio"]))
            tight = min(1.0, max(0.0, 1 - (price[end - 1] - price[start]) / (price[start] * 0.01 + 1e-9)))
            near = 1 - min(1.0, min(abs(r - prefer) for r in ratios))
            score = 50 * sum(weights.get(t, 1.0) for t in tfs) / (n_tf + 1e-9) + 30 * near + 20 * tight + w_trend * trend_score + w_rsi * rsi_score
            out.append((pdf["symbol"].iloc[0], part["price"].mean(), price[start], price[end - 1], end - start, tfs, ratios, score, 0.0, trend_score))
            start = end
        return pd.DataFrame(out, columns=[c.split()[0] for c in CLUSTER.split(", ")])

    out = levels.groupBy("symbol").applyInPandas(run, CLUSTER)
    if "sr" in levels.columns:
        sr = levels.groupBy("symbol").agg(F.first("sr", True).alias("_sr"))
        out = out.join(sr, "symbol", "left").withColumn("sr_score", overlap(F.col("price_mean"), F.col("_sr"))).drop("_sr")
        out = out.withColumn("score", F.col("score") + w_sr * F.col("sr_score"))
    return out


def adaptive_tolerance(df: DataFrame, mode: str = "FIXED", fixed_pct: float = 0.08, mult: float = 1.0) -> DataFrame:
    """(symbol, tol_pct): a fixed tolerance, or the last ATR or ADR over the last close; fixed where there is none."""
    col = {"ATR": "atr", "ADR": "adr"}.get(mode.upper())
    if col is None:
        return df.groupBy("symbol").agg(F.lit(fixed_pct).alias("tol_pct"))
    last = df.groupBy("symbol").agg(F.max_by("close", "time").alias("_c"), F.max_by(col, F.when(F.col(col).isNotNull(), F.col("time"))).alias("_r"))
    return last.select("symbol", F.coalesce(F.col("_r") / F.greatest(F.col("_c"), F.lit(1e-9)) * mult, F.lit(fixed_pct)).alias("tol_pct"))


def attach_abc(df: DataFrame, sw: DataFrame, ratios: tuple[float, ...] = (1.0, 1.618)) -> DataFrame:
    """Bars with the projections of their symbol's last three swings; the swings come from all data (not causal)."""
    p = abc_projections(sw, ratios)
    last = p.groupBy("symbol").agg(*[F.max_by("price", F.when(F.col("ratio") == r, F.col("time"))).alias(f"abc_{str(r).replace('.', '_')}") for r in ratios])
    return df.join(last, "symbol", "left")


def top_zones(cl: DataFrame, k: int = 10, min_members: int = 1, min_score: float | None = None) -> DataFrame:
    """The k best clusters of each symbol."""
    cl = cl.where(F.col("members") >= min_members)
    if min_score is not None:
        cl = cl.where(F.col("score") >= min_score)
    w = Window.partitionBy("symbol").orderBy(F.col("score").desc(), "price_mean")
    return cl.withColumn("zone_rank", F.row_number().over(w)).where(F.col("zone_rank") <= k)


def trade_zones(cl: DataFrame, context: DataFrame, k: int = 5, sl: float = 1.5, tp: float = 2.0, near_pct: float = 0.20) -> DataFrame:
    """Zones with stops, targets and reward over risk; context(symbol, price, atr), atr null: mean zone width."""
    z = top_zones(cl, k).join(context, "symbol")
    z = z.withColumns({"zone_low": F.col("price_min"), "zone_high": F.col("price_max"), "zone_mid": (F.col("price_min") + F.col("price_max")) / 2, "zone_width": F.col("price_max") - F.col("price_min")})
    z = z.withColumn("_a", F.when(F.col("atr") > 0, F.col("atr")).otherwise(F.avg("zone_width").over(Window.partitionBy("symbol"))))
    band = F.col("price") * near_pct / 100
    z = z.withColumns({"distance_to_price": F.abs(F.col("zone_mid") - F.col("price")), "within_proximity": F.col("price").between(F.col("zone_low") - band, F.col("zone_high") + band), "long_sl": F.col("zone_low") - sl * F.col("_a"), "long_tp": F.col("zone_high") + tp * F.col("_a"), "short_sl": F.col("zone_high") + sl * F.col("_a"), "short_tp": F.col("zone_low") - tp * F.col("_a")})
    p = F.col("price")
    return z.withColumns({"long_rr": (F.col("long_tp") - p) / nonzero(p - F.col("long_sl")), "short_rr": (p - F.col("short_tp")) / nonzero(F.col("short_sl") - p)}).drop("_a")


def nearest_cluster(df: DataFrame, cl: DataFrame, k: int = 20) -> DataFrame:
    """For each bar the nearest of its symbol's k best clusters; the clusters come from all data (not causal)."""
    best = top_zones(cl, k).groupBy("symbol").agg(F.collect_list(F.struct("price_mean", "price_min", "price_max", "members", "score")).alias("_cl"))
    out = df.join(best, "symbol", "left").withColumn("_n", F.array_min(F.transform("_cl", lambda x: F.struct(F.abs(F.col("close") - x["price_mean"]).alias("d"), x["price_mean"].alias("price_mean"), x["price_min"].alias("price_min"), x["price_max"].alias("price_max"), x["members"].alias("members"), x["score"].alias("score")))))
    return out.withColumns({"fib_dist": F.col("_n.d"), "fib_level": F.col("_n.price_mean"), "fib_members": F.col("_n.members"), "fib_score": F.col("_n.score"), "fib_inside": flag(F.col("close").between(F.col("_n.price_min"), F.col("_n.price_max")))}).drop("_cl", "_n")


def rsi_score(rsi: Column, mid: float = 50.0, half: float = 20.0) -> Column:
    """A triangle: 1 at mid, 0 half a band away."""
    return F.greatest(F.lit(0.0), 1 - F.abs(rsi - mid) / half)


def enhanced_score(score: Column, slope: Column, adr_: Column, weight: float = 10.0) -> Column:
    return score + weight * F.tanh(F.abs(slope) / nonzero(adr_))


def fractal_levels(df: DataFrame, k: int = 5, n: int = 10) -> DataFrame:
    """(symbol, levels): the last n swing prices of each symbol, sorted."""
    w = Window.partitionBy("symbol").orderBy(F.col("time").desc(), "kind")
    s = swings(df, k).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n)
    return s.groupBy("symbol").agg(F.sort_array(F.collect_set("price")).alias("levels"))


def multi_tf_levels(frames: dict[str, DataFrame], k: int = 3, max_legs: int = 3) -> DataFrame:
    """Levels (symbol, tf, ratio, price) of the last legs in several timeframes."""
    out = None
    for tf, df in frames.items():
        part = leg_levels(swing_legs(swings(df, k), max_legs)).select("symbol", F.lit(tf).alias("tf"), "ratio", "price", "leg_up")
        out = part if out is None else out.unionByName(part)
    return out


def fibo_pipeline(frames: dict[str, DataFrame], base_tf: str, tol_pct: float = 0.3) -> DataFrame:
    """Levels of all timeframes, context of the base one (slope, RSI, swing levels), clusters."""
    from ..functions.indicators import ma_slope, rsi

    base = rsi(ma_slope(frames[base_tf]))
    last = Window.partitionBy("symbol").orderBy(F.col("time").desc())
    context = base.withColumn("_n", F.row_number().over(last)).where("_n = 1").select("symbol", F.col("ma_slope").alias("trend"), F.when(F.col("rsi") >= 70, 1.0).when(F.col("rsi") <= 30, -1.0).otherwise(0.0).alias("rsi"))
    context = context.join(fractal_levels(frames[base_tf]).withColumnRenamed("levels", "sr"), "symbol", "left")
    return clusters(multi_tf_levels(frames).join(context, "symbol", "left"), tol_pct)


