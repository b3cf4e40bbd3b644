"""Candlestick patterns: integer flags from the bar and the bars before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import flag, nonzero, prev, rolling
from .indicators import atr


def _c(name: str) -> Column:
    return F.col(name)


def body() -> Column:
    return _c("close") - _c("open")


def size() -> Column:
    return F.abs(body())


def span_() -> Column:
    return _c("high") - _c("low")


def upper() -> Column:
    return _c("high") - F.greatest("open", "close")


def lower() -> Column:
    return F.least("open", "close") - _c("low")


def _flags(df: DataFrame, name: str, bull: Column, bear: Column) -> DataFrame:
    return df.withColumns({f"{name}_bull": flag(bull), f"{name}_bear": flag(bear)})


def _mean_body(df: DataFrame) -> DataFrame:
    """_mb: mean body of 20 bars, from the fifth on."""
    return df.withColumn("_sz", size()).withColumn("_mb", nonzero(rolling("_sz", 20, F.avg, 5)))


def engulf(df: DataFrame) -> DataFrame:
    pb, po, pc = prev(body()), prev("open"), prev("close")
    return _flags(df, "engulf", (pb < 0) & (_c("close") > po) & (_c("open") < pc), (pb > 0) & (_c("close") < po) & (_c("open") > pc))


def doji(df: DataFrame, atr_ratio: float = 0.1, range_ratio: float = 0.2, atr_win: int = 14) -> DataFrame:
    """Small body against ATR and against the bar's own range."""
    df = atr(df, atr_win, "_atr", "classic")
    return df.withColumn("doji", flag((size() / nonzero(_c("_atr")) <= atr_ratio) & (size() / nonzero(span_()) <= range_ratio))).drop("_atr")


def pin(df: DataFrame, ratio: float = 2.0) -> DataFrame:
    return _flags(df, "pin", (lower() >= ratio * size()) & (upper() <= size()), (upper() >= ratio * size()) & (lower() <= size()))


def hammer_star(df: DataFrame, min_body: float = 0.0, wick: float = 2.0, opposite: float = 1.25) -> DataFrame:
    ok = size() / nonzero(span_()) >= min_body
    return _flags(df, "hammer_star", (lower() >= wick * size()) & (upper() <= opposite * size()) & ok, (upper() >= wick * size()) & (lower() <= opposite * size()) & ok)


def harami(df: DataFrame) -> DataFrame:
    po, pc = prev("open"), prev("close")
    inside = (F.least("open", "close") >= F.least(po, pc)) & (F.greatest("open", "close") <= F.greatest(po, pc))
    return _flags(df, "harami", (body() > 0) & (pc < po) & inside, (body() < 0) & (pc > po) & inside)


def inside_outside(df: DataFrame, min_range: float = 0.0, atr_win: int = 14) -> DataFrame:
    df = atr(df, atr_win, "_atr", "classic")
    ok = (span_() >= min_range * nonzero(_c("_atr"))) if min_range > 0 else F.lit(True)
    ph, pl = prev("high"), prev("low")
    return df.withColumns({"inside_bar": flag((_c("high") <= ph) & (_c("low") >= pl) & ok), "outside_bar": flag((_c("high") >= ph) & (_c("low") <= pl) & ok)}).drop("_atr")


def marubozu(df: DataFrame, wick: float = 0.1) -> DataFrame:
    small = (upper() + lower()) / nonzero(span_()) <= wick
    return _flags(df, "marubozu", (body() > 0) & small, (body() < 0) & small)


def tweezer(df: DataFrame, tol: float | None = 0.001, tol_k: float | None = None, atr_win: int = 14) -> DataFrame:
    """Equal highs or lows within a share of the price: tol, or tol_k times ATR over the mid price."""
    df = atr(df, atr_win, "_atr", "classic")
    share = F.lit(tol) if tol_k is None else tol_k * nonzero(_c("_atr")) / nonzero((_c("high") + _c("low")) / 2)
    ph, pl = prev("high"), prev("low")
    return df.withColumns({"tweezer_top": flag(F.abs(_c("high") - ph) <= share * F.abs(ph)), "tweezer_bottom": flag(F.abs(_c("low") - pl) <= share * F.abs(pl))}).drop("_atr")


def soldiers_crows(df: DataFrame, min_body: float = 0.2) -> DataFrame:
    df = _mean_body(df)
    strong = size() / _c("_mb") >= min_body
    df = df.withColumns({"_u": flag((body() > 0) & strong), "_d": flag((body() < 0) & strong)})
    three = lambda c: (_c(c) == 1) & (prev(c) == 1) & (prev(c, 2) == 1)
    return _flags(df, "three", three("_u"), three("_d")).drop("_sz", "_mb", "_u", "_d")


def star(df: DataFrame, small: float = 0.3, atr_win: int = 14) -> DataFrame:
    df = atr(df, atr_win, "_atr", "classic")
    b1, b2 = prev(body(), 2), prev(body())
    calm, mid = F.abs(b2) / nonzero(_c("_atr")) <= small, (prev("open", 2) + prev("close", 2)) / 2
    return df.withColumns({"morning_star": flag((b1 < 0) & calm & (body() > 0) & (_c("close") > mid)), "evening_star": flag((b1 > 0) & calm & (body() < 0) & (_c("close") < mid))}).drop("_atr")


def piercing_dark(df: DataFrame, min_body: float = 0.2) -> DataFrame:
    df = _mean_body(df)
    o1, c1 = prev("open"), prev("close")
    mid, ok = (o1 + c1) / 2, (F.abs(c1 - o1) / _c("_mb") >= min_body) & (size() / _c("_mb") >= min_body)
    up = (c1 < o1) & (body() > 0) & (_c("close") >= mid) & (_c("open") < c1) & ok
    down = (c1 > o1) & (body() < 0) & (_c("close") <= mid) & (_c("open") > c1) & ok
    return df.withColumns({"piercing": flag(up), "dark_cloud": flag(down)}).drop("_sz", "_mb")


def belt(df: DataFrame, wick: float = 0.1) -> DataFrame:
    r = nonzero(span_())
    return _flags(df, "belt", ((_c("open") - _c("low")) / r <= wick) & (body() > 0), ((_c("high") - _c("open")) / r <= wick) & (body() < 0))


def scaled(scale: float, rules: list[tuple[str, float, float | None, float | None]], given: dict | None = None) -> dict:
    """Parameters derived from one scale: factor times scale within bounds, unless given."""
    out = dict(given or {})
    for name, factor, low, high in rules:
        if out.get(name) is None:
            value = factor * scale
            out[name] = min(value if high is None else high, max(value, low if low is not None else value))
    return out


def abcd(swings: DataFrame, tol: float = 0.05) -> DataFrame:
    """AB=CD on the last four swings of each symbol: swings(symbol, time, price)."""
    from pyspark.sql import Window

    w = Window.partitionBy("symbol").orderBy(F.col("time").desc())
    last = swings.withColumn("_n", F.row_number().over(w)).where("_n <= 4").groupBy("symbol").agg(*[F.max(F.when(F.col("_n") == n, F.col("price"))).alias(p) for n, p in ((4, "a"), (3, "b"), (2, "c"), (1, "d"))])
    ab, cd = _c("b") - _c("a"), _c("d") - _c("c")
    return last.withColumn("cd_ab", F.abs(cd) / nonzero(F.abs(ab))).withColumn("abcd", flag((F.abs(_c("cd_ab") - 1) <= tol) & (F.signum(ab) == F.signum(cd))))
