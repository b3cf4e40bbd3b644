"""Support and resistance zones: five detectors, one lifecycle, and their fusion.

A detector adds <name>_born, <name>_top and <name>_bottom. The lifecycle looks at the zones of the
last `alive` bars and is written once for all of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import flag, last_rows, nonzero, prev, rolling, rows, running
from ..functions.indicators import atr
from .scan import ewm, span

ANY = lambda cs: reduce(lambda a, b: a | b, cs)


def _late(c: str) -> Column:
    return F.coalesce(prev(c), F.lit(0))


def fvg(df: DataFrame, lookback: int = 2, min_size: float = 0.5) -> DataFrame:
    """Fair value gap: this bar's low over the high `lookback` bars ago by a share of ATR, or mirrored."""
    ph, pl, need = prev("high", lookback), prev("low", lookback), F.col("atr") * min_size
    df = df.withColumns({"_bull": flag((F.col("low") > ph) & (F.col("low") - ph >= need)), "_bear": flag((F.col("high") < pl) & (pl - F.col("high") >= need))})
    df = df.withColumns({"fvg_top": F.when(F.col("_bull") == 1, F.col("low")).when(F.col("_bear") == 1, pl), "fvg_bottom": F.when(F.col("_bull") == 1, ph).when(F.col("_bear") == 1, F.col("high"))})
    return df.withColumns({"fvg_up": _late("_bull"), "fvg_dn": _late("_bear"), "fvg_born": flag(F.col("fvg_top").isNotNull())}).drop("_bull", "_bear")


def supply_demand(df: DataFrame, base_len: int = 3, base_max: float = 0.6, impulse_min: float = 1.2) -> DataFrame:
    """Some calm bars, then a wide one; the zone is born a bar later with the bounds of that bar's base."""
    df = df.withColumn("_ratio", (F.col("high") - F.col("low")) / nonzero(F.col("atr"))).withColumn("_calm", flag(F.col("_ratio") <= base_max))
    df = df.withColumn("_base", flag(F.sum("_calm").over(last_rows(base_len)) == base_len)).withColumn("_raw", flag((prev("_base") == 1) & (F.col("_ratio") >= impulse_min)))
    df = df.withColumn("sd_born", _late("_raw"))
    born = F.col("sd_born") == 1
    return df.withColumns({"sd_top": F.when(born, rolling("high", base_len, F.max)), "sd_bottom": F.when(born, rolling("low", base_len, F.min))}).drop("_ratio", "_calm", "_base", "_raw")


def order_block(df: DataFrame, body_min: float = 0.6, wick_max: float = 0.6, bos_lookback: int = 5) -> DataFrame:
    """The last solid opposite candle, born when price breaks the recent extreme."""
    size = F.abs(F.col("close") - F.col("open"))
    wick = F.greatest(F.col("high") - F.col("low") - size, F.lit(0.0))
    solid = (size / nonzero(F.col("atr")) >= body_min) & (wick / nonzero(size) <= wick_max)
    body = F.struct(F.col("open").alias("o"), F.col("close").alias("c"))
    recent = rows(-bos_lookback, -1)
    df = df.withColumns({"_up": flag(F.col("close") > F.max("high").over(recent)), "_dn": flag(F.col("close") < F.min("low").over(recent)), "_bull": F.last(F.when(solid & (F.col("close") < F.col("open")), body), True).over(running()), "_bear": F.last(F.when(solid & (F.col("close") > F.col("open")), body), True).over(running())})
    df = df.withColumns({"_b1": flag((_late("_up") == 1) & F.col("_bull").isNotNull()), "_b2": flag((_late("_dn") == 1) & F.col("_bear").isNotNull())})
    bull, bear = F.col("_b1") == 1, F.col("_b2") == 1
    df = df.withColumns({"ob_born": flag(bull | bear), "ob_top": F.when(bull, F.col("_bull.o")).when(bear, F.col("_bear.c")), "ob_bottom": F.when(bull, F.col("_bull.c")).when(bear, F.col("_bear.o"))})
    return df.drop("_up", "_dn", "_bull", "_bear", "_b1", "_b2")


def liq_sweep(df: DataFrame, lookback: int = 5, min_tail: float = 0.5) -> DataFrame:
    """A long tail through the recent extreme with a close back inside."""
    recent = rows(-lookback, -1)
    df = df.withColumns({"_hi": F.max("high").over(recent), "_lo": F.min("low").over(recent)})
    up = F.greatest(F.col("high") - F.greatest("open", "close"), F.lit(0.0)) / nonzero(F.col("atr")) >= min_tail
    dn = F.greatest(F.least("open", "close") - F.col("low"), F.lit(0.0)) / nonzero(F.col("atr")) >= min_tail
    df = df.withColumns({"_bear": flag((F.col("high") > F.col("_hi")) & (F.col("close") < F.col("_hi")) & up), "_bull": flag((F.col("low") < F.col("_lo")) & (F.col("close") > F.col("_lo")) & dn)})
    bear, bull = F.col("_bear") == 1, F.col("_bull") == 1
    df = df.withColumns({"ls_top": F.when(bear, F.col("high")).when(bull, F.col("_lo")), "ls_bottom": F.when(bear, F.col("_hi")).when(bull, F.col("low")), "_raw": flag(bear | bull)})
    return df.withColumn("ls_born", _late("_raw")).drop("_hi", "_lo", "_bear", "_bull", "_raw")


def breaker_flip(df: DataFrame, lookback: int = 5) -> DataFrame:
    """Price closes through an order block of the last bars; that bar's body is the zone. Needs order_block's columns."""
    close = F.col("close")
    cross = ANY([flag(close > prev("ob_top", k)) == 1 for k in range(1, lookback + 1)] + [flag(close < prev("ob_bottom", k)) == 1 for k in range(1, lookback + 1)])
    df = df.withColumn("_raw", flag(cross))
    hit = F.col("_raw") == 1
    return df.withColumns({"bf_top": F.when(hit, F.greatest("open", "close")), "bf_bottom": F.when(hit, F.least("open", "close")), "bf_born": _late("_raw")}).drop("_raw")


def lifecycle(df: DataFrame, name: str, alive: int = 3, w_size: float = 0.5, w_age: float = 0.3, w_touch: float = 0.2) -> DataFrame:
    """State of the zones born 1..alive bars ago: alive, filled, expired, active bounds, size, age, touch, score."""
    top, bottom = f"{name}_top", f"{name}_bottom"
    ks = range(1, alive + 1)
    hit = ANY([flag((F.col("low") <= prev(top, k)) & (F.col("high") >= prev(bottom, k))) == 1 for k in ks])
    has = ANY([prev(top, k).isNotNull() & prev(bottom, k).isNotNull() for k in ks])
    oldest = prev(top, alive).isNotNull() & prev(bottom, alive).isNotNull()
    df = df.withColumns({f"{name}_filled_window": flag(hit), f"{name}_alive_n": flag(has & ~hit), f"{name}_expired_now": flag(oldest & ~hit), "_age": F.coalesce(*[F.when(prev(top, k).isNotNull(), k) for k in ks]), "_t": F.coalesce(*[prev(top, k) for k in ks]), "_b": F.coalesce(*[prev(bottom, k) for k in ks])})
    on = F.col(f"{name}_alive_n") == 1
    df = df.withColumns({f"{name}_active_top": F.when(on, F.col("_t")), f"{name}_active_bottom": F.when(on, F.col("_b")), f"{name}_age_bars_est": F.when(on, F.col("_age")).otherwise(0)})
    active = F.col(f"{name}_active_top")
    df = df.withColumns({f"{name}_size_norm": F.coalesce(F.abs(active - F.col(f"{name}_active_bottom")) / nonzero(F.col("atr")), F.lit(0.0)), f"{name}_touch_now": flag((F.col("low") <= active) & (F.col("high") >= F.col(f"{name}_active_bottom")))})
    df = df.withColumn(f"{name}_touch_count", F.when(active.isNotNull(), F.sum(f"{name}_touch_now").over(last_rows(alive))).otherwise(0))
    age = F.when(F.col(f"{name}_age_bars_est") > 0, 1.0 / (1.0 + F.col(f"{name}_age_bars_est"))).otherwise(0.0)
    return df.withColumn(f"{name}_score", w_size * F.col(f"{name}_size_norm") + w_age * age + w_touch * F.col(f"{name}_touch_count") / max(1, alive)).drop("_age", "_t", "_b")


DETECTORS = {"fvg": fvg, "sd": supply_demand, "ob": order_block, "ls": liq_sweep, "bf": breaker_flip}


def zone(df: DataFrame, name: str, alive: int = 3, atr_window: int = 14) -> DataFrame:
    """A detector and its lifecycle on plain bars; the breaker needs the order blocks."""
    if "atr" not in df.columns:
        df = atr(df, atr_window)
    if name == "bf" and "ob_top" not in df.columns:
        df = order_block(df)
    return lifecycle(DETECTORS[name](df), name, alive)


def fusion(df: DataFrame, *, alive: int = 3, ema_span: int = 5, age_norm: float = 5.0, enter: float = 0.55, leave: float = 0.35, cooldown: int = 3, min_conf: float = 0.30, confirm: str | None = None, tie: float = 0.02) -> DataFrame:
    """The best of the five zones: smoothed, decayed by age, off for some bars after it was filled or
    expired; near-equal ones by age, then hysteresis between enter and leave."""
    names = ["fvg", "sd", "ob", "bf", "ls"]
    df = atr(df, 14)
    df = order_block(df)
    for n in names:
        df = lifecycle(df if n == "ob" else DETECTORS[n](df), n, alive)
    df = ewm(df, {f"_s_{n}": (f"{n}_score", span(ema_span)) for n in names})
    ok = F.lit(True) if confirm is None else F.col(confirm) == 1
    df = df.withColumns({f"_c_{n}": F.max(F.greatest(f"{n}_filled_window", f"{n}_expired_now")).over(last_rows(cooldown)) for n in names})
    df = df.withColumns({f"_e_{n}": F.when((F.col(f"{n}_alive_n") == 1) & (F.col(f"_c_{n}") == 0) & ok, F.col(f"_s_{n}") / (1 + F.col(f"{n}_age_bars_est") / age_norm)).otherwise(0.0) for n in names})
    best = F.greatest(*[f"_e_{n}" for n in names])
    df = df.withColumn("sr_score_raw", best)
    pool = F.array(*[F.struct(F.when(F.abs(F.col(f"_e_{n}") - F.col("sr_score_raw")) <= tie, 0).otherwise(1).alias("far"), (1 - F.col(f"{n}_alive_n")).alias("off"), F.col(f"{n}_age_bars_est").cast("double").alias("age"), F.lit(i).alias("i"), F.lit(n).alias("name"), F.col(f"{n}_active_top").alias("top"), F.col(f"{n}_active_bottom").alias("bottom")) for i, n in enumerate(names)])
    df = df.withColumn("_w", F.array_min(pool))
    s = F.col("sr_score_raw")
    df = df.withColumn("sr_on", F.coalesce(F.last(F.when((s >= enter) & (s >= min_conf), 1).when((s < leave) | (s < min_conf), 0), True).over(running()), F.lit(0)))
    on = F.col("sr_on") == 1
    df = df.withColumns({"sr_score": F.when(on, s).otherwise(0.0), "sr_active_top": F.when(on, F.col("_w.top")), "sr_active_bottom": F.when(on, F.col("_w.bottom")), "sr_source": F.col("_w.name")})
    return df.drop("_w", *[f"_{p}_{n}" for p in "sce" for n in names])


