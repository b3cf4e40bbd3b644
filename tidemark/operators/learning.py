"""Labels, rewards, splits, scaling, windows, representation, backtest metrics, risk, the simulator."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import by_time, last_rows, nonzero, prev, rolling, rows, running


def label_sign(df: DataFrame, horizon: int = 1) -> DataFrame:
    r = F.coalesce(F.signum(F.col("close") - prev("close", horizon)), F.lit(0.0)).cast("int")
    return df.withColumn("_y", r).withColumn("label", F.coalesce(prev("_y"), F.lit(0))).drop("_y")


def label_logret(df: DataFrame, horizon: int = 1) -> DataFrame:
    df = df.withColumn("_l", F.log(F.col("close") / prev("close"))).withColumn("_s", rolling("_l", horizon, F.sum))
    return df.withColumn("label", F.coalesce(prev("_s"), F.lit(0.0))).drop("_l", "_s")


def triple_barrier(df: DataFrame, tp: float = 2.0, sl: float = 2.0, horizon: int = 10, vol_window: int = 100) -> DataFrame:
    """1 if only the upper barrier is reached within the horizon, -1 if only the lower; one row later.

    The largest and smallest running sum of returns ahead decide, so no pair of rows is compared.
    """
    df = df.withColumn("_l", F.coalesce(F.log(F.col("close") / prev("close")), F.lit(0.0)))
    df = df.withColumn("_v", rolling("_l", vol_window, F.stddev_samp, max(20, vol_window // 5))).withColumn("_s", F.sum("_l").over(running()))
    df = df.withColumn("_v", F.coalesce("_v", F.first("_v", True).over(rows(0, Window.unboundedFollowing))))
    ahead = rows(1, horizon)
    hit = F.coalesce(F.max("_s").over(ahead) - F.col("_s") >= tp * F.col("_v"), F.lit(False))
    stop = F.coalesce(F.min("_s").over(ahead) - F.col("_s") <= -sl * F.col("_v"), F.lit(False))
    df = df.withColumn("_y", F.when(hit & ~stop, 1).when(stop & ~hit, -1).otherwise(0))
    return df.withColumn("label", F.coalesce(prev("_y"), F.lit(0))).drop("_l", "_v", "_s", "_y")


def reward(df: DataFrame, mode: str = "pnl") -> DataFrame:
    """Position times the next return: simple, logarithmic, or over ATR. Needs a column position."""
    nxt = F.lead("close").over(by_time())
    ret = F.log(nxt / F.col("close")) if mode == "logret" else nxt / nonzero(F.col("close")) - 1
    r = F.col("position") * ret
    return df.withColumn("reward", r / F.greatest(F.col("atr"), F.lit(1e-8)) if mode == "atr_norm" else r)


def step_reward(df: DataFrame, turn_cost: float = 0.0, slip: float = 0.0, adr: str | None = None, adr_scale: float = 1.0, adr_floor: float = 1e-6) -> DataFrame:
    """Position times the next return less the cost of changing the position; the last row has none."""
    ret = F.lead("close").over(by_time()) / nonzero(F.col("close")) - 1
    if adr:
        ret = ret / F.when(F.abs(F.col(adr)) > adr_floor, F.col(adr)).otherwise(1.0) * adr_scale
    turns = F.abs(F.col("position") - F.coalesce(prev("position"), F.lit(0.0)))
    return df.withColumn("reward", F.col("position") * ret - turns * (turn_cost + slip))


def ratio_split(df: DataFrame, train: float = 0.7, val: float = 0.15, snap_tz: str | None = None, snap: str = "17:00") -> DataFrame:
    """split of each row by its place in time; with snap_tz the borders move on to the next session edge."""
    n, i = F.count(F.lit(1)).over(Window.partitionBy("symbol")), F.row_number().over(by_time()) - 1
    i1 = F.greatest(F.lit(1), F.floor(n * train))
    i2 = F.greatest(i1 + 1, F.floor(n * (train + val)))
    if not snap_tz:
        return df.withColumn("split", F.when(i < i1, "train").when(i < i2, "val").otherwise("test"))
    df = df.withColumns({"_i": i, "_1": i1, "_2": i2})
    h, m = map(int, snap.split(":"))
    border = lambda c: F.max(F.when(F.col("_i") == F.least(F.col(c), n - 1), F.col("time"))).over(Window.partitionBy("symbol"))

    def snapped(c: str) -> Column:
        local = F.from_utc_timestamp(border(c).cast("timestamp"), snap_tz)
        edge = F.date_trunc("day", local) + F.expr(f"interval {h * 60 + m} minutes")
        return F.to_utc_timestamp(F.when(local <= edge, edge).otherwise(edge + F.expr("interval 1 day")), snap_tz)

    df = df.withColumns({"_t1": snapped("_1"), "_t2": snapped("_2")})
    t = F.col("time").cast("timestamp")
    return df.withColumn("split", F.when(t < F.col("_t1"), "train").when(t < F.col("_t2"), "val").otherwise("test")).drop("_i", "_1", "_2", "_t1", "_t2")


def date_split(df: DataFrame, parts: dict[str, tuple[str, str]]) -> DataFrame:
    """split by fixed ranges of dates, both ends inclusive; rows outside get null."""
    c = reduce(lambda a, p: a.when(F.col("time").between(F.lit(p[1][0]).cast("timestamp"), F.lit(p[1][1]).cast("timestamp")), p[0]), parts.items(), F.when(F.lit(False), ""))
    return df.withColumn("split", c)


def split_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("symbol", "split").agg(F.count(F.lit(1)).alias("bars"), F.min("time").alias("start"), F.max("time").alias("end"))


PRE_NORMALISED = ("z_", "__norm_")


def scaler_fit(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row: mean and sample deviation of each column; 0 or no deviation counts as 1."""
    return df.agg(*[F.avg(c).alias(f"{c}_mean") for c in cols], *[F.coalesce(nonzero(F.stddev_samp(c)), F.lit(1.0)).alias(f"{c}_std") for c in cols])


def scaler_apply(df: DataFrame, stats: DataFrame, cols: list[str]) -> DataFrame:
    """(x - mean) / std from the one-row stats; columns that are normed already stay."""
    todo = [c for c in cols if not c.startswith(PRE_NORMALISED) and not c.endswith("_z")]
    s = stats.select(F.lit(1).alias("_k"), *stats.columns)
    joined = df.withColumn("_k", F.lit(1)).join(F.broadcast(s), "_k")  # one row
    return joined.select(*[((F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std")).alias(c) if c in todo else c for c in df.columns])


def observation(df: DataFrame, cols: list[str], n: int = 4) -> DataFrame:
    """obs: the last n rows' features, oldest first, padded with zero rows in front."""
    row = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols])
    held = F.collect_list(row).over(last_rows(n))
    zero = F.array(*[F.lit(0.0)] * len(cols))
    return df.withColumn("obs", F.concat(F.array_repeat(zero, F.greatest(F.lit(0), F.lit(n) - F.size(held))), held))


def transform_obs(df: DataFrame, cols: list[str], mode: str = "mean", k: int = 4) -> DataFrame:
    """mean and lastk_mean: means of the last k rows; last: the row; flat: the last k rows in one array."""
    if mode in ("mean", "lastk_mean"):
        return df.withColumns({f"{c}_obs": F.avg(c).over(last_rows(k)) for c in cols})
    if mode == "last":
        return df.withColumns({f"{c}_obs": F.col(c) for c in cols})
    return observation(df, cols, k).withColumn("obs", F.flatten("obs"))


def representation(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """binary (null counts as 1), ordinalN (exact quantile bins, equal edges merged) or continuous."""
    for c, kind in mapping.items():
        if kind == "binary":
            df = df.withColumn(c, F.coalesce(F.col(c) != 0, F.lit(True)).cast("int"))
        elif kind.startswith("ordinal"):
            n = int(kind.removeprefix("ordinal") or 3)
            edges = F.array_sort(F.array_distinct(F.percentile(c, F.array(*[F.lit(i / n) for i in range(n + 1)])).over(Window.partitionBy("symbol"))))
            df = df.withColumn("_e", edges)
            below = F.expr(f"size(filter(slice(_e, 2, {n + 1}), e -> e < `{c}`))")
            df = df.withColumn(c, F.when(F.col(c).isNotNull(), F.least(below, F.size("_e") - 2))).drop("_e")
        elif kind != "continuous":
            raise ValueError(f"no representation: {kind}")
    return df


def trades(df: DataFrame) -> DataFrame:
    """Islands of one position sign (not 0) and their sums of reward; needs position and reward."""
    df = df.withColumn("_s", F.signum("position")).withColumn("_new", F.when(F.col("_s") != F.coalesce(prev("_s"), F.lit(0.0)), 1).otherwise(0))
    df = df.withColumn("trade", F.sum("_new").over(running()))
    return df.where("_s <> 0").groupBy("symbol", "trade").agg(F.sum("reward").alias("pnl"), F.count(F.lit(1)).alias("bars"), F.min("time").alias("opened"), F.first("_s").alias("side"))


def metrics(df: DataFrame, tf_minutes: float = 240.0) -> DataFrame:
    """Backtest metrics of each symbol from position and reward."""
    d = df.where("reward is not null").withColumn("_eq", F.sum("reward").over(running())).withColumn("_peak", F.max("_eq").over(running()))
    a = d.groupBy("symbol").agg(F.sum("reward").alias("total_reward"), F.count(F.lit(1)).alias("steps"), F.avg("reward").alias("avg_per_step"), F.stddev_samp("reward").alias("_sd"), F.max(F.col("_peak") - F.col("_eq")).alias("_dd"), F.max("_peak").alias("_top"))
    t = trades(df.where("reward is not null")).groupBy("symbol").agg(F.count(F.lit(1)).alias("trades"), F.sum(F.when(F.col("pnl") > 0, F.col("pnl"))).alias("_win"), F.sum(F.when(F.col("pnl") < 0, F.col("pnl"))).alias("_loss"), F.count(F.when(F.col("pnl") > 0, 1)).alias("_wins"))
    m = a.join(t, "symbol", "left").fillna(0, ["trades", "_wins"])
    days = F.col("steps") * tf_minutes / 1440.0
    return m.select(
        "symbol", "total_reward", "steps", "avg_per_step", "trades",
        (F.col("_wins") / F.greatest(F.lit(1), F.col("trades"))).alias("winrate"),
        F.coalesce(F.col("_win") / (F.abs(F.coalesce("_loss", F.lit(0.0))) + 1e-12), F.lit(0.0)).alias("profit_factor"),
        F.when(F.col("steps") >= 2, F.col("avg_per_step") / (F.col("_sd") + 1e-12) * F.sqrt("steps")).otherwise(0.0).alias("sharpe"),
        (F.col("_dd") / F.greatest(F.lit(1.0), F.abs(F.col("_top")))).alias("max_drawdown"),
        (F.col("trades") / F.greatest(days, F.lit(1e-9))).alias("turnover_per_day"),
    )


def gates(m: DataFrame, limits: dict[str, tuple[str, float]]) -> DataFrame:
    """passed, and failed: the names of the limits that a metrics row misses; limits: name -> (column op, value)."""
    checks = [F.when(~F.coalesce(F.expr(f"{rule} {value!r}"), F.lit(False)), F.lit(name)) for name, (rule, value) in limits.items()]
    return m.withColumn("failed", F.array_join(F.filter(F.array(*checks), lambda x: x.isNotNull()), ",")).withColumn("passed", (F.col("failed") == "").cast("int"))


def slippage_quantiles(df: DataFrame, col: str, n: int = 512) -> DataFrame:
    return df.withColumns({f"{col}_p50": F.percentile(col, F.lit(0.5)).over(last_rows(n)), f"{col}_p90": F.percentile(col, F.lit(0.9)).over(last_rows(n))})


def round_step(x: Column, step: float, low: float, high: float) -> Column:
    """Nearest multiple of step (halves to even) within the bounds."""
    y = F.bround(x / step) * step if step > 0 else x
    return F.least(F.greatest(y, F.lit(low)), F.lit(high))


def lots(df: DataFrame, equity: Column, *, risk: float = 0.01, atr_mult: float = 1.5, pip_value: float = 1.0, point: float = 0.01, step: float = 0.01, low: float = 0.01, high: float = 5.0) -> DataFrame:
    """Fixed-fractional size from an ATR stop; the smallest lot where a figure is missing."""
    df = df.withColumn("stop_distance", F.when(F.col("atr") > 0, atr_mult * F.col("atr")).otherwise(0.0))
    raw = risk * equity / (nonzero(F.col("stop_distance")) / point * pip_value)
    return df.withColumn("lots", F.coalesce(round_step(raw, step, low, high), F.lit(low)))


def loss_breach(df: DataFrame, daily: float = 0.03, total: float = 0.10) -> DataFrame:
    """Flags of equity under the day's start or under its peak by the allowed share."""
    day = Window.partitionBy("symbol", F.to_date("time")).orderBy("time")
    start, peak = F.first("equity").over(day), F.max("equity").over(running())
    share = lambda a: F.coalesce((F.col("equity") - a) / nonzero(a), F.lit(0.0))
    return df.withColumns({"daily_breach": ((start > 0) & (share(start) <= -abs(daily))).cast("int"), "total_breach": ((peak > 0) & (share(peak) <= -abs(total))).cast("int")})


def manage(df: DataFrame, be_r: float = 1.0, trail_mult: float = 1.0, canary: float = 0.1, step: float = 0.01, low: float = 0.01, high: float = 5.0) -> DataFrame:
    """Break-even trigger by r_multiple, trailing offset from ATR, canary volume from lots."""
    return df.withColumns({"breakeven": F.coalesce(F.col("r_multiple") >= be_r, F.lit(False)).cast("int"), "trail_offset": F.when(F.col("atr") > 0, trail_mult * F.col("atr")).otherwise(0.0), "canary_lots": round_step(F.col("lots") * canary, step, low, high)})


SIM = "symbol string, time timestamp, close double, position int, reward double, equity double, stop double, target double, event string"


def simulate_one(high, low, close, action, atr, *, cooldown: int = 2, cost: float = 0.0, sl: float = 1.5, tp: float = 2.0, be: float = 1.0, trail: float = 1.0) -> list[tuple]:
    """Positions -1, 0, 1 bar by bar with stop, target, break-even and trailing; one change a bar."""
    out, pos, entry, stop, target, risk, wait, equity = [], 0, np.nan, np.nan, np.nan, np.nan, 0, 0.0
    for i in range(len(close)):
        gain, event = (pos * (close[i] / close[i - 1] - 1) if i and pos else 0.0), ""
        if pos:
            worst, best = (low[i], high[i]) if pos > 0 else (high[i], low[i])
            exit_ = stop if pos * (worst - stop) <= 0 else target if pos * (best - target) >= 0 else None
            if exit_ is not None:
                event = "stop" if exit_ == stop else "target"
                gain = pos * (exit_ / close[i - 1] - 1) - cost
                pos, stop, target, wait = 0, np.nan, np.nan, cooldown
            else:
                if pos * (close[i] - entry) >= be * risk:
                    stop = pos * max(pos * stop, pos * entry)
                    stop = pos * max(pos * stop, pos * (close[i] - pos * trail * atr[i])) if atr[i] == atr[i] else stop
        if not event and wait == 0 and action[i] != pos:
            gain -= cost * abs(action[i] - pos)
            pos, wait, event = int(action[i]), cooldown, "change"
            if pos:
                entry, width = close[i], atr[i] if atr[i] == atr[i] else 0.01 * close[i]
                risk = sl * width
                stop, target = entry - pos * sl * width, entry + pos * tp * width
            else:
                stop = target = np.nan
        elif wait and not event:
            wait -= 1
        equity += gain
        out.append((pos, gain, equity, stop, target, event))
    return out


def simulate(df: DataFrame, **params) -> DataFrame:
    """The trading simulator over (symbol, time, high, low, close, action, atr): state runs along a symbol."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("time").reset_index(drop=True)
        rows_ = simulate_one(*(pdf[c].to_numpy(float) for c in ("high", "low", "close", "action", "atr")), **params)
        return pd.concat([pdf[["symbol", "time", "close"]], pd.DataFrame(rows_, columns=["position", "reward", "equity", "stop", "target", "event"])], axis=1)

    out = df.select("symbol", F.col("time").cast("timestamp").alias("time"), "high", "low", "close", "action", "atr").groupBy("symbol").applyInPandas(run, SIM)
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("stop", "target")})
