"""Indicators whose next value depends on a choice made with the last one: pandas, a symbol or a range of it at a time."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.frames import by_time
from ..functions.indicators import atr, true_range
from .ranges import HALO, PART, ROWS, cut, ewm_over_ranges, over_ranges, stored


def _each_symbol(df: DataFrame, out: str, fn) -> DataFrame:
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("time").reset_index(drop=True)
        return pdf.assign(**{out: fn(pdf)})

    return df.groupBy("symbol").applyInPandas(run, schema).withColumn(out, F.when(~F.isnan(out), F.col(out)))


def psar_start(high: np.ndarray, low: np.ndarray, start: float) -> tuple[float, ...]:
    """The state after two rows: direction, extreme, stop and speed; in a falling trend prices are mirrored."""
    sign = 1.0 if high[1] > high[0] else -1.0
    ahead, behind = (high, low) if sign > 0 else (-low, -high)
    return sign, ahead[1], behind[0], start


def psar_run(high: np.ndarray, low: np.ndarray, first: int, state: tuple[float, ...], start: float, step: float, top: float) -> tuple[np.ndarray, tuple[float, ...]]:
    """Values from row `first` (two at least come before it) on, and the state at the end."""
    sign, extreme, stop, speed = state
    out = np.full(len(high), np.nan)
    ahead, behind = (high, low) if sign > 0 else (-low, -high)
    for i in range(first, len(high)):
        stop = min(stop + speed * (extreme - stop), behind[i - 1], behind[i - 2])
        if behind[i] < stop:
            sign = -sign
            ahead, behind = (high, low) if sign > 0 else (-low, -high)
            stop, extreme, speed = -extreme, ahead[i], start
        elif ahead[i] > extreme:
            extreme, speed = ahead[i], min(speed + step, top)
        out[i] = sign * stop
    return out, (sign, extreme, stop, speed)


def psar_values(high: np.ndarray, low: np.ndarray, start: float = 0.02, step: float = 0.02, top: float = 0.2) -> np.ndarray:
    """Parabolic stop: it runs after the extreme and jumps to it when touched. Two rows of warm-up."""
    if len(high) < 3:
        return np.full(len(high), np.nan)
    return psar_run(high, low, 2, psar_start(high, low, start), start, step, top)[0]


def psar(df: DataFrame, start: float = 0.02, step: float = 0.02, top: float = 0.2, out: str = "sar") -> DataFrame:
    return _each_symbol(df, out, lambda p: psar_values(p["high"].to_numpy(float), p["low"].to_numpy(float), start, step, top))


def supertrend_values(close: np.ndarray, upper: np.ndarray, lower: np.ndarray, before: float = np.nan) -> np.ndarray:
    """Rises along the lower band while the close is above it, else falls along the upper one."""
    out = np.full(len(close), np.nan)
    for i in range(len(close)):
        last = out[i - 1] if i else before
        if np.isnan(last):
            out[i] = upper[i]
        else:
            out[i] = max(lower[i], last) if close[i] > last else min(upper[i], last)
    return out


def supertrend(df: DataFrame, period: int = 10, multiplier: float = 3.0, out: str = "supertrend") -> DataFrame:
    mid = (F.col("high") + F.col("low")) / 2
    df = atr(df, period, "_atr").withColumns({"_u": mid + multiplier * F.col("_atr"), "_l": mid - multiplier * F.col("_atr")})
    return _each_symbol(df, out, lambda p: supertrend_values(p["close"].to_numpy(float), p["_u"].to_numpy(float), p["_l"].to_numpy(float))).drop("_atr", "_u", "_l")


#: A resumable recurrence: rows, the first one to be computed and the state before it (None: the series begins) to values and state.
Run = Callable[[pd.DataFrame, int, tuple[float, ...] | None], tuple[np.ndarray, tuple[float, ...] | None]]
WARM = 1000


def speculated(df: DataFrame, out: str, run: Run, warm: int = WARM, rows: int = ROWS) -> DataFrame:
    """A column by a recurrence over each symbol, computed range by range at once.

    A range guesses the state at its border by running over the last `warm` rows before it. Then seams are compared:
    where the range before has ended in another state, the range is run again from that state, until all seams
    fit. What comes out is what one run over the symbol gives, and most ranges run once, as such recurrences
    forget their start. Repeated times keep the order that their range has given them.
    """
    given = stored(cut(df, max(2, warm), rows))
    last = given.withColumn("_back", F.row_number().over(Window.partitionBy("symbol", PART).orderBy(F.desc("time")))).where(F.col("_back") <= warm).drop("_back")
    both = given.withColumn(HALO, F.lit(0)).unionByName(last.withColumns({PART: F.col(PART) + 1, HALO: F.lit(1)}))
    state = T.ArrayType(T.DoubleType())
    schema = T.StructType([*given.schema.fields, T.StructField(out, T.DoubleType()), T.StructField("_entry", state), T.StructField("_exit", state)])
    names = [f.name for f in schema.fields]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([HALO, "time"], ascending=[False, True], kind="stable").reset_index(drop=True)
        k = int(pdf[HALO].sum())
        if k == len(pdf):
            return pd.DataFrame(columns=names)
        told = pdf["_state"].iloc[-1] if "_state" in pdf else None
        if told is not None:
            entry = tuple(told) or None
        else:
            entry = run(pdf.iloc[:k], 0, None)[1] if k else None
        values, end = run(pdf, k, entry)
        own = pdf.iloc[k:].assign(**{out: values[k:]})
        # the states stand in one row of the range
        own["_entry"] = [list(entry or ())] + [None] * (len(own) - 1)
        own["_exit"] = [list(end or ())] + [None] * (len(own) - 1)
        return own[names]

    layers = [stored(both.groupBy("symbol", PART).applyInPandas(one, schema).withColumn("_round", F.lit(0)))]
    while True:
        every = reduce(DataFrame.unionByName, layers)
        seams = every.where("_entry is not null").groupBy("symbol", PART).agg(F.max(F.struct("_round", "_entry", "_exit")).alias("m")).select("symbol", PART, "m.*")
        told = F.lag("_exit").over(Window.partitionBy("symbol").orderBy(PART))
        wrong = stored(seams.withColumn("_state", told).where("_state is not null and not (_state <=> _entry)").select("symbol", PART, "_state"))
        if wrong.isEmpty():
            break
        again = both.join(wrong, ["symbol", PART])
        layers.append(stored(again.groupBy("symbol", PART).applyInPandas(one, schema).withColumn("_round", F.lit(len(layers)))))
    newest = seams.select(F.col("symbol").alias("_s"), F.col(PART).alias("_p"), F.col("_round").alias("_r"))
    found = every.join(newest, F.col("symbol").eqNullSafe(F.col("_s")) & (F.col(PART) == F.col("_p")) & (F.col("_round") == F.col("_r")))
    return found.select(*[F.col(f"`{c}`") for c in df.columns], F.when(~F.isnan(out), F.col(out)).alias(out))


def psar_over_ranges(df: DataFrame, start: float = 0.02, step: float = 0.02, top: float = 0.2, out: str = "sar", warm: int = WARM, rows: int = ROWS) -> DataFrame:
    """psar() for symbols of any length."""

    def run(pdf: pd.DataFrame, first: int, state: tuple[float, ...] | None) -> tuple[np.ndarray, tuple[float, ...] | None]:
        high, low = pdf["high"].to_numpy(float), pdf["low"].to_numpy(float)
        if state is None:
            if len(pdf) < 3:
                return np.full(len(pdf), np.nan), None
            first, state = 2, psar_start(high, low, start)
        return psar_run(high, low, first, state, start, step, top)

    return speculated(df, out, run, warm, rows)


def supertrend_over_ranges(df: DataFrame, period: int = 10, multiplier: float = 3.0, out: str = "supertrend", warm: int = WARM, rows: int = ROWS) -> DataFrame:
    """supertrend() for symbols of any length; the bands' mean is a recurrence over ranges too."""
    names, mid = df.columns, (F.col("high") + F.col("low")) / 2
    df = over_ranges(df, lambda d: d.withColumns({"_tr": true_range(), "_n": F.least(F.row_number().over(by_time()), F.lit(period + 1))}), period + 1, rows)
    df = ewm_over_ranges(df, {"_mean": ("_tr", 1.0 / period)}, rows).withColumn("_atr", F.when(F.col("_n") > period, F.col("_mean")))
    df = df.withColumns({"_u": mid + multiplier * F.col("_atr"), "_l": mid - multiplier * F.col("_atr")}).select(*[F.col(f"`{c}`") for c in names], "_u", "_l")

    def run(pdf: pd.DataFrame, first: int, state: tuple[float, ...] | None) -> tuple[np.ndarray, tuple[float, ...] | None]:
        close, upper, lower = (pdf[c].to_numpy(float)[first:] for c in ("close", "_u", "_l"))
        own = supertrend_values(close, upper, lower, state[0] if state else np.nan)
        return np.concatenate([np.full(first, np.nan), own]), (float(own[-1]),) if len(own) else state

    return speculated(df, out, run, warm, rows).drop("_u", "_l")
