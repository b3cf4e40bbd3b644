"""Time of day, sessions and quality flags of bars."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.bars import bucket, seconds
from .frames import flag, prev

#: Trading sessions in UTC.
SESSIONS = {"asia": ("00:00", "08:00"), "london": ("08:00", "16:00"), "newyork": ("13:00", "21:00")}


def time_features(df: DataFrame, time: str = "time") -> DataFrame:
    """hour, weekday (Monday 0) and both on a circle."""
    h, d = F.hour(time), F.weekday(time)
    circle = lambda x, n, f: f(x * (2 * math.pi / n))
    return df.withColumns({"hour": h, "dow": d, "hour_sin": circle(h, 24, F.sin), "hour_cos": circle(h, 24, F.cos), "dow_sin": circle(d, 7, F.sin), "dow_cos": circle(d, 7, F.cos)})


def minute_of_day(time: str = "time") -> Column:
    return F.hour(time) * 60 + F.minute(time)


def in_session(start: str, end: str, time: str = "time") -> Column:
    """Both ends inclusive to the minute's start; a session may pass midnight."""
    s, e = (int(x[:2]) * 3600 + int(x[3:5]) * 60 for x in (start, end))
    t = minute_of_day(time) * 60 + F.second(time)
    return t.between(s, e) if s <= e else (t >= s) | (t <= e)


def sessions(df: DataFrame, time: str = "time") -> DataFrame:
    return df.withColumns({f"session_{n}": flag(in_session(s, e, time)) for n, (s, e) in SESSIONS.items()})


def quality(df: DataFrame, gap: float = 5.0, spike: float = 0.05) -> DataFrame:
    """qc_gap: a step over `gap` median steps; qc_spike: a large relative change; qc_stale: no step."""
    from ..operators.asof import median_step

    df = df.join(F.broadcast(median_step(df)), "symbol", "left")  # one row a symbol
    step = F.unix_micros(F.col("time").cast("timestamp")) - F.unix_micros(prev("time").cast("timestamp"))
    change = F.abs(F.col("close") / F.when(prev("close") != 0, prev("close")) - 1)
    return df.withColumns({"qc_gap": flag(step > gap * F.col("step")), "qc_spike": flag(change > spike), "qc_stale": flag(step == 0)}).drop("step")


def last_closed(df: DataFrame, tf: str, time: str = "time") -> DataFrame:
    """Start of the bar that a time lies in."""
    return df.withColumn("last_closed", bucket(time, tf, "left"))


def lookback(tf: str, bars: int, cap: int | None = None) -> int:
    """Seconds that so many bars span, up to a cap of bars."""
    return seconds(tf) * (min(bars, cap) if cap else bars)
