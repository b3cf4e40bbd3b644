"""Positions followed over a stream: break-even, trailing and scaling out, decided every few steps.

transformWithStateInPandas keeps one small row of state a symbol, and a micro-batch's rows until they are in order; its store is
RocksDB, which use_rocksdb() sets for a session.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .runs import LAST, Runs

STATE = "entry double, stop double, volume double, even boolean, step long, managed long"
ROW = np.dtype([("us", "<i8"), ("seq", "<i8"), *[(c, "<f8") for c in ("price", "atr", "side", "distance", "lots")]])
OUT = "symbol string, us long, price double, r double, stop double, volume double, event string"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def follow(state: tuple | None, price: float, atr: float, side: int, distance: float, lots: float, *, every: int, even_r: float, trail: float, scale: tuple[tuple[float, float], ...], eps: float = 1e-3) -> tuple[tuple, float, str]:
    """One step: (state, r, event). The position opens at the first price.

    Every `every` steps: from even_r on the stop goes to the entry, once; it trails the price by
    trail * atr, never back, and after break-even never behind the entry; each rule (at_r, share) of
    scale closes that share of what is left.
    """
    entry, stop, volume, even, step, managed = state or (price, price - side * distance, lots, False, 0, 0)
    r, events = side * (price - entry) / distance, []
    if state and step - managed >= every:
        if not even and r >= even_r:
            even = True
            if side * (entry - stop) > eps:
                stop = entry
                events.append("breakeven")
        wanted = price - side * trail * atr
        wanted = side * max(side * wanted, side * entry) if even else wanted
        if side * (wanted - stop) > eps:
            stop = wanted
            events.append("trail")
        for at, share in scale:
            if r >= at and volume > 0:
                volume -= volume * share
                events.append("scale")
        managed = step
    return (entry, stop, volume, even, step + 1, managed), r, ",".join(events)


class Manager(StatefulProcessor):
    def __init__(self, **rules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("position", STATE)
        self.rows = Runs(handle, ROW)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """The rows of a micro-batch in order, a piece at a time, as they may be many."""
        now = tuple(self.state.get()) if self.state.exists() else None
        self.rows.add(rows)
        for piece in self.rows.upto():
            out = []
            for us, _, price, *rest in zip(*[piece[c].tolist() for c in ROW.names], strict=True):
                now, r, event = follow(now, price, *rest, **self.rules)
                out.append((key[0], us, price, r, now[1], now[2], event))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])
        self.state.update(now)

    def close(self) -> None:
        pass


def manage_stream(ticks: DataFrame, *, every: int = 5, even_r: float = 1.0, trail: float = 1.0, scale: tuple[tuple[float, float], ...] = ()) -> DataFrame:
    """Rows (symbol, time, seq, price, atr, side, distance, lots) with the managed stop, the volume left and what happened."""
    last = F.lit(int(LAST))
    rows = ticks.select("symbol", F.coalesce(F.unix_micros(F.col("time").cast("timestamp")), last).alias("us"), F.coalesce(F.col("seq").cast("long"), last).alias("seq"), *[F.col(c).cast("double").alias(c) for c in ROW.names[2:]])
    out = rows.groupBy("symbol").transformWithStateInPandas(statefulProcessor=Manager(every=every, even_r=even_r, trail=trail, scale=scale), outputStructType=OUT, outputMode="Append", timeMode="None")
    return out.select("symbol", F.timestamp_micros(F.nullif("us", last)).alias("time"), *out.columns[2:])


def within_budget(spread: Column, point: float, pip_value: float, lots: Column, equity: Column, day_start: Column, peak: Column, daily: float = 0.03, total: float = 0.10) -> Column:
    """Whether the cost of entering is less than what today's and the total loss limit leave."""
    left = lambda limit, base: F.greatest(F.lit(0.0), limit * base - F.greatest(F.lit(0.0), base - equity))
    return F.least(left(daily, day_start), left(total, peak)) > spread / point * pip_value * lots
