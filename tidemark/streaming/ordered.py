"""Streams in event order: rows wait in state until the watermark has passed them, however micro-batches mix them.

A key's rows lie in state as packed runs (see runs.py). A timer at the earliest of them fires once the watermark is there; what
the watermark has passed goes on in the order of (time, seq), piece by piece, the rest waits for a timer of its own. Rows that
come after the watermark has passed their time are late and are dropped by Spark. A heartbeat, a row with a null
symbol, moves event time on where no tick does: it ends a replay, and stale symbols are found by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .positions import use_rocksdb
from .runs import LAST, Runs

ROW = np.dtype([("us", "<i8"), ("seq", "<i8"), ("price", "<f8")])


class InOrder(StatefulProcessor):
    """step(key, rows, state) gets the next rows (us, seq, price) in order and returns what goes out and the new state."""

    STATE = "at long, value double"
    OUT = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = Runs(handle, ROW)
        self.state = handle.getValueState("state", self.STATE)

    def step(self, key: str, rows: np.ndarray, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        raise NotImplementedError

    def idle(self, key: str, state: tuple, mark: int) -> pd.DataFrame | None:
        """What goes out when the watermark (microseconds) is at mark and no row came since the state's."""

    def wake(self, state: tuple) -> int | None:
        """When idle() is to be asked, in microseconds."""

    def empty(self) -> pd.DataFrame:
        return pd.DataFrame(columns=[c.split()[0] for c in self.OUT.split(", ")])

    def timer(self, us: int) -> None:
        self.handle.registerTimer(-(-int(us) // 1000))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if key[0] is None:
            for _ in rows:
                pass
        elif (low := self.rows.add(rows)) is not None:
            self.timer(low)
        yield self.empty()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        state, some = tuple(self.state.get()) if self.state.exists() else None, False
        for rows in self.rows.upto(mark):
            out, state = self.step(key[0], rows, state)
            some = True
            yield out
        if some:
            self.state.update(state)
            if (low := self.rows.first()) is not None:
                self.timer(low)
            at = self.wake(state)
            if at is not None and at > mark:
                self.timer(at)
        if state is not None:
            at = self.wake(state)
            if at is not None and at <= mark and (late := self.idle(key[0], state, mark)) is not None:
                self.state.update((*state[:-1], 1.0))
                yield late

    def close(self) -> None:
        pass


def named(key: str, rows: np.ndarray) -> np.ndarray:
    """The key beside each row, as objects even if there is none: an empty list is a column of numbers, which is no string to Arrow."""
    return np.full(len(rows), key, object)


class Spikes(InOrder):
    OUT = "symbol string, us long, price double, previous double, spike int"

    def __init__(self, limit: float):
        self.limit = limit

    def step(self, key: str, rows: np.ndarray, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        before = np.concatenate([[np.nan if state is None else state[1]], rows["price"][:-1]])
        out = pd.DataFrame({"symbol": named(key, rows), "us": rows["us"], "price": rows["price"], "previous": before, "spike": (np.abs(rows["price"] - before) > self.limit).astype("int32")})
        return out, (int(rows["us"][-1]), float(rows["price"][-1]))


class Mean(InOrder):
    OUT = "symbol string, us long, seq long, price double, ewm double"

    def __init__(self, alpha: float):
        self.alpha = alpha

    def step(self, key: str, rows: np.ndarray, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        mean, means = state[1] if state is not None else None, []
        for x in rows["price"].tolist():
            mean = x if mean is None else (1 - self.alpha) * mean + self.alpha * x
            means.append(mean)
        out = pd.DataFrame({"symbol": named(key, rows), "us": rows["us"], "seq": rows["seq"], "price": rows["price"], "ewm": means})
        return out, (int(rows["us"][-1]), float(mean))


class Stale(InOrder):
    """A row for each tick that no other follows within age: state value 1 once the newest one has been reported."""

    OUT = "symbol string, us long, due long"

    def __init__(self, age_us: int):
        self.age = age_us

    def step(self, key: str, rows: np.ndarray, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        at = rows["us"]
        if state is not None and not state[1]:
            at = np.concatenate([[state[0]], at])
        gone = at[:-1][np.diff(at) > self.age]
        return pd.DataFrame({"symbol": named(key, gone), "us": gone, "due": gone + self.age}), (int(at[-1]), 0.0)

    def wake(self, state: tuple) -> int | None:
        return None if state[1] else state[0] + self.age + 1

    def idle(self, key: str, state: tuple, mark: int) -> pd.DataFrame | None:
        return pd.DataFrame({"symbol": [key], "us": [state[0]], "due": [state[0] + self.age]})


def followed(ticks: DataFrame, processor: InOrder, late: str) -> DataFrame:
    """What a processor makes of ticks (symbol, time, seq, price) in event order; rows without a time are left out."""
    use_rocksdb(ticks.sparkSession)
    rows = ticks.where("time is not null").select("symbol", "time", F.unix_micros("time").alias("us"), F.coalesce(F.col("seq").cast("long"), F.lit(int(LAST))).alias("seq"), F.col("price").cast("double").alias("price"))
    out = rows.withWatermark("time", late).groupBy("symbol").transformWithStateInPandas(statefulProcessor=processor, outputStructType=processor.OUT, outputMode="Append", timeMode="EventTime")
    rest = [F.nullif("seq", F.lit(int(LAST))).alias("seq") if c == "seq" else c for c in out.columns if c not in ("symbol", "us")]
    return out.select("symbol", F.timestamp_micros("us").alias("time"), *rest)


def stale_ticks(ticks: DataFrame, age_s: float, late: str = "1 hour") -> DataFrame:
    """(symbol, time, due): ticks after which none comes for more than age_s seconds, and when that was due."""
    out = followed(ticks, Stale(round(age_s * 1_000_000)), late)
    return out.withColumn("due", F.timestamp_micros("due"))
