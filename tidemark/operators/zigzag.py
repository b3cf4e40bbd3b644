"""ZigZag swings and legs, and what is built from legs.

All of it is window expressions. A bar is a candidate low if it is the lowest of the last `depth` bars
and no later minimum within `backstep` bars clears it (a candidate high likewise). Candidates follow
each other in runs of lows and of highs: a bar that is only a low continues a run of lows or begins
one, a bar that is both ends the run it meets. So the kind of each run follows from the last candidate
that was of one kind only and the number of those since that were both, and its swing is the run's
first extreme. The pivots are revised by later bars (not causal).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import by_time, earlier, flag, last_rows, rows, running
from .asof import fill_ranges


def candidate(x: Column, depth: int, margin: float, backstep: int) -> tuple[Column, Column]:
    """(the least of the last depth values, what a row near it clears: its least value) of a column."""
    least = F.when(F.col("pos") >= depth - 1, F.min(x).over(last_rows(depth)))
    return least, F.when(x - least <= margin, least)


def zigzag(bars: DataFrame, depth: int = 12, deviation: float = 5.0, backstep: int = 10, point: float = 0.01) -> DataFrame:
    """Bars with pos (row within the symbol), zz_state (-1 at a swing high, 1 at a swing low, else 0), zz_high and zz_low."""
    margin = deviation * point
    keep = ["symbol", "time", "open", "high", "low", "close", "volume", "pos"]
    df = bars.select("symbol", F.col("time").cast("timestamp").alias("time"), "open", "high", "low", "close", F.col("volume").cast("long").alias("volume"))
    df = df.withColumn("pos", (F.row_number().over(by_time()) - 1).cast("int"))
    sides = {"_l": F.col("low"), "_h": -F.col("high")}
    for name, x in sides.items():
        least, clears = candidate(x, depth, margin, backstep)
        df = df.withColumns({f"{name}b": least, f"{name}c": clears})
    for name, x in sides.items():
        cleared = F.min(f"{name}c").over(rows(1, backstep)) < x if backstep > 0 else F.lit(False)
        df = df.withColumn(name, flag((x == F.col(f"{name}b")) & ~F.coalesce(cleared, F.lit(False))))
    low, high = F.col("_l") == 1, F.col("_h") == 1
    df = df.withColumns({"_both": flag(low & high), "_one": F.when(low & ~high, 1).when(high & ~low, -1)})
    df = df.withColumn("_flips", F.sum("_both").over(running()))
    df = df.withColumn("_from", F.last(F.when(F.col("_one").isNotNull(), F.struct("_one", "_flips")), True).over(running()))
    # the first candidate of all counts as a high if it is both
    even = (F.col("_flips") - F.coalesce(F.col("_from._flips"), F.lit(1))) % 2 == 0
    kind = F.coalesce(F.col("_from._one"), F.lit(-1)) * F.when(even, 1).otherwise(-1)
    df = df.withColumn("_kind", F.when(low | high, kind))
    turn = F.col("_kind") != F.coalesce(F.last("_kind", True).over(earlier()), F.lit(0))
    df = df.withColumn("_run", F.sum(flag(turn)).over(running()))
    # the first extreme of a run; rows that are no candidate come last in it
    rank = F.row_number().over(Window.partitionBy("symbol", "_run").orderBy(F.when(F.col("_kind") == 1, F.col("low")).when(F.col("_kind") == -1, -F.col("high")).asc_nulls_last(), "time"))
    df = df.withColumn("zz_state", F.when((rank == 1) & F.col("_kind").isNotNull(), F.col("_kind")).otherwise(0))
    state = F.col("zz_state")
    return df.select(*keep, state.cast("int").alias("zz_state"), F.when(state == -1, F.col("high")).alias("zz_high"), F.when(state == 1, F.col("low")).alias("zz_low"))


def legs(states: DataFrame) -> DataFrame:
    """Legs between neighbouring swings: (symbol, leg, start and end time, position and extreme, direction)."""
    p = states.where("zz_state <> 0").withColumn("_x", F.coalesce("zz_high", "zz_low"))
    w = Window.partitionBy("symbol").orderBy("time")
    nxt = lambda c: F.lead(c).over(w)
    out = p.select("symbol", (F.row_number().over(w) - 1).alias("leg"), F.col("time").alias("start_time"), nxt("time").alias("end_time"), F.col("pos").alias("start_pos"), nxt("pos").alias("end_pos"), F.col("zz_state").alias("direction"), F.col("_x").alias("start_extr"), nxt("_x").alias("end_extr"))
    return out.where("end_pos is not null")


def _points(states: DataFrame) -> DataFrame:
    return states.select("symbol", "time", "open", "high", "low", "close", "volume", "pos")


def _with_last(leg: DataFrame, states: DataFrame, extend: bool) -> DataFrame:
    """Legs; with extend the last one reaches to the end of the data."""
    if not extend:
        return leg
    ends = states.groupBy("symbol").agg((F.max("pos") + 1).alias("_n"))
    w = Window.partitionBy("symbol")
    return leg.join(ends, "symbol").withColumn("end_pos", F.when(F.col("leg") == F.max("leg").over(w), F.col("_n")).otherwise(F.col("end_pos"))).drop("_n")


def support_resistance(states: DataFrame, extend: bool = False) -> DataFrame:
    """The start of a leg over the leg: support under a rising one, resistance over a falling one."""
    leg = _with_last(legs(states), states, extend)
    out = fill_ranges(_points(states), leg, ["direction", "start_extr"])
    return out.withColumns({"support": F.when(F.col("direction") == 1, F.col("start_extr")), "resistance": F.when(F.col("direction") == -1, F.col("start_extr"))}).drop("direction", "start_extr")


def leg_mask(states: DataFrame) -> DataFrame:
    """The direction of the leg a row lies in, 0 outside."""
    out = fill_ranges(_points(states), legs(states), ["direction"])
    return out.withColumn("leg_mask", F.coalesce("direction", F.lit(0))).drop("direction")


def fibo(states: DataFrame, ratios: tuple[float, ...] = (0.236, 0.382, 0.5, 0.618, 0.786), extend: bool = True) -> DataFrame:
    """Retracement levels of the leg a row lies in, measured back from the leg's end."""
    leg = _with_last(legs(states), states, extend)
    out = fill_ranges(_points(states), leg, ["start_extr", "end_extr"])
    level = {f"fib_{str(r).replace('.', '_')}": F.col("end_extr") - r * (F.col("end_extr") - F.col("start_extr")) for r in ratios}
    return out.withColumns(level).drop("start_extr", "end_extr")


def mtf(base: DataFrame, higher: DataFrame, extend: bool = True, **params) -> DataFrame:
    """A higher timeframe's swings on the base grid: the state at the bar that opens with it and the running leg."""
    from .asof import asof

    h = zigzag(higher, **params)
    leg = legs(h)
    out = asof(base, leg.select("symbol", F.col("start_time").alias("time"), "direction", "start_extr", "end_time"), ["direction", "start_extr", "end_time"], prefix="htf_")
    inside = F.lit(True) if extend else F.col("time") < F.col("htf_end_time")
    return out.withColumns({"htf_direction": F.when(inside, F.col("htf_direction")), "htf_start_extr": F.when(inside, F.col("htf_start_extr"))}).drop("htf_end_time")


def market_structure(states: DataFrame) -> DataFrame:
    """Labels of swings against the last swing of their kind, breaks and changes of structure, regime."""
    p = states.where("zz_state <> 0").withColumn("_x", F.coalesce("zz_high", "zz_low"))
    kind = Window.partitionBy("symbol", "zz_state").orderBy("time")
    p = p.withColumn("_p", F.lag("_x").over(kind))
    up, down = F.col("_x") > F.col("_p"), F.col("_x") < F.col("_p")
    p = p.withColumn("label", F.when(F.col("zz_state") == -1, F.when(up, "HH").when(down, "LH")).otherwise(F.when(up, "HL").when(down, "LL")))
    order = Window.partitionBy("symbol").orderBy("time")
    p = p.withColumn("_l", F.last("label", True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    is_ = lambda a, *b: F.coalesce((F.col("label") == a) & F.col("_l").isin(*b), F.lit(False)).cast("int")
    p = p.select("symbol", "time", "label", is_("HH", "HL", "HH").alias("bos_up"), is_("LL", "LH", "LL").alias("bos_down"), is_("HH", "LH", "LL").alias("choch_up"), is_("LL", "HL", "HH").alias("choch_down"))
    out = states.join(p, ["symbol", "time"], "left").fillna(0, ["bos_up", "bos_down", "choch_up", "choch_down"])
    turn = F.when((F.col("bos_up") == 1) | (F.col("choch_up") == 1), 1).when((F.col("bos_down") == 1) | (F.col("choch_down") == 1), -1)
    return out.withColumn("regime", F.coalesce(F.last(turn, True).over(by_time().rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
