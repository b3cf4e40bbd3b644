"""As-of, interval and range joins over (symbol, time).

As-of joins are one union and one window: no join node, one shuffle by symbol, and the right side's
rows carry a struct, so nulls inside a matched row stay. Interval joins keep an interval under cells of
several widths, so that they are equi-joins with a residual check instead of nested loops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, fields: list[str], *, prefix: str = "", tolerance_us: int | None = None, by: str = "symbol", time: str = "time") -> DataFrame:
    """The latest right row at or before each left row's time, within the tolerance (inclusive)."""
    return asof_many(left, [(right, fields)], prefix=prefix, tolerance_us=tolerance_us, by=by, time=time)


def asof_many(left: DataFrame, rights: list[tuple[DataFrame, list[str]]], *, prefix: str = "", tolerance_us: int | None = None, by: str = "symbol", time: str = "time") -> DataFrame:
    """As-of joins of several right sides at once: one union and one window for all of them."""
    names, at = left.columns, F.unix_micros(F.col(time).cast("timestamp"))
    both = left.select(*names, F.lit(1).alias("_side"))
    for i, (right, fields) in enumerate(rights):
        both = both.unionByName(right.select(by, time, F.struct(F.col(time).alias("_at"), *[F.col(f"`{f}`") for f in fields]).alias(f"_r{i}"), F.lit(0).alias("_side")), allowMissingColumns=True)
    w = Window.partitionBy(by).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    held = [F.last(f"_r{i}", True).over(w).alias(f"_m{i}") for i in range(len(rights))]
    joined = both.select(*[F.col(f"`{n}`") for n in names], "_side", *held).where("_side = 1")
    found = []
    for i, (_, fields) in enumerate(rights):
        near = F.lit(True) if tolerance_us is None else at - F.unix_micros(F.col(f"_m{i}._at").cast("timestamp")) <= tolerance_us
        found += [F.when(near, F.col(f"_m{i}.`{f}`")).alias(prefix + f) for f in fields]
    return joined.select(*[F.col(f"`{n}`") for n in names], *found)


def median_step(df: DataFrame, by: str = "symbol", time: str = "time") -> DataFrame:
    """(symbol, step): the median distance of neighbouring rows in microseconds."""
    w = Window.partitionBy(by).orderBy(time)
    t = F.unix_micros(F.col(time).cast("timestamp"))
    return df.select(by, (t - F.lag(t).over(w)).alias("d")).groupBy(by).agg(F.percentile("d", F.lit(0.5)).alias("step"))


#: The interval index: steps of the finest level (microseconds), steps of a level in one of the next, and levels.
UNIT_US, FAN, LEVELS = 1 << 26, 16, 8


def interval_cells(start: Column, end: Column) -> Column:
    """The array of (level, cell) that cover the steps from start to end, both in microseconds, once: at most 2 * FAN a level.

    From the finest level up, what sticks out of whole cells of the next level is given as cells of this one.
    """
    fan, unit = F.lit(FAN).cast("long"), F.lit(UNIT_US).cast("long")
    cells = "array<struct<level:int,cell:bigint>>"

    def level(acc: Column, k: Column) -> Column:
        lo, hi = acc["lo"], acc["hi"]  # the steps left, hi exclusive
        top = k == LEVELS - 1
        inner = F.when(top, hi).otherwise(F.least(hi, F.ceil(lo / fan) * fan))
        outer = F.when(top, hi).otherwise(F.greatest(inner, F.floor(hi / fan) * fan))
        some = lambda a, b: F.when(a < b, F.transform(F.sequence(a, F.greatest(a, b - 1)), lambda c: F.struct(k.alias("level"), c.alias("cell")))).otherwise(F.array().cast(cells))
        more = F.concat(acc["cells"], some(lo, inner), some(outer, hi))
        # most intervals are used up at the second level
        return F.when(lo < hi, F.struct(F.ceil(inner / fan).alias("lo"), F.floor(outer / fan).alias("hi"), more.cast(cells).alias("cells"))).otherwise(acc)

    begin = F.struct(F.floor(start / unit).alias("lo"), (F.floor(end / unit) + 1).alias("hi"), F.array().cast(cells).alias("cells"))
    found = F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS - 1)), begin, level)["cells"]
    return F.when(start <= end, found)


def in_interval(points: DataFrame, intervals: DataFrame, *, time: str = "time", start: str = "start", end: str = "end", on: list[str] | None = None) -> DataFrame:
    """Pairs of points and the intervals that hold them (both ends inclusive).

    An interval is kept under few cells, coarse ones for its inside, fine ones at its ends; a point looks in the one
    cell of each level that holds it. So a long interval is no more rows than a short one, a point meets
    an interval once, and only at an interval's ends one that doesn't hold it. Nulls are in no interval.
    """
    i = _in_cells(intervals, start, end)
    return _with_cells(points, i, time).join(i, ["_l", "_b", *(on or [])]).where(F.col(time).between(F.col(start), F.col(end))).drop("_l", "_b")


def _us(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def _in_cells(intervals: DataFrame, start: str, end: str) -> DataFrame:
    """A row for each interval and cell: its columns, _l the level, _b the cell."""
    return intervals.withColumn("_c", F.explode(interval_cells(_us(start), _us(end)))).select("*", F.col("_c.level").alias("_l"), F.col("_c.cell").alias("_b")).drop("_c")


def _with_cells(points: DataFrame, index: DataFrame, time: str) -> DataFrame:
    """A row for each point and level of the index: its columns, _l the level, _b the cell that holds it."""
    used = sorted(r[0] for r in index.select("_l").distinct().collect())  # LEVELS rows at most
    at = [F.struct(F.lit(k).alias("_l"), F.floor(_us(time) / F.lit(UNIT_US * FAN**k)).alias("_b")) for k in used or [0]]
    return points.withColumn("_c", F.explode(F.array(*at))).select("*", "_c._l", "_c._b").drop("_c")


#: Intervals of a cell that are kept in one row, points of a cell that go to one task, pairs that a task is meant to list, and tasks beyond which it lists more.
SLICE, CHUNK, SHARE, TASKS = 1 << 10, 1 << 16, 1 << 25, 1 << 12


def interval_slices(intervals: DataFrame, *, start: str = "start", end: str = "end") -> DataFrame:
    """The interval index with a row for up to SLICE intervals of a cell: (_l, _b, _s, _held, _k), _s numbers a cell's slices from 0, _k counts the slice."""
    w = Window.partitionBy("_l", "_b").orderBy(start, end)
    i = _in_cells(intervals, start, end).withColumn("_s", F.floor((F.row_number().over(w) - 1) / F.lit(SLICE)))
    return i.groupBy("_l", "_b", "_s").agg(F.collect_list(F.struct(*intervals.columns)).alias("_held"), F.count(F.lit(1)).alias("_k"))


def interval_counts(slices: DataFrame) -> DataFrame:
    """(_l, _b, _n): the cells of interval_slices() and how many intervals each has."""
    return slices.groupBy("_l", "_b").agg(F.sum("_k").alias("_n"))


def points_in_cells(points: DataFrame, slices: DataFrame, *, time: str = "time", counts: DataFrame | None = None) -> DataFrame:
    """Points beside each cell of interval_slices() that holds them (_l, _b, and _n, its intervals): at most a row a level, however many intervals meet.

    points may be a stream; pairs_of() makes of what it wrote the rows of in_interval(). counts: interval_counts() of the slices, where they
    have been written, so that Spark knows how few they are.
    """
    counts = interval_counts(slices) if counts is None else counts
    return _with_cells(points, counts, time).join(counts, ["_l", "_b"])


def pairs_of(found: DataFrame, slices: DataFrame, *, time: str = "time", start: str = "start", end: str = "end") -> DataFrame:
    """The pairs of in_interval() from points_in_cells(). Points meet whole slices, which are unfolded as they are read: pairs are neither sent nor kept.

    Tasks are as many as the pairs ask for, not as the bytes that are shuffled, and a crowded cell is dealt to several of them by its slices and by chunks of its points.
    """
    names, cell = [c for c in found.columns if c not in ("_l", "_b", "_n")], ["_l", "_b"]
    tasks = min((found.agg(F.sum("_n")).first()[0] or 0) // SHARE + 1, TASKS)
    # one row in CHUNK points at most
    crowded = F.broadcast(found.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / F.lit(CHUNK)).alias("_m")).where("_m > 1"))
    chunks = F.coalesce(F.col("_m"), F.lit(1).cast("long"))
    from_0 = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    p = found.join(crowded, cell, "left").withColumn("_c", F.pmod(F.xxhash64(*names), chunks)).withColumn("_s", from_0(F.ceil(F.col("_n") / F.lit(SLICE))))
    s = slices.join(crowded, cell, "left").withColumn("_c", from_0(chunks))
    both = [*cell, "_s", "_c"]
    p, s = p.select(*names, *both).repartition(tasks, *both), s.select(*both, "_held").repartition(tasks, *both)
    return p.join(s, both).select(*names, F.inline("_held")).where(F.col(time).between(F.col(start), F.col(end)))


def fill_ranges(points: DataFrame, legs: DataFrame, fields: list[str], *, position: str = "pos", start: str = "start_pos", end: str = "end_pos", by: str = "symbol") -> DataFrame:
    """Each point gets the fields of the latest-starting leg [start, end) that holds it.

    Legs follow each other, so the latest start at or before a position is the only candidate: an
    as-of join on position and a check of its end.
    """
    r = legs.select(by, F.col(start).alias(position), F.col(end).alias("_end"), *fields)
    out = asof(points, r, ["_end", *fields], time=position, by=by)
    hit = F.col(position) < F.col("_end")
    return out.select(*points.columns, *[F.when(hit, F.col(f)).alias(f) for f in fields])


def nearest(price: Column, levels: Column) -> Column:
    """(distance, level) of the level nearest to the price; of equal ones the first."""
    found = F.array_min(F.transform(levels, lambda v, i: F.struct(F.abs(price - v).alias("d"), i.alias("i"), v.alias("level"))))
    return F.struct(found["d"].alias("distance"), found["level"].alias("level"))


def stretch(base: DataFrame, higher: DataFrame, field: str, out: str, by: str = "symbol", time: str = "time") -> DataFrame:
    """Positional alignment: the higher rows are laid over the base rows in equal steps."""
    w = Window.partitionBy(by).orderBy(time)
    b = base.withColumn("_i", F.row_number().over(w) - 1)
    n = base.groupBy(by).agg(F.count(F.lit(1)).alias("_nb")).join(higher.groupBy(by).agg(F.count(F.lit(1)).alias("_nh")), by)
    h = higher.select(by, (F.row_number().over(w) - 1).alias("_j"), F.last(field, True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(out))
    b = b.join(n, by).withColumn("_j", F.least(F.floor(F.col("_i") / F.greatest(F.lit(1), F.floor(F.col("_nb") / F.col("_nh")))), F.col("_nh") - 1).cast("int"))
    return b.join(h, [by, "_j"], "left").drop("_i", "_j", "_nb", "_nh")
