"""A long symbol over many tasks: ranges of (symbol, time), and what crosses their borders on a few rows.

A window by symbol has all rows of the symbol in one task. Here a symbol's rows are cut into ranges of some ROWS rows each,
by counts of fine steps of time, so one exchange deals rows of (symbol, range) out evenly however rows crowd in time. What
a range needs of those before it is small:

- operators that look back at most n rows: the last n rows of the range before, copied to it (`over_ranges`);
- linear recurrences: a range is one affine map; the maps of a symbol's ranges are chained on a row a range, and the
  value that enters a range is applied to all its rows (`ewm_over_ranges`);
- as-of joins: the last right row of the ranges before (`asof_over_ranges`).

Rows of one time stay in one range, so that ties are ordered as they are within a symbol. Rows with a null time
or symbol are in ranges of their own, at the symbol's start. The tables of symbols and steps are written,
and broadcast up to FEW rows; else, and where a table has a row a range, Spark chooses the join.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import KEY, TIME, keyed
from .scan import affine_scan

#: Rows that a range has, and steps of time that it is counted in.
ROWS, STEPS = 250_000, 64
#: Rows of a table of symbols or steps that may be broadcast.
FEW = 500_000
PART, HALO = "_range", "_halo"


def stored(df: DataFrame) -> DataFrame:
    """df written to the folder that all executors share and read again: computed once, and lost executors don't matter."""
    spark = df.sparkSession
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    path = f"{where.rstrip('/')}/tidemark/ranges-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _micros(time: str) -> Column:
    return F.unix_micros(F.col(time).cast("timestamp"))


def sent(df: DataFrame) -> DataFrame:
    """A stored table, marked to be broadcast if it has at most FEW rows."""
    return F.broadcast(df) if df.count() <= FEW else df


def cut(df: DataFrame, least: int = 1, rows: int = ROWS, *, by: str = KEY, time: str = TIME) -> DataFrame:
    """df with its range's number, from 0 on without gaps; each range of a symbol has at least `least` rows, or is its only one."""
    at = _micros(time)
    spans = df.groupBy(by).agg(F.min(at).alias("_from"), F.greatest(F.lit(1), F.max(at) - F.min(at) + 1).alias("_span"), F.ceil(F.count(F.lit(1)) / F.lit(rows)).alias("_parts"))
    spans = spans.select(F.col(by).alias("_by"), "_from", F.ceil(F.col("_span") / (F.col("_parts") * STEPS)).alias("_width"))
    given = df.join(sent(stored(spans)), F.col(by).eqNullSafe(F.col("_by"))).withColumn("_step", F.coalesce(F.floor((at - F.col("_from")) / F.col("_width")), F.lit(-1))).drop("_from", "_width")
    own = Window.partitionBy("_by")
    steps = given.groupBy("_by", "_step").agg(F.count(F.lit(1)).alias("_c"))
    before = F.sum("_c").over(own.orderBy("_step").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")
    steps = steps.withColumn("_p", F.floor(before / rows))
    # a range with too few rows goes to the one before it, or, at the start, to the one after
    steps = steps.withColumn("_n", F.sum("_c").over(Window.partitionBy("_by", "_p")))
    large = F.when(F.col("_n") >= least, F.col("_p"))
    steps = steps.withColumn("_q", F.coalesce(F.last(large, True).over(own.orderBy("_p").rangeBetween(Window.unboundedPreceding, 0)), F.min(large).over(own), F.lit(0)))
    steps = steps.select(F.col("_by").alias("_to"), F.col("_step").alias("_at"), (F.dense_rank().over(own.orderBy("_q")) - 1).alias(PART))
    found = given.join(steps, F.col("_by").eqNullSafe(F.col("_to")) & (F.col("_step") == F.col("_at")))
    return found.select(*[F.col(f"`{c}`") for c in df.columns], PART)


def over_ranges(df: DataFrame, fn: Callable[[DataFrame], DataFrame], reach: int, rows: int = ROWS) -> DataFrame:
    """What fn(df) gives, for an fn whose windows look back at most `reach` rows, range by range.

    fn is built of the windows of functions.frames. Columns that it adds are the same as over whole symbols.
    """
    given = cut(df, reach, rows)
    own = Window.partitionBy(KEY, PART).orderBy(F.desc(TIME))
    tail = given.withColumn("_back", F.row_number().over(own)).where(F.col("_back") <= reach).drop("_back")
    both = given.withColumn(HALO, F.lit(False)).unionByName(tail.withColumns({PART: F.col(PART) + 1, HALO: F.lit(True)}))
    # the copies sent past a symbol's last range have no rows of their own there and are dropped with the rest
    with keyed(KEY, PART):
        out = fn(both)
    return out.where(~F.col(HALO)).drop(HALO, PART)


def ewm_over_ranges(df: DataFrame, averages: dict[str, tuple[str | Column, float]], rows: int = ROWS) -> DataFrame:
    """Exponentially weighted means as scan.ewm gives, range by range."""
    maps, columns = {}, df.columns
    for i, (x, alpha) in enumerate(averages.values()):
        c = (F.col(x) if isinstance(x, str) else x).cast("double")
        keep = F.lit(1.0 - alpha)
        # the range as a map of what enters it: its factor, its value from 0, and its value if nothing came before
        maps |= {f"_a{i}": (keep, F.when(c.isNotNull(), 0.0), keep), f"_b{i}": (keep, c * alpha), f"_f{i}": (keep, c * alpha, c)}
    with keyed(KEY, PART):
        local = stored(affine_scan(cut(df, 1, rows), maps))
    n = range(len(averages))
    # the last row; of several at one time that after the most values, whose factor is smallest
    last = lambda i: F.struct(TIME, -F.coalesce(f"_a{i}", F.lit(2.0)))
    ends = local.groupBy(KEY, PART).agg(*[F.max_by(f"_{m}{i}", last(i)).alias(f"_{m}{i}") for i in n for m in "abf"])
    ends = ends.withColumnRenamed(PART, TIME)
    chained = affine_scan(ends, {f"_y{i}": (F.col(f"_a{i}"), F.col(f"_b{i}"), F.col(f"_f{i}")) for i in n})
    enter = chained.select(F.col(KEY).alias("_by"), (F.col(TIME) + 1).alias("_to"), *[f"_y{i}" for i in n])
    found = local.join(enter, F.col(KEY).eqNullSafe(F.col("_by")) & (F.col(PART) == F.col("_to")), "left")
    value = lambda i: F.when(F.col(f"_y{i}").isNull(), F.col(f"_f{i}")).when(F.col(f"_a{i}").isNull(), F.col(f"_y{i}")).otherwise(F.col(f"_a{i}") * F.col(f"_y{i}") + F.col(f"_b{i}"))
    return found.select(*[F.col(f"`{c}`") for c in columns], *[value(i).alias(name) for i, name in enumerate(averages)])


def asof_over_ranges(left: DataFrame, right: DataFrame, fields: list[str], *, prefix: str = "", tolerance_us: int | None = None, by: str = KEY, time: str = TIME, rows: int = ROWS) -> DataFrame:
    """The latest right row at or before each left row's time, as asof.asof gives, range by range."""
    names = left.columns
    held = F.struct(F.col(time).alias("_at"), *[F.col(f"`{f}`") for f in fields])
    both = left.select(*names, F.lit(1).alias("_side")).unionByName(right.select(by, time, held.alias("_r"), F.lit(0).alias("_side")), allowMissingColumns=True)
    both = cut(both, 1, rows, by=by, time=time)
    w = Window.partitionBy(by, PART).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    local = both.withColumn("_m", F.last("_r", True).over(w)).where("_side = 1")
    ends = both.groupBy(by, PART).agg(F.max_by("_r", F.when(F.col("_side") == 0, F.col(time))).alias("_r"))
    before = F.last("_r", True).over(Window.partitionBy(by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select(F.col(by).alias("_by"), F.col(PART).alias("_to"), before.alias("_before"))
    found = local.join(ends, F.col(by).eqNullSafe(F.col("_by")) & (F.col(PART) == F.col("_to")), "left").withColumn("_m", F.coalesce("_m", "_before"))
    near = F.lit(True) if tolerance_us is None else _micros(time) - F.unix_micros(F.col("_m._at").cast("timestamp")) <= tolerance_us
    return found.select(*[F.col(f"`{n}`") for n in names], *[F.when(near, F.col(f"_m.`{f}`")).alias(prefix + f) for f in fields])
