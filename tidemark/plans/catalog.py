"""Every query of the engine with the SQL it must agree with.

A query takes (spark, sf_dir); events are ticks (event_type the symbol, value the price). Doubles are
rounded to six places, times leave as timestamp_ntz.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.bars import ticks_to_bars

TF = "H4"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def symbols(spark: SparkSession, sf_dir: str) -> list[str]:
    """The symbols that there are ticks of."""
    return [r[0] for r in events(spark, sf_dir).select("event_type").distinct().orderBy("event_type").collect() if r[0] is not None]


def bars(spark: SparkSession, sf_dir: str, tf: str = TF) -> DataFrame:
    return ticks_to_bars(events(spark, sf_dir), tf)


def shared(spark: SparkSession) -> str:
    """A folder that driver and executors share: under spark.checkpoint.dir, or, on one machine only, in the warehouse where that is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = spark.conf.get("spark.sql.warehouse.dir")
    return f"{where}/tidemark"


def out(df: DataFrame, *cols: str | Column) -> DataFrame:
    """Chosen columns as a query returns them: doubles rounded, -0.0 as 0.0, times without zone."""
    df = df.select(*cols) if cols else df
    shown = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        shown.append(c.alias(f.name))
    return df.select(*shown)


#: Right-closed H4 bars of the events, and the row number within a symbol.
BARS_SQL = """
ticks as (select event_type as symbol, value as p, ts, event_id, make_timestamp(((epoch_us(ts) + {w} - 1) // {w}) * {w}) as time from events where value is not null),
bars as (select symbol, time, first(p order by ts, event_id) as open, max(p) as high, min(p) as low, last(p order by ts, event_id) as close, count(*) as volume from ticks group by symbol, time),
b as (select *, row_number() over (partition by symbol order by time) as rn, lag(close) over (partition by symbol order by time) as pc from bars)
"""


def with_bars(body: str, width_us: int = 4 * 3600 * 1_000_000, recursive: bool = False) -> str:
    """SQL over b; body may begin with further common tables, each ending in a comma."""
    head = "with recursive " if recursive else "with "
    ctes, select = (body.split("===", 1) + [""])[:2] if "===" in body else ("", body)
    return head + BARS_SQL.replace("{w}", str(width_us)).strip() + (", " + ctes.strip().rstrip(",") if ctes.strip() else "") + " " + select.strip()


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; sql None: it has none (the tests hold it against other means)."""

    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def over_bars(name: str, sql: str | None, fn: Callable[[DataFrame], DataFrame], cols: list[str], tf: str = TF) -> None:
    """Register fn over bars, returning symbol, time and cols."""
    QUERIES[name] = lambda spark, d: out(fn(bars(spark, d, tf)), "symbol", "time", *cols)
    if sql is not None:
        SQL[name] = sql


def win(n: int) -> str:
    return f"(partition by symbol order by time rows between {n - 1} preceding and current row)"


def full(agg: str, c: str, n: int, least: int | None = None) -> str:
    """agg(c) over the last n rows once `least` of them have a value."""
    return f"case when count({c}) over {win(n)} >= {least or n} then {agg}({c}) over {win(n)} end"


def ewm_sql(c: str, alpha: str | float) -> str:
    """Exponential mean of c (null only before its first value), by folding the list of its values."""
    values = f"list_filter(list({c}) over (partition by symbol order by time rows between unbounded preceding and current row), lambda x: x is not null)"
    return f"list_reduce(list_prepend(cast(null as double), {values}), lambda a, v: case when a is null then v else a * (1 - {alpha}) + v * {alpha} end)"


def r6(c: str, name: str) -> str:
    return f"round({c}, 6) + 0.0 as {name}"
