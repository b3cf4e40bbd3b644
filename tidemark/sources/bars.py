"""Ticks to bars, raw candle readers and writers, metadata.

The reading functions declare their schema; names are matched without case where files are foreign.
"""

from __future__ import annotations

import json
import re
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CANDLES = "symbol string, tf string, time timestamp, open double, high double, low double, close double, volume long, spread long"
RAW = ["time", "open", "high", "low", "close", "volume", "spread"]


def seconds(tf: str) -> int:
    """Seconds of a timeframe such as M15, H4, D1 or W1."""
    m = re.fullmatch(r"([MHDW])(\d+)", tf.upper())
    if not m:
        raise ValueError(f"no timeframe: {tf}")
    return {"M": 60, "H": 3600, "D": 86400, "W": 604800}[m[1]] * int(m[2])


def micros(c: Column | str) -> Column:
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def bucket(c: Column | str, tf: str, closed: str = "right") -> Column:
    """Label of the bar a time falls into: right-closed bars are labelled by their end, left-closed
    ones by their start. Weeks end on Sunday 00:00."""
    w = seconds(tf) * 1_000_000
    shift = 4 * 86_400 * 1_000_000 if tf.upper().startswith("W") else 0  # the epoch is a Thursday
    at = micros(c) + F.lit(shift + (w - 1 if closed == "right" else 0))
    return F.timestamp_micros(at - F.pmod(at, F.lit(w)) - F.lit(shift))


def ticks_to_bars(ticks: DataFrame, tf: str = "H4", *, symbol: str = "event_type", time: str = "ts", price: str = "value", order: str = "event_id") -> DataFrame:
    """One shuffle: partial first/last/max/min/count per (symbol, bucket). Null prices are no ticks."""
    t = ticks.where(F.col(price).isNotNull()).select(F.col(symbol).alias("symbol"), bucket(time, tf).alias("time"), F.col(price).cast("double").alias("p"), F.struct(F.col(time), F.col(order)).alias("o"))
    return t.groupBy("symbol", "time").agg(F.min_by("p", "o").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "o").alias("close"), F.count(F.lit(1)).alias("volume"))


def resample(bars: DataFrame, tf: str, closed: str = "right") -> DataFrame:
    """Bars of a higher timeframe; empty bins are not made."""
    b = bars.withColumn("_b", bucket("time", tf, closed))
    return b.groupBy("symbol", F.col("_b").alias("time")).agg(F.min_by("open", b["time"]).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", b["time"]).alias("close"), F.sum("volume").alias("volume"))


def keep_last(df: DataFrame, keys: list[str], sequence: Column) -> DataFrame:
    """One row of each key: that with the largest sequence."""
    w = Window.partitionBy(*keys).orderBy(sequence.desc())
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def normalise(raw: DataFrame, symbol: str, tf: str) -> DataFrame:
    """The candle schema from any raw frame: unparsable numbers and times become null, rows without time go,
    of rows with one time the last read stays."""
    have = {c.lower(): c for c in raw.columns}
    have.setdefault("volume", have.get("tick_volume", have.get("real_volume")))
    as_type = {"time": "timestamp", "volume": "long", "spread": "long"}
    cols = [(F.expr(f"try_cast(`{have[c]}` as {as_type.get(c, 'double')})") if have.get(c) else F.lit(None).cast(as_type.get(c, "double"))).alias(c) for c in RAW]
    df = raw.select(F.lit(symbol).alias("symbol"), F.lit(tf).alias("tf"), *cols, F.monotonically_increasing_id().alias("_seq")).where("time is not null")
    return keep_last(df, ["symbol", "tf", "time"], F.col("_seq")).drop("_seq")


def read_raw(spark: SparkSession, path: str, symbol: str, tf: str) -> DataFrame:
    """A raw candle file, by its suffix; other suffixes are an error."""
    kind = PurePosixPath(path).suffix.lstrip(".")
    if kind == "parquet":
        return normalise(spark.read.parquet(path), symbol, tf)
    if kind == "csv":
        return normalise(spark.read.option("header", True).csv(path), symbol, tf)
    raise ValueError(f"neither parquet nor csv: {path}")


def last_candles(bars: DataFrame, symbol: str, n: int) -> DataFrame:
    return bars.where(F.col("symbol") == symbol).orderBy(F.col("time").desc()).limit(n)


def candles_between(bars: DataFrame, symbol: str, start: str, end: str) -> DataFrame:
    return bars.where((F.col("symbol") == symbol) & F.col("time").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def merge_append(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new candles, the new winning where both have a time."""
    both = old.withColumn("_seq", F.lit(0)).unionByName(new.withColumn("_seq", F.lit(1)), allowMissingColumns=True)
    return keep_last(both, [c for c in ("symbol", "tf", "time") if c in both.columns], F.col("_seq")).drop("_seq")


def write_candles(df: DataFrame, path: str) -> None:
    """Partitioned by symbol and timeframe; only the partitions in df are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "snappy").partitionBy("symbol", "tf").parquet(path)


def write_json(spark: SparkSession, path: str, data: dict) -> None:
    """A small JSON file in any store that Spark can write."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(json.dumps(data, default=str, sort_keys=True).encode())
    finally:
        out.close()


def describe(df: DataFrame) -> dict:
    """What a manifest says of a frame: rows, columns, first and last time."""
    row = df.agg(F.count(F.lit(1)).alias("rows"), F.min("time").alias("first"), F.max("time").alias("last")).first()
    return {"rows": row["rows"], "columns": df.columns, "first": row["first"], "last": row["last"]}


def download_plan(symbols: DataFrame, timeframes: DataFrame, policy: Column) -> DataFrame:
    """Every symbol with every timeframe; both are small dimensions, joined by a constant key."""
    return symbols.withColumn("_k", F.lit(1)).join(F.broadcast(timeframes.withColumn("_k", F.lit(1))), "_k").drop("_k").withColumn("bars", policy)


def publish(processed: DataFrame, features: DataFrame) -> DataFrame:
    """Only new feature columns, joined on (symbol, time)."""
    new = [c for c in features.columns if c not in processed.columns]
    return processed.join(features.select("symbol", "time", *new), ["symbol", "time"], "left")


def symbol_specs(spark: SparkSession, specs: dict[str, dict]) -> DataFrame:
    """Contract specifications as a small dimension table."""
    fields = {"digits": "int", "point": "double", "trade_tick_value": "double", "trade_tick_size": "double", "contract_size": "double", "volume_min": "double", "volume_step": "double", "volume_max": "double", "pip_value_per_lot": "double"}
    rows = [(s, *[(int if t == "int" else float)(v[f]) if v.get(f) is not None else None for f, t in fields.items()]) for s, v in specs.items()]
    return spark.createDataFrame(rows, "symbol string, " + ", ".join(f"{f} {t}" for f, t in fields.items()))
