"""Stores beside raw candles: processed frames and feature stores with manifests, calendars, specifications.

Frames are Parquet in any store that Spark can write; the small JSON beside them comes from aggregates.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import news
from . import bars as src

CALENDAR = "time_utc timestamp, currency string, impact string, title string, actual string, forecast string, previous string, revised string, detail string, window_before_min int, window_after_min int"


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.option("wholetext", True).text(path).first()[0])


def read_processed(spark: SparkSession, *paths: str, key: list[str] | None = None) -> DataFrame:
    """The first of several files (parquet or csv) that is there, one row a key (the last read), by key and time."""
    for path in paths:
        try:
            df = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.option("header", True).option("inferSchema", True).csv(path)
        except AnalysisException:
            continue
        kept = src.keep_last(df.withColumn("_seq", F.monotonically_increasing_id()), key or ["time"], F.col("_seq"))
        return kept.drop("_seq")
    raise FileNotFoundError(f"none of {', '.join(paths)}")


def merge_counted(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Old and new candles, the new winning; and (symbol, before, after): how many rows a symbol had and has."""
    merged = src.merge_append(old, new)
    n = lambda df, name: df.groupBy("symbol").agg(F.count(F.lit(1)).alias(name))
    counts = n(merged, "after").join(n(old, "before"), "symbol", "left").select("symbol", F.coalesce("before", F.lit(0)).cast("long").alias("before"), "after")
    return merged, counts


def sidecar(df: DataFrame, path: str, **more) -> dict:
    """Write what a raw or processed frame holds to path: rows, columns, first and last time, and what else is given."""
    data = {**src.describe(df), **more}
    src.write_json(df.sparkSession, path, data)
    return data


def save_processed(df: DataFrame, path: str, *, version: str, timeframes: list[str]) -> dict:
    """A processed frame with its manifest beside it."""
    df.write.mode("overwrite").option("compression", "snappy").parquet(path)
    return sidecar(df.sparkSession.read.parquet(path), f"{path}.manifest.json", config_version=version, timeframes=timeframes)


def families(columns: list[str]) -> dict[str, list[str]]:
    """Columns by family: the operator's name in __name@tf__column, else base."""
    out: dict[str, list[str]] = {}
    for c in columns:
        out.setdefault(c[2:].split("@")[0] if c.startswith("__") and "@" in c else "base", []).append(c)
    return out


def save_features(df: DataFrame, path: str, **more) -> DataFrame:
    """A feature store: features, a table of what each column covers, and a manifest. Returns that table."""
    from ..plans.spec import metadata

    own = [c for c in df.columns if c.startswith("__")]
    df.write.mode("overwrite").option("compression", "snappy").parquet(path)
    held = df.sparkSession.read.parquet(path)
    meta = metadata(held, own)
    meta.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}.meta")
    sidecar(held, f"{path}.meta.json", families={k: len(v) for k, v in families(df.columns).items()}, **more)
    return df.sparkSession.read.schema(meta.schema).option("header", True).csv(f"{path}.meta")


def save_trades(trades: DataFrame, path: str, form: str = "csv") -> DataFrame:
    """A trade log as CSV or JSON lines, read back."""
    w = trades.write.mode("overwrite")
    (w.option("header", True).csv if form == "csv" else w.json)(path)
    r = trades.sparkSession.read.schema(trades.schema)
    return r.option("header", True).csv(path) if form == "csv" else r.json(path)


def save_split(summary: DataFrame, path: str, base_tf: str, warmup: int = 0) -> dict:
    """The split summary of each symbol as one JSON file: at most a row a symbol and split."""
    data: dict = {"base_tf": base_tf, "warmup_bars": warmup, "symbols": {}}
    for r in summary.collect():
        data["symbols"].setdefault(r["symbol"], {})[r["split"]] = {"bars": r["bars"], "start": str(r["start"]), "end": str(r["end"])}
    src.write_json(summary.sparkSession, path, data)
    return data


def read_calendar(spark: SparkSession, path: str, tz: str = "UTC") -> DataFrame:
    """A local calendar file, CSV with a header or Parquet, in the one schema of calendars."""
    raw = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.option("header", True).csv(path)
    return news.normalise(raw, tz)


def load_calendar_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cached calendar, or one without rows where there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], CALENDAR)


def overlay_specs(snapshot: dict[str, dict], overlay: dict[str, dict]) -> dict[str, dict]:
    """Contract specifications of a terminal's snapshot, with what a file says about a symbol over them."""
    return {s: {**snapshot.get(s, {}), **{k: v for k, v in overlay.get(s, {}).items() if v is not None}} for s in {**snapshot, **overlay}}
