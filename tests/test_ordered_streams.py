"""Streams in event order: shuffled micro-batches give what one sorted batch gives; timers need no input."""

import numpy as np
import pandas as pd
import pytest

from tidemark.streaming import live
from tidemark.streaming.ordered import stale_ticks

TICKS = "symbol string, time timestamp, seq long, price double"


def ticks_of(n, seed=0, symbols=("A", "B", None)):
    r = np.random.default_rng(seed)
    at = pd.Timestamp("2024-01-01") + pd.to_timedelta(r.integers(0, 400_000, n), unit="s")
    return pd.DataFrame({"symbol": r.choice(symbols[:2], n), "time": at, "seq": np.arange(n), "price": r.integers(0, 1000, n) / 4.0})


def replayed(spark, tmp_path, pdf, parts, fn, name):
    """Run fn over pdf in shuffled micro-batches, one file each, and a heartbeat after them."""
    pdf = pdf.sample(frac=1, random_state=1)
    folder = tmp_path / name
    folder.mkdir()
    beat = pd.DataFrame({"symbol": pd.array([None], "string"), "time": [pdf["time"].max() + pd.Timedelta(days=60)], "seq": pd.array([None], "Int64"), "price": [np.nan]})
    for i, own in enumerate([*np.array_split(np.arange(len(pdf)), parts), None]):
        rows = pdf.iloc[own] if own is not None else beat
        rows.assign(time=rows["time"].dt.tz_localize("UTC").dt.as_unit("us")).to_parquet(folder / f"{i:03d}.parquet", index=False)
    stream = spark.readStream.schema(TICKS).option("maxFilesPerTrigger", 1).parquet(f"file://{folder}")
    q = fn(stream).writeStream.format("parquet").option("path", f"file://{tmp_path}/{name}-out").option("checkpointLocation", f"file://{tmp_path}/{name}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"file://{tmp_path}/{name}-out").toPandas()


@pytest.mark.parametrize("parts", [1, 10])
def test_spikes_of_shuffled_batches(spark, tmp_path, parts):
    """100,000 ticks: many Arrow batches a key, in one micro-batch or mixed over ten."""
    pdf = ticks_of(100_000)
    got = replayed(spark, tmp_path, pdf, parts, lambda s: live.price_spikes(s, 50.0, late="30 days"), "spikes")
    want = pdf.sort_values(["time", "seq"])
    want["previous"] = want.groupby("symbol")["price"].shift(1)
    want["spike"] = ((want["price"] - want["previous"]).abs() > 50).astype(int)
    key = ["symbol", "time", "price", "previous", "spike"]
    pd.testing.assert_frame_equal(got[key].sort_values(key).reset_index(drop=True), want[key].sort_values(key).reset_index(drop=True), check_dtype=False)


def test_mean_of_shuffled_batches(spark, tmp_path):
    pdf = ticks_of(25_000, 3)
    got = replayed(spark, tmp_path, pdf, 4, lambda s: live.stream_ewm(s, 0.1, late="30 days"), "mean").set_index("seq")["ewm"].sort_index()
    want = pdf.sort_values(["time", "seq"]).set_index("seq").groupby("symbol")["price"].transform(lambda x: x.ewm(alpha=0.1, adjust=False).mean()).sort_index()
    np.testing.assert_allclose(got.to_numpy(), want.to_numpy(), rtol=1e-9)


def test_stale_rows_appear_without_input(spark, tmp_path):
    """Gaps inside the stream and after its last tick, of which no later tick of the symbol tells."""
    pdf = ticks_of(3000, 5)
    got = replayed(spark, tmp_path, pdf, 5, lambda s: stale_ticks(s, 600, late="30 days"), "stale")
    own = pdf.sort_values(["time", "seq"])
    gap = own.groupby("symbol")["time"].shift(-1) - own["time"]
    want = own[gap.isna() | (gap > pd.Timedelta(seconds=600))]
    assert sorted(zip(got["symbol"], got["time"])) == sorted(zip(want["symbol"], want["time"]))
    assert ((got["due"] - got["time"]) == pd.Timedelta(seconds=600)).all()
    assert len(want) > 20 and gap[want.index].isna().sum() == 2
