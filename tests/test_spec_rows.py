"""Bars of one time: a spec gives a row a bar, whatever operators rebuild their rows."""

from datetime import datetime, timedelta

import pytest

from tidemark.plans import spec

SCHEMA = "symbol string, time timestamp, open double, high double, low double, close double, volume long, note string"


def bars(spark, n=60, twice=(7, 8, 40)):
    out = []
    for s in ("A", "B"):
        for i in range(n):
            c = 100 + (i * 37 % 11) - 5 + (i % 7) / 3
            rows = [(s, datetime(2024, 1, 1) + timedelta(hours=4 * i), c - 0.5, c + 1.5, c - 1.25, c, 10 + i, f"{s}{i}")]
            if i in twice:
                rows.append((s, rows[0][1], c, c + 2, c - 2, c + 0.25, 5, f"{s}{i}b"))
            out += rows
    return spark.createDataFrame(out, SCHEMA)


@pytest.mark.parametrize("specs", [["rsi(14)", "bbands(close,20,2)"], ["sr_fusion", "ema(close,5)"], ["rsi(14)", "sr_fusion", "rsi(14)@D1", "zigzag(3,5,2)"]])
def test_repeated_times_keep_the_row_count(spark, specs):
    known = [s for s in specs if s.split("(")[0].split("@")[0] in spec.REGISTRY]
    assert len(known) >= 2
    df = bars(spark)
    got = spec.run_specs(df, known, "H4")
    assert got.count() == df.count() == 126
    assert got.columns[: len(df.columns)] == df.columns
    assert sorted(r["note"] for r in got.select("note").collect()) == sorted(r["note"] for r in df.select("note").collect())


def test_every_operator_keeps_the_rows(spark):
    df = bars(spark, 40)
    known = []
    for name in sorted(spec.REGISTRY):
        try:
            spec.bind(spec.parse(name))
        except (TypeError, ValueError, KeyError):
            continue  # has arguments without a default
        known.append(name)
    assert len(known) > 30
    for i in range(0, len(known), 10):
        assert spec.run_specs(df, known[i : i + 10], "H4").select("note").count() == df.count(), known[i : i + 10]


@pytest.mark.parametrize("text, value", [("14", 14), (".382", 0.382), ("1e-3", 0.001), ("'a,b'", "a,b"), ("TRUE", True), ("null", None), ("M15", "M15"), ("5m", "5m"), ("[M1, 'x', 2.5]", ["M1", "x", 2.5]), ("[[1],(2,3)]", [[1], [2, 3]]), ("a b", "a b"), ("[1", "[1"), ("x]", "x]"), ("", "")])
def test_values(text, value):
    assert spec.literal(text) == value
