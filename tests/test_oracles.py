"""Each query that has SQL gives the rows that DuckDB gives for it (small scale, a part each)."""

import math

import duckdb
import pandas as pd
import pytest

from tidemark.plans import catalog, queries_data, queries_features, queries_indicators, queries_learning, queries_store, queries_swings  # noqa: F401

TABLES = ["events", "orders", "lineitem", "customer"]
NAMES = sorted(catalog.SQL)


def rows(df: pd.DataFrame) -> list:
    def value(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return None
        if hasattr(v, "year"):
            return str(pd.Timestamp(v))
        return round(float(v), 5) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)

    return sorted((tuple(value(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, duck, name):
    got = catalog.QUERIES[name](spark, sf).toPandas()
    want = duck.execute(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_is_registered_once():
    assert set(catalog.SQL) <= set(catalog.QUERIES) and len(catalog.QUERIES) > 120


def test_catalogue_needs_no_session():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0 and int(done.stdout) > 120, done.stderr
