"""Packed runs of stream state: order, what waits, pieces of bounded size, and processors over them."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from tidemark.streaming import ordered, positions, runs


class Value:
    def __init__(self):
        self.v = None

    exists = lambda self: self.v is not None
    get = lambda self: self.v

    def update(self, v):
        self.v = v


class Held(dict):
    getValue, updateValue, removeKey = dict.__getitem__, dict.__setitem__, dict.pop  # noqa: N815


class Handle:
    def __init__(self):
        self.timers = []

    getMapState = lambda self, *a: Held()  # noqa: E731, N815
    getValueState = lambda self, *a: Value()  # noqa: E731, N815

    def registerTimer(self, ms):  # noqa: N802
        self.timers.append(ms)


class Mark:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = lambda: ms


def frames(n, seed=0, last=5000):
    r = np.random.default_rng(seed)
    pdf = pd.DataFrame({"us": r.integers(0, last, n) * 1000, "seq": r.permutation(n), "price": r.integers(0, 400, n) / 4.0})
    return pdf, [pdf.iloc[at : at + 1000] for at in range(0, n, 1000)]


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(runs, "PIECE", 4000)
    monkeypatch.setattr(runs, "RUN", 500)


def test_rows_come_in_order_in_bounded_pieces_and_the_rest_waits(small):
    pdf, parts = frames(50_000)
    held = runs.Runs(Handle(), ordered.ROW)
    assert held.add(parts) == pdf["us"].min()
    for low, high in ((-1, 3_000_000), (3_000_000, 3_000_500), (3_000_500, runs.LAST)):
        got = list(held.upto(high))
        want = pdf[(pdf["us"] > low) & (pdf["us"] <= high)].sort_values(["us", "seq"])
        assert [tuple(r) for g in got for r in g.tolist()] == list(want.itertuples(index=False, name=None))
        assert all(len(g) < 8000 for g in got)
        rest = pdf["us"][pdf["us"] > high]
        assert held.first() == (rest.min() if len(rest) else None) and sum(k[3] for k in held.held) == len(rest)


@pytest.mark.parametrize("times, numbers", [(1, 50_000), (2, 50_000), (7, 3), (1, 1)])
def test_rows_of_one_moment_are_dealt_to_bounded_pieces_too(small, times, numbers):
    """Crowded moments, and repeated or missing numbers in them, whose order is left open."""
    pdf, parts = frames(50_000, 4, times)
    parts = [p.assign(seq=p["seq"] % numbers if numbers > 1 else runs.LAST) for p in parts]
    held = runs.Runs(Handle(), ordered.ROW)
    held.add(parts)
    got = list(held.upto())
    assert all(len(g) < 8000 for g in got)
    assert not held.held and held.first() is None
    rows, want = np.concatenate(got), pd.concat(parts).sort_values(["us", "seq", "price"])
    assert list(zip(rows["us"].tolist(), rows["seq"].tolist())) == list(zip(want["us"], want["seq"]))
    assert sorted(rows.tolist()) == list(want.itertuples(index=False, name=None))


def through(processor, parts, marks):
    """What a processor makes of parts and then of timers at marks."""
    processor.init(Handle())
    out = list(processor.handleInputRows(("A",), iter(parts), None))
    for m in marks:
        out += list(processor.handleExpiredTimer(("A",), Mark(m), None))
    return out


def test_means_and_spikes_carry_over_pieces(small):
    pdf, parts = frames(30_000, 1)
    want = pdf.sort_values(["us", "seq"])
    out = through(ordered.Mean(0.1), parts, [2500, 2500, 9000])
    assert max(map(len, out)) < 8000
    np.testing.assert_allclose(pd.concat(x for x in out if len(x))["ewm"].astype(float), want["price"].ewm(alpha=0.1, adjust=False).mean(), rtol=1e-9)
    out = pd.concat(x for x in through(ordered.Spikes(50.0), parts, [2500, 9000]) if len(x))
    assert out["previous"].astype(float).tolist()[1:] == want["price"].tolist()[:-1]
    assert out["spike"].tolist() == (want["price"].diff().abs() > 50).astype(int).tolist()


def test_no_gap_is_an_empty_column_of_strings():
    """Nothing is stale: the column of symbols must still be one of strings to Arrow."""
    _, parts = frames(2000, 2)
    out = through(ordered.Stale(10_000_000), parts, [5000])
    for pdf in out:
        assert isinstance(pa.Array.from_pandas(pdf["symbol"], type=pa.string()), pa.StringArray)
    assert sum(map(len, out)) == 0


def test_positions_are_managed_piece_by_piece(small):
    pdf, parts = frames(20_000, 3)
    more = {"atr": 8.0, "side": 1, "distance": 20.0, "lots": 1.0}
    rules = {"every": 5, "even_r": 1.0, "trail": 1.0, "scale": ((2.0, 0.25),)}
    out = through(positions.Manager(**rules), [p.assign(**more) for p in parts], [])
    assert max(map(len, out)) < 8000
    state, want = None, []
    for us, _, price in pdf.sort_values(["us", "seq"]).itertuples(index=False, name=None):
        state, r, event = positions.follow(state, price, *more.values(), **rules)
        want.append(("A", us, price, r, state[1], state[2], event))
    assert list(pd.concat(out).itertuples(index=False, name=None)) == want
