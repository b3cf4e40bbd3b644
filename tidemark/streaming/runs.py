"""Rows of a key in state: packed runs, put in order piece by piece.

A row of state a tick costs a call and a tuple a tick. Here each Arrow batch of a key is one value of a MapState, the bytes of
a numpy array. What is asked for in order is dealt to pieces of some PIECE rows by bounds (us, seq) from a sample of the
runs, as a sample sort does, again in state; then one piece is sorted at a time. Rows equal to a bound are a piece of their
own, which needs no sorting and goes on run by run. So a worker holds a piece, and a run for each piece, however
many rows a key or a moment has, and the work grows with the rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming.stateful_processor import StatefulProcessorHandle

#: Rows of a piece and of a run that is dealt to one, and every which row of a run is in the sample.
PIECE, RUN, EVERY = 131_072, 8192, 64
#: What stands for a null time or number: it is last in order.
LAST = np.iinfo(np.int64).max
ORDER = np.dtype([("us", "<i8"), ("seq", "<i8")])


class Runs:
    """Rows of a numpy kind whose first fields are us and seq. Keys of the state: piece (-1: none yet), number, earliest time, rows."""

    def __init__(self, handle: StatefulProcessorHandle, kind: np.dtype):
        self.kind = kind
        self.held = handle.getMapState("runs", "piece long, n long, low long, rows long", "data binary")
        self.numbers = handle.getValueState("runs_made", "n long")

    def _put(self, parts: list[tuple[int, np.ndarray]]) -> None:
        n = self.numbers.get()[0] if self.numbers.exists() else 0
        for piece, rows in parts:
            self.held.updateValue((piece, n, int(rows["us"].min()), len(rows)), (rows.tobytes(),))
            n += 1
        self.numbers.update((n,))

    def _get(self, key: tuple) -> np.ndarray:
        return np.frombuffer(bytes(self.held.getValue(key)[0]), self.kind)

    def _keys(self) -> list[tuple]:
        return sorted(tuple(k) for k in self.held.keys())

    def add(self, frames: Iterable[pd.DataFrame]) -> int | None:
        """Keep the rows of frames; the earliest time of them."""
        low = None
        for pdf in frames:
            if len(pdf):
                rows = np.empty(len(pdf), self.kind)
                for c in self.kind.names:
                    rows[c] = pdf[c].to_numpy()
                self._put([(-1, rows)])
                least = int(rows["us"].min())
                low = least if low is None else min(low, least)
        return low

    def first(self) -> int | None:
        """The earliest time of the rows that are held."""
        return min((k[2] for k in self._keys()), default=None)

    def upto(self, mark: int = LAST) -> Iterator[np.ndarray]:
        """Rows up to mark, taken out of the state, in order of (us, seq), piece by piece."""
        keys = [k for k in self._keys() if k[2] <= mark]
        pieces = -(-sum(k[3] for k in keys) // PIECE)
        if not keys:
            return
        bounds = np.empty(0, ORDER)
        if pieces > 1:
            sample = np.concatenate([self._get(k)[::EVERY][list(ORDER.names)].astype(ORDER) for k in keys])
            sample = sample[sample["us"] <= mark]
            sample = sample[np.lexsort((sample["seq"], sample["us"]))]
            bounds = np.unique(sample[(np.arange(1, pieces) * len(sample)) // pieces]) if len(sample) else bounds
        # the last of the parts is what waits
        dealt: list[list[np.ndarray]] = [[] for _ in range(2 * len(bounds) + 2)]
        count = [0] * len(dealt)
        waits = len(dealt) - 1
        spilled = False

        def spill(b: int) -> None:
            self._put([(b if b < waits else -1, np.concatenate(dealt[b]))])
            dealt[b], count[b] = [], 0

        for k in keys:
            rows = self._get(k)
            self.held.removeKey(k)
            to = np.where(rows["us"] > mark, waits, pieces_of(rows, bounds))
            order = np.argsort(to, kind="stable")
            rows, cuts = rows[order], np.searchsorted(to[order], np.arange(len(dealt) + 1))
            for b in np.unique(to):
                # a copy, as a part of few rows would hold on to its whole run
                dealt[b].append(rows[cuts[b] : cuts[b + 1]].copy())
                count[b] += len(dealt[b][-1])
                if count[b] >= RUN and (len(bounds) or b):
                    spill(b)
                    spilled = True
        if dealt[-1]:
            spill(waits)
        kept: dict[int, list[tuple]] = {}
        for k in self._keys() if spilled else []:
            kept.setdefault(k[0], []).append(k)
        for b in range(waits):
            parts = itertools.chain(map(self._take, kept.get(b, [])), dealt[b])
            dealt[b] = []
            if b % 2:
                yield from parts
            elif rows := list(parts):
                rows = np.concatenate(rows)
                yield rows[np.lexsort((rows["seq"], rows["us"]))]

    def _take(self, key: tuple) -> np.ndarray:
        rows = self._get(key)
        self.held.removeKey(key)
        return rows


def pieces_of(rows: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The piece of each row: 2i + 1 where it equals bound i, 2i where it lies before it and after the last one."""
    low, high = (np.searchsorted(bounds["us"], rows["us"], side=side) for side in ("left", "right"))
    on = np.flatnonzero(low < high)
    first = low[on]
    for at in np.unique(first):
        own = on[first == at]
        seqs, seq = bounds["seq"][at : high[own[0]]], rows["seq"][own]
        low[own], high[own] = (at + np.searchsorted(seqs, seq, side=side) for side in ("left", "right"))
    return low + high
