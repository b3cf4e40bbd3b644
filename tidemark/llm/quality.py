"""Operator 4: a quality classifier, a byte-level convolutional network in numpy.

A text is its UTF-8 bytes, cut into overlapping chunks that cover all of it. FILTERS learned filters
over WIDTH neighbouring bytes run along each chunk; their responses are max-pooled over blocks of
BLOCK bytes, and the largest and the mean pool of a chunk are kept. Beside them stand planes that
mark bytes which repeat the bytes before them with some period (repetition is not local, so byte
filters alone don't see it). A hidden layer makes a chunk's features, the largest and the mean over
all chunks make a document's, and a logistic unit gives one probability.

The network is fitted on the driver with at most PER_CLASS labelled documents of each label, on all
chunks of them, in the same number of steps whatever their number; scores use every byte of every text.
Null and empty texts are one empty chunk; a very long text is worked off in groups of chunks. Repeated
rows get equal scores, rows with a null id one like others, an empty table none. With no labels of both
kinds to learn from every score is the only label's, or 1 with none. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .training import fitted, remainder

CHUNK, STRIDE, BLOCK = 512, 448, 32
WIDTH, FILTERS, HIDDEN = 4, 16, 24
#: Periods whose repetition a plane marks.
PERIODS = [(2, 3, 4), (5, 6, 7, 8, 9), (10, 11, 12, 13, 14, 15, 16)]
PER_CLASS = 2500
#: Steps of the training, documents and (but for one document that has more) chunks of a step.
STEPS, BATCH, BATCH_CHUNKS, RATE = 800, 32, 256, 4e-3
CUT = 0.3


def chunks_of(raw: bytes) -> np.ndarray:
    """Overlapping chunks of CHUNK bytes, padded with zeros behind."""
    n = max(1, -(-max(0, len(raw) - (CHUNK - STRIDE)) // STRIDE))
    buffer = np.zeros((n - 1) * STRIDE + CHUNK, np.uint8)
    buffer[: len(raw)] = np.frombuffer(raw, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(buffer, CHUNK)[::STRIDE]


def lengths_of(raw: bytes, n: int) -> np.ndarray:
    return np.clip(len(raw) - STRIDE * np.arange(n), 1, CHUNK)


def run_of(same: np.ndarray, n: int) -> np.ndarray:
    """Places from which n places in a row are true."""
    out, have = same, 1
    while have < n:
        step = min(have, n - have)
        out = out[:, :-step] & out[:, step:]
        have += step
    return out


def repeats(x: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Share of a chunk's bytes where a whole period repeats the one before, by group of periods."""
    out = np.zeros((len(x), len(PERIODS)), np.float32)
    for g, group in enumerate(PERIODS):
        plane = np.zeros(x.shape, bool)
        for p in group:
            whole = run_of((x[:, p:] == x[:, :-p]) & (x[:, p:] > 0), p)
            plane[:, : whole.shape[1]] |= whole
        out[:, g] = plane.sum(axis=1) / length
    return out


class Network:
    """The weights, forward passes for training and scoring."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        wide = 2 * FILTERS + len(PERIODS)
        self.w = {
            "table": rng.normal(0, 0.5, (WIDTH, 256, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "hidden": rng.normal(0, wide**-0.5, (wide, HIDDEN)).astype(np.float32),
            "hidden_bias": np.zeros(HIDDEN, np.float32),
            "out": rng.normal(0, 0.1, 2 * HIDDEN).astype(np.float32),
            "out_bias": np.zeros(1, np.float32),
        }

    def pools(self, x: np.ndarray, length: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Block maxima of the rectified responses: (chunks, blocks, filters)."""
        if not hasattr(self, "pairs"):
            t = self.w["table"]
            self.pairs = [(t[k][:, None, :] + t[k + 1][None, :, :]).reshape(65536, FILTERS) for k in range(0, WIDTH, 2)]
        two = np.zeros((len(x), CHUNK + WIDTH - 2), np.int32)
        two[:, : CHUNK - 1] = (x[:, :-1].astype(np.int32) << 8) | x[:, 1:]
        two[:, CHUNK - 1] = x[:, -1].astype(np.int32) << 8
        z = np.take(self.pairs[0], two[:, :CHUNK], axis=0)
        for k in range(1, WIDTH // 2):
            z += np.take(self.pairs[k], two[:, 2 * k : 2 * k + CHUNK], axis=0)
        z = z.reshape(len(x), CHUNK // BLOCK, BLOCK, FILTERS)
        pool = np.maximum(z.max(axis=2) + self.w["bias"], 0)
        pool *= (np.arange(CHUNK // BLOCK)[None, :] * BLOCK < length[:, None])[:, :, None]
        return pool, z.argmax(axis=2) if places else None

    def chunk_features(self, x: np.ndarray, length: np.ndarray, repeat: np.ndarray | None = None, places: bool = False):
        pool, where = self.pools(x, length, places)
        blocks = -(-length // BLOCK)
        v = np.concatenate([pool.max(axis=1), pool.sum(axis=1) / blocks[:, None], repeats(x, length) if repeat is None else repeat], axis=1)
        return v.astype(np.float32), pool, where, blocks

    def logits(self, h: np.ndarray, begin: np.ndarray) -> np.ndarray:
        count = np.diff(np.append(begin, len(h)))
        d = np.concatenate([np.maximum.reduceat(h, begin, axis=0), np.add.reduceat(h, begin, axis=0) / count[:, None]], axis=1)
        return d @ self.w["out"] + self.w["out_bias"][0]

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Probabilities of whole texts; chunks are worked off in bounded groups."""
        features, begin, at = [], [], 0
        xs, ls = [], []

        def flush() -> None:
            if xs:
                v = self.chunk_features(np.concatenate(xs), np.concatenate(ls))[0]
                features.append(np.maximum(v @ self.w["hidden"] + self.w["hidden_bias"], 0))
                xs.clear()
                ls.clear()

        for raw in texts:
            begin.append(at)
            x = chunks_of(raw)
            length = lengths_of(raw, len(x))
            at += len(x)
            for i in range(0, len(x), 256):
                xs.append(x[i : i + 256])
                ls.append(length[i : i + 256])
                if sum(map(len, xs)) >= 256:
                    flush()
        flush()
        return 1 / (1 + np.exp(-np.clip(self.logits(np.concatenate(features), np.array(begin)).astype(np.float64), -30, 30)))


def batches_of(counts: np.ndarray, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """Endless batches of document numbers, each document once in a round, by the batch bounds."""
    while True:
        order = rng.permutation(len(counts))
        at = 0
        while at < len(order):
            to = at + int(np.searchsorted(np.cumsum(counts[order[at : at + BATCH]]), BATCH_CHUNKS, side="right"))
            to = max(to, at + 1)
            yield order[at:to]
            at = to


def gradients(net: Network, x: np.ndarray, length: np.ndarray, r: np.ndarray, count: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean weighted log loss of documents of count chunks each."""
    begin = np.concatenate([[0], np.cumsum(count)[:-1]])
    if hasattr(net, "pairs"):
        del net.pairs
    v, pool, where, blocks = net.chunk_features(x, length, r, places=True)
    pre = v @ net.w["hidden"] + net.w["hidden_bias"]
    h = np.maximum(pre, 0)
    top = np.maximum.reduceat(h, begin, axis=0)
    mean = np.add.reduceat(h, begin, axis=0) / count[:, None]
    p = 1 / (1 + np.exp(-np.clip(np.concatenate([top, mean], axis=1) @ net.w["out"] + net.w["out_bias"][0], -30, 30)))
    g = ((p - y) * weight / len(count)).astype(np.float32)
    grad = {"out": np.concatenate([top, mean], axis=1).T @ g, "out_bias": g.sum(keepdims=True)}
    doc = np.repeat(np.arange(len(count)), count)
    gt = (g[:, None] * net.w["out"][None, :HIDDEN])[doc]
    gm = (g[:, None] * net.w["out"][None, HIDDEN:])[doc] / count[doc][:, None]
    gh = ((h == top[doc]) * gt + gm) * (pre > 0)
    grad["hidden"] = v.T @ gh
    grad["hidden_bias"] = gh.sum(axis=0)
    gv = gh @ net.w["hidden"].T
    # a block's largest response passes the gradient on to its place
    gp = np.repeat((gv[:, FILTERS : 2 * FILTERS] / blocks[:, None])[:, None, :], pool.shape[1], axis=1)
    gp[np.arange(len(x))[:, None], pool.argmax(axis=1), np.arange(FILTERS)[None, :]] += gv[:, :FILTERS]
    gp *= pool > 0
    grad["bias"] = gp.sum(axis=(0, 1))
    c, b, f = np.nonzero(gp)
    place = where[c, b, f] + b * BLOCK
    table = np.zeros_like(net.w["table"])
    padded = np.pad(x, ((0, 0), (0, WIDTH)))
    for k in range(WIDTH):
        table[k] = np.bincount(padded[c, place + k].astype(np.int64) * FILTERS + f, gp[c, b, f], 256 * FILTERS).reshape(256, FILTERS)
    grad["table"] = table
    return grad


def train(texts: list[bytes], y: np.ndarray, weight: np.ndarray, *, steps: int = STEPS, seed: int = 11) -> Network:
    net, rng = Network(seed), np.random.default_rng(seed)
    xs = [chunks_of(raw) for raw in texts]
    ls = [lengths_of(raw, len(x)) for raw, x in zip(texts, xs, strict=True)]
    rep = [repeats(x, n) for x, n in zip(xs, ls, strict=True)]
    counts = np.array([len(x) for x in xs])
    first = {k: np.zeros_like(v) for k, v in net.w.items()}
    second = {k: np.zeros_like(v) for k, v in net.w.items()}
    for step, own in zip(range(1, steps + 1), batches_of(counts, rng), strict=False):
        rate = RATE * (1 - 0.9 * step / steps)
        grad = gradients(net, *(np.concatenate([part[i] for i in own]) for part in (xs, ls, rep)), counts[own], y[own], weight[own])
        for k in ("out", "hidden"):
            grad[k] = grad[k] + 1e-4 * net.w[k]
        for k, w in net.w.items():
            first[k] = 0.9 * first[k] + 0.1 * grad[k]
            second[k] = 0.99 * second[k] + 0.01 * grad[k] ** 2
            w -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    if hasattr(net, "pairs"):
        del net.pairs
    return net


class Constant:
    """What is left where the labels are all alike or none."""

    def __init__(self, value: float):
        self.value = value

    def score(self, texts: list[bytes]) -> np.ndarray:
        return np.full(len(texts), self.value)


def fit(sample: pd.DataFrame, counts: dict[int, int] | None = None) -> Network | Constant:
    """Fit on (text, y) rows; counts: the true numbers of both labels, which the weights restore."""
    y = sample["y"].to_numpy().astype(np.float32)
    if len(y) == 0 or y.min() == y.max():
        return Constant(float(y[0]) if len(y) else 1.0)
    counts = counts or {0: int((y == 0).sum()), 1: int((y == 1).sum())}
    share = {v: counts[v] / (counts[0] + counts[1]) * len(y) / max(1, int((y == v).sum())) for v in (0, 1)}
    weight = np.where(y == 1, share[1], share[0])
    return train([t.encode() for t in sample["text"]], y, weight)


def fit_quality(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", per_class: int = PER_CLASS) -> Network | Constant:
    return fitted(docs, labels, "quality", remainder(key, 5) != 0, per_class, fit, key=key, text=text)


def score(docs: DataFrame, model: Network | Constant, *, key: str = "doc_id", text: str = "text", cut: float = CUT) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(model.score(part.column("t").to_pylist()), pa.float64())], [key, "score"])

    scored = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t")).mapInArrow(run, f"{key} long, score double")
    return scored.select(key, F.coalesce(remainder(key, 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model, *, text: str = "text", cut: float = CUT) -> DataFrame:
    """The rows of docs at or over the cut, all columns as they were; no join is needed."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                texts = part.column(names.index(text)).to_pylist()
                keep = model.score([(x or '').encode() for x in texts]) >= cut
                yield part.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
