"""Operator 8: toxicity by a subsequence string-kernel SVM with Nystroem landmarks.

The kernel compares words by their subsequences of three characters within a span of five, a gap
costing DECAY; a word has marks at its start and end. Inserted characters only widen some spans,
punctuation inside a word and digits for letters are folded, and RUN or more letters written apart are joined,
so i.d.i.o.t, idxiot and "i d i o t" stay near idiot. A sentence is to a landmark what its nearest word
is. Landmarks are words and word beginnings that are much more frequent in toxic documents, and clean
words that come near them. The Nystroem map K^-1/2 k(sentence, landmarks) makes the SVM linear. It is
trained on sentences: all those of clean documents are negative, and of a toxic document, whose label
doesn't say which, those that score highest are positive, chosen anew in some rounds (a multiple-
instance problem). The margins of a document's highest sentences and the mass of its suspicious words
(words with a margin as if they were sentences) make it a probability, by a logistic unit fitted on margins that an SVM of the other labelled rows gave each row.

A word whose kernel to every toxic landmark is below NEAR can't count; an upper bound of the kernel
sorts most words out before it is computed exactly. Every word of every text is looked at, whatever its
length. Null and empty texts get the score of a text without a suspicious word; repeated rows get equal
scores, rows with a null id one like others, an empty table none; with no labels of both kinds to learn
from, every score is 0. Other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .training import fitted, remainder

DECAY = 0.6
#: Offsets of the second and third character of a subsequence.
OFFSETS = [(1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4)]
NEAR = 0.45
TOXIC_LANDMARKS, CLEAN_LANDMARKS = 64, 48
#: A toxic landmark is in so many toxic documents at least, with a difference of the log odds to clean
#: ones of so much, and of so many of its standard deviations; no two are nearer than ALIKE.
LEAST, ODDS, DEVIATIONS, ALIKE = 3, 1.2, 2.0, 0.85
#: Sentences of a toxic document that may be positive, and the parts of the rows that are margins of the others' SVM.
WITNESSES, FOLDS = 3, 3
#: Margins below count as this.
FLOOR = -1.5
#: Labelled documents of each kind to learn from, at most.
PER_CLASS = 2000
CUT = 0.7
#: Longest piece of a word compared at once; longer words are cut into overlapping pieces.
PIECE, STEP = 32, 24
#: Single letters in a row that are looked at as one word too.
RUN = 3
#: Words that a worker remembers; a memory bound, without effect on the result.
REMEMBERED = 400_000
LEET = str.maketrans("013457@$!", "oieastasi")
STOP = (".", "!", "?", "\u2026")
EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„‘’…–—¡¿"


def fold(word: str) -> str:
    """A word as the kernel sees it, without marks."""
    w = word.strip(EDGE)
    if not w.isalpha():
        w = "".join(c for c in (w if w.isdigit() else w.translate(LEET)) if c.isalnum())
    return w


def spaced_out(words: list[str]) -> list[tuple[int, str]]:
    """Runs of RUN or more single letters, joined, and where they begin."""
    out, run, last = [], [], -2
    for i in [i for i, w in enumerate(words) if len(w) < 3]:
        c = words[i].strip(EDGE)
        if len(c) != 1 or not c.isalpha():
            continue
        if i != last + 1:
            if len(run) >= RUN:
                out.append((last - len(run) + 1, "".join(run)))
            run = []
        run.append(c)
        last = i
    if len(run) >= RUN:
        out.append((last - len(run) + 1, "".join(run)))
    return out


class Text:
    """The words of a text, those joined from letters written apart, and where its lines end."""

    __slots__ = ("joined", "lines", "words")

    def __init__(self, text: str):
        self.words, self.lines = [], []
        for line in text.lower().split("\n"):
            self.words += line.split()
            self.lines.append(len(self.words) - 1)
        # texts without a single letter, which are most, needn't be looked through
        self.joined = spaced_out(self.words) if any(len(w.strip(EDGE)) == 1 for w in set(self.words) if len(w) < 3) else []

    def every(self) -> list[str]:
        return self.words + [w for _, w in self.joined]

    def ends(self) -> list[int]:
        """Numbers of the words that end a sentence: those before a full stop or the like, and at the end of a line."""
        return sorted({i for i, w in enumerate(self.words) if w.endswith(STOP) or w.rstrip("\"'»”’)]").endswith(STOP)} | set(self.lines))


def pieces(folded: str, start: str = "^", end: str = "$") -> list[str]:
    w = start + folded + end
    return [w] if len(w) <= PIECE else [w[i : i + PIECE] for i in range(0, len(w) - PIECE + STEP, STEP)]


def codes(units: list[str]) -> np.ndarray:
    """Characters as numbers 1..127, padded with 0 behind."""
    wide = max(5, max(map(len, units), default=5)) + 4
    raw = np.frombuffer("".join(u.ljust(wide, "\0") for u in units).encode("utf-32-le"), "<u4").reshape(len(units), wide)
    out = np.where((raw >= 97) & (raw <= 122), raw - 94, 29 + raw % 99)
    out = np.where(raw == 94, 1, np.where(raw == 36, 2, out))
    return np.where(raw == 0, 0, out).astype(np.int32)


def features(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Subsequence numbers and weights of each unit, one column for each place; number 0 is none."""
    c = codes(units)
    n = c.shape[1] - 4
    idx = np.empty((len(units), n, len(OFFSETS)), np.int32)
    for k, (i, j) in enumerate(OFFSETS):
        a, b, d = c[:, :n], c[:, i : i + n], c[:, j : j + n]
        idx[:, :, k] = np.where(d > 0, (a << 14) | (b << 7) | d, 0)
    w = np.array([DECAY ** (j - 2) for _, j in OFFSETS], np.float32)
    return idx.reshape(len(units), -1), np.tile(w, n)


def norms(idx: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Lengths of the feature vectors, repeated subsequences added up first."""
    order = np.argsort(idx, axis=1, kind="stable")
    s, v = np.take_along_axis(idx, order, 1), w[order]
    cut = np.ones(s.shape, bool)
    cut[:, 1:] = s[:, 1:] != s[:, :-1]
    flat = np.flatnonzero(cut.ravel())
    sums = np.add.reduceat(v.ravel().astype(np.float64), flat)
    sums[s.ravel()[flat] == 0] = 0
    return np.sqrt(np.bincount(flat // s.shape[1], sums**2, minlength=len(idx)))


class Landmarks:
    """Kernel values between words and landmark strings."""

    def __init__(self, strings: list[str]):
        self.strings = strings
        idx, w = features(strings)
        n = norms(idx, w)
        names = np.unique(idx[idx > 0])
        self.slot = np.zeros(1 << 21, np.int32)
        self.slot[names] = np.arange(1, len(names) + 1)
        self.values = np.zeros((len(names) + 1, len(strings)), np.float32)
        for r in range(len(strings)):
            np.add.at(self.values[:, r], self.slot[idx[r]], w / max(n[r], 1e-9))
        self.values[0] = 0

    def kernel(self, units: list[str], near: float = 0.0, which: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(rows, values): units whose kernel to one of the first `which` landmarks is at least near."""
        rows, values = [], []
        most = self.values[:, :which].max(axis=1)
        by_length = sorted(range(len(units)), key=lambda i: len(units[i]))  # little padding
        for at in range(0, len(units), 4096):
            batch = by_length[at : at + 4096]
            idx, w = features([units[i] for i in batch])
            slots = self.slot[idx]
            r, c = np.nonzero(slots)
            if not len(r):
                continue
            low = np.sqrt((idx > 0) @ (w**2))  # at most the true length
            high = np.bincount(r, most[slots[r, c]] * w[c], minlength=len(idx))  # at least the largest kernel value, before norming
            keep = (high >= near * low)[r]
            r, c = r[keep], c[keep]
            if not len(r):
                continue
            own, first = np.unique(r, return_index=True)
            raw = np.add.reduceat(self.values[slots[r, c]] * w[c][:, None], first, axis=0)
            keep = raw[:, :which].max(axis=1) >= near * low[own]
            own, raw = own[keep], raw[keep]
            if not len(own):
                continue
            value = raw / np.maximum(norms(idx[own], w), 1e-9)[:, None]
            keep = value[:, :which].max(axis=1) >= near
            rows.append(np.array(batch)[own[keep]])
            values.append(value[keep])
        if not rows:
            return np.zeros(0, int), np.zeros((0, len(self.strings)))
        row = np.concatenate(rows)
        order = np.argsort(row, kind="stable")
        return row[order], np.concatenate(values)[order]


def linear_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 1.0, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Squared-hinge linear SVM by Newton steps on the active set."""
    a = np.hstack([x, np.ones((len(x), 1))])
    u = np.zeros(a.shape[1])
    ridge = np.eye(a.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(min(rounds, 40)):
        active = (y * (a @ u)) < 1
        if not active.any():
            break
        sub, ws = a[active], (c * weight[active])[:, None]
        new = np.linalg.solve(ridge + sub.T @ (sub * ws), sub.T @ (y[active] * ws[:, 0]))
        if np.allclose(new, u, atol=1e-7):
            break
        u = 0.5 * u + 0.5 * new if _ > 10 else new
    return u[:-1], float(u[-1])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 60, rising: int = 0) -> np.ndarray:
    """Logistic regression by Newton steps; the first `rising` weights are not negative."""
    a = np.hstack([x, np.ones((len(x), 1))])
    free = np.ones(a.shape[1], bool)
    while True:
        u = np.zeros(a.shape[1])
        penal = np.eye(a.shape[1]) * ridge
        penal[-1, -1] = 1e-6
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(a @ u, -30, 30)))
            h = ((a * (p * (1 - p) + 1e-6)[:, None]).T @ a + penal)[np.ix_(free, free)]
            step = np.linalg.solve(h, (a.T @ (y - p) - penal @ u)[free])
            u[free] += step
            if np.abs(step).max() < 1e-8:
                break
        wrong = np.flatnonzero(u[:rising] < 0)
        if not len(wrong):
            return u
        free[wrong[np.argmin(u[wrong])]] = False


class Model:
    """Landmarks, the SVM's weights on a sentence's kernels to them, and the logistic unit."""

    def __init__(self, landmarks: Landmarks | None, toxic: int, weights: np.ndarray, bias: float):
        self.landmarks, self.toxic, self.weights, self.bias = landmarks, toxic, weights, bias
        self.document = np.zeros(0)
        self.forget()

    def forget(self) -> None:
        """known: words met; hot: those that can count, with their kernels to the landmarks."""
        self.known: set[str] = set()
        self.hot: dict[str, np.ndarray] = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "hot")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.forget()

    def learn_words(self, texts: list[Text]) -> None:
        """Put the words of some texts into known and hot."""
        different = set().union(*[t.every() for t in texts])
        new = different.difference(self.known)
        if new and len(self.known) + len(new) > REMEMBERED:
            self.forget()
            new = different
        self.known |= new
        alike: dict[str, list[str]] = {}  # written forms of the same folded word
        for w in new:
            if len(f := fold(w)) > 1:
                alike.setdefault(f, []).append(w)
        units, forms = [], []
        for f, own in alike.items():
            for p in pieces(f):
                units.append(p)
                forms.append(own)
        if not units:
            return
        rows, k = self.landmarks.kernel(units, NEAR, self.toxic)
        for r, v in zip(rows.tolist(), k.astype(np.float32), strict=True):
            for w in forms[r]:
                # a word of several pieces is as near as its nearest piece
                self.hot[w] = np.maximum(self.hot[w], v) if w in self.hot else v

    def sentences(self, texts: list[Text]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text the kernels to the landmarks of its words that can count, and of its sentences with such words."""
        self.learn_words(texts)
        hot, out = self.hot, []
        for t in texts:
            found = [(i, hot[w]) for i, w in enumerate(t.words) if w in hot] + [(i, hot[w]) for i, w in t.joined if w in hot]
            if not found:
                none = np.zeros((0, len(self.landmarks.strings)), np.float32)
                out.append((none, none))
                continue
            ends, own = t.ends(), {}
            for i, v in found:
                s = bisect_left(ends, i)
                own[s] = np.maximum(own[s], v) if s in own else v
            out.append((np.array([v for _, v in found]), np.array([own[s] for s in sorted(own)])))
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        if self.landmarks is None:
            return np.zeros(len(texts))
        held = [Text(t) for t in texts]
        x = document_features([(w @ self.weights + self.bias, v @ self.weights + self.bias) for w, v in self.sentences(held)], [len(t.words) for t in held])
        return 1 / (1 + np.exp(-np.clip(x @ self.document[:-1] + self.document[-1], -30, 30)))


def document_features(margins: list[tuple[np.ndarray, np.ndarray]], words: list[int]) -> np.ndarray:
    """Highest three margins of a document's sentences, the mass of its words, that for its length, and the length."""
    out = []
    for (w, m), n in zip(margins, words, strict=True):
        top = np.sort(np.append(m, [FLOOR] * 3))[::-1][:3]
        mass, size = np.log1p((1 / (1 + np.exp(-6 * np.clip(w, -5, 5)))).sum()), np.log1p(n)
        out.append([*np.maximum(top, FLOOR), mass, mass - np.log1p(n / 100), size])
    return np.array(out).reshape(len(words), 6)


def nearness(a: str, marks: list[dict[int, float]]) -> tuple[dict[int, float], float]:
    """The normed feature vector of a string, and its largest kernel value to some others."""
    idx, w = features([a])
    own: dict[int, float] = {}
    for i, x in zip(idx[0].tolist(), w.tolist(), strict=True):
        if i:
            own[i] = own.get(i, 0.0) + x
    size = max(1e-9, sum(x * x for x in own.values()) ** 0.5)
    own = {i: x / size for i, x in own.items()}
    return own, max((sum(x * m.get(i, 0.0) for i, x in own.items()) for m in marks), default=0.0)


def toxic_landmarks(docs: list[set[str]], y: np.ndarray) -> list[str]:
    """Words and word beginnings with the most evidence, each some way from those before it."""
    n1, n0 = int((y == 1).sum()), int((y == 0).sum())
    counts: list[Counter] = [Counter(), Counter()]
    for d, label in zip(docs, y, strict=True):
        names = {f"^{w}$" for w in d}
        names |= {f"^{w[:n]}" for w in d for n in (5, 6, 7) if len(w) > n}
        counts[int(label)].update(names)
    rated = []
    for s, a in counts[1].items():
        b = counts[0].get(s, 0)
        odds = np.log((a + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n0 + 1))
        if a >= LEAST and odds > max(ODDS, DEVIATIONS * (1 / (a + 0.5) + 1 / (b + 0.5)) ** 0.5):
            # evidence: how far the count in toxic documents passes what clean ones let expect
            rated.append((a * odds * (1.15 if s.endswith("$") else 1.0), s))
    rated.sort(key=lambda x: (-x[0], x[1]))
    strings: list[str] = []
    marks: list[dict[int, float]] = []
    for _, s in rated:
        if len(strings) == TOXIC_LANDMARKS:
            break
        for own_piece in [s] if len(s) <= PIECE else pieces(s[1:-1]):
            own, near = nearness(own_piece, marks)
            if near < ALIKE and len(strings) < TOXIC_LANDMARKS:
                strings.append(own_piece)
                marks.append(own)
    return strings


def witnesses(bags: list[np.ndarray], y: np.ndarray, root: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float]:
    """The SVM on sentences, in some rounds of choosing each toxic document's witnesses: (weights, bias)."""
    # equal sentences of clean documents are one row with a weight; one without any near word stands for the rest
    negative: Counter = Counter(r.tobytes() for v, label in zip(bags, y, strict=True) if not label for r in v)
    x0 = np.array([np.zeros(len(start)), *[np.frombuffer(r, np.float32) for r in negative]])
    w0 = np.array([(y == 0).sum(), *negative.values()], float)
    positive = [v for v, label in zip(bags, y, strict=True) if label and len(v)]
    weights, bias = start, -0.5
    for _ in range(4):
        chosen = []
        for v in positive:
            m = v @ weights + bias
            order = np.argsort(-m, kind="stable")[:WITNESSES]
            chosen += [v[i] for k, i in enumerate(order) if m[i] > 0 or not k]
        x1 = np.array(chosen) if chosen else np.zeros((0, len(start)))
        t = np.concatenate([np.ones(len(x1)), -np.ones(len(x0))])
        u, bias = linear_svm(np.concatenate([x1, x0]) @ root, t, np.concatenate([np.full(len(x1), ((y == 0).sum() / max(1, (y == 1).sum())) ** 0.5), w0]))
        weights = root @ u
    return weights, bias


def fit(sample: pd.DataFrame) -> Model:
    """Fit on (text, y) rows."""
    y = sample["y"].to_numpy()
    if len(sample) == 0 or y.min() == y.max():
        return Model(None, 0, np.zeros(0), 0.0)
    texts = sample["text"].tolist()
    n1, n0 = int((y == 1).sum()), int((y == 0).sum())
    # each document's different folded words; equal words are one object, so the sample stays small
    same: dict[str, str] = {}
    docs = [{same.setdefault(f, f) for w in set(Text(t).every()) if len(f := fold(w)) > 1} for t in texts]
    strings = toxic_landmarks(docs, y)
    if not strings:
        return Model(None, 0, np.zeros(0), 0.0)
    toxic = len(strings)
    df = [Counter(w for d, label in zip(docs, y, strict=True) if label == v for w in d) for v in (0, 1)]
    clean = lambda w: df[0][w] / n0 - df[1][w] / n1
    units, owner = [], []
    for w in sorted(same):
        for p in pieces(w):
            units.append(p)
            owner.append(w)
    rows, _ = Landmarks(strings).kernel(units, NEAR, toxic)
    near_clean = sorted({(-clean(owner[r]), units[r]) for r in rows if clean(owner[r]) > 0})
    strings += [p for _, p in near_clean if p not in strings][:CLEAN_LANDMARKS]
    del docs, units, owner, same
    marks = Landmarks(strings)
    values, vectors = np.linalg.eigh(marks.kernel(strings)[1].astype(np.float64))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
    # to begin with, a sentence is as bad as it is nearer to a toxic landmark than to a clean one
    start = np.where(np.arange(len(strings)) < toxic, 1.0, -0.3)
    model = Model(marks, toxic, start, 0.0)
    bags, words = [], []
    for i in range(0, len(texts), 128):
        held = [Text(t) for t in texts[i : i + 128]]
        bags += model.sentences(held)
        words += [len(t.words) for t in held]
    model.forget()
    fold_of = np.arange(len(y)) % FOLDS
    margins: list = [None] * len(y)
    for f in range(FOLDS):
        others = np.flatnonzero(fold_of != f)
        weights, bias = witnesses([bags[i][1] for i in others], y[others], root, start)
        for i in np.flatnonzero(fold_of == f):
            margins[i] = tuple(v @ weights + bias for v in bags[i])
    model.document = logistic(document_features(margins, words), y.astype(float), rising=4)
    model.weights, model.bias = witnesses([v for _, v in bags], y, root, start)
    return model


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", per_class: int = PER_CLASS) -> Model:
    return fitted(docs, labels, "toxic", remainder(key, 3) != 1, per_class, lambda sample, _: fit(sample), key=key, text=text)


def score(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text", cut: float = CUT) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(model.score(part.column("t").to_pylist()), pa.float64())], [key, "score"])

    scored = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).mapInArrow(run, f"{key} long, score double")
    return scored.select(key, F.coalesce(remainder(key, 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model, *, text: str = "text", cut: float = CUT) -> DataFrame:
    """The rows of docs below the cut, all columns as they were; no join is needed."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(names.index(text)).to_pylist()
                keep = model.score([x or '' for x in texts]) < cut
                yield part.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
