import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality, toxicity
from tidemark.llm.training import fitted

WORDS = ["river", "stone", "garden", "letter", "window", "morning", "paper", "winter", "table", "silver", "and", "of", "the", "to"]
BAD = ["blorghead", "snivelrat", "drubbish"]


def toxic_corpus(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        w = [rng.choice(WORDS) + rng.choice(["", "s", "ly", "ed"]) for _ in range(rng.randint(10, 120))]
        y = int(rng.random() < 0.3)
        if y:
            for _ in range(rng.randint(2, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(BAD))
        rows.append((i, " ".join(w).capitalize() + ".", y))
    return pd.DataFrame(rows, columns=["id", "text", "y"])


def poor_corpus(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        w = [rng.choice(WORDS) for _ in range(rng.randint(10, 400))]
        y = int(rng.random() < 0.7)
        kind = rng.randrange(3)
        text = " ".join(w)
        if not y:
            text = " ".join(x + "$$" for x in w) if kind == 0 else text.upper().replace(" ", "!! ") if kind == 1 else " ".join(x + " " + x + " " + x for x in w[:60])
        rows.append((i, text, y))
    return pd.DataFrame(rows, columns=["id", "text", "y"])


@pytest.fixture(scope="module")
def toxic_model():
    return toxicity.fit(toxic_corpus(500, 1))


def test_toxicity_on_held_out_text(toxic_model):
    test = toxic_corpus(300, 2)
    p = toxic_model.score(test["text"].tolist()) >= toxicity.CUT
    assert (p == (test["y"] == 1)).mean() > 0.97


def test_gaps_and_insertions(toxic_model):
    clean = "the river and the stone of the garden to the winter table "
    kernel = lambda a, b: toxicity.Landmarks([f"^{a}$"]).kernel([f"^{b}$"])[1].max(initial=0)
    assert kernel("blorghead", "blorghead") == pytest.approx(1)
    assert kernel("blorghead", "bloxrghead") > 0.5 > kernel("blorghead", "window")
    for form in ("b.l.o.r.g.h.e.a.d snivel-rat", "bl0rghead sn1velrat", "b l o r g h e a d snivelxrat", "blorrghead snivellrat"):
        assert toxic_model.score([clean + form])[0] > toxic_model.score([clean + "window morning"])[0] + 0.2, form


def test_kernel_is_the_sum_over_subsequences():
    def slow(a, b):
        def vector(s):
            out = {}
            for i in range(len(s)):
                for j, k in toxicity.OFFSETS:
                    if i + k < len(s):
                        t = s[i] + s[i + j] + s[i + k]
                        out[t] = out.get(t, 0) + toxicity.DECAY ** (k - 2)
            return out

        x, y = vector(a), vector(b)
        dot = lambda p, q: sum(v * q.get(s, 0) for s, v in p.items())
        return dot(x, y) / np.sqrt(dot(x, x) * dot(y, y))

    words = ["^abab$", "^banana$", "^bandana$", "^éclairs$", "^aaaaaa$"]
    marks = toxicity.Landmarks(words)
    rows, k = marks.kernel(words)
    assert rows.tolist() == list(range(len(words)))
    assert np.allclose(k, [[slow(a, b) for b in words] for a in words], atol=1e-5)


def test_quality_on_held_out_text():
    net = quality.fit(poor_corpus(400, 1))
    test = poor_corpus(200, 2)
    p = net.score([t.encode() for t in test["text"]]) >= quality.CUT
    assert (p == (test["y"] == 1)).mean() > 0.95
    # bad bytes far behind in a long text are seen
    long = " ".join(random.Random(1).choice(WORDS) for _ in range(4000))
    a, b = net.score([long.encode(), (long + " " + " ".join(x + "$$" for x in long.split())).encode()])
    assert b < a


def test_chunks_cover_every_byte():
    for n in (0, 1, 447, 448, 511, 512, 513, 960, 961, 5000):
        raw = bytes(1 + i % 255 for i in range(n))
        x = quality.chunks_of(raw)
        length = quality.lengths_of(raw, len(x))
        got = bytearray(n)
        for i, c in enumerate(x):
            part = c[: min(length[i], n - i * quality.STRIDE)].tobytes()
            got[i * quality.STRIDE : i * quality.STRIDE + len(part)] = part
        assert bytes(got) == raw


@pytest.mark.parametrize("module,n,rest,label", [(toxicity, 3, 1, "toxic"), (quality, 5, 0, "quality")])
def test_rows(spark, module, n, rest, label):
    rows = [(i, t, "z") for i, t in enumerate(["", "a", "word " * 40_000, "x" * 50_000, "same", "same"])] + [(None, "text", "z"), (7, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    corpus = (toxic_corpus if label == "toxic" else poor_corpus)(300, 4)
    more = spark.createDataFrame([(100 + i, t, "z") for i, t in zip(corpus["id"], corpus["text"])], docs.schema)
    labels = spark.createDataFrame([(100 + int(i), int(y)) for i, y in zip(corpus["id"], corpus["y"])] + [(None, 1), (7, None)], f"doc_id long, {label} int")
    fit = getattr(module, f"fit_{label if label == 'quality' else 'toxicity'}")
    model = fit(docs.unionByName(more), labels)
    got = module.score(docs, model).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= module.CUT)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % n == rest)
    same = [r["score"] for r in got if r["doc_id"] in (4, 5)]
    assert same[0] == same[1]
    assert module.score(docs.limit(0), model).count() == 0
    assert module.score(docs, fit(docs, labels.limit(0))).count() == len(rows)


def test_held_out_labels_are_not_learned(spark):
    corpus = toxic_corpus(200, 5)
    docs = spark.createDataFrame([(int(i), t) for i, t in zip(corpus["id"], corpus["text"])], "doc_id long, text string")
    flip = lambda i, y: 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y
    a = toxicity.fit_toxicity(docs, spark.createDataFrame([(int(i), int(y)) for i, y in zip(corpus["id"], corpus["y"])], "doc_id long, toxic int"))
    b = toxicity.fit_toxicity(docs, spark.createDataFrame([(int(i), int(flip(i, y))) for i, y in zip(corpus["id"], corpus["y"])], "doc_id long, toxic int"))
    assert np.array_equal(a.document, b.document) and a.landmarks.strings == b.landmarks.strings


def test_forward_is_a_plain_convolution():
    rng = np.random.default_rng(2)
    net = quality.Network(3)
    net.w["bias"] += rng.normal(size=quality.FILTERS).astype("f4") * 0.1
    raws = [b"", b"ab", bytes(rng.integers(1, 255, 700).tolist()), b"abc " * 400]

    def slow(raw):
        h = []
        n = max(1, -(-max(0, len(raw) - 64) // quality.STRIDE))
        for i in range(n):
            chunk = raw[i * quality.STRIDE : i * quality.STRIDE + quality.CHUNK].ljust(quality.CHUNK, b"\0")
            length = min(max(len(raw) - i * quality.STRIDE, 1), quality.CHUNK)
            wide = chunk + b"\0" * quality.WIDTH
            z = np.array([sum(net.w["table"][k][wide[j + k]] for k in range(quality.WIDTH)) for j in range(quality.CHUNK)])
            blocks = -(-length // quality.BLOCK)
            pool = np.array([np.maximum(z[b * quality.BLOCK : (b + 1) * quality.BLOCK].max(axis=0) + net.w["bias"], 0) for b in range(blocks)])
            x = np.frombuffer(chunk, np.uint8)[None]
            v = np.concatenate([pool.max(axis=0), pool.sum(axis=0) / blocks, quality.repeats(x, np.array([length]))[0]])
            h.append(np.maximum(v @ net.w["hidden"] + net.w["hidden_bias"], 0))
        d = np.concatenate([np.max(h, axis=0), np.mean(h, axis=0)])
        return 1 / (1 + np.exp(-(d @ net.w["out"] + net.w["out_bias"][0])))

    assert np.allclose(net.score(raws), [slow(r) for r in raws], atol=1e-4)


def test_gradients_are_differences():
    # bytes without repetition, so that no two places are the largest
    raws = [bytes(np.random.default_rng(n).integers(1, 255, n).tolist()) for n in (900, 160, 25)]
    net = quality.Network(5)
    for k in net.w:
        net.w[k] = net.w[k].astype(np.float64)
    xs = [quality.chunks_of(r) for r in raws]
    ls = [quality.lengths_of(r, len(x)) for r, x in zip(raws, xs, strict=True)]
    count, y, weight = np.array([len(x) for x in xs]), np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])
    x, length = np.concatenate(xs), np.concatenate(ls)
    r = quality.repeats(x, length)

    def loss():
        if hasattr(net, "pairs"):
            del net.pairs
        v = net.chunk_features(x, length, r)[0].astype(np.float64)
        h = np.maximum(v @ net.w["hidden"] + net.w["hidden_bias"], 0)
        p = 1 / (1 + np.exp(-net.logits(h, np.concatenate([[0], np.cumsum(count)[:-1]]))))
        return float((-(y * np.log(p) + (1 - y) * np.log(1 - p)) * weight).mean())

    grad = quality.gradients(net, x, length, r, count, y, weight)
    rng = np.random.default_rng(1)
    for k in net.w:
        flat, g = net.w[k].reshape(-1), np.asarray(grad[k]).reshape(-1)
        busy = np.flatnonzero(np.abs(g) > np.abs(g).max() * 0.2)
        for i in rng.choice(busy, min(5, len(busy)), replace=False):
            old, step = flat[i], 2e-4
            flat[i] = old + step
            up = loss()
            flat[i] = old - step
            down = loss()
            flat[i] = old
            assert abs((up - down) / (2 * step) - g[i]) < 0.05 * abs(g[i]) + 1e-3, (k, i)


def test_each_round_takes_every_document_once():
    counts = np.array([1, 600, 3, 40, 500, 9, 13, 1])
    seen = []
    for b in quality.batches_of(counts, np.random.default_rng(0)):
        assert len(b) == 1 or len(b) <= quality.BATCH and counts[b].sum() <= quality.BATCH_CHUNKS
        seen += b.tolist()
        if len(seen) >= 16:
            break
    assert sorted(seen[:8]) == sorted(seen[8:16]) == list(range(8))


def test_quality_of_held_out_labels_is_not_learned(spark):
    corpus = poor_corpus(120, 5)
    docs = spark.createDataFrame([(int(i), t) for i, t in zip(corpus["id"], corpus["text"])], "doc_id long, text string")
    pairs = [(int(i), int(y)) for i, y in zip(corpus["id"], corpus["y"])]
    flip = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in pairs]
    a, b = (quality.fit_quality(docs, spark.createDataFrame(p, "doc_id long, quality int")) for p in (pairs, flip))
    assert all(np.array_equal(a.w[k], b.w[k]) for k in a.w)


def test_scores_against_a_slow_version(toxic_model):
    """Whole documents: sentences, kernels of every word, margins and the logistic unit, step by step."""
    m = toxic_model
    vector = {}

    def features(s):
        if s not in vector:
            out = {}
            for i in range(len(s)):
                for j, k in toxicity.OFFSETS:
                    if i + k < len(s):
                        out[s[i], s[i + j], s[i + k]] = out.get((s[i], s[i + j], s[i + k]), 0) + toxicity.DECAY ** (k - 2)
            size = sum(x * x for x in out.values()) ** 0.5
            vector[s] = {t: x / size for t, x in out.items()} if size else {}
        return vector[s]

    def kernels(word):
        a = features(f"^{toxicity.fold(word)}$")
        k = np.array([sum(x * features(s).get(t, 0) for t, x in a.items()) for s in m.landmarks.strings])
        return k if len(toxicity.fold(word)) > 1 and k[: m.toxic].max() >= toxicity.NEAR else None

    def slow(text):
        words, found = [], []
        for sentence in re.split(r"(?<=[.!?])\s+|\n", text.lower()):
            own = [k for w in sentence.split() if (k := kernels(w)) is not None]
            words += own
            if own:
                found.append(np.max(own, axis=0) @ m.weights + m.bias)
        mass = np.log1p(sum(1 / (1 + np.exp(-6 * (k @ m.weights + m.bias))) for k in words))
        n = len(text.split())
        top = np.maximum(sorted([*found, -9, -9, -9], reverse=True)[:3], toxicity.FLOOR)
        x = np.array([*top, mass, mass - np.log1p(n / 100), np.log1p(n)])
        return 1 / (1 + np.exp(-(x @ m.document[:-1] + m.document[-1])))

    texts = ["The river blorghead was. Of stone! Drubbish and the\nsnivelrats to it. Bloxrghead garden", "River and stone. Letter window.", "snivelrat drubbish blorghead. " * 5, "drubbishes of the morning", "", "blorg head\nsnivel"]
    assert np.allclose(m.score(texts), [slow(t) for t in texts], atol=1e-4)
    assert m.score(texts)[0] > 0.5 > m.score(texts)[1]


def test_worse_sentences_raise_a_score(toxic_model):
    clean = "The river and the stone. Of the garden. "
    one, two = clean + "It was blorghead.", clean + "It was blorghead. And drubbish."
    a, b, c = toxic_model.score([clean, one, two])
    assert a < b < c


def test_letters_apart_are_joined_whatever_repeats():
    joined = lambda t: [w for _, w in toxicity.Text(t).joined]
    assert joined("you b o o b now") == ["boob"] and joined("p o o p") == ["poop"]
    assert joined("a a a a") == ["aaaa"] and joined("so f. o. o! l no") == ["fool"]
    assert joined("an i d o") == ["ido"] and joined("a b") == [] and joined("no letters here") == []
    assert joined("x y and z q") == []


def test_long_landmarks_give_all_their_pieces():
    word = "".join(random.Random(3).choices("abcdefghijklmnopqrstuvwxyz", k=70))
    docs = [{word, "calm"}] * 40 + [{"calm", "words"}] * 40
    marks = toxicity.toxic_landmarks(docs, np.array([1] * 40 + [0] * 40))
    assert set(toxicity.pieces(word)) <= set(marks) and all(len(m) <= toxicity.PIECE for m in marks)


def test_sample_is_bounded_when_ids_repeat(spark):
    """A row an id, the smallest text of it, however many rows bear it."""
    docs = spark.createDataFrame([(i, t) for i in range(40) for t in (f"b{i}", f"a{i}", None, f"c{i}") * 5], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    got = fitted(docs, labels, "quality", F.lit(True), 7, lambda sample, counts: (sample.to_dict("list"), counts))
    assert len(got[0]["id"]) == len(set(got[0]["id"])) == 14 and got[1] == {0: 20, 1: 20}
    assert got[0]["text"] == [f"a{i}" for i in got[0]["id"]] and got[0]["y"] == [i % 2 for i in got[0]["id"]]
