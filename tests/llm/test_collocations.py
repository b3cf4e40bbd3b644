"""Collocations against counting in dictionaries; the automaton against sets of end positions."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import collocations as col
from tidemark.llm.collocations import Automaton

SCHEMA = "doc_id long, text string, lang string"


def pieces(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def brute(rows, least=30, top=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for p in pieces(text):
            n[lang] += len(p)
            for k in range(1, 5):
                for i in range(len(p) - k + 1):
                    f[lang][tuple(p[i : i + k])] += 1
    out = []
    for lang, own in f.items():
        cand = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        above = Counter()
        for p, a in cand.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    above[p[i : i + k]] = max(above[p[i : i + k]], a)
        kept = []
        for p, a in cand.items():
            if above[p] and 100 * above[p] >= 80 * a:
                continue
            score, k = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def check(spark, rows, parts=3, **args):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    got = sorted(tuple(r) for r in col.collocations(df, **args).collect())
    assert got == brute(rows, **args)
    return got


def prose(n, words, seed, langs=("en", "de", None)):
    r = random.Random(seed)
    out = []
    for i in range(n):
        text = "".join(r.choice(words) + r.choice([" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "-", " ! "]) for _ in range(r.randrange(60)))
        out.append((i, text, langs[i % len(langs)]))
    return out


def test_against_dictionaries(spark):
    got = check(spark, prose(600, ["The", "the", "of", "New", "York", "é", "ÄH", "a\x00b", "x_y", "naïve"], 1), least=30)
    assert len({r[0] for r in got}) == 3 and "und" in {r[0] for r in got}
    got = check(spark, prose(300, [f"w{i}" for i in range(40)] + ["new york city", "new york", "in spite of the"] * 6, 2), least=12)
    assert any(r[2].count(" ") > 1 for r in got)


def test_rare_words_and_pairs_are_cut_without_loss(spark):
    """Frequent phrases amid words that occur once, and words whose pairs are all rare."""
    r = random.Random(5)
    rows = [(i, f"q{i} alpha beta gamma delta z{i} alpha z{i}x beta, gamma. {r.choice('abc')} alpha beta u{i}", "en") for i in range(80)]
    got = check(spark, rows)
    assert "alpha beta gamma delta" in {x[2] for x in got}


def test_covered_and_ties(spark):
    rows = [(i, "a b c d", "en") for i in range(40)] + [(i, "a b", "en") for i in range(8)] + [(i, "c d", "en") for i in range(15)] + [(i, "p q. r s", "en") for i in range(31)]
    got = {r[2]: r for r in check(spark, rows)}
    assert set(got) == {"a b c d", "c d", "p q", "r s"}  # a b: 80 x 48 <= 100 x 40; c d: 80 x 55 > 100 x 40
    assert got["p q"][1] < got["r s"][1] and got["p q"][7] == got["r s"][7] == 1_000_000
    check(spark, rows, top=2)


def test_odd_rows(spark):
    """Null texts, langs and ids, repeated rows, a very long text, clashing columns, nothing."""
    rows = [(None, None, "en"), (1, "", "en"), (2, " \t.,;", None), (3, "x y " * 60_000, "fr"), (3, "x y " * 60_000, "fr"), (4, "one two", "und"), (4, "one two", None)] * 2 + [(9, "one two three", None)] * 40
    df = spark.createDataFrame([r + (1, 2) for r in rows], SCHEMA + ", words int, score long")
    assert sorted(tuple(r) for r in col.collocations(df).collect()) == brute(rows)
    assert col.collocations(df.limit(0)).count() == 0
    assert col.collocations(df.where("doc_id < 3")).count() == 0


def test_scores_beyond_64_bits(spark):
    big = 9_000_000_000_000_000_000
    rows = [("en", "a", 1, big), ("en", "b", 1, big), ("en", "a b", 2, big - 5)]
    got = col.scored(spark.createDataFrame(rows, "lang string, phrase string, words int, f long")).collect()
    assert [(r["a"], r["score"]) for r in got] == [(big - 5, 2_000_000 * (big - 5) // (2 * big))]


@pytest.mark.parametrize("seed", range(6))
def test_automaton_states_are_sets_of_end_positions(seed):
    r = random.Random(seed)
    depth = 1 + seed % 4 if seed else 4
    x = np.array([r.randrange(4) for _ in range(r.choice([0, 1, 60, 300]))], np.int32)
    ends = defaultdict(set)
    for i in range(len(x)):
        for k in range(1, depth + 1):
            if k <= i + 1 and all(x[i - k + 1 : i + 1]):
                ends[tuple(int(v) for v in x[i - k + 1 : i + 1])].add(i)
    states = defaultdict(list)
    for p, e in ends.items():
        states[frozenset(e)].append(p)
    a = Automaton(x, depth)
    got = {}
    for s in range(len(a.start)):
        own = [tuple(int(a.back[k][a.start[s]]) for k in range(length - 1, -1, -1)) for length in range(a.low[s], a.high[s] + 1)]
        assert all(len(ends[p]) == a.count[s] for p in own)
        got[s] = own
    assert sorted(sorted(v) for v in got.values()) == sorted(sorted(v) for v in states.values())
    of = {p: s for s, own in got.items() for p in own}
    for s, link in enumerate(a.links()):
        suffix = got[s][0][1:]
        assert link == (of[suffix] if suffix else -1)
    for length in range(1, depth + 1):
        numbers, counts = a.phrases(length)
        assert dict(zip(zip(*(map(int, n) for n in numbers)), map(int, counts))) == {p: len(e) for p, e in ends.items() if len(p) == length}


def test_words_of_bytes():
    texts = ["Ab\tc. d e,,f", "", "  ", "é É\r\nx", "g"]
    x, vocabulary = col.words_of([t.encode() for t in texts])
    words = [None, *[w.decode() for w in vocabulary.to_pylist()]]
    got, run = [], []
    for v in [*x, 0]:
        if v:
            run.append(words[v])
        elif run:
            got.append(run)
            run = []
    assert got == [p for t in texts for p in pieces(t) if p]
    assert isinstance(vocabulary, pa.Array) and len(set(words)) == len(words)
