import random
import re

from tidemark.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    hits = [(i, label) for p, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), len(hits), min((h[0] for h in hits), default=None), max((h[0] for h in hits), default=None), ",".join(sorted({h[1] for h in hits}))


def test_base_counts_and_labels(spark):
    rng = random.Random(5)
    vocab = "cc by CC-BY general public license GNU all rights reserved ALL\nRights été Ünder licensed".split(" ")
    texts = [None, "", "All rights reserved. all RIGHTS reserved", "cc  by\ncc by-nc", "x" * 100_000, "Licensed under the Apache License, Version 2.0."] + [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, labels string")
    got = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(t), t
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1
    assert "apache-2.0" in got[5]["labels"] and got[5]["score"] == 1.0
    assert got[4]["labels"] == "" and got[4]["score"] == 0


def test_changed_notice_is_found(spark):
    t = "Permission is hereby granted, absolutely free of charge, to any person obtaining one copy of this software"
    df = spark.createDataFrame([(1, t)], "doc_id long, text string")
    r = licenses.scan(df).first()
    assert r["labels"] == "mit" and 0.75 <= r["score"] < 1
    assert r["spans"][0]["first"] == 0


def test_automaton_gives_longest_runs():
    rng = random.Random(1)
    seqs = [[rng.randint(0, 3) for _ in range(rng.randint(2, 12))] for _ in range(6)]
    auto = licenses.Automaton()
    for n, s in enumerate(seqs):
        auto.add(n, s)
    auto.finish()
    has = lambda run: {(n, i + len(run) - 1) for n, s in enumerate(seqs) for i in range(len(s)) if s[i : i + len(run)] == run}
    text = [rng.randint(0, 4) for _ in range(400)]
    want = set()
    for n, own in enumerate(seqs):  # all runs of each sequence that can grow to neither side
        for i in range(len(text)):
            for j in range(len(own)):
                if text[i] != own[j] or (i and j and text[i - 1] == own[j - 1]):
                    continue
                size = 0
                while i + size < len(text) and j + size < len(own) and text[i + size] == own[j + size]:
                    size += 1
                if size > 1:
                    want.add((i, j, size, n))
    got = list(auto.anchors(text, seqs))
    assert len(got) == len(set(got)) and set(got) == want
    for s in range(1, len(auto.len)):
        assert all(has(seqs[n][e - auto.len[s] + 1 : e + 1]) == auto.ends[s] for n, e in auto.ends[s])


def test_a_run_inside_another_templates_run_counts(spark):
    templates = [("b c d e f", "one"), ("x c d e y z w", "two")]
    texts = ["x b c d e f y z w", "x q c d e q y z w"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in licenses.scan(df, templates=templates, base={}).collect()}
    found = licenses.Scanner(tuple(templates))
    own = {s[0]: s for s in found.spans(found.runs(licenses.words_of(texts[0].encode())))}
    assert own["one"][3] == 1.0 and rows[1]["labels"] == "two" and abs(rows[1]["score"] - 6 / 7) < 0.2
    _, _, auto, seqs = found.parts(tuple(templates))
    vocab = found.parts(tuple(templates))[0]
    ids = [vocab[w] for w in licenses.words_of(texts[0].encode())]
    two = [(t, p, n) for t, p, n, k in auto.anchors(ids, seqs) if k == 1]
    assert (2, 1, 3) in two and (6, 4, 3) in two


def test_the_nearer_licence_wins(spark):
    gnu = "under the terms of the gnu {} general public license as published by the free software foundation"
    texts = {
        gnu.format("project"): "gpl",
        gnu.format(""): "gpl",
        gnu.format("affero"): "agpl,gpl",  # gpl is the base phrase
        gnu.format("lesser"): "gpl,lgpl",
        gnu.format("affero").replace("published", "printed"): "agpl,gpl",
        "licensed under cc [sic] by nc": "cc-by-nc",
        "licensed under cc by sa": "cc-by,cc-by-sa",
    }
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(df).collect()}
    assert got == dict(enumerate(texts.values()))


def test_inserted_words_are_bridged(spark):
    texts = [
        "permission to use copy modify and or distribute this software and or for any purpose with or without fee",
        "under the terms of the gnu affero of the general public license as published by the free software foundation",
        "licensed under the one two three four five six apache license version 2 0",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (0, texts[0])], "doc_id long, text string")
    rows = licenses.scan(df).collect()
    assert sorted(r["labels"] for r in rows) == ["agpl,gpl", "apache-2.0", "isc", "isc", "isc"]
    assert licenses.scan(df.limit(0)).count() == 0


def test_chains_against_all_chains():
    rng = random.Random(4)

    def slow(anchors):
        best = 0
        order = sorted(anchors)

        def go(last, at, covered):
            nonlocal best
            best = max(best, covered)
            for i in range(at, len(order)):
                t, p, n = order[i]
                skip = max(0, last[0] - t, last[1] - p)
                if skip < n and t + skip - last[0] <= licenses.GAP:
                    go((t + n, p + n), i + 1, covered + n - skip)

        for i, (t, p, n) in enumerate(order):
            go((t + n, p + n), i + 1, n)
        return best

    for _ in range(300):
        anchors = list({(rng.randrange(30), rng.randrange(20), rng.randint(2, 6)) for _ in range(rng.randint(1, 8))})
        found = licenses.chains(anchors, 0)
        assert found[0][2] == slow(anchors)
        spans = sorted(f[:2] for f in found)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
        assert all(f[2] >= found[0][2] for f in licenses.chains(anchors, found[0][2]))
