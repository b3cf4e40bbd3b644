"""Operator 2: licence scans with a generalised suffix automaton.

The automaton holds every run of words of all templates. A text is streamed through it: at each
word it gives the length of the longest run ending there that some template holds (the matching
statistic), and by its suffix links the longest one of every other template. A run that can't grow within
its template is an anchor; the anchors of a template are chained in the
order of both text and template, and the words that a chain covers make a span. Of all chains ending
in an anchor the best is kept (dynamic programming), so inserted words that stand elsewhere in the
template don't break it. A template is found if a chain covers enough of it, so notices with changed,
missing or inserted words are found too. Where spans of several labels overlap, the best covered one wins,
so that a notice near two licences gets the label of the nearer. Templates are notices and opening paragraphs.

Besides, three base phrases are counted word by word. Words are maximal runs of a-z, 0-9 and
characters beyond ASCII after lower-casing A-Z. Nulls and empty texts have no words: counts 0, no
labels, score 0, null positions. Repeated rows and null ids give rows like others, an empty table
none. A very long text is scanned whole; only its anchors are held besides. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Wordings of licence notices, and the label of each.
TEMPLATES = [
    ("licensed under cc by", "cc-by"),
    ("licensed under cc by nc", "cc-by-nc"),
    ("licensed under cc by sa", "cc-by-sa"),
    ("licensed under cc by nd", "cc-by-nd"),
    ("licensed under a creative commons attribution license", "cc-by"),
    ("dedicated to the public domain under cc0", "cc0"),
    ("this work is licensed under the gnu general public license version", "gpl"),
    ("under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("under the terms of the gnu lesser general public license as published by the free software foundation", "lgpl"),
    ("under the terms of the gnu affero general public license as published by the free software foundation", "agpl"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license", "apache-2.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee", "isc"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("made available under the terms of the eclipse public license", "epl"),
    ("distributed under the boost software license version 1 0", "bsl"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"
        " including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"
        " subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "mit",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        "isc",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above"
        " copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"
        " in the documentation and or other materials provided with the distribution",
        "bsd",
    ),
    (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone"
        " to use this software for any purpose including commercial applications and to alter it and redistribute it freely",
        "zlib",
    ),
]
#: A chain may skip so many words of the text between two anchors.
GAP = 6
#: A template is found where a chain covers this share of it.
COVER = 0.75
#: Bytes to words: lower case, all that is no word character to a blank.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(FOLD).split()


class Automaton:
    """Suffix automaton over several word sequences; state 0 is the empty run."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]

    def _state(self, length: int, link: int, moves: dict[int, int], ends: set) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.len.append(length)
        self.ends.append(ends)
        return len(self.len) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """State for the shorter runs of q that p reaches by c."""
        if self.len[q] == self.len[p] + 1:
            return q
        copy = self._state(self.len[p] + 1, self.link[q], dict(self.next[q]), set())
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def add(self, number: int, sequence: list[int]) -> None:
        last = 0
        for at, c in enumerate(sequence):
            if c in self.next[last]:
                last = self._split(last, self.next[last][c], c)
            else:
                new, p = self._state(self.len[last] + 1, 0, {}, set()), last
                while p >= 0 and c not in self.next[p]:
                    self.next[p][c] = new
                    p = self.link[p]
                if p >= 0:
                    self.link[new] = self._split(p, self.next[p][c], c)
                last = new
            self.ends[last].add((number, at))

    def finish(self) -> None:
        """Give every state all places where its runs end, longest runs first."""
        for s in sorted(range(1, len(self.len)), key=lambda s: -self.len[s]):
            if self.link[s] > 0:
                self.ends[self.link[s]] |= self.ends[s]

    def anchors(self, ids: list[int], sequences: list[list[int]]) -> Iterator[tuple[int, int, int, int]]:
        """(first word, place in the sequence, length, sequence) of the runs of two words and more that, within that
        sequence, can grow neither to the left nor to the right.

        The state after a word stands for the sequences that have the longest run in common with the text there;
        its suffix links lead to those whose runs are shorter.
        """
        state = size = 0
        for i, c in enumerate(ids):
            while state and c not in self.next[state]:
                state = self.link[state]
                size = self.len[state]
            if c not in self.next[state]:
                continue
            state, size = self.next[state][c], size + 1
            after = ids[i + 1] if i + 1 < len(ids) else None
            s, length, seen = state, size, frozenset()
            while s > 0 and length > 1:
                for number, end in self.ends[s]:
                    own = sequences[number]
                    if (number, end) not in seen and not (end + 1 < len(own) and own[end + 1] == after):
                        yield i - length + 1, end - length + 1, length, number
                seen, s = self.ends[s], self.link[s]
                length = self.len[s]


@dataclass(frozen=True)
class Scanner:
    """Templates, vocabulary and automaton; built once in a worker."""

    templates: tuple[tuple[str, str], ...]
    #: How many of the last templates are exact phrases, which don't compete with others for their place.
    phrases: int = 0

    @staticmethod
    @lru_cache(maxsize=4)
    def parts(templates: tuple[tuple[str, str], ...]):
        split = [words_of(t.encode()) for t, _ in templates]
        vocab = {w: i for i, w in enumerate(dict.fromkeys(w for t in split for w in t))}
        pairs = np.zeros((len(vocab) + 1,) * 2, bool)
        auto, seqs = Automaton(), []
        for n, t in enumerate(split):
            ids = [vocab[w] for w in t]
            seqs.append(ids)
            pairs[ids[:-1], ids[1:]] = True
            auto.add(n, ids)
        auto.finish()
        return vocab, pairs, auto, seqs

    def runs(self, words: list[bytes]) -> list[tuple[int, list[int]]]:
        """Maximal runs of words whose every neighbouring pair some template holds: the only places
        where the matching statistic passes one word."""
        vocab, pairs, _, _ = self.parts(self.templates)
        if len(words) < 2:
            return []
        ids = np.fromiter(map(vocab.get, words, repeat(len(vocab))), "i4", len(words))
        ok = np.flatnonzero(pairs[ids[:-1], ids[1:]])
        if not len(ok):
            return []
        return [(int(x[0]), ids[x[0] : x[-1] + 2].tolist()) for x in np.split(ok, np.flatnonzero(np.diff(ok) > 1) + 1)]

    def spans(self, runs: list[tuple[int, list[int]]]) -> list[tuple[str, int, int, float]]:
        """(label, first word, last word, covered share of the template) of the chains that suffice."""
        _, _, auto, seqs = self.parts(self.templates)
        anchors: dict[int, list[tuple[int, int, int]]] = {}
        for at, ids in runs:
            for first, place, size, number in auto.anchors(ids, seqs):
                anchors.setdefault(number, []).append((at + first, place, size))
        found, phrases = [], []
        for number, list_ in anchors.items():
            need = len(seqs[number])
            out = found if number < len(self.templates) - self.phrases else phrases
            for first, end, covered in chains(list_, COVER * need):
                out.append((covered, (self.templates[number][1], first, end - 1, covered / need)))
        return strongest(found) + [s for _, s in phrases]


def strongest(spans: list[tuple[int, tuple[str, int, int, float]]]) -> list[tuple[str, int, int, float]]:
    """Of (words covered, span) of different labels that overlap, the span that its template is covered best by, of
    such the one with the most words: a notice that is one word from two licences is the nearer one's."""
    out: list[tuple[str, int, int, float]] = []
    for _, s in sorted(spans, key=lambda x: (-x[1][3], -x[0], x[1])):
        if all(s[0] == t[0] or s[2] < t[1] or s[1] > t[2] for t in out):
            out.append(s)
    return out


def chains(anchors: list[tuple[int, int, int]], least: float) -> list[tuple[int, int, int]]:
    """(first word, end, words covered) of chains of (text place, template place, size), the best first, that
    don't overlap in the text and cover at least so much. Neighbours in a chain are at most GAP words
    of the text apart; what both cover counts once."""
    anchors = sorted(anchors)
    best: list[tuple[int, int]] = []  # words covered by the best chain that ends in an anchor, and where it begins
    open_: list[int] = []  # anchors that a later one may still follow
    for i, (text, place, size) in enumerate(anchors):
        open_ = [j for j in open_ if anchors[j][0] + anchors[j][2] + GAP >= text]
        top = (size, -text)
        for j in open_:
            t, p, n = anchors[j]
            skip = max(0, t + n - text, p + n - place)  # words that the chain has already
            if skip < size and text + skip - (t + n) <= GAP:
                top = max(top, (best[j][0] + size - skip, best[j][1]))
        best.append(top)
        open_.append(i)
    out: list[tuple[int, int, int]] = []
    for i in sorted(range(len(anchors)), key=lambda i: (-best[i][0], anchors[i])):
        covered, first, end = best[i][0], -best[i][1], anchors[i][0] + anchors[i][2]
        if covered < least:
            break
        if all(end <= a or first >= b for a, b, _ in out):
            out.append((first, end, covered))
    return out


def scan(docs: DataFrame, *, key: str = "doc_id", text: str = "text", templates=tuple(TEMPLATES), base=None) -> DataFrame:
    """One row a document: counts of base phrases, labels, the best cover as score, and the spans."""
    base = dict(BASE if base is None else base)
    scanner = Scanner(tuple(templates) + tuple(base.items()), len(base))
    phrases = [(words_of(p.encode()), label) for p, label in base.items()]
    span = "array<struct<label:string,first:long,last:long,cover:double>>"
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("cover", pa.float64())]))]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]

    def one(raw: bytes) -> tuple:
        words = words_of(raw)
        runs = scanner.runs(words)
        if not runs:
            return len(words), 0, None, None, "", "", 0.0, []
        places, labels = [], set()
        for at, ids in runs:
            held = words[at : at + len(ids)]
            for phrase, label in phrases:
                for i in range(len(held) - len(phrase) + 1):
                    if held[i : i + len(phrase)] == phrase:
                        places.append(at + i)
                        labels.add(label)
        spans = scanner.spans(runs)
        everything = labels | {s[0] for s in spans}
        score = max([float(bool(places)), *(s[3] for s in spans)])
        return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(everything)), min(1.0, score), [dict(zip(("label", "first", "last", "cover"), s, strict=True)) for s in sorted(spans)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(x) for x in batch.column("t").to_pylist()]
            if rows:
                cols = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("k"), *cols], [key, *names])

    schema = f"{key} long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans {span}"
    return docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t")).mapInArrow(run, schema)
