"""The manifest against a recursive version over lists, at several fanouts' edges and layouts."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import manifest
from tidemark.llm.manifest import FANOUT, Range, depth

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def part(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + FANOUT]) for i in range(0, len(levels[-1]), FANOUT)])
    return levels


def beside(levels, at):
    out = []
    for level in levels[:-1]:
        run = level[at // FANOUT * FANOUT : at // FANOUT * FANOUT + FANOUT]
        out.append((run[: at % FANOUT], run[at % FANOUT + 1 :]))
        at //= FANOUT
    return out


def lower(t):
    return None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def brute(rows):
    by = {}
    for r in rows:
        leaf, changed = (h(*map(part, (*r[:4], t))) for t in (r[4], lower(r[4])))
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        by.setdefault(r[1], []).append(((r[0] is not None, r[0] or 0, leaf), r[0], leaf, changed if hit else leaf))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by[s])]) for s in order}
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, (_, doc, leaf, start) in enumerate(sorted(by[s])):
            way = beside(trees[s], i) + beside(top, k)
            at = start
            for left, right in way:
                at = h(*left, at, *right)
            out.append((doc, leaf, trees[s][-1][0], top[-1][0], h(*[x for left, right in way for x in left + right]), at, at == top[-1][0]))
    return sorted(out, key=str)


def check(spark, rows, parts=3, more=""):
    df = spark.createDataFrame(rows, SCHEMA + more).repartition(parts)
    got = sorted((tuple(r) for r in manifest.Manifest(df).proofs().collect()), key=str)
    want = brute(rows)
    assert got == want
    return got


def test_sizes_about_full_runs(spark):
    """Sources of 1, 15, 16, 17, 256, 257 and 273 rows, 20 sources in all, so that the upper tree has two levels."""
    sizes = [1, 15, 16, 17, 31, 32, 33, 256, 257, 273] + [2] * 10
    rows = [(1000 * s + 7 * i % 997, f"s{s}", "en", i, f"Text {s} {i}") for s, n in enumerate(sizes) for i in range(n)]
    got = check(spark, rows, 5)
    assert not all(r[-1] for r in got) and any(r[-1] for r in got)


def test_odd_rows(spark):
    """Nulls in every column, repeated ids and rows, empty and very long texts, non-ASCII sources, clashing columns."""
    rows = [(None, None, None, None, None), (None, None, None, None, None), (5, None, "x", 3, "A"), (5, None, "x", 3, "A"), (5, None, "x", 3, "B"), (1, "é", "fr", 0, ""), (2, "z", None, 9, "ÄB" * 200_000), (3, "Z", "de", -4, None), (10, "", "", 0, "CAPS")]
    rows += [(i, "hot", "en", i, f"Doc {i}") for i in range(100, 700)]
    df = [r + ("c", 1) for r in rows]
    both = spark.createDataFrame(df, SCHEMA + ", hash string, index int").repartition(7)
    got = sorted((tuple(r) for r in manifest.Manifest(both).proofs().collect()), key=str)
    assert got == brute(rows)


def test_one_row_one_source_and_nothing(spark):
    got = check(spark, [(4, "s", "en", 1, "Hi")], 1)
    assert got[0][4] == h() and got[0][2] == got[0][1] == got[0][3]
    check(spark, [(i, "s", "en", i, str(i)) for i in range(40)], 2)
    empty = spark.createDataFrame([], SCHEMA)
    m = manifest.Manifest(empty)
    assert m.root is None and m.proofs().count() == 0


@pytest.mark.parametrize("n", [1, 2, 16, 17, 100, 256, 257, 600, 4096, 4100])
def test_ranges_cut_anywhere(n):
    """Records of ranges cut at any place, put together, are those of one range over all."""
    leaves = [h(str(i)) for i in range(n)]
    levels = tree(leaves)
    want = {(k, i // FANOUT): "".join(level[i : i + FANOUT]) for k, level in enumerate(levels[:-1]) for i in range(0, len(level), FANOUT)} or {(0, 0): leaves[0]}
    assert depth(n) == max(1, len(levels) - 1)
    for cuts in ([0, n], [0, n // 3, n // 2 + 1, n], [0, 1, n], list(range(0, n, max(1, n // 7))) + [n]):
        cuts = sorted(set(cuts))
        records = []
        for a, b in zip(cuts, cuts[1:]):
            m = Range("s", n)
            for i in range(a, b):
                m.add(0, i, leaves[i])
            m.end()
            assert sum(not r[-1] for r in m.records) <= 2 * depth(n)  # edges: at most two a level
            records += m.records
        for r in records:
            if r[-1]:
                assert want[r[1], r[2]] == r[4]
            else:
                assert r[4] in want[r[1], r[2]] and want[r[1], r[2]].index(r[4]) == r[3] * manifest.HEX
        parts = {}
        for r in sorted(records, key=lambda r: r[3]):
            if r[1] == 0:
                parts[r[2]] = parts.get(r[2], "") + r[4]
        assert parts == {run: x for (level, run), x in want.items() if level == 0}


def test_a_large_source_is_cut_over_tasks(spark):
    """One source of 3,000 rows: its leaves lie in several ranges, and the runs at their edges are merged."""
    rows = [(i, "s", "en", 0, f"T{i}") for i in range(3000)]
    m = manifest.Manifest(spark.createDataFrame(rows, SCHEMA))
    assert m.leaves.select("part").distinct().count() > 1
    starts = [r["index"] for r in m.leaves.groupBy("part").agg(F.min("index").alias("index")).collect()]
    assert any(i % FANOUT for i in starts)
    want = tree([r["hash"] for r in m.leaves.orderBy("index").collect()])
    got = {(r["level"], r["run"]): r["hashes"] for r in m.runs.collect()}
    assert got == {(k, i // FANOUT): "".join(level[i : i + FANOUT]) for k, level in enumerate(want[:-1]) for i in range(0, len(level), FANOUT)}
    assert m.roots.first()["hash"] == m.root == want[-1][0]
