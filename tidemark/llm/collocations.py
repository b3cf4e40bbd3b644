"""Operator 13: phrases of two to four words that occur more often together than apart, by language.

Texts (A-Z lower-cased) are cut into pieces at `[.,;:!?\\x0A-\\x0D]` and pieces into words `[^\\x20\\x09]+`. A phrase is a
run of words within a piece; f counts all its places, n all words of a language (null: `und`). Candidates have two to
DEPTH words and f >= LEAST.

1. A task reads its texts in shards of some SHARD bytes and builds a generalised suffix automaton of depth DEPTH for each
   language of a shard. Its states are the sets of end positions that phrases have. They are made by sorting the end
   positions by their words read backwards, which is the order of the automaton's tree of suffix links: the places of
   a phrase are an interval of that order, a state is the phrases with one interval, its link leads to the
   smallest interval that is larger, and the length of an interval is the number of end positions.
2. Phrases and counts of all shards are added up. A phrase is no more frequent than the words and pairs in it, so
   that is done in three rounds: words; pairs of frequent words; then longer phrases, in texts cut where
   a pair is rare. Nothing that can be a candidate is lost: what is frequent is looked up in a bit table of fixed
   size (BITS), which errs on the side of frequent only. So most phrases, which occur once, are never shuffled.
3. A candidate's parts are looked up among the counts; the cut with the smallest score is its own. A candidate is dropped for
   a longer one that holds it and has 80 % of its places; the phrases that one holds are its prefixes and what
   suffix links lead to from them. Scores are whole numbers in decimal arithmetic.

Null and empty texts have no words; ids aren't read, so repeated rows count again. Ties are ranked by count and phrase, and phrases
are distinct, so ranks are. A very long text is a shard of its own. An empty table gives no rows; other columns are not read. The driver
gets the bit table, 8 MB at most. Once far more phrases are frequent than the table has bits, more rare ones pass and are
shuffled; counts stay right.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

DEPTH = 4
LEAST = 30
TOP = 2000
#: A candidate goes if a longer one that holds it has this percentage of its places.
COVERED = 80
SCALE = 2_000_000
SHARD = 8 << 20
BITS = 1 << 26
#: Parts of a language that are cut to the first TOP before these meet.
SALT = 64
OUT = "lang string, phrase string, words int, c long"
BREAK, BLANK = 0xFF, 0x20
#: What each byte becomes. 0xFF isn't found in UTF-8.
BYTES = np.arange(256, dtype=np.uint8)
BYTES[65:91] += 32
BYTES[[*b".,;:!?\n\x0b\x0c\r"]] = BREAK
BYTES[9] = BLANK


def words_of(texts: list[bytes]) -> tuple[np.ndarray, pa.Array]:
    """The words of all texts as numbers from 1 on, with 0 between pieces, and the words that the numbers mean."""
    data = BYTES[np.frombuffer(b"\n".join(texts), dtype=np.uint8)]
    inner = (data != BREAK) & (data != BLANK)
    edge = np.diff(inner.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.int32), pa.array([], pa.binary())
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    found = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inner])]).dictionary_encode()
    piece = np.searchsorted(np.flatnonzero(data == BREAK), starts)
    at = np.arange(len(starts)) + np.cumsum(np.diff(piece, prepend=piece[0]) > 0)
    x = np.zeros(at[-1] + 1, np.int32)
    x[at] = found.indices.to_numpy() + 1
    return x, found.dictionary


class Automaton:
    """The suffix automaton, to a depth, of number sequences with 0 between them.

    back[k] holds, for each end position in the order of the tree, the number k places before. States are given by
    start (of their interval), count (end positions), and the lengths `low` to `high` of their phrases; link is the
    state that the suffix of low - 1 numbers belongs to, -1 for the empty one.
    """

    def __init__(self, x: np.ndarray, depth: int):
        ends = np.flatnonzero(x)
        n = len(ends)
        padded = np.concatenate([np.zeros(depth, x.dtype), x])
        back = [x[ends]]
        for k in range(1, depth):
            back.append(np.where(back[-1] > 0, padded[ends + depth - k], 0))
        order = np.lexsort(back[::-1])
        self.back = [b[order] for b in back]
        new = np.zeros(n, bool)
        new[:1] = True
        low, size = np.zeros(n, np.int8), np.zeros(n, np.int64)
        states: list[tuple[np.ndarray, ...]] = []
        levels = []
        for k, b in enumerate(self.back, 1):
            new[1:] |= b[1:] != b[:-1]
            starts = np.flatnonzero(new)
            sizes = np.diff(starts, append=n)
            starts, sizes = starts[b[starts] > 0], sizes[b[starts] > 0]
            same = size[starts] == sizes  # the interval of the suffix that is one shorter: the same state
            low[starts] = np.where(same, low[starts], k)
            size[starts] = sizes
            levels.append((starts, sizes, low[starts].copy()))
        longer = np.zeros(n, np.int64)
        for k in range(depth, 0, -1):
            starts, sizes, least = levels[k - 1]
            own = longer[starts] != sizes
            states.append((starts[own], sizes[own], least[own], np.full(own.sum(), k, np.int8)))
            longer = np.zeros(n, np.int64)
            longer[starts] = sizes
        self.start, self.count, self.low, self.high = (np.concatenate(c) for c in zip(*states, strict=True)) if n else (np.zeros(0, np.int64),) * 4

    def links(self) -> np.ndarray:
        """For each state the state of the longest suffix that has more end positions, or -1."""
        n = len(self.back[0])
        out = np.full(len(self.start), -1)
        for k in range(1, len(self.back)):
            own = np.full(n, -1)  # the state that holds each end position's phrase of length k
            for s in np.flatnonzero((self.low <= k) & (self.high >= k)):
                own[self.start[s] : self.start[s] + self.count[s]] = s
            below = self.low == k + 1
            out[below] = own[self.start[below]]
        return out

    def phrases(self, length: int) -> tuple[list[np.ndarray], np.ndarray]:
        """The distinct phrases of a length, as one array of numbers for each place, and their counts."""
        own = (self.low <= length) & (self.high >= length)
        return [self.back[k][self.start[own]] for k in range(length - 1, -1, -1)], self.count[own]


def hashed(lang: str, words: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array([lang, *words], dtype=object), categorize=False)


def mixed(parts: list[np.ndarray], salt: np.uint64) -> np.ndarray:
    """Places in the bit table for phrases given by the hashes of their words."""
    h = np.full(len(parts[0]), salt, np.uint64)
    for p in parts:
        h = (h ^ p) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h % np.uint64(BITS)


def bit_table(frequent: DataFrame) -> np.ndarray:
    """A bit for the hash of each phrase of frequent(lang, phrase); at most BITS / 64 numbers reach the driver."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pd.DataFrame({"lang": batch.column("lang").to_pylist(), "phrase": batch.column("phrase").to_pylist()})
            for lang, own in table.groupby("lang", sort=False):
                words = [p.split(" ") for p in own["phrase"]]
                h = hashed(lang, [w for p in words for w in p])
                k = len(words[0])
                bits = mixed([h[1 + i :: k] for i in range(k)], h[0])
                yield pa.RecordBatch.from_arrays([pa.array((bits // 64).astype(np.int64)), pa.array((bits % 64).astype(np.int32))], ["at", "bit"])

    found = frequent.select("lang", "phrase").mapInArrow(places, "at long, bit int").groupBy("at").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask")).toArrow()
    bits = np.zeros(BITS // 64, np.uint64)
    bits[found["at"].to_numpy()] = found["mask"].to_numpy().view(np.uint64)
    return bits


def marked(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bits[places // np.uint64(64)] >> (places % np.uint64(64))) & np.uint64(1) > 0


def word_rows(lang: str, x: np.ndarray, vocabulary: pa.Array) -> Iterator[pa.RecordBatch]:
    yield from rows(lang, 1, vocabulary, np.bincount(x, minlength=len(vocabulary) + 1)[1:])


def frequent_words(lang: str, x: np.ndarray, vocabulary: pa.Array, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.uint64]:
    """x with 0 for rare words, the hash of each number's word, and the language's."""
    h = hashed(lang, vocabulary.cast(pa.string()).to_pylist())
    keep = np.concatenate([[False], marked(bits, mixed([h[1:]], h[0]))])
    return np.where(keep[x], x, 0), h, h[0]


def pair_rows(lang: str, x: np.ndarray, vocabulary: pa.Array, words: np.ndarray) -> Iterator[pa.RecordBatch]:
    yield from phrase_rows(lang, frequent_words(lang, x, vocabulary, words)[0], vocabulary, [2], 2)


def long_rows(lang: str, x: np.ndarray, vocabulary: pa.Array, words: np.ndarray, pairs: np.ndarray) -> Iterator[pa.RecordBatch]:
    x, h, salt = frequent_words(lang, x, vocabulary, words)
    both = np.flatnonzero((x[:-1] > 0) & (x[1:] > 0))
    rare = both[~marked(pairs, mixed([h[x[both]], h[x[both + 1]]], salt))]
    yield from phrase_rows(lang, np.insert(x, rare + 1, 0), vocabulary, range(3, DEPTH + 1), DEPTH)


def phrase_rows(lang: str, x: np.ndarray, vocabulary: pa.Array, lengths, depth: int) -> Iterator[pa.RecordBatch]:
    automaton = Automaton(x, depth)
    for length in lengths:
        numbers, counts = automaton.phrases(length)
        for i in range(0, len(counts), 1 << 16):
            parts = [vocabulary.take(pa.array(a[i : i + (1 << 16)] - 1)) for a in numbers]
            yield from rows(lang, length, pc.binary_join_element_wise(*parts, b" "), counts[i : i + (1 << 16)])


def rows(lang: str, length: int, phrases: pa.Array, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(phrases), 1 << 16):
        own, c = phrases.slice(i, 1 << 16), pa.array(counts[i : i + (1 << 16)].astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(own), np.int32))), own.cast(pa.string()), pa.array(np.full(len(own), length, np.int32)), c], ["lang", "phrase", "words", "c"])


def counted(texts: DataFrame, fn: Callable, *tables: np.ndarray) -> DataFrame:
    """(lang, phrase, words, f): what fn finds in the shards of texts(lang, text binary), added up."""
    shared = [texts.sparkSession.sparkContext.broadcast(t) for t in tables]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = [b.value for b in shared]
        held: dict[str, list[bytes]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, own in held.items():
                x, vocabulary = words_of(own)
                if len(x):
                    yield from fn(lang, x, vocabulary, *bits)
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
                data = text.as_py()
                held.setdefault(lang.as_py(), []).append(data)
                size += len(data) + 1
                if size >= SHARD:
                    yield from flush()
                    size = 0
        yield from flush()

    return texts.mapInArrow(run, OUT).groupBy("lang", "phrase", "words").agg(F.sum("c").alias("f"))


def frequent_phrases(docs: DataFrame, least: int = LEAST, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """All phrases of up to DEPTH words with f >= least, as (lang, phrase, words, f), and (lang, n)."""
    texts = docs.where(F.col(text).isNotNull()).select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("binary").alias("text"))
    words = written(counted(texts, word_rows), "words")
    total = words.groupBy("lang").agg(F.sum("f").alias("n"))
    one = words.where(F.col("f") >= least)
    first = bit_table(one)
    two = written(counted(texts, pair_rows, first).where(F.col("f") >= least), "pairs")
    more = written(counted(texts, long_rows, first, bit_table(two)).where(F.col("f") >= least), "phrases")
    return one.unionByName(two).unionByName(more), total


def scored(phrases: DataFrame) -> DataFrame:
    """Candidates (lang, phrase, words, a, l, r, score): the cut with the smallest score, the earliest of such."""
    exact = lambda c: c.cast("decimal(38,0)")
    cut = phrases.where("words > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cut = cut.withColumns({"left": F.expr("substring_index(phrase, ' ', k)"), "right": F.expr("substring_index(phrase, ' ', k - words)")})
    part = lambda side, count: phrases.select("lang", F.col("phrase").alias(side), F.col("f").alias(count))
    cut = cut.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    cut = cut.withColumns({"top": exact(F.col("f")) * SCALE, "under": exact(F.col("l")) + exact(F.col("r"))}).withColumn("score", F.expr("top div under"))
    best = cut.groupBy("lang", "phrase", "words", "f").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    return best.select("lang", "phrase", "words", F.col("f").alias("a"), "m.l", "m.r", "m.score")


def holding(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, above): for phrases inside longer ones, the largest count of these.

    Inside a phrase lie its prefixes and the suffixes of those and of itself, where suffix links lead."""
    w = F.split("phrase", " ")
    own = phrases.where("words > 2").select("lang", "f", "words", w.alias("w"))
    own = own.withColumn("end", F.explode(F.sequence(F.lit(2), F.col("words")))).withColumn("from", F.explode(F.sequence(F.lit(1), F.col("end") - 1)))
    own = own.where("end - from + 1 < words")
    return own.select("lang", "f", F.expr("array_join(slice(w, from, end - from + 1), ' ')").alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("above"))


def collocations(docs: DataFrame, *, least: int = LEAST, top: int = TOP, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the first `top` phrases of each language."""
    found, total = frequent_phrases(docs, least, text, lang)
    found = written(found, "frequent")
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    kept = scored(found).join(holding(found), ["lang", "phrase"], "left").where(F.col("above").isNull() | (exact("above") * 100 < exact("a") * COVERED))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    first = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALT)))
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
