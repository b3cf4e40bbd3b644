"""Operator 5: n-gram Jaccard join by a MinHash LSH forest.

Documents are sets of shingles of five words (fewer words: one shingle of all); words are runs of
a-z, 0-9 and characters beyond ASCII after lower-casing A-Z. Equal word sequences are one vertex
with a weight. Each vertex has TREES x DEPTH minhash values of 16 bits; a trie is the sorted order of all
vertices by the DEPTH values of one tree (a range sort, so that a trie lies over many tasks), kept
with the length of the prefix that each row shares with the row before it. Vertices that share the
first d values are a subtree. The join starts with whole labels and shortens the prefix by STEP while
the recall is short of its target: that measured on up to AUDIT vertices, which are compared with all
texts exactly (the mean of each group size, LEAST at least), and that estimated from the similarities of
the links found and from how many the last shortening has added; a length that promises the target for
any pair at the threshold is enough if the measured recall is. Only subtrees that branch at the new length are looked at again, and a pair is handled once:
at the longest prefix it shares, in the first tree where it does.

A label that more than LARGE vertices share marks a large group; of several the largest is a vertex's own.
A group has one representative, to which its vertices are compared; those within half the distance of
the threshold form its ball. Jaccard distance is a metric, so all of a ball are linked to each other,
which is counted from the ball's weight without comparing them. Vertices of a subtree that aren't of
one ball are cut into slices of SLICE vertices, a slice is one row, and a task compares two slices, first by signatures
(five standard deviations below the threshold drop out), then by the shingles of the texts: every
remaining pair is verified. Tasks return one row a vertex (links and local component), never rows of
pairs, so no group is expanded.

A row is known by a number of its own, so ids that are repeated, with equal texts or others, are rows
like others. Texts without a word link only with equal texts, null and empty texts with nothing. Null
ids are left out (single() keeps them). Very long texts are hashed whole; an empty table gives no
rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import logging
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, drop_written, grouped_stream, join_hot, written
from .licenses import FOLD
from .neardup import local_roots, recall_of

log = logging.getLogger(__name__)
WORDS, THRESHOLD, RECALL = 5, 0.8, 0.9999
TREES, DEPTH = 16, 6
#: Values that a prefix is shortened by.
STEP = 2
#: Vertices of a subtree that a task compares with as many others, and those that share a label in a large group.
SLICE, LARGE = 2048, 256
#: Vertices that are compared with all texts, and the recall that they must have.
AUDIT, LEAST = 500, 0.99
BASE = 0x9E3779B97F4A7C15 | 1
U64 = np.uint64


@lru_cache(maxsize=2)
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(BASE, -1, 1 << 64)
    out = []
    for b in (BASE, inverse):
        x = np.full(size, b, U64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def shingle_hashes(canon: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the shingles of texts (words joined by one blank, none empty), and where each text's begin."""
    data = np.frombuffer(b" ".join(canon) + b" ", np.uint8)
    size = 1 << max(16, int(len(data)).bit_length())
    up, down = powers(size)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=sums[1:])
    ends = np.flatnonzero(data == 32)
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = np.cumsum(np.array([len(c) + 1 for c in canon])) - 1  # the blank after each text
    word_to = np.searchsorted(ends, last) + 1
    word_from = np.concatenate([[0], word_to[:-1]])
    count = np.maximum(1, word_to - word_from - (words - 1))
    begin = np.concatenate([[0], np.cumsum(count)[:-1]])
    text = np.repeat(np.arange(len(canon)), count)
    first = word_from[text] + np.arange(len(text)) - begin[text]
    final = np.minimum(first + words, word_to[text]) - 1
    s, e = starts[first], ends[final]
    return mix((sums[e] - sums[s]) * down[s]), begin


def canonical(raw: bytes) -> bytes:
    return b" ".join(raw.translate(FOLD).split())


def coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix(np.arange(1, 2 * n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
    return h[:n] | U64(1), h[n:]


def signatures(canon: list[bytes]) -> np.ndarray:
    h, begin = shingle_hashes(canon)
    a, b = coefficients(TREES * DEPTH)
    out = np.empty((len(canon), len(a)), np.uint32)
    for j in range(len(a)):
        out[:, j] = np.minimum.reduceat(((h * a[j] + b[j]) >> U64(32)).astype(np.uint32), begin)
    # the smallest values have zeros in front: the lower half is as good as random
    return (out & 0xFFFF).astype(np.uint16)


def prepared(docs: DataFrame, text: str = "text") -> DataFrame:
    """(uid, digest, sig, row), written: all rows of docs with a number, the digest of the words (null for
    null and empty texts) and the signature (null for texts without a word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid, row = batch.column("uid"), batch.column("row")
            texts = [t or b"" for t in row.field(text).cast(pa.binary()).to_pylist()]
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (size < 1 << 19 or to == at):
                    size += len(texts[to])
                    to += 1
                canon = [canonical(t) for t in texts[at:to]]
                digest = [hashlib.md5(c or b"\0" + t).digest() if t else None for c, t in zip(canon, texts[at:to], strict=True)]
                sig: list[bytes | None] = [None] * len(canon)
                have = [i for i, c in enumerate(canon) if c]
                if have:
                    for i, values in zip(have, signatures([canon[i] for i in have]), strict=True):
                        sig[i] = values.astype(">u2").tobytes()
                yield pa.RecordBatch.from_arrays([uid.slice(at, to - at), pa.array(digest, pa.binary()), pa.array(sig, pa.binary()), row.slice(at, to - at)], ["uid", "digest", "sig", "row"])
                at = to

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    schema = T.StructType([T.StructField("uid", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("sig", T.BinaryType()), T.StructField("row", rows.schema["row"].dataType)])
    return written(rows.mapInArrow(run, schema), "signed")


def chance(similarity: np.ndarray | float, depth: int) -> np.ndarray | float:
    """Probability that a pair shares a prefix of that depth in some tree."""
    return 1 - (1 - similarity**depth) ** TREES


def shared_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many first values rows of labels have in common."""
    return np.logical_and.accumulate(a == b, axis=1).sum(axis=1)


def tries(vert: DataFrame, least: int) -> DataFrame:
    """(tree, label, id, lcp, reach), written: the sorted tries without the rows that share no prefix of `least`.

    lcp is the prefix shared with the row before, reach the longer one of those with both neighbours. Where
    the neighbour is in another task lcp is null and reach is as if all were shared, which costs a
    look at a few rows more and loses none.
    """
    label = F.expr(f"substring(sig, tree * {2 * DEPTH} + 1, {2 * DEPTH})")
    rows = vert.select("id", "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")).select("tree", label.alias("label"), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(b: pa.RecordBatch, first: int, after: int) -> pa.RecordBatch:
            """Rows with the prefixes shared with the row before (first: that of the first row) and behind (after: of the last); -1: unknown."""
            tree = b.column("tree").to_numpy()
            values = np.frombuffer(b"".join(b.column("label").to_pylist()), ">u2").reshape(len(tree), DEPTH)
            lcp = np.concatenate([[first], shared_prefix(values[1:], values[:-1]) * (tree[1:] == tree[:-1])])
            behind = np.append(lcp[1:], after)
            reach = np.where((lcp < 0) | (behind < 0), DEPTH, np.maximum(lcp, behind))
            keep = pa.array(reach >= least)
            made = pa.RecordBatch.from_arrays([b.column("tree"), b.column("label"), b.column("id"), pa.array(lcp.astype("i4"), mask=lcp < 0), pa.array(reach.astype("i4"))], ["tree", "label", "id", "lcp", "reach"])
            return made.filter(keep)

        held, first = None, -1
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                ends = [np.frombuffer(x.column("label")[i].as_py(), ">u2")[None] for x, i in ((held, held.num_rows - 1), (batch, 0))]
                seam = int(shared_prefix(*ends)[0]) if held.column("tree")[held.num_rows - 1] == batch.column("tree")[0] else 0
                yield out(held, first, seam)
                first = seam
            held = batch
        if held is not None:
            yield out(held, first, -1)

    in_order = rows.repartitionByRange("tree", "label", "id").sortWithinPartitions("tree", "label", "id")
    return written(in_order.mapInArrow(run, "tree int, label binary, id long, lcp int, reach int"), "tries")


def texts_of(trie: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, t), written: the texts of vertices in the trie, told by a bitmap of a bit a row of the corpus, so that no
    other text is shuffled and these aren't for it."""
    number, place = F.bitmap_bucket_number("id"), F.bitmap_bit_position("id")
    bits = trie.select(number.alias("number"), place.alias("place")).groupBy("number").agg(F.bitmap_construct_agg("place").alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", F.expr("cast(bitmap_bit_position(id) div 8 as int) + 1"), F.lit(1))), 16, 10).cast("int")
    inside = texts.withColumn("number", number).join(F.broadcast(bits), "number")
    return written(inside.where(F.getbit(byte, F.pmod(place, F.lit(8)).cast("int")) == 1).select("id", "t"), "texts")


def balls(trie: DataFrame, count: int, texts: DataFrame, threshold: float) -> DataFrame | None:
    """(id, ball), written: vertices of large groups that are so near to a representative that they link with
    each other. trie has count rows."""
    whole = trie.where(F.col("reach") == DEPTH)
    large = written(whole.groupBy("tree", "label").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > LARGE), "large")
    if large.isEmpty():
        drop_written(large)
        return None
    # the largest group that a vertex is in is its own; the group's head is a vertex that is in many
    seats = join_hot(whole, large, ["tree", "label"], count)
    home = seats.groupBy("id").agg(F.max(F.struct("c", "tree", "label")).alias("grp"), F.count(F.lit(1)).alias("seats")).select("id", "seats", F.xxhash64("grp.tree", "grp.label").alias("grp"))
    home = written(home, "home")
    heads = written(home.groupBy("grp").agg(F.max(F.struct("seats", (-F.col("id")).alias("id"))).alias("m"), F.count(F.lit(1)).alias("c")).select("grp", "c", (-F.col("m.id")).alias("head"), F.ceil(F.col("c") / F.lit(2 * LARGE)).cast("int").alias("parts")), "heads")
    member = join_hot(home, heads, ["grp"], count).select("head", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), "id")
    asked = heads.select("head", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("head").alias("id"))
    near = (1 + threshold) / 2

    def measure(t: pa.Table) -> pa.Table | None:
        head, ids = t.column("head")[0].as_py(), t.column("id").to_numpy()
        h, text, size = sets_of([canonical(x) for x in t.column("t").to_pylist()])
        own = np.flatnonzero(ids == head)
        if not len(own):
            return None
        common = np.bincount(text[np.isin(h, h[text == own[0]])], minlength=len(ids))
        ok = np.unique(ids[common >= near * (size + size[own[0]] - common)])
        return pa.table({"id": pa.array(ok), "ball": pa.array(np.full(len(ok), head))})

    found = grouped_stream(member.unionByName(asked).join(texts, "id"), ["head", "part"], measure, "id long, ball long")
    out = written(found.distinct(), "balls")
    for old in (home, heads, large):
        drop_written(old)
    return out


def candidates(trie: DataFrame, count: int, vert: DataFrame, depth: int, above: int, threshold: float, made: list[DataFrame]) -> DataFrame:
    """(task, id, w, partners): pairs whose longest shared prefix is at least depth and below `above`, by task. trie has count rows; made
    gets what was written for it."""
    rows = trie.where(F.col("reach") >= depth).select("id", "tree", "ball", "lcp", F.xxhash64(F.substring("label", 1, 2 * depth)).alias("prefix"))
    sizes = rows.groupBy("tree", "prefix", "ball").agg(F.count(F.lit(1)).alias("c"), F.min(F.when(F.coalesce("lcp", F.lit(depth)) >= depth, F.coalesce("lcp", F.lit(depth)))).alias("fork"))
    many = sizes.groupBy("tree", "prefix").agg(F.sum("c").alias("c"), F.min("fork").alias("fork"), F.collect_list(F.struct("ball", F.ceil(F.col("c") / F.lit(SLICE)).cast("int").alias("slices"))).alias("parts"))
    many = many.where((F.col("c") > 1) & (F.lit(above > DEPTH) | (F.col("fork") < above)) & ((F.size("parts") > 1) | (F.col("parts")[0]["ball"] == -1))).drop("fork")
    # four branches join it, each of which would count the subtrees again
    made.append(many := written(many, "subtrees"))
    held = join_hot(rows.drop("lcp"), many, ["tree", "prefix"], count).join(vert.select("id", "sig", "w"), "id")
    screen = threshold - 5 * np.sqrt(threshold * (1 - threshold) / (TREES * DEPTH))

    def paired(tree: int, task: pa.Scalar, t: pa.Table, left: np.ndarray, right: np.ndarray, inner: bool) -> pa.Table | None:
        """Rows of t(id, w, sig) that have partners among the others: those at left with those at right; inner: each pair once."""
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), ">u2").reshape(t.num_rows, -1)
        ids = t.column("id").to_numpy()
        partners: list[list[int]] = [[] for _ in range(t.num_rows)]
        step = max(1, (1 << 22) // (len(right) * sig.shape[1]))
        for at in range(0, len(left), step):
            a = left[at : at + step]
            same = sig[a][:, None, :] == sig[right][None, :, :]
            shared = np.logical_and.accumulate(same.reshape(len(a), len(right), TREES, DEPTH), axis=3).sum(axis=3)
            best = shared.max(axis=2)
            ok = (best >= depth) & (best < above) & ((shared >= depth).argmax(axis=2) == tree) & (same.mean(axis=2) >= screen)
            if inner:
                ok &= ids[a][:, None] < ids[right][None, :]
            for i, j in zip(*np.nonzero(ok), strict=True):
                partners[a[i]].append(int(ids[right[j]]))
        inside = {x for p in partners for x in p}
        rows = [i for i in range(t.num_rows) if partners[i] or int(ids[i]) in inside]
        if not rows:
            return None
        return pa.table({"task": pa.array([task.as_py()] * len(rows)), "id": pa.array(ids[rows]), "w": t.column("w").take(pa.array(rows)), "partners": pa.array([partners[i] for i in rows], pa.list_(pa.int64()))})

    out = "task long, id long, w long, partners array<long>"
    # a subtree of one slice and no ball is compared as it is
    one = (F.size("parts") == 1) & (F.col("parts")[0]["slices"] == 1)
    alone = held.where(one).select("tree", "prefix", "id", "w", "sig", F.xxhash64("tree", "prefix").alias("task"))

    def within(t: pa.Table) -> pa.Table | None:
        every = np.arange(t.num_rows)
        return paired(t.column("tree")[0].as_py(), t.column("task")[0], t, every, every, True) if t.num_rows > 1 else None

    # larger ones: a slice is packed into one row before it is sent to the slices that it meets
    name = lambda ball, slice_: F.concat_ws(":", ball.cast("string"), slice_.cast("string"))
    slices = F.filter("parts", lambda x: x["ball"] == F.col("ball"))[0]["slices"]
    # vertices of one ball are linked already: their slices meet only others
    others = F.flatten(F.transform(F.filter("parts", lambda x: (x["ball"] != F.col("ball")) | (x["ball"] == -1)), lambda x: F.transform(F.sequence(F.lit(0), x["slices"] - 1), lambda k: name(x["ball"], k))))
    packed = held.where(~one).select("tree", "prefix", name(F.col("ball"), F.pmod(F.xxhash64("id"), slices)).alias("own"), others.alias("others"), F.struct("id", "w", "sig").alias("v"))
    packed = packed.groupBy("tree", "prefix", "own").agg(F.first("others").alias("others"), F.collect_list("v").alias("v"))
    met = packed.select("tree", "prefix", "own", F.explode("others").alias("other"), "v")
    met = met.select("tree", "prefix", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "v").withColumn("task", F.xxhash64("tree", "prefix", "lo", "hi"))

    def between(t: pa.Table) -> pa.Table | None:
        lo, hi, tree = (t.column(c)[0].as_py() for c in ("lo", "hi", "tree"))
        if lo != hi and t.num_rows < 2:
            return None
        v = t.column("v").combine_chunks()
        rows = pa.Table.from_struct_array(v.flatten())
        own = np.repeat(np.array(t.column("own").to_pylist()), pc.list_value_length(v).to_numpy())
        left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        return paired(tree, t.column("task")[0], rows, left, right, lo == hi)

    return grouped_stream(alone, ["tree", "prefix"], within, out).unionByName(grouped_stream(met, ["tree", "prefix", "lo", "hi"], between, out))


def verify(found: DataFrame, texts: DataFrame, depth: int, threshold: float) -> DataFrame:
    """(id, root, n, expected): links of a vertex within a task, verified on the shingles of the texts."""
    joined = found.join(texts, "id")

    def check(t: pa.Table) -> pa.Table | None:
        ids, w = t.column("id").to_numpy(), t.column("w").to_numpy()
        place = {int(x): i for i, x in enumerate(ids)}
        pairs = np.array([(i, place[j]) for i, p in enumerate(t.column("partners").to_pylist()) for j in p if j in place], np.int64).reshape(-1, 2)
        h, begin = shingle_hashes([canonical(x) for x in t.column("t").to_pylist()])
        owner = np.repeat(np.arange(len(ids)), np.diff(np.append(begin, len(h))))
        order = np.lexsort((owner, h))
        h, owner = h[order], owner[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        h, owner = h[fresh], owner[fresh]
        size = np.bincount(owner, minlength=len(ids))
        value = np.concatenate([[0], np.cumsum(h[1:] != h[:-1])])
        shared = np.bincount(value)[value] > 1
        owner, value = owner[shared], np.unique(value[shared], return_inverse=True)[1]
        common = np.zeros((len(ids), len(ids)), np.float32)
        width = max(64, (1 << 22) // max(1, len(ids)))
        for at in range(0, int(value.max(initial=-1)) + 1, width):
            a, b = np.searchsorted(value, [at, at + width])
            part = np.zeros((len(ids), int(value[b - 1]) - at + 1), np.float32)
            part[owner[a:b], value[a:b] - at] = 1
            common += part @ part.T
        both = common[pairs[:, 0], pairs[:, 1]].astype(np.int64)
        either = size[pairs[:, 0]] + size[pairs[:, 1]] - both
        ok = both >= threshold * either - 1e-9
        if not ok.any():
            return None
        a, b = pairs[ok].T
        odds = 1 / chance(both[ok] / either[ok], depth)
        n, expected = np.zeros(len(ids), np.int64), np.zeros(len(ids))
        np.add.at(n, a, w[b])
        np.add.at(n, b, w[a])
        np.add.at(expected, a, w[b] * odds)
        np.add.at(expected, b, w[a] * odds)
        rank = np.argsort(ids, kind="stable")
        back = np.empty_like(rank)
        back[rank] = np.arange(len(ids))
        root = ids[rank][local_roots(back[a], back[b], len(ids))][back]
        show = np.unique(np.concatenate([a, b]))
        return pa.table({"id": pa.array(ids[show]), "root": pa.array(root[show]), "n": pa.array(n[show]), "expected": pa.array(expected[show])})

    return grouped_stream(joined, ["task"], check, "id long, root long, n long, expected double")


def sets_of(canon: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, size): the distinct shingles of texts and how many each text has."""
    h, begin = shingle_hashes(canon)
    owner = np.repeat(np.arange(len(canon)), np.diff(np.append(begin, len(h))))
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[fresh], owner[fresh], np.bincount(owner[fresh], minlength=len(canon))


def audited(wordy: DataFrame, texts: DataFrame, threshold: float, sample: int = AUDIT) -> dict[int, int]:
    """True links (rows of other texts) of up to `sample` vertices, by comparison with every text."""
    picked = wordy.orderBy(F.xxhash64("id", F.lit("audit")), "id").limit(sample).select("id")
    held = texts.join(F.broadcast(picked), "id").dropDuplicates(["id"]).toPandas()
    if not len(held):
        return {}
    own = [canonical(bytes(t)) for t in held["t"]]
    h, text, size = sets_of(own)
    order = np.argsort(h, kind="stable")
    text = text[order]
    known, first, many = np.unique(h[order], return_index=True, return_counts=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(own), np.int64)

        def add(canon: list[bytes]) -> None:
            h, row, rows = sets_of(canon)
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = known[at] == h
            at, row = at[hit], row[hit]
            c = many[at]
            other = text[np.repeat(first[at] - np.cumsum(c) + c, c) + np.arange(c.sum())]
            common = np.bincount(np.repeat(row, c) * len(own) + other, minlength=len(canon) * len(own)).reshape(len(canon), -1)
            total[:] += ((common > 0) & (common >= threshold * (rows[:, None] + size[None, :] - common) - 1e-9)).sum(axis=0)

        for batch in batches:
            held, n = [], 0
            for t in batch.column("t").to_pylist():
                if c := canonical(t):
                    # equal word sequences are the same vertex
                    held.append(c)
                    n += len(c)
                if n > 1 << 17:
                    add(held)
                    held, n = [], 0
            if held:
                add(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(own))), pa.array(total)], ["i", "true"])

    rows = texts.select("t").mapInArrow(run, "i long, true long").groupBy("i").agg(F.sum("true").alias("true")).collect()
    return {int(held["id"][r["i"]]): r["true"] for r in rows}


def classes(rows: DataFrame, *, text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(digest, vertex, w, root, n), written: for each word sequence of prepared() rows its vertex, its
    weight, the smallest vertex of its class, and the rows of other vertices that it links with."""
    texts = rows.select(F.col("uid").alias("id"), F.col(f"row.`{text}`").cast("binary").alias("t")).where("t is not null")
    vert = written(rows.where("digest is not null").groupBy("digest").agg(F.min("uid").alias("id"), F.count(F.lit(1)).alias("w"), F.first("sig").alias("sig")), "vertices")
    wordy = vert.where("sig is not null").select("id", "sig", "w")
    # prefixes of `promised` values find any pair at the threshold with the recall asked for
    promised = next((d for d in range(DEPTH, 0, -1) if chance(threshold, d) >= recall), 1)
    plain = tries(wordy, promised)
    count = plain.count()
    near = texts_of(plain, texts)
    ball = balls(plain, count, near, threshold)
    found, made = [], [vert, plain, near]

    def with_balls(trie: DataFrame) -> DataFrame:
        if ball is None:
            return trie.withColumn("ball", F.lit(-1).cast("long"))
        made.append(written(trie.join(ball, "id", "left").withColumn("ball", F.coalesce("ball", F.lit(-1))), "tries"))
        return made[-1]

    trie = with_balls(plain)
    if ball is not None:
        made.append(ball)
        inside = ball.join(vert.select("id", "w"), "id")
        whole = written(inside.groupBy("ball").agg(F.sum("w").alias("all"), F.count(F.lit(1)).alias("c")), "ball-sizes")
        made.append(whole)
        found.append(join_hot(inside, whole, ["ball"], count).select("id", F.col("ball").alias("root"), (F.col("all") - F.col("w")).alias("n")).where("n > 0"))
    true, total, seen = audited(wordy, texts, threshold), 0, Counter()
    held = vert.where(F.col("id").isin(list(true))).select("id", "w").collect()

    def note(part: DataFrame) -> tuple[int, float]:
        """All links of a part and those expected; those of the audited vertices go to seen."""
        rows = part.groupBy(F.when(F.col("id").isin(list(true)), F.col("id")).alias("id")).agg(F.sum("n").alias("n"), F.sum("expected").alias("e")).collect()
        seen.update({r["id"]: r["n"] for r in rows if r["id"] is not None})
        return sum(r["n"] for r in rows), sum(r["e"] for r in rows)

    for part in found:
        note(part.withColumn("expected", F.lit(0.0)))
    depth, above = DEPTH, DEPTH + 1
    while True:
        pairs = written(candidates(trie, count, wordy, depth, above, threshold, made), "pairs")
        new = written(verify(pairs, near, depth, threshold), "links")
        drop_written(pairs)
        made.append(new)
        found.append(new.select("id", "root", "n"))
        got, expected = note(new)
        total += got
        measured = recall_of(np.array([true[r["id"]] - r["w"] for r in held], np.int64), np.array([seen[r["id"]] for r in held], np.int64))
        log.info("prefixes of %s: %s links, %s expected, measured recall %s", depth, got, expected, measured)
        # what pairs like those found at this length leave to shorter ones, and what this length has added
        few = (not got or got / expected >= recall) and (depth == DEPTH or got <= (1 - recall) * total)
        if depth == 1 or (measured >= LEAST and (few or depth <= promised)):
            break
        depth, above = max(depth - STEP, promised) if depth > promised else depth - 1, depth
        if depth < promised:
            plain = tries(wordy, depth)
            near = texts_of(plain, texts)
            made += [plain, near]
            count = plain.count()
            trie = with_balls(plain)
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    comp = components(links.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    n = links.groupBy("id").agg(F.sum("n").alias("n"))
    whole = vert.select("digest", F.col("id").alias("vertex"), "w").join(n.withColumnRenamed("id", "vertex"), "vertex", "left").join(comp.withColumnRenamed("id", "vertex"), "vertex", "left")
    out = written(whole.select("digest", "vertex", "w", F.coalesce("component", "vertex").alias("root"), F.coalesce("n", F.lit(0)).cast("long").alias("n")), "classes")
    for old in made:
        drop_written(old)
    return out


def jaccard_classes(docs: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, n_links): for each document its class (smallest id in it) and its links."""
    rows = prepared(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null"))
    found = classes(rows, threshold=threshold, recall=recall)
    total = rows.count()
    least = rows.where("digest is not null").groupBy("digest").agg(F.min("row.id").alias("low")).join(found, "digest").groupBy("root").agg(F.min("low").alias("class_id"), F.count(F.lit(1)).alias("c"))
    least = written(least, "least")
    known = written(join_hot(found, least, ["root"], total).drop("c"), "known")
    linked = join_hot(rows.select("row.id", "digest"), known, ["digest"], total, "w").select(F.col("id").alias(key), "class_id", (F.col("n") + F.col("w") - 1).cast("long").alias("n_links"))
    alone = rows.where("digest is null").select(F.col("row.id").alias(key), F.col("row.id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return linked.unionByName(alone)


def single(docs: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """docs with one row of each class: that with the smallest id (null ids last; of equal ids any one).

    Null and empty texts are classes of their own, so all of them stay.
    """
    rows = prepared(docs, text)
    first = rows.where("digest is not null").groupBy("digest").agg(F.min(F.struct(F.col(f"row.`{key}`").isNull().alias("none"), F.col(f"row.`{key}`").alias("id"), "uid")).alias("first"))
    kept = classes(rows, text=text, threshold=threshold, recall=recall).join(first, "digest").groupBy("root").agg(F.min("first").alias("first")).select("first.uid")
    return rows.where("digest is null").unionByName(rows.join(kept, "uid", "left_semi")).select("row.*")
