"""Operator 11: a Merkle manifest of a dataset: one tree a source, and one over the sources' roots.

H is sha256 in lower-case hex over its inputs one after the other. A leaf is H of doc_id, source, lang, n_chars
and text, each `-` if null, else its bytes in UTF-8, `:` and its value. The leaves of a source stand in the order
of doc_id (null first; equal ids by leaf). While a tree has several nodes, every FANOUT consecutive ones (the last
run may be shorter) become their H: no padding. The roots of the sources, null first and then bytewise, are the
leaves of the last tree.

1. Leaves are dealt to partitions by ranges of (source, doc_id), so that a large source covers many of them, and
   sorted; counts per partition and source give each leaf its index.
2. Each task streams its leaves through a mountain range: a stack with one open run a level. A run that is full,
   or that ends its level, is closed and its H carried to the next level, like a digit of a counter in base FANOUT.
   Every run is put out as a record of its children. Where a task begins or ends inside a run, it puts out the part
   it has seen (an unaligned edge), which nothing above it can be built on.
3. Edges are put together level by level: parts of one run meet by (source, level, run), become a full record, and
   its H is a part of a run of the next level, until no parts are left. A task has at most two edges a level.
4. Proofs run down from the roots: a run's path is its own record and the path of the run above it. Leaves meet
   the path of their run (at most FANOUT rows a key), and all hashes of a proof are computed there.

A lone leaf is its source's root without hashing. A null doc_id is never tampered with in `proofs`. Empty and null
texts are leaves like others; repeated rows are one leaf each, equal in hash; a very long text is hashed where it
is read and goes no further. An empty table has no nodes and gives no rows. Other columns are not read. Nothing but
counts reaches the driver; the starts of the partitions (a row a partition and source) are broadcast up to FEW rows.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, written

FANOUT = 16
#: Hex digits of a digest.
HEX = 64
#: Leaves that a partition should have at most.
ROWS = 500_000
FEW = 100_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A run of a level: its children from number `first` on; whole: all of them.
RUN = "src string, level int, run long, first int, hashes string, nodes long, whole boolean"


def sha(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def encoded(c: Column) -> Column:
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(*fields: Column) -> Column:
    return sha(*[encoded(f) for f in fields])


def lowered(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def indexed(leaves: DataFrame, order: list[str]) -> DataFrame:
    """leaves(src, hash, ...) with index (within src, by order), nodes (leaves of src) and, for the tasks' order, part."""
    spark = leaves.sparkSession
    rows = leaves.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS))
    dealt = leaves.repartitionByRange(parts, "src", *order).sortWithinPartitions("src", *order)
    at = F.monotonically_increasing_id()
    dealt = written(dealt.withColumns({"part": F.shiftright(at, 33), "row": at.bitwiseAND(F.lit((1 << 33) - 1))}), "ranges")
    starts = dealt.groupBy("part", "src").agg(F.min("row").alias("from"), F.count(F.lit(1)).alias("c"))
    own = Window.partitionBy("src")
    starts = starts.withColumns({"before": F.sum("c").over(own.orderBy("part")) - F.col("c"), "nodes": F.sum("c").over(own)}).drop("c")
    starts = written(starts, "starts")
    starts = F.broadcast(starts) if starts.count() <= FEW else starts
    return dealt.join(starts, ["part", "src"]).withColumn("index", F.col("row") - F.col("from") + F.col("before")).drop("row", "from", "before")


class Range:
    """A mountain range over consecutive leaves of one tree of n leaves: open runs by level, records of what is closed."""

    def __init__(self, src: str, n: int):
        self.src, self.sizes = src, [n]
        while self.sizes[-1] > 1:
            self.sizes.append(-(-self.sizes[-1] // FANOUT))
        self.open: list[tuple[int, list[str]] | None] = [None] * max(1, len(self.sizes) - 1)
        self.records: list[tuple] = []

    def add(self, level: int, at: int, digest: str) -> None:
        """The node number `at` of a level; nodes of a level come in order."""
        while level < len(self.open):
            if self.open[level] is None:
                self.open[level] = (at, [])
            start, run = self.open[level]
            run.append(digest)
            if (at + 1) % FANOUT and at + 1 < self.sizes[level]:
                return
            self.close(level)
            if start % FANOUT:
                return  # an edge: its begin lies in another task
            level, at, digest = level + 1, at // FANOUT, hashlib.sha256("".join(run).encode()).hexdigest()

    def close(self, level: int) -> None:
        start, run = self.open[level]
        whole = start % FANOUT == 0 and (start + len(run) == self.sizes[level] or len(run) == FANOUT)
        self.records.append((self.src, level, start // FANOUT, start % FANOUT, "".join(run), self.sizes[0], whole))
        self.open[level] = None

    def end(self) -> None:
        for level, run in enumerate(self.open):
            if run:
                self.close(level)


def mountains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of the runs that a stream of leaves (src, index, nodes, hash), sorted, closes or leaves open."""
    schema = pa.schema([("src", pa.string()), ("level", pa.int32()), ("run", pa.int64()), ("first", pa.int32()), ("hashes", pa.string()), ("nodes", pa.int64()), ("whole", pa.bool_())])
    held, last = None, None

    def put(records: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*records, strict=True), schema.types, strict=True)], schema=schema)

    for batch in batches:
        done = []
        for src, at, n, digest in zip(*(batch.column(c).to_pylist() for c in ("src", "index", "nodes", "hash")), strict=True):
            if held is None or (src, at - 1) != last:
                if held:
                    held.end()
                    done += held.records
                held = Range(src, n)
            held.add(0, at, digest)
            last = (src, at)
        if held:
            done += held.records
            held.records = []
        if done:
            yield put(done)
    if held:
        held.end()
        if held.records:
            yield put(held.records)


def depth(n: int) -> int:
    """Levels that have runs."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return max(1, levels)


def level_size(nodes: Column, level: int) -> Column:
    """How many nodes a level has in a tree of so many leaves."""
    return F.ceil(nodes / F.lit(FANOUT**level)).cast("long")


def run_size(level: int) -> Column:
    return F.least(F.lit(FANOUT).cast("long"), level_size(F.col("nodes"), level) - F.col("run") * FANOUT)


def runs_of(leaves: DataFrame) -> DataFrame:
    """All runs of all trees over leaves(src, index, nodes, hash): (src, level, run, hashes, nodes), each one whole."""
    sorted_ = leaves.select("src", "index", "nodes", "hash").sortWithinPartitions("src", "index")
    found = written(sorted_.mapInArrow(mountains, RUN), "runs")
    edges = found.where("not whole").drop("whole")
    whole = [found.where("whole").drop("whole", "first")]
    top = found.agg(F.max("nodes")).first()[0]
    carried = None  # what merging a level below has made
    for level in range(depth(top or 0)):
        parts = edges.where(F.col("level") == level).drop("level")
        if carried is not None:
            parts = parts.unionByName(carried)
        joined = parts.groupBy("src", "run", "nodes").agg(F.array_sort(F.collect_list(F.struct("first", "hashes"))).alias("parts"))
        joined = joined.select("src", "run", "nodes", F.array_join("parts.hashes", "").alias("hashes"))
        merged = written(joined.withColumn("level", F.lit(level)), "merged")
        short = merged.where(F.length("hashes") != HEX * run_size(level))
        if short.limit(1).count():
            raise RuntimeError("parts of a run are missing")
        whole.append(merged)
        up = merged.where(level_size(F.col("nodes"), level) > FANOUT)
        carried = up.select("src", F.floor(F.col("run") / FANOUT).alias("run"), F.pmod("run", F.lit(FANOUT)).cast("int").alias("first"), sha(F.col("hashes")).alias("hashes"), "nodes")
    columns = ["src", "level", "run", "hashes", "nodes"]
    out = whole[0].select(columns)
    for df in whole[1:]:
        out = out.unionByName(df.select(columns))
    return out


def roots_of(runs: DataFrame) -> DataFrame:
    """(src, hash) for each tree: H of its last run, or its lone leaf."""
    top = runs.where("run = 0").groupBy("src", "nodes").agg(F.max(F.struct("level", "hashes")).alias("m"))
    return top.select("src", F.when(F.col("nodes") == 1, F.col("m.hashes")).otherwise(sha(F.col("m.hashes"))).alias("hash"))


def beside(hashes: Column, at: Column) -> Column:
    """What stands before and after child number `at` of a run."""
    slot = F.pmod(at, F.lit(FANOUT)).cast("int") * HEX
    return F.struct(hashes.substr(F.lit(1), slot).alias("left"), hashes.substr(slot + HEX + 1, F.lit(HEX * FANOUT)).alias("right"))


def paths(runs: DataFrame, above: DataFrame) -> DataFrame:
    """(src, run, hashes, nodes, path, ...) for the runs over leaves: path is what stands beside each node above the run.

    above(src, path, ...): one row a tree, what stands beside its root, and columns to be handed on."""
    more = [c for c in above.columns if c not in ("src", "path")]
    columns = ["src", "run", "hashes", "nodes", "path", *more]
    upper = None
    for level in reversed(range(depth(runs.agg(F.max("nodes")).first()[0] or 0))):
        own = runs.where(F.col("level") == level)
        last = level_size(F.col("nodes"), level) <= FANOUT
        found = own.where(last).join(above, "src").select(columns)
        if upper is not None:
            up = upper.select("src", F.col("run").alias("_up"), F.col("hashes").alias("_hashes"), F.col("path").alias("_path"), *more)
            rest = own.where(~last).withColumn("_up", F.floor(F.col("run") / FANOUT)).join(up, ["src", "_up"])
            found = found.unionByName(rest.withColumn("path", F.concat(F.array(beside(F.col("_hashes"), F.col("run"))), "_path")).select(columns))
        upper = found if level == 0 else written(found, "paths")
    return runs.where("false").join(above, "src").select(columns) if upper is None else upper


def proofs_of(leaves: DataFrame, lowest: DataFrame) -> DataFrame:
    """leaves(src, index, ...) with the columns of paths() and `beside`: what stands beside each node from the leaf to the root."""
    own = leaves.drop("nodes").withColumn("run", F.floor(F.col("index") / FANOUT))
    found = own.join(lowest, ["src", "run"])
    first = F.when(F.col("nodes") == 1, F.col("path")).otherwise(F.concat(F.array(beside(F.col("hashes"), F.col("index"))), F.col("path")))
    return found.withColumn("beside", first).drop("hashes", "path", "run")


def folded(start: Column, beside_: Column) -> Column:
    """The root that a leaf and what stands beside its path lead to."""
    return F.aggregate(beside_, start, lambda h, b: sha(b["left"], h, b["right"]))


class Manifest:
    """The trees over docs: leaves, runs (the node records, by source), roots, tree (the runs over the roots), root."""

    def __init__(self, docs: DataFrame, fields: tuple[str, ...] = FIELDS):
        """fields: the columns that correspond to doc_id, source, lang, n_chars and text, in this order."""
        key, source, *_, text = fields
        src = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))
        tampered = leaf(*[lowered(F.col(f)) if f == text else F.col(f) for f in fields])
        chosen = F.crc32(F.col(key).cast("string")) % 5 == 0
        rows = docs.select(src.alias("src"), F.col(key).cast("long").alias("doc_id"), leaf(*[F.col(f) for f in fields]).alias("hash"), F.when(chosen, tampered).alias("tampered"))
        rows = written(rows, "leaves")
        self.leaves = indexed(rows, ["doc_id", "hash"])
        self.runs = written(runs_of(self.leaves), "manifest")
        self.roots = written(indexed(roots_of(self.runs).withColumnsRenamed({"src": "of"}).withColumn("src", F.lit("")), ["of"]), "roots")
        self.tree = written(runs_of(self.roots), "manifest")
        found = roots_of(self.tree).first()
        self.root = found["hash"] if found else None
        drop_written(rows)

    def proofs(self) -> DataFrame:
        """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row.

        The proof is checked against tampering: rows whose crc32(doc_id) five divides have their text lower-cased."""
        root = F.lit(self.root).cast("string")
        top = self.tree.select("src").distinct().select("src", F.array().cast("array<struct<left:string,right:string>>").alias("path"))
        above = proofs_of(self.roots, paths(self.tree, top)).select(F.col("of").alias("src"), F.col("beside").alias("path"), F.col("hash").alias("subroot"))
        found = proofs_of(self.leaves, paths(self.runs, written(above, "above")))
        proof = sha(F.array_join(F.transform("beside", lambda b: F.concat(b["left"], b["right"])), ""))
        found = found.select("doc_id", F.col("hash").alias("leaf"), "subroot", root.alias("root"), proof.alias("proof_sha256"), folded(F.coalesce("tampered", "hash"), F.col("beside")).alias("folded_root"))
        return found.withColumn("verified", F.col("folded_root") == F.col("root"))
