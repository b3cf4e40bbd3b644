"""Operator 12: mix sources to target weights, in fixed-length blocks of words. DataFrame functions only.

Sources stand in code point order (null last) and carry the weights 1, 2, 3, 1, ... They share the words
of all documents by weight; a target stops at REPEAT times the words of its source, and what is over is
shared again by weight until no target is above that. That fixed point is found in one pass over the
sources ordered by cap / weight: those capped are the first ones.

1. The words of a source, document after document in a hashed order, are cut into blocks of `block` words
   (the last one may be shorter). Starts are prefix sums: over the bins of a source, then inside a bin.
2. The output has as many slots as the targets have blocks, in shards of `slots`. Every slot of a shard
   draws its source with probabilities by target, so each shard's counts are multinomial. What a source
   drew over its quota, taken evenly from all its shards, is drawn again among the sources that are short,
   without replacement: the mix meets every target to the word.
3. The j-th slot of a source reads block perm(j mod blocks) of pass j div blocks; each pass has a
   pseudorandom permutation of its own (swap-or-not: a bijection of any number of blocks without walks or
   tables). A last slot takes only what its target still lacks, from its block's start.
4. Blocks and slots meet by (source, block number).

As a pass reads each block once and there are at most REPEAT passes, no document exceeds REPEAT times its
size. All draws are hashes of numbers, and rows are ordered by a hash of id and text, so reruns agree
whatever the layout of the files.

Null and empty texts have size 0: they take part in the result with taken 0. A null source is a source of
its own. Rows with null or repeated ids and repeated rows are placed one by one; rows equal in id, text and
source are interchangeable. A very long text is many pieces. An empty table gives no rows; other columns
are not read. What is broadcast is a row a source and CELLS cells, and only up to FEW sources; the table of
sources is ordered in one task (it is the list that weights are given to, not data).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: What counts as a word, as a pattern of Java and Python.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
REPEAT = 3
BLOCK = 256
#: Slots of an output shard.
SLOTS = 16384
#: Rows of a source that a bin of its hashed order should have.
BIN_ROWS = 16384
#: Equal parts of a range of numbers, by which intervals are looked up.
CELLS = 4096
#: Sources that may be broadcast.
FEW = 100_000
#: Rounds of a permutation.
ROUNDS = 24
DRAW, DEAL, READ = 1, 2, 3


def long(x: int) -> Column:
    return F.lit(x).cast("long")


def shuffled(x: Column, n: Column, *key: Column, inverse: bool = False) -> Column:
    """Where a pseudorandom permutation of 0..n-1, chosen by key, sends x: rounds of swap-or-not.

    A round pairs v with K - v (mod n) and swaps the two or not, by a hash of the larger: it undoes itself.
    """

    def swap_or_not(v: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(*key, r), n) - v, n)
        return F.when(F.pmod(F.xxhash64(*key, r, F.greatest(v, other)), long(2)) == 0, other).otherwise(v)

    first, last = (ROUNDS - 1, 0) if inverse else (0, ROUNDS - 1)
    return F.aggregate(F.sequence(long(first), long(last)), x, swap_or_not)


def interval(rows: DataFrame, at: str, bounds: DataFrame, total: int, few: bool) -> DataFrame:
    """rows with the columns of that row of bounds(lo, hi, ...) whose interval holds rows.at, from 0 to total - 1."""
    width = long(max(1, math.ceil(total / CELLS)))
    cells = bounds.where("hi > lo").withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    cells = F.broadcast(cells) if few else cells
    return rows.withColumn("cell", F.floor(F.col(at) / width)).join(cells, "cell").where(F.col(at).between(F.col("lo"), F.col("hi") - 1)).drop("cell", "lo", "hi")


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, src, size, h) for every row; src is the source with null told from any string."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    src = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))
    return docs.select(F.col(key).cast("long").alias("doc_id"), src.alias("src"), size.alias("size"), F.xxhash64(key, text).alias("h"))


def targets(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeat: int = REPEAT) -> DataFrame:
    """(src, no, n_rows, source_size, target, goal) for each source of sized(): goal is the target in whole words."""
    found = docs.groupBy("src").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    found = found.withColumn("no", F.row_number().over(Window.orderBy(F.col("src") == "", "src")).cast("long") - 1)
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), F.pmod("no", F.lit(len(weights))).cast("int") + 1)
    exact = lambda c: c.cast("decimal(38,0)")
    found = found.withColumns({"w": exact(w), "cap": exact(F.col("source_size") * repeat)})
    # sources by cap / weight, in whole numbers
    ratio = F.col("cap") * exact(F.floor(long(math.lcm(*weights)) / w))
    order, all_ = Window.orderBy(ratio, "no").rowsBetween(Window.unboundedPreceding, -1), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = exact(F.sum("source_size").over(all_)) - F.coalesce(exact(F.sum("cap").over(order)), exact(F.lit(0)))
    weight = exact(F.sum("w").over(all_)) - F.coalesce(exact(F.sum("w").over(order)), exact(F.lit(0)))
    found = found.withColumns({"left": exact(left), "weight": exact(weight)})
    found = found.withColumn("capped", F.col("cap") * F.col("weight") < F.col("w") * F.col("left"))
    over = exact(F.sum("source_size").over(all_)) - exact(F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(all_))
    by = F.sum(F.when(~F.col("capped"), F.col("w"))).over(all_)
    share = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise((F.col("w") * over).cast("double") / by.cast("double"))
    found = found.withColumn("target", F.least(F.coalesce(share, F.lit(0.0)), F.col("cap").cast("double")))
    goal = F.least(F.floor(F.col("target") + 0.5), F.col("source_size") * repeat)
    return found.select("src", "no", "n_rows", "source_size", "target", goal.cast("long").alias("goal"))


def quotas(sources: DataFrame, block: int) -> DataFrame:
    """Adds blocks, tail (words of the last block), passes and rest (goal in whole passes and words over), short (the last
    block's place in the pass that is cut) and quota (slots), and with lo and hi the quotas one after the other."""
    s = sources.withColumn("blocks", F.floor((F.col("source_size") + (block - 1)) / long(block)))
    size = F.greatest(F.col("source_size"), long(1))
    s = s.withColumns({"tail": F.col("source_size") - (F.col("blocks") - 1) * block, "passes": F.floor(F.col("goal") / size)})
    s = s.withColumn("rest", F.col("goal") - F.col("passes") * F.col("source_size"))
    n = F.greatest(F.col("blocks"), long(1))
    s = s.withColumn("short", shuffled(n - 1, n, long(READ), F.col("no"), F.col("passes"), inverse=True))
    before = F.col("short") * block
    part = F.ceil(F.col("rest") / long(block))
    past = F.col("short") + 1 + F.ceil(F.greatest(F.col("rest") - before - F.col("tail"), long(0)) / long(block))
    s = s.withColumn("quota", F.col("passes") * F.col("blocks") + F.when(F.col("rest") <= before, part).otherwise(past))
    w = Window.orderBy("no")
    return s.withColumns({"hi": F.sum("quota").over(w), "lo": F.sum("quota").over(w) - F.col("quota")})


def drawn(sources: DataFrame, total: int, slots: int, few: bool) -> DataFrame:
    """(shard, no, c): multinomial counts of each shard's slots, settled so that each source has its quota."""
    spark = sources.sparkSession
    own = F.broadcast if few else lambda df: df
    each = spark.range(0, total).select(F.floor(F.col("id") / long(slots)).alias("shard"), F.pmod(F.xxhash64(long(DRAW), "id"), long(max(1, total))).alias("at"))
    counts = interval(each, "at", sources.select("no", "lo", "hi"), total, few).groupBy("shard", "no").agg(F.count(F.lit(1)).alias("c"))
    counts = written(counts, "drawn")
    sums = counts.groupBy("no").agg(F.sum("c").alias("all"))
    gap = sources.select("no", "quota").join(sums, "no", "left").select("no", "quota", F.coalesce("all", long(0)).alias("all"))
    gap = gap.select("no", "all", F.greatest(F.col("all") - F.col("quota"), long(0)).alias("over"), F.greatest(F.col("quota") - F.col("all"), long(0)).alias("under"))
    w = Window.orderBy("no")
    gap = written(gap.withColumns({"from": F.sum("over").over(w) - F.col("over"), "hi": F.sum("under").over(w), "lo": F.sum("under").over(w) - F.col("under")}), "gap")
    again = gap.agg(F.coalesce(F.sum("over"), F.lit(0))).first()[0]
    if not again:
        return counts
    # of a source's draws, numbered over its shards, `over` ones are given back, evenly spread
    upto = F.sum("c").over(Window.partitionBy("no").orderBy("shard"))
    c = counts.join(own(gap.select("no", "all", "over", "from")), "no").withColumn("upto", upto)
    back = lambda x: F.expr(f"cast(({x}) as decimal(38,0)) * over div all")
    c = c.withColumns({"first": back("upto - c"), "next": back("upto")})
    loose = c.where("next > first").select("shard", F.explode(F.sequence(F.col("from") + F.col("first"), F.col("from") + F.col("next") - 1)).alias("z"))
    loose = loose.select("shard", shuffled(F.col("z"), long(again), long(DEAL)).alias("at"))
    dealt = interval(loose, "at", gap.select("no", "lo", "hi"), again, few).select("shard", "no", long(1).alias("c"))
    kept = c.select("shard", "no", (F.col("c") - F.col("next") + F.col("first")).alias("c"))
    return kept.unionByName(dealt).groupBy("shard", "no").agg(F.sum("c").alias("c")).where("c > 0")


def slots_of(counts: DataFrame, sources: DataFrame, total: int, block: int, few: bool) -> DataFrame:
    """(shard, no, j, block, length, take): the block that each slot reads, its words, and how many of them are taken."""
    upto = F.sum("c").over(Window.partitionBy("no").orderBy("shard"))
    # few bytes, much work: a number of tasks that adaptive execution doesn't put together
    parts = max(int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // SLOTS))
    each = counts.withColumn("upto", upto).repartition(parts, "shard", "no").select("shard", "no", F.explode(F.sequence(F.col("upto") - F.col("c"), F.col("upto") - 1)).alias("j"))
    s = sources.select("no", "blocks", "tail", "passes", "rest", "short", "quota")
    each = each.join(F.broadcast(s) if few else s, "no").withColumns({"pass": F.floor(F.col("j") / F.col("blocks")), "at": F.pmod("j", "blocks")})
    each = each.withColumn("block", shuffled(F.col("at"), F.col("blocks"), long(READ), F.col("no"), F.col("pass")))
    each = each.withColumn("length", F.when(F.col("block") == F.col("blocks") - 1, F.col("tail")).otherwise(long(block)))
    before = F.col("at") * block - F.when(F.col("short") < F.col("at"), block - F.col("tail")).otherwise(0)
    last = (F.col("j") == F.col("quota") - 1) & (F.col("rest") > 0)
    return each.select("shard", "no", "j", "block", "length", F.when(last, F.col("rest") - before).otherwise(F.col("length")).alias("take"))


def pieces(docs: DataFrame, sources: DataFrame, block: int, few: bool) -> DataFrame:
    """(doc_id, h, no, start, size, source_size, target, block, lo, hi, first): the words of each row that each block holds.

    start is the row's first word in its source; words lo to hi - 1 of the block are the row's words from first on. Rows
    without words have one piece without a block."""
    s = sources.select("src", "no", "source_size", "target", F.ceil(F.col("n_rows") / long(BIN_ROWS)).alias("bins"))
    d = docs.join(F.broadcast(s) if few else s, "src").withColumn("bin", F.pmod(F.shiftright("h", 20), F.col("bins"))).drop("src", "bins")
    some = d.where("size > 0")
    bins = some.groupBy("no", "bin").agg(F.sum("size").alias("in_bin"))
    bins = bins.withColumn("before", F.sum("in_bin").over(Window.partitionBy("no").orderBy("bin")) - F.col("in_bin")).drop("in_bin")
    inside = F.sum("size").over(Window.partitionBy("no", "bin").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    some = some.withColumn("upto", inside).join(bins, ["no", "bin"]).withColumn("start", F.col("before") + F.col("upto") - F.col("size"))
    b = long(block)
    some = some.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b))))
    at = F.col("start") - F.col("block") * b
    none = d.where("size = 0").withColumns({x: F.lit(None).cast("long") for x in ("start", "block", "lo", "hi", "first")})
    some = some.withColumns({"lo": F.greatest(at, long(0)), "hi": F.least(at + F.col("size"), b), "first": F.greatest(-at, long(0))})
    return some.select(none.drop("bin").columns).unionByName(none.drop("bin"))


class Mix:
    """A plan of a mix of docs(key, text, source): its sources, pieces and slots."""

    def __init__(self, docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, repeat: int = REPEAT, block: int = BLOCK, slots: int = SLOTS, key: str = "doc_id", text: str = "text", source: str = "source"):
        self.names = (key, text, source)
        rows = written(sized(docs, key, text, source), "sized")
        self.sources = written(quotas(targets(rows, weights, repeat), block), "sources")
        n, total = self.sources.agg(F.count(F.lit(1)), F.coalesce(F.sum("quota"), F.lit(0))).first()
        few = n <= FEW
        self.pieces = pieces(rows, self.sources, block, few)
        self.slots = slots_of(drawn(self.sources, total, slots, few), self.sources, total, block, few)

    def taken(self) -> DataFrame:
        """(doc_id, size, source_size, target, taken) for every row."""
        uses = self.slots.groupBy("no", "block").agg(F.sum((F.col("take") == F.col("length")).cast("long")).alias("whole"), F.max(F.when(F.col("take") < F.col("length"), F.col("take"))).alias("part"))
        some = self.pieces.where("block is not null").join(uses, ["no", "block"], "left")
        words = F.coalesce("whole", long(0)) * (F.col("hi") - F.col("lo")) + F.greatest(F.least("hi", F.coalesce("part", long(0))) - F.col("lo"), long(0))
        some = some.groupBy("no", "start", "doc_id", "size", "source_size", "target").agg(F.sum(words).alias("taken"))
        columns = ["doc_id", "size", "source_size", "target"]
        return some.select(*columns, "taken").unionByName(self.pieces.where("block is null").select(*columns, long(0).alias("taken")))

    def spans(self) -> DataFrame:
        """(shard, slot, part, doc_id, h, first_word, n_words): what each output slot holds, in the order of part.

        Slots of a shard are numbered by a hash, so that sources alternate."""
        number = F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64("shard", "no", "j"), "no", "j")).cast("long") - 1
        some = self.pieces.where("block is not null").join(self.slots.withColumn("slot", number), ["no", "block"]).where("lo < take")
        return some.select("shard", "slot", F.col("lo").alias("part"), "doc_id", "h", F.col("first").alias("first_word"), (F.least("hi", "take") - F.col("lo")).alias("n_words"))

    def texts(self, docs: DataFrame) -> DataFrame:
        """spans() with the words themselves, joined by single spaces, as text."""
        key, text, _ = self.names
        own = docs.select(F.col(key).cast("long").alias("_id"), F.xxhash64(key, text).alias("_h"), F.col(text).alias("text")).dropDuplicates(["_id", "_h"])
        spans = self.spans()
        cut = F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), (F.col("first_word") + 1).cast("int"), F.col("n_words").cast("int"))
        found = spans.join(own, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")))
        return found.select(*spans.columns, F.array_join(cut, " ").alias("text"))
