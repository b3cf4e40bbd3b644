"""Operator 3: shards by balanced label propagation.

Vertices are documents with a size; links lead from documents to the hub of their group (equal
texts here; any table of (doc, hub) will do). The start is an even split of a random order. In each
round the hubs take the shard that holds most of their bytes; members elsewhere ask to move there.
What a shard may take in a round is the room its linked rows leave up to a quota, what it may lose
is not limited; requests are granted in a fixed random order up to the room, by prefix sums over coarse
bins and then rows, never by one ranking of all rows. Rounds end when the share of linked bytes that
lie apart from most of their group falls by less than GAIN. Then a last pass evens the sizes out: rows
of shards over the mean go, small unlinked ones first, to the gaps of those under it.

The law is `bytes`: shard sizes (UTF-8 bytes of the text, plus 16 a row) near equal. A group larger
than a shard's room is split over several. Null texts count as empty, and empty texts are a group
like others; so are rows with a null id. Repeated rows are placed one by one; a very long text is one
row of its size, which may leave its shard over the mean; an empty table gives no rows. Rows of one
order get their place by a number that follows the files' layout, so another layout gives other
shards of the same quality. Other columns are not read. All work is DataFrame operations; what reaches
the driver or is broadcast is at most shards x 4096 sums and the hubs of over HOT rows, of which there
are fewer than 2,000.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, written

log = logging.getLogger(__name__)
SHARDS = 40
#: A round must lower the share of linked bytes apart from their group by this part of it.
GAIN = 0.02
#: Rows that a bin of the random order within a shard should have.
BIN_ROWS = 4096
#: Parts that a hub with many rows is dealt into.
PARTS = 64
OVERHEAD = 16
#: Share of the requests to leave a shard that counts as room for those who come.
LEAVING = 0.8
#: Share of a shard that linked rows may fill; the rest is left for evening out.
QUOTA = 0.9
#: Share of a shard that one hub may fill.
PART = 0.5


def running(df: DataFrame, part: str, amount: str, order: list, out: str) -> DataFrame:
    """Adds out: the sum of amount over earlier rows of the same part, in two passes.

    Pass one sums coarse bins (df has a column bin), pass two runs inside a bin only, so no task
    needs all rows of a part.
    """
    sums = df.groupBy(part, "bin").agg(F.sum(amount).alias("_s"))
    w = Window.partitionBy(part).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(part, "bin", F.coalesce(F.sum("_s").over(w), F.lit(0)).alias("_b"))
    inside = Window.partitionBy(part, "bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_i", F.coalesce(F.sum(amount).over(inside), F.lit(0))).join(F.broadcast(before), [part, "bin"]).withColumn(out, F.col("_i") + F.col("_b")).drop("_i", "_b")


def vertices(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(uid, id, size, crc, hub, rnd): what placing needs; no text goes further."""
    t = F.coalesce(F.col(text), F.lit(""))
    v = docs.select(F.col(key).cast("long").alias("id"), (F.octet_length(t) + OVERHEAD).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("crc"), F.md5(t.cast("binary")).alias("hub"))
    v = v.withColumn("uid", F.monotonically_increasing_id())
    return v.withColumn("rnd", F.xxhash64("id", "uid"))


def bin_of(n: int):
    return F.pmod(F.shiftright("rnd", 20), F.lit(n)).cast("int")


def even_start(v: DataFrame, shards: int, bins: int) -> DataFrame:
    """Cut the random order of all rows into shards of equal bytes."""
    total = v.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    placed = running(v.withColumn("all", F.lit(0)).withColumn("bin", bin_of(bins * shards)), "all", "size", ["rnd", "uid"], "at")
    cut = F.least(F.floor(F.col("at") * shards / F.lit(max(1, total))), F.lit(shards - 1)).cast("int")
    return placed.select("uid", "id", "size", "crc", "hub", "rnd", bin_of(bins).alias("bin"), cut.alias("shard"))


def by_hub(v: DataFrame, hubs: DataFrame, columns: list[str]) -> DataFrame:
    """v with columns of hubs(hub, hot, ...) where it has a hub there. The rows of hot hubs stay where they are."""
    hot, rest = hubs.where("hot").select("hub", *columns), hubs.where("not hot").select("hub", *columns)
    return v.where("hot").join(F.broadcast(hot), "hub", "left").unionByName(v.where("not hot").join(rest, "hub", "left"))


def best_shards(v: DataFrame) -> DataFrame:
    """(hub, hot, want, all, most): the shard with most of a linked hub's bytes, the hub's bytes and those there."""
    weights = v.where("linked = 1").groupBy("hub", "hot", "shard").agg(F.sum("size").alias("w"))
    best = weights.groupBy("hub", "hot").agg(F.max(F.struct("w", (-F.col("shard")).alias("s"))).alias("m"), F.sum("w").alias("all"))
    return best.select("hub", "hot", (-F.col("m.s")).cast("int").alias("want"), "all", F.col("m.w").alias("most"))


def apart(v: DataFrame) -> float:
    """The share of linked bytes that lie in another shard than most of their group."""
    row = best_shards(v).agg(F.sum("all"), F.sum("most")).first()
    return 1 - row[1] / row[0] if row[0] else 0.0


def one_round(v: DataFrame, capacity: float) -> DataFrame:
    """One round of propagation over v(uid, id, size, crc, hub, rnd, bin, hot, linked, shard)."""
    asked = by_hub(v, best_shards(v), ["want"])
    movers = asked.where("want is not null and want <> shard")
    # the quota is for linked rows, the others give way in the last pass; most of what asks to leave
    # will leave and makes room in the same round
    load = v.where("linked = 1").groupBy("shard").agg(F.sum("size").alias("all")).join(movers.groupBy("shard").agg(F.sum("size").alias("out")), "shard", "left")
    load = load.select("shard", (F.col("all") - F.lit(LEAVING) * F.coalesce("out", F.lit(0))).alias("load"))
    room = load.select(F.col("shard").alias("want"), F.greatest(F.lit(0.0), F.lit(capacity) - F.col("load")).alias("room"))
    ranked = running(movers, "want", "size", ["rnd", "uid"], "asked_before").join(F.broadcast(room), "want")
    granted = ranked.where(F.col("asked_before") + F.col("size") <= F.col("room")).select("uid", "want")
    return v.join(granted, "uid", "left").withColumn("shard", F.coalesce("want", "shard")).drop("want")


def even_out(v: DataFrame, shards: int, bins: int) -> DataFrame:
    """Move what lies over the mean, unlinked rows first, into the gaps under it."""
    total = v.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    mean = total / shards
    # linked rows first, then large before small: what passes the mean is small and unlinked as far as
    # possible. The rows of a hub follow each other, over several bins if it is hot
    classes = F.lit(63) - F.floor(F.log2(F.col("size").cast("double"))).cast("int")
    own = F.pmod(F.xxhash64("hub"), F.lit(bins)).cast("int") * PARTS + F.when(F.col("hot"), bin_of(PARTS)).otherwise(0)
    v = v.withColumn("bin", F.when(F.col("linked") == 1, own).otherwise(bins * PARTS + classes * bins + bin_of(bins)))
    v = running(v, "shard", "size", ["hub", "rnd", "uid"], "at")
    over = (F.col("at") + F.col("size")) > F.lit(mean)
    stay, leave = v.where(~over), v.where(over)
    kept = {r["shard"]: r["s"] for r in stay.groupBy("shard").agg(F.sum("size").alias("s")).collect()}  # one row a shard
    gaps, at = [], 0.0
    for s in range(shards):
        gap = max(0.0, mean - kept.get(s, 0))
        gaps.append((s, at, at + gap))
        at += gap
    left = leave.withColumn("all", F.lit(0)).withColumn("bin", bin_of(bins * shards))
    left = running(left, "all", "size", ["rnd", "uid"], "pos")
    mid = F.col("pos") + F.col("size") / 2
    target = F.lit(shards - 1)
    for s, _, hi in reversed(gaps[:-1]):
        target = F.when(mid < F.lit(hi), F.lit(s)).otherwise(target)
    cols = ["uid", "id", "size", "crc", "rnd"]
    moved = left.select(*cols, target.cast("int").alias("shard"))
    return stay.select(*cols, F.col("shard").cast("int")).unionByName(moved)


def shard_documents(docs: DataFrame, shards: int = SHARDS, *, gain: float = GAIN, quota: float = QUOTA, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row."""
    made = [written(vertices(docs, key, text), "vertices")]

    def step(df: DataFrame, what: str) -> DataFrame:
        """Write what comes next; what it was made from isn't needed any more."""
        made.append(written(df, what))
        drop_written(made[-2])
        return made[-1]

    total, rows = made[0].agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    mean = total / shards
    bins = min(4096, max(64, rows // (shards * BIN_ROWS) + 1))
    v = step(even_start(made[0], shards, bins), "start")
    # a group that fills over half a shard is cut into hubs of that size, so that each can settle
    # somewhere and no task gets all of it; there are fewer than 2 x shards such groups
    groups = v.groupBy("hub").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n"))
    large = groups.where(F.col("s") > PART * mean).select("hub", F.ceil(F.col("s") / F.lit(max(1.0, PART * mean))).cast("int").alias("parts"))
    cut = F.when(F.col("parts").isNotNull(), F.concat_ws("#", "hub", F.pmod(F.shiftright("rnd", 7), "parts").cast("string"))).otherwise(F.col("hub"))
    v = step(v.join(F.broadcast(large), "hub", "left").withColumn("hub", cut).drop("parts"), "cut")
    # hubs with many rows: their number is bounded, so what is to be known of them is sent to their rows
    many = max(512, rows // 2000)
    groups = v.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hub", (F.col("n") > many).alias("hot"), F.lit(1).alias("linked"))
    hot = F.broadcast(groups.where("hot"))
    marked = v.join(hot, "hub").select(*v.columns, "hot", "linked")
    plain = v.join(hot.select("hub"), "hub", "left_anti").join(groups.where("not hot"), "hub", "left").select(*v.columns, F.coalesce("hot", F.lit(False)).alias("hot"), F.coalesce("linked", F.lit(0)).alias("linked"))
    v = step(marked.unionByName(plain), "linked")
    share = apart(v)
    while share > 0:
        v = step(one_round(v, mean * quota), "round")
        last, share = share, apart(v)
        log.info("share of linked bytes apart from their group: %.4f", share)
        if share > last * (1 - gain):
            break
    v = step(even_out(v, shards, bins), "placed")
    v = v.withColumn("bin", bin_of(bins)).withColumn("one", F.lit(1))
    out = running(v, "shard", "one", ["rnd", "uid"], "slot")
    return out.select(F.col("id").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
