"""What the operators of this folder share: tables, the shared folder, streamed groups, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


HUBS = 2000
#: Spark's setting that drops the shuffle files of an execution at its end.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Only where the session names none and runs on one machine a temporary one is made and kept in the
    session's settings, so that later calls find it; on a cluster that is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.tidemark.shared", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.tidemark.shared", where)
    return where.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage, survives lost executors.

    The write's shuffle files go with its end; else they stay until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/{what}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete the files behind a frame that written() returned, once nothing reads it any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Cut a stream of batches, sorted by keys, into one table for each key."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        cols = [batch.column(k).to_pylist() for k in keys]
        names = list(zip(*cols, strict=True))
        start = 0
        for i in range(n):
            if last is not None and names[i] != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start = [], i
            last = names[i]
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def grouped_stream(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], pa.Table | None], schema: str) -> DataFrame:
    """Apply fn to the rows of each key, streamed from a sorted partition.

    Like applyInArrow, but a task holds one group at a time and many small groups share a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer, rows = [], 0
        for group in groups(batches, keys):
            out = fn(group)
            if out is not None and out.num_rows:
                buffer.append(out)
                rows += out.num_rows
                if rows >= 8192:
                    yield from pa.concat_tables(buffer).combine_chunks().to_batches(max_chunksize=16384)
                    buffer, rows = [], 0
        if buffer:
            yield from pa.concat_tables(buffer).combine_chunks().to_batches(max_chunksize=16384)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def join_hot(df: DataFrame, groups: DataFrame, keys: list[str], rows: int, size: str = "c") -> DataFrame:
    """df joined with groups(keys, size, ...), where size is the number of rows that a group has in df.

    Groups with more than one in HUBS of all rows (rows: how many there are) are fewer than HUBS; what they
    say is sent to their rows, so that these needn't meet in one task. groups is best a written() frame: it is looked at for hot ones first,
    and where there are none the join is a plain one, which halves all plans over it.
    """
    limit = max(1000, rows // HUBS)
    if groups.where(F.col(size) > limit).isEmpty():
        return df.join(groups, keys)
    hot, rest = groups.where(F.col(size) > limit), groups.where(F.col(size) <= limit)
    return df.join(F.broadcast(hot), keys).unionByName(df.join(rest, keys))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges(a long, b long): rows (id, component), component the smallest id.

    Alternating large-star and small-star rounds: every round moves at most one row an edge, and a
    hub costs one row a neighbour. Rounds end when the rows stop changing; their number grows with
    the logarithm of the size. Each round is written to the shared folder. Nodes with more than one
    in HUBS of all edges are fewer than 2 x HUBS; their smallest neighbour is sent to their edges
    instead of gathering these in one task.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = written(e, "edges")
    seen, count = None, e.count()
    while True:
        # each step is written: as one plan, which is made anew as its stages end, a round costs the driver many times more
        # large-star: the larger neighbours of a node point to the smallest of it and its neighbours
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c")).select("u", F.least("u", "m").alias("m"), "c"), "edges-least")
        large = join_hot(both, least, ["u"], count).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u <> v").distinct(), "edges-large")
        # small-star: the smaller neighbours of a node, and itself, point to the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        new = written(small, "edges")
        mark = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        for old in (e, least, large):
            drop_written(old)
        e, count = new, mark[0]
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
    return e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component").union(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
