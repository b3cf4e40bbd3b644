"""Operator 1: exact nearest neighbours by a block matrix join over int8 tiles.

Equal vectors are one candidate with its k + 1 smallest ids, so copies cost nothing. Every vector is
quantised once, to int8 codes and the int8 codes of what those lost, each with a scale (times a power of
two, so that no norm overflows or vanishes) and e, the length of what is lost then. Queries and
candidates are dealt into blocks and a task gets the codes of one block of each, a quarter of the
original vectors. The integer product of the tiles gives the distance of the quantised vectors, which is
within e_q + e_c (and the rounding of the product) of the true one. Candidates whose lower bound passes
the k-th smallest upper bound of a query can't be among its k nearest; those left get the much narrower
bounds of both codes, and are sorted out again, in the block and then over all blocks. Only the survivors
are joined with their original vectors and computed in double precision; a heap keeps the k best of a
query. The result is exact.

Distances are those of the plain formula, or of the same formula on scaled vectors where its squares
overflow or vanish. Vectors that are null, empty, zero or hold null or non-finite components take no
part, nor do pairs of different lengths. Ties go to the smaller vec_id; repeated rows are candidates
each, but a query is never matched with rows of its own vec_id, and rows of one query id are one query
(the smallest vector). Null ids take no part. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import grouped_stream, written

QUERY_BLOCK = 4096
CANDIDATE_BLOCK = 16384
#: Query rows of a tile whose products are held at once.
TILE = 128
#: Rounding of a squared distance of quantised vectors, as a share of the squared lengths.
ROUNDING = 1e-14
FLOATS = ("scale", "lost", "scale2", "lost2")


def usable(v: str) -> Column:
    """True for vectors that can be compared."""
    x = F.col(v)
    bad = F.exists(x, lambda a: a.isNull() | F.isnan(a) | (F.abs(a) == float("inf")))
    return F.coalesce(x.isNotNull() & ~bad & F.exists(x, lambda a: a != 0), F.lit(False))


def power_of_two(v: Column) -> Column:
    """Minus the exponent of the largest component: vectors times 2 ** it have components of about 1."""
    return F.least(F.lit(1000), F.greatest(F.lit(-1000), -F.floor(F.log2(F.array_max(F.transform(v, F.abs)))).cast("int")))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales and the lengths of the residuals."""
    scale = np.abs(x).max(axis=1) / 127.0
    scale[scale == 0] = 1.0
    code = np.rint(x / scale[:, None]).astype(np.int8)
    lost = np.sqrt(((x - code * scale[:, None]) ** 2).sum(axis=1))
    return code, scale, lost


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of paired rows, summed in the order of the components."""
    total = np.zeros(len(a))
    with np.errstate(over="ignore", under="ignore"):
        for d in range(a.shape[1]):
            diff = a[:, d] - b[:, d]
            total += diff * diff
        out = np.sqrt(total)
        odd = np.flatnonzero(~np.isfinite(total) | (total < 1e-280))
        if len(odd):  # the squares overflow or lose digits
            diff = np.abs(a[odd] - b[odd])
            top = diff.max(axis=1)
            unit = diff / np.where((top > 0) & np.isfinite(top), top, 1)[:, None]
            out[odd] = np.where(top > 0, top * np.sqrt((unit**2).sum(axis=1)), 0)
    return out


def bounds(q: tuple, c: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the distances of quantised vectors (code, scale, lost, exponent); exponents are alike for all."""
    (qc, qs, qe), (cc, cs, ce) = q, c
    exact = np.float32 if qc.shape[1] <= 1000 else np.float64  # sums of products of int8 stay whole numbers
    dot = (qc.astype(exact) @ cc.astype(exact).T).astype(np.float64)
    both = ((qs**2) * (qc.astype(np.int32) ** 2).sum(axis=1))[:, None] + ((cs**2) * (cc.astype(np.int32) ** 2).sum(axis=1))[None, :]
    square = both - 2.0 * dot * (qs[:, None] * cs[None, :])
    lost = (qe[:, None] + ce[None, :]) * (1 + 1e-12)
    low = np.sqrt(np.maximum(0.0, square - ROUNDING * both)) * (1 - 1e-12) - lost
    high = np.sqrt(np.maximum(0.0, square + ROUNDING * both)) * (1 + 1e-12) + lost
    return np.maximum(low, 0.0), high


def both_codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code, scale, lost) of vectors, and those of what they lost."""
    code, scale, lost = quantise(x)
    return code, scale, lost, *quantise(x - code * scale[:, None])


def survivors(q_id: np.ndarray, q: tuple, c_id: list[set[int]], c: tuple, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, lower, upper) of one tile: row numbers and bounds of those that may be among the k nearest.

    q, c: both_codes(). c_id: the ids of a candidate; one that has only the query's own is none of its candidates.
    """
    only = np.array([next(iter(x)) if len(x) == 1 else -1 for x in c_id])
    single = np.array([len(x) == 1 for x in c_id])
    fine = [s[:, None] * a + t[:, None] * b for a, s, _, b, t, _ in (q, c)]
    out = []
    for at in range(0, len(q_id), TILE):
        part = slice(at, at + TILE)
        low, high = bounds(tuple(x[part] for x in q[:3]), c[:3])
        own = (q_id[part, None] == only[None, :]) & single[None, :]
        high[own] = np.inf
        nth = min(k, high.shape[1]) - 1
        bound = np.partition(high, nth, axis=1)[:, nth]
        rows, cols = np.nonzero((low <= bound[:, None]) & ~own)
        # the second codes' bounds of those left
        a, b = fine[0][at + rows], fine[1][cols]
        near = np.sqrt(((a - b) ** 2).sum(axis=1))
        lost = (q[5][at + rows] + c[5][cols]) * (1 + 1e-12) + ROUNDING * (np.sqrt((a**2).sum(axis=1)) + np.sqrt((b**2).sum(axis=1)))
        low, high = np.maximum(near * (1 - 1e-12) - lost, 0.0), near * (1 + 1e-12) + lost
        order = np.lexsort((high, rows))
        rows, cols, low, high = rows[order], cols[order], low[order], high[order]
        first, count = np.unique(rows, return_index=True, return_counts=True)[1:]
        bound = np.repeat(high[first + np.minimum(count, k) - 1], count)
        keep = (low <= bound) | np.repeat(count < k, count)
        out.append((rows[keep] + at, cols[keep], low[keep], high[keep]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    col = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1).astype(np.float64)


def coded(vectors: DataFrame) -> DataFrame:
    """(uid, ids, dim, exp and both_codes() in one binary and five numbers) of vectors (uid, ids, v): all that the tiles need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, exps = batch.column("dim").to_numpy(), batch.column("exp").to_numpy()
            for d in np.unique(dims):
                sel = np.flatnonzero(dims == d)
                part = batch.take(pa.array(sel))
                code, scale, lost, code2, scale2, lost2 = both_codes(np.ldexp(matrix(part.column("v")), exps[sel][:, None]))
                codes = pa.array([r.tobytes() for r in np.concatenate([code, code2], axis=1)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(x) for x in ("uid", "ids", "dim", "exp")), codes, *map(pa.array, (scale, lost, scale2, lost2))], ["uid", "ids", "dim", "exp", "codes", *FLOATS])

    rows = vectors.select("uid", "ids", F.size("v").alias("dim"), power_of_two(F.col("v")).alias("exp"), "v")
    return rows.mapInArrow(run, "uid long, ids array<long>, dim int, exp int, codes binary, " + ", ".join(f"{x} double" for x in FLOATS))


def distinct(rows: DataFrame, k: int) -> DataFrame:
    """(v, ids): each vector once with its k + 1 smallest ids, each as often as it has rows (k times at most).

    A vector's rows are first cut down in parts, so that no task sorts all copies of one.
    """
    part = Window.partitionBy("v", "part").orderBy("id")
    n = F.row_number().over(Window.partitionBy("v", "part", "id").orderBy("id"))
    few = rows.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64))).withColumn("n", n).where(F.col("n") <= k).withColumn("r", F.dense_rank().over(part)).where(F.col("r") <= k + 1)
    whole = few.groupBy("v", "id").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("n")).withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= k + 1)
    return whole.groupBy("v").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("id", "n"))), lambda x: F.array_repeat(x["id"], x["n"]))).alias("ids"))


def knn(queries: DataFrame, vectors: DataFrame, k: int = 10, *, key: str = "vec_id", vector: str = "embedding", query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k nearest rows with another id."""
    keep = lambda df: df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable("v"))
    # uid is fixed by writing it
    c = written(distinct(keep(vectors), k).select(F.monotonically_increasing_id().alias("uid"), "ids", "v"), "candidates")
    q = keep(queries).groupBy("id").agg(F.min("v").alias("v")).select(F.col("id").alias("uid"), F.array("id").alias("ids"), "v")
    n_q, n_c = q.count(), c.count()
    q_blocks, c_blocks = max(1, math.ceil(n_q / query_block)), max(1, math.ceil(n_c / candidate_block))
    block = lambda n: F.pmod(F.xxhash64("uid"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = coded(q).withColumn("qb", block(q_blocks)).withColumn("cb", every(c_blocks)).withColumn("side", F.lit(0))
    right = coded(c).withColumn("cb", block(c_blocks)).withColumn("qb", every(q_blocks)).withColumn("side", F.lit(1))

    def search(t: pa.Table) -> pa.Table | None:
        side = t.column("side").to_numpy()
        if not (0 < side.sum() < len(side)):
            return None
        codes = np.frombuffer(b"".join(t.column("codes").to_pylist()), np.int8).reshape(len(side), 2, -1)
        # lengths in the unit of the largest vector; what vanishes there has bounds of 0 and survives
        exp = t.column("exp").to_numpy()
        scale, lost, scale2, lost2 = (np.ldexp(t.column(x).to_numpy(), exp.min() - exp) for x in FLOATS)
        held = (codes[:, 0], scale, lost, codes[:, 1], scale2, lost2)
        uid, ids = t.column("uid").to_numpy(), t.column("ids").to_pylist()
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        r, s, low, high = survivors(uid[a], tuple(x[a] for x in held), [set(ids[i]) for i in b], tuple(x[b] for x in held), k)
        unit = np.full(len(r), int(exp.min()), np.int32)
        return pa.table({"query_id": pa.array(uid[a][r]), "uid": pa.array(uid[b][s]), "exp": pa.array(unit), "low": pa.array(low), "high": pa.array(high)}) if len(r) else None

    found = grouped_stream(left.unionByName(right), ["dim", "qb", "cb"], search, "query_id long, uid long, exp int, low double, high double")

    def overall(t: pa.Table) -> pa.Table:
        # bounds of different blocks in one unit; powers of two, so nothing is rounded but what vanishes
        exp = t.column("exp").to_numpy()
        low, high = (np.ldexp(t.column(x).to_numpy(), exp.min() - exp) for x in ("low", "high"))
        bound = np.partition(high, k - 1)[k - 1] if len(high) >= k else np.inf
        return t.select(["query_id", "uid"]).filter(pa.array(low <= bound))

    best = grouped_stream(found, ["query_id"], overall, "query_id long, uid long")
    pairs = best.join(c.select("uid", "ids", F.col("v").alias("b")), "uid").join(q.select(F.col("uid").alias("query_id"), F.col("v").alias("a")), "query_id")

    def merge(t: pa.Table) -> pa.Table | None:
        score = distances(matrix(t.column("a")), matrix(t.column("b")))
        own = t.column("query_id")[0].as_py()
        rows = heapq.nsmallest(k, ((s, i) for s, ids in zip(score.tolist(), t.column("ids").to_pylist(), strict=True) for i in ids if i != own))
        if not rows:
            return None
        s, v = zip(*rows, strict=True)
        n = len(rows)
        return pa.table({"query_id": pa.array(t.column("query_id").to_pylist()[:1] * n, pa.int64()), "rank": pa.array(range(1, n + 1), pa.int32()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.float64())})

    return grouped_stream(pairs, ["query_id"], merge, "query_id long, rank int, vec_id long, score double")
