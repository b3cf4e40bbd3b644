"""Operator 10: embedding near-duplicates through a robust-pruned flat graph.

Equal vectors are one vertex with a weight. Centroids are fitted on a bounded sample (SAMPLE rows);
every vector then gets its nearest cluster as home and the second nearest as overlap. In each shard
(a cluster, or a slice of one that is too large for a task) a robust-pruned graph is built over home
and overlap members; the two adjacency lists of a vector are united. Every vector then searches the
shards of its `probes` nearest clusters: a greedy beam search from the shard's medoid, then a range
expansion that follows every neighbour over the threshold less a slack. The graph is entered at the
medoid, at one node of each large group and of each part that no entry leads to, and at the vector itself where it is a
member. Hits are verified by cosine
in double precision and counted only in the hit's home shard, so nothing counts twice and no list of
pairs is made: a shard returns one row a vertex, its number of links and a local component.

Recall is audited at every size, twice. In each shard up to SHARD_AUDIT queries are compared with its
home members exactly; where the graph has missed more than the target allows, the whole shard is
compared exactly, in blocks. Then up to AUDIT vertices are compared with all vectors; where the search
has found less than `recall` of their links, on average of the vertices of any group size, it is repeated with twice the probes and a wider beam, and
where all clusters are probed already, all vectors are compared exactly, in blocks.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do
vectors of different lengths; they are their own component. Vectors of any finite size are compared.
Repeated rows and equal vectors under other ids are linked; an empty table gives no rows. Null ids are left out. Other columns, labels included, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, grouped_stream, written
from .nearest import matrix, power_of_two, usable

THRESHOLD = 0.9
#: Rows that the centroids are fitted on, at most.
SAMPLE = 20_000
#: Vectors a cluster should have; more clusters than MAX_CLUSTERS are never made, shards are sliced.
PER_CLUSTER, MAX_CLUSTERS = 1000, 2000
#: Members of a shard at most, on average.
SHARD = 4000
DEGREE = 24
ALPHA = 1.2
BEAM = 24
#: The range expansion follows nodes down to the threshold less this.
SLACK = 0.05
PROBES = 4
AUDIT = 1000
#: Vertices of so many links at least (and fewer than the next) are audited together.
SIZES = np.array([1, 3, 10, 100, 1000])
SHARD_AUDIT = 1024


def fit_centroids(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 2048] @ c.T).argmax(axis=1) for i in range(0, len(x), 2048)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), c)
    return c.astype(np.float32)


def kept_of(x: np.ndarray, c: np.ndarray, sim: np.ndarray, degree: int, alpha: float) -> list[int]:
    """The rows that robust pruning keeps of candidates c, sorted by their similarity to the row."""
    dist = np.sqrt(np.maximum(0, 2 - 2 * sim))
    alive, kept = np.ones(len(c), bool), []
    for i in range(len(c)):
        if not alive[i] and len(kept) >= 4:
            continue
        kept.append(int(c[i]))
        if len(kept) >= degree:
            break
        alive &= ~(alpha * np.sqrt(np.maximum(0, 2 - 2 * (x[c] @ x[c[i]]))) <= dist)
    return kept


def prune(x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA, pool: int = 96) -> list[np.ndarray]:
    """Robust-pruned neighbours of each row: the nearest four, then each next one that no kept
    neighbour covers (alpha times nearer to it than the row itself is), and reverse edges; where these
    are more than `degree`, they are pruned by the same rule."""
    n = len(x)
    pool = min(pool, n - 1)
    if pool < 1:
        return [np.zeros(0, np.int64)] * n
    out: list[list[int]] = []
    for at in range(0, n, 512):
        sim = x[at : at + 512] @ x.T
        sim[np.arange(len(sim)), np.arange(at, at + len(sim))] = -2
        near = np.argpartition(-sim, pool - 1, axis=1)[:, :pool]
        for r in range(len(sim)):
            c = near[r][np.argsort(-sim[r][near[r]], kind="stable")]
            out.append(kept_of(x, c, sim[r][c], degree, alpha))
    back: list[list[int]] = [[] for _ in range(n)]
    for i, kept in enumerate(out):
        for j in kept:
            back[j].append(i)
    for j, from_ in enumerate(back):
        if len(from_) > degree:
            c = np.array(from_)
            sim = x[c] @ x[j]
            c, sim = c[(o := np.argsort(-sim, kind="stable"))], sim[o]
            back[j] = kept_of(x, c, sim, degree, alpha)
    return [np.unique(np.array(a + b, np.int64)) for a, b in zip(out, back, strict=True)]


def entries(x: np.ndarray, graph: np.ndarray, low: float) -> np.ndarray:
    """The medoid, a node of each group (joined by edges of similarity >= low) that a beam may not get
    into or out of, and a node of each part of the graph that no earlier entry leads to."""
    a, k = np.nonzero(graph >= 0)
    b = graph[a, k]
    near = np.concatenate([np.einsum("ij,ij->i", x[a[i : i + (1 << 16)]], x[b[i : i + (1 << 16)]]) for i in range(0, len(a), 1 << 16)] or [np.zeros(0)]) >= low
    group = np.bincount(local_roots(a[near], b[near], len(x)), minlength=len(x))
    wait = np.flatnonzero(group > DEGREE).tolist()
    reached, out, new = np.zeros(len(x), bool), [], int((x @ x.mean(axis=0)).argmax())
    while True:
        out.append(new)
        reached[new] = True
        edge = np.array([new])
        while len(edge):
            edge = np.unique(graph[edge])
            edge = edge[edge >= 0]
            edge = edge[~reached[edge]]
            reached[edge] = True
        if wait:
            new = wait.pop()
        elif reached.all():
            return np.unique(out)
        else:
            new = int(reached.argmin())


def range_search(x: np.ndarray, graph: np.ndarray, q: np.ndarray, threshold: float, beam: int, starts: np.ndarray | None = None, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) pairs of similarity >= threshold found by greedy search and range expansion.

    graph: neighbours padded with -1. starts: its entries. own: a query's own node or -1. All queries
    advance together, one hop at a time.
    """
    n, m = len(x), len(q)
    starts = entries(x, graph, threshold - SLACK) if starts is None else starts
    seen = np.zeros((m, n), bool)
    seen[:, starts] = True
    sims = np.full((m, n), -2, np.float32)
    sims[:, starts] = q @ x[starts].T
    if own is not None:
        at = np.flatnonzero(own >= 0)
        seen[at, own[at]] = True
        sims[at, own[at]] = np.einsum("ij,ij->i", q[at], x[own[at]])
    ids = np.full((m, beam), -1, np.int64)
    val = np.full((m, beam), -3, np.float32)
    done = np.zeros((m, beam), bool)
    # the beam begins with the best entries; the expansion below starts from all of them
    first = np.concatenate([np.tile(starts, (m, 1)), np.full((m, 1), -1) if own is None else own[:, None]], axis=1)
    first[:, -1] = np.where((first[:, :-1] == first[:, -1:]).any(axis=1), -1, first[:, -1])
    worth = np.where(first >= 0, sims[np.arange(m)[:, None], first], -3)
    top = np.argsort(-worth, axis=1, kind="stable")[:, :beam]
    ids[:, : top.shape[1]], val[:, : top.shape[1]] = np.take_along_axis(first, top, 1), np.take_along_axis(worth, top, 1)
    live = np.arange(m)
    while len(live):
        open_ = np.where(done[live] | (ids[live] < 0), -9, val[live])
        pick = open_.argmax(axis=1)
        going = open_[np.arange(len(live)), pick] > -9
        live, pick = live[going], pick[going]
        if not len(live):
            break
        node = ids[live, pick]
        done[live, pick] = True
        nb = graph[node]
        fresh = (nb >= 0) & ~seen[live[:, None], nb]
        rows, cols = np.nonzero(fresh)
        hit, at = nb[rows, cols], live[rows]
        new = np.full(nb.shape, -3, np.float32)
        s = np.einsum("ij,ij->i", x[hit], q[at])
        new[rows, cols] = s
        sims[at, hit] = s
        seen[at, hit] = True
        all_val = np.concatenate([val[live], new], axis=1)
        all_ids = np.concatenate([ids[live], np.where(fresh, nb, -1)], axis=1)
        all_done = np.concatenate([done[live], np.zeros(nb.shape, bool)], axis=1)
        top = np.argpartition(-all_val, beam - 1, axis=1)[:, :beam]
        take = np.arange(len(live))[:, None]
        val[live], ids[live], done[live] = all_val[take, top], all_ids[take, top], all_done[take, top]
    low = threshold - SLACK
    spread = np.zeros((m, n), bool)
    while True:
        rows, nodes = np.nonzero((sims >= low) & ~spread)
        if not len(rows):
            break
        spread[rows, nodes] = True
        for i in range(0, len(rows), 1 << 17):
            r, nb = rows[i : i + (1 << 17)], graph[nodes[i : i + (1 << 17)]]
            a, b = np.nonzero((nb >= 0) & ~seen[r[:, None], nb])
            key = np.unique(r[a] * n + nb[a, b])
            qa, hit = key // n, key % n
            sims[qa, hit] = np.einsum("ij,ij->i", x[hit], q[qa])
            seen[qa, hit] = True
    return np.nonzero(sims >= threshold - 1e-4)


def local_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest index of each node's component under edges a, b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def near_duplicates(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, recall: float = 0.97, sample: int = SAMPLE, probes: int = PROBES) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null")
    # times a power of two, which leaves the cosine as it is and keeps lengths from overflowing or vanishing
    rows = rows.withColumn("v", F.when(usable("v"), F.col("v"))).withColumn("e", power_of_two(F.col("v")))
    rows = rows.select("id", F.transform("v", lambda x: x * F.pow(F.lit(2.0), F.col("e").cast("double")) + F.lit(0.0)).alias("v"))
    vert = written(rows.where("v is not null").groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("w")).withColumn("dim", F.size("v")), "vertices")
    count, links, comp = vert.count(), None, None
    if count:
        clusters = max(1, min(MAX_CLUSTERS, math.ceil(count / PER_CLUSTER)))
        centroids = {}
        # a bounded sample fits the centroids; every vector is indexed all the same
        picked = vert.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toPandas()["v"]
        for d in {len(v) for v in picked}:
            x = np.array([v for v in picked if len(v) == d])
            centroids[d] = fit_centroids(x / np.linalg.norm(x, axis=1, keepdims=True), clusters)
        beam = BEAM
        while True:
            found = written(search(vert, centroids, threshold, probes, beam, recall), "found")
            if audit(vert, found, threshold) >= recall:
                break
            if probes >= clusters:
                found = written(compare_all(vert, count, threshold), "found")
                break
            probes, beam = probes * 2, beam * 2
        links = found.where("n > 0").groupBy("id").agg(F.sum("n").alias("n"))
        comp = components(found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    out = rows.join(vert.select("v", F.col("id").alias("vertex"), "w"), "v", "left")
    if links is not None:
        out = out.join(links.select(F.col("id").alias("vertex"), "n"), "vertex", "left").join(comp.select(F.col("id").alias("vertex"), "component"), "vertex", "left")
    else:
        out = out.withColumn("n", F.lit(0)).withColumn("component", F.lit(None).cast("long"))
    whole = F.coalesce("component", "vertex", "id")
    return out.select(F.col("id").alias(key), (F.coalesce("n", F.lit(0)) + F.coalesce(F.col("w") - 1, F.lit(0))).cast("long").alias("n_links"), whole.alias("component_id"), (F.col("id") == whole).alias("kept"))


def recalls(true: np.ndarray, got: np.ndarray) -> dict[int, float]:
    """Mean share of a vertex's true links that were found, by group size (SIZES); vertices without links aside."""
    size = np.searchsorted(SIZES, true, side="right")
    share = np.minimum(got, true) / np.maximum(true, 1)
    return {int(SIZES[k - 1]): float(share[size == k].mean()) for k in np.unique(size[size > 0])}


def recall_of(true: np.ndarray, got: np.ndarray) -> float:
    """The recall of the group size where it is least; 1 where there are no links."""
    return min(recalls(true, got).values(), default=1.0)


def block_search(x: np.ndarray, q: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """All (query, node) pairs of similarity >= threshold, but for rounding."""
    return np.nonzero(q @ x.T >= threshold - 1e-4)


def shard_links(t: pa.Table, threshold: float, beam: int, recall: float | None) -> pa.Table | None:
    """Links of the queries of a shard with its home members: by its graph as far as that meets the recall, else (and for recall None) by blocks.

    Roles: 0 home, 1 overlap, 2 only asks, -1 home and doesn't ask.
    """
    role, ids, w = (t.column(c).to_numpy() for c in ("role", "id", "w"))
    x = matrix(t.column("v"))
    norm = np.linalg.norm(x, axis=1)
    unit = (x / norm[:, None]).astype(np.float32)
    nodes = np.flatnonzero(role < 2)
    if not len(nodes):
        return None
    home, asks = np.flatnonzero(role <= 0), np.flatnonzero(role >= 0)
    order = np.argsort(ids, kind="stable")  # so that the smallest index is the smallest id
    back = np.empty_like(order)
    back[order] = np.arange(len(ids))

    def run(find, members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(weight of links, number of links of a query, root by rank of the id)."""
        step = max(64, min(1024, (1 << 24) // max(1, len(members))))
        n, links, root = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), np.arange(len(ids))
        for at in range(0, len(asks), step):
            part = asks[at : at + step]
            q, hit = find(part)
            q, hit = part[q], members[hit]
            keep = (role[hit] <= 0) & (ids[q] != ids[hit])
            q, hit = q[keep], hit[keep]
            for i in range(0, len(q), 1 << 16):
                a, b = q[i : i + (1 << 16)], hit[i : i + (1 << 16)]
                ok = np.einsum("ij,ij->i", x[a], x[b]) / (norm[a] * norm[b]) >= threshold
                a, b = a[ok], b[ok]
                np.add.at(n, a, w[b])
                np.add.at(links, a, 1)
                # pairs are folded into the roots at once: no list of them is kept
                root = local_roots(np.concatenate([back[a], np.arange(len(ids))]), np.concatenate([back[b], root]), len(ids))
        return n, links, root

    short = recall is None
    if not short:
        place = {int(i): p for p, i in enumerate(ids[nodes])}
        near = t.column("near").to_pylist()
        lists = [[place[j] for j in near[r] if j in place] for r in nodes]
        g = np.full((len(nodes), max(1, max(map(len, lists)))), -1, np.int64)
        for r, list_ in enumerate(lists):
            g[r, : len(list_)] = list_
        inside, own_node = unit[nodes], np.full(len(ids), -1, np.int64)
        own_node[nodes] = np.arange(len(nodes))
        starts = entries(inside, g, threshold - SLACK)
        n, links, root = run(lambda q: range_search(inside, g, unit[q], threshold, beam, starts, own_node[q]), nodes)
        picked = np.random.default_rng(len(ids)).permutation(len(ids))[:SHARD_AUDIT]
        true = np.zeros(len(picked), np.int64)
        for at in range(0, len(picked), 256):
            p = picked[at : at + 256]
            cos = (x[p] @ x[home].T) / (norm[p][:, None] * norm[home][None, :])
            true[at : at + 256] = ((cos >= threshold) & (ids[p][:, None] != ids[home][None, :])).sum(axis=1)
        short = recall_of(true, links[picked]) < recall
    if short:
        own = unit[home]
        n, links, root = run(lambda q: block_search(own, unit[q], threshold), home)
    member = ids[order][root][back]
    show = np.flatnonzero((n > 0) | (np.bincount(root, minlength=len(ids))[root[back]] > 1))
    return pa.table({"id": pa.array(ids[show]), "root": pa.array(member[show]), "n": pa.array(n[show])}) if len(show) else None


def compare_all(vert: DataFrame, count: int, threshold: float) -> DataFrame:
    """As search(), of all vertices with all: a task compares a block of vertices with another, or itself."""
    blocks = math.ceil(count / SHARD)
    rows = vert.select("dim", "id", "w", "v", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("own")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    held = rows.select("dim", F.col("own").alias("slice"), F.col("other").alias("block"), F.when(F.col("own") == F.col("other"), 0).otherwise(-1).alias("role"), "id", "w", "v")
    asked = rows.where("own <> other").select("dim", F.col("other").alias("slice"), F.col("own").alias("block"), F.lit(2).alias("role"), "id", "w", "v")
    return grouped_stream(held.unionByName(asked), ["dim", "slice", "block"], lambda t: shard_links(t, threshold, 0, None), "id long, root long, n long")


def search(vert: DataFrame, centroids: dict[int, np.ndarray], threshold: float, probes: int, beam: int, recall: float) -> DataFrame:
    """(id, root, n): a vertex, its smallest partner within a shard, its links' weight in that shard."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, w, dims = (batch.column(c).to_numpy() for c in ("id", "w", "dim"))
            for d in np.unique(dims):
                sel = np.flatnonzero(dims == d)
                x = matrix(batch.column("v").take(pa.array(sel)))
                unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
                c = centroids.get(int(d), unit[:1])
                p = min(probes, len(c))
                for at in range(0, len(sel), 2048):
                    part = slice(at, at + 2048)
                    order = np.argsort(-(unit[part] @ c.T), axis=1, kind="stable")[:, :p]
                    k = order.size
                    rep = np.repeat(np.arange(len(order)), p)
                    yield pa.RecordBatch.from_arrays([pa.array(order.ravel().astype("i4")), pa.array(np.tile(np.arange(p), len(order)).astype("i4")), pa.array(ids[sel][part][rep]), pa.array(w[sel][part][rep]), pa.array(np.full(k, d, "i4")), pa.FixedSizeListArray.from_arrays(pa.array(x[part][rep].ravel()), int(d)).cast(pa.list_(pa.float64()))], ["cluster", "rank", "id", "w", "dim", "v"])

    routed = written(vert.select("id", "w", "dim", "v").mapInArrow(route, "cluster int, rank int, id long, w long, dim int, v array<double>"), "routed")
    # slices of clusters that are too large for one task: every query of the cluster visits each slice
    sizes = routed.where("rank < 2").groupBy("dim", "cluster").agg(F.ceil(F.count(F.lit(1)) / F.lit(SHARD)).cast("int").alias("slices"))
    members = routed.join(sizes, ["dim", "cluster"])
    own = members.where("rank < 2").withColumn("slice", F.pmod(F.xxhash64("id"), "slices").cast("int"))

    def build(t: pa.Table) -> pa.Table:
        x = matrix(t.column("v"))
        ids = t.column("id").to_numpy()
        lists = prune((x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32))
        return pa.table({"id": pa.array(ids), "near": pa.array([ids[a].tolist() for a in lists], pa.list_(pa.int64()))})

    parts = grouped_stream(own.select("dim", "cluster", "slice", "id", "v"), ["dim", "cluster", "slice"], build, "id long, near array<long>")
    graph = written(parts.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "graph")
    asked = members.withColumn("own_slice", F.pmod(F.xxhash64("id"), "slices").cast("int")).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    asked = asked.withColumn("role", F.when((F.col("rank") < 2) & (F.col("slice") == F.col("own_slice")), F.col("rank")).otherwise(2)).join(graph, "id").select("dim", "cluster", "slice", "role", "id", "w", "v", F.when(F.col("role") < 2, F.col("near")).alias("near"))

    return grouped_stream(asked, ["dim", "cluster", "slice"], lambda t: shard_links(t, threshold, beam, recall), "id long, root long, n long")


def audit(vert: DataFrame, found: DataFrame, threshold: float, sample: int = AUDIT) -> float:
    """recall_of() of up to `sample` vertices, drawn without regard to what was found, by brute force."""
    picked = vert.orderBy(F.xxhash64("id", F.lit("audit")), "id").limit(sample).select("id", "v", "dim").toPandas()
    q_id, vs = picked["id"].to_numpy(np.int64), list(picked["v"])
    by_dim = {d: ([i for i, v in enumerate(vs) if len(v) == d]) for d in {len(v) for v in vs}}
    held = {d: (q_id[i], np.array([vs[j] for j in i], float)) for d, i in by_dim.items()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, w, dims = (batch.column(c).to_numpy() for c in ("id", "w", "dim"))
            for d in np.unique(dims):
                if int(d) not in held:
                    continue
                sel = np.flatnonzero(dims == d)
                x = matrix(batch.column("v").take(pa.array(sel)))
                qi, q = held[int(d)]
                cos = (q @ x.T) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :])
                n = ((cos >= threshold) & (qi[:, None] != ids[sel][None, :])) @ w[sel]
                yield pa.RecordBatch.from_arrays([pa.array(qi), pa.array(n.astype(np.int64))], ["id", "true"])

    true = vert.select("id", "w", "dim", "v").mapInArrow(count, "id long, true long").groupBy("id").agg(F.sum("true").alias("true"))
    got = found.groupBy("id").agg(F.sum("n").alias("n"))
    rows = true.join(got, "id", "left").select("true", F.coalesce("n", F.lit(0)).alias("n")).toPandas()
    return recall_of(rows["true"].to_numpy(np.int64), rows["n"].to_numpy(np.int64))
