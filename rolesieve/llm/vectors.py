"""Near-duplicate vectors through a flat, robustly pruned neighbour graph.

Centroids are fitted on a bounded sample; every vector joins the shards of its nearest few, so
shards overlap. Each shard builds the pruned graph of its members in a task; the adjacency lists of
a vector from all its shards are united. Then each vector is searched for in its nearest shard: a
greedy walk from the shard's medoids and from itself, which goes on from everything in range until
nothing new is in range. Links are verified in double precision. An audit compares a bounded set of
vectors with all others, in blocks, and widens shards and walks if too little was found. If that is
still too little, as when a dense group spans more shards than a vector joins, all vectors are
compared with all, a bounded chunk of them at a time; a result below LEAST_RECALL is never returned.

Equal vectors are one node with a count, so copies cost nothing. A search reports a count for each
node, and of its links only those that join what was not joined, so output grows with the vectors
however dense a group is.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolesieve.llm.common import n_partitions, stored
from rolesieve.llm.components import components
from rolesieve.llm.simhash import Forest

COSINE, SLACK = 0.95, 0.03
#: Vectors of a shard before overlap, centroids at most, and vectors they are fitted on at most.
SHARD, MAX_CENTROIDS, SAMPLE_ROWS = 1500, 4096, 40_000
#: Shards of a vector, width of the walk; both double when the audit finds less than LEAST_RECALL.
OVERLAP, BEAM, LEAST_RECALL, TRIES = 4, 24, 0.9, 3
POOL, DEGREE, ALPHA, MEDOIDS = 64, 24, 1.2, 16
#: The audit compares all vectors whose id this divides with all others.
EVERY = 100
BLOCK = 256
#: Numbers of the vectors that are compared with all others at a time.
CHUNK = 1 << 21


def centroids(x: np.ndarray, k: int, seed: int = 0, rounds: int = 8) -> np.ndarray:
    """Spherical k-means of unit vectors."""
    c = x[np.random.default_rng(seed).permutation(len(x))[:k]]
    for _ in range(rounds):
        at = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.maximum(norm, 1e-12), c)
    return c


def pruned_graph(x: np.ndarray, seed: int = 0) -> list[np.ndarray]:
    """Neighbours of each row of ``x`` (unit vectors): from its nearest POOL rows and a few random
    ones, nearest first, those that no chosen neighbour is ALPHA times nearer to; and back links."""
    n = len(x)
    pool, rng = min(POOL, n - 1), np.random.default_rng(seed)
    if pool < 1:
        return [np.zeros(0, np.int64) for _ in range(n)]
    chosen = []
    for s in range(0, n, BLOCK):
        own = np.arange(s, min(n, s + BLOCK))
        sim = x[own] @ x.T
        sim[np.arange(len(own)), own] = -2
        near = np.argpartition(-sim, pool - 1, axis=1)[:, :pool]
        near = np.concatenate([near, rng.integers(0, n, (len(own), 8))], axis=1)
        d = 1 - np.take_along_axis(sim, near, axis=1)
        order = np.argsort(d, axis=1)
        near, d = np.take_along_axis(near, order, axis=1), np.take_along_axis(d, order, axis=1)
        live = (near != own[:, None]) & np.concatenate([np.ones((len(own), 1), bool), near[:, 1:] != near[:, :-1]], axis=1)
        between = 1 - np.einsum("bid,bjd->bij", x[near], x[near], optimize=True)
        picked, row = np.zeros_like(live), np.arange(len(own))
        for _ in range(DEGREE):
            best = live.argmax(axis=1)
            some = live[row, best]
            picked[row[some], best[some]] = True
            live &= ~((ALPHA * between[row, best] <= d) & some[:, None])
            live[row, best] = False
        chosen += [near[i][picked[i]] for i in range(len(own))]
    a = np.repeat(np.arange(n), [len(c) for c in chosen])
    b = np.concatenate(chosen)
    order = np.argsort(b, kind="stable")
    back = np.split(a[order], np.cumsum(np.bincount(b, minlength=n))[:-1])
    return [np.union1d(c, r) for c, r in zip(chosen, back)]


def range_search(x: np.ndarray, adjacency: list[np.ndarray], queries: np.ndarray, beam: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query row, row) for rows in range with slack, walking the graph from medoids and the query."""
    n = len(x)
    degree = np.array([len(a) for a in adjacency])
    flat, base = np.concatenate(adjacency).astype(np.int64), np.cumsum(degree) - degree
    tops = centroids(x, min(MEDOIDS, n), rounds=3)
    starts = np.unique((tops @ x.T).argmax(axis=1))
    for s in range(0, len(queries), BLOCK):
        q = queries[s:s + BLOCK]
        seen = np.zeros((len(q), n), bool)

        def visit(b, node):
            keep = ~seen[b, node]
            key = np.unique(b[keep] * n + node[keep])
            b, node = key // n, key % n
            seen[b, node] = True
            return b, node, np.einsum("ij,ij->i", x[q[b]], x[node])

        def expand(b, node):
            size = degree[node]
            ends = np.cumsum(size)
            return visit(np.repeat(b, size), flat[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size - base[node], size)])

        rows = np.arange(len(q))
        first = [np.r_[a, c] for a, c in zip((rows, q), (np.repeat(rows, len(starts)), np.tile(starts, len(q))))]
        b, node, sim = visit(*first)
        done = np.zeros(len(b), bool)
        everything = [(b, node, sim)]
        while not done.all():
            fresh = np.flatnonzero(~done)
            fresh = fresh[_rank(b[fresh], sim[fresh]) < 4]  # the best few of each query go on
            done[fresh] = True
            more = expand(b[fresh], node[fresh])
            everything.append(more)
            b, node, sim, done = (np.r_[old, new] for old, new in zip((b, node, sim, done), (*more, np.zeros(len(more[0]), bool))))
            keep = _rank(b, sim) < beam
            b, node, sim, done = b[keep], node[keep], sim[keep], done[keep]
        b, node, sim = (np.concatenate(c) for c in zip(*everything))
        near = sim >= COSINE - SLACK
        found = [(b[near], node[near])]
        while len(found[-1][0]):
            b, node, sim = expand(*found[-1])
            near = sim >= COSINE - SLACK
            found.append((b[near], node[near]))
        b, node = (np.concatenate(c) for c in zip(*found))
        other = node != q[b]
        yield q[b[other]], node[other]


def _rank(group: np.ndarray, sim: np.ndarray) -> np.ndarray:
    """Place of each element in its group, the largest first."""
    order = np.lexsort((-sim, group))
    g = group[order]
    start = np.maximum.accumulate(np.where(np.r_[True, g[1:] != g[:-1]], np.arange(len(g)), 0)) if len(g) else g
    rank = np.empty(len(g), np.int64)
    rank[order] = np.arange(len(g)) - start
    return rank


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _verified(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x[a], x[b]) >= COSINE


def _build(table: pa.Table) -> pa.Table:
    nodes = table["node"].to_numpy()
    graph = pruned_graph(_unit(_matrix(table["v"])).astype(np.float32))
    return pa.table({"node": pa.array(nodes, pa.int64()), "near": pa.array([nodes[g] for g in graph], pa.list_(pa.int64()))})


def _search(beam: int):
    def search(table: pa.Table) -> pa.Table:
        nodes, copies = table["node"].to_numpy(), table["copies"].to_numpy()
        x = _unit(_matrix(table["v"]))
        order = np.argsort(nodes)
        near = []
        for a in table["near"].to_pylist():  # neighbours outside this shard lead nowhere here
            at = order[np.minimum(np.searchsorted(nodes, a or [], sorter=order), len(nodes) - 1)]
            near.append(at[nodes[at] == np.array(a or [], np.int64)])
        home = np.flatnonzero(table["home"].to_numpy(zero_copy_only=False))
        links, forest = np.zeros(len(nodes), np.int64), Forest(len(nodes))
        for q, p in range_search(x.astype(np.float32), near, home, beam):
            for s in range(0, len(q), 1 << 16):
                a, b = q[s:s + (1 << 16)], p[s:s + (1 << 16)]
                ok = _verified(x, a, b)
                np.add.at(links, a[ok], copies[b[ok]])
                forest.add(a[ok], b[ok])
        a, b = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (forest.a, forest.b))
        return pa.table({
            "node": pa.array(np.r_[nodes[home], nodes[a]], pa.int64()),
            "links": pa.array([*links[home].tolist(), *[None] * len(a)], pa.int64()),
            "other": pa.array([*[None] * len(home), *nodes[b].tolist()], pa.int64())})

    return search


def near_duplicates(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, Audit]:
    """One row per input row: __row (the row as a struct), n_links (other vectors found with a cosine
    of COSINE or more), component_id (smallest id that links reach); and the audit, whose recall is
    None where no audited vector has a link.

    A vector that is null or zero, or holds a null or a number that is not finite, links with
    nothing, its component is its own id. So does a vector of another length than the commonest one,
    but for its exact copies. Repeated rows are copies of each other. A null id is passed over as
    long as the component has another. An empty table gives an empty one.
    """
    spark = table.sparkSession
    vector = F.transform(embedding, lambda x: x.cast("double"))
    valid = F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0), F.lit(False))
    rows = stored(table.select(F.struct(*(c for c in table.columns if c != embedding)).alias("__row"), F.col(vec_id).alias("id"), F.when(valid, vector).alias("v")))
    same = rows.where("v is not null").groupBy("v").agg(F.min("id").alias("low"), F.count("*").alias("copies"))
    unique = stored(same.withColumn("node", F.monotonically_increasing_id()))
    sizes = unique.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").head()
    checked, links, edges = Audit(0, 0), None, None
    if sizes:
        used, n = unique.where(F.size("v") == sizes["d"]), sizes["count"]
        overlap, beam = OVERLAP, BEAM
        for _ in range(TRIES):
            result = stored(_linked(used, n, overlap, beam))
            links = result.where("links is not null").select("node", "links")
            checked = audit(used, links, sizes["d"])
            if checked.good:
                break
            overlap, beam = 2 * overlap, 2 * beam
        else:
            result = exact(used, n, sizes["d"])
            links = result.where("links is not null").select("node", "links")
            if not (checked := audit(used, links, sizes["d"])).good:
                raise RuntimeError(f"links found: {checked.found} of {checked.links} of the audit")
        edges = result.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))
    links = links if links is not None else spark.createDataFrame([], "node long, links long")
    edges = edges if edges is not None else spark.createDataFrame([], "a long, b long")
    found = components(edges)
    placed = unique.join(links, "node", "left").join(found, "node", "left").select(
        "v", "low", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("root"))
    lowest = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    by_vector = placed.join(lowest, "root").select("v", "n_links", "component_id")
    out = rows.join(by_vector, "v", "left").select("__row", F.coalesce("n_links", F.lit(0)).alias("n_links"),
                                                   F.when(F.col("v").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    return out, checked


def _linked(used: DataFrame, n: int, overlap: int, beam: int) -> DataFrame:
    spark = used.sparkSession
    k = min(MAX_CENTROIDS, max(1, n // SHARD))
    sample = used.orderBy(F.xxhash64("v")).select("v").limit(min(SAMPLE_ROWS, max(k * 50, 1000))).toArrow()
    tops = centroids(_unit(_matrix(sample["v"])), k).astype(np.float32)
    width = min(overlap, len(tops))

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            sim = _unit(_matrix(batch.column("v"))).astype(np.float32) @ tops.T
            at = np.argsort(-sim, axis=1, kind="stable")[:, :width]
            take = np.repeat(np.arange(len(at)), width)
            wide = batch.take(pa.array(take))
            yield pa.RecordBatch.from_arrays(
                [*wide.columns, pa.array(at.ravel(), pa.int64()), pa.array(np.tile(np.arange(width) == 0, len(at)))],
                names=["node", "copies", "v", "shard", "home"])

    members = stored(used.select("node", "copies", "v").mapInArrow(shards, "node long, copies long, v array<double>, shard long, home boolean"))
    parts = n_partitions(spark, k, 1)
    graph = members.select("shard", "node", "v").repartition(parts, "shard").groupBy("shard").applyInArrow(_build, "node long, near array<long>")
    united = graph.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))  # a list per shard of the node
    return members.join(united, "node").repartition(parts, "shard").groupBy("shard").applyInArrow(_search(beam), "node long, links long, other long")


def exact(used: DataFrame, n: int, width: int) -> DataFrame:
    """As the search, by comparing all with all: a chunk of the nodes goes to every task at a time."""
    chunks = -(-n * width // CHUNK)
    spread = stored(used.select("node", "copies", "v").repartition(n_partitions(used.sparkSession, n, 5000)))
    mine = F.pmod(F.xxhash64("node"), F.lit(chunks))
    return reduce(DataFrame.unionByName, (stored(_against(spread, spread.where(mine == c).select("node", "v").toArrow())) for c in range(chunks)))


def _against(rows: DataFrame, chunk: pa.Table) -> DataFrame:
    ids, probes = chunk["node"].to_numpy(), _unit(_matrix(chunk["v"])) if len(chunk) else np.zeros((0, 1))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, forest, a, b = np.zeros(len(ids), np.int64), Forest(len(ids)), [], []
        places = np.arange(len(ids))
        for batch in batches:
            for s in range(0, len(batch) if len(ids) else 0, BLOCK):
                part = batch.slice(s, BLOCK)
                nodes = part.column("node").to_numpy()
                hit = _unit(_matrix(part.column("v"))) @ probes.T >= COSINE
                hit &= nodes[:, None] != ids
                total += part.column("copies").to_numpy() @ hit
                some = hit.any(axis=1)
                hit, first = hit[some], hit[some].argmax(axis=1)
                a.append(nodes[some])
                b.append(ids[first])
                for row, at in zip(hit, first):  # a row joins all that it hits
                    other = places[row]
                    forest.add(np.full(len(other), at), other)
        x, y = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (forest.a, forest.b))
        x, y = np.concatenate([ids[x], *a]), np.concatenate([ids[y], *b])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[ids, x], pa.int64()), pa.array([*total.tolist(), *[None] * len(x)], pa.int64()), pa.array([*[None] * len(ids), *y.tolist()], pa.int64())],
            names=["node", "links", "other"])

    found = stored(rows.mapInArrow(compare, "node long, links long, other long"))  # split below
    return found.where("other is null").groupBy("node").agg(F.sum("links").alias("links"), F.first("other").alias("other")).unionByName(
        found.where("other is not null").distinct())


class Audit(NamedTuple):
    """True links of the audited vectors, and how many of them were found."""

    links: int
    found: int

    @property
    def recall(self) -> float | None:
        """None where the audited vectors have no link, so that nothing was measured."""
        return self.found / self.links if self.links else None

    @property
    def good(self) -> bool:
        return self.found >= LEAST_RECALL * self.links


def audit(used: DataFrame, links: DataFrame, width: int, every: int = EVERY) -> Audit:
    """Links of all vectors whose id ``every`` divides, counted against all vectors, a chunk of them at
    a time. Found links have been verified and count each partner once, so no count can hide a miss."""
    picked = used.where(F.col("low").try_cast("long") % every == 0).select("node", "v")
    spread, n = used.select("node", "copies", "v"), picked.count()
    total, found = 0, 0
    for c in range(chunks := -(-n * width // CHUNK)):
        probes = picked.where(F.pmod(F.xxhash64("node"), F.lit(chunks)) == c).toArrow()
        row = _true_links(spread, probes).join(links, "node", "left").agg(F.sum("all"), F.sum(F.least("all", F.coalesce("links", F.lit(0))))).first()
        total, found = total + (row[0] or 0), found + (row[1] or 0)
    return Audit(total, found)


def _true_links(rows: DataFrame, picked: pa.Table) -> DataFrame:
    ids, probes = picked["node"].to_numpy(), _unit(_matrix(picked["v"])) if len(picked) else None

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            for s in range(0, len(batch) if len(ids) else 0, BLOCK):
                part = batch.slice(s, BLOCK)
                hit = _unit(_matrix(part.column("v"))) @ probes.T >= COSINE
                hit &= part.column("node").to_numpy()[:, None] != ids
                total += part.column("copies").to_numpy() @ hit
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total, pa.int64())], names=["node", "all"])

    return rows.mapInArrow(compare, "node long, all long").groupBy("node").agg(F.sum("all").alias("all"))
