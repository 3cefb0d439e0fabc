"""Approximate nearest neighbours by learned partitions.

A neighbour graph of a bounded sample is cut into balanced partitions; a
small classifier learns, for each sampled vector, how its neighbours spread
over the partitions, and routes: every row of the table goes to its most
probable partition, every query to its ``probes`` most probable ones, where
inner products with all rows are taken and the best are reranked exactly.

Rows and queries of a partition meet in blocks of bounded size, so a large
partition is many tasks.  Of equal vectors only the ``k`` + 1 with the
smallest ids can be among a query's ``k`` nearest; the others are left out
before any search, which is exact and takes the heat out of large groups of
equal vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigfolio.llm.common import cut_lineage, small_batches

#: Vectors that the partitions and the classifier are fitted on, at most.
MAX_SAMPLE = 4096
PARTITIONS = 16
PROBES = 12
NEIGHBOURS = 20
BLOCK = 4096
SALTS = 32


@dataclass
class Router:
    """Two layers: vector -> hidden (relu) -> log odds of the partitions."""

    dim: int
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def ranked(self, x: np.ndarray) -> np.ndarray:
        """Partitions of each vector, most probable first."""
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
        z = np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        return np.argsort(-z, axis=1, kind="stable")


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k largest inner products of each row, itself left out."""
    out = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), 1024):
        s = x[a:a + 1024] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a:a + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_cut(x: np.ndarray, graph: np.ndarray, parts: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """A part for each vertex: nearly equal sizes, few edges between parts.

    Starts from balanced clusters; then vertices move, largest gain first, to
    the part that holds most of their neighbours while it has room.
    """
    n = len(x)
    room = int(np.ceil(1.05 * n / parts))

    def place(gain: np.ndarray) -> np.ndarray:
        size, part = np.zeros(parts, np.int64), np.full(n, -1)
        for v in np.argsort(-(gain.max(axis=1) - np.median(gain, axis=1)), kind="stable"):
            order = np.argsort(-gain[v], kind="stable")
            p = order[np.argmax(size[order] < room)]
            part[v] = p
            size[p] += 1
        return part

    centre = x[rng.choice(n, parts, replace=False)]
    for _ in range(8):
        part = place(x @ centre.T)
        centre = np.stack([x[part == p].mean(axis=0) for p in range(parts)])
    source, target = np.repeat(np.arange(n), graph.shape[1]), graph.ravel()
    for _ in range(rounds):
        near = np.zeros((n, parts))
        np.add.at(near, (source, part[target]), 1.0)
        np.add.at(near, (target, part[source]), 1.0)
        near[np.arange(n), part] += 0.5
        part = place(near + 0.1 * (x @ centre.T))
    return part


def train_router(x: np.ndarray, target: np.ndarray, rng: np.random.Generator, hidden: int = 128, epochs: int = 40) -> Router:
    """Softmax cross entropy against the neighbours' spread, by Adam."""
    d, parts = x.shape[1], target.shape[1]
    par = [rng.normal(0, 1 / np.sqrt(d), (d, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), (hidden, parts)), np.zeros(parts)]
    m, v, t = [np.zeros_like(p) for p in par], [np.zeros_like(p) for p in par], 0
    scale = np.sqrt(d)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), 256):
            rows = order[a:a + 256]
            xb, yb = x[rows] * scale, target[rows]
            h = np.maximum(xb @ par[0] + par[1], 0)
            z = h @ par[2] + par[3]
            e = np.exp(z - z.max(axis=1, keepdims=True))
            dz = (e / e.sum(axis=1, keepdims=True) - yb) / len(rows)
            dh = (dz @ par[2].T) * (h > 0)
            grads = [xb.T @ dh + 1e-4 * par[0], dh.sum(axis=0), h.T @ dz + 1e-4 * par[2], dz.sum(axis=0)]
            t += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                par[k] -= 2e-3 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return Router(d, par[0] * scale, *par[1:])


def fit_router(x: np.ndarray, parts: int, neighbours: int, seed: int = 7) -> Router:
    """Graph, balanced cut and classifier from a sample of vectors."""
    rng = np.random.default_rng(seed)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
    if len(x) < 2 * parts:  # too few to learn from: one partition
        d = x.shape[1] if len(x) else 0
        return Router(d, np.zeros((d, 1)), np.zeros(1), np.zeros((1, parts)), np.zeros(parts))
    graph = neighbour_graph(unit, min(neighbours, len(x) - 1))
    part = balanced_cut(unit, graph, parts, rng)
    spread = np.zeros((len(x), parts))
    np.add.at(spread, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph].ravel()), 1.0)
    spread[np.arange(len(x)), part] += 0.25 * graph.shape[1]
    return train_router(unit, spread / spread.sum(axis=1, keepdims=True), rng)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v, a, b): vectors in double precision with two hashes;
    those that are NULL, empty, zero or hold NULL or a non-finite number, and
    rows without an id, are left out; repeated rows count once."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
            .filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0.0))
            .withColumn("a", F.xxhash64("v")).withColumn("b", F.xxhash64(F.lit(1), "v"))
            .dropDuplicates(["vec_id", "a", "b"]))


def first_of_equals(rows: DataFrame, keep: int) -> DataFrame:
    """Of equal vectors the ``keep`` with the smallest ids, ranked in salted
    parts first so that no task gets a whole group."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
    part = Window.partitionBy("a", "b", "salt").orderBy("vec_id")
    whole = Window.partitionBy("a", "b").orderBy("vec_id")
    some = salted.withColumn("n", F.row_number().over(part)).filter(F.col("n") <= keep)
    return some.withColumn("n", F.row_number().over(whole)).filter(F.col("n") <= keep).drop("n", "salt")


def to_matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.flatten() if not isinstance(flat, pa.ChunkedArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    return flat.to_numpy(zero_copy_only=False).reshape(-1, dim)


def search(vectors: DataFrame, is_query: Column, k: int = 20, partitions: int = PARTITIONS, probes: int = PROBES,
           max_sample: int = MAX_SAMPLE, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest found by
    inner product in double precision, nearest first, ties to the smaller id.

    ``is_query`` is a condition on ``vec_id``.  A query is not its own
    candidate.  Vectors of another length than the commonest of the sample
    form a partition for each length, searched whole.  An empty table, one
    without queries or with a single vector gives no rows; extra columns take
    no part.
    """
    spark = vectors.sparkSession
    small_batches(spark, 4096)
    rows = cut_lineage(usable(vectors, id_col, vector_col), "vectors")
    sample = [r["v"] for r in rows.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(max_sample).collect()]
    lengths = [len(v) for v in sample]
    dim = max(sorted(set(lengths)), key=lengths.count) if lengths else 1
    router = fit_router(np.array([v for v in sample if len(v) == dim], float).reshape(-1, dim), partitions, NEIGHBOURS)
    def route(n: int):
        def run(batches):
            for b in batches:  # the router, dim x 128 + 128 x partitions numbers, goes with the function
                v = b.column("v")
                size = v.value_lengths().to_numpy(zero_copy_only=False)
                fits = size == router.dim
                ranked = np.zeros((len(size), n), np.int64)
                if fits.any():
                    flat = v.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).reshape(-1, router.dim)
                    ranked[fits] = router.ranked(flat)[:, :n]
                out = [r.tolist() if f else [-int(s)] for r, f, s in zip(ranked, fits, size)]
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), v, pa.array(out, pa.list_(pa.int32()))], names=["vec_id", "v", "parts"])
        return run

    schema = "vec_id long, v array<double>, parts array<int>"
    base = first_of_equals(rows, k + 1).select("vec_id", "v").mapInArrow(route(1), schema).select("vec_id", "v", F.element_at("parts", 1).alias("part"))
    base = cut_lineage(base, "indexed")
    asked = (rows.filter(is_query).groupBy("vec_id").agg(F.min_by("v", F.struct("a", "b")).alias("v"))
             .mapInArrow(route(min(probes, partitions)), schema).select("vec_id", "v", F.explode("parts").alias("part")))
    asked = cut_lineage(asked, "queries")
    blocks = lambda df, name: df.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))
    # one row per partition: partitions and the lengths of vectors
    count = blocks(base, "n").join(blocks(asked, "m"), "part")
    spread = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    left = (base.join(count, "part").withColumn("i", spread("n")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
            .select("part", "i", "j", "vec_id", "v"))
    right = (asked.join(count, "part").withColumn("j", spread("m")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
             .select("part", "i", "j", F.col("vec_id").alias("query_id"), "v"))

    def nearest(x: pa.Table, q: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        out: list[list] = [[], [], []]
        if x.num_rows and q.num_rows:
            d = len(x.column("v")[0])
            ids, rows_x = x.column("vec_id").to_numpy(), to_matrix(x.column("v"), d)
            own, rows_q = q.column("query_id").to_numpy(), to_matrix(q.column("v"), d)
            for a in range(0, len(own), 256):
                s = rows_q[a:a + 256] @ rows_x.T
                s[own[a:a + 256, None] == ids[None, :]] = -np.inf
                for i, (t, exact) in enumerate(best_of(s, rows_x, rows_q[a:a + 256], ids, k)):
                    out[0] += [int(own[a + i])] * len(t)
                    out[1] += ids[t].tolist()
                    out[2] += exact.tolist()
        return pa.Table.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=names)

    found = (left.groupBy("part", "i", "j").cogroup(right.groupBy("part", "i", "j"))
             .applyInArrow(nearest, "query_id long, vec_id long, score double"))
    order = (F.col("score").desc(), F.col("vec_id"))
    some = Window.partitionBy("query_id", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))).orderBy(*order)
    whole = Window.partitionBy("query_id").orderBy(*order)
    best = found.dropDuplicates(["query_id", "vec_id", "score"]).withColumn("n", F.row_number().over(some)).filter(F.col("n") <= k)
    return (best.withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def best_of(s: np.ndarray, x: np.ndarray, queries: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per row of the scores ``s``: places and exact scores of the k best,
    ties to smaller ids.  Every place counts whose score may reach the k-th
    one but for rounding; -inf leaves a place out."""
    at = min(k, s.shape[1]) - 1
    with np.errstate(all="ignore"):
        kth = -np.partition(-s, at, axis=1)[:, at]
        # twice the bound of two inner products' rounding errors
        margin = 4 * x.shape[1] * np.finfo(s.dtype).eps * np.linalg.norm(queries, axis=1) * np.linalg.norm(x, axis=1).max(initial=0.0)
        least = kth - margin
    least[~np.isfinite(least)] = -np.inf
    for row, q, low in zip(s, queries, least):
        t = np.flatnonzero((row >= low) & (row > -np.inf))
        exact = (x[t] * q).sum(axis=1)  # one order of adding for all
        best = np.lexsort((ids[t], -exact))[:k]
        yield t[best], exact[best]


def nearest_exact(x: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int) -> dict[int, list[int]]:
    """Brute force over a small table, to measure recall against."""
    out = {}
    for q in queries.tolist():
        s = (x * x[ids == q][0]).sum(axis=1)
        order = np.lexsort((ids, -s))
        out[q] = [int(i) for i in ids[order] if i != q][:k]
    return out
