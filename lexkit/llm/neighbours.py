"""Operator 9, approximate nearest neighbours: adaptive dimension scan.

Index.  Centroids are fitted by k-means on a bounded, documented sample; every
usable row is assigned to its nearest centroid.  Unit vectors are turned by one
random orthogonal matrix, so the first columns of a vector say as much about
its length as any others.  The index is a table of (list, part, id, turned
vector, original vector); a large list is split into parts by a hash of the id.

Search.  A query visits the parts of its nearest lists.  Inside a part the
columns are read in blocks: after each block the partial squared distance,
scaled up to all columns, is tested against the query's current k-th best
distance; a candidate whose estimate exceeds it by more than the test's error
bound is abandoned, the others go on to the next block.  Candidates that reach
the last column are measured by their cosine on the original vectors in double
precision.  Each part returns k rows per query; a window keeps the best k.

The number of visited lists is set by measurement: for a bounded sample of
queries the true neighbours are found by brute force over all rows, and the
queries visit as many lists as reach ``target`` recall there (all lists, if
need be).

A list that many queries visit meets them in blocks.

Defined cases: vectors that are null, zero or hold null or non-finite components,
and rows without an id, take no part; vectors of different lengths have no cosine,
so each length has an index of its own; equal vectors
tie exactly, the smaller id is nearer; a query never finds its own id; fewer
than k candidates: all of them; rows repeating an id count once, with the first
vector; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexkit.llm.common import hash_sample
from lexkit.llm.vectortable import cosine_pairs, lists, matrix, unit, usable
from lexkit.session import materialize

TOP = 5
SAMPLE_ROWS = 20_000        # rows the centroids are fitted on
MOST_LISTS = 1024
PART_ROWS = 4096            # rows of one part of a list
QUERY_ROWS = 4096           # queries that a part is scanned for at once
BLOCK = 16                  # columns per step of the scan
ERROR = 2.1                 # error bound of the abandoning test, in 1 / sqrt(columns read)
CHUNK = 512                 # candidates scanned at once
AUDIT_QUERIES = 64
TARGET = 0.97
SEED = 11


def k_means(x: np.ndarray, k: int, rounds: int = 10, seed: int = SEED) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        norm = np.sqrt((total * total).sum(1, keepdims=True))
        c = np.where(norm > 0, total / np.maximum(norm, 1e-12), c)
    return c


def rotation(d: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def adaptive_scan(q: np.ndarray, x: np.ndarray, k: int, skip: np.ndarray | None = None) -> list[np.ndarray]:
    """Per query, the candidates (rows of ``x``) that are not abandoned: all that
    can be among its k nearest.  ``q`` and ``x`` are turned unit vectors;
    ``skip[i]`` is a row of ``x`` that query i must not count (-1: none)."""
    d = q.shape[1]
    blocks = [(a, min(a + BLOCK, d)) for a in range(0, d, BLOCK)]
    best = np.full((len(q), k), np.inf)
    found: list[list[np.ndarray]] = [[] for _ in q]
    for lo in range(0, len(x), CHUNK):
        part = x[lo:lo + CHUNK]
        bound = best[:, -1]
        a, b = blocks[0]
        dist = 2.0 * np.clip(0.5 * ((q[:, a:b] ** 2).sum(1)[:, None] + (part[:, a:b] ** 2).sum(1)[None]) - q[:, a:b] @ part[:, a:b].T, 0, None)
        if skip is not None:
            own = np.flatnonzero((skip >= lo) & (skip < lo + len(part)))
            dist[own, skip[own] - lo] = np.inf
        alive = np.nonzero(dist * (d / b) <= (bound * (1 + ERROR / np.sqrt(b)) ** 2)[:, None])
        near = dist[alive]
        for a, b in blocks[1:]:
            gap = q[alive[0], a:b] - part[alive[1], a:b]
            near = near + (gap * gap).sum(1)
            limit = bound[alive[0]] * ((1 + ERROR / np.sqrt(b)) ** 2 if b < d else 1 + 1e-9)
            keep = near * (d / b) <= limit
            alive, near = (alive[0][keep], alive[1][keep]), near[keep]
        finite = np.isfinite(near)
        alive, near = (alive[0][finite], alive[1][finite]), near[finite]
        first = np.searchsorted(alive[0], np.arange(len(q) + 1))
        for i in np.flatnonzero(np.diff(first)):
            s = slice(first[i], first[i + 1])
            best[i] = np.sort(np.concatenate([best[i], near[s]]))[:k]
            # ties and rounding: keep what is as near as the k-th so far
            found[i].append(alive[1][s][near[s] <= best[i, -1] + 1e-9] + lo)
    return [np.concatenate(f) if f else np.empty(0, np.int64) for f in found]


def _nearest(queries: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    q, x = matrix(queries.column("vector")), matrix(rows.column("vector"))
    qid, xid = queries.column("query_id").to_numpy(), rows.column("id").to_numpy()
    order = np.argsort(xid, kind="stable")
    x, xid = x[order], xid[order]
    at = np.minimum(np.searchsorted(xid, qid), len(xid) - 1)
    skip = np.where(xid[at] == qid, at, -1)
    found = adaptive_scan(matrix(queries.column("turned"), np.float32).astype(np.float64),
                          matrix(rows.column("turned"), np.float32)[order].astype(np.float64), k, skip)
    n = np.array([len(f) for f in found])
    who, cand = np.repeat(np.arange(len(qid)), n), np.concatenate(found) if len(found) else np.empty(0, np.int64)
    score = cosine_pairs(q[who], x[cand])
    order = np.lexsort((xid[cand], -score, who))
    rank = np.arange(len(order)) - np.repeat(np.cumsum(n) - n, n)
    order = order[rank < k]
    return pa.table({"query_id": qid[who[order]], "id": xid[cand[order]], "score": score[order]})


class Index:
    """Inverted lists of turned vectors, written once, and the way into them."""

    def __init__(self, vectors: DataFrame, key: str = "vec_id", vector: str = "embedding"):
        self.spark = vectors.sparkSession
        rows = vectors.groupBy(F.col(key).alias("id")).agg(F.min(vector).alias("vector"))
        rows = materialize(rows)
        sample = hash_sample(rows, SAMPLE_ROWS, "id", seed=SEED).select("id", "vector").toArrow().sort_by("id")
        self.n = rows.count()
        if not self.n:
            self.lists = 0
            return
        x = unit(matrix(sample.column("vector")))
        self.turn = rotation(x.shape[1])
        self.centroids = k_means(x, int(min(MOST_LISTS, max(1, np.sqrt(self.n)))))
        self.lists = len(self.centroids)
        centroids, turn = self.centroids, self.turn

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                u = unit(matrix(b.column("vector")))
                if len(u):
                    yield pa.RecordBatch.from_arrays(
                        [b.column("id"), b.column("vector"), lists((u @ turn).astype(np.float32)),
                         pa.array((u @ centroids.T).argmax(1).astype(np.int32))], ["id", "vector", "turned", "list"])

        assigned = materialize(rows.mapInArrow(assign, "id bigint, vector array<double>, turned array<float>, list int"))
        # one row per list: bounded by MOST_LISTS
        sizes = assigned.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).alias("parts"))
        self.sizes = F.broadcast(sizes)
        self.rows = assigned.join(self.sizes, "list").withColumn(
            "part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")

    def probes(self, queries: DataFrame, count: int) -> DataFrame:
        """(query_id, vector, turned, list, part) for the ``count`` nearest lists."""
        centroids = self.centroids

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    near = np.argsort(-(unit(matrix(b.column("vector"))) @ centroids.T), 1, kind="stable")[:, :count]
                    at = pa.array(np.repeat(np.arange(b.num_rows), near.shape[1]))
                    yield pa.RecordBatch.from_arrays(
                        [b.column("query_id").take(at), b.column("vector").take(at), b.column("turned").take(at),
                         pa.array(near.ravel().astype(np.int32))], ["query_id", "vector", "turned", "list"])

        return (queries.select("query_id", "vector", "turned")
                .mapInArrow(choose, "query_id bigint, vector array<double>, turned array<float>, list int")
                .join(self.sizes, "list")
                .withColumn("part", F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int")))).drop("parts"))

    def search(self, queries: DataFrame, k: int, count: int) -> DataFrame:
        """(query_id, id, score, rank): the k nearest within ``count`` lists."""

        def scan(q: pa.Table, x: pa.Table) -> pa.Table:
            if not len(q) or not len(x):
                return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()),
                                 "score": pa.array([], pa.float64())})
            return _nearest(q, x, k)

        # a list that many queries visit is scanned for one block of them at a time
        probes = materialize(self.probes(queries, count))
        blocks = probes.filter("part = 0").groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("blocks"))
        blocks = F.broadcast(materialize(blocks))          # one row per list
        asked = probes.join(blocks, "list").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int"))
        rows = self.rows.join(blocks, "list").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        hits = (asked.drop("blocks").groupBy("list", "part", "block")
                .cogroup(rows.drop("blocks").groupBy("list", "part", "block"))
                .applyInArrow(scan, "query_id bigint, id bigint, score double"))
        return best_rows(hits, k)

    def calibrated(self, queries: DataFrame, k: int, target: float = TARGET) -> int:
        """Lists to visit so that a sample of queries finds ``target`` of its true
        neighbours; the true ones come from brute force over all rows."""
        sample = queries.orderBy(F.xxhash64(F.lit(SEED), "query_id")).limit(AUDIT_QUERIES).toArrow()
        if not len(sample):
            return self.lists
        qid, q = sample.column("query_id").to_numpy(), matrix(sample.column("vector"))

        def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x, xid = matrix(b.column("vector")), b.column("id").to_numpy()
                    s = unit(q) @ unit(x).T
                    s[qid[:, None] == xid[None]] = -np.inf
                    top = np.argsort(-s, 1, kind="stable")[:, :k]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(qid, top.shape[1])), pa.array(xid[top.ravel()]),
                         pa.array(np.take_along_axis(s, top, 1).ravel()),
                         b.column("list").take(pa.array(top.ravel()))], ["query_id", "id", "score", "list"])

        true = best_rows(self.rows.mapInArrow(exact, "query_id bigint, id bigint, score double, list int")
                         .filter("score > -2"), k).select("query_id", "list").collect()
        order = {i: np.argsort(np.argsort(-row, kind="stable")) for i, row in
                 zip(qid.tolist(), unit(q) @ self.centroids.T, strict=True)}
        ranks = np.sort([order[r[0]][r[1]] for r in true])
        return int(ranks[int(np.ceil(target * len(ranks))) - 1]) + 1 if len(ranks) else self.lists


def best_rows(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def nearest(vectors: DataFrame, every: int, k: int = TOP, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest rows of every row whose id is divisible by ``every``."""
    out = vectors.sparkSession.createDataFrame([], "query_id bigint, id bigint, score double, rank int")
    for rows in usable(vectors, key, vector):
        index = Index(rows, key, "vector")
        if index.lists:
            queries = index.rows.filter(F.col("id") % every == 0).withColumnRenamed("id", "query_id")
            out = out.unionByName(index.search(queries, k, index.calibrated(queries, k)))
    return out


def op9_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors of every vector whose id is divisible by 50."""
    hits = nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 50)
    return hits.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
