"""Dense-vector operators.

Vectors are (vec_id, embedding ARRAY<FLOAT>[, group]).  Group statistics are
computed on the exploded (vec_id, dim, x) form with grouped aggregates, so a
large group never has to fit in one task; only per-group vectors of length d
(the dimension) are ever collected.

Exact inner-product search (V1) scans the vector table once: blocks of vectors
meet blocks of queries, each pair is a numpy matrix product that keeps a local
top-k; the global top-k (W2) then only sees k rows per query per block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexkit.functions import scoring as S
from lexkit.functions.hashing import uniform
from lexkit.operators.joins import MAX_BROADCAST_ROWS
from lexkit.operators.windows import top_k_per_key


def explode_vectors(vecs: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                    keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, dim, x DOUBLE) rows; dim is 0-based."""
    return vecs.select(id_col, *keep, F.posexplode(vec_col).alias("dim", "x")) \
               .withColumn("x", F.col("x").cast("double"))


def mean_pool(vecs: DataFrame, group_col: str, id_col: str = "vec_id", vec_col: str = "embedding",
              mask_col: str | None = None) -> DataFrame:
    """A26 mean pooling: (group, dim, value) = mean of the group's vectors; with
    ``mask_col`` only of those whose mask is not 0 (a group without any has none)."""
    if mask_col:
        vecs = vecs.filter(F.col(mask_col).cast("int") != 0)
    ex = explode_vectors(vecs, id_col, vec_col, (group_col,))
    return ex.groupBy(group_col, "dim").agg(F.avg("x").alias("value"))


def masked_mean(vectors: Column, mask: Column) -> Column:
    """A26 inside a row: the mean of those of a list of vectors whose mask is not 0
    (null if there is none)."""
    used = F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda p: p["m"] != 0)
    add = lambda acc, p: F.when(F.size(acc) == 0, p["v"]).otherwise(F.zip_with(acc, p["v"], lambda a, b: a + b))
    total = F.aggregate(used, F.array().cast("array<double>"), add)
    return F.when(F.size(used) > 0, F.transform(total, lambda x: x / F.size(used)))


def as_arrays(long: DataFrame, key_col: str, dim_col: str = "dim", value_col: str = "value",
              out: str = "vec") -> DataFrame:
    """(key, dim, value) -> (key, ARRAY<DOUBLE> in dim order); groups have d rows."""
    return (long.groupBy(key_col)
                .agg(F.array_sort(F.collect_list(F.struct(F.col(dim_col).alias("d"), F.col(value_col).alias("v"))))
                     .alias("_s"))
                .select(key_col, F.transform("_s", lambda s: s["v"]).alias(out)))


def cls_pool(token_vecs: DataFrame, group_col: str, pos_col: str = "pos", vec_col: str = "embedding") -> DataFrame:
    """A26 first-token pooling: the vector at the smallest position of each group."""
    return token_vecs.groupBy(group_col).agg(F.min_by(vec_col, pos_col).alias(vec_col))


def embedding_spread(vecs: DataFrame, group_col: str, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """A10: per group, the sample standard deviation of every dimension,
    averaged over dimensions."""
    ex = explode_vectors(vecs, id_col, vec_col, (group_col,))
    return (ex.groupBy(group_col, "dim").agg(F.stddev_samp("x").alias("sd"))
              .groupBy(group_col).agg(F.avg("sd").alias("spread")))


def _block_topk(k: int):
    """Top k rows per query of one (query block, vector block): score rounded to
    9 digits, then id, the order of ``rank_hits``."""
    def fn(q: pa.Table, x: pa.Table) -> pa.Table:
        if not len(q) or not len(x):
            return pa.table({"query_id": q.column("query_id").slice(0, 0), "id": x.column("id").slice(0, 0),
                             "score": pa.array([], pa.float64())})
        order = pc.sort_indices(x.column("id")).to_numpy()
        return _best_of(q, x, order, _matrix(q.column("v")) @ _matrix(x.column("v"))[order].T, k)
    return fn


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column of equal lengths as a two-dimensional array."""
    flat = pc.list_flatten(column).to_numpy()
    return flat.reshape(len(column), -1)


def _best_of(q: pa.Table, x: pa.Table, order: np.ndarray, scores: np.ndarray, k: int) -> pa.Table:
    """The k best of scores (queries x rows of ``x`` in ``order``, by id)."""
    best = np.argsort(-np.round(scores, 9), axis=1, kind="stable")[:, :k]
    row, col = np.repeat(np.arange(len(scores)), best.shape[1]), best.ravel()
    return pa.table({"query_id": q.column("query_id").take(pa.array(row)),
                     "id": x.column("id").take(pa.array(order[col])), "score": pa.array(scores[row, col])})


def flat_ip_search(queries: DataFrame, vecs: DataFrame, k: int, *, query_id: str = "query_id",
                   query_vec: str = "vec", id_col: str = "vec_id", vec_col: str = "embedding",
                   block: int = 2048, vector_block: int = 8192) -> DataFrame:
    """Exact inner-product top-k of every query over all vectors.

    Queries and vectors are dealt to blocks by a hash of their id; an equi-join
    on the pair of blocks brings them together (queries copied to every vector
    block, vectors to every query block), each pair is one matrix product that
    leaves k rows per query, and a window keeps the best k.  Nothing passes
    through the driver, and the vectors are scanned once.
    Returns (query_id, vec_id STRING (J4), score, rank)."""
    q = queries.select(F.col(query_id).alias("query_id"), F.col(query_vec).cast("array<double>").alias("v"))
    x = vecs.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    top = _search_blocks(q, x, k, _block_topk(k), block, vector_block)
    return top.select("query_id", F.col("id").cast("string").alias(id_col), "score", "rank")


def _search_blocks(q: DataFrame, x: DataFrame, k: int, best, block: int, vector_block: int) -> DataFrame:
    """Top k of every query (query_id, v) over all rows (id, v): ``best`` gives the
    top k of one block of queries and one block of rows."""
    nq, nx = -(-q.count() // block) or 1, -(-x.count() // vector_block) or 1
    qb = (q.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(nq)))
           .withColumn("xb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(nx - 1).cast("bigint")))))
    xb = (x.withColumn("xb", F.pmod(F.xxhash64("id"), F.lit(nx)))
           .withColumn("qb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(nq - 1).cast("bigint")))))
    schema = f"query_id {dict(q.dtypes)['query_id']}, id {dict(x.dtypes)['id']}, score double"
    local = qb.groupBy("qb", "xb").cogroup(xb.groupBy("qb", "xb")).applyInArrow(best, schema)
    return top_k_per_key(local, k, key_col="query_id", doc_col="id")


def ip_scores_sql_form(queries: DataFrame, vecs: DataFrame, *, query_id: str = "query_id",
                       query_vec: str = "vec", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """J6 as a relational plan: exploded vectors joined to the (small, broadcast)
    exploded query table on dim, summed per (query, vector)."""
    ev = explode_vectors(vecs, id_col, vec_col)
    eq = queries.select(F.col(query_id).alias("query_id"), F.posexplode(query_vec).alias("dim", "qx"))
    return (ev.join(F.broadcast(eq), "dim")
              .groupBy("query_id", id_col).agg(F.sum(F.col("x") * F.col("qx")).alias("score")))


def cosine_to(vecs: DataFrame, targets: DataFrame, on: str, id_col: str = "vec_id",
              vec_col: str = "embedding", target_vec: str = "vec") -> DataFrame:
    """Dot product and cosine of each vector with its group's target
    vector (targets are one array per group, broadcast after a size check)."""
    t = targets.select(on, target_vec)
    n = t.limit(MAX_BROADCAST_ROWS + 1).count()
    t = F.broadcast(t) if n <= MAX_BROADCAST_ROWS else t
    j = vecs.select(id_col, on, vec_col).join(t, on)
    return j.select(id_col, on, S.dot(vec_col, target_vec).alias("dot"),
                    S.cos_sim(vec_col, target_vec).alias("cos"),
                    S.dot(S.l2_normalize(vec_col), S.l2_normalize(target_vec)).alias("cos_normed"))


# ---------------------------------------------------------------- product quantisation (V3)
#
# A codebook is (sub, code, centroid): m sub-spaces of 2^bits centroids, d * 2^bits
# numbers in all, whatever the number of vectors; it goes to the tasks whole.

def _book(codebook: DataFrame) -> np.ndarray:
    """The codebook as an array: sub-space x code x dimension."""
    rows = sorted(((r["sub"], r["code"], r["centroid"]) for r in codebook.collect()), key=lambda r: r[:2])
    m = 1 + max(r[0] for r in rows)
    return np.array([r[2] for r in rows], np.float64).reshape(m, len(rows) // m, -1)


def _nearest_codes(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Rows x sub-spaces: the nearest centroid (squared L2 rounded to 9 digits,
    then the smallest code)."""
    m, _, width = book.shape
    x = x.reshape(len(x), m, width)
    out = np.empty((len(x), m), np.int64)
    for a in range(0, len(x), 1024):
        for s in range(m):
            far = ((x[a:a + 1024, s, None] - book[s][None]) ** 2).sum(-1)
            out[a:a + 1024, s] = np.round(far, 9).argmin(1)
    return out


def _codebook(spark, book: np.ndarray) -> DataFrame:
    rows = [(s, c, [float(v) for v in book[s, c]]) for s in range(book.shape[0]) for c in range(book.shape[1])]
    return spark.createDataFrame(rows, "sub int, code int, centroid array<double>")


def pq_train(vecs: DataFrame, m: int, bits: int = 8, seed: int = 0, id_col: str = "vec_id",
             vec_col: str = "embedding", max_iter: int = 20) -> DataFrame:
    """V3 training: k-means (k = 2^bits, capped by the row count) in all m
    sub-spaces at once.  An iteration is one pass over the vectors: a task adds up
    its rows per (sub-space, code), partial sums combine, and the new centroids
    (d * k numbers) come back.  The first centroids are the k vectors of smallest
    seeded hash; a code without rows keeps its centroid.  Stops when no centroid
    moves.  Returns the codebook (sub, code, centroid)."""
    spark = vecs.sparkSession
    x = vecs.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    start = x.orderBy(uniform(seed, "pq", F.col("id")), "id").limit(2 ** bits).select("v").collect()
    if not start:
        raise ValueError("no vector to train on")
    book = np.array([r["v"] for r in start], np.float64)
    book = np.ascontiguousarray(book.reshape(len(book), m, -1).transpose(1, 0, 2))
    for _ in range(max_iter):
        now = book

        def add_up(batches):
            k, width = now.shape[1:]  # noqa: B023
            total, n = np.zeros((m * k, width)), np.zeros(m * k, np.int64)
            for b in batches:
                if b.num_rows:
                    v = _matrix(b.column("v"))
                    at = (_nearest_codes(v, now) + np.arange(m) * k).ravel()  # noqa: B023
                    n += np.bincount(at, minlength=m * k)
                    flat = v.reshape(-1, width)
                    for j in range(width):
                        total[:, j] += np.bincount(at, flat[:, j], m * k)
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(used, width)), pa.array(np.tile(np.arange(width), len(used))),
                 pa.array(total[used].ravel()), pa.array(np.repeat(n[used], width))], ["cell", "j", "total", "n"])

        sums = (x.select("v").mapInArrow(add_up, "cell bigint, j bigint, total double, n bigint")
                 .groupBy("cell", "j").agg((F.sum("total") / F.sum("n")).alias("mean")).collect())
        book = now.copy()
        for r in sums:
            book[r["cell"] // now.shape[1], r["cell"] % now.shape[1], r["j"]] = r["mean"]
        if np.array_equal(book, now):
            break
    return _codebook(spark, book)


def pq_encode(vecs: DataFrame, codebook: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """V3 encoding: (id, codes ARRAY<SMALLINT>), the nearest centroid of every
    sub-space, found inside the row: nothing is shuffled."""
    book = _book(codebook)

    def run(batches):
        for b in batches:
            if b.num_rows:
                codes = _nearest_codes(_matrix(b.column("v")), book).astype(np.int16)
                first = np.arange(len(codes) + 1, dtype=np.int32) * codes.shape[1]
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(pa.array(first), pa.array(codes.ravel()))],
                                                 ["id", "codes"])

    x = vecs.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    return x.mapInArrow(run, f"id {dict(x.dtypes)['id']}, codes array<smallint>").withColumnRenamed("id", id_col)


def pq_search(queries: DataFrame, codes: DataFrame, codebook: DataFrame, k: int, query_id: str = "query_id",
              query_vec: str = "vec", id_col: str = "vec_id", block: int = 512, vector_block: int = 65_536) -> DataFrame:
    """V3 search: blocks of codes meet blocks of queries (as in ``flat_ip_search``); a
    query's look-up table (sub-space x code) is made in the task, the score is the
    sum of the looked-up products, and k rows per query leave it."""
    book = _book(codebook)

    def best(q: pa.Table, x: pa.Table) -> pa.Table:
        if not len(q) or not len(x):
            return pa.table({"query_id": q.column("query_id").slice(0, 0), "id": x.column("id").slice(0, 0),
                             "score": pa.array([], pa.float64())})
        order = pc.sort_indices(x.column("id")).to_numpy()
        v, of = _matrix(q.column("v")).reshape(len(q), book.shape[0], -1), _matrix(x.column("v"))[order]
        scores = np.zeros((len(q), len(x)))
        for s in range(book.shape[0]):
            scores += (v[:, s] @ book[s].T)[:, of[:, s]]
        return _best_of(q, x, order, scores, k)

    q = queries.select(F.col(query_id).alias("query_id"), F.col(query_vec).cast("array<double>").alias("v"))
    top = _search_blocks(q, codes.select(F.col(id_col).alias("id"), F.col("codes").alias("v")), k, best, block, vector_block)
    return top.select("query_id", F.col("id").alias(id_col), "score", "rank")
