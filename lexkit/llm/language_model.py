"""Operator 6, LM scoring: deleted interpolation.

Tokens of a text are its words and one end.  The model mixes maximum-likelihood
estimates of order two, one and zero,

    P(w | u) = a2 c(u, w) / c(u) + a1 c(w) / N + a0 / (V + 1),

with one set of mixture weights per bucket of the context's frequency c(u)
(powers of two).  The weights are learnt by expectation-maximisation on
held-out counts: one fold of the training rows is deleted from the counts, its
tokens are predicted from the rest.  Scores then use the counts of all training
rows.

Counting without a row per token: documents are grouped into memory-sized
chunks; a chunk sends, per range of n-gram hashes, one block of its sorted
distinct n-grams with their counts (combined before the shuffle, so a frequent
n-gram is no hot key).  Rows are dealt by their place in the table, so a row
repeated often is spread over all chunks.  A range adds up all blocks and answers each chunk with
a block of corpus counts in the chunk's own order.  The chunk, grouped again
with its answers, scores its texts.  What is gathered grows with the corpus; no
vocabulary or count table is ever collected or broadcast.

Held-out events are counted on a grid (bucket, both estimates on a logarithmic
scale) whose size does not grow with the corpus; the EM runs over that grid.

Defined cases: null and empty texts have the end as their only token; a null id
is a training row; repeated rows count as often as they occur; without training
rows all counts are 0; an empty table gives an empty table; whole texts are
read; corpus counts are 64 bits wide; ``docs`` is a stored table; words are hashed to 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexkit.llm.blocks import numbers, pack_sorted, planes, unpack_sorted
from lexkit.llm.common import crc_mod, documents, free_names, numbered
from lexkit.llm.flatwords import U64, Words, mix
from lexkit.session import shuffle_partitions, written

FOLDS = 7
SCORED_FOLD = 2            # never learnt from
DELETED_FOLD = 3           # training rows the mixture weights are learnt on
CHUNK_BYTES = 8 << 20
RANGE_KEYS = 2 << 20       # distinct n-grams of one range
KEPT, DELETED, SCORED = 0, 1, 2
BUCKETS = 44
GRID = 4                   # steps of the grid per factor of two
EM_ROUNDS = 50
END, BEGIN = U64(0x5851F42D4C957F2D), U64(0x14057B7EF767814F)
_STEP = U64(0xD6E8FEB86659FD93)


class Chunk:
    """Tokens of a chunk's texts and its sorted distinct unigrams and bigrams."""

    def __init__(self, texts: pa.ChunkedArray):
        w = Words(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts)
        self.tokens = np.insert(w.hash, w.first[1:], END)
        self.counts = w.counts + 1
        self.first = np.cumsum(self.counts) - self.counts
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[self.first] = BEGIN
        self.keys, self.at, self.n = [], [], []
        for x in (self.tokens, mix(before * _STEP + self.tokens)):
            keys, at, n = np.unique(x, return_inverse=True, return_counts=True)
            self.keys.append(keys)
            self.at.append(at.astype(np.int32))        # a chunk has fewer tokens than that
            self.n.append(n)

    def events(self, answers: pa.Table, column: str, n_docs: int) -> tuple[np.ndarray, ...]:
        """Per token: count of the token, of its bigram and of its context."""
        groups, blocks = answers.column("g").to_numpy(), answers.column(column)
        parts = [numbers(blocks[int(i)].as_py(), np.uint64) for i in np.argsort(groups)]
        table = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        m = len(self.keys[0])
        one = table[:m][self.at[0]].astype(np.int64)
        two = table[m:][self.at[1]].astype(np.int64)
        context = np.empty_like(one)
        context[1:] = one[:-1]
        context[self.first] = n_docs
        return one, two, context


def bucket_of(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + floor(log2(count))."""
    return np.minimum(np.frexp(context.astype(float))[1], BUCKETS - 1)


def fit_weights(grid: np.ndarray, vocabulary: int) -> np.ndarray:
    """Mixture weights per bucket (order two, one, zero) from held-out events:
    rows (bucket, step of estimate two, of estimate one, events); a step of
    -1 is an estimate of 0."""
    w = np.tile([0.3, 0.6, 0.1], (BUCKETS, 1))
    w[0] = [0.0, 0.8, 0.2]
    if not len(grid):
        return w
    b, n = grid[:, 0], grid[:, 3].astype(float)
    p = np.stack([np.where(grid[:, i] < 0, 0.0, 2.0 ** (-(grid[:, i] + 0.5) / GRID)) for i in (1, 2)]
                 + [np.full(len(grid), 1 / (vocabulary + 1))], 1)
    for _ in range(EM_ROUNDS):
        joint = w[b] * p
        share = joint / joint.sum(1, keepdims=True) * n[:, None]
        total = np.stack([np.bincount(b, share[:, i], BUCKETS) for i in range(3)], 1)
        total += w * 1.0 + 1e-6            # one event's worth of the weights so far
        total[0, 0] = 0.0
        w = total / total.sum(1, keepdims=True)
    return w


def score_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score."""
    spark = docs.sparkSession
    fold = crc_mod("doc_id", FOLDS)
    row, = free_names(docs, "_row")
    src = numbered(docs, row).select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"),
                                     F.col(row).alias("row"))
    src = src.withColumn("kind", F.when(fold == SCORED_FOLD, SCORED).when(fold == DELETED_FOLD, DELETED).otherwise(KEPT))
    size, n_docs, n_kept = src.agg(F.sum(F.octet_length("text")), F.sum((F.col("kind") != SCORED).cast("int")),
                                   F.sum((F.col("kind") == KEPT).cast("int"))).first()
    size, n_docs, n_kept = size or 0, n_docs or 0, n_kept or 0
    partitions = shuffle_partitions(spark)
    chunks = max(-(-size // CHUNK_BYTES), partitions)
    few = -(-chunks // (FOLDS - 2))        # chunks of the two folds of their own
    many = F.when(F.col("kind") == KEPT, F.lit(chunks)).otherwise(F.lit(few))
    start = F.when(F.col("kind") == KEPT, F.lit(0)).when(F.col("kind") == DELETED, F.lit(chunks)).otherwise(F.lit(chunks + few))
    src = src.withColumn("chunk", (start + F.pmod(F.xxhash64("row"), many)).cast("bigint")).drop("row")
    bits = max(int(np.ceil(np.log2(max(size / 8 / RANGE_KEYS, partitions, 2)))), 1)
    shift, ranges = U64(64 - bits), 1 << bits

    def ask(t: pa.Table) -> pa.Table:
        chunk = Chunk(t.column("text"))
        kind, number = t.column("kind")[0].as_py(), t.column("chunk")[0].as_py()
        out = []
        for order, (keys, n) in enumerate(zip(chunk.keys, chunk.n, strict=True)):
            border = np.searchsorted(keys >> shift, np.arange(ranges + 1, dtype=np.uint64))
            out += [(order * ranges + r, number, kind, pack_sorted(keys[a:b]), planes(n[a:b].astype(np.uint32)))
                    for r, (a, b) in enumerate(zip(border[:-1], border[1:], strict=True)) if b > a]
        return pa.table({name: pa.array(c, kind) for name, c, kind in zip(
            ("g", "chunk", "kind", "keys", "n"), zip(*out, strict=True),
            (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)})

    def answer(t: pa.Table) -> pa.Table:
        keys = [unpack_sorted(x.as_py()) for x in t.column("keys")]
        kinds, length = t.column("kind").to_numpy(), [len(k) for k in keys]
        n = np.concatenate([numbers(x.as_py(), np.uint32) for x in t.column("n")]).astype(float)
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        of = np.repeat(kinds, length)
        kept = np.bincount(at, n * (of == KEPT), len(distinct)).astype(np.uint64)
        every = np.bincount(at, n * (of != SCORED), len(distinct)).astype(np.uint64)
        first = t.column("g")[0].as_py() < ranges
        cuts = np.cumsum(length)[:-1]
        zero = np.zeros(len(keys), np.int64)
        seen, total, total_kept = zero.copy(), zero.copy(), zero.copy()
        if first:
            seen[0], total[0], total_kept[0] = (every > 0).sum(), every.sum(dtype=np.int64), kept.sum(dtype=np.int64)
        return pa.table({
            "g": t.column("g"), "chunk": t.column("chunk"), "kind": t.column("kind"),
            "every": pa.array([planes(x) for x in np.split(every[at], cuts)], pa.binary()),
            "kept": pa.array([planes(x) if k == DELETED else b"" for k, x in zip(kinds, np.split(kept[at], cuts), strict=True)],
                             pa.binary()),
            "v": pa.array(seen), "total": pa.array(total), "total_kept": pa.array(total_kept)})

    asked = src.groupBy("chunk").applyInArrow(ask, "g int, chunk bigint, kind int, keys binary, n binary")
    answers, _ = written(asked.groupBy("g").applyInArrow(
        answer, "g int, chunk bigint, kind int, every binary, kept binary, v bigint, total bigint, total_kept bigint"))
    v, total, total_kept = (x or 0 for x in answers.agg(F.sum("v"), F.sum("total"), F.sum("total_kept")).first())

    def grid(t: pa.Table, a: pa.Table) -> pa.Table:
        names = ("bucket", "two", "one", "n")
        if not len(t):
            return pa.table({x: pa.array([], pa.int64()) for x in names})
        one, two, context = Chunk(t.column("text")).events(a, "kept", n_kept)
        with np.errstate(divide="ignore", invalid="ignore"):
            steps = [np.where(c > 0, np.floor(-np.log2(c / m) * GRID), -1).astype(np.int64)
                     for c, m in ((two, np.maximum(context, 1)), (one, max(total_kept, 1)))]
        code, n = np.unique((bucket_of(context).astype(np.int64) * 512 + steps[0] + 1) * 512 + steps[1] + 1, return_counts=True)
        return pa.table(dict(zip(names, (code // 512 ** 2, code // 512 % 512 - 1, code % 512 - 1, n.astype(np.int64)), strict=True)))

    events = (src.filter(F.col("kind") == DELETED).groupBy("chunk")
              .cogroup(answers.filter(F.col("kind") == DELETED).groupBy("chunk"))
              .applyInArrow(grid, "bucket bigint, two bigint, one bigint, n bigint")
              .groupBy("bucket", "two", "one").agg(F.sum("n").alias("n")).collect())
    weights = fit_weights(np.array([list(r) for r in events], np.int64).reshape(-1, 4), v)

    def score(t: pa.Table, a: pa.Table) -> pa.Table:
        chunk = Chunk(t.column("text"))
        one, two, context = chunk.events(a, "every", n_docs)
        w = weights[bucket_of(context)]
        p = w[:, 0] * two / np.maximum(context, 1) + w[:, 1] * one / max(total, 1) + w[:, 2] / (v + 1)
        add = lambda x: np.add.reduceat(x, chunk.first)
        return pa.table({"doc_id": t.column("doc_id"), "held_out": pa.array(t.column("kind").to_numpy() == SCORED),
                         "n_tokens": pa.array(chunk.counts.astype(np.int64)),
                         "n_known": pa.array(add((one > 0).astype(np.int64))),
                         "train_tokens": pa.array(np.full(len(t), total, np.int64)),
                         "base_score": pa.array(add(np.log10((one + 1) / (total + v + 1)))),
                         "score": pa.array(add(np.log10(p)))})

    return (src.groupBy("chunk").cogroup(answers.select("g", "chunk", "every").groupBy("chunk"))
            .applyInArrow(score, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
                                 "base_score double, score double"))


def op6_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document by the interpolated model and the base."""
    return score_texts(documents(spark, sf_dir))
