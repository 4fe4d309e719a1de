"""Ranking and ordering operators.

Per-key top-k (W2) is a ``row_number`` filter, which Spark plans as a partial
``WindowGroupLimit`` before the shuffle, so a hot key is reduced to k rows per
input partition first.

Global orderings (vocabulary ranks, batch numbers, contiguous shards) never use
an un-partitioned window: ``ordered_index`` range-partitions the rows on the
order key once, writes them with their place in their partition, and adds
per-partition offsets from a table with one row per (partition, group).  A hot group is spread over
as many range partitions as its size requires.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexkit.session import materialize, shuffle_partitions


def _cols(xs) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def ordered_prefix(df: DataFrame, order_by: Sequence, group_by: Sequence[str] = (),
                   weight: str | Column | None = None, out: str = "idx",
                   num_partitions: int | None = None) -> DataFrame:
    """Exclusive prefix sum of ``weight`` (default 1 = 0-based row index) within
    each group, in the given order.  ``order_by`` must be a total order inside a
    group (add a unique tie-breaker), so the numbering is repeatable when a lost
    partition is recomputed.  Null group keys form a group of their own.

    The rows are range-partitioned and sorted once; the partition number and the
    position in it come from ``monotonically_increasing_id`` of that very pass,
    which is written.  Totals per (partition, group) and their offsets are
    derived from the written table, so rows and offsets cannot disagree."""
    n = num_partitions or shuffle_partitions(df.sparkSession)
    group_by = list(group_by)
    keys = _cols(group_by) + _cols(order_by)
    w_col = F.lit(1).cast("bigint") if weight is None else (
        F.col(weight) if isinstance(weight, str) else weight).cast("double")
    s = materialize(df.withColumn("_w", w_col)
                      .repartitionByRange(n, *keys)
                      .sortWithinPartitions(*keys)
                      .withColumn("_at", F.monotonically_increasing_id()))
    s = s.withColumn("_pid", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1))
    tot = s.groupBy("_pid", *group_by).agg(F.sum("_w").alias("_tot"), F.min("_at").alias("_first"))
    # at most one row per (partition, group); the un-keyed case has one row per partition
    off_w = Window.partitionBy(*group_by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select(F.col("_pid").alias("_opid"), *[F.col(g).alias(f"_o{i}") for i, g in enumerate(group_by)],
                      "_first", F.coalesce(F.sum("_tot").over(off_w), F.lit(0)).alias("_off"))
    if weight is None:
        # rows of a group are neighbours in the sorted partition
        local = F.col("_at") - F.col("_first")
    else:
        run = Window.partitionBy("_pid", *group_by).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        s = s.withColumn("_run", F.coalesce(F.sum("_w").over(run), F.lit(0)))
        local = F.col("_run")
    on = F.col("_pid") == F.col("_opid")
    for i, g in enumerate(group_by):
        on = on & F.col(g).eqNullSafe(F.col(f"_o{i}"))
    if not group_by:
        offs = F.broadcast(offs)  # bounded by the number of partitions
    res = s.join(offs, on).withColumn(out, F.col("_off") + local)
    if weight is None:
        res = res.withColumn(out, F.col(out).cast("bigint"))
    return res.select(*[c for c in df.columns if c != out], out)


def ordered_index(df: DataFrame, order_by: Sequence, group_by: Sequence[str] = (),
                  out: str = "idx") -> DataFrame:
    """0-based position of each row inside its group under a total order."""
    return ordered_prefix(df, order_by, group_by, None, out)


def rank_hits(run: DataFrame, query_col: str = "query_id", doc_col: str = "doc_id",
              score_col: str = "score", out: str = "rank", digits: int = 9) -> DataFrame:
    """1-based rank per query, score descending (rounded to ``digits`` so two
    engines agree on ties), then doc id ascending."""
    w = Window.partitionBy(query_col).orderBy(F.round(F.col(score_col), digits).desc(), F.col(doc_col))
    return run.withColumn(out, F.row_number().over(w))


def top_k_per_key(df: DataFrame, k: int, key_col: str = "query_id", doc_col: str = "doc_id",
                  score_col: str = "score", out: str = "rank", digits: int = 9) -> DataFrame:
    """Best k rows per key (WindowGroupLimit partial + final)."""
    return rank_hits(df, key_col, doc_col, score_col, out, digits).filter(F.col(out) <= k)


def first_true(df: DataFrame, key_cols: Sequence[str], pos_col: str, flag_col: str,
               out: str = "first_hit") -> DataFrame:
    """Smallest position whose flag is true, per key (null when none)."""
    return df.groupBy(*key_cols).agg(F.min(F.when(F.col(flag_col), F.col(pos_col))).alias(out))


def assign_batches(df: DataFrame, batch_size: int, order_by: Sequence, out: str = "batch",
                   pos_out: str = "pos_in_batch") -> DataFrame:
    """Consecutive groups of ``batch_size`` rows in the given total order."""
    ix = ordered_index(df, order_by, out="_row")
    return (ix.withColumn(out, F.floor(F.col("_row") / batch_size).cast("bigint"))
              .withColumn(pos_out, (F.col("_row") % batch_size).cast("int"))
              .drop("_row"))


def drop_last(df: DataFrame, batch_size: int, batch_col: str = "batch") -> DataFrame:
    """Discard the final incomplete batch (keep batch < floor(N / B))."""
    n_full = df.select(F.floor(F.count(F.lit(1)) / batch_size).alias("n")).scalar()
    return df.filter(F.col(batch_col) < n_full)


def pad_width(df: DataFrame, tokens_col: str, batch_col: str = "batch", out: str = "width") -> DataFrame:
    """Longest token list per batch (batches are bounded groups)."""
    return df.withColumn(out, F.max(F.size(tokens_col)).over(Window.partitionBy(batch_col)))


def shard_round_robin(df: DataFrame, world: int, order_by: Sequence, out: str = "shard") -> DataFrame:
    """1-based running number mod ``world`` is the shard (rank -1 = all rows)."""
    ix = ordered_index(df, order_by, out="_row")
    return ix.withColumn(out, ((F.col("_row") + 1) % world).cast("int")).drop("_row")


def shard_contiguous(df: DataFrame, world: int, order_by: Sequence, out: str = "shard") -> DataFrame:
    """Contiguous k-way split, the first N mod k shares one row larger
    (same sizes as numpy.array_split)."""
    ix = ordered_index(df, order_by, out="_row")
    n = df.select(F.count(F.lit(1)).alias("n")).scalar()
    q = F.floor(n / world)
    r = n - q * world
    big = r * (q + 1)
    shard = F.when(F.col("_row") < big, F.floor(F.col("_row") / (q + 1))) \
             .otherwise(r + F.floor((F.col("_row") - big) / q))
    return ix.withColumn(out, shard.cast("int")).drop("_row")


def filter_shard(df: DataFrame, rank: int, shard_col: str = "shard") -> DataFrame:
    """Keep one shard; rank -1 keeps everything."""
    return df if rank < 0 else df.filter(F.col(shard_col) == rank)


def vocab_ranking(weights: DataFrame, weight_col: str = "weight", token_col: str = "token",
                  out: str = "rank") -> DataFrame:
    """0-based position of every token in descending weight order (token
    breaks ties), distributed via ``ordered_index``."""
    return ordered_index(weights, [F.col(weight_col).desc(), F.col(token_col)], out=out)


def top_weights(weights: DataFrame, k: int, weight_col: str = "weight", token_col: str = "token",
                largest: bool = True) -> DataFrame:
    """L1 / L2: k largest (or smallest) weights; planned as TakeOrderedAndProject."""
    o = F.col(weight_col).desc() if largest else F.col(weight_col).asc()
    return weights.orderBy(o, F.col(token_col)).limit(k)


def smallest_magnitude(weights: DataFrame, k: int, weight_col: str = "weight",
                       token_col: str = "token") -> DataFrame:
    """L3: k weights closest to zero."""
    return weights.orderBy(F.abs(F.col(weight_col)), F.col(token_col)).limit(k)
