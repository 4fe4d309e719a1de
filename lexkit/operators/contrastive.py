"""Contrastive statistics over batches.

A batch is a bounded group of B rows (W7).  Scores live in a long table
(batch, qi, kj, score); the positive of query qi is key kj = qi (J12).  Pairs
are produced by equi-joins on the batch key (J7, at most B^2 per batch) or, for
the queue of a momentum encoder, by exploding each key to the later batches it
serves as a negative for and equi-joining on the target batch (J8) -- there is
no theta join.

For the sparse lexical scorer only pairs sharing a token get a row; pairs with
no shared token have score 0 and enter the log-sum-exp analytically:
    m = greatest(max(score), 0 if cnt < B),
    lse = m + ln(sum exp(score - m) + (B - cnt) exp(-m)).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexkit.functions import scoring as S
from lexkit.operators import batch_scores
from lexkit.session import materialize


# ---------------------------------------------------------------- generic CE over a score table

def cross_entropy(scores: DataFrame, group_cols: list[str], cand_col: str, pos_col: str,
                  temperature: float = 1.0, label_smoothing: float = 0.0) -> DataFrame:
    """Per group (one query), CE of softmax(score / T) against the positive
    candidate, with label smoothing (1 - e) nll + e mean_j(-log p_j); also the
    argmax hit (ties -- equal to 9 digits, so equal keys tie in every engine --
    resolve to the smallest candidate index, as argmax does)."""
    z = F.col("score") / F.lit(temperature)
    g = scores.withColumn("_z", z)
    agg = g.groupBy(*group_cols).agg(
        F.max("_z").alias("_m"), F.count(F.lit(1)).alias("_n"), F.avg("_z").alias("_mean"),
        F.max(F.when(F.col(cand_col) == F.col(pos_col), F.col("_z"))).alias("_zpos"),
        F.max_by(F.col(cand_col), F.struct(F.round(F.col("_z"), 9), -F.col(cand_col))).alias("_arg"),
        F.first(pos_col).alias("_pos"))
    sums = g.join(agg.select(*group_cols, "_m"), group_cols).groupBy(*group_cols).agg(
        F.sum(F.exp(F.col("_z") - F.col("_m"))).alias("_se"))
    j = agg.join(sums, group_cols)
    lse = F.col("_m") + F.log("_se")
    nll = lse - F.col("_zpos")
    smooth = lse - F.col("_mean")
    return j.select(*group_cols,
                    (F.lit(1.0 - label_smoothing) * nll + F.lit(label_smoothing) * smooth).alias("loss"),
                    (F.col("_arg") == F.col("_pos")).cast("double").alias("hit"))


def in_batch_scores(q: DataFrame, k: DataFrame, q_vec: str = "qv", k_vec: str = "kv") -> DataFrame:
    """Every query against every key of the same batch: (batch, qi, kj, score)."""
    return (q.select("batch", F.col("pos").alias("qi"), q_vec)
             .join(k.select("batch", F.col("pos").alias("kj"), k_vec), "batch")
             .select("batch", "qi", "kj", S.dot(q_vec, k_vec).alias("score")))


def batch_spread(rows: DataFrame, vec_col: str, out: str) -> DataFrame:
    """A10 per batch: mean over dimensions of the per-dimension sample std."""
    ex = rows.select("batch", F.posexplode(vec_col).alias("dim", "x"))
    return (ex.groupBy("batch", "dim").agg(F.stddev_samp(F.col("x").cast("double")).alias("sd"))
              .groupBy("batch").agg(F.avg("sd").alias(out)))


def in_batch_stats(rows: DataFrame, temperature: float = 1.0, label_smoothing: float = 0.0,
                   norm_query: bool = False, norm_doc: bool = False) -> DataFrame:
    """V12 in-batch: rows (batch, pos, qv, kv) -> per batch loss, accuracy (x100), stdq, stdk."""
    r = rows
    if norm_query:
        r = r.withColumn("qv", S.l2_normalize("qv"))
    if norm_doc:
        r = r.withColumn("kv", S.l2_normalize("kv"))
    sc = in_batch_scores(r, r).withColumn("pos", F.col("qi"))
    ce = cross_entropy(sc, ["batch", "qi"], "kj", "pos", temperature, label_smoothing)
    per = ce.groupBy("batch").agg(F.avg("loss").alias("loss"), (F.avg("hit") * 100).alias("accuracy"))
    return per.join(batch_spread(r, "qv", "stdq"), "batch").join(batch_spread(r, "kv", "stdk"), "batch")


def queue_scores(rows: DataFrame, queue_batches: int) -> DataFrame:
    """For every query, its own key (candidate 0) and the keys of the
    ``queue_batches`` preceding batches (candidates 1..), as
    (batch, qi, cand, score); early batches have a shorter queue."""
    own = rows.select("batch", F.col("pos").alias("qi"), F.lit(0).cast("bigint").alias("cand"),
                      S.dot("qv", "kv").alias("score"))
    keys = (rows.select(F.col("batch").alias("kb"), F.col("pos").alias("kp"), "kv")
                .withColumn("_d", F.explode(F.sequence(F.lit(1), F.lit(queue_batches))))
                .withColumn("batch", F.col("kb") + F.col("_d")))
    neg = (rows.select("batch", F.col("pos").alias("qi"), "qv").join(keys, "batch")
               .select("batch", "qi", "kb", "kp", S.dot("qv", "kv").alias("score")))
    # candidate index in queue order (oldest batch first, then key position)
    w = Window.partitionBy("batch", "qi").orderBy("kb", "kp")
    neg = neg.select("batch", "qi", F.row_number().over(w).cast("bigint").alias("cand"), "score")
    return own.unionByName(neg)


def moco_stats(rows: DataFrame, queue_batches: int, temperature: float = 1.0,
               label_smoothing: float = 0.0) -> DataFrame:
    """V12 momentum-queue form: positive logit first, queue negatives after."""
    sc = queue_scores(rows, queue_batches).withColumn("pos", F.lit(0).cast("bigint"))
    ce = cross_entropy(sc, ["batch", "qi"], "cand", "pos", temperature, label_smoothing)
    per = ce.groupBy("batch").agg(F.avg("loss").alias("loss"), (F.avg("hit") * 100).alias("accuracy"))
    return per.join(batch_spread(rows, "qv", "stdq"), "batch").join(batch_spread(rows, "kv", "stdk"), "batch")


# ---------------------------------------------------------------- sparse lexical scorer

def lexical_batch_loss(pairs: DataFrame, weights: DataFrame, beta) -> DataFrame:
    """A7 + A9 per batch: CE over rows (docs) + CE over columns (queries), both
    averaged over the batch; accuracy = share of docs whose best query is their
    own (a fraction, doc -> query, as the lexical trainer reports it)."""
    # read by two aggregates: written once
    return batch_scores.batch_loss(materialize(batch_scores.block_pass(pairs, weights, float(beta))))
