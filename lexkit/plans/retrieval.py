"""Retrieval evaluation plans (V7, V8) and the metric report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexkit.operators import lexical as L
from lexkit.operators.joins import bounded_broadcast
from lexkit.operators import metrics as M
from lexkit.operators.store import Retriever
from lexkit.session import materialize


def retrieve_and_evaluate(corpus: DataFrame, queries: DataFrame, qrels: DataFrame,
                          k_values: Sequence[int] = M.K_VALUES, *, doc_title: str | None = "title",
                          scorer: str = "bm25", weights: DataFrame | None = None, beta: float = 0.0,
                          lower: bool = True, normalize: bool = False, max_len: int | None = None,
                          exclude_self: bool = False) -> DataFrame:
    """V7: encode queries and corpus, score, keep the top max(k), evaluate.

    As in the reference loader, only judged queries are retrieved.  Returns
    the long metric table (metric, k, value)."""
    judged = queries.join(qrels.select("query_id").distinct(), "query_id", "left_semi")
    depth = max(k_values)
    if scorer == "bm25":
        run = L.bm25_search(corpus, judged, depth, doc_title=doc_title, lower=lower,
                            normalize=normalize, max_len=max_len, exclude_self=exclude_self)
    else:
        run = L.learned_search(corpus, judged, weights, beta, depth, doc_title=doc_title,
                               lower=lower, normalize=normalize, max_len=max_len, exclude_self=exclude_self)
    # the run (queries x depth rows) is read by several metric aggregates: write once
    run = materialize(run.select("query_id", "doc_id", "score"))
    return M.evaluate(run, qrels, k_values)


def evaluate_retriever(retriever: Retriever, queries: DataFrame, qrels: DataFrame,
                       k_values: Sequence[int] = M.K_VALUES, exclude_self: bool = False) -> DataFrame:
    """V7 with a stored retriever: its postings, weights and parameters as they
    were saved; only judged queries are retrieved."""
    judged = queries.join(qrels.select("query_id").distinct(), "query_id", "left_semi")
    run = materialize(retriever.search(judged, max(k_values), exclude_self).select("query_id", "doc_id", "score"))
    return M.evaluate(run, qrels, k_values)


def evaluate_multi(corpus: DataFrame, queries: DataFrame, qrels: DataFrame, dataset_col: str,
                   k_values: Sequence[int] = M.K_VALUES, *, doc_title: str | None = "title",
                   expected_members: int | None = None) -> tuple[DataFrame, DataFrame]:
    """V8 + A12: every dataset (a value of ``dataset_col``) is its own corpus
    with its own statistics (df, N, avgdl); all of them run in one job keyed by
    dataset.  Returns (per-dataset metrics, macro average)."""
    sub = corpus.select(F.col(dataset_col).alias("dataset"), "doc_id", *( [doc_title] if doc_title else []), "text")
    # scope document ids by dataset so one postings table serves all datasets
    toks = L.doc_tokens(sub.withColumn("doc_key", F.struct("dataset", "doc_id")), "doc_key", "text",
                        doc_title, True, False, None)
    posts = L.materialize(L.postings_from_tokens(toks, keep_empty=True))
    posts = posts.select(F.col("doc_id.dataset").alias("dataset"), F.col("doc_id.doc_id").alias("doc_id"),
                         "token", "tf", "dl")
    stats = posts.groupBy("dataset", "doc_id").agg(F.first("dl").alias("dl")) \
                 .groupBy("dataset").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("dl").alias("avgdl"))
    qrels_d = qrels.join(sub.select("dataset", "doc_id"), "doc_id")
    judged = queries.join(qrels_d.select("dataset", "query_id").distinct(), "query_id")
    qt = L.query_terms(judged.withColumn("qk", F.struct("dataset", "query_id")), "qk", "text")
    qt = qt.select(F.col("query_id.dataset").alias("dataset"), F.col("query_id.query_id").alias("query_id"), "token")
    # df of the query tokens only (semi-join on the size-checked token list)
    df = (posts.join(bounded_broadcast(qt.select("dataset", "token").distinct()), ["dataset", "token"], "left_semi")
               .groupBy("dataset", "token").agg(F.count(F.lit(1)).alias("df")))
    from lexkit.functions import scoring as S
    qw = (qt.join(df, ["dataset", "token"]).join(bounded_broadcast(stats), "dataset")
            .select("dataset", "query_id", "token", S.idf(F.col("n"), F.col("df")).alias("weight"), "avgdl"))
    small = L.query_side_is_small(qt)
    scored = (posts.join(F.broadcast(qw) if small else qw, ["dataset", "token"])
                   .groupBy("dataset", "query_id", "doc_id")
                   .agg(F.sum(F.col("weight") * S.bm25_tf(F.col("tf"), F.col("dl"), F.col("avgdl"))).alias("score")))
    from lexkit.operators.windows import top_k_per_key
    run = top_k_per_key(scored.withColumn("dq", F.struct("dataset", "query_id")), max(k_values), key_col="dq")
    run = materialize(run.select("dataset", "query_id", "doc_id", "score"))
    per = M.evaluate(run, qrels_d, k_values, group_cols=["dataset"])
    return per, M.macro_average(per, "dataset", expected_members)


def metric_report(metrics: DataFrame, group_col: str | None = None) -> DataFrame:
    """S11: 'name@k' labels with the value at one decimal, as the logs print them."""
    g = [group_col] if group_col else []
    return metrics.select(*g, F.concat(F.col("metric"), F.lit("@"), F.col("k").cast("string")).alias("name"),
                          F.format_number(F.col("value"), 1).alias("value"))
