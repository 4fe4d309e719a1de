"""Retrieval metrics over a run and judgements.

A run is (query_id, doc_id, score); qrels is (query_id, doc_id, relevance).
Definitions follow the trec_eval / BEIR conventions the reference relies on:

* ranks: score descending, ties by doc id ascending (trec_eval breaks ties by
  doc id descending; we document ours and keep it in both engines);
* NDCG@k (linear gain, 1/log2(rank+1), ideal from the judgements), MAP@k
  (sum of precision at relevant ranks <= k over the number of relevant),
  Recall@k and P@k: averaged over queries present in both run and qrels;
* MRR@k, R_cap@k (relevant in top k / min(#relevant, k)) and Hole@k (share of
  the top k judged for no query): summed over run queries that have
  judgements and divided by the number of judged queries;
* each mean is rounded to 5 digits, then multiplied by 100.

All of it is joins and grouped aggregates; the only window is the per-query
rank over a run already cut to depth max(k) (a bounded group).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexkit.operators.windows import rank_hits

K_VALUES = (1, 3, 5, 10, 100, 1000)


def exclude_self(run: DataFrame, query_col: str = "query_id", doc_col: str = "doc_id") -> DataFrame:
    """Drop hits whose document id equals the query id (compared as strings)."""
    return run.filter(F.col(query_col).cast("string") != F.col(doc_col).cast("string"))


def attach_relevance(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """Judgement lookup, missing = 0."""
    q = qrels.select("query_id", "doc_id", F.col("relevance").alias("_rel"))
    return run.join(q, ["query_id", "doc_id"], "left").withColumn("relevance", F.coalesce("_rel", F.lit(0))).drop("_rel")


def unjudged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """Hits whose document is judged for no query."""
    return run.join(qrels.select("doc_id").distinct(), "doc_id", "left_anti")


def _ks_at_least(rank_col: str, k_values: Sequence[int]):
    """The cut-offs k >= rank, as rows (a row feeds every cut-off it lies within)."""
    arr = F.array(*[F.lit(int(k)) for k in k_values])
    return F.explode(F.filter(arr, lambda k: k >= F.col(rank_col)))


def per_query_metrics(run: DataFrame, qrels: DataFrame, k_values: Sequence[int] = K_VALUES) -> DataFrame:
    """Per (query_id, k): ndcg, ap, recall, precision, rr, rcap, hole (fractions)."""
    kmax = max(k_values)
    ranked = rank_hits(run).filter(F.col("rank") <= kmax)
    judged_docs = qrels.select("doc_id").distinct().withColumn("_judged", F.lit(1))
    rel = (attach_relevance(ranked, qrels)
           .join(judged_docs, "doc_id", "left")
           .withColumn("is_rel", (F.col("relevance") > 0).cast("int"))
           .withColumn("is_hole", F.col("_judged").isNull().cast("int")))
    # running count of relevant hits down the ranking (bounded group: depth kmax)
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rel = rel.withColumn("cum_rel", F.sum("is_rel").over(w))
    cut = rel.withColumn("k", _ks_at_least("rank", k_values))
    got = cut.groupBy("query_id", "k").agg(
        F.sum(F.col("relevance") / F.log2(F.col("rank") + 1)).alias("dcg"),
        F.sum("is_rel").alias("hits"),
        F.sum(F.when(F.col("is_rel") == 1, F.col("cum_rel") / F.col("rank")).otherwise(0.0)).alias("ap_sum"),
        F.min(F.when(F.col("is_rel") == 1, F.col("rank"))).alias("first_rel"),
        F.sum("is_hole").alias("holes"))
    # ideal DCG from the judgements of each query
    wi = Window.partitionBy("query_id").orderBy(F.col("relevance").desc(), F.col("doc_id"))
    ideal = (qrels.filter(F.col("relevance") > 0)
                  .withColumn("irank", F.row_number().over(wi))
                  .filter(F.col("irank") <= kmax)  # per-query top-k limit, reduced before the shuffle
                  .withColumn("k", _ks_at_least("irank", k_values))
                  .groupBy("query_id", "k")
                  .agg(F.sum(F.col("relevance") / F.log2(F.col("irank") + 1)).alias("idcg")))
    nrel = qrels.filter(F.col("relevance") > 0).groupBy("query_id").agg(F.count(F.lit(1)).alias("nrel"))
    run_q = ranked.select("query_id").distinct()
    base = (run_q.join(qrels.select("query_id").distinct(), "query_id")
                 .withColumn("k", F.explode(F.array(*[F.lit(int(k)) for k in k_values]))))
    m = (base.join(got, ["query_id", "k"], "left")
             .join(ideal, ["query_id", "k"], "left")
             .join(nrel, "query_id", "left")
             .fillna({"dcg": 0.0, "hits": 0, "ap_sum": 0.0, "holes": 0, "idcg": 0.0, "nrel": 0}))
    return m.select(
        "query_id", "k",
        F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg"),
        F.when(F.col("nrel") > 0, F.col("ap_sum") / F.col("nrel")).otherwise(0.0).alias("ap"),
        F.when(F.col("nrel") > 0, F.col("hits") / F.col("nrel")).otherwise(0.0).alias("recall"),
        (F.col("hits") / F.col("k")).alias("precision"),
        F.coalesce(F.lit(1.0) / F.col("first_rel"), F.lit(0.0)).alias("rr"),
        F.when(F.col("nrel") > 0, F.col("hits") / F.least(F.col("nrel"), F.col("k"))).otherwise(0.0).alias("rcap"),
        (F.col("holes") / F.col("k")).alias("hole"))


METRIC_NAMES = (("ndcg", "NDCG"), ("ap", "MAP"), ("recall", "Recall"), ("precision", "P"),
                ("rr", "MRR"), ("rcap", "R_cap"), ("hole", "Hole"))
_DIV_BY_JUDGED = {"rr", "rcap", "hole"}


def evaluate(run: DataFrame, qrels: DataFrame, k_values: Sequence[int] = K_VALUES,
             group_cols: Sequence[str] = ()) -> DataFrame:
    """Long table (metric, k, value) with value = 100 * round(mean, 5).

    ``group_cols`` (e.g. a dataset column present in run and qrels) evaluates
    every group in the same job."""
    g = list(group_cols)
    if g:
        pq = _grouped_per_query(run, qrels, k_values, g)
    else:
        pq = per_query_metrics(run, qrels, k_values)
    sums = pq.groupBy(*g, "k").agg(F.count(F.lit(1)).alias("n_eval"),
                                   *[F.sum(c).alias(c) for c, _ in METRIC_NAMES])
    if g:
        sums = sums.join(qrels.groupBy(*g).agg(F.countDistinct("query_id").alias("n_judged")), g)
    else:
        sums = sums.withColumn("n_judged", qrels.agg(F.countDistinct("query_id")).scalar())
    stacked = F.explode(F.array(*[
        F.struct(F.lit(name).alias("metric"),
                 (F.col(c) / (F.col("n_judged") if c in _DIV_BY_JUDGED else F.col("n_eval"))).alias("mean"))
        for c, name in METRIC_NAMES]))
    out = sums.select(*g, "k", stacked.alias("m")).select(*g, F.col("m.metric").alias("metric"), "k",
                                                         F.col("m.mean").alias("mean"))
    return out.select(*g, "metric", F.col("k").cast("int").alias("k"),
                      (F.round(F.col("mean"), 5) * 100.0).alias("value"))


def _grouped_per_query(run, qrels, k_values, g):
    """Per-query metrics where query ids are scoped by the group columns."""
    key = F.concat_ws("\u0001", *[F.col(c).cast("string") for c in g], F.col("query_id").cast("string"))
    r = run.withColumn("_gq", key)
    q = qrels.withColumn("_gq", key)
    keep = r.select("_gq", *g).distinct()
    keep = keep.unionByName(q.select("_gq", *g).distinct()).distinct()
    pq = per_query_metrics(r.drop("query_id").withColumnRenamed("_gq", "query_id"),
                           q.drop("query_id").withColumnRenamed("_gq", "query_id"), k_values)
    return pq.join(keep.withColumnRenamed("_gq", "query_id"), "query_id")


def macro_average(metrics: DataFrame, group_col: str = "dataset", expected_members: int | None = None) -> DataFrame:
    """Per (metric, k) mean over groups; optionally assert the member count."""
    out = metrics.groupBy("metric", "k").agg(F.avg("value").alias("value"),
                                             F.count(F.lit(1)).alias("members"))
    if expected_members is not None:
        bad = out.filter(F.col("members") != expected_members).limit(1).count()
        if bad:
            raise AssertionError(f"collection must have exactly {expected_members} members")
    return out
