"""Physical-plan properties the scale design relies on."""
from pyspark.sql import functions as F

from conftest import SF_SMALL
from lexkit.operators import lexical as L
from lexkit.operators import windows as W
from lexkit.sources import testdata as td


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scoring_plan_broadcasts_queries_and_limits_per_partition(spark):
    posts = L.materialize(L.postings(td.corpus(spark, SF_SMALL), title_col="title"))
    qt = L.query_terms(td.queries(spark, SF_SMALL))
    st = L.corpus_stats(posts)
    qw = L.bm25_query_weights(qt, L.idf_table(posts, st.n_docs))
    run = W.top_k_per_key(L.score(posts, qw, L.bm25_doc_term(st), True), 10)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = _plan(run)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "BroadcastHashJoin" in p
    assert "WindowGroupLimit" in p            # partial top-k before the shuffle
    # bucketed postings: the (query, doc) aggregate sits directly on the join, no exchange below it
    agg_part = p.split("HashAggregate(keys=[query_id")[-1]
    assert "Exchange hashpartitioning(query_id" not in agg_part.split("BroadcastHashJoin")[0]


def test_postings_scan_prunes_columns(spark):
    posts = L.postings(td.corpus(spark, SF_SMALL), title_col="title")
    p = posts._jdf.queryExecution().executedPlan().toString()
    # only the three columns the title rule and the tokenizer need are read
    assert "ReadSchema: struct<doc_id:bigint,text:string,source:string>" in p
    # the tokenizer regex is evaluated once per row (no inferred size() filter)
    assert p.count("regexp_extract_all") == 1


def test_ordered_index_has_no_single_partition_window(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 7)
    p = _plan(W.ordered_index(df, [F.col("id")]))
    assert "SinglePartition" not in p.split("BroadcastExchange")[0]
