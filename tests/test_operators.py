"""Worked micro-cases for the DataFrame operators."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexkit.operators import agreement as AG
from lexkit.operators import contrastive as CT
from lexkit.operators import metrics as M
from lexkit.operators import qa as QA
from lexkit.operators import sampling as SM
from lexkit.operators import stats as ST
from lexkit.operators import windows as W


def test_inversions_and_topk(spark):
    lists = spark.createDataFrame([(1, i, g) for i, g in enumerate([2, 0, 1, 3])], "list_id int, pos int, gold int")
    assert AG.inversions(lists).first()["inversions"] == 2
    avg = {r["k"]: r["avg_topk"] for r in AG.avg_topk(lists, [2]).collect()}
    assert avg[2] == pytest.approx(0.5)
    idx = {r["k"]: r["idx_topk"] for r in AG.idx_topk(lists, [0, 2]).collect()}
    assert idx == {0: 4, 2: 3}


def test_inversions_random_lists(spark):
    rng = np.random.default_rng(0)
    rows, want = [], {}
    for lid in range(5):
        perm = rng.permutation(37 + lid * 11)
        rows += [(lid, i, int(g)) for i, g in enumerate(perm)]
        want[lid] = sum(1 for i in range(len(perm)) for j in range(i + 1, len(perm)) if perm[i] > perm[j])
    got = {r["list_id"]: r["inversions"] for r in AG.inversions(
        spark.createDataFrame(rows, "list_id int, pos int, gold int")).collect()}
    assert got == want


def test_ordered_index_groups(spark):
    df = spark.createDataFrame([(g, i) for g in range(3) for i in range(100 * (g + 1))], "g int, i int")
    out = W.ordered_index(df, [F.col("i").desc()], ["g"]).collect()
    for r in out:
        assert r["idx"] == 100 * (r["g"] + 1) - 1 - r["i"]


def test_shards(spark):
    df = spark.createDataFrame([(i,) for i in range(1, 8)], "r int")
    sizes = W.shard_contiguous(df, 3, [F.col("r")]).groupBy("shard").count().orderBy("shard").collect()
    assert [s["count"] for s in sizes] == [3, 2, 2]
    rr = W.shard_round_robin(spark.createDataFrame([(i,) for i in range(1, 6)], "r int"), 2, [F.col("r")])
    assert sorted(r["r"] for r in W.filter_shard(rr, 0).collect()) == [2, 4]


def test_sampling_prob(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 300)], "dataset_id string, n long")
    for c, want in ((1.0, (0.25, 0.75)), (0.0, (0.5, 0.5)), (0.5, (0.366025, 0.633975))):
        got = [r["prob"] for r in SM.sampling_prob(sizes, c).orderBy("dataset_id").collect()]
        assert got == pytest.approx(want, abs=1e-6)


def test_top_k_hits(spark):
    rows = []
    for q, first in enumerate([0, 2, None]):
        for p in range(4):
            rows.append((q, p, first is not None and p >= first and p == first))
    hits = spark.createDataFrame(rows, "question_id int, ctx_pos int, hit boolean")
    curve = [r["hits"] for r in QA.top_k_hits(hits).orderBy("k").collect()]
    assert curve == [1, 1, 2, 2]


def test_f1_and_em(spark):
    preds = spark.createDataFrame([("p", "the cat sat")], "pred_id string, prediction string")
    truths = spark.createDataFrame([("p", 1, "cat sat down"), ("p", 2, "The Cat sat!")],
                                   "pred_id string, truth_id int, truth string")
    r = QA.reader_scores(preds, truths).first()
    assert r["em"] == 1 and r["f1"] == pytest.approx(1.0)
    r = QA.reader_scores(preds, truths.filter("truth_id = 1")).first()
    assert r["em"] == 0 and r["f1"] == pytest.approx(0.8)


def test_weighted_average(spark):
    df = spark.createDataFrame([("k", 2.0, 1), ("k", 5.0, 3)], "key string, value double, weight int")
    r = ST.weighted_average(df).first()
    assert r["avg"] == pytest.approx(4.25) and r["total_weight"] == 4


def test_metrics_micro_case(spark):
    run = spark.createDataFrame([(1, "d0", 2.0), (1, "d1", 1.0)], "query_id int, doc_id string, score double")
    qrels = spark.createDataFrame([(1, "d1", 1)], "query_id int, doc_id string, relevance int")
    m = {(r["metric"], r["k"]): r["value"] for r in M.evaluate(run, qrels, [2]).collect()}
    assert m[("NDCG", 2)] == pytest.approx(100 * round(1 / math.log2(3), 5))
    assert m[("MRR", 2)] == pytest.approx(50.0)
    assert m[("R_cap", 2)] == pytest.approx(100.0)
    assert m[("Hole", 2)] == pytest.approx(50.0)
    # ideal run has NDCG 1
    ideal = spark.createDataFrame([(1, "d1", 5.0)], "query_id int, doc_id string, score double")
    m = {(r["metric"], r["k"]): r["value"] for r in M.evaluate(ideal, qrels, [1, 2]).collect()}
    assert m[("NDCG", 1)] == pytest.approx(100.0) and m[("NDCG", 2)] == pytest.approx(100.0)


def _dense_loss(S):
    S = np.asarray(S, dtype=float)
    B = len(S)

    def ce(M):
        m = M.max(axis=1, keepdims=True)
        lse = (m + np.log(np.exp(M - m).sum(axis=1, keepdims=True))).ravel()
        return (lse - np.diag(M)).mean()
    acc = (S.argmax(axis=1) == np.arange(B)).mean()
    return ce(S) + ce(S.T), acc


def test_lexical_loss_identity_scores(spark):
    # one token per document, weight 1, tf large -> S ~ I
    pairs = spark.createDataFrame([(0, 0, [7], [7] * 1000), (0, 1, [8], [8] * 1000)],
                                  "batch long, pos long, q_tokens array<int>, k_tokens array<int>")
    w = spark.createDataFrame([(7, 1.0), (8, 1.0)], "token int, weight double")
    r = CT.lexical_batch_loss(pairs, w, -50.0).first()  # e^beta ~ 0 -> saturation 1
    assert r["loss"] == pytest.approx(2 * math.log(1 + math.exp(-1)), abs=1e-6)
    assert r["acc"] == pytest.approx(1.0)


def test_lexical_loss_matches_dense(spark):
    rng = np.random.default_rng(3)
    B, V = 7, 30
    rows, wts = [], [(t, float(rng.normal())) for t in range(V)]
    for i in range(B):
        rows.append((0, i, [int(x) for x in rng.integers(0, V, 4)], [int(x) for x in rng.integers(0, V, 9)]))
    pairs = spark.createDataFrame(rows, "batch long, pos long, q_tokens array<int>, k_tokens array<int>")
    w = spark.createDataFrame(wts, "token int, weight double")
    beta = 0.3
    S = np.zeros((B, B))
    for d in range(B):
        tf = np.bincount(rows[d][3], minlength=V)
        for q in range(B):
            for t in set(rows[q][2]):
                if tf[t]:
                    S[d, q] += wts[t][1] * tf[t] / (tf[t] + math.exp(beta))
    want_loss, want_acc = _dense_loss(S)
    r = CT.lexical_batch_loss(pairs, w, beta).first()
    assert r["loss"] == pytest.approx(want_loss, abs=1e-9)
    assert r["acc"] == pytest.approx(want_acc)


def test_pooling(spark):
    from lexkit.operators import vectors as V
    rows = [(1, 0, [1.0, 2.0]), (1, 1, [3.0, 4.0]), (2, 0, [5.0, 6.0])]
    tv = spark.createDataFrame(rows, "g int, pos int, embedding array<double>")
    cls = {r["g"]: r["embedding"] for r in V.cls_pool(tv, "g").collect()}
    assert cls == {1: [1.0, 2.0], 2: [5.0, 6.0]}
    mean = V.as_arrays(V.mean_pool(tv.withColumnRenamed("pos", "vec_id"), "g"), "g").collect()
    assert {r["g"]: r["vec"] for r in mean} == {1: [2.0, 3.0], 2: [5.0, 6.0]}


def test_drop_pad(spark):
    from lexkit.operators import lexical as L
    df = spark.createDataFrame([(1, 1), (1, 5)], "doc_id int, token int")
    assert [r["token"] for r in L.drop_pad(df, 1).collect()] == [5]


def test_top_k_hits_per_file_and_report(spark):
    rows = []
    for f, firsts in (("a", [0, 1]), ("b", [None, 0, 2])):
        for q, first in enumerate(firsts):
            for p in range(3):
                rows.append((f, q, p, first is not None and p == first))
    hits = spark.createDataFrame(rows, "file string, question_id int, ctx_pos int, hit boolean")
    curve = QA.top_k_hits(hits, group_cols=["file"])
    got = {(r["file"], r["k"]): r["hits"] for r in curve.collect()}
    assert [got[("a", k)] for k in (1, 2, 3)] == [1, 2, 2]
    assert [got[("b", k)] for k in (1, 2, 3)] == [1, 1, 2]
    rec = QA.answer_recall_at(curve, ks=(1, 3), group_cols=["file"])
    rep = {r["k"]: r["values"] for r in QA.recall_report(rec, ks=(1, 3)).collect()}
    assert rep[1] == "50.0\t33.3" and rep[3] == "100.0\t66.7"
