"""Gradient of the lexical trainer vs finite differences; PQ vs exact search."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexkit.functions import arrays as A
from lexkit.operators import contrastive as CT
from lexkit.operators import sampling as SM
from lexkit.operators import training as TR
from lexkit.operators import vectors as V


def test_gradient_matches_finite_differences(spark):
    rng = np.random.default_rng(5)
    B, Vv = 6, 12
    rows = [(0, i, [int(x) for x in rng.integers(0, Vv, 3)], [int(x) for x in rng.integers(0, Vv, 6)])
            for i in range(B)]
    pairs = spark.createDataFrame(rows, "batch long, pos long, q_tokens array<int>, k_tokens array<int>")
    w0 = {t: float(rng.normal()) for t in range(Vv)}
    beta = 0.2

    def loss(wd, b):
        w = spark.createDataFrame(list(wd.items()), "token int, weight double")
        return CT.lexical_batch_loss(pairs, w, b).first()["loss"]

    wdf = spark.createDataFrame([(t, v, 0.0, 0.0) for t, v in w0.items()], "token int, weight double, m double, v double")
    gw, gb = TR.step_gradients(pairs, wdf, beta)
    g = {r["token"]: r["g"] for r in gw.collect()}
    eps = 1e-5
    for t in list(w0)[:5]:
        up, dn = dict(w0), dict(w0)
        up[t] += eps
        dn[t] -= eps
        fd = (loss(up, beta) - loss(dn, beta)) / (2 * eps)
        assert g.get(t, 0.0) == pytest.approx(fd, abs=1e-6)
    fdb = (loss(w0, beta + eps) - loss(w0, beta - eps)) / (2 * eps)
    assert gb == pytest.approx(fdb, abs=1e-6)


def test_adamw_step_decreases_loss(spark):
    rows = [(0, i, [i, 10 + i], [i, i, 10 + i, 20]) for i in range(5)]
    pairs = spark.createDataFrame(rows, "batch long, pos long, q_tokens array<int>, k_tokens array<int>")
    vocab = spark.createDataFrame([(t,) for t in list(range(5)) + list(range(10, 15)) + [20]], "token int")
    model = TR.init_model(vocab, 1)
    l0 = CT.lexical_batch_loss(pairs, model.weights, model.beta).first()["loss"]
    model = TR.train_lexical(pairs, model, 5, base_lr=0.1, warmup=0, total=5)
    l1 = CT.lexical_batch_loss(pairs, model.weights, model.beta).first()["loss"]
    assert l1 < l0
    assert [s for s, *_ in model.log] == [1, 2, 3, 4, 5]


def test_pq_with_enough_codes_is_exact(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(6, 8))
    vecs = spark.createDataFrame([(i, [float(x) for x in base[i]]) for i in range(6)], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(100 + j, [float(x) for x in rng.normal(size=8)]) for j in range(3)],
                                    "query_id long, vec array<double>")
    book = V.pq_train(vecs, 2, bits=3, seed=1)   # 8 codes >= 6 distinct sub-vectors
    codes = V.pq_encode(vecs, book)
    pq = {(r["query_id"], r["vec_id"]): r["score"] for r in V.pq_search(queries, codes, book, 6).collect()}
    exact = {(r["query_id"], int(r["vec_id"])): r["score"] for r in V.flat_ip_search(queries, vecs, 6).collect()}
    assert set(pq) == set(exact)
    for k, v in exact.items():
        assert pq[k] == pytest.approx(v, abs=1e-9)


def test_flat_search_matches_relational_form(spark):
    rng = np.random.default_rng(4)
    vecs = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=5)]) for i in range(40)],
                                 "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(j, [float(x) for x in rng.normal(size=5)]) for j in range(4)],
                                    "query_id long, vec array<double>")
    fast = {(r["query_id"], int(r["vec_id"])): r["score"] for r in V.flat_ip_search(queries, vecs, 3).collect()}
    rel = V.ip_scores_sql_form(queries, vecs)
    from lexkit.operators.windows import top_k_per_key
    slow = {(r["query_id"], r["vec_id"]): r["score"]
            for r in top_k_per_key(rel, 3, key_col="query_id", doc_col="vec_id").collect()}
    assert fast.keys() == slow.keys()
    for k in fast:
        assert fast[k] == pytest.approx(slow[k])


def test_segments_take_the_steps_one_by_one(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(8)
    word = lambda: f"t{rng.integers(0, 30)}"
    rows = [(b, i, [word() for _ in range(4)], [word() for _ in range(rng.integers(0, 9))]) for b in range(3) for i in range(4)]
    pairs = spark.createDataFrame(rows, "batch long, pos long, q_tokens array<string>, k_tokens array<string>").coalesce(1)
    vocab = spark.createDataFrame([(f"t{i}",) for i in range(40)], "token string").coalesce(1)
    one = TR.init_model(vocab, 1)
    for i in range(3):
        stats, grad, by_beta = TR.batch_scores.loss_and_gradients(pairs.filter(F.col("batch") == i), one.weights, one.beta)
        r = stats.first()
        one.log.append(pytest.approx((i + 1, r["loss"], r["acc"], TR.lr_at(i, 0.05, 2, 3)), abs=1e-9))
        one = TR.adamw(one, grad, by_beta, one.log[-1].expected[3])
    # no jobs of its own for a step; two segments: batches of 4 + 4 and of 4 pairs
    monkeypatch.setattr(TR.batch_scores, "loss_and_gradients", None)
    monkeypatch.setattr(TR, "SEGMENT_PAIRS", 9)
    got = TR.train_lexical(pairs, TR.init_model(vocab, 1), 3, 0.05, 2, save_dir=f"{tmp_path}/m", save_every=2)
    state = lambda m: {r["token"]: (r["weight"], r["m"], r["v"]) for r in m.weights.collect()}
    assert state(got) == {t: pytest.approx(x, abs=1e-9) for t, x in state(one).items()} and len(state(got)) == 40
    assert got.log == one.log and [got.beta, got.beta_m, got.beta_v] == pytest.approx([one.beta, one.beta_m, one.beta_v], abs=1e-9)
    assert sorted(r["step"] for r in spark.read.parquet(f"{tmp_path}/m/params").collect()) == [1, 2, 3]


def plan(df):
    return df._jdf.queryExecution().toString()


def test_ids_are_made_without_a_row_per_occurrence(spark, monkeypatch):
    monkeypatch.setattr(SM, "CHUNK_TOKENS", 5)
    rows = [(1, "s", "b a b"), (2, "s", None), (3, None, "c a"), (4, "t", ""), (5, "t", "a , b c d e f g"), (1, "s", "a d"), (1, "t", "g")]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string").coalesce(1)
    ids, vocab = SM.token_id_corpus(docs, "source")
    number = {r["token"]: r["id"] for r in vocab.collect()}
    assert number == {t: i for i, t in enumerate([",", *"abcdefg"], 1)}
    got = {(r["dataset_id"], r["row_id"]): [" ,abcdefg"[i] for i in r["input_ids"]] for r in ids.collect()}
    # rows of one key make one row, in order of position
    assert got == {("s", 1): list("abadb"), ("s", 2): [], (None, 3): list("ca"), ("t", 4): [], ("t", 5): list("a,bcdefg"), ("t", 1): ["g"]}
    assert "Exchange" not in plan(ids) and "Generate" not in plan(ids)


def test_elements_are_shuffled_in_their_row(spark):
    rows = [(i, list(range(100 * i, 100 * i + 7 * i))) for i in range(6)] + [(None, [1, 2])]
    df = spark.createDataFrame(rows, "row_id bigint, ids array<int>")
    out = SM.shuffle_tokens_rows(df, "row_id", "ids", 0.6, 5, "s", "new")
    assert "Exchange" not in plan(out)
    both = out.withColumn("old", A.shuffle_tokens("ids", 0.6, 5, "s", F.col("row_id"))).collect()
    assert all(r["new"] == (r["old"] if r["row_id"] is not None else []) for r in both) and any(r["new"] != r["ids"] for r in both)
