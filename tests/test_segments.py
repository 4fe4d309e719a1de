"""Training by segments, searches of stored retrievers and block maxima at size."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexkit.operators import block_max as BM
from lexkit.operators import lexical as L
from lexkit.operators import training as TR
from lexkit.operators.store import build_retriever, load_retriever, save_retriever


def ranking(df):
    return sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 8)) for r in df.collect())


def test_saves_do_not_cut_a_segment(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(5)
    word = lambda: f"t{rng.integers(0, 25)}"
    rows = [(b, i, [word() for _ in range(5)], [word() for _ in range(rng.integers(0, 9))] + [None]) for b in range(7) for i in range(3)]
    pairs = spark.createDataFrame(rows, "batch long, pos long, q_tokens array<string>, k_tokens array<string>").coalesce(1)
    vocab = spark.createDataFrame([(f"t{i}",) for i in range(30)], "token string").coalesce(1)      # t25 to t29 are in no text
    one, states = TR.init_model(vocab, 1), {}
    state = lambda m: {r["token"]: (r["weight"], r["m"], r["v"]) for r in m.weights.collect()}
    for i in range(7):
        _, grad, by_beta = TR.batch_scores.loss_and_gradients(pairs.filter(F.col("batch") == i), one.weights, one.beta)
        one = TR.adamw(one, grad, by_beta, TR.lr_at(i, 0.05, 2, 7))
        states[i + 1] = state(one), one.beta
    taken, take = [], TR.take_segment
    monkeypatch.setattr(TR, "take_segment", lambda *a: taken.append(1) or take(*a))
    TR.train_lexical(pairs, TR.init_model(vocab, 1), 7, 0.05, 2, save_dir=f"{tmp_path}/m", save_every=2)
    assert len(taken) == 1
    for step in (1, 2, 4, 6, 7):
        back = TR.load_model(spark, f"{tmp_path}/m", step)
        weights, beta = states[step]
        assert state(back) == {t: pytest.approx(x, abs=1e-9) for t, x in weights.items()} and back.beta == pytest.approx(beta, abs=1e-9)


def test_steps_without_a_gradient_at_once():
    rng = np.random.default_rng(2)
    w, m, v = rng.random(50), rng.normal(size=50) * 10.0 ** rng.integers(-12, 1, 50), rng.random(50) * 10.0 ** rng.integers(-24, 1, 50)
    m[:9] = v[:9] = 0.0
    for first in (0, 3, 900):
        lrs = [TR.lr_at(first + i, 0.01, 12, 2000) for i in range(700)]
        x = w, m, v
        for i, lr in enumerate(lrs):
            x = TR.adamw_arrays(*x, 0.0, first + i + 1, lr)
        for got, want in zip(TR.idle_steps(w, m, v, first, lrs), x, strict=True):
            assert np.allclose(got, want, rtol=1e-11, atol=1e-13)


def test_a_learned_search_makes_no_row_per_pair(spark, monkeypatch, tmp_path):
    rng = random.Random(3)
    word = lambda: f"w{min(int(rng.expovariate(0.2)), 40)}"
    docs = spark.createDataFrame([(i, " ".join(word() for _ in range(rng.randrange(0, 12)))) for i in range(200)], "doc_id bigint, text string")
    qs = spark.createDataFrame([(i, " ".join(word() for _ in range(4))) for i in range(12)] + [(50, "w90"), (51, "w39 w40")], "query_id bigint, text string")
    weights = spark.createDataFrame([(f"w{i}", (i % 5) - 1.0) for i in range(41)], "token string, weight double")
    save_retriever(build_retriever(docs, "learned", weights, 0.4), f"{tmp_path}/r")
    learned = load_retriever(spark, f"{tmp_path}/r", "learned")
    asked, score = [], L.score
    monkeypatch.setattr(L, "score", lambda p, w, *a: asked.append({r[0] for r in w.select("query_id").distinct().collect()}) or score(p, w, *a))
    got = ranking(learned.search(qs, 5))
    assert len(asked) == 1 and len(asked[0]) < 12           # only queries with too few documents above 0
    monkeypatch.setattr(L, "score", score)
    assert got == ranking(L.learned_search(docs, qs, weights, 0.4, 5))


def test_cells_are_packed_where_documents_lie(spark, monkeypatch):
    rng = random.Random(6)
    text = lambda n: " ".join(f"w{min(int(rng.expovariate(0.3)), 30)}" for _ in range(n))
    docs = spark.createDataFrame([(i, text(rng.randrange(1, 30))) for i in range(800)] + [(None, "w1 w2")], "doc_id bigint, text string")
    qs = spark.createDataFrame([(i, text(6)) for i in range(25)], "query_id bigint, text string")
    monkeypatch.setattr(BM, "CELL_POSTINGS", 100)
    monkeypatch.setattr(BM, "TASK_CELLS", 1000)
    posts = L.written_postings(docs)
    index = BM.block_index(posts, 8)
    weights = L.bm25_query_weights(L.query_terms(qs), L.idf_table(posts, index.stats.n_docs))
    cells = BM.packed_cells(index, weights.groupBy("token").agg(F.sum("weight").alias("worth")))
    sizes = [len(r["dr"]) for r in cells.select("dr").collect()]
    assert len(sizes) > 30 and max(sizes) <= index.cell_postings
    assert "hashpartitioning(doc_id" not in cells._jdf.queryExecution().toString()       # bucketed postings stay where they are
    pairs = BM.scored_pairs(index, weights, 3)
    assert pairs.count() <= 25 * 3 * 2 * spark.sparkContext.defaultParallelism
    assert ranking(BM.top_k_per_key(pairs, 3)) == ranking(L.top_k_per_key(L.score(posts, weights, L.bm25_doc_term(index.stats)), 3))
