"""Stored retrievers, the sampled statistics job and the blocked batch scores."""
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexkit.functions.hashing import uniform
from lexkit.operators import agreement as AG
from lexkit.operators import batch_scores as BS
from lexkit.operators import block_max as BM
from lexkit.operators import lexical as L
from lexkit.operators import sampling as SM
from lexkit.operators.store import _table_name, build_retriever, load_retriever, save_retriever


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(0, 30)))) for i in range(60)] + [(60, ""), (61, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame([(1, "w1 w2 w3 w1"), (2, "w7"), (3, "unknown")], "query_id bigint, text string")


def ranking(df):
    return sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 9)) for r in df.collect())


def test_a_stored_retriever_searches_like_a_fresh_one(spark, corpus, questions, tmp_path):
    root = str(tmp_path / "r")
    assert save_retriever(build_retriever(corpus, "bm25"), root) == 1
    weights = spark.createDataFrame([(f"w{i}", i / 10 - 1.5) for i in range(40)], "token string, weight double")
    assert save_retriever(build_retriever(corpus, "learned", weights, 0.4), root) == 2
    bm25, learned = load_retriever(spark, root, "bm25"), load_retriever(spark, root, "learned")
    assert (bm25.version, learned.version, learned.beta) == (1, 2, 0.4)
    assert ranking(bm25.search(questions, 5)) == ranking(L.bm25_search(corpus, questions, 5))
    assert ranking(learned.search(questions, 5)) == ranking(L.learned_search(corpus, questions, weights, 0.4, 5))
    assert save_retriever(build_retriever(corpus, "bm25"), root) == 3 and load_retriever(spark, root, "bm25").version == 3
    assert load_retriever(spark, root, "bm25", 1).version == 1


def test_postings_of_a_stored_retriever_keep_their_buckets(spark, corpus, questions, tmp_path):
    root = str(tmp_path / "r")
    save_retriever(build_retriever(corpus, "bm25"), root)
    spark.sql(f"DROP TABLE {_table_name(f'{root}/version=1')}")
    posts = load_retriever(spark, root, "bm25").posts           # another session: defined anew over the files
    plan = posts.groupBy("doc_id").count()._jdf.queryExecution().toString()
    assert "Exchange" not in plan.split("Physical Plan")[1]


def test_only_finished_and_whole_versions_are_read(spark, corpus, tmp_path):
    root = str(tmp_path / "r")
    with pytest.raises(FileNotFoundError):
        load_retriever(spark, root, "bm25")
    with pytest.raises(ValueError):
        build_retriever(corpus, "learned")
    save_retriever(build_retriever(corpus, "bm25"), root)
    with pytest.raises(FileNotFoundError):
        load_retriever(spark, root, "learned")
    spark.range(3).write.parquet(f"{root}/version=2/weights")     # left by a writer that was lost
    assert load_retriever(spark, root, "bm25").version == 1
    assert save_retriever(build_retriever(corpus, "bm25"), root) == 2
    spark.createDataFrame([("x", 1.0)], "token string, weight double").write.mode("append").parquet(f"{root}/version=2/weights")
    with pytest.raises(AssertionError):
        load_retriever(spark, root, "bm25")


def test_sampled_counts_equal_row_by_row_draws(spark):
    rng = random.Random(4)
    rows = [(f"d{i % 3}", i, [f"t{rng.randrange(30)}" for _ in range(rng.randrange(0, 25))]) for i in range(40)] + [("one", 99, ["a", "b", "a"])]
    corpus = spark.createDataFrame(rows, "dataset_id string, row_id bigint, tokens array<string>")
    offsets = SM.epoch_offsets(corpus, [1], 8, 5)
    got = {r["token"]: (r["df"], r["idf"]) for r in SM.sampled_idf(corpus, offsets, 8, 0.3, 0.9, 4, 0.0, 5, pad_token="t3").collect()}
    n = len(rows) // 4 * 4
    draws = SM.sample_rows(spark.range(n).withColumnRenamed("id", "draw_id"), "draw_id", corpus, 0.0, 5).collect()
    us = {r["id"]: (r["r"], r["s"]) for r in spark.range(n).select(
        "id", uniform(5, "k:ratio", F.col("id")).alias("r"), uniform(5, "k:start", F.col("id")).alias("s")).collect()}
    at, tokens = {r["dataset_id"]: r["offset"] for r in offsets.collect()}, {(d, i): t for d, i, t in rows}
    df = Counter()
    for r in draws:
        chunk = tokens[r["dataset_id"], r["row_id"]][at[r["dataset_id"]]:at[r["dataset_id"]] + 8]
        ratio, u = us[r["draw_id"]]
        length = math.floor(len(chunk) * (0.3 + (0.9 - 0.3) * ratio))
        start = math.floor(u * (len(chunk) - length + 1))
        df.update(set(chunk[start:start + length]))
    del df["t3"]
    want = {t: (df[t], pytest.approx(math.log(1 + (len(rows) - df[t] + 0.5) / (df[t] + 0.5)))) for _, _, ts in rows for t in ts}
    assert got == want and len(draws) == n and sum(df.values()) > 20


def test_batches_of_several_blocks_score_like_one_block(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(b, i, [f"t{rng.randrange(12)}" for _ in range(4)], [",", *(f"t{rng.randrange(12)}" for _ in range(rng.randrange(0, 9)))])
            for b, n in ((0, 11), (1, 3), (2, 1)) for i in range(n)]
    pairs = spark.createDataFrame(rows, "batch bigint, pos bigint, q_tokens array<string>, k_tokens array<string>")
    w = spark.createDataFrame([(f"t{i}", rng.uniform(-1, 2)) for i in range(12)] + [(",", 0.1)], "token string, weight double")

    def result():
        loss, grad, b = BS.loss_and_gradients(pairs, w, 0.3)
        return ({r["batch"]: (pytest.approx(r["loss"]), r["acc"]) for r in loss.collect()},
                {r["token"]: pytest.approx(r["g"], abs=1e-9) for r in grad.collect()}, pytest.approx(b))

    one = result()
    monkeypatch.setattr(BS, "DOC_BLOCK", 4)
    loss, grad, b = BS.loss_and_gradients(pairs, w, 0.3)
    assert ({r["batch"]: (r["loss"], r["acc"]) for r in loss.collect()}, {r["token"]: r["g"] for r in grad.collect()}, b) == one


@pytest.mark.parametrize("band", [None, 3, 7])
def test_inversions_over_bands(spark, band):
    rng = np.random.default_rng(3)
    lists = {"a": rng.permutation(50).tolist(), "b": rng.integers(0, 9, 40).tolist(), "c": [0], "d": list(range(20))[::-1]}
    rows = [(k, p, g) for k, v in lists.items() for p, g in enumerate(v)]
    got = {r["list_id"]: r["inversions"] for r in AG.inversions(
        spark.createDataFrame(rows, "list_id string, pos bigint, gold bigint"), band).collect()}
    assert got == {k: sum(v[i] > v[j] for j in range(len(v)) for i in range(j)) for k, v in lists.items()}


def test_block_max_search_is_exact_and_skips(spark):
    rng = random.Random(9)
    zipf = lambda: f"w{int(rng.paretovariate(0.6)) % 3000}"
    docs = spark.createDataFrame([(i, " ".join(zipf() for _ in range(rng.randrange(0, 60)))) for i in range(1500)] + [(2000, None)],
                                 "doc_id bigint, text string")
    qs = spark.createDataFrame([(i, " ".join(zipf() for _ in range(rng.randrange(1, 6)))) for i in range(40)] + [(90, "unseen")],
                               "query_id bigint, text string")
    posts = L.written_postings(docs)
    for k in (1, 10):
        assert ranking(BM.block_max_search(posts, qs, k, block_docs=16)) == ranking(L.bm25_search(docs, qs, k, posts=posts))
    index = BM.block_index(posts, 16)
    weights = L.bm25_query_weights(L.query_terms(qs), L.idf_table(posts, index.stats.n_docs))
    every = L.score(posts, weights, L.bm25_doc_term(index.stats)).count()
    assert BM.scored_pairs(index, weights, 3).count() < every / 2


def test_block_max_search_hands_on_k_documents_of_a_cell(spark, monkeypatch):
    """Common words keep every block's bound high: blocks are scored, but no row per pair leaves a cell."""
    rng = random.Random(4)
    text = lambda n: " ".join(f"w{min(int(rng.expovariate(0.3)), 30)}" for _ in range(n))
    texts = [text(rng.randrange(1, 40)) for _ in range(300)]
    docs = spark.createDataFrame([(i, texts[i % 300]) for i in range(600)], "doc_id bigint, text string")
    qs = spark.createDataFrame([(f"q{i}", text(8)) for i in range(30)] * 2 + [(None, "w1")], "query_id string, text string")
    for name, size in {"CELL_POSTINGS": 700, "SLICE_TERMS": 60, "PACK_TERMS": 20, "QUERIES": 4, "PANEL_DOCS": 40, "JOINED": 50}.items():
        monkeypatch.setattr(BM, name, size)
    posts = L.written_postings(docs)
    index = BM.block_index(posts, 8)
    assert index.cells > 5
    weights = L.bm25_query_weights(L.query_terms(qs.filter("query_id IS NOT NULL")), L.idf_table(posts, index.stats.n_docs))
    mixed = weights.withColumn("weight", F.col("weight") - 1.0)         # of either sign
    for w in (weights, mixed):
        pairs = BM.scored_pairs(index, w, 3)
        assert ranking(BM.top_k_per_key(pairs, 3)) == ranking(L.top_k_per_key(L.score(posts, w, L.bm25_doc_term(index.stats)), 3))
        assert pairs.count() <= 30 * 3 * index.cells
    assert ranking(BM.block_max_search(posts, qs, 3, index=index)) == ranking(L.bm25_search(docs, qs.filter("query_id IS NOT NULL"), 3, posts=posts))


def test_a_retriever_from_written_tokens_reads_no_text(spark, questions, tmp_path):
    """Tokens of the text serve the titled corpus, too; BM25 is searched without a row per pair."""
    rows = [(1, "A\u03a3 title", "w1 W2, w2"), (2, "", "w2 w7"), (3, None, "w3"), (4, "only", None), (5, None, None), (1, "A\u03a3 title", "w1 W2, w2")]
    docs = spark.createDataFrame(rows, "doc_id bigint, title string, text string")
    toks = L.titled_tokens(docs.select("doc_id", "title", L.analyze(F.col("text")).alias("tokens")))
    as_rows = lambda df: sorted(map(str, df.select("doc_id", "tokens", "dl").collect()))
    assert as_rows(toks) == as_rows(L.doc_tokens(docs, title_col="title"))
    weights = spark.createDataFrame([("w1", 2.0), ("w2", 0.0), ("w3", 1.0), ("w7", -1.0)], "token string, weight double")
    fresh = build_retriever(docs, "bm25", weights, doc_title="title")
    lazy = build_retriever(docs.select("doc_id"), "bm25", weights, toks=toks)
    assert (lazy.n_docs, lazy.avgdl) == (fresh.n_docs, fresh.avgdl)
    save_retriever(lazy, str(tmp_path / "t"))
    loaded = load_retriever(spark, str(tmp_path / "t"), "bm25")
    terms = L.learned_query_weights(L.query_terms(questions), weights)
    every = L.score(fresh.posts, terms, L.bm25_doc_term(L.CorpusStats(F.lit(float(fresh.n_docs)), F.lit(fresh.avgdl))))
    for exclude in (False, True):
        want = ranking(L.top_k_per_key(L.without_own(every, exclude), 2))
        assert want and ranking(loaded.search(questions, 2, exclude)) == ranking(fresh.search(questions, 2, exclude)) == want


def test_average_length_of_a_batch(spark):
    docs = spark.createDataFrame([(i, "x " * (i % 5 + 1)) for i in range(10)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["avgdl"] for r in L.batch_average_length(docs, L.written_postings(docs), 4).collect()}
    order = sorted(range(10), key=lambda i: (-(i % 5), i))
    assert got == {i: pytest.approx(np.mean([j % 5 + 1 for j in order[b:b + 4]])) for b in (0, 4, 8) for i in order[b:b + 4]}
