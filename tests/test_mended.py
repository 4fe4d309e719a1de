"""Cases that earlier plans got wrong: large ordered indexes, token-less
documents, questions without passages, self-hits, negative weights, null ids."""
import tempfile

import pytest
from pyspark.sql import functions as F

from lexkit.operators import lexical as L
from lexkit.operators import qa as QA
from lexkit.operators import training as TR
from lexkit.operators import windows as W
from lexkit.sources import readers as RD


def test_ordered_index_beyond_the_sampler(spark):
    n = 500_000
    d = spark.range(n, numPartitions=1).select(F.xxhash64("id").alias("k"), "id", F.lit("payload").alias("p"))
    got = W.ordered_index(d, [F.col("k")], out="ix")
    r = got.agg(F.count(F.lit(1)), F.countDistinct("ix"), F.min("ix"), F.max("ix")).first()
    assert tuple(r) == (n, n, 0, n - 1)
    assert got.columns == ["k", "id", "p", "ix"]
    assert W.ordered_index(got, [F.col("ix")], out="again").filter("again <> ix").isEmpty()


def test_ordered_prefix_groups_and_weights(spark):
    d = spark.range(20_000).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"), (F.col("id") % 7).alias("w"))
    got = W.ordered_prefix(d, [F.col("id")], ["g"], "w", "before").collect()
    sums: dict = {}
    for r in sorted(got, key=lambda r: r["id"]):
        assert r["before"] == sums.get(r["g"], 0)
        sums[r["g"]] = sums.get(r["g"], 0) + r["w"]
    assert len(got) == 20_000


def test_tokenless_documents_count(spark):
    c = spark.createDataFrame([(1, "alpha beta"), (2, "alpha"), (3, "")], "doc_id bigint, text string")
    p = L.written_postings(c)
    s = L.corpus_stats(p)
    assert tuple(p.select(s.n_docs, s.avgdl).first()) == (3.0, 1.0)
    idf = {r["token"]: r["idf"] for r in L.idf_table(p, s.n_docs).collect()}
    assert idf == pytest.approx({r["token"]: r["idf"] for r in L.build_idf(c).collect()})


def test_recall_counts_questions_without_passages(spark):
    ctxs = spark.createDataFrame([(1, 0, "the answer here")], "question_id bigint, ctx_pos int, text string")
    answers = spark.createDataFrame([(1, "answer"), (2, "answer")], "question_id bigint, answer string")
    curve = QA.top_k_hits(QA.passage_hits(ctxs, answers), questions=answers).collect()
    assert [(r["k"], r["hits"], r["recall"]) for r in curve] == [(1, 1, 0.5)]


def test_negative_weights_rank_below_unscored(spark):
    c = spark.createDataFrame([(1, "a b"), (2, "a"), (3, "c")], "doc_id bigint, text string")
    q = spark.createDataFrame([(9, "a")], "query_id bigint, text string")
    w = spark.createDataFrame([("a", -1.0)], "token string, weight double")
    assert [r["doc_id"] for r in L.learned_search(c, q, w, 0.0, 3).orderBy("rank").collect()] == [3, 1, 2]
    assert L.learned_search(c, q, w, 0.0, 3, fill_zero=False).count() == 2


def test_self_hits_leave_before_the_cut(spark):
    c = spark.createDataFrame([(1, "a a"), (2, "a b"), (3, "a c d")], "doc_id bigint, text string")
    q = spark.createDataFrame([(1, "a")], "query_id bigint, text string")
    assert [r["doc_id"] for r in L.bm25_search(c, q, 2, exclude_self=True).orderBy("rank").collect()] == [2, 3]


def test_null_ids_and_missing_path(spark, tmp_path):
    (tmp_path / "p.tsv").write_text("id\ttext\ttitle\n\tx\ty\n1\tz\tt\n")
    assert sorted((r["id"] or "", r["text"]) for r in RD.read_passages(spark, str(tmp_path / "p.tsv")).collect()) == [("", "x"), ("1", "z")]
    assert RD.read_passages(spark, str(tmp_path / "none.tsv")).count() == 0


def test_latest_saved_parameters(spark):
    root = tempfile.mkdtemp()
    weights = spark.createDataFrame([("a", 1.0, 0.0, 0.0)], "token string, weight double, m double, v double")
    TR.save_model(TR.LexicalModel(weights, 0.9, step=3), root)
    TR.save_model(TR.LexicalModel(weights.withColumn("weight", F.lit(2.0)), 0.1, step=3), root)
    m = TR.load_model(spark, root)
    assert (m.beta, m.step, m.weights.first()["weight"]) == (0.1, 3, 2.0)


def test_common_tokens_is_a_multiset(spark):
    d = spark.createDataFrame([(1, ["a", "a", "b"], ["a", "a", "a", "c"]), (2, [], ["a"]), (3, [], []), (4, ["x", "y", "x"], ["x", "y", "x"])],
                              "i int, x array<string>, y array<string>")
    d = QA.with_occurrences(QA.with_occurrences(d, "x", "a"), "y", "b")
    assert {r["i"]: r["n"] for r in d.select("i", QA.common_tokens(F.col("a"), F.col("b")).alias("n")).collect()} == {1: 2, 2: 0, 3: 0, 4: 3}


def test_reader_scores_is_linear_in_the_text(spark):
    """A text of 40,000 words takes seconds, not minutes, and scores as it should."""
    import time
    text = " ".join(f"w{i % 9000}" for i in range(40_000))
    p = spark.createDataFrame([(1, text), (2, ""), (3, "x y")], "pred_id int, prediction string")
    t = spark.createDataFrame([(1, 1, text + " more"), (1, 2, "none"), (2, 1, ""), (3, 1, "y z")], "pred_id int, truth_id int, truth string")
    t0 = time.time()
    got = {r["pred_id"]: (r["em"], round(r["f1"], 6)) for r in QA.reader_scores(p, t).collect()}
    assert got == {1: (0, round(80_000 / 80_001, 6)), 2: (1, 0.0), 3: (0, 0.5)} and time.time() - t0 < 30
