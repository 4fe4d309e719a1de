"""Work that queries once left undone."""
from lexkit.plans import catalog


def test_every_question_is_checked(spark, tmp_path):
    passages = {0: "the red fox", 1: "the blue whale", 2: "the grey owl", 3: "the lost shoe", 4: "zzz yyy", 5: "xxx www"}
    texts = [f"here {passages[i]} sleeps" for i in (0, 1, 2)] + [f"the other text {i}" for i in range(5)]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)],
                          "doc_id bigint, text string, lang string, source string, n_chars bigint") \
         .write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(passages.items()), "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = catalog.qa_results_recall(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [(5, "66.7\t33.3")]


def test_training_takes_every_batch_of_the_epoch(spark):
    sf = "/root/testdata/sf0.001"
    batches = catalog._lexical_pairs(spark, sf)[0].select("batch").distinct().count()
    log = catalog.train_lexical_log(spark, sf).collect()
    assert batches > 3 and [r["step"] for r in log] == list(range(1, batches + 1))
    assert log[-1]["lr"] == catalog.TRAIN_LR * ((batches - 1) / catalog.TRAIN_WARMUP)
