"""Model save / load, run and log writers."""
import os
import tempfile

from pyspark.sql import functions as F

from lexkit.operators import training as TR
from lexkit.sources import readers as RD


def test_save_load_latest(spark):
    d = tempfile.mkdtemp(prefix="lexkit-model-")
    rows = [(0, i, [i, 10 + i], [i, i, 10 + i]) for i in range(4)]
    pairs = spark.createDataFrame(rows, "batch long, pos long, q_tokens array<int>, k_tokens array<int>")
    vocab = spark.createDataFrame([(t,) for t in list(range(4)) + list(range(10, 14))], "token int")
    m = TR.init_model(vocab, 2)
    m = TR.train_lexical(pairs, m, 3, base_lr=0.05, warmup=0, total=3, save_dir=d, save_every=2)
    back = TR.load_model(spark, d, "latest")
    assert back.step == 3 and abs(back.beta - m.beta) < 1e-12
    a = {r["token"]: r["weight"] for r in m.weights.collect()}
    b = {r["token"]: r["weight"] for r in back.weights.collect()}
    assert a == b
    first = TR.load_model(spark, d, 1, reset_params=True)
    assert first.step == 1 and first.weights.agg(F.max("m")).first()[0] == 0.0
    log = TR.training_log(spark, m)
    RD.append_training_log(log, os.path.join(d, "log"))
    RD.append_training_log(log, os.path.join(d, "log"))
    assert spark.read.parquet(os.path.join(d, "log")).count() == 6


def test_write_run(spark):
    d = tempfile.mkdtemp(prefix="lexkit-run-")
    run = spark.createDataFrame([(1, 2, 0.5, 1)], "query_id long, doc_id long, score double, rank int")
    RD.write_run(run, os.path.join(d, "run"))
    assert spark.read.parquet(os.path.join(d, "run")).count() == 1
