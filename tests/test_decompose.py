"""F2 in the JVM against Python's own normalisation."""
import random
import unicodedata

from pyspark.sql import functions as F

from lexkit.functions.decompose import nfd


def both(spark, texts):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["n"] for r in d.select("i", nfd("t").alias("n")).collect()}
    return [got[i] for i in range(len(texts))]


def test_every_code_point(spark):
    """Blocks of 512 code points, each between plain letters."""
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"
              and unicodedata.category(chr(c)) != "Co"]
    texts = ["x".join(map(chr, points[i:i + 512])) for i in range(0, len(points), 512)]
    assert both(spark, texts) == [unicodedata.normalize("NFD", t) for t in texts]


def test_runs_of_marks_and_odd_texts(spark):
    rng = random.Random(4)
    pool = [chr(c) for c in (*range(0x300, 0x345), 0x5B0, 0x5C1, 0x64B, 0x651, 0x3099, 0x1D165, 0x1D16D, 0x1D160)]
    pool += list("aéềǭ각하한 \n$^") + ["ᄒ", "̈́", "\U0001F600"]
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 40))) for _ in range(400)]
    texts += ["", "plain", None, "é" * 50_000, "a" + "̣́" * 2_000]
    assert both(spark, texts) == [t if t is None else unicodedata.normalize("NFD", t) for t in texts]


def test_no_python_in_the_plan(spark):
    d = spark.createDataFrame([("é",)], "t string").select(nfd(F.col("t")).alias("n"))
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
