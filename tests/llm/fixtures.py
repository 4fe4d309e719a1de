"""Small tables with the awkward rows every operator must take."""
import random
import tempfile
import uuid

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, row int, size string, shard int, _row int, label string"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def rows(seed=3, n=60):
    rng = random.Random(seed)
    out = [(i, ". ".join(words(rng, rng.randrange(3, 40)).capitalize() for _ in range(4)) + ".\n" + words(rng, 12),
            "en", f"s{i % 4}") for i in range(n)]
    out[5] = (5, out[4][1], "en", "s0")                                     # exact copy
    out[6] = (6, out[4][1] + " tail", "en", None)                            # near copy, null source
    out[7] = (7, out[4][1].upper(), "en", "")                                # same words, other case
    out += [(100, None, None, None), (101, "", "en", "s1"), (102, " \n\t\x0b ", "en", "s1"), (103, "two words", None, "s2"),
            (104, words(rng, 30_000), "en", "s0"), (None, words(rng, 20), "en", "s3"), (None, None, None, "s3"),
            (105, "é ü ñ — 漢字 " * 30, "xx", "s2"), (106, "x" * 5000, "en", "s2"), (107, "a  b   c\r\n d <|endoftext|>", "en", "s2"),
            (8, out[8][1], "en", "s0"), (8, out[8][1], "en", "s0")]            # repeated rows
    return [(i, t, lang, s, None if t is None else len(t), 1, "big", 2, 3, "l") for i, t, lang, s in out]


def stored(spark, data, schema=COLUMNS):
    path = f"{tempfile.mkdtemp(prefix='lexkit-llm-')}/{uuid.uuid4().hex}"
    spark.createDataFrame(data, schema).repartition(3).write.parquet(path)
    return spark.read.parquet(path)
