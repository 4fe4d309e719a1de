"""Worked micro-cases for the column functions and small operators."""
import math

import pytest
from pyspark.sql import functions as F

from lexkit.functions import arrays as A
from lexkit.functions import schedules as SCH
from lexkit.functions import scoring as S
from lexkit.functions import text as T


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_normalize_text_edge_row(spark):
    src = "a–b ‘c’ “d” e… f . . . g ⁗ h­\u0010i\u0001j\u000bk∕l＋m"
    want = "a-b 'c' \"d\" e... f ... g '''' h\u0010ij k/l＋m"
    assert one(spark, T.normalize_text(F.lit(src))) == want


def test_normalize_answer(spark):
    assert one(spark, T.normalize_answer(F.lit("The  U.S.A., an Apple!"))) == "usa apple"
    assert one(spark, T.normalize_answer(F.lit("a a a the cat"))) == "cat"


def test_simple_tokenize(spark):
    assert one(spark, T.simple_tokenize(F.lit("Héllo, wörld 42!"))) == ["héllo", ",", "wörld", "42", "!"]


def test_title_text(spark):
    assert one(spark, T.title_text(F.lit("T"), F.lit("x"))) == "T x"
    assert one(spark, T.title_text(F.lit(""), F.lit("x"))) == "x"
    assert one(spark, T.title_text(F.lit(None).cast("string"), F.lit("x"))) == "x"


def test_has_answer(spark):
    def ha(ans, text):
        return one(spark, T.has_answer_tokens(T.qa_tokens(F.lit(text).cast("string")),
                                              T.qa_tokens(F.lit(ans).cast("string"))))
    assert ha("", "anything") is True
    assert ha("b c", "a b c d") is True
    assert ha("b d", "a b c d") is False
    assert ha("a b c d e", "a b c d") is False
    assert ha("é", "é") is True
    assert ha("x", None) is False


def test_idf_bm25_saturate(spark):
    assert one(spark, S.idf(F.lit(10.0), F.lit(3))) == pytest.approx(math.log(1 + 7.5 / 3.5))
    assert one(spark, S.bm25_tf(F.lit(2), F.lit(100.0), F.lit(100.0))) == pytest.approx(5.2 / 3.6)
    assert one(spark, S.saturate(F.lit(2), F.lit(0.0))) == pytest.approx(2 / 3)


def test_vector_functions(spark):
    u, v = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(4.0), F.lit(3.0))
    assert one(spark, S.dot(u, v)) == pytest.approx(24.0)
    assert one(spark, S.cos_sim(u, v)) == pytest.approx(24 / 25)
    assert one(spark, S.l2_normalize(u)) == pytest.approx([0.6, 0.8])


def test_schedules(spark):
    vals = [one(spark, SCH.lr_linear(F.lit(s), 12, 325, 0.0)) for s in (6, 12, 325)]
    assert vals == pytest.approx([0.5, 1.0, 0.0])
    assert one(spark, SCH.lr_cosine(F.lit(6), 12, 325, 0.1)) == pytest.approx(0.5)
    assert one(spark, SCH.momentum_update(F.lit(1.0), F.lit(0.0), 0.9)) == pytest.approx(0.9)


def test_pad_and_bos(spark):
    x = F.array(F.lit(5), F.lit(6))
    assert one(spark, A.pad(x, F.lit(4))) == [5, 6, 0, 0]
    assert one(spark, A.pad_mask(x, F.lit(4))) == [1, 1, 0, 0]
    assert one(spark, A.add_bos_eos(F.array(F.lit(5)), None, 2)) == [5, 2]
    assert one(spark, A.add_token(F.array(F.lit(5)), 7)) == [7, 5]


def test_zero_probability_edits_are_identity(spark):
    x = F.array(*[F.lit(i) for i in range(20)])
    assert one(spark, A.delete_tokens(x, 0.0, 1, "d", F.lit(1))) == list(range(20))
    assert one(spark, A.mask_tokens(x, 99, 0.0, 1, "m", F.lit(1))) == list(range(20))
    assert one(spark, A.shuffle_tokens(x, 0.0, 1, "s", F.lit(1))) == list(range(20))
    shuffled = one(spark, A.shuffle_tokens(x, 1.0, 1, "s", F.lit(1)))
    assert sorted(shuffled) == list(range(20))
    assert one(spark, A.delete_tokens(x, 1.0, 1, "d", F.lit(1))) == []


def test_random_crop_inside_chunk(spark):
    x = F.array(*[F.lit(i) for i in range(50)])
    for key in range(10):
        c = one(spark, A.random_crop(x, 0.3, 0.7, 3, "q", F.lit(key)))
        assert 15 <= len(c) <= 35
        assert c == list(range(c[0], c[0] + len(c)))


def test_chunk_past_end(spark):
    assert one(spark, A.chunk(F.array(F.lit(1), F.lit(2)), F.lit(5), 3)) == []


def test_augment_dispatch(spark):
    x = F.array(*[F.lit(i) for i in range(10)])
    assert one(spark, A.augment(x, "none", 0.5, 1, "a", F.lit(1))) == list(range(10))
    assert one(spark, A.augment(x, "mask", 1.0, 1, "a", F.lit(1), mask_id=9)) == [9] * 10
    r = one(spark, A.augment(x, "replace", 1.0, 1, "a", F.lit(1), lo=100, hi=105))
    assert all(100 <= v <= 105 for v in r)
    assert one(spark, A.augment(x, "delete", 1.0, 1, "a", F.lit(1))) == []
