"""Scoring terms and vector expressions (F8-F11) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# BM25 parameters of the reference document encoder.
BM25_K1 = 1.6
BM25_B = 0.75


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else (x if isinstance(x, Column) else F.lit(x))


def idf(n_docs, df) -> Column:
    """A4: ln(1 + (N - df + 0.5) / (df + 0.5))."""
    n, d = _c(n_docs), _c(df)
    return F.log(F.lit(1.0) + (n - d + F.lit(0.5)) / (d + F.lit(0.5)))


def bm25_tf(tf, dl, avgdl, k1: float = BM25_K1, b: float = BM25_B) -> Column:
    """F8: tf (k1 + 1) / (tf + k1 (1 - b + b dl / avgdl))."""
    t = _c(tf).cast("double")
    return t * F.lit(k1 + 1.0) / (t + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * _c(dl) / _c(avgdl)))


def saturate(tf, beta) -> Column:
    """tf / (tf + e^beta)."""
    t = _c(tf).cast("double")
    return t / (t + F.exp(_c(beta)))


def dot(u, v) -> Column:
    """F11 'dot': inner product of two equal-length numeric arrays (as double)."""
    return F.aggregate(F.zip_with(_c(u), _c(v), lambda a, b: a.cast("double") * b.cast("double")),
                       F.lit(0.0), lambda acc, x: acc + x)


def norm(v) -> Column:
    return F.sqrt(F.aggregate(_c(v), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalize(v) -> Column:
    """v / ||v|| (zero vectors stay zero)."""
    n = norm(v)
    return F.transform(_c(v), lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))


def cos_sim(u, v) -> Column:
    """F11 'cos_sim'."""
    return dot(u, v) / (norm(u) * norm(v))


def score_fn(u, v, kind: str = "dot") -> Column:
    if kind == "dot":
        return dot(u, v)
    if kind == "cos_sim":
        return cos_sim(u, v)
    raise ValueError(f"unknown score function {kind!r}")
