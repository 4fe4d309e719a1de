"""Vector columns as numpy blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexkit.session import materialize


def usable(vectors: DataFrame, key: str, vector: str, *others: str) -> list[DataFrame]:
    """(key, vector as array<double>, others) of the vectors that take part: with
    an id, not null, all components finite, not zero.  One written table per
    vector length (vectors of different lengths have no cosine)."""
    v = F.col(vector).cast("array<double>")
    ok = (F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
          & F.exists(v, lambda x: x != 0))
    good = vectors.select(F.col(key).cast("bigint").alias(key), v.alias("vector"), *others).filter(
        F.col(key).isNotNull() & F.col("vector").isNotNull() & F.coalesce(ok, F.lit(False)))
    sizes = sorted(r[0] for r in good.select(F.size("vector")).distinct().collect())
    if len(sizes) < 2:
        return [good]
    good = materialize(good)
    return [good.filter(F.size("vector") == n) for n in sizes]


def matrix(column: pa.Array | pa.ChunkedArray, kind=np.float64) -> np.ndarray:
    """Rows of a list column without nulls as a two-dimensional array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def lists(m: np.ndarray) -> pa.Array:
    n, d = m.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(np.ascontiguousarray(m).ravel()))


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def cosine_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of row i of ``a`` and row i of ``b`` in double precision; equal
    rows give equal results wherever they stand."""
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))
