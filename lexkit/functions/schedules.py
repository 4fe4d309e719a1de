"""Schedules and parameter-update expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else (x if isinstance(x, Column) else F.lit(x))


def lr_linear(step, warmup: int, total: int, ratio: float = 0.0) -> Column:
    """linear warm-up to 1, then linear decay towards ``ratio``, floored at 0."""
    s = _c(step).cast("double")
    warm = F.lit(1.0 - ratio) * s / F.lit(float(max(1, warmup)))
    decay = F.greatest(F.lit(0.0), F.lit(1.0) + F.lit(ratio - 1.0) * (s - F.lit(float(warmup)))
                       / F.lit(float(max(1, total - warmup))))
    return F.when(s < F.lit(warmup), warm).otherwise(decay)


def lr_cosine(step, warmup: int, total: int, ratio: float = 0.1) -> Column:
    """linear warm-up, then ratio + (1 - ratio) cos(pi/2 * progress)."""
    s = _c(step).cast("double")
    warm = s / F.lit(float(max(1, warmup)))
    prog = (s - F.lit(float(warmup))) / F.lit(float(max(1, total - warmup)))
    cos_part = F.lit(ratio) + F.lit(1.0 - ratio) * F.cos(F.lit(math.pi / 2.0) * prog)
    return F.when(s < F.lit(warmup), warm).otherwise(cos_part)


def momentum_update(k, q, m: float) -> Column:
    """k m + q (1 - m)."""
    return _c(k) * F.lit(m) + _c(q) * F.lit(1.0 - m)
