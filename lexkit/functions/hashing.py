"""Repeatable hash uniforms.

Every random draw is a pure function of (seed, operator tag, row key, position):
u = first 52 bits of md5("seed:tag:key...") / 2**52, a double in [0, 1).
The value does not depend on partitioning or on execution order, so a lost
task recomputes the same draw, and an SQL engine with ``md5`` reproduces it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_52 = 4503599627370496.0


def _as_col(k) -> Column:
    return k if isinstance(k, Column) else F.lit(k)


def uniform(seed: int, tag: str, *keys) -> Column:
    """Uniform double in [0, 1) keyed by ``seed``, ``tag`` and the key columns.

    Keys must be integer or string columns (their string form is hashed).
    """
    parts = [F.lit(str(seed)), F.lit(tag)] + [_as_col(k).cast("string") for k in keys]
    h = F.md5(F.concat_ws(":", *parts))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("bigint") / F.lit(TWO_POW_52)


def uniform_int(seed: int, tag: str, lo, hi, *keys) -> Column:
    """Uniform integer in [lo, hi] inclusive."""
    lo_c, hi_c = _as_col(lo), _as_col(hi)
    return (lo_c + F.floor(uniform(seed, tag, *keys) * (hi_c - lo_c + 1))).cast("bigint")


def sql_uniform(seed: int, tag: str, *key_sql: str) -> str:
    """The same draw written as DuckDB SQL (used by the oracle queries)."""
    parts = [f"'{seed}'", f"'{tag}'"] + [f"CAST({k} AS VARCHAR)" for k in key_sql]
    return (f"(('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 13))::BIGINT"
            f" / {TWO_POW_52})")
