"""Running weighted statistics.

The reference keeps a dictionary of (sum of value * weight, sum of weight) per
key, updated batch by batch and reset at log time.  Here the same state is a
grouped aggregate: partial sums are combined map-side and merged per key, so
any number of batches (or a stream, see ``lexkit.streaming``) reduce to one
row per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def weighted_sums(df: DataFrame, key: str = "key", value: str = "value", weight: str = "weight") -> DataFrame:
    return df.groupBy(key).agg(F.sum(F.col(value) * F.col(weight)).alias("raw"),
                               F.sum(weight).alias("total_weight"))


def weighted_average(df: DataFrame, key: str = "key", value: str = "value", weight: str = "weight") -> DataFrame:
    """(key, avg, total_weight)."""
    s = weighted_sums(df, key, value, weight)
    return s.select(key, (F.col("raw") / F.col("total_weight")).alias("avg"), "total_weight")


def merge_sums(a: DataFrame, b: DataFrame, key: str = "key") -> DataFrame:
    """Combine two partial states (e.g. an earlier run and a new batch)."""
    return a.unionByName(b).groupBy(key).agg(F.sum("raw").alias("raw"), F.sum("total_weight").alias("total_weight"))
