"""Join helpers: size-checked broadcast and an exact substring join.

``bounded_broadcast`` is the only place that decides to broadcast a side whose
size depends on the data: it counts the side first and broadcasts only under
a row bound; above the bound the join is left to the planner (sort-merge or
shuffled hash, with AQE skew splitting).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexkit.session import materialize

# Default row bound for broadcasting a data-dependent side.
MAX_BROADCAST_ROWS = 2_000_000


# Default bound of the same side's data, by column sizes.
MAX_BROADCAST_BYTES = 256 << 20


def _bytes_of(field: T.StructField):
    """Approximate bytes of a value: strings and arrays by their length."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(c), F.lit(0))
    if isinstance(field.dataType, T.ArrayType):
        inner = field.dataType.elementType
        each = F.aggregate(c, F.lit(0), lambda acc, x: acc + F.coalesce(F.octet_length(x), F.lit(0))) \
            if isinstance(inner, T.StringType) else F.size(c) * 8
        return F.coalesce(each, F.lit(0))
    return F.lit(8)


def bounded_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``broadcast(df)`` if it has at most ``max_rows`` rows and about ``max_bytes``
    bytes, else ``df``.  Give it a written or cheap table: it is read to be measured."""
    size = F.lit(0)
    for f in df.schema.fields:
        size = size + _bytes_of(f)
    n, total = df.select(size.cast("bigint").alias("b")).agg(F.count(F.lit(1)), F.sum("b")).first()
    return F.broadcast(df) if n <= max_rows and (total or 0) <= max_bytes else df


def substring_pairs(hay: DataFrame, hay_key: str, hay_text: str,
                    needles: DataFrame, needle_key: str, needle_text: str,
                    gram: int | None = None) -> DataFrame:
    """All (needle_key, hay_key) pairs where the needle text is a substring of the
    hay text (exact; empty needles match nothing).

    No theta join: the hay text is cut into consecutive ``gram``-character
    anchors; the needle side emits its grams at every offset 0..gram-1.  Any
    occurrence of a needle of length L >= 2 gram - 1 covers one whole hay
    anchor, so an equi-join on the gram finds every candidate (needle, hay,
    start); candidates are then verified by comparing the aligned substring.
    By default gram is about half the shortest needle (at most 64), which keeps
    anchors selective and the anchor table at ~1/gram of the text.  The hay side is never shuffled: the
    needle grams are broadcast (size-checked) and the verification reads the
    text of candidate rows only, once per hay row.
    """
    nd = (needles.select(F.col(needle_key).alias("_nk"), F.col(needle_text).alias("_nt"))
          .filter(F.length("_nt") > 0)
          .withColumn("_nl", F.length("_nt")))
    lmin = nd.agg(F.min("_nl")).first()[0]
    if lmin is None:
        return hay.sparkSession.createDataFrame([], f"{needle_key} bigint, {hay_key} bigint")
    # anchors are consecutive, non-overlapping gram-length pieces (stride = gram)
    g = gram or max(1, min(64, (lmin + 1) // 2))
    m = g
    if 2 * g - 1 > lmin:
        raise ValueError("2 * gram - 1 must not exceed the shortest needle")
    ng = (nd.select("_nk", "_nl", "_nt", F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("_off"))
            .select("_nk", "_nl", "_off", F.substring("_nt", F.col("_off") + 1, g).alias("_g")))
    # one linear regex pass cuts the text into pieces; substring() at growing
    # offsets would rescan the UTF-8 text from its start for every anchor
    pieces = F.regexp_extract_all(F.col(hay_text), F.lit("(?s).{%d}" % g), F.lit(0))
    hg = (hay.select(F.col(hay_key).alias("_hk"), F.posexplode(pieces).alias("_i", "_g"))
             .select("_hk", (F.col("_i") * g).alias("_p"), "_g"))
    cand = (hg.join(bounded_broadcast(ng), "_g")
              .select("_hk", "_nk", "_nl", (F.col("_p") - F.col("_off")).alias("_s"))
              .filter(F.col("_s") >= 0)
              .groupBy("_hk").agg(F.collect_set(F.struct("_nk", "_nl", "_s")).alias("_c")))
    # candidates are few; write them once so the hay anchors are scanned once
    cand = materialize(cand)
    # each candidate hay row is read once; its candidate starts are checked in place
    hay_c = hay.select(F.col(hay_key).alias("_hk"), F.col(hay_text).alias("_ht"))
    checked = (hay_c.join(bounded_broadcast(cand), "_hk")
                    .select("_hk", "_ht", F.explode("_c").alias("c"))
                    .select("_hk", "_ht", "c.*")
                    .join(F.broadcast(nd.select("_nk", "_nt")) if _small(nd) else nd.select("_nk", "_nt"), "_nk")
                    .filter(F.substring("_ht", F.col("_s") + 1, F.col("_nl")) == F.col("_nt")))
    return checked.select(F.col("_nk").alias(needle_key), F.col("_hk").alias(hay_key)).distinct()


def _small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> bool:
    return df.limit(max_rows + 1).count() <= max_rows
