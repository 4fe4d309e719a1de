"""Rank-agreement statistics between a predicted order and a gold order.

Input: (list_id, pos, gold) -- ``gold`` is the gold rank of the item shown at
predicted position ``pos`` (both 0-based).

Inversions (A22) are counted without emitting pairs and without copying rows.
Positions and gold ranks are cut into bands of ``BAND`` rows; a row's cell is its
pair of bands.  Two inverted rows share the position band, or the gold band, or
neither:

    inversions = sum over position bands + sum over gold bands
                 - sum over cells + sum over pairs of cells, both bands inverted.

The first three are counts inside one band (a merge count in one task, at most
``BAND`` rows); the last needs only the number of rows per cell.  So n rows are
dealt twice, and the table of cells has (n / BAND)^2 rows at most.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexkit.session import materialize

BAND = 1 << 20


def count_inversions(values: np.ndarray) -> int:
    """Pairs i < j with values[i] > values[j]; equal values are no inversion."""
    n = len(values)
    if n < 2:
        return 0
    rank = np.empty(n, np.int64)
    rank[np.argsort(values, kind="stable")] = np.arange(n)      # ties in order: not inverted
    total = 0
    for bit in range(int(n - 1).bit_length() - 1, -1, -1):
        # rows stand by their higher bits, in their first order inside them
        one = (rank >> bit) & 1
        high = rank >> (bit + 1)
        start = np.flatnonzero(np.diff(high, prepend=-1))
        ones = np.cumsum(one)
        before = ones - np.repeat(ones[start] - one[start], np.diff(np.append(start, n)))
        total += int(before[one == 0].sum())
        rank = rank[np.argsort(rank >> bit, kind="stable")]
    return total


def _within(lists: DataFrame, band: str, cells: bool) -> DataFrame:
    """(list_id, n): inversions inside every band; with ``cells`` less those inside its cells."""
    def count(t: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        gold, cell = t.column("gold").to_numpy(), t.column("gb").to_numpy()
        n = count_inversions(gold)
        if cells:
            n -= sum(count_inversions(gold[cell == c]) for c in np.unique(cell)) if len(np.unique(cell)) > 1 else n
        return pa.table({"list_id": t.column("list_id").slice(0, 1), "n": pa.array([n], pa.int64())})

    kind = dict(lists.dtypes)["list_id"]
    return lists.select("list_id", "pos", "gold", "pb", "gb").groupBy("list_id", band).applyInArrow(count, f"list_id {kind}, n bigint")


def _between(t: pa.Table) -> pa.Table:
    """Pairs of rows in cells of an earlier position band and a later gold band."""
    p, g = (np.unique(t.column(c).to_numpy(), return_inverse=True)[1] for c in ("pb", "gb"))
    dense = np.zeros((p.max() + 1, g.max() + 1), np.int64)
    dense[p, g] = t.column("rows").to_numpy()
    later = dense[:, ::-1].cumsum(1)[:, ::-1] - dense           # same position band, later gold bands
    above = later.cumsum(0) - later                             # of all earlier position bands
    return pa.table({"list_id": t.column("list_id").slice(0, 1), "n": pa.array([int((above * dense).sum())], pa.int64())})


def inversions(lists: DataFrame, band: int | None = None) -> DataFrame:
    """(list_id, inversions)."""
    size = band or BAND
    banded = (lists.withColumn("pb", F.floor(F.col("pos") / size).cast("bigint"))
                   .withColumn("gb", F.floor(F.col("gold") / size).cast("bigint")))
    kind = dict(lists.dtypes)["list_id"]
    cells = banded.groupBy("list_id", "pb", "gb").agg(F.count(F.lit(1)).alias("rows"))
    parts = _within(banded, "pb", cells=True)                   # all but the cells' own
    parts = parts.unionByName(_within(banded, "gb", cells=False))
    parts = parts.unionByName(cells.groupBy("list_id").applyInArrow(_between, f"list_id {kind}, n bigint"))
    return parts.groupBy("list_id").agg(F.sum("n").alias("inversions"))


def avg_topk(lists: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Share of the first k predicted items whose gold rank < k (all items
    when the list is shorter)."""
    arr = F.array(*[F.lit(int(k)) for k in ks])
    ex = lists.withColumn("k", F.explode(F.filter(arr, lambda k: k > F.col("pos"))))
    return ex.groupBy("list_id", "k").agg(F.avg((F.col("gold") < F.col("k")).cast("double")).alias("avg_topk"))


def idx_topk(lists: DataFrame, ks: Sequence[int]) -> DataFrame:
    """1-based position of the last item with gold rank < k; the list
    length when there is none."""
    arr = F.array(*[F.lit(int(k)) for k in ks])
    ex = lists.withColumn("k", F.explode(arr))
    return ex.groupBy("list_id", "k").agg(
        F.coalesce(F.max(F.when(F.col("gold") < F.col("k"), F.col("pos") + 1)),
                   F.count(F.lit(1))).cast("bigint").alias("idx_topk"))


def rank_agreement(lists: DataFrame, ks: Sequence[int] = (1, 5, 10, 20)) -> DataFrame:
    """Per (list_id, k): inversions, avg_topk, idx_topk."""
    lists = materialize(lists)
    return (avg_topk(lists, ks).join(idx_topk(lists, ks), ["list_id", "k"], "full")
            .join(inversions(lists), "list_id"))
