"""Operator 4, sharding: two-pass external shuffle.

Pass one scatters whole records uniformly over memory-sized buckets by a seeded
hash of the key and the row's place in its input split, so a repeated key does
not fill one bucket.  Pass two loads one bucket at a time, Fisher-Yates
shuffles it; ``write_shards`` writes the result.  Buckets in order form one
uniform permutation of all records, which is dealt out to the shards in turn
(law ``rows``: shard sizes differ by at most one row).  ``df`` is a stored table
(its rows are numbered by their place, the same in every pass).

Defined cases: null keys and null texts are records like others; repeated rows
stay repeated; an empty table gives an empty table; other columns pass through
unchanged whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lexkit.llm.common import documents, free_names, numbered
from lexkit.operators.joins import MAX_BROADCAST_ROWS
from lexkit.session import materialize, shuffle_partitions

BUCKET_BYTES = 32 << 20
BUCKETS_PER_PARTITION = 4
SHARDS = 8
SEED = 20_240_607
PREFIX_BLOCK = 1024


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """A uniform permutation of 0..n-1: place i swaps with a place in 0..i."""
    perm = list(range(n))
    swap = (rng.random(n) * np.arange(1, n + 1)).astype(np.int64).tolist()
    for i in range(n - 1, 0, -1):
        j = swap[i]
        perm[i], perm[j] = perm[j], perm[i]
    return np.array(perm, np.int64)


def bucket_offsets(counts: DataFrame, bucket: str, base: str) -> DataFrame:
    """(bucket, ``base``): records in all earlier buckets, as running sums inside
    blocks of buckets plus running sums over the blocks' totals."""
    c = counts.withColumn("_block", F.floor(F.col(bucket) / PREFIX_BLOCK))
    inside = Window.partitionBy("_block").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(F.lit(0)).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    block = (c.groupBy("_block").agg(F.sum("n").alias("_n"))
              .select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")))
    return (c.withColumn("_in", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(block, "_block")
             .select(bucket, (F.col("_in") + F.col("_base")).alias(base)))


def external_shuffle(df: DataFrame, key: str, size, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES,
                     place: str = "place") -> DataFrame:
    """``df`` with ``place``: the record's position in one uniform permutation.

    ``size`` is the column expression of a record's bytes."""
    spark = df.sparkSession
    total = df.agg(F.sum(size)).first()[0] or 0
    buckets = max(-(-int(total) // bucket_bytes), BUCKETS_PER_PARTITION * shuffle_partitions(spark))
    b, h, at, row, first = free_names(df, "_bucket", "_hash", "_at", "_row", "_first")
    scattered = (numbered(df, row).withColumn(h, F.xxhash64(F.lit(seed), F.col(key), F.col(row))).drop(row)
                 .withColumn(b, F.pmod(F.xxhash64(F.lit(seed), F.col(h)), F.lit(buckets))))
    # the buckets' sizes follow from keys alone: a pass that reads no record
    base = materialize(bucket_offsets(scattered.groupBy(b).agg(F.count(F.lit(1)).alias("n")), b, first))

    def shuffle_bucket(t: pa.Table) -> pa.Table:
        t = t.take(pc.sort_indices(t, sort_keys=[(h, "ascending")]))
        perm = fisher_yates(len(t), np.random.default_rng([seed, t.column(b)[0].as_py()]))
        return t.take(pa.array(perm)).drop_columns([h]).append_column(at, pa.array(np.arange(len(t), dtype=np.int64)))

    fields = [f for f in scattered.schema.fields if f.name != h]
    done = scattered.groupBy(b).applyInArrow(
        shuffle_bucket, StructType([StructField(f.name, f.dataType, True) for f in fields]
                                   + [StructField(at, LongType())]))
    if buckets <= MAX_BROADCAST_ROWS:  # one row a bucket: at most 64 TB of records
        base = F.broadcast(base)
    return done.join(base, b).withColumn(place, F.col(first) + F.col(at)).drop(b, at, first)


def shard_rows(df: DataFrame, key: str, size, shards: int = SHARDS, **options) -> DataFrame:
    """``df`` with ``shard`` and ``slot`` (replacing columns of these names): the
    shuffled records dealt in turn."""
    place, = free_names(df, "_place")
    out = external_shuffle(df, key, size, place=place, **options)
    return (out.withColumn("shard", (F.col(place) % shards).cast("int"))
               .withColumn("slot", F.floor(F.col(place) / shards).cast("bigint")).drop(place))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder of Parquet files per shard, records in slot order."""
    n = shuffle_partitions(sharded.sparkSession)
    (sharded.repartitionByRange(n, "shard", "slot").sortWithinPartitions("shard", "slot")
            .write.partitionBy("shard").parquet(path))


def record_size(text: str = "text"):
    """UTF-8 bytes of the text (null: none) plus one."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1


def op4_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 by law ``rows``."""
    out = shard_rows(documents(spark, sf_dir), "doc_id", record_size())
    return out.select("doc_id", record_size().alias("size"),
                      F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("bigint").alias("text_crc32"),
                      F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
