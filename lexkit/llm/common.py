"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexkit.session import discard, written


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
        taken.add(n.lower())
    return out


def numbered(docs: DataFrame, name: str = "row") -> DataFrame:
    """``docs``, a stored table, with a unique number per row that is the same
    in every pass over it.  The number follows from how the files are split;
    that must not depend on how many cores happen to be alive, so the least
    number of splits is fixed for the session where it is not."""
    spark = docs.sparkSession
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", spark.sparkContext.defaultParallelism)
    return docs.withColumn(name, F.monotonically_increasing_id())


def checked_broadcast(df: DataFrame, max_rows: int = 2_000_000) -> DataFrame:
    """``df``, a table of a few numbers per row that is already written, marked
    for broadcast if it has at most ``max_rows`` rows."""
    return F.broadcast(df) if df.count() <= max_rows else df


def hash_sample(df: DataFrame, rows: int, *keys: str, seed: int = 1) -> DataFrame:
    """About ``rows`` rows of ``df`` (all, if it has no more), chosen by a seeded
    hash of the keys: the same ones whatever the partitioning."""
    n = df.count()
    if n <= rows:
        return df
    return df.filter(F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 40)) < int(rows / n * (1 << 40)))


def crc_mod(column: str, m: int):
    """crc32 of the decimal text of an id, modulo ``m`` (null id: -1)."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % m, F.lit(-1)).cast("int")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): smallest id reachable over undirected edges (a, b).

    The graph is contracted round by round: every node hooks to its smallest
    neighbour, chains of hooks are shortened by pointer jumping, edges are
    relabelled and loops dropped.  Each round is a few keyed joins and
    minimum aggregates (map-side combined, so a hub is not a hot key); tables
    of a round are written and the previous ones removed.  Only nodes with an
    edge are returned; no edge: no row."""
    spark = edges.sparkSession
    edges, edge_path = written(edges.select(F.col("a").cast("bigint"), F.col("b").cast("bigint"))
                               .filter("a <> b").distinct())
    label, label_path = None, None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook, hook_path = written(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("to"))
                                  .withColumn("to", F.least("id", "to")))
        while True:
            nxt = hook.select(F.col("id").alias("to"), F.col("to").alias("far"))
            jumped, path = written(hook.join(nxt, "to").select("id", F.col("far").alias("to"),
                                                               (F.col("far") < F.col("to")).alias("moved")))
            discard(spark, hook_path)
            hook, hook_path = jumped.select("id", "to"), path
            if jumped.filter("moved").isEmpty():
                break
        old = label_path
        if label is None:
            label = hook.select("id", F.col("to").alias("component"))
        else:
            label = (label.join(hook.select(F.col("id").alias("component"), "to"), "component", "left")
                          .select("id", F.coalesce("to", "component").alias("component")))
        label, label_path = written(label)
        ends = hook.select(F.col("id").alias("a"), F.col("to").alias("x"))
        other = hook.select(F.col("id").alias("b"), F.col("to").alias("y"))
        fresh, path = written(edges.join(ends, "a").join(other, "b").filter("x <> y")
                              .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        discard(spark, edge_path, hook_path, *([old] if old else []))
        edges, edge_path = fresh, path
    discard(spark, edge_path)
    if label is None:
        return spark.createDataFrame([], "id bigint, component bigint")
    return label
