"""Structured Streaming forms of the reference's carried running statistics.

The reference accumulates document frequencies batch by batch (its statistics
job) and keeps running weighted averages per key.  Here both are streaming
aggregations: new files in a source folder are micro-batches, Spark keeps the
per-key state in its fault-tolerant state store (checkpointed under the given
location), and every trigger publishes the full current table.  Restarting
the query from the same checkpoint resumes exactly where it stopped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexkit.functions import text as TX
from lexkit.session import scratch_path


def _publish(output_path: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        # complete mode: the batch is the whole current table
        batch.write.mode("overwrite").parquet(output_path)
    return write


def document_frequency_stream(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """A3 over a stream of whole documents: each document contributes its
    distinct tokens once, so the running count per token is its df."""
    toks = F.array_distinct(TX.simple_tokenize(F.col(text_col), uncased=True))
    return (docs.select(F.explode(toks).alias("token"))
                .groupBy("token").agg(F.count(F.lit(1)).alias("df")))


def weighted_average_stream(rows: DataFrame, key: str = "key", value: str = "value",
                            weight: str = "weight") -> DataFrame:
    """A11 over a stream: running sum(value * weight) / sum(weight) per key."""
    return (rows.groupBy(key).agg(F.sum(F.col(value) * F.col(weight)).alias("raw"),
                                  F.sum(weight).alias("total_weight"))
                .select(key, (F.col("raw") / F.col("total_weight")).alias("avg"), "total_weight"))


def run_to_table(stream_df: DataFrame, output_path: str, checkpoint_location: str) -> None:
    """Process everything available now (incrementally, resumable) and publish
    the aggregate table to ``output_path``."""
    q = (stream_df.writeStream.outputMode("complete")
         .option("checkpointLocation", checkpoint_location)
         .foreachBatch(_publish(output_path))
         .trigger(availableNow=True)
         .start())
    q.awaitTermination()


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def _source(spark: SparkSession, folder: str, schema, file_glob: str | None, max_files_per_trigger: int | None = None):
    """The parquet files of ``folder`` that match ``file_glob``, or those of the table
    folder of that name.  A micro-batch takes a file per core."""
    n = max_files_per_trigger or max(1, spark.sparkContext.defaultParallelism)
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", n)
    if file_glob and _is_folder(spark, f"{folder.rstrip('/')}/{file_glob}"):
        return r.parquet(f"{folder.rstrip('/')}/{file_glob}")
    if file_glob:
        r = r.option("pathGlobFilter", file_glob)
    return r.parquet(folder)


def stream_document_frequency(spark: SparkSession, folder: str, schema: T.StructType | str,
                              file_glob: str | None = None, output_path: str | None = None,
                              checkpoint_location: str | None = None, text_col: str = "text") -> DataFrame:
    """Run the df stream over the parquet files of ``folder`` (optionally only
    those matching ``file_glob``); return the published table."""
    run = uuid.uuid4().hex
    out = output_path or scratch_path(spark, f"df-stream-{run}/table")
    ckpt = checkpoint_location or scratch_path(spark, f"df-stream-{run}/checkpoint")
    docs = _source(spark, folder, schema, file_glob)
    run_to_table(document_frequency_stream(docs, text_col), out, ckpt)
    return spark.read.parquet(out)


def stream_weighted_average(spark: SparkSession, folder: str, schema: T.StructType | str, key: str, value: str,
                            weight_expr, file_glob: str | None = None, output_path: str | None = None,
                            checkpoint_location: str | None = None) -> DataFrame:
    run = uuid.uuid4().hex
    out = output_path or scratch_path(spark, f"wavg-stream-{run}/table")
    ckpt = checkpoint_location or scratch_path(spark, f"wavg-stream-{run}/checkpoint")
    rows = _source(spark, folder, schema, file_glob).select(
        F.col(key).alias("key"), F.col(value).alias("value"), weight_expr.alias("weight"))
    run_to_table(weighted_average_stream(rows), out, ckpt)
    return spark.read.parquet(out)
