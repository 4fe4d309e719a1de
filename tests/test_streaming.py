"""Streaming running statistics: equal to the batch result, resumable."""
import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from lexkit.operators import lexical as L
from lexkit.sources import testdata as td
from lexkit.streaming import running_stats as RS


def test_stream_df_equals_batch_and_resumes(spark):
    d = tempfile.mkdtemp(prefix="lexkit-stream-")
    schema = td.table(spark, SF_SMALL, "documents").schema
    out, ckpt = os.path.join(d, "table"), os.path.join(d, "ckpt")
    first = RS.stream_document_frequency(spark, SF_SMALL, schema, file_glob="documents.parquet",
                                         output_path=out, checkpoint_location=ckpt)
    batch = L.build_idf(td.table(spark, SF_SMALL, "documents")).select("token", "df")
    a = {r["token"]: r["df"] for r in first.collect()}
    assert a == {r["token"]: r["df"] for r in batch.collect()}
    # restart from the same checkpoint: nothing new to read, the table is unchanged
    again = RS.stream_document_frequency(spark, SF_SMALL, schema, file_glob="documents.parquet",
                                         output_path=out, checkpoint_location=ckpt)
    assert {r["token"]: r["df"] for r in again.collect()} == a


def test_tables_written_as_folders_are_streamed(spark):
    d = tempfile.mkdtemp(prefix="lexkit-stream-")
    docs = spark.createDataFrame([(i, f"a b{i % 2} c{i}") for i in range(6)], "doc_id bigint, text string")
    docs.repartition(3).write.parquet(f"{d}/documents.parquet")
    got = RS.stream_document_frequency(spark, d, docs.schema, file_glob="documents.parquet")
    assert {r["token"]: r["df"] for r in got.collect()} == {"a": 6, "b0": 3, "b1": 3, **{f"c{i}": 1 for i in range(6)}}
    avg = RS.stream_weighted_average(spark, d, docs.schema, "text", "doc_id", F.lit(2), file_glob="documents.parquet")
    assert sorted(r["avg"] for r in avg.collect()) == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]
