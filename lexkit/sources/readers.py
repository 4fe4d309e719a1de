"""Readers and writers for the reference's on-disk inputs and artefacts.

All readers are Spark data sources with explicit schemas (no inference);
paths may be local, HDFS or object-store URIs.  File listings are metadata
calls of the Hadoop FileSystem, like Spark's own planning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexkit.operators.windows import ordered_index

CTX = T.StructType([T.StructField("title", T.StringType()), T.StructField("text", T.StringType())])
QA_EXAMPLE_SCHEMA = T.StructType([
    T.StructField("question", T.StringType()),
    T.StructField("positive_ctxs", T.ArrayType(CTX)),
    T.StructField("negative_ctxs", T.ArrayType(CTX)),
    T.StructField("hard_negative_ctxs", T.ArrayType(CTX)),
])
QA_RESULT_SCHEMA = T.StructType([
    T.StructField("question", T.StringType()),
    T.StructField("answers", T.ArrayType(T.StringType())),
    T.StructField("ctxs", T.ArrayType(T.StructType([T.StructField("id", T.StringType()),
                                                    T.StructField("text", T.StringType())]))),
])


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> list[str]:
    """Sorted file paths under ``path`` matching a glob (FileSystem metadata)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/" + pattern)
    fs = p.getFileSystem(conf)
    stats = fs.globStatus(p) or []
    return sorted(str(s.getPath().toString()) for s in stats if s.isFile())


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_token_corpora(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Every directory is one dataset keyed by its path; (dataset_id, row_id, input_ids)."""
    out = None
    for p in paths:
        d = spark.read.parquet(p).select(F.lit(p).alias("dataset_id"), "row_id", "input_ids")
        out = d if out is None else out.unionByName(d)
    return out


def read_shards(spark: SparkSession, path: str, mode: str = "full", rank: int = 0, world: int = 1) -> DataFrame | None:
    """Sorted ``*.p*`` files; 'full' = all, 'single' = first file, 'split' =
    this worker's contiguous share of the file list (P12 sizes), where unreadable
    files are skipped; the other modes fail on one.  None when there is nothing
    to read."""
    files = list_files(spark, path, "*.p*")
    if mode == "single":
        files = files[:1]
    elif mode == "split":
        n, q, r = len(files), len(files) // world, len(files) % world
        start = rank * q + min(rank, r)
        files = files[start:start + q + (1 if rank < r else 0)]
    if not files:
        return None
    return spark.read.option("ignoreCorruptFiles", str(mode == "split").lower()).parquet(*files)


def read_passages(spark: SparkSession, path: str) -> DataFrame:
    """S3 + P5: '.jsonl' -> JSON rows; otherwise TSV (id, text, title) with CSV
    quoting, a header row whose first field is 'id' dropped (a row with an empty
    id stays).  A path that does not exist yields no passage."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], "id string, title string, text string")
    if path.endswith(".jsonl"):
        schema = "id string, title string, text string"
        return spark.read.schema(schema).json(path).select("id", "title", "text")
    df = (spark.read.option("sep", "\t").option("quote", '"').option("escape", '"').option("multiLine", "true")
          .schema("id string, text string, title string").csv(path))
    return df.filter(F.col("id").isNull() | (F.col("id") != "id")).select("id", "title", "text")


def _ordered_rows(df: DataFrame) -> DataFrame:
    """Attach (file index, position) in file order: file path, split start and
    the in-split sequence number give the order lines appear in the files."""
    return (df.withColumn("_file", F.col("_metadata.file_path"))
              .withColumn("_blk", F.col("_metadata.file_block_start"))
              .withColumn("_seq", F.monotonically_increasing_id()))


def read_qa_examples(spark: SparkSession, paths: Sequence[str], maxload: int | None = None,
                     rank: int = -1, world: int = 1) -> DataFrame:
    """S4 + P10 + P11: '.json' files hold one JSON array; anything else
    ('.jsonl' files, folders of JSON-lines part files) one example per line.
    Files are concatenated in the given path order (part files of a folder in
    name order); the running row number counts over all files; rows past
    ``maxload`` are dropped, then rows whose 1-based number mod world != rank."""
    parts = []
    for i, p in enumerate(paths):
        d = spark.read.schema(QA_EXAMPLE_SCHEMA).option("multiLine", str(p.endswith(".json")).lower()).json(p)
        parts.append(_ordered_rows(d).withColumn("_path_ix", F.lit(i)))
    df = parts[0]
    for d in parts[1:]:
        df = df.unionByName(d)
    df = ordered_index(df, [F.col("_path_ix"), F.col("_file"), F.col("_blk"), F.col("_seq")], out="_row")
    if maxload is not None and maxload > 0:
        df = df.filter(F.col("_row") < maxload)
    if rank > -1:
        df = df.filter((F.col("_row") + 1) % world == rank)
    return df.drop("_path_ix", "_file", "_blk", "_seq")


def read_beir(spark: SparkSession, data_dir: str, split: str = "test"):
    """(corpus, queries, qrels) of one retrieval dataset folder."""
    d = data_dir.rstrip("/")
    corpus = spark.read.schema("_id string, title string, text string").json(f"{d}/corpus.jsonl") \
        .select(F.col("_id").alias("doc_id"), F.coalesce("title", F.lit("")).alias("title"), "text")
    queries = spark.read.schema("_id string, text string").json(f"{d}/queries.jsonl") \
        .select(F.col("_id").alias("query_id"), "text")
    qrels = (spark.read.option("sep", "\t").option("header", "true")
             .schema("`query-id` string, `corpus-id` string, score int").csv(f"{d}/qrels/{split}.tsv")
             .select(F.col("`query-id`").alias("query_id"), F.col("`corpus-id`").alias("doc_id"),
                     F.col("score").alias("relevance")))
    return corpus, queries, qrels


def split_for(dataset: str) -> str:
    """The evaluation split of a dataset."""
    return "dev" if dataset == "msmarco" else "test"


def read_qa_results(spark: SparkSession, glob: str) -> DataFrame:
    """JSON-lines result files; the file path is the report group key."""
    d = spark.read.schema(QA_RESULT_SCHEMA).json(glob)
    return _ordered_rows(d).withColumn("question_id", F.col("_seq")).drop("_blk", "_seq") \
        .withColumnRenamed("_file", "file")


def explode_qa_results(results: DataFrame):
    """S6 rows -> (ctxs, answers) in the exploded form the answer check uses;
    ``results`` itself is the question table (one row each, ctxs or not)."""
    ctxs = results.select("file", "question_id", F.posexplode("ctxs").alias("ctx_pos", "c")) \
        .select("file", "question_id", "ctx_pos", F.col("c.text").alias("text"))
    answers = results.select("file", "question_id", F.explode("answers").alias("answer"))
    return ctxs, answers


def write_index(vecs: DataFrame, path: str, id_col: str = "vec_id", vec_col: str = "embedding") -> None:
    """Persist vectors with their external ids (append adds vectors)."""
    vecs.select(F.col(id_col).cast("string").alias("vec_id"), vec_col).write.mode("append").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Load vectors; every vector must carry an id."""
    df = spark.read.parquet(path)
    bad = df.filter(F.col("vec_id").isNull() | F.col(df.columns[1]).isNull()).limit(1).count()
    if bad:
        raise AssertionError("index has vectors without ids")
    return df


def write_idf(idf: DataFrame, path: str) -> None:
    """Persist (token, df, idf)."""
    idf.select("token", "df", "idf").write.mode("overwrite").parquet(path)


def read_idf(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_run(run: DataFrame, path: str) -> None:
    """Persist a ranking (query_id, doc_id, score, rank)."""
    run.write.mode("overwrite").parquet(path)


def append_training_log(log: DataFrame, path: str) -> None:
    """Append per-step (step, loss, acc, lr) rows."""
    log.write.mode("append").parquet(path)
