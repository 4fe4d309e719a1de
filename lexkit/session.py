"""Session construction and cluster-level settings."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

_CKPT_KEY = "spark.checkpoint.dir"
_LOCAL_DIR: str | None = None


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "lexkit", extra: dict | None = None) -> SparkSession:
    """Return (or create) a session with the settings every lexkit plan assumes.

    AQE is on (runtime coalescing, skew-join splitting, runtime broadcast
    conversion); Arrow is on for the few pandas-backed operators; the UI is off.
    On a cluster pass ``master=None`` and let spark-submit decide.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this must be set by the deployment (a shared file system path).
    Only in local mode, when it is unset, a private folder is created so tests
    and local runs work.
    """
    global _LOCAL_DIR
    d = spark.conf.get(_CKPT_KEY, None) or spark.sparkContext.getConf().get(_CKPT_KEY, None)
    if not d:
        master = spark.sparkContext.master or ""
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        if _LOCAL_DIR is None:
            _LOCAL_DIR = tempfile.mkdtemp(prefix="lexkit-ckpt-")
        d = _LOCAL_DIR
        try:
            spark.conf.set(_CKPT_KEY, d)
        except Exception:  # noqa: BLE001 - core confs may be read-only at runtime
            pass
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written intermediate tables."""
    return os.path.join(checkpoint_dir(spark), name)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def new_scratch(spark: SparkSession) -> str:
    """A fresh folder name under the shared checkpoint folder."""
    return scratch_path(spark, "lexkit_" + uuid.uuid4().hex[:16])


def written(df, **options: str) -> tuple:
    """Write ``df`` as parquet under the shared folder; return (table, path).

    The path can be given to ``discard`` once every reader of the table is done.
    ``options`` are options of the Parquet writer."""
    path = new_scratch(df.sparkSession)
    df.write.mode("overwrite").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Remove written intermediate tables that no plan reads any more."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(hadoop).delete(path, True)


def materialize(df, bucket_by: str | None = None, buckets: int | None = None):
    """Write ``df`` once as parquet under the shared checkpoint folder and read
    it back: the lineage is cut, every consumer scans compact columnar files,
    and a lost executor never forces recomputation of the inputs.

    With ``bucket_by`` the table is written bucketed on that column (as a
    catalog table located in the same folder), so later aggregates and joins
    keyed by it need no exchange.  Only a refusal of the catalog (analysis
    error, before any row is computed) falls back to plain files."""
    spark = df.sparkSession
    path = new_scratch(spark)
    if bucket_by:
        # callers hash-partition by the bucket column into the same number of
        # partitions first, so every task writes exactly one bucket file
        try:
            (df.write.mode("overwrite").option("path", path)
               .bucketBy(buckets or shuffle_partitions(spark), bucket_by).saveAsTable(os.path.basename(path)))
            return spark.table(os.path.basename(path))
        except AnalysisException:
            path = path + "-plain"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
