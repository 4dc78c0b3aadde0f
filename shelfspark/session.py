"""Session settings and the shared work folder."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

# Every timestamp in the data model is zone-free, so the zone only matters for
# text rendering.  The adaptive settings are Spark's defaults, spelled out
# because the skewed-key joins of this package rely on them.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, app: str = "shelfspark", **extra: str) -> SparkSession:
    """A session with the package's settings; ``extra`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def work_root(spark: SparkSession) -> str | None:
    """The shared folder the cluster names in ``spark.checkpoint.dir``, or the context's checkpoint folder."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def work_folder(spark: SparkSession) -> str:
    """A fresh folder for intermediate tables, on the cluster's shared storage; gone when the driver ends."""
    root = work_root(spark)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = f"{root.rstrip('/')}/shelfspark-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, folder)
    return folder


def _remove(spark: SparkSession, folder: str) -> None:
    """Drops a work folder if its session still runs."""
    context = spark.sparkContext
    if context._jsc is None or context._jsc.sc().isStopped():
        return
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(context._jsc.hadoopConfiguration())
    for status in system.globStatus(context._jvm.org.apache.hadoop.fs.Path(f"{folder}*")) or ():
        system.delete(status.getPath(), True)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on whatever storage the path names."""
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(context._jsc.hadoopConfiguration()).exists(target)


def delete_path(spark: SparkSession, path: str) -> None:
    """Removes a folder, on whatever storage the path names."""
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def write_and_reread(df: DataFrame, path: str, *partition_by: str) -> DataFrame:
    """Cut lineage with a written table, so a lost executor costs no recomputation."""
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
