"""Session settings and tables kept between the passes of a job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# Settings every job expects.  Joins are left to the cost-based choice of
# Spark: a side is broadcast only when its measured size is under
# ``autoBroadcastJoinThreshold``; skewed shuffle partitions are split by AQE.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # a shuffle starts in many parts and is coalesced by size, so a task's share of it
    # (its sort, its hash table) does not grow with the table
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "400",
    # tables written by shard or side: a task with few of them writes them side by side,
    # without sorting its rows (texts and all) first
    "spark.sql.maxConcurrentOutputFileWriters": "4",
    # the JVM never compiles methods of more than 8,000 bytes (wide feature rows);
    # their plans run operator by operator instead
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


KEPT = "kudoscope/kept"  # folder of the kept tables, inside the shared folder


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings above to a running session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build(name: str = "kudoscope", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def shared_folder(spark: SparkSession) -> str | None:
    """Folder all executors reach, as the cluster names it."""
    return spark.conf.get("spark.checkpoint.dir", None)


def keep(df: DataFrame) -> DataFrame:
    """A table that several passes read.

    Written to the shared folder, so a lost executor costs nothing and columns
    are still pruned; where the cluster names no folder it is cached on the
    executors (spilling to disk).
    """
    folder = shared_folder(df.sparkSession)
    if not folder:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    path = f"{folder}/{KEPT}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Give back a table of :func:`keep`: its cache, or its files.

    Nothing that still has to read the table may be left."""
    df.unpersist()
    if not shared_folder(df.sparkSession):
        return
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if f"/{KEPT}/" in folder:
            delete(df.sparkSession, folder)


def delete(spark: SparkSession, folder: str) -> None:
    """Remove a folder of written products, wherever the cluster has it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def work_folder(spark: SparkSession) -> str:
    """A new folder for written products: in the shared folder of the cluster;
    a local folder only where Spark itself is local."""
    shared = shared_folder(spark)
    if shared:
        return f"{shared}/kudoscope/{uuid.uuid4().hex}"
    if spark.sparkContext.master.startswith("local"):
        return tempfile.mkdtemp(prefix="kudoscope-")
    raise ValueError("set spark.checkpoint.dir to a folder all executors reach")
