"""A session with the settings that the plans rely on."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, shuffle_partitions: int | None = None, **settings: str) -> SparkSession:
    """UTC, adaptive execution with coalescing and skew joins; on a cluster the partitions are the cluster's."""
    builder = SparkSession.builder.appName("tidemark")
    if master:
        builder = builder.master(master)
    chosen = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        chosen["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    return builder.config(map=chosen | settings).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it; a temporary one only on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


_OPENED: set[str] = set()


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, under one that is deleted when the driver ends."""
    root = f"{shared_folder(spark)}/tidemark-core/{spark.sparkContext.applicationId}"
    if root not in _OPENED:
        _OPENED.add(root)
        atexit.register(_remove, spark, root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session may have ended: its folder stays, as a cluster's own checkpoints do
        pass


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: worked out once however often it is used, its lineage cut."""
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
