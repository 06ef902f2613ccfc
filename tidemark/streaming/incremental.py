"""Incremental ingestion: streams over the event files, with watermarks, and state for each issue."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.history import latest
from tidemark.session import fresh_folder
from tidemark.streaming.states import followed, rocksdb

LATE = "48 hours"


def events_stream(spark: SparkSession, path: str, files: int = 64) -> DataFrame:
    """The event files as a stream, ``files`` at a time; its schema is that of the files, its times are UTC instants."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    within = _is_folder(spark, path)
    read = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet" if within else name).option("maxFilesPerTrigger", files)
    return read.parquet(path if within else folder).withColumn("ts", F.col("ts").cast("timestamp"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over all that is there; its result, with the number of the micro-batch that told each row, as a table in the shared folder."""
    return drained_with_progress(stream, mode)[0]


def drained_with_progress(stream: DataFrame, mode: str) -> tuple[DataFrame, list[dict]]:
    """The same with the progress of each micro-batch, which says what state was kept and dropped."""
    spark = stream.sparkSession
    out = fresh_folder(spark, "stream")

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite").parquet(f"{out}/data/batch={epoch}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    schema = stream.schema.add("epoch", "long")
    told = spark.read.option("recursiveFileLookup", "true").schema(schema).parquet(f"{out}/data") if _exists(spark, f"{out}/data") else spark.createDataFrame([], schema)
    return told, [json.loads(p.json) for p in query.recentProgress]


def once(events: DataFrame) -> DataFrame:
    """Events under the watermark; one that comes again within its delay counts once."""
    return events.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(["event_id"])


def daily_counts(spark: SparkSession, path: str) -> DataFrame:
    """Events by day and type.  Days are told again while they change, and forgotten once the watermark has passed them."""
    days = once(events_stream(spark, path)).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    last = latest(drained(days, "update"), ["window", "event_type"], ["epoch"])
    return last.select(F.to_date("window.start").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def sliding(events: DataFrame, days: int = 30) -> DataFrame:
    """(first, end, event_type, n, total) of the ``days`` before each midnight: told once, when the watermark has passed it."""
    spans = F.window("ts", f"{days} days", "1 day")
    each = once(events).groupBy(spans, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return each.select(F.to_date("window.start").alias("first"), F.to_date("window.end").alias("end"), "event_type", "n", F.round("total", 4).alias("total"))


def status_changes(spark: SparkSession, path: str) -> DataFrame:
    """(user_id, reopens, n): the latest state of each issue."""
    stream = events_stream(spark, path).select(F.col("user_id").alias("issue_id"), F.col("event_id").alias("n"), F.col("event_type").alias("to_status"), F.col("ts").alias("moved_at"))
    with rocksdb(spark):
        told = drained(followed(stream, LATE), "update")
    return latest(told, ["issue_id"], ["n", "settled"]).select(F.col("issue_id").alias("user_id"), "reopens", "n")
