"""Stored snapshots: a Parquet table partitioned by day, of which a write replaces only the days it touches.

A cell is a (scope, metric, day).  A cell of a closed day that is fresh, made by this version of the engine from
the same watermark, is never worked out again; all others are, and replace what was there.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.catalog import ENGINE_VERSION
from tidemark.plans.rederive import CELL, closed, mark_stale
from tidemark.session import staged

VALUES = "scope string, metric string, day date, n long, value double, p90 double, data_quality string"
SCHEMA = f"{VALUES}, engine_version string, watermark timestamp, stale boolean"
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


class SnapshotStore:
    """Snapshots in a folder; ``path`` is one that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def read(self, first: dt.date | str | None = None, last: dt.date | str | None = None, scopes: list[str] | None = None, metrics: list[str] | None = None) -> DataFrame:
        """The cells of a range of days, both included: only its days' partitions are listed and read."""
        if not self._exists():
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(self.path).select(_COLUMNS)
        if first is not None:
            rows = rows.where(F.col("day") >= F.lit(str(first)).cast("date"))
        if last is not None:
            rows = rows.where(F.col("day") <= F.lit(str(last)).cast("date"))
        for column, own in (("scope", scopes), ("metric", metrics)):
            if own is not None:
                rows = rows.where(F.col(column).isin(own))
        return rows

    def put(self, cells: DataFrame) -> None:
        """Write cells over those of the same key; days without one stay as they are, file by file."""
        new = staged(cells.select(_COLUMNS), "cells")
        first, last = new.agg(F.min("day"), F.max("day")).first()
        if first is None:
            return
        days = F.broadcast(new.select("day").distinct())  # a row a day
        old = self.read(first, last).join(days, "day", "left_semi").join(new.select(*CELL), CELL, "left_anti")
        whole = staged(old.select(_COLUMNS).unionByName(new), "cells")  # what is read can't be written over
        whole.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(self.path)

    def due(self, asked: DataFrame, watermark: Column, now: Column) -> DataFrame:
        """The cells of ``asked`` (scope, metric, day) but those of closed days that are stored fresh."""
        first, last = asked.agg(F.min("day"), F.max("day")).first()
        if first is None:
            return asked.select(*CELL)
        fresh = self.read(first, last).where(~F.col("stale") & (F.col("engine_version") == ENGINE_VERSION) & F.col("watermark").eqNullSafe(watermark))
        return asked.select(*CELL).join(fresh.where(closed(F.col("day"), watermark, now)).select(*CELL), CELL, "left_anti")

    def snapshot(self, asked: DataFrame, compute: Callable[[DataFrame], DataFrame], watermark: Column, now: Column) -> int:
        """Work out and store what is due of ``asked``; ``compute`` gets its cells and returns their values.  Returns how many were written."""
        due = staged(self.due(asked, watermark, now), "due")
        if due.isEmpty():
            return 0
        made = staged(compute(due).join(due, CELL, "left_semi").select(*[c.split()[0] for c in VALUES.split(", ")], F.lit(ENGINE_VERSION).alias("engine_version"), watermark.cast("timestamp").alias("watermark"), F.lit(False).alias("stale")), "made")
        self.put(made)
        return made.count()

    def mark_late(self, late: DataFrame, trailing_days: int = 30) -> None:
        """Mark cells stale whose trailing window holds a day of ``late`` (scope, day)."""
        first, last = late.agg(F.min("day"), F.max("day")).first()
        if first is None:
            return
        reach = self.read(first, last + dt.timedelta(trailing_days - 1))
        marked = mark_stale(reach.withColumn("was", F.col("stale")), late, trailing_days)
        self.put(marked.where("stale and not was"))
