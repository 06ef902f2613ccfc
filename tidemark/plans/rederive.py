"""Snapshots kept up with late data: what is stale, what is closed, and what engine made it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.history import upsert
from tidemark.plans.catalog import ENGINE_VERSION

GRACE_HOURS = 48
CELL = ["scope", "metric", "day"]


class MixedVersions(ValueError):
    """A series was made by more than one version of the engine."""


def closed(day: Column, watermark: Column, now: Column) -> Column:
    """Data reaches the day's end and its grace is over: nothing more is expected."""
    end = F.date_add(day, 1).cast("timestamp")
    return F.coalesce((watermark >= end) & (F.unix_micros(now) - F.unix_micros(end) >= GRACE_HOURS * 3_600_000_000), F.lit(False))


def mark_stale(snapshots: DataFrame, late: DataFrame, trailing_days: int = 30) -> DataFrame:
    """Mark the cells whose trailing window holds a day of ``late`` (scope, day): that day and those after it.

    A late day touches as many cells as the window has days, so the join is on (scope, day), not a range.
    """
    touched = late.select("scope", F.explode(F.sequence(F.col("day"), F.date_add("day", trailing_days - 1))).alias("day")).distinct().withColumn("__touched", F.lit(True))
    marked = snapshots.join(touched, ["scope", "day"], "left")
    return marked.withColumn("stale", F.coalesce("stale", F.lit(False)) | F.col("__touched").isNotNull()).select(*snapshots.columns)


def rederive(snapshots: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Recompute stale cells and those of another engine version; the rest stays as it is.

    ``compute`` gets their (scope, metric, day) and returns those with value and data_quality.  A cell
    that it leaves out keeps its value and is flagged ``rederive_failed``.
    """
    due = snapshots.where(F.col("stale") | (F.col("engine_version") != ENGINE_VERSION))
    made = compute(due.select(*CELL)).select(*CELL, "value", "data_quality", F.lit(ENGINE_VERSION).alias("engine_version"), F.lit(False).alias("stale"), F.lit(1).alias("__v"))
    missing = due.join(made.select(*CELL), CELL, "left_anti").withColumn("data_quality", F.lit("rederive_failed")).withColumn("__v", F.lit(1))
    columns = [*CELL, "value", "data_quality", "engine_version", "stale", "__v"]
    return upsert(snapshots.withColumn("__v", F.lit(0)).select(columns), made.select(columns).unionByName(missing.select(columns)), CELL, "__v").drop("__v")


def one_version(snapshots: DataFrame) -> DataFrame:
    """The series as it is, if one version of the engine made each; else ``MixedVersions``."""
    mixed = snapshots.groupBy("scope", "metric").agg(F.countDistinct("engine_version").alias("n")).where("n > 1").limit(1).collect()
    if mixed:
        raise MixedVersions(f"{mixed[0]['scope']}, {mixed[0]['metric']}")
    return snapshots


def serve(snapshots: DataFrame, watermark: Column, now: Column, warn_hours: float = 4, refuse_hours: float = 24) -> DataFrame:
    """Values with their freshness; those of data that is too old, or that nothing is known of, are withheld."""
    hours = (F.unix_micros(now) - F.unix_micros(watermark)) / 3.6e9
    old = hours.isNull() | (hours >= refuse_hours)
    fresh = F.when(old, "refused").when(hours >= warn_hours, "warn").otherwise("ok")
    return snapshots.withColumn("freshness", fresh).withColumn("data_quality", F.when(old, "stale_refused").otherwise(F.col("data_quality"))).withColumn("value", F.when(~old, F.col("value")))
