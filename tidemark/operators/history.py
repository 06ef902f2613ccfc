"""Operators on histories: current rows, effective-dated rows, status intervals, idempotent merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def latest(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``: an aggregate, pre-aggregated before its shuffle, not a sort."""
    rest = [c for c in df.columns if c not in by]
    last = df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return last.select(*by, *[F.col(f"__row.`{c}`").alias(c) for c in rest]).select(*df.columns)


def upsert(old: DataFrame, new: DataFrame, by: list[str], version: str) -> DataFrame:
    """Last writer wins: of all rows of a key the one of the greatest ``version``, the new one on ties."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return latest(both, by, [version, "__new"]).drop("__new")


def append_ignore(old: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """Old rows, and the first of each key that old rows lack."""
    return old.unionByName(new.dropDuplicates(by).join(old.select(*by).distinct(), by, "left_anti"))


def tombstone(stored: DataFrame, listed: DataFrame, by: list[str], at: Column, deleted: str = "deleted_at") -> DataFrame:
    """Stored rows that the live listing lacks are marked deleted, those deleted before as they were."""
    live = listed.select(*by).distinct().withColumn("__live", F.lit(True))
    marked = F.when(F.col("__live").isNull() & F.col(deleted).isNull(), at).otherwise(F.col(deleted))
    return stored.join(live, by, "left").withColumn(deleted, marked).select(*stored.columns)


def effective(df: DataFrame, by: list[str], start: str, out: str = "valid_to") -> DataFrame:
    """Close each version where its key's next one starts."""
    return df.withColumn(out, F.lead(start).over(W.partitionBy(*by).orderBy(start)))


def as_of(df: DataFrame, by: list[str], at: Column, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """The version of each key that holds at an instant: start <= at < end; the newest start on overlaps."""
    holds = df.where((F.col(start) <= at) & (F.col(end).isNull() | (F.col(end) > at)))
    return latest(holds, by, [start])


def status_intervals(transitions: DataFrame, created: DataFrame, now: Column, key: str = "issue_id") -> DataFrame:
    """(key, status, begin, end): how long each status held, from creation on and to ``now``.

    ``transitions`` has key, n, from_status, to_status, moved_at; ``created`` key and created_at.  What held
    before the first transition is its ``from_status``.
    """
    at = W.partitionBy(key).orderBy("moved_at", "n")
    after = transitions.select(key, F.col("to_status").alias("status"), F.col("moved_at").alias("begin"), F.coalesce(F.lead("moved_at").over(at), now).alias("end"))
    first = transitions.groupBy(key).agg(F.min_by("from_status", F.struct("moved_at", "n")).alias("status"), F.min("moved_at").alias("end"))
    before = first.join(created.select(key, "created_at"), key).select(key, "status", F.col("created_at").alias("begin"), "end")
    return after.unionByName(before).where("status is not null and begin < end")


def prune(tables: dict[str, DataFrame], times: dict[str, str], cutoff: Column, children: dict[str, tuple[str, list[str]]] | None = None) -> dict[str, DataFrame]:
    """What retention keeps: rows at or after the day of ``cutoff``, and children whose parent is kept.

    ``times`` names each aged table's time column (null times are kept); ``children`` each other table's
    parent and the shared keys.  Nothing is written: counting what is kept is the dry run.
    """
    floor = F.date_trunc("DAY", cutoff)
    kept = {name: df.where(F.col(times[name]).isNull() | (F.col(times[name]) >= floor)) if name in times else df for name, df in tables.items()}
    for name, (parent, keys) in (children or {}).items():
        kept[name] = kept[name].join(kept[parent].select(*keys).distinct(), keys, "left_semi")
    return kept
