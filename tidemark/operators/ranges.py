"""What held at an instant: rows looked up in versions that are valid from one time to another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held_at(rows: DataFrame, versions: DataFrame, by: dict[str, str], at: str, carry: list[str], start: str = "valid_from", end: str = "valid_to", bucket: str = "MONTH") -> DataFrame:
    """``rows`` with ``held``, a struct of ``carry`` of the version that holds at ``at``: start <= at < end, null end for ever.

    ``by`` maps columns of rows to those of versions.  Of versions that overlap the newest start counts; a row
    that no version covers, or whose key or instant is null, has null.  Time is cut into buckets: a version is
    listed once for each bucket that it covers and rows reach, so a key's rows meet only the versions of their
    bucket, and rows stay as many as they are.
    """
    first, last = rows.agg(F.min(at), F.max(at)).first()
    if first is None:
        return rows.withColumn("held", F.lit(None).cast(versions.select(F.struct(*carry).alias("x")).schema["x"].dataType))
    low, high = F.lit(first), F.lit(last)
    reached = versions.where((F.col(start) <= high) & (F.col(end).isNull() | (F.col(end) > low)))
    cut = lambda c: F.date_trunc(bucket, c)
    covered = F.sequence(cut(F.greatest(F.col(start), low)), cut(F.least(F.coalesce(F.col(end), high), high)), F.expr(f"interval 1 {bucket}"))
    listed = reached.select(*[F.col(b).alias(f"__k{i}") for i, b in enumerate(by.values())], F.explode(covered).alias("__b"), F.struct(F.col(start).alias("start"), F.col(end).alias("end"), F.struct(*carry).alias("held")).alias("v"))
    keys = [f"__k{i}" for i in range(len(by))]
    lists = listed.groupBy(*keys, "__b").agg(F.collect_list("v").alias("__v"))  # the versions of one key in one bucket
    on = cut(F.col(at)) == F.col("__b")
    for a, k in zip(by, keys, strict=True):
        on = on & (F.col(a) == F.col(k))
    joined = rows.join(lists, on, "left")
    holds = F.filter("__v", lambda v: (v["start"] <= F.col(at)) & (v["end"].isNull() | (v["end"] > F.col(at))))
    newest = F.aggregate(holds, F.lit(None).cast(lists.schema["__v"].dataType.elementType), lambda best, v: F.when(best.isNull() | (v["start"] >= best["start"]), v).otherwise(best))
    return joined.select(*rows.columns, newest["held"].alias("held"))
