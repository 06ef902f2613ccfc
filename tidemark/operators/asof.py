"""As-of joins: each row with the next, or the latest, event of its key.

One window over a key would put a key's whole history in one task.  Events of one instant are first reduced to
the one that counts, and rows to their instants; both are cut into time buckets.  A running window finds the event
within the bucket, and a table of one row per key and bucket says what the nearest later (earlier) bucket
starts (ends) with.  Rows then take the event of their instant.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.session import staged


def asof(rows: DataFrame, events: DataFrame, by: list[str], at: str, event_at: str, event_id: str, carry: list[str], forward: bool = True, bucket: str = "DAY") -> DataFrame:
    """Add struct ``event`` (``event_at``, ``event_id`` and ``carry``) to each row, null if there is none.

    Forward: the first event at or after ``at``; backward: the last at or before it.  Of events at one
    instant the smallest (backward: largest) ``event_id`` counts.  Null instants and keys match nothing;
    repeated rows each get their event.  ``bucket`` is the unit of the time buckets.
    """
    keys = [f"__k{i}" for i in range(len(by))]
    named = [F.col(c).alias(k) for c, k in zip(by, keys, strict=True)]
    known = lambda df, time: reduce(lambda d, c: d.where(F.col(c).isNotNull()), [*by, time], df)
    nearest = F.min_by if forward else F.max_by
    payload = F.struct(F.col(event_at), F.col(event_id), *[F.col(c) for c in carry])
    rows = staged(rows, "asof-rows")  # read twice
    asked = known(rows, at).select(*named, F.col(at).alias("__t")).distinct().withColumn("__asked", F.lit(True))
    told = known(events, event_at).select(*named, F.col(event_at).alias("__t"), F.col(event_id).cast("long").alias("__i"), payload.alias("event"))
    first = told.groupBy(*keys, "__t").agg(nearest("event", F.coalesce("__i", F.lit(-(1 << 63)))).alias("event"))
    instants = asked.unionByName(first, allowMissingColumns=True).withColumn("__b", F.date_trunc(bucket, "__t"))
    both = staged(instants, "asof")  # read twice
    # The nearest event comes before its row in this order, so the window only ever adds one: a frame that
    # ends at the last row is worked out anew for each.  Of one instant the event comes first.
    turn = (lambda c: F.desc(c)) if forward else (lambda c: F.asc(c))
    so_far = W.partitionBy(*keys, "__b").orderBy(turn("__t"), F.col("__asked").isNotNull()).rowsBetween(W.unboundedPreceding, W.currentRow)
    within = both.withColumn("__within", F.last("event", ignorenulls=True).over(so_far)).where("__asked")
    edge = both.groupBy(*keys, "__b").agg(nearest("event", F.when(F.col("event").isNotNull(), F.col("__t"))).alias("__edge"))
    beyond = W.partitionBy(*keys).orderBy(turn("__b")).rowsBetween(W.unboundedPreceding, -1)
    edges = edge.select(*keys, "__b", F.last("__edge", ignorenulls=True).over(beyond).alias("__beyond"))
    found = within.join(edges, [*keys, "__b"], "left").select(*keys, "__t", F.coalesce("__within", "__beyond").alias("event"))
    on = reduce(lambda a, b: a & b, [F.col(c) == F.col(k) for c, k in zip([*by, at], [*keys, "__t"], strict=True)])
    return rows.join(found, on, "left").select(*rows.columns, "event")
