"""Counts, sums and exact percentiles of a window that slides by days, for all its days at once.

What a day has is kept as counted values: a row for each distinct value of a key and day.  They add up: a
window's counts are the sums of its days'.  A percentile is found in two steps, so that no row is repeated
for each window that holds it: values are cut into slices at approximate quantiles of their key, the slices'
daily counts slide as a few numbers a day and tell which slice holds the wanted rank; only that slice's values
are then looked at.  Slices' ends decide how much is looked at, never what is found.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.session import staged

SLICES = 64


def counted_days(facts: DataFrame, by: list[str]) -> DataFrame:
    """(``by``, day, v, c): each day's distinct values and how often each occurs; null values don't count."""
    return facts.where("v is not null and not isnan(v)").groupBy(*by, "day", "v").agg(F.count(F.lit(1)).alias("c"))


def trailing(states: DataFrame, by: list[str], first: str, last: str, days: int, shares: dict[str, float], slices: int = SLICES) -> DataFrame:
    """(``by``, day, n, total, one column for each of ``shares``) of the ``days`` that end with each day from first to last.

    ``states`` is what ``counted_days`` gives; every key that has a value in reach gets a row for each day.
    Percentiles interpolate (R-7) and are null where there is nothing.
    """
    start = F.date_sub(F.lit(first).cast("date"), days - 1)
    reach = states.where((F.col("day") >= start) & (F.col("day") <= F.lit(last).cast("date")))
    ends = reach.groupBy(*by).agg(F.percentile_approx("v", [k / slices for k in range(1, slices)], 10_000).alias("ends"))
    at = F.size(F.filter("ends", lambda e: e < F.col("v")))
    chunk = lambda day: F.floor(F.unix_date(day) / days)
    sliced = staged(reach.join(ends, by).select(*by, "day", "v", "c", at.alias("slice"), chunk(F.col("day")).alias("chunk")), "sliced")

    # below[i]: how many of the day's values lie in slices 0 to i
    below = [F.sum(F.when(F.col("slice") <= i, F.col("c")).otherwise(0)) for i in range(slices)]
    daily = sliced.groupBy(*by, "day").agg(F.sum(F.col("v") * F.col("c")).alias("total"), F.array(*below).alias("below"))
    grid = sliced.select(*by).distinct().select(*by, F.explode(F.sequence(start, F.lit(last).cast("date"))).alias("day"))
    over = W.partitionBy(*by).orderBy("day").rowsBetween(1 - days, 0)  # a row a day
    none = F.array_repeat(F.lit(0).cast("long"), slices)
    dense = grid.join(daily, [*by, "day"], "left").withColumn("below", F.coalesce("below", none))
    slid = dense.select(*by, "day", F.coalesce(F.sum("total").over(over), F.lit(0.0)).alias("total"), F.array(*[F.sum(F.get("below", F.lit(i))).over(over) for i in range(slices)]).alias("below"))
    windows = slid.where(F.col("day") >= F.lit(first).cast("date")).withColumn("n", F.get("below", F.lit(slices - 1)))

    rank = lambda p, up: F.least(F.floor((F.col("n") - 1) * p).cast("long") + up, F.col("n") - 1)
    asked = F.array(*[F.struct(F.lit(f"{name}_{up}").alias("what"), rank(p, up).alias("r")) for name, p in shares.items() for up in (0, 1)])
    wanted = windows.where("n > 0").select(*by, F.col("day").alias("to"), "below", F.inline(asked))
    placed = wanted.withColumn("slice", F.size(F.filter("below", lambda b: b <= F.col("r"))))
    placed = placed.select(*by, "to", "what", "slice", F.when(F.col("slice") == 0, F.col("r")).otherwise(F.col("r") - F.get("below", F.col("slice") - 1)).alias("r"))
    reached = placed.withColumn("chunk", F.explode(F.array_distinct(F.array(chunk(F.date_sub("to", days - 1)), chunk(F.col("to"))))))
    seen = reached.join(sliced, [*by, "slice", "chunk"]).where((F.col("day") <= F.col("to")) & (F.col("day") > F.date_sub("to", days)))
    before = F.sum("c").over(W.partitionBy(*by, "to", "what").orderBy("v", "day"))  # one slice of one window
    found = seen.withColumn("upto", before).where((F.col("upto") > F.col("r")) & (F.col("upto") - F.col("c") <= F.col("r")))
    picked = found.groupBy(*by, F.col("to").alias("day")).agg(*[F.max(F.when(F.col("what") == f"{name}_{up}", F.col("v"))).alias(f"{name}_{up}") for name in shares for up in (0, 1)])
    part = lambda p: (F.col("n") - 1) * p - F.floor((F.col("n") - 1) * p)
    made = [(F.col(f"{name}_0") + part(p) * (F.col(f"{name}_1") - F.col(f"{name}_0"))).alias(name) for name, p in shares.items()]
    return windows.join(picked, [*by, "day"], "left").select(*by, "day", "n", "total", *made)
