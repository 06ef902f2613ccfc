"""Numeric rules that every metric shares: unknown is null, never zero; percentiles are exact (R-7)."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.session import staged


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where either is null or b is zero."""
    return F.when(b != 0, a.cast("double") / b)


def finite(x: Column) -> Column:
    """Null for NaN and infinities, so that no aggregate sees them."""
    d = x.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def r7(x: Column, p: float) -> Column:
    """Exact percentile with linear interpolation, over finite values."""
    return F.percentile(finite(x), F.lit(p))


def floored(x: Column, p: float, least: int) -> Column:
    """``r7`` if there are ``least`` finite values, else null."""
    return F.when(F.count(finite(x)) >= least, r7(x, p))


def p90(x: Column) -> Column:
    return floored(x, 0.9, 20)


def p95(x: Column) -> Column:
    return floored(x, 0.95, 30)


def seconds(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / 1e6


def waited(start: Column, end: Column) -> Column:
    """Seconds from start to end, never below zero; null if either is."""
    s = seconds(start, end)
    return F.when(s < 0, F.lit(0.0)).otherwise(s)


def rounded(x: Column, digits: int = 6) -> Column:
    return F.round(x.cast("double"), digits)


def quality(n: Column, least: int = 1) -> Column:
    return F.when(n == 0, "no_data").when(n < least, "insufficient_sample").otherwise("ok")


def bands(x: Column, steps: list[tuple[float, str]], rest: str) -> Column:
    """The name of the first step whose least value x reaches; null stays null."""
    first = reduce(lambda c, s: c.when(x >= s[0], s[1]), steps[1:], F.when(x >= steps[0][0], steps[0][1]))
    return F.when(x.isNotNull(), first.otherwise(rest))


def gini(counts: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Gini coefficient of the positive values, null for fewer than two of them, with how many there were.

    Equal values are counted before they are ranked, so ranking handles a row per distinct value.
    """
    by = by or []
    same = counts.where(F.col(value) > 0).groupBy(*by, F.col(value).alias("x")).agg(F.count(F.lit(1)).alias("c"))
    below = W.partitionBy(*(by or [F.lit(0)])).orderBy("x").rowsBetween(W.unboundedPreceding, -1)
    ranked = same.withColumn("before", F.coalesce(F.sum("c").over(below), F.lit(0)))
    weighed = ranked.withColumn("ix", F.col("x") * (F.col("c") * F.col("before") + F.col("c") * (F.col("c") + 1) / 2))
    n, total = F.sum("c"), F.sum(F.col("x") * F.col("c"))
    return weighed.groupBy(*by).agg(F.when(n >= 2, 2 * F.sum("ix") / (n * total) - (n + 1) / n).alias("gini"), F.coalesce(n, F.lit(0)).alias("n"))


def entropy_share(weight: Column, total: Column) -> Column:
    """One part's -p ln p."""
    p = ratio(weight, total)
    return F.when(p > 0, -p * F.log(p)).otherwise(F.lit(0.0))


def counted(df: DataFrame, value: str, slices: int = 256) -> DataFrame:
    """(``value``, c, below): each distinct value, how many rows have it and how many have a smaller one.

    Values are counted before anything is sorted, so ties cost nothing, and kept as a table, so ``df`` is worked
    out once; distinct values are cut at approximate quantiles into slices that are summed apart, so no task
    sorts them all.
    """
    return _ranked(*_same(df, value, slices), value)


def _same(df: DataFrame, value: str, slices: int) -> tuple[DataFrame, int, list]:
    """The counts of equal values, how many rows there are, and the ends of slices: one row that the driver is told."""
    same = staged(df.groupBy(value).agg(F.count(F.lit(1)).alias("c")), "counted")
    row = same.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.percentile_approx(value, [k / slices for k in range(1, slices)], 10_000).alias("ends")).first()
    return same, row["n"], sorted(set(row["ends"] or []))


def _ranked(same: DataFrame, n: int, ends: list, value: str) -> DataFrame:
    kind = same.schema[value].dataType
    at = F.size(F.filter(F.array(*[F.lit(e).cast(kind) for e in ends]), lambda e: e < F.col(value))) if ends else F.lit(0)
    sliced = same.withColumn("__s", at)
    before = W.partitionBy(F.lit(0)).orderBy("__at").rowsBetween(W.unboundedPreceding, -1)  # a row a slice
    starts = sliced.groupBy(F.col("__s").alias("__at")).agg(F.sum("c").alias("__c")).select("__at", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__start"))
    inside = F.coalesce(F.sum("c").over(W.partitionBy("__s").orderBy(value).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return sliced.withColumn("__i", inside).join(F.broadcast(starts), F.col("__s") == F.col("__at")).select(value, "c", (F.col("__start") + F.col("__i")).alias("below"))


def quantiles(df: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """One row: ``n`` finite values, and of each name the exact percentile (R-7), null without any.

    What ``percentile`` gives, without a table of all distinct values in one task; ``df`` is worked out once.
    """
    same, n, ends = _same(df.select(finite(F.col(value)).alias("x")).where("x is not null"), "x", 256)
    at = lambda r: F.max(F.when((F.col("below") <= r) & (F.col("below") + F.col("c") > r), F.col("x")))
    low = {k: math.floor((n - 1) * p) for k, p in shares.items()}
    picked = _ranked(same, n, ends, "x").agg(*[at(r).alias(f"{k}_lo") for k, r in low.items()], *[at(min(r + 1, n - 1)).alias(f"{k}_hi") for k, r in low.items()])
    made = [(F.col(f"{k}_lo") + F.lit((n - 1) * p - low[k]) * (F.col(f"{k}_hi") - F.col(f"{k}_lo"))).alias(k) for k, p in shares.items()]
    return picked.select(F.lit(n).cast("long").alias("n"), *made)


def mean_ranks(df: DataFrame, value: str, out: str) -> DataFrame:
    """Add the rank of ``value`` over all rows, ties sharing their mean rank.  ``value`` must be finite."""
    ranks = counted(df, value).select(F.col(value).alias("__v"), (F.col("below") + (F.col("c") + 1) / 2.0).alias(out))
    return df.join(ranks, F.col(value) == F.col("__v")).drop("__v")


# Two-sided critical t at 0.05 for 1 to 10 degrees of freedom, and the normal's.
T_05 = [12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228]
Z_05 = 1.96


def critical_t(df: Column) -> Column:
    """Critical t at 0.05: the table, then z + z (z^2 + 1) / (4 df)."""
    table = F.array(*map(F.lit, T_05))
    return F.when(df < 1, None).when(df <= len(T_05), F.get(table, (df - 1).cast("int"))).otherwise(Z_05 + Z_05 * (Z_05 * Z_05 + 1) / (4 * df))


def noisy_or(weights: Column) -> Column:
    """1 - prod(1 - w) of an array of weights; null weights don't count."""
    return F.aggregate(F.filter(weights, lambda w: w.isNotNull()), F.lit(1.0), lambda p, w: p * (1 - w), lambda p: 1 - p)


def robust_sd(sd: Column, mad: Column) -> Column:
    return F.greatest(F.coalesce(sd, F.lit(0.0)), 1.4826 * mad, F.lit(1e-9))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of an ASCII string, as a long."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))
    step = lambda h, c: F.pmod(h.bitwiseXOR(c) * F.lit(16777619).cast("long"), F.lit(1 << 32))
    return F.aggregate(F.filter(codes, lambda c: c > 0), F.lit(2166136261).cast("long"), step)


def poly31(text: Column) -> Column:
    """The 31-polynomial of an ASCII string modulo 2^32."""
    codes = F.filter(F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long")), lambda c: c > 0)
    return F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + c, F.lit(1 << 32)))


def normal(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))
