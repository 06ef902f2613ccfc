"""What changed lines were before: hunks against the lines that others own, by age and by author.

Files are cut into stretches of 64 lines, and what an interval covers of a stretch is the bits of one long.  So a
hunk meets the owners of its stretches, not all of its file, a large file is dealt over tasks, and no line
is ever a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

STRETCH = 64
CLASSES = ("new", "legacy_refactor", "help_others", "rework")


def _stretches(df: DataFrame, first: str, last: str) -> DataFrame:
    """Each interval cut at the ends of its stretches: (stretch, bits) for every one that it touches."""
    at = lambda c: F.floor((F.col(c) - 1) / STRETCH)
    cut = df.where(F.col(first) <= F.col(last)).withColumn("stretch", F.explode(F.sequence(at(first), at(last))))
    start = F.col("stretch") * STRETCH + 1
    lo, hi = (F.greatest(F.col(first), start) - start).cast("int"), (F.least(F.col(last), start + STRETCH - 1) - start).cast("int")
    return cut.withColumn("bits", _upto(hi).bitwiseAND(F.bitwise_not(_upto(lo - 1))))


def _upto(n: Column) -> Column:
    """The bits 0 to ``n`` of a long, none for -1."""
    return F.when(n < 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), STRETCH - 1 - n))


def _kind(recent_days: int) -> Column:
    old = F.col("at") > F.col("changed_at") + F.expr(f"interval {int(recent_days)} days")
    return F.when(old, "legacy_refactor").when(F.col("owner") != F.col("author"), "help_others").otherwise("rework")


def _met(mine: DataFrame, theirs: DataFrame, keep: list[str], recent_days: int) -> DataFrame:
    """(``keep``, kind, n): the lines that stretches of hunks share with stretches that somebody owns."""
    shared = F.bit_count(F.col("bits").bitwiseAND(F.col("owned"))).cast("long")
    owned = theirs.select("path", "stretch", F.col("author").alias("owner"), "changed_at", F.col("bits").alias("owned"))
    met = mine.join(owned, ["path", "stretch"]).where(F.col("bits").bitwiseAND(F.col("owned")) != 0)
    return met.select(*keep, _kind(recent_days).alias("kind"), shared.alias("n"))


def _sums(met: DataFrame, by: str) -> DataFrame:
    return met.groupBy(by).agg(*[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(k) for k in CLASSES[1:]])


def _classed(all_: DataFrame, sums: DataFrame, by: str) -> DataFrame:
    """(``by``, lines, new and the other classes): what was met of all lines, the rest is new."""
    known = all_.join(sums, by, "left").select(by, "lines", *[F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in CLASSES[1:]])
    return known.select(by, "lines", (F.col("lines") - sum(F.col(k) for k in CLASSES[1:])).alias("new"), *CLASSES[1:])


def _lines() -> Column:
    return F.greatest(F.col("last_line") - F.col("first_line") + 1, F.lit(0)).cast("long")


def work_types(hunks: DataFrame, blame: DataFrame, recent_days: int = 30) -> DataFrame:
    """(hunk, lines, new, legacy_refactor, help_others, rework) in lines, for each of ``hunks``.

    ``hunks`` has hunk (unique), path, author, at, first_line, last_line; ``blame`` path, first_line, last_line, author,
    changed_at, disjoint within a path.  A line that nothing is known of is new; one changed over ``recent_days`` ago
    is legacy, whoever wrote it; of recent ones those of another are help, one's own are rework.  A hunk without
    lines has zeros.
    """
    mine = _stretches(hunks.select("hunk", "path", "author", "at", "first_line", "last_line"), "first_line", "last_line")
    met = _met(mine, _stretches(blame, "first_line", "last_line"), ["hunk"], recent_days)
    return _classed(hunks.select("hunk", _lines().alias("lines")), _sums(met, "hunk"), "hunk")


def work_types_by_author(changes: DataFrame, before: DataFrame, recent_days: int = 30) -> DataFrame:
    """(author, lines and the classes) of all ``changes``, by what blame after those ``before`` says.

    Both are (path, id, author, at, first_line, last_line).  Sums need no hunk's own result, so changes are summed
    by author where they meet the owners.
    """
    mine = _stretches(changes.select("path", "author", "at", "first_line", "last_line"), "first_line", "last_line").select("path", "stretch", "author", "at", "bits")
    lines = changes.groupBy("author").agg(F.sum(_lines()).alias("lines"))
    return _classed(lines, _sums(_met(mine, owned_bits(before), ["author"], recent_days), "author"), "author")


def owned_bits(changes: DataFrame) -> DataFrame:
    """(path, stretch, bits, id, author, changed_at): the lines of a stretch that a change still owns after all changes.

    From the latest change of a stretch to the earliest, each owns what no later one covers; ties go to the greatest id.
    """
    latest = W.partitionBy("path", "stretch").orderBy(F.desc("at"), F.desc("id"), F.desc("author")).rowsBetween(W.unboundedPreceding, -1)
    parts = _stretches(changes, "first_line", "last_line").select("path", "stretch", "bits", "id", "author", F.col("at"))
    later = F.coalesce(F.bit_or("bits").over(latest), F.lit(0).cast("long"))
    left = parts.withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not(later))).where("bits <> 0")
    return left.select("path", "stretch", "bits", "id", "author", F.col("at").alias("changed_at"))


def blame_of(changes: DataFrame) -> DataFrame:
    """(path, first_line, last_line, author, changed_at) after changes (path, id, author, at, first_line, last_line).

    A line belongs to its latest change, ties to the greatest id; lines in a row of one change in a stretch are one interval.
    """
    bit = lambda n: F.col("bits").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), n)) != 0
    every = F.sequence(F.lit(0), F.lit(STRETCH - 1))
    starts = F.filter(every, lambda n: bit(n) & ((n == 0) | ~bit(F.greatest(n - 1, F.lit(0)))))
    ends = F.filter(every, lambda n: bit(n) & ((n == STRETCH - 1) | ~bit(F.least(n + 1, F.lit(STRETCH - 1)))))
    runs = owned_bits(changes).withColumn("run", F.explode(F.arrays_zip(starts.alias("a"), ends.alias("b"))))
    line = lambda c: (F.col("stretch") * STRETCH + 1 + F.col(c)).cast("int").alias({"run.a": "first_line", "run.b": "last_line"}[c])
    return runs.select("path", line("run.a"), line("run.b"), "author", "changed_at")
