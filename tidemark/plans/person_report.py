"""The report of a person: each of their metrics against the cohort's, computed for everyone at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.stats import bands, robust_sd
from tidemark.plans.catalog import load
from tidemark.tables import Tables

#: Metrics of the report and which way is better: 1 up, -1 down, 0 neither.
POLARITY = {
    "person.review_reciprocity": 1,
    "person.knowledge_ownership_index": 0,
    "person.ci_green_before_merge_rate": 1,
    "person.ticket_linkage_rate": 1,
    "person.test_inclusion_rate": 1,
    "person.wip_small_pr_discipline": 1,
    "pr.changes_requested_rate_received": -1,
    "pr.review_bypass_rate_received": -1,
    "person.complexity_authored_delta": -1,
    "person.high_complexity_file_share": 0,
    "person.pr_conceptual_surface": 0,
    "person.worktype_mix": 0,
    "person.bugfix_share": 0,
    "person.skill_domain_footprint": 0,
    "person.momentum_vs_team": 1,
    "person.design_bearing_ratio": 0,
    "person.pr_review_difficulty": 0,
    "person.pr_atomicity": 1,
    "person.pr_description_quality": 1,
    "person.convention_adherence": 1,
    "pr.feedback_severity_mix_received": -1,
    "person.review_depth_mentorship": 1,
    "person.ai_blend_rework_coupling": 0,
}
LEAST_PEOPLE = 8


def values(t: Tables, only: list[str] | None = None) -> DataFrame:
    """(metric, person_id, value), long: one plan a metric, none a person."""
    known = load()
    parts = [known[m].plan(t).select(F.lit(m).alias("metric"), F.col("person_id").cast("long").alias("person_id"), F.col("value").cast("double").alias("value")) for m in (only or POLARITY)]
    return reduce(DataFrame.unionByName, parts).where("value is not null")


def against_cohort(rows: DataFrame) -> DataFrame:
    """Add each metric's cohort to (metric, person_id, value): z, its direction, its band and percentile rank.

    The cohort's numbers are a row a metric, joined back; fewer than eight people are no cohort.
    """
    middle = rows.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.median("value").alias("p50"), F.stddev_samp("value").alias("sd"))
    spread = rows.join(F.broadcast(middle.select("metric", "p50")), "metric").groupBy("metric").agg(F.median(F.abs(F.col("value") - F.col("p50"))).alias("mad"))
    way = F.create_map(*[F.lit(x) for pair in POLARITY.items() for x in pair])[F.col("metric")]
    joined = rows.join(F.broadcast(middle.join(spread, "metric")), "metric")
    z = F.when(F.col("n") >= LEAST_PEOPLE, (F.col("value") - F.col("p50")) / robust_sd(F.col("sd"), F.col("mad")))
    told = joined.withColumn("z", z).withColumn("standing", F.col("z") * F.when(F.coalesce(way, F.lit(0)) == 0, F.lit(1)).otherwise(way))
    same = rows.groupBy("metric", "value").agg(F.count(F.lit(1)).alias("c"))
    upto = same.withColumn("below", F.sum("c").over(W.partitionBy("metric").orderBy("value"))).drop("c")
    return told.join(upto, ["metric", "value"]).select(
        "metric", "person_id", "value", "n", "z", "standing", bands(F.abs("z"), [(2.0, "outlier"), (1.0, "notable")], "typical").alias("band"), (F.col("below") / F.col("n")).alias("percentile")
    )


def person(t: Tables, person_id: int, only: list[str] | None = None) -> DataFrame:
    """One person's report."""
    return against_cohort(values(t, only)).where(F.col("person_id") == person_id).orderBy("metric")


def difference_in_differences(before: DataFrame, after: DataFrame, treated: list[int]) -> DataFrame:
    """(metric, did): how much more the treated changed than the others, of (metric, person_id, value) each."""
    both = before.withColumnRenamed("value", "a").join(after.withColumnRenamed("value", "b"), ["metric", "person_id"])
    d, own = F.col("b") - F.col("a"), F.col("person_id").isin(*treated)
    return both.groupBy("metric").agg((F.avg(F.when(own, d)) - F.avg(F.when(~own, d))).alias("did"))
