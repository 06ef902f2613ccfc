"""Reports against a prior baseline, from stored snapshots, and the weekly trend of all people."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.stats import finite, r7, robust_sd, rounded, waited
from tidemark.plans.backfill import _FACTS_SQL, TRAILING_DAYS, _cells_sql, _merged_rows, cells, day_states, keep_snapshots
from tidemark.plans.catalog import metric
from tidemark.plans.pull_requests import sizes
from tidemark.session import fresh_folder, staged
from tidemark.sources.snapshot_store import SnapshotStore
from tidemark.tables import TO, Tables

BASELINE_DAYS = 90
# The least baseline, the noise band and the outer one in robust deviations, the same as shares of a
# flat baseline, and what counts as no spread.
LEAST, NOISE, WELL, FLAT_NOISE, FLAT_WELL, EPS = 5, 0.5, 1.5, 0.1, 0.25, 1e-9


def flat(sd: Column, mad: Column) -> Column:
    """No spread to speak of: neither deviation is known and above nothing."""
    return (F.coalesce(sd, F.lit(0.0)) <= EPS) & (F.coalesce(mad, F.lit(0.0)) <= EPS)


def judged(v: Column, n: Column, p50: Column, mean: Column, sd: Column, mad: Column) -> dict[str, Column]:
    """delta, delta_pct, band, arrow, z and significant of a value against a baseline.

    Bands are of robust deviations from the median; a flat baseline has none, so its bands are of the share that the
    value moved by, and any move from a flat zero is a whole one.  Under five values nothing is said.
    """
    few = (n < LEAST) | p50.isNull() | v.isNull()
    delta = v - p50
    none, share = flat(sd, mad), F.abs(delta / F.when(p50 != 0, p50))
    far = F.when(~none, delta / robust_sd(sd, mad))
    side = lambda up, down: F.when(delta > 0, up).otherwise(down)
    of_flat = F.when(delta == 0, "in_line").when(p50 == 0, side("well_above", "well_below")).when(share <= FLAT_NOISE, "in_line").when(share >= FLAT_WELL, side("well_above", "well_below")).otherwise(side("above", "below"))
    of_spread = F.when(far <= -WELL, "well_below").when(far < -NOISE, "below").when(far <= NOISE, "in_line").when(far < WELL, "above").otherwise("well_above")
    steady = F.when(none, of_flat == "in_line").otherwise(F.abs(far) <= NOISE)
    arrow = F.when(few | steady, "steady").otherwise(side("up", "down"))
    return {
        "delta": F.when(~few, delta),
        "delta_pct": F.when(~few & (p50 != 0), delta / p50),
        "band": F.when(few, "unknown").when(none, of_flat).otherwise(of_spread),
        "arrow": arrow,
        "z": F.when(~few & ~none & (sd > 0), (v - mean) / F.when(sd > 0, sd)),
        "significant": arrow != "steady",
    }


def drifted(now: Column, p50: Column, sd: Column, mad: Column) -> Column:
    """What a new median says of the one before: stable, shifting, a change of regime, or that there was none."""
    delta = now - p50
    share = F.abs(delta / F.when(p50 != 0, p50))
    of_flat = F.when(delta == 0, "stable").when(p50 == 0, "regime_change").when(share < FLAT_NOISE, "stable").when(share < FLAT_WELL, "shifting").otherwise("regime_change")
    z = F.abs(delta / robust_sd(sd, mad))
    return F.when(now.isNull() | p50.isNull(), "cold_start").when(flat(sd, mad), of_flat).when(z < 1, "stable").when(z < 2, "shifting").otherwise("regime_change")


def summaries(values: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """(``by``, n, p50, mean, sd, mad, values) of the finite values of each key; a key has a value a day."""
    known = values.withColumn("__v", finite(F.col(value))).where("__v is not null")
    centred = known.withColumn("__med", F.percentile("__v", F.lit(0.5)).over(W.partitionBy(*by)))
    return centred.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), r7(F.col("__v"), 0.5).alias("p50"), F.avg("__v").alias("mean"), F.stddev_samp("__v").alias("sd"), r7(F.abs(F.col("__v") - F.col("__med")), 0.5).alias("mad"), F.collect_list("__v").alias("values"))


def report_cells(store: SnapshotStore, asked: DataFrame, first: str, last: str, live: Callable[[DataFrame], DataFrame] | None = None, baseline_days: int = BASELINE_DAYS) -> DataFrame:
    """A report's cells for ``asked`` (scope, metric) over the days from first to last.

    A cell's value is its latest stored one that isn't null and not stale; its baseline are the ``baseline_days``
    before.  ``live`` is asked for (scope, metric, value) of those cells alone that have no snapshot in the period.
    """
    end = dt.date.fromisoformat(first) - dt.timedelta(1)
    key = ["scope", "metric"]
    rows = store.read(end - dt.timedelta(baseline_days - 1), last).where("not stale").join(asked.select(*key), key, "left_semi")
    now = rows.where(F.col("day") >= F.lit(first).cast("date"))
    told = now.groupBy(*key).agg(F.count(F.lit(1)).alias("days"), F.max_by("value", F.when(F.col("value").isNotNull(), F.col("day"))).alias("value"))
    held = asked.select(*key).join(told, key, "left").withColumn("source", F.when(F.col("days").isNotNull(), "stored"))
    if live is not None:
        missing = asked.select(*key).join(told.select(*key), key, "left_anti")
        found = live(missing).select(*key, F.col("value").alias("live"))
        held = held.join(found, key, "left").select(*key, "days", F.coalesce("value", "live").alias("value"), F.coalesce("source", F.when(F.col("live").isNotNull(), "live")).alias("source"))
    base = summaries(rows.where(F.col("day") < F.lit(first).cast("date")), key)
    joined = held.join(base, key, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    v = F.col("value")
    parts = judged(v, *[F.col(c) for c in ("n", "p50", "mean", "sd", "mad")])
    within = F.size(F.filter("values", lambda x: x <= v)) / F.size("values")
    return joined.select(*key, "value", "source", "n", F.col("p50").alias("baseline_p50"), *[c.alias(k) for k, c in parts.items()], F.when(parts["band"] != "unknown", within).alias("percentile"))


_UNSTORED = "pr.size"
_FIRST_SQL, _LAST_SQL = f"(date '{TO}' - {TRAILING_DAYS - 1})", f"date '{TO}'"


@metric(
    "report.against_baseline",
    _cells_sql(f"({_FIRST_SQL} - {BASELINE_DAYS})", _LAST_SQL)
    + f""", st as (select * from cell where metric <> '{_UNSTORED}'), cu as (select "scope", metric, arg_max(value, "day") filter (value is not null) v, 'stored' source from st where "day" >= {_FIRST_SQL} group by 1, 2
 union all select "scope", metric, value, case when value is not null then 'live' end from cell where metric = '{_UNSTORED}' and "day" = {_LAST_SQL}),
md as (select "scope", metric, median(value) med from st where "day" < {_FIRST_SQL} group by 1, 2),
ba as (select s."scope", s.metric, count(value) n, median(value) p50, avg(value) mean, stddev_samp(value) sd, median(abs(value - med)) mad, list(value) filter (value is not null) vs from st s join md on md."scope" = s."scope" and md.metric = s.metric where "day" < {_FIRST_SQL} group by 1, 2),
j as (select cu."scope", cu.metric, v, source, coalesce(n, 0) n, p50, mean, sd, mad, vs, coalesce(n, 0) < {LEAST} or p50 is null or v is null few, coalesce(sd, 0) <= {EPS} and coalesce(mad, 0) <= {EPS} flat, v - p50 delta, abs((v - p50) / nullif(p50, 0)) share, (v - p50) / greatest(coalesce(sd, 0), 1.4826 * mad, {EPS}) far from cu left join ba on ba."scope" = cu."scope" and ba.metric = cu.metric),
k as (select *, case when few then 'unknown' when flat then case when delta = 0 then 'in_line' when p50 = 0 then case when delta > 0 then 'well_above' else 'well_below' end when share <= {FLAT_NOISE} then 'in_line' when share >= {FLAT_WELL} then case when delta > 0 then 'well_above' else 'well_below' end when delta > 0 then 'above' else 'below' end
 when far <= -{WELL} then 'well_below' when far < -{NOISE} then 'below' when far <= {NOISE} then 'in_line' when far < {WELL} then 'above' else 'well_above' end band from j)
select "scope", metric, round(v, 6) as value, source, n, round(p50, 6) baseline_p50, case when not few then round(delta, 6) end delta, case when not few then round(delta / nullif(p50, 0), 6) end delta_pct, band, case when band in ('unknown', 'in_line') then 'steady' when delta > 0 then 'up' else 'down' end arrow,
 case when not few and not flat and sd > 0 then round((v - mean) / sd, 6) end z, band not in ('unknown', 'in_line') significant, case when not few then round(len(list_filter(vs, lambda x: x <= v)) / len(vs)::double, 6) end percentile from k""",
)
def against_baseline(t: Tables) -> DataFrame:
    """Every team's metrics over the last 30 days against the 90 days before, from stored snapshots; one metric that isn't stored is worked out live."""
    last = dt.date.fromisoformat(t.window.last)
    back = lambda days: str(last - dt.timedelta(days))
    store, states = SnapshotStore(t.spark, fresh_folder(t.spark, "snapshots")), staged(day_states(t), "day_states")
    first = back(TRAILING_DAYS - 1)
    keep_snapshots(store, states.where(F.col("metric") != _UNSTORED), back(TRAILING_DAYS + BASELINE_DAYS - 1), str(last), back(-1), back(-1))

    def live(missing: DataFrame) -> DataFrame:
        return cells(states.join(missing, ["scope", "metric"], "left_semi"), str(last), str(last)).select("scope", "metric", "value")

    reached = states.where((F.col("day") > F.lit(back(TRAILING_DAYS + BASELINE_DAYS + TRAILING_DAYS - 1)).cast("date")) & (F.col("day") <= F.lit(str(last)).cast("date")))
    asked = reached.select("scope", "metric").distinct()
    made = report_cells(store, asked, first, str(last), live)
    return made.select("scope", "metric", *[rounded(F.col(c)).alias(c) if c in ("value", "baseline_p50", "delta", "delta_pct", "z", "percentile") else F.col(c) for c in made.columns[2:]])


WEEKS = 13


def weekly_panel(t: Tables, weeks: int = WEEKS) -> DataFrame:
    """(person_id, week, merged, time_to_merge, size, unreviewed): each author's last ``weeks`` weeks, one row for each.

    Weeks end with the window's last day and are named by their first; a week without merges has none of a
    value and zero merged.  All people and weeks come from one pass over the tables.
    """
    last = F.lit(t.window.last).cast("date")
    rows = _merged_rows(t).withColumn("ago", F.floor(F.date_diff(last, F.to_date("merged_at")) / 7)).where((F.col("ago") >= 0) & (F.col("ago") < weeks))
    reviewers = t.reviews.groupBy("pr_id").agg(F.collect_set("reviewer_id").alias("by"))  # the reviewers of one pull request
    each = sizes(t, rows.select("id", "author_id", "ago", waited(F.coalesce("ready_at", "created_at"), F.col("merged_at")).alias("took"))).join(reviewers, F.col("id") == F.col("pr_id"), "left")
    alone = F.coalesce(F.size(F.filter("by", lambda r: r != F.col("author_id"))), F.lit(0)) == 0
    sums = each.groupBy("author_id", "ago").agg(F.count(F.lit(1)).alias("merged"), r7(F.col("took"), 0.5).alias("time_to_merge"), r7(F.col("size"), 0.5).alias("size"), F.avg(alone.cast("double")).alias("unreviewed"))
    slots = F.transform(F.sequence(F.lit(0), F.lit(weeks - 1)), lambda k: F.coalesce(F.element_at("by_week", k.cast("long")), F.struct(F.lit(0).cast("long").alias("merged"), *[F.lit(None).cast("double").alias(c) for c in ("time_to_merge", "size", "unreviewed")])))
    people = sums.groupBy("author_id").agg(F.map_from_entries(F.collect_list(F.struct("ago", F.struct("merged", "time_to_merge", "size", "unreviewed")))).alias("by_week"))  # a row a week
    dense = people.select(F.col("author_id").alias("person_id"), F.posexplode(slots).alias("ago", "x"))
    return dense.select("person_id", F.date_sub(last, (F.col("ago") + 1) * 7 - 1).alias("week"), "x.merged", *[rounded(F.col(f"x.{c}")).alias(c) for c in ("time_to_merge", "size", "unreviewed")])


@metric(
    "person.weekly_trend",
    _FACTS_SQL.split(", ms as")[0]
    + f""", wk as (select author_id, (date '{TO}' - merged_at::date) // 7 ago, greatest(0, (epoch_us(merged_at) - epoch_us(coalesce(ready_at, created_at))) / 1e6) took, coalesce(s, 0) z, (id not in (select pr_id from reviews join mr on mr.id = pr_id where reviewer_id <> author_id))::int::double u
 from mr left join (select pr_id, sum(coalesce(haloc, additions + deletions)) s from files group by 1) on id = pr_id where merged_at::date <= date '{TO}' and (date '{TO}' - merged_at::date) // 7 < {WEEKS}),
g as (select author_id, unnest(range({WEEKS})) ago from (select distinct author_id from wk))
select g.author_id person_id, (date '{TO}' - ((g.ago + 1) * 7 - 1)::int) "week", count(took) merged, round(median(took), 6) time_to_merge, round(median(z), 6) size, round(avg(u), 6) unreviewed from g left join wk on wk.author_id = g.author_id and wk.ago = g.ago group by 1, 2""",
)
def weekly_trend(t: Tables) -> DataFrame:
    """Each author's last 13 weeks: pull requests merged, their median time to merge and size, and the share nobody else reviewed."""
    return weekly_panel(t)
