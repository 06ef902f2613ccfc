"""Flow metrics over issues and their status transitions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.stats import p90, p95, quality, quantiles, r7, ratio, rounded, seconds
from tidemark.operators.history import status_intervals
from tidemark.operators.ranges import held_at
from tidemark.plans.catalog import ENGINE_VERSION, metric
from tidemark.tables import AS_OF, DONE, ISSUE_DAYS, ISSUES_FROM, ISSUES_TO, STARTED, Tables

_DONE, _STARTED = "('purchase')", "('view', 'click')"
_IN = f"moved_at >= timestamp '{ISSUES_FROM}' and moved_at < timestamp '{ISSUES_TO}' + interval 1 day"
NOW = f"timestamp '{AS_OF}'"


def cycles(t: Tables) -> DataFrame:
    """(issue_id, started_at, done_at): first entry to a started status, and the first to done at or after it."""
    starts = t.transitions.where(F.col("to_status").isin(*STARTED)).groupBy("issue_id").agg(F.min("moved_at").alias("started_at"))
    done = t.transitions.where(F.col("to_status").isin(*DONE)).join(starts, "issue_id").where("moved_at >= started_at")
    return done.groupBy("issue_id", "started_at").agg(F.min("moved_at").alias("done_at"))


_CYCLES = f""", st as (select issue_id, min(moved_at) started_at from transitions where to_status in {_STARTED} group by 1),
cy as (select s.issue_id, started_at, min(moved_at) done_at from transitions t join st s on t.issue_id = s.issue_id where to_status in {_DONE} and moved_at >= started_at group by 1, 2)"""


@metric(
    "flow.cycle_time",
    _CYCLES
    + f""", x as (select (epoch_us(done_at) - epoch_us(started_at)) / 1e6 s from cy where done_at >= timestamp '{ISSUES_FROM}' and done_at < timestamp '{ISSUES_TO}' + interval 1 day)
select count(*) n, round(quantile_cont(s, 0.5), 6) p50, round(quantile_cont(s, 0.75), 6) p75, round(quantile_cont(s, 0.85), 6) p85, case when count(*) >= 20 then round(quantile_cont(s, 0.9), 6) end p90,
 case when count(*) >= 30 then round(quantile_cont(s, 0.95), 6) end p95, case when count(*) = 0 then 'no_data' when count(*) < 30 then 'insufficient_sample' else 'ok' end data_quality from x""",
)
def cycle_time(t: Tables) -> DataFrame:
    """Seconds from the first started status to the first done one after it, of issues done in the window."""
    rows = cycles(t).where(t.issues_within("done_at")).select(seconds(F.col("started_at"), F.col("done_at")).alias("s"))
    q = quantiles(rows, "s", {"p50": 0.5, "p75": 0.75, "p85": 0.85, "p90": 0.9, "p95": 0.95})
    floor = {"p90": 20, "p95": 30}
    return q.select("n", *[rounded(F.when(F.col("n") >= floor.get(p, 1), F.col(p))).alias(p) for p in ("p50", "p75", "p85", "p90", "p95")], quality(F.col("n"), 30).alias("data_quality"))


@metric(
    "flow.throughput",
    f" select count(distinct issue_id) as value, case when count(*) = 0 then 'no_data' else 'ok' end data_quality from transitions where to_status in {_DONE} and {_IN}",
)
def throughput(t: Tables) -> DataFrame:
    """Issues with a transition to done in the window, each counted once."""
    done = t.transitions.where(F.col("to_status").isin(*DONE)).where(t.issues_within("moved_at"))
    return done.agg(F.countDistinct("issue_id").alias("value"), quality(F.count(F.lit(1))).alias("data_quality"))


@metric(
    "flow.reopened",
    f" select issue_id, count(*) reopens from transitions where from_status in {_DONE} and to_status not in {_DONE} and {_IN} group by 1",
)
def reopened(t: Tables) -> DataFrame:
    """Times each issue left done in the window."""
    back = F.col("from_status").isin(*DONE) & ~F.col("to_status").isin(*DONE)
    return t.transitions.where(back).where(t.issues_within("moved_at")).groupBy("issue_id").agg(F.count(F.lit(1)).alias("reopens"))


def intervals(t: Tables) -> DataFrame:
    return status_intervals(t.transitions.where(f"moved_at <= {t.now}"), t.issues, F.expr(t.now))


_INTERVALS = f""", tr as (select * from transitions where moved_at <= {NOW}),
iv as (select * from (select issue_id, to_status status, moved_at begin_, coalesce(lead(moved_at) over (partition by issue_id order by moved_at, n), {NOW}) end_ from tr) where begin_ < end_)"""


@metric(
    "flow.time_in_status",
    _INTERVALS
    + """, d as (select issue_id, status, sum((epoch_us(end_) - epoch_us(begin_)) / 1e6) s from iv group by 1, 2)
select status, count(*) issues, round(quantile_cont(s, 0.5), 6) p50, round(quantile_cont(s, 0.75), 6) p75, round(quantile_cont(s, 0.85), 6) p85, round(quantile_cont(s, 0.95), 6) p95 from d group by 1""",
)
def time_in_status(t: Tables) -> DataFrame:
    """Seconds that issues spent in each status, re-entries added up, in percentiles over issues."""
    each = intervals(t).groupBy("issue_id", "status").agg(F.sum(seconds(F.col("begin"), F.col("end"))).alias("s"))
    return each.groupBy("status").agg(F.count(F.lit(1)).alias("issues"), *[rounded(r7(F.col("s"), p)).alias(f"p{round(p * 100)}") for p in (0.5, 0.75, 0.85, 0.95)])


#: Days that an issue may be open before it counts as forgotten.
ZOMBIE_DAYS = 90


def stated(t: Tables) -> DataFrame:
    """Transitions up to now with ``state``, what the status they enter meant when they entered it."""
    seen = t.transitions.where(f"moved_at <= {t.now}")
    return held_at(seen, t.flow_states, {"to_status": "status"}, "moved_at", ["flow_state"]).withColumn("state", F.col("held.flow_state")).drop("held")


def efficiencies(t: Tables) -> DataFrame:
    """(issue_id, active, total, open_s): seconds in active statuses and in all, and from creation to the end.

    An issue ends where it is first done, or now.  Only the last status is cut at that end: of an issue that was
    reopened what lies between its transitions counts whole.  A status means what it meant when it was entered;
    what isn't active then, done and unknown ones too, is waiting.
    """
    rows = stated(t).withColumn("done_at", F.min(F.when(F.col("state") == "done", F.col("moved_at"))).over(W.partitionBy("issue_id")))
    end = F.coalesce("done_at", F.expr(t.now))
    spent = status_intervals(rows.withColumn("until", end), t.issues, F.col("until"))
    meant = held_at(spent, t.flow_states, {"status": "status"}, "begin", ["flow_state"])
    s = seconds(F.col("begin"), F.col("end"))
    sums = meant.groupBy("issue_id").agg(F.sum(F.when(F.col("held.flow_state") == "active", s).otherwise(0.0)).alias("active"), F.sum(s).alias("total"))
    ends = rows.groupBy("issue_id").agg(F.first(end).alias("end"))
    opened = t.issues.select("issue_id", "created_at").join(ends, "issue_id")
    return opened.join(sums, "issue_id", "left").select("issue_id", "active", "total", seconds(F.col("created_at"), F.col("end")).alias("open_s"))


_STATED = f""", tr as (select t.*, f.flow_state state from transitions t left join flow_states f on f.status = t.to_status and valid_from <= moved_at and valid_to > moved_at where moved_at <= {NOW}),
fd as (select issue_id, coalesce(min(moved_at) filter (state = 'done'), {NOW}) until from tr group by 1),
iv as (select tr.issue_id, to_status status, moved_at begin_, coalesce(lead(moved_at) over (partition by tr.issue_id order by moved_at, n), until) end_ from tr join fd using (issue_id)),
e as (select issue_id, sum(case when flow_state = 'active' then (epoch_us(end_) - epoch_us(begin_)) / 1e6 else 0 end) active, sum((epoch_us(end_) - epoch_us(begin_)) / 1e6) total from iv left join flow_states f on f.status = iv.status and valid_from <= begin_ and valid_to > begin_ where begin_ < end_ group by 1),
x as (select i.issue_id, active / nullif(total, 0) v, (epoch_us(until) - epoch_us(created_at)) / 1e6 open_s from issues i join fd using (issue_id) left join e using (issue_id))"""


@metric(
    "flow.flow_efficiency",
    _STATED
    + f""" select count(v) n, round(quantile_cont(v, 0.5), 6) p50, round(quantile_cont(v, 0.75), 6) p75, round(quantile_cont(v, 0.85), 6) p85, case when count(v) >= 20 then round(quantile_cont(v, 0.9), 6) end p90, case when count(v) >= 30 then round(quantile_cont(v, 0.95), 6) end p95,
 count(*) filter (open_s > {ZOMBIE_DAYS * 86400}) zombies, case when count(v) = 0 then 'no_data' when count(v) < 30 then 'insufficient_sample' else 'ok' end data_quality from x""",
)
def flow_efficiency(t: Tables) -> DataFrame:
    """Active / all time of each issue, by what its statuses meant when it entered them, in percentiles."""
    each = efficiencies(t).withColumn("v", ratio(F.col("active"), F.col("total")))
    v, n = F.col("v"), F.count("v")
    return each.agg(
        n.alias("n"),
        *[rounded(r7(v, p)).alias(f"p{round(p * 100)}") for p in (0.5, 0.75, 0.85)],
        rounded(p90(v)).alias("p90"),
        rounded(p95(v)).alias("p95"),
        F.count_if(F.col("open_s") > ZOMBIE_DAYS * 86400).alias("zombies"),
        quality(n, 30).alias("data_quality"),
    )


@metric(
    "flow.cycle_time_by_state",
    _STATED
    + """, st as (select issue_id, min(moved_at) started_at from tr where state = 'active' group by 1), cy as (select issue_id, started_at, min(moved_at) done_at from tr join st using (issue_id) where state = 'done' and moved_at >= started_at group by 1, 2)
select issue_id, round((epoch_us(done_at) - epoch_us(started_at)) / 1e6, 6) s from cy""",
)
def cycle_time_by_state(t: Tables) -> DataFrame:
    """Seconds from an issue's first transition to what was an active status then, to its first done at or after it."""
    rows = stated(t)
    starts = rows.where("state = 'active'").groupBy("issue_id").agg(F.min("moved_at").alias("started_at"))
    done = rows.where("state = 'done'").join(starts, "issue_id").where("moved_at >= started_at")
    return done.groupBy("issue_id", "started_at").agg(F.min("moved_at").alias("done_at")).select("issue_id", rounded(seconds(F.col("started_at"), F.col("done_at"))).alias("s"))


def status_at(t: Tables) -> DataFrame:
    """(issue_id, status, started_at): each issue's status at an instant and its first started one before it."""
    seen = t.transitions.where(f"moved_at <= {t.now}")
    return seen.groupBy("issue_id").agg(F.max_by("to_status", F.struct("moved_at", "n")).alias("status"), F.min(F.when(F.col("to_status").isin(*STARTED), F.col("moved_at"))).alias("started_at"), F.min("moved_at").alias("first_at"))


_STATUS_AT = f""", sa as (select issue_id, arg_max(to_status, (moved_at, n)) status, min(case when to_status in {_STARTED} then moved_at end) started_at, min(moved_at) first_at from transitions where moved_at <= {NOW} group by 1)"""


@metric(
    "flow.wip_load",
    _CYCLES
    + _STATUS_AT.replace(", sa", ", sa", 1)
    + f""", w as (select count(*) wip from sa where status in {_STARTED}),
p as (select quantile_cont((epoch_us(done_at) - epoch_us(started_at)) / 1e6, 0.5) / 86400 as days from cy where done_at >= timestamp '{ISSUES_FROM}' and done_at < timestamp '{ISSUES_TO}' + interval 1 day)
select wip as value, round(days, 6) avg_cycle_days, round(wip / nullif(days, 0), 6) littles_law_per_day, wip > 3 * days overloaded from w, p""",
)
def wip_load(t: Tables) -> DataFrame:
    """Issues in a started status now; by Little's law what that makes a day at the median cycle time."""
    wip = status_at(t).agg(F.count_if(F.col("status").isin(*STARTED)).alias("wip"))
    days = cycles(t).where(t.issues_within("done_at")).agg((r7(seconds(F.col("started_at"), F.col("done_at")), 0.5) / 86400).alias("days"))
    return wip.crossJoin(days).select(F.col("wip").alias("value"), rounded(F.col("days")).alias("avg_cycle_days"), rounded(ratio(F.col("wip"), F.col("days"))).alias("littles_law_per_day"), (F.col("wip") > 3 * F.col("days")).alias("overloaded"))  # a row each


@metric(
    "flow.aging_wip",
    _STATUS_AT
    + f""", a as (select (epoch_us({NOW}) - epoch_us(coalesce(started_at, first_at))) / 1e6 age from sa where status in {_STARTED}), q as (select quantile_cont(age, 0.85) t from a)
select count(*) n, round(quantile_cont(age, 0.5), 6) p50, round(quantile_cont(age, 0.75), 6) p75, round(max(t), 6) p85, count(*) filter (age > t) alerts from a, q""",
)
def aging_wip(t: Tables) -> DataFrame:
    """Age of issues in a started status; those older than the 85th percentile are alerts."""
    age = seconds(F.coalesce("started_at", "first_at"), F.expr(t.now))
    ages = status_at(t).where(F.col("status").isin(*STARTED)).select(age.alias("age"))
    line = ages.agg(r7(F.col("age"), 0.85).alias("t"))
    joined = ages.join(F.broadcast(line))  # one row
    return joined.agg(F.count(F.lit(1)).alias("n"), rounded(r7(F.col("age"), 0.5)).alias("p50"), rounded(r7(F.col("age"), 0.75)).alias("p75"), rounded(F.max("t")).alias("p85"), F.count_if(F.col("age") > F.col("t")).alias("alerts"))


# Issue types, in lower case, of each bucket.
BUG_TYPES = ("bug", "defect", "hotfix", "incident", "fix")
DEBT_TYPES = ("technical debt", "tech debt", "debt", "refactor", "chore", "task")
FEATURE_TYPES = ("story", "feature", "epic", "improvement", "enhancement", "user story", "new feature")
BUCKETS = ("feature", "bug", "debt", "other")


def bucket(issue_type):
    name = F.lower(issue_type)
    return F.when(name.isin(*BUG_TYPES), "bug").when(name.isin(*DEBT_TYPES), "debt").when(name.isin(*FEATURE_TYPES), "feature").otherwise("other")


_BUCKET_SQL = f"case when lower(type) in {BUG_TYPES} then 'bug' when lower(type) in {DEBT_TYPES} then 'debt' when lower(type) in {FEATURE_TYPES} then 'feature' else 'other' end"


@metric(
    "flow.flow_distribution",
    f""", fd as (select issue_id, min(moved_at) done_at from transitions where to_status in {_DONE} group by 1),
b as (select {_BUCKET_SQL} bucket from issues join fd using (issue_id) where done_at >= timestamp '{ISSUES_FROM}' and done_at < timestamp '{ISSUES_TO}' + interval 1 day),
k as (select unnest(['feature', 'bug', 'debt', 'other']) bucket), c as (select k.bucket, count(b.bucket) n from k left join b using (bucket) group by 1)
select bucket, n, round(n / nullif(sum(n) over (), 0)::double, 6) share from c""",
)
def flow_distribution(t: Tables) -> DataFrame:
    """Issues first done in the window by bucket, with share; empty buckets too."""
    done = t.transitions.where(F.col("to_status").isin(*DONE)).groupBy("issue_id").agg(F.min("moved_at").alias("done_at")).where(t.issues_within("done_at"))
    counts = t.issues.join(done, "issue_id").groupBy(bucket(F.col("type")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    every = t.spark.createDataFrame([(b,) for b in BUCKETS], "bucket string")
    all_ = every.join(counts, "bucket", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    total = all_.agg(F.sum("n").alias("total"))
    return all_.join(F.broadcast(total)).select("bucket", "n", rounded(ratio(F.col("n"), F.col("total"))).alias("share"))  # one row


@metric(
    "flow.cfd",
    f""", days as (select unnest(generate_series(date '{ISSUES_FROM}', date '{ISSUES_TO}', interval 1 day))::date as day_),
iv as (select issue_id, to_status status, moved_at begin_, coalesce(lead(moved_at) over (partition by issue_id order by moved_at, n), timestamp '9999-01-01') end_ from transitions)
select day_ as "day", status, count(*) n from days join iv on begin_ < day_ + interval 1 day and end_ >= day_ + interval 1 day group by 1, 2""",
)
def cfd(t: Tables) -> DataFrame:
    """Issues in each status at the end of each day: an interval adds one where it begins and takes one where it ends, summed day by day."""
    never = F.lit("9999-01-01").cast("timestamp")
    held = status_intervals(t.transitions, t.issues, never).where("begin < end")
    first, last = F.lit(t.window.issues_first).cast("date"), F.lit(t.window.issues_last).cast("date")
    # Differences instead of a row for each issue and day: at most two rows an interval, whatever its length.
    enters = held.select("status", F.greatest(F.to_date("begin"), first).alias("day"), F.lit(1).alias("d")).where(F.col("day") <= last)
    leaves = held.where(F.col("end") < never).select("status", F.greatest(F.to_date("end"), first).alias("day"), F.lit(-1).alias("d")).where(F.col("day") <= last)
    changes = enters.union(leaves).groupBy("status", "day").agg(F.sum("d").alias("d"))
    grid = changes.select("status").distinct().select("status", F.explode(F.sequence(first, last)).alias("day"))
    running = F.sum(F.coalesce("d", F.lit(0))).over(W.partitionBy("status").orderBy("day"))
    return grid.join(changes, ["status", "day"], "left").select("day", "status", running.alias("n")).where("n > 0")


def _weeks(t: Tables) -> int:
    """Whole weeks of the window, one at least; the last takes the rest."""
    return max(1, t.window.issue_days // 7)


def _week(t: Tables, at: str):
    start = F.lit(t.window.issues_first).cast("timestamp")
    return F.least(F.floor(seconds(start, F.col(at)) / 604800), F.lit(_weeks(t) - 1)).cast("long")


_WEEK_SQL = f"least(floor((epoch_us({{}}) - epoch_us(timestamp '{ISSUES_FROM}')) / 1e6 / 604800), greatest(1, {ISSUE_DAYS} // 7) - 1)"
_WEEKS_SQL = f"select unnest(generate_series(0, greatest(1, {ISSUE_DAYS} // 7) - 1)) as week"


@metric(
    "flow.weekly_throughput",
    f""", w as ({_WEEKS_SQL}), d as (select {_WEEK_SQL.format('moved_at')} as week, issue_id from transitions where to_status in {_DONE} and {_IN})
select w.week::bigint as week, count(distinct issue_id) n from w left join d on w.week = d.week group by 1""",
)
def weekly_throughput(t: Tables) -> DataFrame:
    """Issues done in each week from the window's start; the last week takes the rest; empty weeks are zero."""
    done = t.transitions.where(F.col("to_status").isin(*DONE)).where(t.issues_within("moved_at"))
    n = done.groupBy(_week(t, "moved_at").alias("week")).agg(F.countDistinct("issue_id").alias("n"))
    return t.spark.range(_weeks(t)).select(F.col("id").alias("week")).join(n, "week", "left").select("week", F.coalesce("n", F.lit(0)).alias("n"))


def first_done(t: Tables) -> DataFrame:
    """(week, n): issues by the week of their first transition to done; empty weeks are zero."""
    done = t.transitions.where(F.col("to_status").isin(*DONE)).groupBy("issue_id").agg(F.min("moved_at").alias("done_at")).where(t.issues_within("done_at"))
    n = done.groupBy(_week(t, "done_at").alias("week")).agg(F.count(F.lit(1)).alias("n"))
    return t.spark.range(_weeks(t)).select(F.col("id").alias("week")).join(n, "week", "left").select("week", F.coalesce("n", F.lit(0)).alias("n"))


@metric(
    "flow.active_span",
    f""", fd as (select issue_id, min(moved_at) done_at from transitions where to_status in {_DONE} group by 1), d as (select {_WEEK_SQL.format('done_at')} as week from fd where done_at >= timestamp '{ISSUES_FROM}' and done_at < timestamp '{ISSUES_TO}' + interval 1 day)
select coalesce(max(week) - min(week) + 1, 0)::bigint as value, (select count(*) from ({_WEEKS_SQL})) as weeks from d""",
    unit="weeks",
)
def active_span(t: Tables) -> DataFrame:
    """Weeks from the first in which an issue was first done to the last, weeks without any between them included."""
    some = F.when(F.col("n") > 0, F.col("week"))
    return first_done(t).agg(F.coalesce(F.max(some) - F.min(some) + 1, F.lit(0)).alias("value"), F.count(F.lit(1)).alias("weeks"))


#: Fixed values of the public generator mulberry32: its step, and what it masks to.
_STEP, _MASK = 0x6D2B79F5, 0xFFFFFFFF


def draws(seed: int, first: int, n: int):
    """Draws ``first`` to ``first + n`` of mulberry32 from ``seed``, in [0, 1): draw k depends on k alone, so all come at once."""
    import numpy as np

    mask = np.uint64(_MASK)
    k = np.arange(first + 1, first + n + 1, dtype=np.uint64)
    s = (np.uint64(seed & _MASK) + k * np.uint64(_STEP)) & mask
    t = ((s ^ (s >> np.uint64(15))) * (s | np.uint64(1))) & mask
    t ^= (t + (((t ^ (t >> np.uint64(7))) * (t | np.uint64(61))) & mask)) & mask
    return (t ^ (t >> np.uint64(14))).astype(np.float64) / 2.0**32


def simulate(samples: list[int], remaining: int, seed: int, simulations: int = 10_000, most: int = 520) -> tuple[list[int], int]:
    """Weeks that each bootstrap of weekly throughput takes to finish what remains, at most ``most``, and how many did not.

    Simulations draw one after the other from one stream of samples in ascending order; each ends where
    the running total has grown by what remained.
    """
    import numpy as np

    pool = np.sort(np.maximum(np.asarray(samples, dtype=np.int64), 0))
    total, size = np.zeros(1, dtype=np.int64), 1 << 16
    weeks, unfinished, at = [], 0, 0
    for _ in range(simulations):
        while len(total) <= at + most:
            drawn = pool[(draws(seed, len(total) - 1, size) * len(pool)).astype(np.int64)]
            total = np.concatenate([total, total[-1] + np.cumsum(drawn)])
        n = int(np.searchsorted(total[at : at + most + 1], total[at] + remaining))
        unfinished += n > most
        weeks.append(min(n, most))
        at += weeks[-1]
    return weeks, unfinished


FORECAST = "remaining long, sample_size long, observed_weeks long, value double, p50 double, p75 double, p85 double, p90 double, p95 double, simulations long, unfinished_share double, data_quality string"


@metric("flow.monte_carlo_forecast", unit="weeks")
def monte_carlo_forecast(t: Tables) -> DataFrame:
    """Percentiles of the weeks until the work in progress is done, bootstrapped from the window's weeks of first completions.

    The seed is the FNV-1a of the window's days and the engine's version.  p90 and p95 need 8 and 12 active
    weeks; fewer than 4 are an insufficient sample; a history without completions is no data.
    """
    wip = status_at(t).agg(F.count_if(F.col("status").isin(*STARTED)).alias("remaining"))
    samples = first_done(t).agg(F.sort_array(F.collect_list(F.struct("week", "n"))).alias("weeks")).select(F.col("weeks.n").alias("samples"))  # a row a week
    seed = _fnv1a(f"{t.window.issues_first}|{t.window.issues_last}|{ENGINE_VERSION}")
    names = [x.split()[0] for x in FORECAST.split(", ")]

    def run(batches):
        import numpy as np

        for pdf in batches:
            rows = []
            for given, left in zip(pdf["samples"], pdf["remaining"], strict=True):
                own, left = [int(x) for x in given], int(left)
                active = [i for i, x in enumerate(own) if x > 0]
                observed = active[-1] - active[0] + 1 if active else 0
                if not left or not active:
                    rows.append((left, len(own), observed, *[None] * 6, 0, None, "ok" if not left and own else "no_data"))
                    continue
                weeks, unfinished = simulate(own, left, seed)
                p = np.percentile(weeks, [50, 75, 85, 90, 95]).tolist()
                rows.append((left, len(own), observed, p[0], *p[:3], p[3] if observed >= 8 else None, p[4] if observed >= 12 else None, len(weeks), unfinished / len(weeks), "ok" if observed >= 4 else "insufficient_sample"))
            yield pd.DataFrame(rows, columns=names)

    return samples.crossJoin(wip).mapInPandas(run, FORECAST)  # one row


def _fnv1a(text: str) -> int:
    h = 2166136261
    for byte in text.encode():
        h = (h ^ byte) * 16777619 & _MASK
    return h
