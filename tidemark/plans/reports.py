"""Snapshots, baselines, comparisons, roll-ups, anti-gaming and serving rules."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.stats import bands, r7, ratio, robust_sd, rounded, seconds
from tidemark.operators.history import upsert
from tidemark.plans.catalog import ENGINE_VERSION, metric
from tidemark.plans.dora import _LINKS_SQL, incident_links, production
from tidemark.plans.pull_requests import merged, sizes
from tidemark.session import fresh_folder, staged
from tidemark.streaming.incremental import daily_counts, drained, events_stream, sliding, status_changes
from tidemark.streaming.sync import SyncStore, follow
from tidemark.tables import FROM, TEAMS, TO, Tables

_IN_WINDOW = f"created_at >= timestamp '{FROM}' and created_at < timestamp '{TO}' + interval 1 day"


def snapshots(t: Tables) -> DataFrame:
    """(day, n): deployments in the 30 days that end with each day, in one plan for all days."""
    daily = t.deploys.where("status = 'success'").where(t.within("created_at")).groupBy(F.to_date("created_at").alias("day")).agg(F.count(F.lit(1)).alias("d"))
    days = t.spark.range(1).select(F.explode(F.sequence(F.lit(t.window.first).cast("date"), F.lit(t.window.last).cast("date"))).alias("day"))
    trailing = W.orderBy("day").rowsBetween(-29, 0)  # a row a day
    return days.join(daily, "day", "left").select("day", F.sum(F.coalesce("d", F.lit(0))).over(trailing).alias("n"))


_SNAP = f""", daily as (select created_at::date "day", count(*) d from deploys where status = 'success' and created_at >= timestamp '{FROM}' and created_at < timestamp '{TO}' + interval 1 day group by 1),
days as (select unnest(generate_series(date '{FROM}', date '{TO}', interval 1 day))::date as "day"),
snap as (select "day", sum(coalesce(d, 0)) over (order by "day" rows between 29 preceding and current row)::bigint n from days left join daily using ("day"))"""


@metric("report.snapshots", _SNAP + ' select "day", n, round(n / 30.0, 6) as value from snap')
def snapshot_series(t: Tables) -> DataFrame:
    """Deployments a day over a trailing 30 days, for each day of the window."""
    return snapshots(t).select("day", "n", rounded(F.col("n") / 30.0).alias("value"))


@metric("report.snapshot_upsert", _SNAP + f""" select "day", case when "day" >= date '{TO}' - 5 then n + 1 else n end n, '{ENGINE_VERSION}' engine_version from snap""")
def snapshot_upsert(t: Tables) -> DataFrame:
    """Snapshots rederived for late days replace those written before."""
    first = snapshots(t).select("day", "n", F.lit(ENGINE_VERSION).alias("engine_version"), F.lit(1).alias("version"))
    again = first.where(F.col("day") >= F.date_sub(F.lit(t.window.last).cast("date"), 5)).withColumns({"n": F.col("n") + 1, "version": F.lit(2)})
    return upsert(first, again, ["day"], "version").select("day", "n", "engine_version")


@metric("report.closed_days", _SNAP + f""" select count(*) as days, count(*) filter ("day" + interval 1 day <= timestamp '{TO}' and timestamp '{TO}' - ("day" + interval 1 day) >= interval 48 hour) closed from snap""")
def closed_days(t: Tables) -> DataFrame:
    """Days whose window is closed: data reaches beyond it and its end is 48 hours past."""
    end, now = F.date_add("day", 1).cast("timestamp"), F.lit(t.window.last).cast("timestamp")
    return snapshots(t).agg(F.count(F.lit(1)).alias("days"), F.count_if((end <= now) & (seconds(end, now) >= 48 * 3600)).alias("closed"))


_BASE = """, m as (select repo_id, date_trunc('month', merged_at)::date mo, median((epoch_us(merged_at) - epoch_us(created_at)) / 1e6) v from prs where merged_at is not null group by 1, 2), r as (select *, row_number() over (partition by repo_id order by mo desc) i from m),
md as (select repo_id, median(v) med from r where i > 1 group by 1), b as (select r.repo_id, count(*) n, avg(v) mean, quantile_cont(v, 0.5) p50, quantile_cont(v, 0.75) p75, quantile_cont(v, 0.9) p90, stddev_samp(v) sd, median(abs(v - med)) mad from r join md on r.repo_id = md.repo_id where i > 1 group by 1)"""


def baselines(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Each repository's months of median time to merge: the baseline of all but the latest, and the latest."""
    took = seconds(F.col("created_at"), F.col("merged_at"))
    months = t.prs.where("merged_at is not null").groupBy("repo_id", F.trunc("merged_at", "MONTH").alias("mo")).agg(F.median(took).alias("v"))
    ranked = months.withColumn("i", F.row_number().over(W.partitionBy("repo_id").orderBy(F.desc("mo"))))
    past = ranked.where("i > 1").withColumn("med", F.median("v").over(W.partitionBy("repo_id")))
    v = F.col("v")
    base = past.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), r7(v, 0.5).alias("p50"), r7(v, 0.75).alias("p75"), r7(v, 0.9).alias("p90"), F.stddev_samp(v).alias("sd"), F.median(F.abs(v - F.col("med"))).alias("mad")
    )
    return base, ranked.where("i = 1").select("repo_id", "v")


@metric("report.baselines", _BASE + " select repo_id, n, round(mean, 4) mean, round(p50, 4) p50, round(p75, 4) p75, round(p90, 4) p90, round(sd, 4) sd, round(mad, 4) mad from b")
def baseline_records(t: Tables) -> DataFrame:
    """Count, mean, quantiles, deviation and median absolute deviation of each repository's history."""
    base, _ = baselines(t)
    return base.select("repo_id", "n", *[rounded(F.col(c), 4).alias(c) for c in ("mean", "p50", "p75", "p90", "sd", "mad")])


@metric(
    "report.compare",
    _BASE
    + """, c as (select repo_id, r.v, n, (r.v - p50) / greatest(coalesce(sd, 0), 1.4826 * mad, 1e-9) z from r join b using (repo_id) where i = 1),
pr as (select c.repo_id, avg(case when h.v <= c.v then 1.0 else 0 end) pct from c join r h on h.repo_id = c.repo_id and h.i > 1 group by 1)
select repo_id, n, round(case when n >= 5 then z end, 6) z, case when n < 5 then 'insufficient' when z >= 1.5 then 'much_higher' when z >= 0.5 then 'higher' when z > -0.5 then 'similar' when z > -1.5 then 'lower' else 'much_lower' end band, round(pct, 6) percentile,
 case when n < 5 then 'establishing' when abs(z) < 1 then 'stable' when abs(z) < 2 then 'shifting' else 'regime_change' end drift from c join pr using (repo_id)""",
)
def compare(t: Tables) -> DataFrame:
    """The latest month against the baseline: z, its band, its percentile rank in the history, and drift."""
    took = seconds(F.col("created_at"), F.col("merged_at"))
    months = t.prs.where("merged_at is not null").groupBy("repo_id", F.trunc("merged_at", "MONTH").alias("mo")).agg(F.median(took).alias("h"))
    past = months.withColumn("i", F.row_number().over(W.partitionBy("repo_id").orderBy(F.desc("mo")))).where("i > 1").select("repo_id", "h")
    base, now = baselines(t)
    joined = now.join(base, "repo_id").withColumn("z", (F.col("v") - F.col("p50")) / robust_sd(F.col("sd"), F.col("mad")))
    rank = now.join(past, "repo_id").groupBy("repo_id").agg(F.avg(F.when(F.col("h") <= F.col("v"), 1.0).otherwise(0.0)).alias("pct"))
    z, few = F.col("z"), F.col("n") < 5
    band = F.when(few, "insufficient").when(z >= 1.5, "much_higher").when(z >= 0.5, "higher").when(z > -0.5, "similar").when(z > -1.5, "lower").otherwise("much_lower")
    drift = F.when(few, "establishing").when(F.abs(z) < 1, "stable").when(F.abs(z) < 2, "shifting").otherwise("regime_change")
    return joined.join(rank, "repo_id").select("repo_id", "n", rounded(F.when(~few, z)).alias("z"), band.alias("band"), rounded(F.col("pct")).alias("percentile"), drift.alias("drift"))


@metric(
    "report.rollup",
    """, t as (select repo_id, median((epoch_us(merged_at) - epoch_us(created_at)) / 1e6) v from prs where merged_at is not null group by 1)
select count(*) teams, round(min(v), 6) least, round(quantile_cont(v, 0.25), 6) p25, round(median(v), 6) p50, round(quantile_cont(v, 0.75), 6) p75, round(quantile_cont(v, 0.9), 6) p90, round(max(v), 6) most from t""",
)
def rollup(t: Tables) -> DataFrame:
    """The organisation's distribution of its teams' medians."""
    took = seconds(F.col("created_at"), F.col("merged_at"))
    v = F.col("v")
    teams = t.prs.where("merged_at is not null").groupBy("repo_id").agg(F.median(took).alias("v"))
    return teams.agg(F.count(F.lit(1)).alias("teams"), rounded(F.min(v)).alias("least"), *[rounded(r7(v, p)).alias(f"p{round(100 * p)}") for p in (0.25, 0.5, 0.75, 0.9)], rounded(F.max(v)).alias("most"))


RAPID_S, JUGGLE_S, JUGGLE_TRIPS, SPLIT_S, SPLIT_PRS, SPLIT_SIZE, RESET_S = 300, 3600, 2, 86400, 5, 10, 3600


@metric(
    "gaming.deploy_inflation",
    f""", d as (select * from deploys where {_IN_WINDOW}), g as (select repo_id, (epoch_us(created_at) - epoch_us(lag(created_at) over (partition by repo_id order by created_at, id))) / 1e6 s from d where environment = 'production'),
b as (select repo_id, count(*) filter (s < {RAPID_S}) bursts from g group by 1), e as (select repo_id, count(*) filter (environment <> 'production') elsewhere from d group by 1)
select repo_id, elsewhere, coalesce(bursts, 0) bursts, case when elsewhere > 0 or bursts > 0 then 'deploy_frequency_inflated' else 'ok' end flag from e left join b using (repo_id)""",
)
def deploy_inflation(t: Tables) -> DataFrame:
    """Of each repository's deployments in the window those outside production, and those to production within five minutes of the one before; either flags it."""
    rows = t.deploys.where(t.within("created_at")).withColumn("day", F.to_date("created_at"))
    live = rows.where("environment = 'production'")
    # Sorted a day at a time; across midnight a day's first is held against the day before's last.
    gap = seconds(F.lag("created_at").over(W.partitionBy("repo_id", "day").orderBy("created_at", "id")), F.col("created_at"))
    inside = live.withColumn("s", gap).groupBy("repo_id", "day").agg(F.count_if(F.col("s") < RAPID_S).alias("n"), F.min("created_at").alias("first"), F.max("created_at").alias("last"))
    before = inside.select("repo_id", F.date_add("day", 1).alias("day"), F.col("last").alias("before"))
    over = F.coalesce((seconds(F.col("before"), F.col("first")) < RAPID_S).cast("int"), F.lit(0))
    bursts = inside.join(before, ["repo_id", "day"], "left").groupBy("repo_id").agg(F.sum(F.col("n") + over).alias("bursts"))
    each = rows.groupBy("repo_id").agg(F.count_if(F.col("environment") != "production").alias("elsewhere")).join(bursts, "repo_id", "left")
    flag = F.when((F.col("elsewhere") > 0) | (F.col("bursts") > 0), "deploy_frequency_inflated").otherwise("ok")
    return each.select("repo_id", "elsewhere", F.coalesce("bursts", F.lit(0)).alias("bursts"), flag.alias("flag"))


@metric(
    "gaming.status_juggling",
    f""", r as (select issue_id, moved_at, lead(moved_at) over w nat, from_status, to_status, lead(to_status) over w nto, lead(from_status) over w nfrom from transitions window w as (partition by issue_id order by moved_at, n))
select issue_id, count(*) reversals from r where to_status = nfrom and from_status = nto and epoch_us(nat) - epoch_us(moved_at) <= {JUGGLE_S} * 1000000::bigint group by 1 having count(*) >= {JUGGLE_TRIPS}""",
)
def status_juggling(t: Tables) -> DataFrame:
    """Issues with two or more moves that the next one takes back within the hour."""
    w = W.partitionBy("issue_id").orderBy("moved_at", "n")
    r = t.transitions.withColumns({"nat": F.lead("moved_at").over(w), "nto": F.lead("to_status").over(w), "nfrom": F.lead("from_status").over(w)})
    back = r.where("from_status = nto and to_status = nfrom").where(seconds(F.col("moved_at"), F.col("nat")) <= JUGGLE_S)
    return back.groupBy("issue_id").agg(F.count(F.lit(1)).alias("reversals")).where(F.col("reversals") >= JUGGLE_TRIPS)


@metric(
    "gaming.trivial_splitting",
    f""", z as (select id, author_id, created_at, coalesce(s, 0) size from prs left join (select pr_id, sum(coalesce(haloc, additions + deletions)) s from files group by 1) on id = pr_id),
s as (select author_id, created_at, lead(created_at, {SPLIT_PRS - 1}) over (partition by author_id order by created_at, id) last from z where size <= {SPLIT_SIZE} and {_IN_WINDOW})
select author_id, count(*) runs from s where epoch_us(last) - epoch_us(created_at) <= {SPLIT_S} * 1000000::bigint group by 1""",
)
def trivial_splitting(t: Tables) -> DataFrame:
    """Authors with five pull requests of ten lines at most, opened in the window within 24 hours of each other, and in how many runs."""
    tiny = sizes(t, t.prs.where(t.within("created_at"))).where(F.col("size") <= SPLIT_SIZE)
    last = F.lead("created_at", SPLIT_PRS - 1).over(W.partitionBy("author_id").orderBy("created_at", "id"))
    return tiny.withColumn("last", last).where(seconds(F.col("created_at"), F.col("last")) <= SPLIT_S).groupBy("author_id").agg(F.count(F.lit(1)).alias("runs"))


@metric(
    "gaming.lead_time_reset",
    f""", m as (select * from prs where state = 'merged' and merged_at >= timestamp '{FROM}' and merged_at < timestamp '{TO}' + interval 1 day and merge_commit_at is not null and first_commit_at is not null)
select repo_id, count(*) n, count(*) filter (epoch_us(merge_commit_at) - epoch_us(first_commit_at) > {RESET_S} * 1000000::bigint) resets from m group by 1""",
)
def lead_time_reset(t: Tables) -> DataFrame:
    """Merged pull requests whose merge commit was authored over an hour after their first commit, by repository."""
    late = seconds(F.col("first_commit_at"), F.col("merge_commit_at")) > RESET_S
    rows = merged(t).where("merge_commit_at is not null and first_commit_at is not null")
    return rows.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(late).alias("resets"))


@metric(
    "gaming.cfr_suppression",
    f""", {_LINKS_SQL}, d as (select repo_id, count(*) n, count(*) filter (reverted_at is not null and id not in (select deploy_id from inc_links)) suppressed from live group by 1)
select repo_id, n, suppressed, case when suppressed > 0 then 'cfr_suppressed' else 'ok' end flag from d""",
)
def cfr_suppression(t: Tables) -> DataFrame:
    """Production deployments in the window that a revert or hotfix followed but no incident is linked to, by repository."""
    linked = incident_links(t).select(F.col("deploy_id").alias("id")).distinct().withColumn("linked", F.lit(True))
    rows = production(t).where(t.within("created_at")).select("repo_id", "id", "reverted_at").join(linked, "id", "left")
    hidden = F.count_if(F.col("reverted_at").isNotNull() & F.col("linked").isNull())
    each = rows.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"), hidden.alias("suppressed"))
    return each.withColumn("flag", F.when(F.col("suppressed") > 0, "cfr_suppressed").otherwise("ok"))


@metric("serve.visibility", " select repo_id, author_id, count(*) n from prs where repo_id = 3 or author_id = 7 group by 1, 2")
def visibility(t: Tables) -> DataFrame:
    """Rows that a member of team 3, who is person 7, may see."""
    return t.prs.where((F.col("repo_id") == 3) | (F.col("author_id") == 7)).groupBy("repo_id", "author_id").agg(F.count(F.lit(1)).alias("n"))


@metric("serve.freshness", """with w as (select event_type source, max(ts) newest from events group by 1) select source, round((epoch_us(timestamp '2024-01-31') - epoch_us(newest)) / 3.6e9, 6) as hours, case when epoch_us(timestamp '2024-01-31') - epoch_us(newest) >= 24 * 3600 * 1000000::bigint then 'stale_refused' when epoch_us(timestamp '2024-01-31') - epoch_us(newest) >= 4 * 3600 * 1000000::bigint then 'warn' else 'ok' end freshness from w""", prelude=False)
def freshness(t: Tables) -> DataFrame:
    """Age of each source's newest record: warned from 4 hours on, refused from 24 on."""
    age = seconds(F.col("at"), F.lit("2024-01-31").cast("timestamp")) / 3600
    newest = t.raw("events").groupBy(F.col("event_type").alias("source")).agg(F.max("ts").alias("at"))
    return newest.select("source", rounded(age).alias("hours"), bands(age, [(24.0, "stale_refused"), (4.0, "warn")], "ok").alias("freshness"))


@metric("serve.overview", " ".join("union all" if i % 2 else f"select '{n}' \"table\", count(*) n from {n}" for i, n in enumerate([x for t in ("orders", "lineitem", "events", "customer", "supplier", "part") for x in (t, "")][:-1])), prelude=False)
def overview(t: Tables) -> DataFrame:
    """Rows of each table."""
    out = None
    for name in ("orders", "lineitem", "events", "customer", "supplier", "part"):
        row = t.raw(name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n")
        out = row if out is None else out.union(row)
    return out


@metric(
    "report.trend_pivot",
    """, x as (select year(created_at)::int y, state, count(*) n from prs group by 1, 2) select y "year", coalesce(sum(n) filter (state = 'merged'), 0)::bigint merged, coalesce(sum(n) filter (state = 'open'), 0)::bigint "open", coalesce(sum(n) filter (state = 'closed'), 0)::bigint closed from x group by 1""",
)
def trend_pivot(t: Tables) -> DataFrame:
    """Pull requests by year and state, a column a state: what a stacked chart draws."""
    wide = t.prs.groupBy(F.year("created_at").alias("year")).pivot("state", ["merged", "open", "closed"]).agg(F.count(F.lit(1)))
    return wide.na.fill(0, ["merged", "open", "closed"])


def period(kind: str, at: dt.date, days: int = 30) -> tuple[dt.date, dt.date, dt.date, dt.date]:
    """First and last day of the period that holds ``at``, and of the one before it."""
    if kind == "weekly":
        first = at - dt.timedelta(at.weekday())
        last = first + dt.timedelta(6)
    elif kind in ("monthly", "quarterly", "annual"):
        months = {"monthly": 1, "quarterly": 3, "annual": 12}[kind]
        first = dt.date(at.year, (at.month - 1) // months * months + 1, 1)
        after = first.month - 1 + months
        last = dt.date(first.year + after // 12, after % 12 + 1, 1) - dt.timedelta(1)
        before = first.month - 1 - months
        return first, last, dt.date(first.year + before // 12, before % 12 + 1, 1), first - dt.timedelta(1)
    elif kind == "custom":
        first, last = at - dt.timedelta(days - 1), at
    else:
        raise ValueError(f"no such period: {kind}")
    length = (last - first).days + 1
    return first, last, first - dt.timedelta(length), first - dt.timedelta(1)


@metric(
    "report.periods",
    """, p as (select date_trunc('quarter', merged_at)::date q, count(*) n, median((epoch_us(merged_at) - epoch_us(created_at)) / 1e6) v from prs where merged_at is not null group by 1)
select q, n, round(v, 6) as value, round(lag(v) over (order by q), 6) prior, round(v / nullif(lag(v) over (order by q), 0) - 1, 6) change from p""",
)
def periods(t: Tables) -> DataFrame:
    """Median time to merge by quarter, and its change from the quarter before."""
    each = t.prs.where("merged_at is not null").groupBy(F.trunc("merged_at", "QUARTER").alias("q")).agg(F.count(F.lit(1)).alias("n"), F.median(seconds(F.col("created_at"), F.col("merged_at"))).alias("v"))
    prior = F.lag("v").over(W.orderBy("q"))  # a row a quarter
    return each.select("q", "n", rounded(F.col("v")).alias("value"), rounded(prior).alias("prior"), rounded(ratio(F.col("v"), prior) - 1).alias("change"))


@metric("stream.daily_counts", "select ts::date \"day\", event_type, count(*) n, round(sum(value), 4) total from events group by 1, 2", prelude=False)
def stream_daily(t: Tables) -> DataFrame:
    """Events by day and type, counted by a stream with a watermark that drops repeated events."""
    return daily_counts(t.spark, f"{t.folder}/events.parquet")


@metric("stream.reopens", "with x as (select user_id, lag(event_type) over (partition by user_id order by ts, event_id) p, event_type from events) select user_id, count(*) filter (p = 'purchase' and event_type <> 'purchase') reopens, count(*) n from x group by 1", prelude=False)
def stream_reopens(t: Tables) -> DataFrame:
    """Times each issue left done, by a state machine over the stream."""
    return status_changes(t.spark, f"{t.folder}/events.parquet")


@metric(
    "stream.sliding_counts",
    """with d as (select distinct * from events), m as (select max(ts) - interval 48 hour mark, min(ts) least from d), e as (select unnest(generate_series(least::date + 1, mark::date, interval 1 day))::date "end" from m)
select ("end" - 30) "first", "end", event_type, count(*) n, round(sum(value), 4) total from e join d on ts < "end" and ts >= "end" - interval 30 day group by 1, 2, 3""",
    prelude=False,
)
def stream_sliding(t: Tables) -> DataFrame:
    """Events by type in the 30 days before each midnight that the watermark has passed; each window is told once and its state dropped."""
    return drained(sliding(events_stream(t.spark, f"{t.folder}/events.parquet")), "append").drop("epoch")


SYNCED = "event_id long, user_id long, event_type string, ts timestamp"


@metric(
    "stream.synced",
    f"""with x as (select * from events), s as (select (user_id % {TEAMS})::varchar "scope", count(distinct event_id) n, max(ts) watermark from x group by 1)
select 'tracker' source, 'events' resource, "scope", n, watermark, watermark - interval 10 minute since from s""",
    prelude=False,
)
def stream_synced(t: Tables) -> DataFrame:
    """Events merged into a table a few files at a time, twice over: rows of each scope, its watermark, and where its next read starts."""
    store = SyncStore(t.spark, fresh_folder(t.spark, "synced"), SYNCED, ["event_id"], "ts")
    files = staged(t.raw("events").select("event_id", "user_id", "event_type", "ts").repartition(6), "landed")
    scope = F.col("user_id") % TEAMS
    for name in ("first", "again"):
        stream = t.spark.readStream.schema(SYNCED).option("maxFilesPerTrigger", 4).parquet(files.inputFiles()[0].rpartition("/")[0])
        follow(stream, store, fresh_folder(t.spark, "checkpoint"), name, "tracker", "events", scope, F.col("ts"))
    rows = store.read().groupBy(scope.cast("string").alias("scope")).agg(F.count(F.lit(1)).alias("n"))
    return store.watermarks().join(store.since(), ["source", "resource", "scope"]).join(rows, "scope").select("source", "resource", "scope", "n", "watermark", "since")
