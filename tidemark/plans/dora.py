"""Delivery metrics: how often, how fast, how safely."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.stats import bands, quality, quantiles, ratio, rounded, waited
from tidemark.operators.asof import asof
from tidemark.plans.catalog import metric
from tidemark.tables import DAYS, FROM, ISSUE_DAYS, ISSUES_FROM, ISSUES_TO, TO, Tables

#: Deployments to production, whatever its region or number.
PRODUCTION = r"^prod(uction)?([-_. ]|\d|$)"
_PROD_SQL = r"regexp_matches(lower(trim(environment)), '^prod(uction)?([-_. ]|[0-9]|$)')"
_WINDOW_SQL = f"created_at >= timestamp '{FROM}' and created_at < timestamp '{TO}' + interval 1 day"


def environment_matches(column: Column, target: str) -> Column:
    """Production's family for any name of it, else equality without case."""
    name = F.lower(F.trim(column))
    return name.rlike(PRODUCTION) if target.lower() in ("prod", "production") else name == target.strip().lower()


def production(t: Tables) -> DataFrame:
    return t.deploys.where(environment_matches(F.col("environment"), "production"))


@metric(
    "dora.deployment_frequency",
    f""", d as (select * from deploys where status = 'success' and {_PROD_SQL} and {_WINDOW_SQL})
select case when count(*) = 0 then null else round(count(*) / {DAYS}.0, 6) end as value, count(*) total, count(distinct created_at::date) active_days,
 case when count(*) = 0 then null when count(*) >= {DAYS} then 'elite' when count(*) / {DAYS}.0 >= 1 / 7.0 then 'high' when count(*) / {DAYS}.0 >= 1 / 30.0 then 'medium' else 'low' end band,
 case when count(*) = 0 then 'no_data' else 'ok' end data_quality from d""",
)
def deployment_frequency(t: Tables) -> DataFrame:
    """Successful production deployments / days of the window; bands from 1 a day, 1 a week, 1 in 30 days."""
    n = F.count(F.lit(1))
    value = F.when(n > 0, n / F.lit(float(t.window.days)))
    return (
        production(t)
        .where("status = 'success'")
        .where(t.within("created_at"))
        .agg(
            rounded(value).alias("value"),
            n.alias("total"),
            F.countDistinct(F.to_date("created_at")).alias("active_days"),
            bands(value, [(1.0, "elite"), (1 / 7, "high"), (1 / 30, "medium")], "low").alias("band"),
            quality(n).alias("data_quality"),
        )
    )


_LEAD_SQL = f"""d as (select repo_id, finished_at, id, created_at from deploys where status = 'success' and {_PROD_SQL}),
m as (select * from prs where state = 'merged' and first_commit_at is not null and merged_at >= timestamp '{FROM}' and merged_at < timestamp '{TO}' + interval 1 day),
j as (select m.*, d.finished_at from m asof join d on m.repo_id = d.repo_id and m.merged_at <= d.finished_at),
x as (select *, greatest(0, (epoch_us(finished_at) - epoch_us(first_commit_at)) / 1e6) s from j)"""


def _merged(t: Tables) -> DataFrame:
    return t.prs.where("state = 'merged'").where(t.within("merged_at"))


@metric(
    "dora.lead_time",
    unit="seconds",
    oracle=f""", {_LEAD_SQL} select count(*) n, round(quantile_cont(s, 0.5), 6) p50, round(quantile_cont(s, 0.75), 6) p75,
 case when count(*) >= 20 then round(quantile_cont(s, 0.9), 6) end p90, case when count(*) = 0 then 'no_data' else 'ok' end data_quality from x""",
)
def lead_time(t: Tables) -> DataFrame:
    """First commit to the first successful production deployment of the repository that ends at or after the merge, in seconds, never below zero."""
    done = production(t).where("status = 'success'").select("repo_id", "finished_at", "id")
    found = asof(_merged(t).where("first_commit_at is not null").select("id", "repo_id", "first_commit_at", "merged_at"), done, ["repo_id"], "merged_at", "finished_at", "id", [])
    q = quantiles(found.select(waited(F.col("first_commit_at"), F.col("event.finished_at")).alias("s")), "s", {"p50": 0.5, "p75": 0.75, "p90": 0.9})
    return q.select("n", rounded(F.col("p50")).alias("p50"), rounded(F.col("p75")).alias("p75"), rounded(F.when(F.col("n") >= 20, F.col("p90"))).alias("p90"), quality(F.col("n")).alias("data_quality"))


def incident_links(t: Tables) -> DataFrame:
    """Each order placed open in the window is an incident; its deployment is the latest production one at most seven days before."""
    incidents = t.prs.where("state = 'open'").where(t.within("created_at")).select(F.col("id").alias("incident_id"), "created_at", F.lit(0).alias("all"))
    live = production(t).where(t.within("created_at")).select(F.col("created_at").alias("deployed_at"), F.col("id").alias("deploy_id"), F.lit(0).alias("all"))
    found = asof(incidents, live, ["all"], "created_at", "deployed_at", "deploy_id", [], forward=False)
    return found.where("event is not null and created_at <= event.deployed_at + interval 7 days").select("incident_id", F.col("event.deploy_id").alias("deploy_id"))


_LINKS_SQL = f"""live as (select * from deploys where {_PROD_SQL} and {_WINDOW_SQL}),
inc as (select id incident_id, created_at from prs where state = 'open' and {_WINDOW_SQL}),
last as (select created_at, max(id) id from live group by 1),
inc_links as (select incident_id, last.id deploy_id from inc asof join last on inc.created_at >= last.created_at where inc.created_at <= last.created_at + interval 7 day)"""


@metric("dora.incident_links", f", {_LINKS_SQL} select incident_id, deploy_id from inc_links")
def links(t: Tables) -> DataFrame:
    """Incident and the latest production deployment at most seven days before it, of any repository."""
    return incident_links(t)


def _share(t: Tables, needs_incidents: bool) -> DataFrame:
    deploys = production(t).where(t.within("created_at")).agg(F.count(F.lit(1)).alias("deploys"))
    linked = incident_links(t).agg(F.countDistinct("deploy_id").alias("linked"))
    n = t.prs.where("state = 'open'").where(t.within("created_at")).agg(F.count(F.lit(1)).alias("incidents"))
    one = deploys.crossJoin(linked).crossJoin(n)  # a row each
    known = (F.col("deploys") > 0) & ((F.col("incidents") > 0) if needs_incidents else F.lit(True))
    return one.select(rounded(F.when(known, ratio(F.col("linked"), F.col("deploys")))).alias("value"), "deploys", "linked", F.when(known, "ok").otherwise("no_data").alias("data_quality"))


def _share_sql(guard: str) -> str:
    return f""", {_LINKS_SQL}, s as (select (select count(*) from live) deploys, (select count(distinct deploy_id) from inc_links) linked, (select count(*) from inc) incidents)
select case when {guard} then round(linked / deploys::double, 6) end as value, deploys, linked, case when {guard} then 'ok' else 'no_data' end data_quality from s"""


@metric("dora.change_failure_rate", _share_sql("deploys > 0 and incidents > 0"), trust="hybrid")
def change_failure_rate(t: Tables) -> DataFrame:
    """Production deployments linked to an incident / production deployments; no data without either."""
    return _share(t, True)


@metric("dora.deployment_rework_rate", _share_sql("deploys > 0"), trust="hybrid")
def deployment_rework_rate(t: Tables) -> DataFrame:
    """Production deployments that an incident follows / production deployments."""
    return _share(t, False)


@metric(
    "dora.recovery_time",
    f""", e as (select id, created_at, status from deploys where {_PROD_SQL} and {_WINDOW_SQL}),
ok as (select created_at, min(id) id from e where status = 'success' group by 1),
f as (select (epoch_us(ok.created_at) - epoch_us(e.created_at)) / 1e6 s from e asof join ok on e.created_at < ok.created_at where e.status in ('failure', 'error'))
select round(median(s), 6) as value, count(*) n, case when count(*) = 0 then 'no_data' else 'ok' end data_quality from f""",
)
def recovery_time(t: Tables) -> DataFrame:
    """Median seconds from a failed production deployment to the next successful one, of any repository."""
    live = production(t).where(t.within("created_at")).withColumn("all", F.lit(0))
    # Deployments come at whole days here, so the next one is at least an instant later.
    failed = live.where("status in ('failure', 'error')").select("id", "all", "created_at", F.expr("created_at + interval 1 microsecond").alias("from_at"))
    good = live.where("status = 'success'").select("all", F.col("created_at").alias("good_at"), F.col("id").alias("good_id"))
    found = asof(failed, good, ["all"], "from_at", "good_at", "good_id", [])
    s = waited(F.col("created_at"), F.col("event.good_at"))
    return found.agg(rounded(F.median(s)).alias("value"), F.count(s).alias("n"), quality(F.count(s)).alias("data_quality"))


_INC_WINDOW = f"created_at >= timestamp '{ISSUES_FROM}' and created_at < timestamp '{ISSUES_TO}' + interval 1 day"


@metric(
    "dora.incident_recovery",
    f", i as (select (epoch_us(resolved_at) - epoch_us(created_at)) / 1e6 s from incidents where {_INC_WINDOW}) select round(median(s), 6) as value, count(*) incidents, count(s) resolved from i",
)
def incident_recovery(t: Tables) -> DataFrame:
    """Median seconds from an incident to the first event of its issue that is none: what recovery falls back to."""
    s = waited(F.col("created_at"), F.col("resolved_at"))
    return t.incidents.where(t.issues_within("created_at")).agg(rounded(F.median(s)).alias("value"), F.count(F.lit(1)).alias("incidents"), F.count(s).alias("resolved"))


@metric(
    "dora.incident_reopen_rate",
    """, r as (select issue_id, count(*) filter (to_status = 'error') errors, count(*) filter (from_status in ('purchase') and to_status not in ('purchase')) reopened from transitions group by 1)
select round(count(*) filter (reopened > 0) / count(*)::double, 6) as value, count(*) incidents, sum(reopened)::bigint reopens from r where errors > 0""",
)
def incident_reopen_rate(t: Tables) -> DataFrame:
    """Issues with an incident that left done again / issues with an incident."""
    reopened = F.col("from_status").isin("purchase") & ~F.col("to_status").isin("purchase")
    each = t.transitions.groupBy("issue_id").agg(F.count_if(F.col("to_status") == "error").alias("errors"), F.count_if(reopened).alias("reopened")).where("errors > 0")
    n = F.count(F.lit(1))
    return each.agg(rounded(ratio(F.count_if(F.col("reopened") > 0), n)).alias("value"), n.alias("incidents"), F.sum("reopened").alias("reopens"))


@metric(
    "dora.reliability_proxy",
    f""", i as (select count(*) n from incidents where {_INC_WINDOW}) select round(1 / (1 + n / {ISSUE_DAYS}.0), 6) as value, n incidents from i""",
    trust="hybrid",
)
def reliability_proxy(t: Tables) -> DataFrame:
    """1 / (1 + incidents / days of the window)."""
    n = F.count(F.lit(1))
    return t.incidents.where(t.issues_within("created_at")).agg(rounded(1 / (1 + n / F.lit(float(t.window.issue_days)))).alias("value"), n.alias("incidents"))


@metric(
    "dora.by_repository",
    f""", d as (select repo_id, count(*) filter (status = 'success') good, count(*) n, bool_and(source <> 'merge_proxy') is_real from deploys where {_PROD_SQL} and {_WINDOW_SQL} group by 1)
select repo_id, good, n, round(good / n::double, 6) success_share, is_real, round(good / {DAYS}.0, 6) per_day from d""",
)
def by_repository(t: Tables) -> DataFrame:
    """Success share and rate of production deployments of each repository, and whether its feed has no proxies."""
    good, n = F.count_if(F.col("status") == "success"), F.count(F.lit(1))
    each = production(t).where(t.within("created_at")).groupBy("repo_id").agg(good.alias("good"), n.alias("n"), F.bool_and(F.col("source") != "merge_proxy").alias("is_real"))
    return each.select("repo_id", "good", "n", rounded(ratio(F.col("good"), F.col("n"))).alias("success_share"), "is_real", rounded(F.col("good") / F.lit(float(t.window.days))).alias("per_day"))


@metric(
    "dora.benchmark",
    f""", d as (select repo_id, count(*) filter (status = 'success') / {DAYS}.0 r from deploys where {_PROD_SQL} and {_WINDOW_SQL} group by 1)
select repo_id, case when r >= 1 then 'elite' when r >= 1 / 7.0 then 'high' when r >= 1 / 30.0 then 'medium' else 'low' end band, (rank() over (order by r desc))::int as place from d""",
)
def benchmark(t: Tables) -> DataFrame:
    """Band and rank of each repository's deployment rate."""
    rate = F.count_if(F.col("status") == "success") / F.lit(float(t.window.days))
    each = production(t).where(t.within("created_at")).groupBy("repo_id").agg(rate.alias("r"))
    return each.select("repo_id", bands(F.col("r"), [(1.0, "elite"), (1 / 7, "high"), (1 / 30, "medium")], "low").alias("band"), F.rank().over(W.orderBy(F.desc("r"))).cast("int").alias("place"))
