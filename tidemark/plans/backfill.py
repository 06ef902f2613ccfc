"""Daily snapshots of a set of metrics over trailing windows: all days, teams and metrics in one job."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.stats import rounded, waited
from tidemark.operators.sliding import counted_days, trailing
from tidemark.plans.catalog import metric
from tidemark.plans.dora import _PROD_SQL, production
from tidemark.plans.pull_requests import sizes
from tidemark.session import fresh_folder, staged
from tidemark.sources.snapshot_store import SnapshotStore
from tidemark.tables import FROM, TO, Tables

TRAILING_DAYS = 30
#: Days that a store of snapshots looks back.
HORIZON_DAYS = 60


def _merged_rows(t: Tables) -> DataFrame:
    return t.prs.where("state = 'merged' and merged_at is not null")


def _deployments(t: Tables) -> DataFrame:
    return production(t).where("status = 'success'").select("repo_id", F.to_date("created_at").alias("day"), F.lit(1.0).alias("v"))


def _since_open(column: str) -> Callable[[Tables], DataFrame]:
    return lambda t: _merged_rows(t).select("repo_id", F.to_date("merged_at").alias("day"), waited(F.coalesce("ready_at", "created_at"), F.col(column)).alias("v"))


def _size(t: Tables) -> DataFrame:
    return sizes(t, _merged_rows(t)).select("repo_id", F.to_date("merged_at").alias("day"), F.col("size").cast("double").alias("v"))


def _unreviewed(t: Tables) -> DataFrame:
    rows = _merged_rows(t).select("id", "author_id", "repo_id", F.to_date("merged_at").alias("day"))
    others = rows.join(t.reviews, F.col("id") == F.col("pr_id")).where(F.col("reviewer_id") != F.col("author_id")).select(F.col("id").alias("seen")).distinct()
    return rows.join(others, F.col("id") == F.col("seen"), "left").select("repo_id", "day", F.col("seen").isNull().cast("double").alias("v"))


#: What a snapshot's value is: values a day, the median value, or the mean one.
RATE, MEDIAN, MEAN = "rate", "median", "mean"
#: The metrics that are kept as snapshots: what their value is, and a team's values by day.
SNAPSHOTS: dict[str, tuple[str, Callable[[Tables], DataFrame]]] = {
    "dora.deployment_frequency": (RATE, _deployments),
    "pr.time_to_merge": (MEDIAN, _since_open("merged_at")),
    "pr.time_to_first_review": (MEDIAN, _since_open("first_review_at")),
    "pr.size": (MEDIAN, _size),
    "pr.merge_without_review_rate": (MEAN, _unreviewed),
}


def day_states(t: Tables, names: list[str] | None = None) -> DataFrame:
    """(scope, metric, day, v, c) of a set of metrics, by team: what any trailing window is put together from."""
    facts = [SNAPSHOTS[n][1](t).select(F.concat(F.lit("team:"), "repo_id").alias("scope"), F.lit(n).alias("metric"), "day", "v") for n in names or SNAPSHOTS]
    return counted_days(reduce(DataFrame.unionByName, facts), ["scope", "metric"])


def cells(states: DataFrame, first: str, last: str, days: int = TRAILING_DAYS) -> DataFrame:
    """(scope, metric, day, n, value, p90, data_quality) of each day from first to last, over the ``days`` that end with it.

    A window without values is ``no_data`` and has none; percentiles of 90 need 20 values.
    """
    kinds = F.create_map(*[F.lit(x) for n, (kind, _) in SNAPSHOTS.items() for x in (n, kind)])
    slid = trailing(states, ["scope", "metric"], first, last, days, {"p50": 0.5, "p90": 0.9}).withColumn("kind", kinds[F.col("metric")])
    n, kind = F.col("n"), F.col("kind")
    value = F.when(kind == RATE, n / F.lit(float(days))).when(kind == MEDIAN, F.col("p50")).otherwise(F.col("total") / n)
    return slid.select(
        "scope",
        "metric",
        "day",
        "n",
        rounded(F.when(n > 0, value)).alias("value"),
        rounded(F.when((kind == MEDIAN) & (n >= 20), F.col("p90"))).alias("p90"),
        F.when(n == 0, "no_data").otherwise("ok").alias("data_quality"),
    )


_FACTS_SQL = f""", mr as (select * from prs where state = 'merged' and merged_at is not null),
ms as (select repo_id, merged_at::date d, (epoch_us(merged_at) - epoch_us(coalesce(ready_at, created_at))) / 1e6 a, (epoch_us(first_review_at) - epoch_us(coalesce(ready_at, created_at))) / 1e6 b, coalesce(s, 0)::double z,
 (id not in (select pr_id from reviews join mr on mr.id = pr_id where reviewer_id <> author_id))::int::double u from mr left join (select pr_id, sum(coalesce(haloc, additions + deletions)) s from files group by 1) on id = pr_id),
facts as (select repo_id, 'dora.deployment_frequency' metric, created_at::date d, 1.0::double v from deploys where status = 'success' and {_PROD_SQL}
 union all select repo_id, 'pr.time_to_merge', d, greatest(0, a) from ms where a is not null union all select repo_id, 'pr.time_to_first_review', d, greatest(0, b) from ms where b is not null
 union all select repo_id, 'pr.size', d, z from ms union all select repo_id, 'pr.merge_without_review_rate', d, u from ms)"""


def _cells_sql(first: str, last: str) -> str:
    return _FACTS_SQL + f""", grid as (select repo_id, metric, unnest(generate_series({first}, {last}, interval 1 day))::date d from (select distinct repo_id, metric from facts where d > {first} - {TRAILING_DAYS} and d <= {last})),
cell as (select concat('team:', g.repo_id) "scope", g.metric metric, g.d "day", count(v) n, round(case when count(v) > 0 then case when g.metric = 'dora.deployment_frequency' then count(v) / {TRAILING_DAYS}.0::double when g.metric = 'pr.merge_without_review_rate' then avg(v) else quantile_cont(v, 0.5) end end, 6) as value,
 case when g.metric in ('pr.time_to_merge', 'pr.time_to_first_review', 'pr.size') and count(v) >= 20 then round(quantile_cont(v, 0.9), 6) end p90, case when count(v) = 0 then 'no_data' else 'ok' end data_quality
 from grid g left join facts f on f.repo_id = g.repo_id and f.metric = g.metric and f.d <= g.d and f.d > g.d - {TRAILING_DAYS} group by 1, 2, 3)"""


@metric("report.backfill", _cells_sql(f"date '{FROM}'", f"date '{TO}'") + ' select "scope", metric, "day", n, value, p90, data_quality from cell')
def backfill(t: Tables) -> DataFrame:
    """Every team's snapshots of all kept metrics, for each day of the window, over the 30 days that end with it."""
    return cells(staged(day_states(t), "day_states"), t.window.first, t.window.last)


def asked_cells(states: DataFrame, first: str, last: str) -> DataFrame:
    """(scope, metric, day) of every scope and metric that has values, for each day."""
    return states.select("scope", "metric").distinct().select("scope", "metric", F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))


def keep_snapshots(store: SnapshotStore, states: DataFrame, first: str, last: str, watermark: str, now: str) -> int:
    """Bring the store up to a watermark for the days from first to last; returns how many cells were worked out."""

    def compute(due: DataFrame) -> DataFrame:
        begin, end = due.agg(F.min("day"), F.max("day")).first()
        return cells(states, str(begin), str(end))

    at = lambda s: F.lit(s).cast("timestamp")
    return store.snapshot(asked_cells(states, first, last), compute, at(watermark), at(now))


_LATE_DAYS = 7
_HORIZON_SQL = f"(date '{TO}' - {HORIZON_DAYS - 1})"


@metric(
    "report.stored_snapshots",
    _cells_sql(_HORIZON_SQL, f"date '{TO}'") + f""" select "scope", metric, "day", n, value, p90, data_quality, timestamp '{TO}' + interval 1 day watermark from cell where "day" > date '{TO}' - {2 * _LATE_DAYS}""",
)
def stored_snapshots(t: Tables) -> DataFrame:
    """The last two weeks read from a store of 60 days: written as of a week before the window's end, then brought up to the end."""
    store, last = SnapshotStore(t.spark, fresh_folder(t.spark, "snapshots")), dt.date.fromisoformat(t.window.last)
    back = lambda days: str(last - dt.timedelta(days))
    states = staged(day_states(t), "day_states")
    known = states.where(F.col("day") <= F.lit(back(_LATE_DAYS)).cast("date"))
    for have, upto in ((known, back(_LATE_DAYS)), (states, str(last))):
        end = str(dt.date.fromisoformat(upto) + dt.timedelta(1))
        keep_snapshots(store, have, back(HORIZON_DAYS - 1), upto, end, end)
    return store.read(back(2 * _LATE_DAYS - 1), last).select("scope", "metric", "day", "n", "value", "p90", "data_quality", "watermark")
