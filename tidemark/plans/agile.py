"""Sprint metrics: a sprint is a month; its issues are the orders placed in it or carried over from the month before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.stats import critical_t, finite, mean_ranks, ratio, rounded, seconds
from tidemark.plans.catalog import metric
from tidemark.tables import FROM, ISSUES_FROM, ISSUES_TO, TO, Tables


def membership(t: Tables) -> DataFrame:
    """(sprint, issue_id, change, at_start): added at its month's start or late, every ninth removed again."""
    rows = t.prs.where(t.within("created_at"))
    added = rows.select(F.trunc("created_at", "MONTH").alias("sprint"), F.col("id").alias("issue_id"), F.lit("added").alias("change"), (F.dayofmonth("created_at") <= 15).alias("at_start"))
    gone = rows.where("id % 9 = 0").select(F.trunc("created_at", "MONTH").alias("sprint"), F.col("id").alias("issue_id"), F.lit("removed").alias("change"), F.lit(False).alias("at_start"))
    return added.unionByName(gone)


def sprint_issues(t: Tables) -> DataFrame:
    """(issue_id, is_done, points, level, parent_id): some issues have no points; every fourth hangs below the one before."""
    return t.prs.selectExpr("id as issue_id", "state = 'merged' as is_done", f"{_POINTS} as points", f"{_LEVEL} as level", "case when id % 4 = 3 then id - 1 end as parent_id")


_POINTS = "case when id % 6 < 2 then null else cast(id % 8 as double) end"
_LEVEL = "case when id % 4 = 3 then 2 when id % 9 = 0 then 0 else 1 end"
COUNT_LEVEL = 1


def counted_points(member: str, level: int = COUNT_LEVEL) -> Column:
    """What an issue adds to the points of the sprint's set ``member``, of rows joined with their parent.

    An issue of the level counts its own points; one below it counts, if its parent is known, unless the parent has
    points and is in the set itself, which then counts those; one above counts nothing, nor does one without points.
    """
    own, parent = F.col(member) & (F.col("points") > 0), F.coalesce(F.col(f"parent_{member}") & (F.col("parent_points") > 0), F.lit(False))
    counts = own & ((F.col("level") == level) | ((F.col("level") > level) & F.col("known_parent").isNotNull() & ~parent))
    return F.when(counts, F.col("points")).otherwise(0.0)


def sprints(t: Tables) -> DataFrame:
    """(sprint, committed, completed, added_after): points at one level of the hierarchy, none twice."""
    each = membership(t).groupBy("sprint", "issue_id").agg(F.bool_or((F.col("change") == "added") & F.col("at_start")).alias("at_start"), F.bool_or(F.col("change") == "added").alias("added"), F.bool_or(F.col("change") == "removed").alias("removed"))
    rows = each.join(sprint_issues(t), "issue_id").select("sprint", "issue_id", "points", "level", "parent_id", F.col("at_start").alias("committed"), (F.col("added") & ~F.col("removed") & F.col("is_done")).alias("completed"), (F.col("added") & ~F.col("at_start")).alias("added_after"))
    sets = ("committed", "completed", "added_after")
    known = sprint_issues(t).select(F.col("issue_id").alias("known_parent"), F.col("points").alias("parent_points"))
    beside = rows.select(F.col("sprint").alias("parent_sprint"), F.col("issue_id").alias("parent_issue"), *[F.col(c).alias(f"parent_{c}") for c in sets])
    up = rows.join(known, F.col("parent_id") == F.col("known_parent"), "left").join(beside, (F.col("parent_id") == F.col("parent_issue")) & (F.col("sprint") == F.col("parent_sprint")), "left")
    return up.groupBy("sprint").agg(*[F.sum(counted_points(c)).alias(c) for c in sets])


_COUNTS_SQL = "case when e.{0} and p > 0 and (level = 1 or (level > 1 and known is not null and not coalesce(q.{0} and parent_points > 0, false))) then p else 0 end"
_SPRINTS = f""", mb as (select date_trunc('month', created_at)::date sprint, id issue_id, 'added' change, day(created_at) <= 15 at_start from prs where created_at >= timestamp '{FROM}' and created_at < timestamp '{TO}' + interval 1 day
 union all select date_trunc('month', created_at)::date, id, 'removed', false from prs where id % 9 = 0 and created_at >= timestamp '{FROM}' and created_at < timestamp '{TO}' + interval 1 day),
pt as (select id, state = 'merged' done, {_POINTS} p, {_LEVEL} as level, case when id % 4 = 3 then id - 1 end parent_id from prs),
es as (select sprint, issue_id, bool_or(change = 'added' and at_start) committed, bool_or(change = 'added') and not bool_or(change = 'removed') and any_value(done) completed, bool_or(change = 'added') and not bool_or(change = 'added' and at_start) added_after from mb join pt on issue_id = id group by 1, 2),
sp as (select e.sprint, sum({_COUNTS_SQL.format("committed")}) committed, sum({_COUNTS_SQL.format("completed")}) completed, sum({_COUNTS_SQL.format("added_after")}) added_after
 from es e join pt on e.issue_id = pt.id left join (select id known, p parent_points from pt) k on k.known = pt.parent_id left join es q on q.sprint = e.sprint and q.issue_id = pt.parent_id group by 1)"""


@metric("agile.sprint_velocity", _SPRINTS + " select sprint, committed, completed, added_after, round(avg(completed) over (), 6) window_average from sp")
def sprint_velocity(t: Tables) -> DataFrame:
    """Points committed, completed and added late in each sprint, and the average completed."""
    return sprints(t).withColumn("window_average", rounded(F.avg("completed").over(W.partitionBy())))  # a row a month


@metric("agile.latest_velocity", _SPRINTS + " select max(sprint) sprint, arg_max(completed, sprint) as value from sp")
def latest_velocity(t: Tables) -> DataFrame:
    """Points completed in the latest sprint."""
    return sprints(t).agg(F.max("sprint").alias("sprint"), F.max_by("completed", "sprint").alias("value"))


@metric("agile.say_do", _SPRINTS + " select round(sum(completed) / nullif(sum(committed), 0), 6) as value, count(*) sprints from sp")
def say_do(t: Tables) -> DataFrame:
    """Points completed / committed over all sprints."""
    return sprints(t).agg(rounded(ratio(F.sum("completed"), F.sum("committed"))).alias("value"), F.count(F.lit(1)).alias("sprints"))


@metric(
    "agile.sprint_predictability",
    _SPRINTS + " select case when count(*) >= 2 then round(count(*) filter (abs(completed - committed) / committed <= 0.2) / count(*)::double, 6) end as value, count(*) sprints from sp where committed > 0",
)
def sprint_predictability(t: Tables) -> DataFrame:
    """Share of sprints that completed within a fifth of what was committed; at least two."""
    n = F.count(F.lit(1))
    near = F.abs(F.col("completed") - F.col("committed")) / F.col("committed") <= 0.2
    return sprints(t).where("committed > 0").agg(rounded(F.when(n >= 2, ratio(F.count_if(near), n))).alias("value"), n.alias("sprints"))


@metric(
    "agile.estimation_accuracy",
    f""", pairs as (select points x, (epoch_us(resolved_at) - epoch_us(created_at)) / 1e6 y from issues where points > 0 and not was_reopened and resolved_at >= timestamp '{ISSUES_FROM}' and resolved_at < timestamp '{ISSUES_TO}' + interval 1 day),
r as (select rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0 rx, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0 ry from pairs),
c as (select count(*) n, corr(rx, ry) rho from r), s as (select n, case when isfinite(rho) then rho end rho from c),
u as (select n, rho, abs(rho) * sqrt((n - 2) / nullif(1 - rho * rho, 0)) t, case when n - 2 < 1 then null when n - 2 <= 10 then [12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228][n - 2]::double else 1.96 + 1.96 * (1.96 * 1.96 + 1) / (4.0 * (n - 2)) end crit from s)
select n, round(rho, 9) rho, round(t, 6) t, t > crit significant, case when n >= 5 and t > crit then round(rho, 9) end as value, case when n = 0 then 'no_data' when n >= 5 and coalesce(t > crit, false) then 'ok' else 'insufficient_sample' end data_quality from u""",
    unit="correlation",
)
def estimation_accuracy(t: Tables) -> DataFrame:
    """Spearman's rank correlation of points and time from creation to resolution, of issues resolved in the window, pointed and never reopened; told if n >= 5 and significant at 0.05."""
    pairs = t.issues.where("points > 0 and not was_reopened").where(t.issues_within("resolved_at")).select(F.col("points").alias("x"), seconds(F.col("created_at"), F.col("resolved_at")).alias("y"))
    ranked = mean_ranks(mean_ranks(pairs, "x", "rx"), "y", "ry")
    found = ranked.agg(F.count(F.lit(1)).alias("n"), finite(F.corr("rx", "ry")).alias("rho"))
    rho, df = F.col("rho"), F.col("n") - 2
    told = found.withColumn("t", F.abs(rho) * F.sqrt(ratio(df, 1 - rho * rho))).withColumn("significant", F.col("t") > critical_t(df))
    sure = F.coalesce((F.col("n") >= 5) & F.col("significant"), F.lit(False))
    state = F.when(F.col("n") == 0, "no_data").when(sure, "ok").otherwise("insufficient_sample")
    return told.select("n", F.round("rho", 9).alias("rho"), rounded(F.col("t")).alias("t"), "significant", F.when(sure, F.round("rho", 9)).alias("value"), state.alias("data_quality"))


@metric(
    "agile.rolled_up_points",
    """, up as (select i.issue_id, i.level, i.points, i.parent_id, p.issue_id is not null has_parent, p.points parent_points from issues i left join issues p on i.parent_id = p.issue_id),
k as (select case when level = 1 then 'own' else 'rolled_up' end kind, points from up where points > 0 and (level = 1 or (level > 1 and has_parent and not coalesce(parent_points > 0, false))))
select kind, count(*) issues, sum(points) points from k group by 1""",
    unit="points",
)
def rolled_up_points(t: Tables) -> DataFrame:
    """Points at one level of the hierarchy: an issue's own, or a subtask's where its parent is known and has none; none counts twice."""
    known = rolled_up(t.issues).where("points > 0")
    return known.groupBy("kind").agg(F.count(F.lit(1)).alias("issues"), F.sum("points").alias("points"))


def rolled_up(issues: DataFrame, level: int = 1) -> DataFrame:
    """(issue_id, kind, points) of what counts among ``issues``: a self join of issues to their parents."""
    parents = issues.select(F.col("issue_id").alias("known_parent"), F.col("points").alias("parent_points"))
    up = issues.join(parents, F.col("parent_id") == F.col("known_parent"), "left")
    below = (F.col("level") > level) & F.col("known_parent").isNotNull() & ~F.coalesce(F.col("parent_points") > 0, F.lit(False))
    return up.where((F.col("level") == level) | below).select("issue_id", F.when(F.col("level") == level, "own").otherwise("rolled_up").alias("kind"), "points")


@metric(
    "agile.priority_mix",
    f""", w as (select * from prs where created_at >= timestamp '{FROM}' and created_at < timestamp '{TO}' + interval 1 day) select priority, count(*) n, round(count(*) / sum(count(*)) over ()::double, 6) share from w where priority is not null group by 1""",
)
def priority_mix(t: Tables) -> DataFrame:
    """Items created in the window by priority."""
    counts = t.prs.where(t.within("created_at")).where("priority is not null").groupBy("priority").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("priority", "n", rounded(ratio(F.col("n"), F.col("total"))).alias("share"))  # one row


@metric(
    "agile.resolution_mix",
    f""", b as (select resolution from issues where type = 'Bug' and resolution is not null and created_at < timestamp '{ISSUES_TO}' + interval 1 day), n as (select count(*) c from b)
select resolution, count(*) n, case when max(c) >= 3 then round(count(*) / max(c)::double, 6) end share from b, n group by 1""",
)
def resolution_mix(t: Tables) -> DataFrame:
    """Resolved bugs by resolution, shares from three on."""
    bugs = t.issues.where("type = 'Bug' and resolution is not null").where(f"created_at < timestamp '{t.window.issues_last}' + interval 1 day")
    counts = bugs.groupBy("resolution").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("c"))
    return counts.join(F.broadcast(total)).select("resolution", "n", rounded(F.when(F.col("c") >= 3, ratio(F.col("n"), F.col("c")))).alias("share"))  # one row


@metric("agile.prioritised_share", f" select round(count(priority) / nullif(count(*), 0)::double, 6) as value, count(*) n from issues where created_at < timestamp '{ISSUES_FROM}'")
def prioritised_share(t: Tables) -> DataFrame:
    """Issues with a priority / issues, of those created before the window."""
    return t.issues.where(f"created_at < timestamp '{t.window.issues_first}'").agg(rounded(ratio(F.count("priority"), F.count(F.lit(1)))).alias("value"), F.count(F.lit(1)).alias("n"))
