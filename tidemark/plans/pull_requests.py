"""Pull-request metrics: phases, reviews, sizes, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.stats import bands, gini, p90, quality, quantiles, r7, ratio, rounded, seconds, waited
from tidemark.operators.asof import asof
from tidemark.plans.catalog import metric
from tidemark.tables import FROM, TO, Tables

_MERGED_SQL = f", mp as (select * from prs where state = 'merged' and merged_at >= timestamp '{FROM}' and merged_at < timestamp '{TO}' + interval 1 day)"


def merged(t: Tables) -> DataFrame:
    return t.prs.where("state = 'merged'").where(t.within("merged_at"))


def external_reviews(t: Tables) -> DataFrame:
    """Reviews of merged pull requests by people other than their author."""
    own = merged(t).select(F.col("id").alias("pr_id"), "author_id")
    return t.reviews.join(own, "pr_id").where("reviewer_id <> author_id").join(t.bots, F.col("reviewer_id") == F.col("bot_id"), "left_anti")


_EXTERNAL_SQL = _MERGED_SQL + ", xr as (select r.*, mp.author_id from reviews r join mp on r.pr_id = mp.id where reviewer_id <> author_id and reviewer_id not in (select bot_id from bots))"


@metric(
    "pr.cycle_time",
    _MERGED_SQL
    + """, dd as (select repo_id, finished_at from deploys where status = 'success' and lower(environment) = 'production'),
j as (select mp.*, dd.finished_at from mp asof left join dd on mp.repo_id = dd.repo_id and mp.merged_at <= dd.finished_at),
p as (select greatest(0, epoch_us(coalesce(ready_at, created_at)) - epoch_us(first_commit_at)) / 1e6 coding, greatest(0, epoch_us(first_review_at) - epoch_us(coalesce(ready_at, created_at))) / 1e6 pickup,
 greatest(0, epoch_us(merged_at) - epoch_us(first_review_at)) / 1e6 review, greatest(0, epoch_us(finished_at) - epoch_us(merged_at)) / 1e6 deploy, first_commit_at is not null and first_review_at is not null and finished_at is not null full_ from j)
select count(*) merged, count(*) filter (full_) n, round(median(coding) filter (coding is not null and full_), 6) coding_p50, round(median(pickup) filter (full_), 6) pickup_p50, round(median(review) filter (full_), 6) review_p50, round(median(deploy) filter (full_), 6) deploy_p50,
 round(quantile_cont(coding + pickup + review + deploy, 0.5) filter (full_), 6) as value, round(quantile_cont(coding + pickup + review + deploy, 0.75) filter (full_), 6) p75,
 case when count(*) = 0 then 'no_data' when count(*) filter (full_) = 0 then 'insufficient_sample' else 'ok' end data_quality from p""",
)
def cycle_time(t: Tables) -> DataFrame:
    """Coding, pickup, review and deploy phases of merged pull requests, and their sum where all four are known."""
    done = t.deploys.where("status = 'success' and lower(environment) = 'production'").select("repo_id", "finished_at", F.col("id").alias("deploy_id"))
    own = merged(t).select("id", "repo_id", F.coalesce("ready_at", "created_at").alias("open_at"), "first_commit_at", "first_review_at", "merged_at")
    found = asof(own, done, ["repo_id"], "merged_at", "finished_at", "deploy_id", [])
    phases = found.select(
        waited(F.col("first_commit_at"), F.col("open_at")).alias("coding"),
        waited(F.col("open_at"), F.col("first_review_at")).alias("pickup"),
        waited(F.col("first_review_at"), F.col("merged_at")).alias("review"),
        waited(F.col("merged_at"), F.col("event.finished_at")).alias("deploy"),
    ).withColumn("total", F.col("coding") + F.col("pickup") + F.col("review") + F.col("deploy"))
    whole = lambda c: F.when(F.col("total").isNotNull(), F.col(c))
    n = F.count("total")
    return phases.agg(
        F.count(F.lit(1)).alias("merged"),
        n.alias("n"),
        *[rounded(r7(whole(c), 0.5)).alias(f"{c}_p50") for c in ("coding", "pickup", "review", "deploy")],
        rounded(r7(F.col("total"), 0.5)).alias("value"),
        rounded(r7(F.col("total"), 0.75)).alias("p75"),
        F.when(F.count(F.lit(1)) == 0, "no_data").when(n == 0, "insufficient_sample").otherwise("ok").alias("data_quality"),
    )


def _reviewed_rows(t: Tables) -> DataFrame:
    by = W.partitionBy("pr_id").orderBy("submitted_at", "n")
    return t.reviews.withColumn("next_at", F.lead("submitted_at").over(by))


@metric(
    "pr.review_latency",
    _MERGED_SQL
    + """, rv as (select *, lead(submitted_at) over (partition by pr_id order by submitted_at, n) next_at from reviews),
g as (select pr_id, min(submitted_at) first_at, sum(case when state = 'changes_requested' then (epoch_us(next_at) - epoch_us(submitted_at)) / 1e6 end) rework from rv group by 1),
x as (select greatest(0, (epoch_us(first_at) - epoch_us(coalesce(ready_at, created_at))) / 1e6) fr, coalesce(rework, 0) rework, greatest(0, (epoch_us(merged_at) - epoch_us(coalesce(ready_at, created_at))) / 1e6) total from mp join g on mp.id = g.pr_id)
select count(*) n, round(median(fr), 6) first_response_p50, round(median(rework), 6) rework_p50, round(median(greatest(0, total - fr - rework)), 6) idle_p50 from x""",
)
def review_latency(t: Tables) -> DataFrame:
    """First response, waiting for the next review after each request for changes, and the idle rest, of merged pull requests."""
    rework = F.sum(F.when(F.col("state") == "changes_requested", seconds(F.col("submitted_at"), F.col("next_at"))))
    each = _reviewed_rows(t).groupBy("pr_id").agg(F.min("submitted_at").alias("first_at"), F.coalesce(rework, F.lit(0.0)).alias("rework"))
    opened = F.coalesce("ready_at", "created_at")
    rows = merged(t).join(each, F.col("id") == F.col("pr_id")).select(waited(opened, F.col("first_at")).alias("fr"), "rework", waited(opened, F.col("merged_at")).alias("total"))
    idle = F.greatest(F.lit(0.0), F.col("total") - F.col("fr") - F.col("rework"))
    return rows.agg(F.count(F.lit(1)).alias("n"), rounded(F.median("fr")).alias("first_response_p50"), rounded(F.median("rework")).alias("rework_p50"), rounded(F.median(idle)).alias("idle_p50"))


def _since_open(t: Tables, column: str) -> DataFrame:
    q = quantiles(merged(t).select(waited(F.coalesce("ready_at", "created_at"), F.col(column)).alias("s")), "s", {"p50": 0.5, "p75": 0.75, "p90": 0.9})
    return q.select("n", rounded(F.col("p50")).alias("p50"), rounded(F.col("p75")).alias("p75"), rounded(F.when(F.col("n") >= 20, F.col("p90"))).alias("p90"), quality(F.col("n")).alias("data_quality"))


def _since_open_sql(column: str) -> str:
    return _MERGED_SQL + f""", x as (select greatest(0, (epoch_us({column}) - epoch_us(coalesce(ready_at, created_at))) / 1e6) s from mp where {column} is not null)
select count(s) n, round(quantile_cont(s, 0.5), 6) p50, round(quantile_cont(s, 0.75), 6) p75, case when count(s) >= 20 then round(quantile_cont(s, 0.9), 6) end p90, case when count(s) = 0 then 'no_data' else 'ok' end data_quality from x"""


@metric("pr.time_to_first_review", _since_open_sql("first_review_at"))
def time_to_first_review(t: Tables) -> DataFrame:
    """Seconds from ready (else created) to the first review of merged pull requests, never below zero."""
    return _since_open(t, "first_review_at")


@metric("pr.time_to_merge", _since_open_sql("merged_at"))
def time_to_merge(t: Tables) -> DataFrame:
    """Seconds from ready (else created) to the merge."""
    return _since_open(t, "merged_at")


def sizes(t: Tables, prs: DataFrame) -> DataFrame:
    """(id, size): churn of each pull request, zero without files; a file's own count, else lines added and deleted."""
    churn = t.files.groupBy("pr_id").agg(F.sum(F.coalesce("haloc", F.col("additions") + F.col("deletions"))).alias("size"))
    return prs.join(churn, F.col("id") == F.col("pr_id"), "left").withColumn("size", F.coalesce("size", F.lit(0))).drop("pr_id")


_SIZES_SQL = _MERGED_SQL + ", sz as (select mp.*, coalesce(s, 0) as size from mp left join (select pr_id, sum(coalesce(haloc, additions + deletions)) s from files group by 1) on id = pr_id)"


@metric(
    "pr.size",
    _SIZES_SQL
    + """ select round(median(size), 6) as value, count(*) filter (size <= 10) xs, count(*) filter (size > 10 and size <= 50) s, count(*) filter (size > 50 and size <= 200) m,
 count(*) filter (size > 200 and size <= 500) l, count(*) filter (size > 500) xl from sz""",
)
def size(t: Tables) -> DataFrame:
    """Median churn of merged pull requests, and how many are XS to 10, S to 50, M to 200, L to 500, XL."""
    x = F.col("size")
    limits = {"xs": x <= 10, "s": (x > 10) & (x <= 50), "m": (x > 50) & (x <= 200), "l": (x > 200) & (x <= 500), "xl": x > 500}
    return sizes(t, merged(t)).agg(rounded(F.median("size")).alias("value"), *[F.count_if(c).alias(name) for name, c in limits.items()])


@metric(
    "pr.size_buckets",
    _SIZES_SQL + " select case when size <= 10 then 'XS' when size <= 50 then 'S' when size <= 200 then 'M' when size <= 500 then 'L' else 'XL' end bucket, count(*) n from sz group by 1",
)
def size_buckets(t: Tables) -> DataFrame:
    """Merged pull requests by size bucket."""
    bucket = bands(-F.col("size"), [(-10, "XS"), (-50, "S"), (-200, "M"), (-500, "L")], "XL")
    return sizes(t, merged(t)).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@metric(
    "pr.ci_health",
    """, s as (select count(*) filter (conclusion = 'success') good, count(*) filter (conclusion is not null and completed_at is not null) done, quantile_cont(case when completed_at is not null then greatest(0, (epoch_us(completed_at) - epoch_us(started_at)) / 1e6) end, 0.5) p50,
 quantile_cont(case when completed_at is not null then greatest(0, (epoch_us(completed_at) - epoch_us(started_at)) / 1e6) end, 0.9) p90 from checks),
f as (select count(*) filter (k > 1) flaky, count(*) pairs from (select head_sha, "name", count(distinct conclusion) k from checks where conclusion is not null group by 1, 2))
select round(good / done::double, 6) as value, done, round(p50, 6) p50, round(p90, 6) p90, round(flaky / pairs::double, 6) flakiness from s, f""",
)
def ci_health(t: Tables) -> DataFrame:
    """Successes / completed check runs, their latency, and the share of (commit, check) with more than one conclusion."""
    took = waited(F.col("started_at"), F.col("completed_at"))
    done = F.count_if(F.col("conclusion").isNotNull() & F.col("completed_at").isNotNull())
    runs = t.checks.agg(ratio(F.count_if(F.col("conclusion") == "success"), done).alias("value"), done.alias("done"), r7(took, 0.5).alias("p50"), p90(took).alias("p90"))
    pairs = t.checks.where("conclusion is not null").groupBy("head_sha", "name").agg(F.countDistinct("conclusion").alias("k")).agg(ratio(F.count_if(F.col("k") > 1), F.count(F.lit(1))).alias("flakiness"))
    return runs.crossJoin(pairs).select(rounded(F.col("value")).alias("value"), "done", rounded(F.col("p50")).alias("p50"), rounded(F.col("p90")).alias("p90"), rounded(F.col("flakiness")).alias("flakiness"))  # a row each


@metric(
    "pr.stale",
    f", la as (select pr_id, max(submitted_at) a from reviews group by 1) select id from prs left join la on id = pr_id where state = 'open' and not is_draft and greatest(updated_at, a) < timestamp '{TO}' - interval 14 day",
)
def stale(t: Tables) -> DataFrame:
    """Open pull requests, no drafts, whose last update or review is older than 14 days; the metric's value is their number."""
    last = t.reviews.groupBy("pr_id").agg(F.max("submitted_at").alias("a"))
    rows = t.prs.where("state = 'open' and not is_draft").join(last, F.col("id") == F.col("pr_id"), "left")
    return rows.where(F.greatest("updated_at", "a") < F.expr(f"timestamp '{t.window.last}' - interval 14 days")).select("id")


@metric(
    "pr.reviewer_load_gini",
    _EXTERNAL_SQL
    + """, c as (select reviewer_id, count(*) x from xr group by 1), r as (select x, row_number() over (order by x, reviewer_id) i, count(*) over () n, sum(x) over () total from c)
select round(2 * sum(i * x) / (max(n) * max(total)) - (max(n) + 1) / max(n)::double, 6) as value, max(n) reviewers from r""",
)
def reviewer_load_gini(t: Tables) -> DataFrame:
    """Gini coefficient of reviews given on merged pull requests, over reviewers."""
    counts = external_reviews(t).groupBy("reviewer_id").agg(F.count(F.lit(1)).alias("given"))
    return gini(counts, "given").select(rounded(F.col("gini")).alias("value"), F.col("n").alias("reviewers"))


def _per_merged(t: Tables, numerator: DataFrame) -> DataFrame:
    """``numerator`` is one row with column x."""
    n = merged(t).agg(F.count(F.lit(1)).alias("merged"))
    return n.crossJoin(numerator).select(rounded(ratio(F.col("x"), F.col("merged"))).alias("value"), "merged", quality(F.col("merged")).alias("data_quality"))  # a row each


def _per_merged_sql(x: str, external: bool = True) -> str:
    return (_EXTERNAL_SQL if external else _MERGED_SQL) + f" select round(({x}) / nullif((select count(*) from mp), 0)::double, 6) as value, (select count(*) from mp) merged, case when (select count(*) from mp) = 0 then 'no_data' else 'ok' end data_quality"


@metric("pr.review_coverage", _per_merged_sql("select count(distinct pr_id) from xr"))
def review_coverage(t: Tables) -> DataFrame:
    """Merged pull requests with a review by another person / merged pull requests."""
    return _per_merged(t, merged(t).join(external_reviews(t), F.col("id") == F.col("pr_id"), "left_semi").agg(F.count(F.lit(1)).alias("x")))


@metric("pr.merge_without_review_rate", _per_merged_sql("select count(*) from mp where id not in (select pr_id from xr)"))
def merge_without_review_rate(t: Tables) -> DataFrame:
    """Merged pull requests without a review by another person / merged pull requests."""
    return _per_merged(t, merged(t).join(external_reviews(t), F.col("id") == F.col("pr_id"), "left_anti").agg(F.count(F.lit(1)).alias("x")))


@metric("pr.reviewers_per_pr", _per_merged_sql("select count(*) from (select distinct pr_id, reviewer_id from xr)"))
def reviewers_per_pr(t: Tables) -> DataFrame:
    """Distinct reviewers over merged pull requests / merged pull requests."""
    return _per_merged(t, external_reviews(t).select("pr_id", "reviewer_id").distinct().agg(F.count(F.lit(1)).alias("x")))


@metric("pr.comments_per_pr", _per_merged_sql("select count(*) from reviews join mp on pr_id = id where reviews.state = 'commented'", False))
def comments_per_pr(t: Tables) -> DataFrame:
    """Comments on merged pull requests / merged pull requests."""
    return _per_merged(t, t.reviews.where("state = 'commented'").join(merged(t), F.col("pr_id") == F.col("id"), "left_semi").agg(F.count(F.lit(1)).alias("x")))


@metric("pr.review_iterations", _per_merged_sql("select count(*) from (select *, lead(submitted_at) over (partition by pr_id order by submitted_at, n) nx from reviews) q join mp on pr_id = id where q.state = 'changes_requested' and nx is not null", False))
def review_iterations(t: Tables) -> DataFrame:
    """Requests for changes that aren't a pull request's last review / merged pull requests."""
    rounds = _reviewed_rows(t).where("state = 'changes_requested' and next_at is not null").join(merged(t), F.col("pr_id") == F.col("id"), "left_semi")
    return _per_merged(t, rounds.agg(F.count(F.lit(1)).alias("x")))


@metric(
    "pr.window_slice",
    f" select state, count(*) n from prs where (created_at >= timestamp '{FROM}' and created_at < timestamp '{TO}' + interval 1 day) or (merged_at >= timestamp '{FROM}' and merged_at < timestamp '{TO}' + interval 1 day) or (state = 'open' and created_at < timestamp '{TO}' + interval 1 day) group by 1",
)
def window_slice(t: Tables) -> DataFrame:
    """Pull requests created in the window, merged in it, or open by its end, by state."""
    reaches = t.within("created_at") | t.within("merged_at") | ((F.col("state") == "open") & (F.col("created_at") < F.expr(f"timestamp '{t.window.last}' + interval 1 day")))
    return t.prs.where(reaches).groupBy("state").agg(F.count(F.lit(1)).alias("n"))
