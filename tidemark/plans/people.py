"""Metrics of people: each plan computes all people at once, one row a person, with the sample floors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.stats import bands, entropy_share, floored, quality, r7, ratio, robust_sd, rounded, seconds
from tidemark.plans.catalog import metric
from tidemark.plans.code import _KIND_SQL, directory, path_kind
from tidemark.plans.flow import BUG_TYPES
from tidemark.plans.pull_requests import _EXTERNAL_SQL, _MERGED_SQL, _SIZES_SQL, external_reviews, merged, sizes
from tidemark.tables import Tables


def told(value: Column, n: Column, least: int) -> Column:
    """A person's value, null below the sample floor."""
    return rounded(F.when(n >= least, value))


@metric(
    "person.review_reciprocity",
    _EXTERNAL_SQL
    + """, g as (select reviewer_id p, count(*) given from xr group by 1), r as (select author_id p, count(*) received from xr group by 1)
select coalesce(g.p, r.p) person_id, coalesce(given, 0) given, coalesce(received, 0) received, case when coalesce(given, 0) + coalesce(received, 0) >= 5 then round(coalesce(given, 0) / (coalesce(received, 0) + 1)::double, 6) end as value from g full join r on g.p = r.p""",
)
def review_reciprocity(t: Tables) -> DataFrame:
    """Reviews given / (received + 1), from five of both on."""
    x = external_reviews(t)
    both = x.select(F.col("reviewer_id").alias("person_id"), F.lit(1).alias("g"), F.lit(0).alias("r")).union(x.select("author_id", F.lit(0), F.lit(1)))
    each = both.groupBy("person_id").agg(F.sum("g").alias("given"), F.sum("r").alias("received"))
    return each.select("person_id", "given", "received", told(F.col("given") / (F.col("received") + 1), F.col("given") + F.col("received"), 5).alias("value"))


@metric(
    "person.knowledge_ownership_index",
    """, o as (select path, touched_by, sum(additions) mine, max(complexity) c from files group by 1, 2), w as (select *, sum(mine) over (partition by path) total, count(*) over (partition by path) people, max(c) over (partition by path) cc from o)
select touched_by person_id, coalesce(sum(case when mine / total::double >= 0.5 and mine >= 30 then cc end), 0)::bigint as value, count(*) filter (mine / total::double >= 0.8 and people <= 1) sole from w group by 1""",
)
def knowledge_ownership_index(t: Tables) -> DataFrame:
    """Complexity of the paths of which a person wrote at least half and 30 lines, and of how many they are the only one."""
    own = t.files.groupBy("path", "touched_by").agg(F.sum("additions").alias("mine"), F.max("complexity").alias("c"))
    whole = own.groupBy("path").agg(F.sum("mine").alias("total"), F.count(F.lit(1)).alias("people"), F.max("c").alias("cc"))
    share = F.col("mine") / F.col("total")
    rows = own.drop("c").join(whole, "path")
    return rows.groupBy(F.col("touched_by").alias("person_id")).agg(F.coalesce(F.sum(F.when((share >= 0.5) & (F.col("mine") >= 30), F.col("cc"))), F.lit(0)).cast("long").alias("value"), F.count_if((share >= 0.8) & (F.col("people") <= 1)).alias("sole"))


@metric(
    "person.ownership_top",
    """, o as (select path, touched_by, sum(additions) mine, max(complexity) c from files group by 1, 2), r as (select *, row_number() over (partition by touched_by order by c desc, mine desc, path) i from o)
select touched_by person_id, i::int place, path, c::int complexity from r where i <= 5""",
)
def ownership_top(t: Tables) -> DataFrame:
    """Each person's five most complex paths."""
    own = t.files.groupBy("path", "touched_by").agg(F.sum("additions").alias("mine"), F.max("complexity").alias("c"))
    at = W.partitionBy("touched_by").orderBy(F.desc("c"), F.desc("mine"), "path")
    return own.withColumn("place", F.row_number().over(at)).where("place <= 5").select(F.col("touched_by").alias("person_id"), "place", "path", F.col("c").cast("int").alias("complexity"))


@metric(
    "person.ci_green_before_merge_rate",
    _MERGED_SQL
    + """, k as (select pr_id, count(*) filter (completed_at is not null) done, bool_or(coalesce(conclusion = 'failure', false)) red from checks group by 1)
select author_id person_id, count(*) n, round(count(*) filter (done > 0 and not red) / count(*)::double, 6) as value from mp join k on id = pr_id group by 1""",
)
def ci_green_before_merge_rate(t: Tables) -> DataFrame:
    """Merged pull requests with completed checks of which none failed / those with checks."""
    runs = t.checks.groupBy("pr_id").agg(F.count("completed_at").alias("done"), F.bool_or(F.coalesce(F.col("conclusion") == "failure", F.lit(False))).alias("red"))
    n = F.count(F.lit(1))
    return merged(t).join(runs, F.col("id") == F.col("pr_id")).groupBy(F.col("author_id").alias("person_id")).agg(n.alias("n"), rounded(ratio(F.count_if((F.col("done") > 0) & ~F.col("red")), n)).alias("value"))


def _best_links(t: Tables) -> DataFrame:
    """(pr_id, confidence, issue_id): each linked pull request's best link, the smallest issue on ties."""
    return t.links.groupBy("pr_id").agg(F.max("confidence").alias("confidence"), F.max_by("issue_id", F.struct(F.col("confidence"), -F.col("issue_id"))).alias("issue_id"))


_BEST_SQL = ", bl as (select pr_id, max(confidence) confidence, arg_max(issue_id, (confidence, -issue_id)) issue_id from links group by 1)"


@metric(
    "person.ticket_linkage_rate",
    _MERGED_SQL
    + _BEST_SQL
    + """ select author_id person_id, count(*) n, count(pr_id) linked, round(count(pr_id) / count(*)::double, 6) as value, round(sum(coalesce(confidence, 0)) / count(*), 6) weighted_rate, case when count(*) < 5 then 'insufficient_sample' else 'ok' end data_quality
 from mp left join bl on id = pr_id group by 1""",
    unit="ratio",
)
def ticket_linkage_rate(t: Tables) -> DataFrame:
    """Merged pull requests with a link to an issue / merged pull requests, and the mean confidence of their best links."""
    rows = merged(t).join(_best_links(t), F.col("id") == F.col("pr_id"), "left")
    n = F.count(F.lit(1))
    return rows.groupBy(F.col("author_id").alias("person_id")).agg(
        n.alias("n"),
        F.count("pr_id").alias("linked"),
        rounded(ratio(F.count("pr_id"), n)).alias("value"),
        rounded(ratio(F.sum(F.coalesce("confidence", F.lit(0.0))), n)).alias("weighted_rate"),
        quality(n, 5).alias("data_quality"),
    )


@metric(
    "person.unlinked_evidence",
    _MERGED_SQL + ", r as (select author_id, id, row_number() over (partition by author_id order by merged_at, id) i from mp where id not in (select pr_id from links)) select author_id person_id, i::int place, id pr_id from r where i <= 5",
)
def unlinked_evidence(t: Tables) -> DataFrame:
    """Each person's first five merged pull requests without a link."""
    bare = merged(t).join(t.links, F.col("id") == F.col("pr_id"), "left_anti")
    at = W.partitionBy("author_id").orderBy("merged_at", "id")
    return bare.withColumn("place", F.row_number().over(at)).where("place <= 5").select(F.col("author_id").alias("person_id"), "place", F.col("id").alias("pr_id"))


@metric(
    "person.test_inclusion_rate",
    _MERGED_SQL
    + f""", k as (select pr_id, bool_or(({_KIND_SQL}) = 'prod') prod, bool_or(({_KIND_SQL}) = 'test') test from files group by 1)
select author_id person_id, count(*) filter (prod) n, case when count(*) filter (prod) >= 5 then round(count(*) filter (prod and test) / count(*) filter (prod)::double, 6) end as value from mp join k on id = pr_id group by 1""",
    trust="hybrid",
)
def test_inclusion_rate(t: Tables) -> DataFrame:
    """Pull requests that touch production code and tests / those that touch production code, from five on."""
    kind = path_kind(F.col("path"))
    touched = t.files.groupBy("pr_id").agg(F.bool_or(kind == "prod").alias("prod"), F.bool_or(kind == "test").alias("test"))
    n = F.count_if("prod")
    return merged(t).join(touched, F.col("id") == F.col("pr_id")).groupBy(F.col("author_id").alias("person_id")).agg(n.alias("n"), told(ratio(F.count_if(F.col("prod") & F.col("test")), n), n, 5).alias("value"))


@metric(
    "person.wip_small_pr_discipline",
    _SIZES_SQL + ", m as (select median(size) med from sz) select author_id person_id, count(*) n, case when count(*) >= 8 then round(count(*) filter (size <= med) / count(*)::double, 6) end as value from sz, m group by 1",
)
def small_pr_discipline(t: Tables) -> DataFrame:
    """Pull requests no larger than the team's median / pull requests, from eight on."""
    rows = sizes(t, merged(t))
    n = F.count(F.lit(1))
    middle = rows.agg(F.median("size").alias("med"))
    return rows.join(F.broadcast(middle)).groupBy(F.col("author_id").alias("person_id")).agg(n.alias("n"), told(ratio(F.count_if(F.col("size") <= F.col("med")), n), n, 8).alias("value"))  # one row


@metric(
    "pr.changes_requested_rate_received",
    _EXTERNAL_SQL + ", c as (select distinct pr_id from xr where state = 'changes_requested') select author_id person_id, count(*) n, case when count(*) >= 8 then round(count(c.pr_id) / count(*)::double, 6) end as value from mp left join c on id = c.pr_id group by 1",
)
def changes_requested_rate_received(t: Tables) -> DataFrame:
    """Merged pull requests on which another person requested changes / merged pull requests, from eight on."""
    asked = external_reviews(t).where("state = 'changes_requested'").select("pr_id").distinct()
    n = F.count(F.lit(1))
    return merged(t).join(asked, F.col("id") == F.col("pr_id"), "left").groupBy(F.col("author_id").alias("person_id")).agg(n.alias("n"), told(ratio(F.count("pr_id"), n), n, 8).alias("value"))


@metric(
    "pr.review_bypass_rate_received",
    _EXTERNAL_SQL + ", c as (select distinct pr_id from xr) select mp.author_id person_id, count(*) n, case when count(*) >= 8 then round(count(*) filter (c.pr_id is null or merged_by = mp.author_id) / count(*)::double, 6) end as value from mp left join c on id = c.pr_id group by 1",
)
def review_bypass_rate_received(t: Tables) -> DataFrame:
    """Merged pull requests without another's review or merged by their author / merged pull requests, from eight on."""
    seen = external_reviews(t).select("pr_id").distinct()
    n = F.count(F.lit(1))
    bypassed = F.col("pr_id").isNull() | (F.col("merged_by") == F.col("author_id"))
    return merged(t).join(seen, F.col("id") == F.col("pr_id"), "left").groupBy(F.col("author_id").alias("person_id")).agg(n.alias("n"), told(ratio(F.count_if(bypassed), n), n, 8).alias("value"))


@metric(
    "pr.feedback_response_latency",
    _EXTERNAL_SQL
    + """, x as (select author_id, state, (epoch_us(lead(submitted_at) over (partition by pr_id order by submitted_at, n)) - epoch_us(submitted_at)) / 1e6 s from xr)
select author_id person_id, count(*) n, case when count(*) >= 5 then round(quantile_cont(s, 0.5), 6) end p50, case when count(*) >= 5 then round(quantile_cont(s, 0.75), 6) end p75, case when count(*) >= 20 then round(quantile_cont(s, 0.9), 6) end p90 from x where state = 'changes_requested' and s is not null group by 1""",
)
def feedback_response_latency(t: Tables) -> DataFrame:
    """Seconds from a request for changes to the next review by another person, from five on.

    Reviews of one instant and number come by reviewer, so the order of the rows decides nothing.
    """
    at = W.partitionBy("pr_id").orderBy("submitted_at", "n", "reviewer_id", "state")
    waits = external_reviews(t).withColumn("s", seconds(F.col("submitted_at"), F.lead("submitted_at").over(at))).where("state = 'changes_requested' and s is not null")
    s = F.col("s")
    return waits.groupBy(F.col("author_id").alias("person_id")).agg(F.count(F.lit(1)).alias("n"), rounded(floored(s, 0.5, 5)).alias("p50"), rounded(floored(s, 0.75, 5)).alias("p75"), rounded(floored(s, 0.9, 20)).alias("p90"))


_CX = ", mf as (select f.*, mp.author_id from files f join mp on f.pr_id = mp.id where not is_generated)"


@metric(
    "person.complexity_authored_delta",
    _MERGED_SQL
    + _CX
    + """, p as (select author_id, pr_id, sum(greatest(0, complexity - coalesce(base_complexity, 0))) d from mf group by 1, 2)
select author_id person_id, count(*) n, sum(d)::bigint total, round(median(d), 6) as value, round(quantile_cont(d, 0.75), 6) p75, case when count(*) < 5 then 'insufficient_sample' else 'ok' end data_quality from p group by 1""",
    unit="index",
)
def complexity_authored_delta(t: Tables) -> DataFrame:
    """Complexity that each merged pull request adds, head less base summed over its files where positive (a new file has no base): median, upper quartile and total."""
    rows = t.files.where("not is_generated").join(merged(t).select("id", "author_id"), F.col("pr_id") == F.col("id"))
    each = rows.groupBy("author_id", "pr_id").agg(F.sum(F.greatest(F.lit(0), F.col("complexity") - F.coalesce("base_complexity", F.lit(0)))).alias("d"))
    n = F.count(F.lit(1))
    return each.groupBy(F.col("author_id").alias("person_id")).agg(n.alias("n"), F.sum("d").cast("long").alias("total"), rounded(r7(F.col("d"), 0.5)).alias("value"), rounded(r7(F.col("d"), 0.75)).alias("p75"), quality(n, 5).alias("data_quality"))


@metric(
    "person.high_complexity_file_share",
    _MERGED_SQL
    + _CX.replace("mp.author_id", "mp.author_id, mp.repo_id")
    + """, th as (select repo_id, quantile_cont(complexity, 0.75) t from mf group by 1)
select author_id person_id, sum(additions + deletions)::bigint as lines, round(sum(case when complexity >= t then additions + deletions else 0 end) / nullif(sum(additions + deletions), 0)::double, 6) as value from mf join th using (repo_id) group by 1""",
)
def high_complexity_file_share(t: Tables) -> DataFrame:
    """Lines changed in files of at least the repository's upper quartile of complexity / lines changed."""
    rows = t.files.where("not is_generated").join(merged(t).select("id", "author_id", "repo_id"), F.col("pr_id") == F.col("id"))
    line = rows.groupBy("repo_id").agg(r7(F.col("complexity"), 0.75).alias("t"))
    n = F.col("additions") + F.col("deletions")
    return rows.join(line, "repo_id").groupBy(F.col("author_id").alias("person_id")).agg(F.sum(n).alias("lines"), rounded(ratio(F.sum(F.when(F.col("complexity") >= F.col("t"), n).otherwise(0)), F.sum(n))).alias("value"))


@metric(
    "person.pr_conceptual_surface",
    _MERGED_SQL
    + _CX
    + """, p as (select author_id, pr_id, sum(complexity * least(1, (additions + deletions) / greatest(1, complexity * 4)::double)) * (1 + 0.1 * (count(distinct case when contains(path, '/') then regexp_replace(path, '/[^/]*$', '') else '.' end) - 1)) s from mf group by 1, 2)
select author_id person_id, count(*) n, case when count(*) >= 8 then round(median(s), 6) end as value, case when count(*) >= 8 then round(quantile_cont(s, 0.75), 6) end p75 from p group by 1""",
)
def pr_conceptual_surface(t: Tables) -> DataFrame:
    """Complexity touched, weighted by the share of the file changed and the directories involved, from eight on."""
    rows = t.files.where("not is_generated").join(merged(t).select("id", "author_id"), F.col("pr_id") == F.col("id"))
    part = F.col("complexity") * F.least(F.lit(1.0), (F.col("additions") + F.col("deletions")) / F.greatest(F.lit(1), F.col("complexity") * 4))
    each = rows.groupBy("author_id", "pr_id").agg((F.sum(part) * (1 + 0.1 * (F.countDistinct(directory(F.col("path"))) - 1))).alias("s"))
    return each.groupBy(F.col("author_id").alias("person_id")).agg(F.count(F.lit(1)).alias("n"), rounded(floored(F.col("s"), 0.5, 8)).alias("value"), rounded(floored(F.col("s"), 0.75, 8)).alias("p75"))


WORK = ("feature", "bug", "debt", "test", "docs", "other")
# Issue types of each kind of work, in lower case; types of bugs are those of the flow metrics.
FEATURE_WORK = ("story", "feature", "epic", "new feature")
DEBT_WORK = ("debt", "tech debt", "technical debt", "chore", "maintenance")
_WORK_SQL = f"""case when lower(issue_type) in {BUG_TYPES} then 'bug' when lower(issue_type) in {FEATURE_WORK} then 'feature' when lower(issue_type) in {DEBT_WORK} then 'debt'
 when test_ and not prod_ then 'test' when docs_ and not prod_ then 'docs' when issue_type is not null then 'other' else 'feature' end"""


def work(t: Tables) -> DataFrame:
    """(person_id, kind, is_verified) of each merged pull request with files: the type of its best linked issue, else what its paths are."""
    kind = path_kind(F.col("path"))
    touched = t.files.groupBy("pr_id").agg(*[F.bool_or(kind == k).alias(f"{k}_") for k in ("test", "docs", "prod")])
    types = _best_links(t).join(t.issues.select("issue_id", F.col("type").alias("issue_type")), "issue_id").select(F.col("pr_id").alias("linked_id"), "issue_type")
    rows = merged(t).join(touched, F.col("id") == F.col("pr_id")).join(types, F.col("id") == F.col("linked_id"), "left")
    return rows.select(F.col("author_id").alias("person_id"), F.expr(_WORK_SQL).alias("kind"), F.col("issue_type").isNotNull().alias("is_verified"))


_WORK = _MERGED_SQL + _BEST_SQL + f""", tk as (select pr_id, bool_or(({_KIND_SQL}) = 'test') test_, bool_or(({_KIND_SQL}) = 'docs') docs_, bool_or(({_KIND_SQL}) = 'prod') prod_ from files group by 1),
ty as (select pr_id, type issue_type from bl join issues on bl.issue_id = issues.issue_id),
wk as (select author_id person_id, {_WORK_SQL} kind, issue_type is not null is_verified from mp join tk on id = tk.pr_id left join ty on id = ty.pr_id)"""


@metric(
    "person.worktype_mix",
    _WORK + """, c as (select person_id, kind, count(*) n from wk group by 1, 2), s as (select person_id, sum(n) total, arg_max(kind, (n, -list_position(['feature', 'bug', 'debt', 'test', 'docs', 'other'], kind))) dominant, max(n) most from c group by 1)
select person_id, total::bigint n, dominant, round(most / total::double, 6) as value from s""",
    trust="hybrid",
)
def worktype_mix(t: Tables) -> DataFrame:
    """The commonest kind of work and its share; ties go to the first in the fixed order."""
    counts = work(t).groupBy("person_id", "kind").agg(F.count(F.lit(1)).alias("n"))
    place = F.array_position(F.array(*map(F.lit, WORK)), F.col("kind"))
    return counts.groupBy("person_id").agg(F.sum("n").alias("n"), F.max_by("kind", F.struct(F.col("n"), -place)).alias("dominant"), F.max("n").alias("most")).select("person_id", "n", "dominant", rounded(ratio(F.col("most"), F.col("n"))).alias("value"))


@metric(
    "person.bugfix_share",
    _WORK + " select person_id, count(*) n, round(count(*) filter (kind = 'bug') / count(*)::double, 6) as value, case when count(*) filter (is_verified) / count(*)::double >= 0.7 then 'real' else 'proxy' end data_source from wk group by 1",
    trust="hybrid",
    unit="ratio",
)
def bugfix_share(t: Tables) -> DataFrame:
    """Bug fixes / units of work; real if the type of at least 70 % of them is known from an issue, else a proxy."""
    n = F.count(F.lit(1))
    source = F.when(ratio(F.count_if("is_verified"), n) >= 0.7, "real").otherwise("proxy")
    return work(t).groupBy("person_id").agg(n.alias("n"), rounded(ratio(F.count_if(F.col("kind") == "bug"), n)).alias("value"), source.alias("data_source"))


# The skill that a path asks for, by the first pattern that it meets.
DOMAINS = [
    ("ci_build", r"(?i)(^|/)(\.github|\.gitlab|ci|\.circleci)(/|$)|(dockerfile|makefile|\.ya?ml$)"),
    ("infra", r"(?i)(^|/)(terraform|infra|deploy|k8s|kubernetes|helm|ansible|\.tf)(/|$)|\.tf$"),
    ("auth", r"(?i)(^|/)(auth|oauth|login|session|permission|rbac|identity|jwt|token)(/|$|[._-])"),
    ("database", r"(?i)(^|/)(db|database|migration|migrations|schema|sql|repository|store|model|entity)(/|$|[._-])"),
    ("api", r"(?i)(^|/)(api|controller|handler|route|router|endpoint|graphql|resolver|grpc)(/|$|[._-])"),
    ("frontend", r"(?i)(^|/)(components?|ui|views?|pages?|styles?|css|hooks?)(/|$)|\.(tsx|jsx|vue|svelte|css|scss)$"),
    ("test", r"(?i)(^|/)(tests?|__tests__|spec|e2e)(/|$)|\.(test|spec)\."),
    ("docs", r"(?i)(^|/)docs?(/|$)|\.(md|mdx|rst)$"),
]
_DOMAIN_SQL = "case " + " ".join(f"when regexp_matches(path, '{p}') then '{n}'" for n, p in DOMAINS) + " else 'other' end"


def domain(path: Column) -> Column:
    """The skill that a path asks for: the first rule that it meets."""
    (name, pattern), *rest = DOMAINS
    out = F.when(path.rlike(pattern), name)
    for name, pattern in rest:
        out = out.when(path.rlike(pattern), name)
    return out.otherwise("other")


@metric(
    "person.skill_domain_footprint",
    f""", d as (select touched_by person_id, {_DOMAIN_SQL} d, sum(additions) w from files group by 1, 2), x as (select *, sum(w) over (partition by person_id) tot from d)
select person_id, count(*) domains, round(max(w) / max(tot)::double, 6) depth, round(case when count(*) > 1 then -sum(w / tot::double * ln(w / tot::double)) / ln(count(*)) else 0 end, 6) as value from x group by 1""",
    trust="hybrid",
)
def skill_domain_footprint(t: Tables) -> DataFrame:
    """Normalised entropy of a person's lines over domains, and the largest one's share."""
    lines = t.files.groupBy(F.col("touched_by").alias("person_id"), domain(F.col("path")).alias("d")).agg(F.sum("additions").alias("w"))
    x = lines.withColumn("tot", F.sum("w").over(W.partitionBy("person_id")))
    n = F.count(F.lit(1))
    return x.groupBy("person_id").agg(n.alias("domains"), rounded(F.max("w") / F.max("tot")).alias("depth"), rounded(F.when(n > 1, F.sum(entropy_share(F.col("w"), F.col("tot"))) / F.log(n)).otherwise(0.0)).alias("value"))


_MONTHLY_SQL = """, mo as (select author_id person_id, date_trunc('month', merged_at)::date m, median((epoch_us(merged_at) - epoch_us(created_at)) / 1e6) v from prs where merged_at is not null group by 1, 2),
la as (select *, row_number() over (partition by person_id order by m desc) r from mo), cur as (select person_id, v from la where r = 1),
mm as (select person_id, median(v) med from la where r > 1 group by 1), base as (select la.person_id, count(*) n, quantile_cont(la.v, 0.5) p50, stddev_samp(la.v) sd, median(abs(la.v - med)) mad from la join mm on la.person_id = mm.person_id where r > 1 group by 1),
z as (select cur.person_id, coalesce(n, 0) n, case when n >= 5 then (cur.v - p50) / greatest(coalesce(sd, 0), 1.4826 * mad, 1e-9) end z from cur left join base on cur.person_id = base.person_id)"""


def drifts(t: Tables) -> DataFrame:
    """(person_id, n, z): a person's latest month of median time to merge against their months before."""
    took = seconds(F.col("created_at"), F.col("merged_at"))
    months = t.prs.where("merged_at is not null").groupBy(F.col("author_id").alias("person_id"), F.trunc("merged_at", "MONTH").alias("m")).agg(F.median(took).alias("v"))
    latest = F.row_number().over(W.partitionBy("person_id").orderBy(F.desc("m")))
    ranked = months.withColumn("r", latest)
    past = ranked.where("r > 1").withColumn("med", F.median("v").over(W.partitionBy("person_id")))
    base = past.groupBy("person_id").agg(F.count(F.lit(1)).alias("n"), r7(F.col("v"), 0.5).alias("p50"), F.stddev_samp("v").alias("sd"), F.median(F.abs(F.col("v") - F.col("med"))).alias("mad"))
    joined = ranked.where("r = 1").join(base, "person_id", "left")
    z = (F.col("v") - F.col("p50")) / robust_sd(F.col("sd"), F.col("mad"))
    return joined.select("person_id", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") >= 5, z).alias("z"))


@metric("person.self_baseline_drift", _MONTHLY_SQL + " select person_id, n, round(z, 6) z, case when z is null then 'establishing' when abs(z) < 1 then 'stable' when abs(z) < 2 then 'shifting' else 'regime_change' end drift from z")
def self_baseline_drift(t: Tables) -> DataFrame:
    """z of a person's latest month against their own months before, by the robust deviation; from five months on."""
    kind = F.coalesce(bands(-F.abs(F.col("z")), [(-0.9999999999, "stable"), (-1.9999999999, "shifting")], "regime_change"), F.lit("establishing"))
    return drifts(t).select("person_id", "n", rounded(F.col("z")).alias("z"), kind.alias("drift"))


@metric(
    "person.momentum_vs_team",
    _MONTHLY_SQL + ", team as (select avg(z) tz from z) select person_id, round(-(z - tz), 6) as value, case when -(z - tz) >= 0.5 then 'ahead' when -(z - tz) <= -0.5 then 'behind' else 'with_team' end band from z, team where z is not null",
)
def momentum_vs_team(t: Tables) -> DataFrame:
    """A person's drift against the team's mean drift; less time to merge is better."""
    z = drifts(t).where("z is not null")
    team = z.agg(F.avg("z").alias("tz"))
    m = -(F.col("z") - F.col("tz"))
    return z.join(F.broadcast(team)).select("person_id", rounded(m).alias("value"), F.when(m >= 0.5, "ahead").when(m <= -0.5, "behind").otherwise("with_team").alias("band"))  # one row


CONFIDENT, HARD, HEAVY, COUPLED = 0.5, 4, 0.5, 5
# Ratings that count as substance, meaningful severities and all known ones, and substantive reviews.
GOOD_RATINGS = ("adequate", "strong")
MEANINGFUL = ("logic", "architectural", "security")
SEVERITIES = ("nit", "clarification", *MEANINGFUL)
SUBSTANTIVE = ("substantive_logic", "design_arch", "security", "test_coverage")


def _verdict_share(name: str, yes: str, among: str, doc: str, weight: str = "1", least: int = 5):
    """A metric over judgements: the weight of those that are ``yes`` / the weight of all, both SQL on their columns."""
    oracle = f""", v as (select * from verdicts where {among}) select person_id, count(*) n, round(sum(case when {yes} then {weight} else 0 end) / nullif(sum({weight}), 0)::double, 6) as value,
 case when count(*) < {least} then 'insufficient_sample' else 'ok' end data_quality from v group by 1"""

    def plan(t: Tables) -> DataFrame:
        n, w = F.count(F.lit(1)), F.expr(weight)
        share = ratio(F.sum(F.when(F.expr(yes), w).otherwise(0)), F.sum(w))
        return t.verdicts.where(among).groupBy("person_id").agg(n.alias("n"), rounded(share).alias("value"), quality(n, least).alias("data_quality"))

    plan.__doc__ = doc
    metric(name, oracle, "probabilistic", unit="ratio")(plan)


_verdict_share("person.design_bearing_ratio", "design_bearing", f"confidence >= {CONFIDENT}", "Difficulty of work judged design / difficulty of all, over verdicts of enough confidence.", weight="difficulty")
_verdict_share("person.pr_description_quality", f"rating in {GOOD_RATINGS}", "rating is not null", "Descriptions judged adequate or strong / all, unknown labels in the denominator.")
_verdict_share("person.convention_adherence", "adherence = 'follows'", "adherence is not null", "Changes judged to follow conventions / all.")
_verdict_share("pr.feedback_severity_mix_received", f"severity in {MEANINGFUL}", f"severity in {SEVERITIES}", "Comments about logic, architecture or security / comments with a known label.")
_verdict_share("person.review_depth_mentorship", f"category in {SUBSTANTIVE}", "is_review", "Substantive reviews / reviews, weighted by complexity.", weight="weight")


@metric(
    "person.pr_review_difficulty",
    f""" select person_id, count(*) n, round(median(difficulty), 6) as value, round(quantile_cont(difficulty, 0.75), 6) p75, round(count(*) filter (difficulty >= {HARD}) / count(*)::double, 6) hard_share,
 case when count(*) < 8 then 'insufficient_sample' else 'ok' end data_quality from verdicts group by 1""",
    trust="probabilistic",
    unit="band",
)
def pr_review_difficulty(t: Tables) -> DataFrame:
    """Median difficulty of changes, its upper quartile and the share of hard ones; eight are a sample."""
    d, n = F.col("difficulty"), F.count(F.lit(1))
    return t.verdicts.groupBy("person_id").agg(n.alias("n"), rounded(r7(d, 0.5)).alias("value"), rounded(r7(d, 0.75)).alias("p75"), rounded(ratio(F.count_if(d >= HARD), n)).alias("hard_share"), quality(n, 8).alias("data_quality"))


@metric(
    "person.pr_atomicity",
    """ select person_id, count(*) n, round(median(atomicity), 6) as value, round(count(*) filter (sprawling) / count(*)::double, 6) sprawling_share, case when count(*) < 8 then 'insufficient_sample' else 'ok' end data_quality from verdicts group by 1""",
    trust="hybrid",
    unit="ratio",
)
def pr_atomicity(t: Tables) -> DataFrame:
    """Median atomicity and the share of sprawling changes; eight are a sample."""
    n = F.count(F.lit(1))
    return t.verdicts.groupBy("person_id").agg(n.alias("n"), rounded(r7(F.col("atomicity"), 0.5)).alias("value"), rounded(ratio(F.count_if("sprawling"), n)).alias("sprawling_share"), quality(n, 8).alias("data_quality"))


_SCORE_SQL = "case when ai_verdict then 1.0 when not ai_verdict then 0.0 else ai_score end"


@metric(
    "person.ai_blend_rework_coupling",
    _MERGED_SQL
    + f""", x as (select author_id person_id, ({_SCORE_SQL})::double score, rework_lines from mp)
select person_id, count(*) n, round(avg(score), 6) as value, round(count(*) filter (score >= {HEAVY}) / count(*)::double, 6) assisted_share,
 case when count(*) filter (score >= {HEAVY}) >= {COUPLED} and count(*) filter (score < {HEAVY}) >= {COUPLED} then round(median(rework_lines) filter (score >= {HEAVY}) / nullif(median(rework_lines) filter (score < {HEAVY}), 0), 6) end coupling,
 case when count(*) filter (score >= {HEAVY}) >= {COUPLED} and count(*) filter (score < {HEAVY}) >= {COUPLED} then 'ok' else 'insufficient_sample' end coupling_quality from x group by 1""",
    trust="hybrid",
    unit="ratio",
)
def ai_blend_rework_coupling(t: Tables) -> DataFrame:
    """Mean assistance score of merged pull requests, a verdict overriding the score; the share assisted; and median rework of assisted / of other ones with five of each."""
    rows = merged(t).select(F.col("author_id").alias("person_id"), F.expr(_SCORE_SQL).cast("double").alias("score"), "rework_lines")
    yes, no, n = F.col("score") >= HEAVY, F.col("score") < HEAVY, F.count(F.lit(1))
    enough = (F.count_if(yes) >= COUPLED) & (F.count_if(no) >= COUPLED)
    coupling = ratio(F.median(F.when(yes, F.col("rework_lines"))), F.median(F.when(no, F.col("rework_lines"))))
    return rows.groupBy("person_id").agg(n.alias("n"), rounded(F.avg("score")).alias("value"), rounded(ratio(F.count_if(yes), n)).alias("assisted_share"), rounded(F.when(enough, coupling)).alias("coupling"), F.when(enough, "ok").otherwise("insufficient_sample").alias("coupling_quality"))


@metric(
    "person.cohort_baseline",
    _MERGED_SQL
    + """, v as (select author_id person_id, median((epoch_us(merged_at) - epoch_us(created_at)) / 1e6) v from mp group by 1), m as (select median(v) med, count(*) n, stddev_samp(v) sd from v), d as (select median(abs(v - med)) mad from v, m)
select person_id, round(-(v - med) / greatest(coalesce(sd, 0), 1.4826 * mad, 1e-9), 6) z, case when abs((v - med) / greatest(coalesce(sd, 0), 1.4826 * mad, 1e-9)) >= 2 then 'outlier' when abs((v - med) / greatest(coalesce(sd, 0), 1.4826 * mad, 1e-9)) >= 1 then 'notable' else 'typical' end band from v, m, d where n >= 8""",
)
def cohort_baseline(t: Tables) -> DataFrame:
    """A person's median time to merge against everyone's, in robust deviations, less being better; from eight people on."""
    v = merged(t).groupBy(F.col("author_id").alias("person_id")).agg(F.median(seconds(F.col("created_at"), F.col("merged_at"))).alias("v"))
    m = v.agg(F.median("v").alias("med"), F.count(F.lit(1)).alias("n"), F.stddev_samp("v").alias("sd"))
    with_m = v.join(F.broadcast(m))  # one row
    mad = with_m.agg(F.median(F.abs(F.col("v") - F.col("med"))).alias("mad"))
    z = (F.col("v") - F.col("med")) / robust_sd(F.col("sd"), F.col("mad"))
    return with_m.join(F.broadcast(mad)).where("n >= 8").select("person_id", rounded(-z).alias("z"), bands(F.abs(z), [(2.0, "outlier"), (1.0, "notable")], "typical").alias("band"))  # one row
