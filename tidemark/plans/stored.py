"""What a store of deliveries is read for: keys, windows, versions, memberships, baselines, snapshots, what is due."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.units import SECONDS, formatted
from tidemark.operators import flowstate, retention
from tidemark.operators.history import as_of, effective, latest
from tidemark.plans.catalog import metric
from tidemark.plans.reports import _BASE, _SNAP, baselines, snapshots
from tidemark.tables import AS_OF, FROM, ISSUES_FROM, ISSUES_TO, TO, Tables

#: Minutes that an incremental read goes back behind the watermark.
OVERLAP_MINUTES = 10
KEYS = (1, 7, 32, 64, 65, 1000)


@metric("store.by_key", f" select id, repo_id, state from prs where id in {KEYS}")
def by_key(t: Tables) -> DataFrame:
    """Pull requests by a list of keys: the condition reaches the scan."""
    return t.by_key("prs", "id", list(KEYS)).select("id", "repo_id", "state")


_SLICES = {
    "prs": f"created_at >= timestamp '{FROM}' and created_at < timestamp '{TO}' + interval 1 day or merged_at >= timestamp '{FROM}' and merged_at < timestamp '{TO}' + interval 1 day or (state = 'open' and created_at < timestamp '{TO}' + interval 1 day)",
    "reviews": f"submitted_at >= timestamp '{FROM}' and submitted_at < timestamp '{TO}' + interval 1 day",
    "deploys": f"created_at >= timestamp '{FROM}' and created_at < timestamp '{TO}' + interval 1 day",
    "checks": f"started_at >= timestamp '{FROM}' and started_at < timestamp '{TO}' + interval 1 day",
    "transitions": f"moved_at >= timestamp '{ISSUES_FROM}' and moved_at < timestamp '{ISSUES_TO}' + interval 1 day",
    "incidents": f"created_at >= timestamp '{ISSUES_FROM}' and created_at < timestamp '{ISSUES_TO}' + interval 1 day",
}


def window_slices(t: Tables) -> dict[str, DataFrame]:
    """The rows of each entity that the window touches."""
    touched = t.within("created_at") | t.within("merged_at") | ((F.col("state") == "open") & (F.col("created_at") < F.expr(f"timestamp '{t.window.last}' + interval 1 day")))
    return {
        "prs": t.prs.where(touched),
        "reviews": t.reviews.where(t.within("submitted_at")),
        "deploys": t.deploys.where(t.within("created_at")),
        "checks": t.checks.where(t.within("started_at")),
        "transitions": t.transitions.where(t.issues_within("moved_at")),
        "incidents": t.incidents.where(t.issues_within("created_at")),
    }


@metric("store.window_slice", " " + " union all ".join(f"select '{n}' entity, count(*) n from {n} where {c}" for n, c in _SLICES.items()))
def window_slice(t: Tables) -> DataFrame:
    """Rows of every entity that the window touches."""
    out = None
    for name, df in window_slices(t).items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("entity"), "n")
        out = row if out is None else out.union(row)
    return out


@metric("store.overlap_reread", f", w as (select repo_id, max(updated_at) as mark from prs where created_at < timestamp '{TO}' group by 1) select prs.repo_id, count(*) n from prs join w using (repo_id) where updated_at >= mark - interval {OVERLAP_MINUTES} minute group by 1")
def overlap_reread(t: Tables) -> DataFrame:
    """Pull requests that a sync reads again: those updated since ten minutes before their repository's watermark."""
    marks = t.prs.where(F.col("created_at") < F.lit(t.window.last).cast("timestamp")).groupBy("repo_id").agg(F.max("updated_at").alias("mark"))
    rows = t.prs.select("repo_id", "updated_at").join(marks, "repo_id").where(F.expr(f"updated_at >= mark - interval {OVERLAP_MINUTES} minutes"))
    return rows.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"))


_STATUS_NAMES = ("To Do", "In Progress", "Code Review", "Waiting for Customer", "QA queue", "QA", "On Hold", "Selected for Dev", "Testing", "Deployed", "Ready for Release", "Blocked", "Triage", "Analysis", "Development", "UAT")
_LIST = "(" + ", ".join(f"'{n}'" for n in _STATUS_NAMES) + ")"
_STATUSES = f""", st as (select p_partkey status_id, (p_partkey % 5)::int workflow_id, [{', '.join(repr(n) for n in _STATUS_NAMES)}][(p_partkey % {len(_STATUS_NAMES)})::int + 1] "name",
 case p_size % 6 when 0 then 'new' when 1 then 'done' when 2 then null else 'indeterminate' end category, case p_partkey % 7 when 0 then 'done' when 1 then 'queue' when 2 then 'started' end board from part),
cl as (select *, coalesce(category in ('new', 'done'), false) told, regexp_matches("name", '{flowstate.WAIT}') waits, regexp_matches("name", '{flowstate.WAIT}') or regexp_matches("name", '{flowstate.ACTIVE}') known from st),
cs as (select *, case when told then category when not known or waits then 'wait' else 'active' end plain, case when told then 0.95 when known then 0.8 else 0.45 end sure from cl)"""


def statuses(t: Tables) -> DataFrame:
    """(workflow_id, status_id, name, category, board) of every status."""
    names = F.array(*map(F.lit, _STATUS_NAMES))
    return t.raw("part").select(
        (F.col("p_partkey") % 5).cast("int").alias("workflow_id"),
        F.col("p_partkey").alias("status_id"),
        F.get(names, (F.col("p_partkey") % len(_STATUS_NAMES)).cast("int")).alias("name"),
        F.expr("case p_size % 6 when 0 then 'new' when 1 then 'done' when 2 then null else 'indeterminate' end").alias("category"),
        F.expr("case p_partkey % 7 when 0 then 'done' when 1 then 'queue' when 2 then 'started' end").alias("board"),
    )


@metric(
    "flowstate.seed",
    _STATUSES
    + """ select workflow_id, status_id, case when not told and board = 'done' then 'done' when board = 'queue' and plain = 'active' then 'wait' when not told and board = 'started' and plain = 'wait' and sure <= 0.5 then 'active' else plain end state,
 (case when not told and (board = 'done' or (board = 'started' and plain = 'wait' and sure <= 0.5)) then 0.75 when board = 'queue' and plain = 'active' then 0.7 else sure end)::double confidence from cs""",
)
def seed(t: Tables) -> DataFrame:
    """The flow state that a status's category, its name and its board column suggest, and how surely."""
    state, sure = flowstate.classify(F.col("category"), F.col("name"), F.col("board"))
    return statuses(t).select("workflow_id", "status_id", state.alias("state"), sure.alias("confidence"))


@metric(
    "flowstate.fallback",
    _STATUSES
    + """, m as (select workflow_id, status_id, plain, sure::double sure, case when status_id % 11 = 3 then 'lead' end who from cs where status_id % 3 <> 0 union all select workflow_id, status_id, plain, least(sure, 0.45)::double, null from cs where status_id % 3 = 0),
o as (select *, status_id % 13 = 4 as over_ from m)
select case when over_ then 'active' else plain end flow_state, case when over_ then 'boss' else coalesce(who, case when status_id % 10 = 1 then 'lead' end) end confirmed_by, count(*) n, round(avg(case when over_ then 1.0 else sure end), 6) confidence from o group by 1, 2""",
)
def model(t: Tables) -> DataFrame:
    """Open rows of the model after fallbacks for statuses without one, confirmations and overrides, by state and who confirmed."""
    at = F.lit("2024-01-01").cast("timestamp")
    none = F.lit(None)
    every = statuses(t)
    state, sure = flowstate.classify(F.col("category"), F.col("name"), none.cast("string"))
    by = F.when(F.col("status_id") % 11 == 3, "lead")
    first = every.where("status_id % 3 <> 0").select(*flowstate.KEY, state.alias("flow_state"), sure.alias("confidence"), by.alias("confirmed_by"), none.cast("timestamp").alias("confirmed_at"), at.alias("valid_from"), none.cast("timestamp").alias("valid_to"))
    whole = flowstate.fallback(first, every, at)
    said = every.where("status_id % 10 = 1").select(*flowstate.KEY, F.lit("lead").alias("confirmed_by"), at.alias("confirmed_at"))
    changed = every.where("status_id % 13 = 4").select(*flowstate.KEY, F.lit("active").alias("flow_state"), F.lit("boss").alias("confirmed_by"), F.lit("2024-02-01").cast("timestamp").alias("valid_from"))
    now = flowstate.override(flowstate.confirm(whole, said), changed).where("valid_to is null")
    return now.groupBy("flow_state", "confirmed_by").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))


@metric("store.status_categories", _STATUSES + ", v as (select *, case when status_id % 4 = 0 then 'done' else category end now_ from st) select coalesce(now_, 'none') category, count(*) n from v group by 1")
def status_categories(t: Tables) -> DataFrame:
    """Statuses by their current category: the open version of each."""
    first = statuses(t).select("status_id", "category", F.lit("2020-01-01").cast("timestamp").alias("valid_from"))
    moved = first.where("status_id % 4 = 0").withColumns({"category": F.lit("done"), "valid_from": F.lit("2023-01-01").cast("timestamp")})
    now = effective(first.unionByName(moved), ["status_id"], "valid_from").where("valid_to is null")
    return now.groupBy(F.coalesce("category", F.lit("none")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@metric(
    "team.members",
    """with m as (select (c_nationkey)::int team_id, c_custkey person_id, timestamp '1996-01-01' + to_days((c_custkey % 900)::int) valid_from, case when c_custkey % 4 = 0 then timestamp '1996-01-01' + to_days((c_custkey % 900 + 200)::int) end valid_to from customer
 union all select ((c_nationkey + 1) % 25)::int, c_custkey, timestamp '1996-01-01' + to_days((c_custkey % 900 + 200)::int), null from customer where c_custkey % 4 = 0)
select team_id, count(*) members from m where valid_from <= timestamp '1998-01-01' and (valid_to is null or valid_to > timestamp '1998-01-01') group by 1""",
    prelude=False,
)
def members(t: Tables) -> DataFrame:
    """Members of each team as of a day; a person who moves belongs to one team at a time."""
    day = lambda n: F.expr(f"timestampadd(DAY, cast({n} as int), timestamp '1996-01-01')")
    people = t.raw("customer").select(F.col("c_nationkey").cast("int").alias("team_id"), F.col("c_custkey").alias("person_id"))
    first = people.withColumns({"valid_from": day("person_id % 900"), "valid_to": F.when(F.col("person_id") % 4 == 0, day("person_id % 900 + 200"))})
    moved = people.where("person_id % 4 = 0").withColumns({"team_id": ((F.col("team_id") + 1) % 25).cast("int"), "valid_from": day("person_id % 900 + 200"), "valid_to": F.lit(None).cast("timestamp")})
    held = as_of(first.unionByName(moved), ["team_id", "person_id"], F.lit("1998-01-01").cast("timestamp"))
    return held.groupBy("team_id").agg(F.count(F.lit(1)).alias("members"))


@metric("report.latest_baseline", _BASE + ", v as (select repo_id, unnest([1, 2, 3]) as version, p50 from b), s as (select *, repo_id % 3 + 1 < version as superseded from v) select repo_id, max(version) as version, round(arg_max(p50 * version, version), 4) p50 from s where not superseded group by 1")
def latest_baseline(t: Tables) -> DataFrame:
    """The newest baseline of each repository that none has superseded."""
    base, _ = baselines(t)
    stored = base.select("repo_id", "p50", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("version")).withColumn("superseded", F.col("repo_id") % 3 + 1 < F.col("version"))
    held = latest(stored.where("not superseded"), ["repo_id"], ["version"])
    return held.select("repo_id", "version", F.round(F.col("p50") * F.col("version"), 4).alias("p50"))


@metric("report.latest_snapshot", _SNAP + """, v as (select "day", case when day("day") % 3 = 0 then null else n end n from snap) select max("day") "day", arg_max(n, "day") n from v where n is not null""")
def latest_snapshot(t: Tables) -> DataFrame:
    """The last day whose snapshot has a value, and the value; days without one are passed over."""
    rows = snapshots(t).withColumn("n", F.when(F.dayofmonth("day") % 3 != 0, F.col("n"))).where("n is not null")
    return rows.agg(F.max("day").alias("day"), F.max_by("n", "day").alias("n"))


@metric(
    "verdict.pending",
    f""", j as (select id from verdicts where confidence >= 0.5), p as (select id, author_id, row_number() over (partition by author_id order by created_at desc, id) i from prs
 where state = 'merged' and created_at >= timestamp '{FROM}' and id not in (select id from j)) select author_id person_id, id pr_id, i::int place from p where i <= 25""",
)
def pending_verdicts(t: Tables) -> DataFrame:
    """Each person's newest 25 merged pull requests, of those opened since the window began, that nothing was judged of."""
    rows = t.prs.where("state = 'merged'").where(F.col("created_at") >= F.lit(t.window.first).cast("timestamp"))
    due = rows.join(t.verdicts.where("confidence >= 0.5").select(F.col("id").alias("judged")), F.col("id") == F.col("judged"), "left_anti")
    at = W.partitionBy("author_id").orderBy(F.desc("created_at"), "id")
    return due.withColumn("place", F.row_number().over(at)).where("place <= 25").select(F.col("author_id").alias("person_id"), F.col("id").alias("pr_id"), "place")


@metric("verdict.record", ", o as (select id, person_id, rating, 0 f from verdicts), n as (select id, person_id, 'strong' rating, 1 f from verdicts where id % 5 = 0), b as (select * from o union all select * from n) select rating, count(*) n from (select *, row_number() over (partition by id order by f desc) r from b) where r = 1 group by 1")
def record_verdicts(t: Tables) -> DataFrame:
    """Verdicts after new ones on some of their subjects replaced the old, by rating."""
    old = t.verdicts.select("id", "person_id", "rating", F.lit(0).alias("version"))
    new = old.where("id % 5 = 0").withColumns({"rating": F.lit("strong"), "version": F.lit(1)})
    return latest(old.unionByName(new), ["id"], ["version"]).groupBy("rating").agg(F.count(F.lit(1)).alias("n"))


# Files that tell of a coding assistant, by assistant, and accounts of coding agents.
MARKERS = {
    "claude": ("CLAUDE.md", ".claude"),
    "agents": ("AGENTS.md",),
    "gemini": ("GEMINI.md", ".gemini"),
    "cursor": (".cursorrules", ".cursor"),
    "copilot": (".github/copilot-instructions.md",),
    "windsurf": (".windsurfrules",),
    "aider": (".aider.conf.yml",),
    "continue": (".continue",),
    "codeium": (".codeium",),
    "cline": (".clinerules",),
    "codex": (".codex", "codex.md"),
}
_MARKER_ROWS = [(name, path, i) for name, paths in MARKERS.items() for i, path in enumerate(paths)]
_MARKER_SQL = ", ".join(f"('{n}', '{p}', {i})" for n, p, i in _MARKER_ROWS)


@metric(
    "repo.assistant_signals",
    f"""with mk as (select * from (values {_MARKER_SQL}) v("name", "path", i)), ix as (select *, row_number() over (order by "name", i) - 1 k from mk),
rp as (select distinct s_nationkey repo_id from supplier), there as (select distinct s_nationkey repo_id, "path" from supplier join ix on s_suppkey % 17 = k)
select repo_id, concat('config:', "name") signal, count(th.p) > 0 present, arg_min(th.p, i) filter (th.p is not null) detail from rp cross join mk left join (select repo_id r, "path" p from there) th on th.r = repo_id and th.p = "path" group by 1, 2""",
    prelude=False,
)
def assistant_signals(t: Tables) -> DataFrame:
    """For each repository and coding assistant whether one of its files is there, and the first that is."""
    rows = sorted(_MARKER_ROWS, key=lambda r: (r[0], r[2]))
    markers = F.broadcast(t.spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "name string, path string, i int, k long"))  # a row a file
    supplier = t.raw("supplier").select(F.col("s_nationkey").alias("repo_id"), (F.col("s_suppkey") % 17).alias("k"))
    there = supplier.join(markers, "k").select("repo_id", "path", F.lit(True).alias("there")).distinct()
    asked = supplier.select("repo_id").distinct().select("repo_id", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).alias("path"), F.lit(i).alias("i")) for n, p, i in _MARKER_ROWS])).alias("m")).select("repo_id", "m.*")
    found = asked.join(there, ["repo_id", "path"], "left")
    hit = F.col("there").isNotNull()
    return found.groupBy("repo_id", F.concat(F.lit("config:"), "name").alias("signal")).agg(F.bool_or(hit).alias("present"), F.min_by(F.when(hit, F.col("path")), F.when(hit, F.col("i"))).alias("detail"))


_UNIT_SQL = "case l_linenumber when 1 then '%' when 2 then 'hours' when 3 then 'days' when 4 then 'count' when 5 then 'minutes' when 6 then 'points' else 'weeks' end"


@metric(
    "report.units",
    f"""with x as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, {_UNIT_SQL} unit, case when l_linenumber = 1 then l_discount when l_partkey % 10 = 0 then null else l_extendedprice end v from lineitem),
d as (select *, case unit when '%' then v * 100 when 'hours' then v / 3600 when 'days' then v / 86400 when 'minutes' then v / 60 when 'weeks' then v / 604800 else v end s from x),
f as (select *, case when v is null then '—' else concat(case when s = floor(s) or abs(s) >= 100 then printf('%.0f', round(s::double)) else regexp_replace(printf('%.2f', round(s::double, 2)), '\\.?0+$', '') end, case unit when '%' then '%' when 'count' then '' else concat(' ', unit) end) end shown from d)
select unit, count(*) n, count(distinct shown) shown, min(length(shown)) shortest, max(length(shown)) longest from f group by 1""",
    prelude=False,
)
def units(t: Tables) -> DataFrame:
    """Values as reports show them: percent, durations in their unit, two decimals at most."""
    assert {"hours", "days", "minutes", "weeks"} <= set(SECONDS)
    value = F.when(F.col("l_linenumber") == 1, F.col("l_discount")).when(F.col("l_partkey") % 10 != 0, F.col("l_extendedprice"))
    rows = t.raw("lineitem").select(F.expr(_UNIT_SQL).alias("unit"), value.alias("v"))
    shown = formatted(F.col("v"), F.col("unit"))
    return rows.select("unit", shown.alias("shown")).groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("shown").alias("shown"), F.min(F.length("shown")).alias("shortest"), F.max(F.length("shown")).alias("longest"))


@metric("serve.status", f""" select 'prs' entity, count(*) n, max(updated_at)::date newest from prs union all select 'deploys', count(*), max(created_at)::date from deploys union all select 'transitions', count(*), max(moved_at)::date from transitions where moved_at <= timestamp '{AS_OF}'""")
def status(t: Tables) -> DataFrame:
    """Rows of the main entities and their newest day: what a status call tells."""
    row = lambda name, df, at: df.agg(F.count(F.lit(1)).alias("n"), F.to_date(F.max(at)).alias("newest")).select(F.lit(name).alias("entity"), "n", "newest")
    return row("prs", t.prs, "updated_at").union(row("deploys", t.deploys, "created_at")).union(row("transitions", t.transitions.where(f"moved_at <= {t.now}"), "moved_at"))


KEEP_DAYS, KEEP_TEXTS_DAYS = 365, 180
#: How customers, their orders and those orders' lines age: texts first, then rows, then who has none left.
RETENTION = {
    "nation": retention.Rule(),
    "customer": retention.Rule(parents={"nation": {"c_nationkey": "n_nationkey"}}, needs=("orders",)),
    "orders": retention.Rule(time="o_orderdate", parents={"customer": {"o_custkey": "c_custkey"}}, texts=("o_orderpriority",)),
    "lineitem": retention.Rule(parents={"orders": {"l_orderkey": "o_orderkey"}}, texts=("l_returnflag",), texts_time="l_shipdate"),
}


@metric(
    "store.retention",
    f"""with o as (select * from orders where o_orderdate >= timestamp '{TO}' - interval {KEEP_DAYS} day and o_custkey in (select c_custkey from customer join nation on c_nationkey = n_nationkey)), l as (select * from lineitem where l_orderkey in (select o_orderkey from o)),
c as (select * from customer where c_nationkey in (select n_nationkey from nation) and (c_custkey in (select o_custkey from o) or c_custkey not in (select o_custkey from orders)))
select 'nation' "table", (select count(*) from nation) before, (select count(*) from nation) as after, 0 texts union all select 'customer', (select count(*) from customer), (select count(*) from c), 0
 union all select 'orders', (select count(*) from orders), (select count(*) from o), (select count(*) from o where o_orderdate < timestamp '{TO}' - interval {KEEP_TEXTS_DAYS} day)
 union all select 'lineitem', (select count(*) from lineitem), (select count(*) from l), (select count(*) from l where l_shipdate < timestamp '{TO}' - interval {KEEP_TEXTS_DAYS} day)""",
    prelude=False,
)
def retention_run(t: Tables) -> DataFrame:
    """What a year's retention leaves of customers, orders and lines, and how many texts of over half a year it empties."""
    tables = {name: t.raw(name) for name in RETENTION}
    ago = lambda days: F.date_sub(F.lit(t.window.last).cast("date"), days).cast("timestamp")
    return retention.counts(tables, retention.retained(tables, RETENTION, ago(KEEP_DAYS), ago(KEEP_TEXTS_DAYS)), RETENTION)
