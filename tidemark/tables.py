"""The delivery entities, projected from the driver's tables.

An order is a pull request of the repository of its customer's nation; its lines are reviews, changed
files, check runs and deployments; an event is the transition of an issue (its user) to a status (its
type).  Each view is a plan over one scan: columns a metric doesn't use are never read.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

STARTED, DONE = ("view", "click"), ("purchase",)


@dataclass(frozen=True)
class Window:
    """The days a metric is asked for, both ends included, and the instant it is asked at.

    The tables' pull requests and issues lie in different years, so each has days of its own;
    ``Window.of`` asks both for the same.
    """

    first: str = "1996-01-01"
    last: str = "1998-12-31"
    issues_first: str = "2024-01-08"
    issues_last: str = "2024-01-28"
    as_of: str = "2024-01-29"

    @classmethod
    def of(cls, first: str, last: str, as_of: str | None = None) -> Window:
        after = (dt.date.fromisoformat(last) + dt.timedelta(1)).isoformat()
        return cls(first, last, first, last, as_of or after)

    @property
    def days(self) -> int:
        return _days(self.first, self.last)

    @property
    def issue_days(self) -> int:
        return _days(self.issues_first, self.issues_last)


def _days(first: str, last: str) -> int:
    n = (dt.date.fromisoformat(last) - dt.date.fromisoformat(first)).days + 1
    if n < 1:
        raise ValueError("a window ends no earlier than it begins")
    return n


@dataclass(frozen=True)
class Scope:
    """Whom a metric is asked for: teams by repository, people as authors; none given means everyone.

    An issue belongs to the team ``issue_id % TEAMS`` and to the person of its id.
    """

    repos: tuple[int, ...] | None = None
    people: tuple[int, ...] | None = None

    def allows(self, repo: str, person: str | None = None) -> str:
        """The condition, in SQL that Spark and DuckDB share, on a repository's and a person's column."""
        parts = [f"{c} in ({', '.join(str(int(x)) for x in own)})" if own else "false" for c, own in ((repo, self.repos), (person, self.people)) if c and own is not None]
        return " and ".join(parts) or "true"


TEAMS = 25
EVERYONE, USUAL = Scope(), Window()
#: What stands for the window in an oracle's SQL; ``said`` puts the days there.
FROM, TO, DAYS = "@first", "@last", "@days"
ISSUES_FROM, ISSUES_TO, AS_OF, ISSUE_DAYS = "@issues_first", "@issues_last", "@as_of", "@issue_days"


def said(sql: str, window: Window = USUAL, scope: Scope = EVERYONE) -> str:
    """An oracle's SQL for a window and a scope."""
    every = {FROM: window.first, TO: window.last, DAYS: window.days, ISSUES_FROM: window.issues_first, ISSUES_TO: window.issues_last, AS_OF: window.as_of, ISSUE_DAYS: window.issue_days}
    every |= {"@prs": scope.allows("c_nationkey", "(case when o_orderkey % 30 = 1 then 1 else o_custkey end)"), "@deploys": scope.allows("s_nationkey"), "@issues": scope.allows(f"user_id % {TEAMS}", "user_id"), "@lines": "true" if scope == EVERYONE else "l_orderkey in (select id from prs)"}
    for mark in sorted(every, key=len, reverse=True):
        sql = sql.replace(mark, str(every[mark]))
    return sql


def between(column: str, first: str, last: str) -> Column:
    """Both days included: half-open on instants, so it reaches the scan."""
    return (F.col(column) >= F.lit(first).cast("timestamp")) & (F.col(column) < F.date_add(F.lit(last).cast("date"), 1).cast("timestamp"))


class Tables:
    """The entities of one folder for one window and scope.  The scope is applied where rows are read."""

    def __init__(self, spark: SparkSession, folder: str, window: Window = USUAL, scope: Scope = EVERYONE):
        self.spark, self.folder, self.window, self.scope = spark, folder, window, scope

    def within(self, column: str) -> Column:
        return between(column, self.window.first, self.window.last)

    def issues_within(self, column: str) -> Column:
        return between(column, self.window.issues_first, self.window.issues_last)

    @property
    def now(self) -> str:
        return f"timestamp '{self.window.as_of}'"

    def by_key(self, entity: str, key: str, values: list) -> DataFrame:
        """The rows of an entity whose key is one of a list: the condition reaches the scan."""
        return getattr(self, entity).where(F.col(key).isin(*values))

    def raw(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return df.select(*[F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in df.dtypes])

    @cached_property
    def lineitem(self) -> DataFrame:
        """Line items of the pull requests in scope."""
        rows = self.raw("lineitem")
        return rows if self.scope == EVERYONE else rows.join(self._orders.select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")

    @cached_property
    def events(self) -> DataFrame:
        """Events of the issues in scope."""
        return self.raw("events").where(self.scope.allows(f"user_id % {TEAMS}", "user_id"))

    @cached_property
    def _orders(self) -> DataFrame:
        rows = self.raw("orders").join(self.raw("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        return rows.selectExpr("*", f"{_AUTHOR} as author_id").where(self.scope.allows("c_nationkey", "author_id"))

    @cached_property
    def prs(self) -> DataFrame:
        span = self.raw("lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"))
        orders = self._orders.join(span, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        later = lambda hours: f"timestampadd(HOUR, cast({hours} as int), o_orderdate)"
        return orders.selectExpr(
            "o_orderkey as id",
            "c_nationkey as repo_id",
            "author_id",
            "case o_orderstatus when 'F' then 'merged' when 'O' then 'open' else 'closed' end as state",
            "o_orderkey % 17 = 0 as is_draft",
            f"case when {_SPLIT} then timestampadd(HOUR, cast(o_orderkey % 20 as int), date_trunc('YEAR', o_orderdate)) else o_orderdate end as created_at",
            f"case when o_orderkey % 3 <> 0 then {later('o_orderkey % 5')} end as ready_at",
            f"case when o_orderkey % 11 <> 0 then {later('-(o_orderkey % 72)')} end as first_commit_at",
            "first_ship as first_review_at",
            f"case when o_orderstatus = 'F' then {later('24 + o_orderkey % 240')} end as merged_at",
            "case when o_orderkey % 10 = 0 then o_custkey else o_orderkey % 100 + 1 end as merged_by",
            "greatest(o_orderdate, last_ship) as updated_at",
            "o_orderpriority as priority",
            f"case when o_orderstatus = 'F' then case when o_orderkey % 6 = 0 then {later('o_orderkey % 9')} else {later('-(o_orderkey % 72)')} end end as merge_commit_at",
            "cast(o_orderkey % 100 as double) / 100 as ai_score",
            "case when o_orderkey % 20 = 3 then false when o_orderkey % 20 = 7 then true end as ai_verdict",
            "o_orderkey % 13 + 1 as rework_lines",
        )

    @cached_property
    def links(self) -> DataFrame:
        """(pr_id, issue_id, confidence): three of four pull requests name an issue, some two."""
        first = self.prs.where("id % 4 <> 0").selectExpr("id as pr_id", "author_id % 15 as issue_id", "case id % 3 when 0 then 0.98D when 1 then 0.85D else 0.75D end as confidence")
        second = self.prs.where("id % 8 = 1").selectExpr("id as pr_id", "(author_id + 7) % 15 as issue_id", "0.5D as confidence")
        return first.unionByName(second)

    @cached_property
    def reviews(self) -> DataFrame:
        return self.lineitem.selectExpr(
            "l_orderkey as pr_id",
            "l_linenumber as n",
            "l_suppkey as reviewer_id",
            "case l_returnflag when 'A' then 'approved' when 'R' then 'changes_requested' else 'commented' end as state",
            "l_shipdate as submitted_at",
        )

    @cached_property
    def bots(self) -> DataFrame:
        """Suppliers that are automation accounts."""
        return self.raw("supplier").where("s_suppkey % 25 = 0").select(F.col("s_suppkey").alias("bot_id"))

    @cached_property
    def files(self) -> DataFrame:
        path = """case l_linenumber % 7 when 1 then concat('src/', lower(replace(p_brand, '#', '')), '/main.py') when 2 then concat('src/', lower(replace(p_type, ' ', '/')), '.js')
                  when 3 then concat('tests/test_', l_suppkey % 20, '.py') when 4 then concat('docs/', lower(replace(p_type, ' ', '-')), '.md') when 5 then 'package.json'
                  when 6 then concat('dist/', l_suppkey % 9, '.min.js') else concat('infra/deploy/', l_suppkey % 5, '.yml') end"""
        part = self.raw("part").select("p_partkey", "p_brand", "p_type", "p_size")
        return self.lineitem.join(part, F.col("l_partkey") == F.col("p_partkey")).selectExpr(
            "l_orderkey as pr_id",
            "l_linenumber as n",
            f"{path} as path",
            "cast(l_quantity as bigint) as additions",
            "cast(round(l_discount * 100) as bigint) as deletions",
            "case when l_orderkey % 30 = 1 then 1L when l_linenumber % 4 <> 0 then cast(l_quantity as bigint) end as haloc",
            "l_linenumber % 7 = 6 as is_generated",
            "p_size as complexity",
            "case when l_linenumber <> 5 then l_suppkey % 50 end as base_complexity",
            "l_suppkey as touched_by",
        )

    @cached_property
    def functions(self) -> DataFrame:
        """(pr_id, path, side, name, cyclomatic): the functions of each changed file at base and head.

        A file is dealt out before its functions are listed: one row a file moves, and what groups by file and
        function stays where it is.
        """
        one = "named_struct('side', '{}', 'name', '{}', 'cyclomatic', cast({} as int))"
        own = [one.format(*x) for x in FUNCTIONS]
        path = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)"
        files = self.lineitem.selectExpr("l_orderkey as pr_id", f"{path} as path", "l_quantity", "l_linenumber", "l_suppkey", "l_partkey").repartition("pr_id", "path")
        return files.selectExpr("pr_id", "path", f"inline(array({', '.join(own)}))")

    @cached_property
    def deploys(self) -> DataFrame:
        nations = self.raw("supplier").select("s_suppkey", "s_nationkey")
        return self.raw("lineitem").where("l_linenumber <= 3").join(nations, F.col("l_suppkey") == F.col("s_suppkey")).where(self.scope.allows("s_nationkey")).selectExpr(
            "l_orderkey * 10 + l_linenumber as id",
            "s_nationkey as repo_id",
            "case l_linenumber when 1 then 'production' when 2 then 'prod-eu' else 'staging' end as environment",
            "case when l_linestatus = 'F' then 'success' when l_partkey % 2 = 0 then 'failure' else 'error' end as status",
            "l_shipdate as created_at",
            "timestampadd(MINUTE, l_linenumber * 10, l_shipdate) as finished_at",
            "case when l_partkey % 50 = 0 then 'merge_proxy' else 'api' end as source",
            "case when l_partkey % 9 = 0 then timestampadd(HOUR, 5, l_shipdate) end as reverted_at",
        )

    @cached_property
    def checks(self) -> DataFrame:
        return self.lineitem.selectExpr(
            "l_orderkey as pr_id",
            "l_partkey as head_sha",
            "l_suppkey % 10 as name",
            "case l_returnflag when 'A' then 'success' when 'R' then 'failure' end as conclusion",
            "l_shipdate as started_at",
            "case when l_returnflag <> 'N' then timestampadd(SECOND, cast(l_quantity as int) * 60, l_shipdate) end as completed_at",
        )

    @cached_property
    def transitions(self) -> DataFrame:
        """issue_id, n (order within the issue), from_status, to_status, moved_at."""
        at = W.partitionBy("user_id").orderBy("ts", "event_id")
        return self.events.select(
            F.col("user_id").alias("issue_id"),
            F.col("event_id").alias("n"),
            F.lag("event_type").over(at).alias("from_status"),
            F.col("event_type").alias("to_status"),
            F.col("ts").alias("moved_at"),
        )

    @cached_property
    def issues(self) -> DataFrame:
        """issue_id, created_at, type, priority, points, resolution, status: first event on, status as it is."""
        last = F.struct("ts", "event_id")
        return self.events.groupBy(F.col("user_id").alias("issue_id")).agg(F.min("ts").alias("created_at"), F.max_by("event_type", last).alias("status"), F.max("ts").alias("updated_at"), F.min(F.when(F.col("event_type").isin(*DONE), F.col("ts"))).alias("resolved_at"), F.count(F.lit(1)).alias("n_events")).selectExpr(
            "issue_id",
            "created_at",
            "updated_at",
            "resolved_at",
            "status",
            "case issue_id % 5 when 0 then 'Bug' when 1 then 'Story' when 2 then 'Tech Debt' when 3 then 'Feature' else 'Chore' end as type",
            "case when issue_id % 4 = 0 then null else concat('P', issue_id % 3) end as priority",
            "case when issue_id % 3 = 0 then null else cast(issue_id % 8 as double) end as points",
            "issue_id % 7 = 6 as was_reopened",
            "case when issue_id % 4 = 3 then issue_id - 1 end as parent_id",
            "case when issue_id % 4 = 3 then 2 when issue_id % 9 = 0 then 0 else 1 end as level",
            "case when status = 'purchase' then case when issue_id % 2 = 0 then 'Fixed' else 'Duplicate' end end as resolution",
        )

    @cached_property
    def flow_states(self) -> DataFrame:
        """(status, flow_state, valid_from, valid_to): what each status means, and since when; two change within January 2024."""
        kinds = self.raw("events").select(F.col("event_type").alias("status")).distinct()
        return kinds.selectExpr("status", f"inline({_STATES})")

    @cached_property
    def verdicts(self) -> DataFrame:
        """A judgement of a person's change (``is_review``: of a review they gave) in columns, one an event."""
        listed = lambda names: f"element_at(array({', '.join(repr(n) for n in names)}), k % {len(names)} + 1)"
        rows = self.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("person_id"), (F.col("event_type") != "signup").alias("is_review"), F.from_json("props", "k int")["k"].alias("k")).where("k is not null")
        return rows.selectExpr(
            "id",
            "person_id",
            "is_review",
            "k % 3 = 0 as design_bearing",
            "k % 5 + 1 as difficulty",
            "k % 10 / 10D as confidence",
            "(9 - k % 10) / 10D + 0.1D as atomicity",
            "k % 10 >= 7 as sprawling",
            "k % 7 + 1 as weight",
            *(f"{listed(names)} as {column}" for column, names in LABELS.items()),
        )

    @cached_property
    def incidents(self) -> DataFrame:
        """An error event is an incident, resolved by its user's next event that is no error."""
        at = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(1, W.unboundedFollowing)
        return self.events.withColumn("resolved_at", F.first(F.when(F.col("event_type") != "error", F.col("ts")), ignorenulls=True).over(at)).where("event_type = 'error'").select(F.col("event_id").alias("id"), F.col("user_id").alias("issue_id"), F.col("ts").alias("created_at"), "resolved_at")


#: One of thirty pull requests is one author's, opened on a year's first day and tiny: work split into trifles.
_SPLIT = "o_orderkey % 30 = 1"
_AUTHOR = f"case when {_SPLIT} then 1 else o_custkey end"
_VERSION = "named_struct('flow_state', {}, 'valid_from', timestamp '{}', 'valid_to', {})"
_STATES = "case status when 'click' then array({}, {}) when 'error' then array({}, {}) else array({}) end".format(
    _VERSION.format("'active'", "2020-01-01", "timestamp '2024-01-15'"),
    _VERSION.format("'wait'", "2024-01-15", "cast(null as timestamp)"),
    _VERSION.format("'wait'", "2020-01-01", "timestamp '2024-01-20 12:00:00'"),
    _VERSION.format("'active'", "2024-01-20 12:00:00", "cast(null as timestamp)"),
    _VERSION.format("case status when 'view' then 'active' when 'purchase' then 'done' else 'new' end", "2020-01-01", "cast(null as timestamp)"),
)
#: Side, name and complexity of the functions of a line item's file.
FUNCTIONS = [
    ("head", "main", "l_quantity % 12"),
    ("head", "load", "l_linenumber * 2"),
    ("head", "extra", "l_suppkey % 5"),
    ("base", "main", "l_partkey % 9"),
    ("base", "load", "l_linenumber + 3"),
    ("base", "old", "l_suppkey % 3"),
]
#: Labels of judgements; the last severity and rating are ones that no metric knows.
LABELS = {
    "rating": ["absent", "thin", "adequate", "strong", "unreadable"],
    "adherence": ["follows", "minor_divergence", "violates"],
    "severity": ["nit", "clarification", "logic", "architectural", "security", "praise"],
    "category": ["substantive_logic", "cosmetic_nit", "design_arch", "rubber_stamp", "security", "test_coverage"],
}

#: The same entities for DuckDB: the beginning of each oracle's statement.
ORACLE = """
with span as (select l_orderkey, min(l_shipdate) first_ship, max(l_shipdate) last_ship from lineitem group by 1),
prs as (select o_orderkey id, c_nationkey repo_id, case when o_orderkey % 30 = 1 then 1 else o_custkey end author_id, case o_orderstatus when 'F' then 'merged' when 'O' then 'open' else 'closed' end state,
  o_orderkey % 17 = 0 is_draft, case when o_orderkey % 30 = 1 then date_trunc('year', o_orderdate)::timestamp + to_hours(o_orderkey % 20) else o_orderdate end created_at, case when o_orderkey % 3 <> 0 then o_orderdate + to_hours(o_orderkey % 5) end ready_at,
  case when o_orderkey % 11 <> 0 then o_orderdate - to_hours(o_orderkey % 72) end first_commit_at, first_ship first_review_at,
  case when o_orderstatus = 'F' then o_orderdate + to_hours(24 + o_orderkey % 240) end merged_at,
  case when o_orderkey % 10 = 0 then o_custkey else o_orderkey % 100 + 1 end merged_by, greatest(o_orderdate, last_ship) updated_at, o_orderpriority priority,
  case when o_orderstatus = 'F' then case when o_orderkey % 6 = 0 then o_orderdate + to_hours(o_orderkey % 9) else o_orderdate - to_hours(o_orderkey % 72) end end merge_commit_at,
  cast(o_orderkey % 100 as double) / 100 ai_score, case when o_orderkey % 20 = 3 then false when o_orderkey % 20 = 7 then true end ai_verdict, o_orderkey % 13 + 1 rework_lines
  from orders join customer on o_custkey = c_custkey left join span on o_orderkey = l_orderkey where @prs),
links as (select id pr_id, author_id % 15 issue_id, case id % 3 when 0 then 0.98 when 1 then 0.85 else 0.75 end::double confidence from prs where id % 4 <> 0 union all select id, (author_id + 7) % 15, 0.5 from prs where id % 8 = 1),
reviews as (select l_orderkey pr_id, l_linenumber n, l_suppkey reviewer_id, case l_returnflag when 'A' then 'approved' when 'R' then 'changes_requested' else 'commented' end state, l_shipdate submitted_at from lineitem where @lines),
bots as (select s_suppkey bot_id from supplier where s_suppkey % 25 = 0),
files as (select l_orderkey pr_id, l_linenumber n, case l_linenumber % 7 when 1 then concat('src/', lower(replace(p_brand, '#', '')), '/main.py') when 2 then concat('src/', lower(replace(p_type, ' ', '/')), '.js')
  when 3 then concat('tests/test_', l_suppkey % 20, '.py') when 4 then concat('docs/', lower(replace(p_type, ' ', '-')), '.md') when 5 then 'package.json'
  when 6 then concat('dist/', l_suppkey % 9, '.min.js') else concat('infra/deploy/', l_suppkey % 5, '.yml') end as path,
  cast(l_quantity as bigint) additions, cast(round(l_discount * 100) as bigint) deletions, case when l_orderkey % 30 = 1 then 1 when l_linenumber % 4 <> 0 then cast(l_quantity as bigint) end haloc,
  l_linenumber % 7 = 6 is_generated, p_size complexity, case when l_linenumber <> 5 then l_suppkey % 50 end base_complexity, l_suppkey touched_by from lineitem join part on l_partkey = p_partkey where @lines),
functions as (select l_orderkey pr_id, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as path, unnest(['head', 'head', 'head', 'base', 'base', 'base']) side, unnest(['main', 'load', 'extra', 'main', 'load', 'old']) "name",
  unnest([(l_quantity % 12)::int, (l_linenumber * 2)::int, (l_suppkey % 5)::int, (l_partkey % 9)::int, (l_linenumber + 3)::int, (l_suppkey % 3)::int]) cyclomatic from lineitem where @lines),
deploys as (select l_orderkey * 10 + l_linenumber id, s_nationkey repo_id, case l_linenumber when 1 then 'production' when 2 then 'prod-eu' else 'staging' end environment,
  case when l_linestatus = 'F' then 'success' when l_partkey % 2 = 0 then 'failure' else 'error' end status, l_shipdate created_at,
  l_shipdate + to_minutes(l_linenumber * 10) finished_at, case when l_partkey % 50 = 0 then 'merge_proxy' else 'api' end source, case when l_partkey % 9 = 0 then l_shipdate + to_hours(5) end reverted_at
  from lineitem join supplier on l_suppkey = s_suppkey where l_linenumber <= 3 and @deploys),
checks as (select l_orderkey pr_id, l_partkey head_sha, l_suppkey % 10 "name", case l_returnflag when 'A' then 'success' when 'R' then 'failure' end conclusion, l_shipdate started_at,
  case when l_returnflag <> 'N' then l_shipdate + to_seconds(cast(l_quantity as int) * 60) end completed_at from lineitem where @lines),
ev as (select * from events where @issues),
verdicts as (select event_id id, user_id person_id, event_type <> 'signup' is_review, k % 3 = 0 design_bearing, k % 5 + 1 difficulty, k % 10 / 10.0::double confidence, (9 - k % 10) / 10.0::double + 0.1::double atomicity, k % 10 >= 7 sprawling, k % 7 + 1 weight,
  ['absent', 'thin', 'adequate', 'strong', 'unreadable'][k % 5 + 1] rating, ['follows', 'minor_divergence', 'violates'][k % 3 + 1] adherence, ['nit', 'clarification', 'logic', 'architectural', 'security', 'praise'][k % 6 + 1] severity,
  ['substantive_logic', 'cosmetic_nit', 'design_arch', 'rubber_stamp', 'security', 'test_coverage'][k % 6 + 1] category from (select *, cast(json_extract(props, '$.k') as int) k from ev) where k is not null),
transitions as (select user_id issue_id, event_id n, lag(event_type) over (partition by user_id order by ts, event_id) from_status, event_type to_status, ts moved_at from ev),
flow_states as (select event_type status, unnest(case event_type when 'click' then ['active', 'wait'] when 'error' then ['wait', 'active'] when 'view' then ['active'] when 'purchase' then ['done'] else ['new'] end) flow_state,
  unnest(case event_type when 'click' then [timestamp '2020-01-01', timestamp '2024-01-15'] when 'error' then [timestamp '2020-01-01', timestamp '2024-01-20 12:00:00'] else [timestamp '2020-01-01'] end) valid_from,
  unnest(case event_type when 'click' then [timestamp '2024-01-15', timestamp '2999-01-01'] when 'error' then [timestamp '2024-01-20 12:00:00', timestamp '2999-01-01'] else [timestamp '2999-01-01'] end) valid_to from (select distinct event_type from events)),
issues as (select issue_id, created_at, updated_at, resolved_at, status, n_events, case issue_id % 5 when 0 then 'Bug' when 1 then 'Story' when 2 then 'Tech Debt' when 3 then 'Feature' else 'Chore' end as type,
  case when issue_id % 4 = 0 then null else concat('P', issue_id % 3) end priority, case when issue_id % 3 = 0 then null else cast(issue_id % 8 as double) end points,
  issue_id % 7 = 6 was_reopened, case when issue_id % 4 = 3 then issue_id - 1 end parent_id, case when issue_id % 4 = 3 then 2 when issue_id % 9 = 0 then 0 else 1 end as level,
  case when status = 'purchase' then case when issue_id % 2 = 0 then 'Fixed' else 'Duplicate' end end resolution
  from (select user_id issue_id, min(ts) created_at, max(ts) updated_at, arg_max(event_type, (ts, event_id)) status, min(ts) filter (event_type = 'purchase') resolved_at, count(*) n_events from ev group by 1)),
incidents as (select event_id id, user_id issue_id, ts created_at, resolved_at from (select *, first_value(case when event_type <> 'error' then ts end ignore nulls) over (partition by user_id order by ts, event_id rows between 1 following and unbounded following) resolved_at from ev) where event_type = 'error')
"""
