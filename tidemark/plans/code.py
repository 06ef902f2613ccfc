"""Code metrics: churn from patches, impact, complexity, upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.stats import entropy_share, ratio, rounded
from tidemark.operators.blame import work_types_by_author
from tidemark.plans.catalog import metric
from tidemark.plans.pull_requests import merged
from tidemark.tables import DAYS, FROM, TO, Tables

_MP = f", mp as (select * from prs where state = 'merged' and merged_at >= timestamp '{FROM}' and merged_at < timestamp '{TO}' + interval 1 day)"


def directory(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")


def hunks(patches: DataFrame, key: str = "id", patch: str = "patch") -> DataFrame:
    """(key, hunk, inserted, deleted) of unified diffs: a running count of hunk headers over each patch's lines.

    Within one patch, so the window's groups are single texts.  File headers, blank changes and the
    marker of a missing newline don't count; carriage returns are ignored; a binary patch has no hunks.
    """
    lines = patches.select(key, F.posexplode(F.split(F.regexp_replace(F.coalesce(F.col(patch), F.lit("")), "\r", ""), "\n")).alias("n", "line"))
    at = W.partitionBy(key).orderBy("n")
    numbered = lines.withColumn("hunk", F.sum(F.col("line").startswith("@@").cast("int")).over(at)).where("hunk > 0")
    changed = F.length(F.trim(F.substring("line", 2, 1 << 30))) > 0
    return numbered.groupBy(key, "hunk").agg(F.count_if(F.col("line").startswith("+") & changed).alias("inserted"), F.count_if(F.col("line").startswith("-") & changed).alias("deleted"))


def haloc(patches: DataFrame, key: str = "id", patch: str = "patch") -> DataFrame:
    """(key, haloc): the larger of lines inserted and deleted, summed over hunks."""
    return hunks(patches, key, patch).groupBy(key).agg(F.sum(F.greatest("inserted", "deleted")).alias("haloc"))


#: Names a line item: order and number alone repeat.
_LINE = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)"


def patches(t: Tables) -> DataFrame:
    """A patch for each line item: two hunks whose sizes follow its numbers."""
    plus = "repeat('+added line\\n', cast(l_quantity as int) % 5 + 1)"
    minus = "repeat('-gone line\\n', l_linenumber % 4)"
    return t.lineitem.selectExpr(f"{_LINE} as id", f"concat('@@ -1,4 +1,9 @@\\n context\\n', {plus}, {minus}, '@@ -20,2 +25,2 @@\\n', {minus}, '+   \\n same') as patch")


@metric(
    "code.haloc_patches",
    " select count(*) patches, sum(greatest(cast(l_quantity as int) % 5 + 1, l_linenumber % 4) + l_linenumber % 4)::bigint as value from lineitem",
    prelude=False,
)
def haloc_patches(t: Tables) -> DataFrame:
    """Lines of churn of patch texts: per hunk the larger of lines inserted and deleted."""
    return haloc(patches(t)).agg(F.count(F.lit(1)).alias("patches"), F.sum("haloc").alias("value"))


_FILES = _MP + ", mf as (select f.* from files f join mp on f.pr_id = mp.id)"


def merged_files(t: Tables) -> DataFrame:
    return t.files.join(merged(t), F.col("pr_id") == F.col("id"), "left_semi")


@metric(
    "code.haloc_aggregate",
    _FILES + " select sum(case when not is_generated then coalesce(haloc, greatest(additions, deletions)) end)::bigint as value, sum(case when is_generated then coalesce(haloc, greatest(additions, deletions)) end)::bigint generated, round(count(haloc) / count(*)::double, 6) coverage from mf",
)
def haloc_aggregate(t: Tables) -> DataFrame:
    """Churn of merged pull requests, generated files apart, and the share of files with a count of their own."""
    churn = F.coalesce("haloc", F.greatest("additions", "deletions"))
    return merged_files(t).agg(F.sum(F.when(~F.col("is_generated"), churn)).alias("value"), F.sum(F.when(F.col("is_generated"), churn)).alias("generated"), rounded(ratio(F.count("haloc"), F.count(F.lit(1)))).alias("coverage"))


@metric(
    "code.nagappan_ball",
    f""", c as (select sum(case when created_at >= timestamp '{FROM}' and created_at < timestamp '{TO}' + interval 1 day then coalesce(haloc, 0) else 0 end) h, sum(case when created_at < timestamp '{FROM}' then coalesce(haloc, 0) else 0 end) p
 from files join prs on pr_id = id where not is_generated) select round(h / nullif(p + h, 0)::double, 6) m1, round(h / {DAYS}.0, 6) m2, h::bigint haloc, p::bigint prior from c""",
)
def nagappan_ball(t: Tables) -> DataFrame:
    """M1: churn / (churn before the window and in it); M2: churn a day."""
    rows = t.files.where("not is_generated").join(t.prs.select("id", "created_at"), F.col("pr_id") == F.col("id"))
    own = F.coalesce("haloc", F.lit(0).cast("long"))
    sums = rows.agg(F.sum(F.when(t.within("created_at"), own).otherwise(0)).alias("h"), F.sum(F.when(F.col("created_at") < F.lit(t.window.first).cast("timestamp"), own).otherwise(0)).alias("p"))
    return sums.select(rounded(ratio(F.col("h"), F.col("p") + F.col("h"))).alias("m1"), rounded(F.col("h") / F.lit(float(t.window.days))).alias("m2"), F.col("h").alias("haloc"), F.col("p").alias("prior"))


@metric(
    "code.change_impact",
    _FILES
    + """, g as (select pr_id, case when contains(path, '/') then regexp_replace(path, '/[^/]*$', '') else '.' end dir, count(*) n, sum(coalesce(haloc, additions + deletions)) h from mf group by 1, 2),
e as (select pr_id, count(*) dirs, sum(n) files, sum(h) h, max(tot) tot, -sum((n / tot::double) * ln(n / tot::double)) ent from (select *, sum(n) over (partition by pr_id) tot from g) group by 1)
select count(*) n, round(avg(least(1, 0.25 * least(1, dirs / 10.0) + 0.25 * h / (h + 100.0) + 0.2 * least(1, files / 20.0) + 0.15 * case when dirs > 1 then ent / ln(dirs) else 0 end)), 6) as value from e""",
)
def change_impact(t: Tables) -> DataFrame:
    """Mean impact of merged pull requests from directories touched, churn, files and the spread over directories."""
    dirs = merged_files(t).groupBy("pr_id", directory(F.col("path")).alias("dir")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("haloc", F.col("additions") + F.col("deletions"))).alias("h"))
    total = F.sum("n").over(W.partitionBy("pr_id"))
    each = dirs.withColumn("tot", total).groupBy("pr_id").agg(F.count(F.lit(1)).alias("dirs"), F.sum("n").alias("files"), F.sum("h").alias("h"), F.sum(entropy_share(F.col("n"), F.col("tot"))).alias("ent"))
    spread = F.when(F.col("dirs") > 1, F.col("ent") / F.log("dirs")).otherwise(0.0)
    impact = 0.25 * F.least(F.lit(1.0), F.col("dirs") / 10) + 0.25 * F.col("h") / (F.col("h") + 100) + 0.2 * F.least(F.lit(1.0), F.col("files") / 20) + 0.15 * spread
    return each.agg(F.count(F.lit(1)).alias("n"), rounded(F.avg(F.least(F.lit(1.0), impact))).alias("value"))


@metric(
    "code.complexity_delta",
    """, h as (select * from functions where side = 'head'), b as (select * from functions where side = 'base'),
s as (select h.cyclomatic - b.cyclomatic d, h.cyclomatic head, b.cyclomatic base from h full join b on h.pr_id = b.pr_id and h.path = b.path and h."name" = b."name")
select sum(greatest(d, 0))::bigint increased, sum(greatest(-d, 0))::bigint decreased, count(*) filter (d > 0) functions_increased, count(*) filter (d < 0) functions_decreased,
 count(*) filter (base is null) added, count(*) filter (head is null) removed, sum(head) filter (base is null)::bigint added_complexity from s""",
    unit="index",
)
def complexity_delta(t: Tables) -> DataFrame:
    """Cyclomatic complexity that functions of one name gained and lost between base and head, and apart from those what functions were added and removed."""
    key = ["pr_id", "path", "name"]
    # One side's row for each function, so a function is joined to itself by pivoting: no join, and no shuffle but the files'.
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("cyclomatic")))
    both = t.functions.groupBy(*key).agg(of("head").alias("head"), of("base").alias("base"))
    d = F.col("head") - F.col("base")
    return both.agg(
        F.sum(F.greatest(d, F.lit(0))).alias("increased"),
        F.sum(F.greatest(-d, F.lit(0))).alias("decreased"),
        F.count_if(d > 0).alias("functions_increased"),
        F.count_if(d < 0).alias("functions_decreased"),
        F.count_if(F.col("base").isNull()).alias("added"),
        F.count_if(F.col("head").isNull()).alias("removed"),
        F.sum(F.when(F.col("base").isNull(), F.col("head"))).alias("added_complexity"),
    )


@metric(
    "code.top_files",
    _FILES + """, r as (select pr_id, path, n, row_number() over (partition by pr_id order by abs(complexity - coalesce(base_complexity, 0)) desc, n, path, complexity - coalesce(base_complexity, 0)) i, complexity - coalesce(base_complexity, 0) delta from mf)
select pr_id, i::int place, path, delta::int delta from r where i <= 10""",
)
def top_files(t: Tables) -> DataFrame:
    """The ten files of each merged pull request whose complexity changed most."""
    delta = F.col("complexity") - F.coalesce("base_complexity", F.lit(0))
    at = W.partitionBy("pr_id").orderBy(F.desc(F.abs("delta")), "n", "path", "delta")
    return merged_files(t).withColumn("delta", delta).withColumn("place", F.row_number().over(at)).where("place <= 10").select("pr_id", "place", "path", F.col("delta").cast("int").alias("delta"))


@metric(
    "code.maintainability_index",
    _FILES
    + """, d as (select path, max(complexity) c, max(additions) loc from mf where not is_generated group by 1), h as (select avg(coalesce(haloc, additions)) h from mf where not is_generated)
select count(*) files, round(greatest(0, least(100, 171 - 5.2 * ln(max(h) + 1) - 0.23 * avg(c) - 16.2 * ln(avg(loc) + 1))), 6) as value from d, h""",
)
def maintainability_index(t: Tables) -> DataFrame:
    """171 - 5.2 ln(churn + 1) - 0.23 complexity - 16.2 ln(lines + 1), of averages over distinct files, within 0 to 100."""
    own = merged_files(t).where("not is_generated")
    files = own.groupBy("path").agg(F.max("complexity").alias("c"), F.max("additions").alias("loc")).agg(F.count(F.lit(1)).alias("files"), F.avg("c").alias("c"), F.avg("loc").alias("loc"))
    churn = own.agg(F.avg(F.coalesce("haloc", "additions")).alias("h"))
    index = 171 - 5.2 * F.log(F.col("h") + 1) - 0.23 * F.col("c") - 16.2 * F.log(F.col("loc") + 1)
    return files.crossJoin(churn).select("files", rounded(F.greatest(F.lit(0.0), F.least(F.lit(100.0), index))).alias("value"))  # a row each


@metric(
    "code.rework_paths",
    """, l as (select l_partkey path, l_suppkey author, l_shipdate moved_at, l_orderkey * 10 + l_linenumber id from lineitem),
b as (select *, lag(author) over w last_author, lag(moved_at) over w last_at from l window w as (partition by path order by moved_at, id)),
c as (select case when last_at is null then 'new' when moved_at > last_at + interval 30 day then 'legacy_refactor' when last_author <> author then 'help_others' else 'rework' end class from b)
select class, count(*) n, round(count(*) / sum(count(*)) over ()::double, 6) share from c group by 1""",
)
def rework_paths(t: Tables) -> DataFrame:
    """Changes by what the last change of their file was: none, older than 30 days, another's recent one, one's own."""
    at = W.partitionBy("path").orderBy("at", "id")
    rows = t.lineitem.selectExpr("l_partkey as path", "l_suppkey as author", "l_shipdate as at", "l_orderkey * 10 + l_linenumber as id")
    known = rows.withColumns({"last_author": F.lag("author").over(at), "last_at": F.lag("at").over(at)})
    kind = F.when(F.col("last_at").isNull(), "new").when(F.col("at") > F.col("last_at") + F.expr("interval 30 days"), "legacy_refactor").when(F.col("last_author") != F.col("author"), "help_others").otherwise("rework")
    counts = known.groupBy(kind.alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", rounded(F.col("n") / F.sum("n").over(W.partitionBy())))  # four rows


_CHANGE_SQL = f""", ch as (select l_partkey path, l_orderkey * 10 + l_linenumber id, l_suppkey author, l_shipdate moved_at, (l_suppkey % 100 + 1)::int first_line, (l_suppkey % 100 + l_quantity)::int last_line from lineitem where @lines),
ln as (select path, id, author, moved_at, unnest(generate_series(first_line, last_line)) line from ch)"""


def line_changes(t: Tables) -> DataFrame:
    """(path, id, author, at, first_line, last_line): the lines of a file that each line item changed."""
    return t.lineitem.selectExpr("l_partkey as path", "l_orderkey * 10 + l_linenumber as id", "l_suppkey as author", "l_shipdate as at", "cast(l_suppkey % 100 + 1 as int) as first_line", "cast(l_suppkey % 100 + l_quantity as int) as last_line")


@metric(
    "code.rework_churn",
    _CHANGE_SQL
    + f""", bl as (select path, line, arg_max(author, (moved_at, id)) as owner, max(moved_at) changed_at from ln where moved_at < timestamp '{TO}' + interval 1 day group by 1, 2),
hk as (select ln.*, case when owner is null then 'new' when ln.moved_at > changed_at + interval 30 day then 'legacy_refactor' when owner <> author then 'help_others' else 'rework' end kind from ln left join bl on bl.path = ln.path and bl.line = ln.line where ln.moved_at >= timestamp '{TO}' + interval 1 day)
select author, count(*) as lines, count(*) filter (kind = 'new') "new", count(*) filter (kind = 'legacy_refactor') legacy_refactor, count(*) filter (kind = 'help_others') help_others, count(*) filter (kind = 'rework') rework,
 round(100.0 * count(*) filter (kind = 'rework') / count(*), 6) rework_percent, round(100 - 100.0 * count(*) filter (kind = 'rework') / count(*), 6) efficiency from hk group by 1""",
)
def rework_churn(t: Tables) -> DataFrame:
    """Each author's lines changed since the window by what blame at its end says: new, over 30 days old, another's, one's own."""
    changes = line_changes(t)
    after = F.date_add(F.lit(t.window.last).cast("date"), 1).cast("timestamp")
    sums = work_types_by_author(changes.where(F.col("at") >= after), changes.where(F.col("at") < after)).where("lines > 0")
    share = 100 * ratio(F.col("rework"), F.col("lines"))
    return sums.select("*", rounded(share).alias("rework_percent"), rounded(100 - share).alias("efficiency"))


# The kinds of path, in the order in which they are tried.
PATH_KINDS = [
    ("generated", r"(?i)(^|/)(dist|build|out|vendor|node_modules|generated|__generated__)(/|$)|\.(min\.[a-z]+|generated\.[a-z]+|pb\.go|g\.dart)$|(^|/)(package-lock\.json|yarn\.lock|bun\.lockb|go\.sum)$"),
    ("test", r"(?i)(^|/)(tests?|__tests__|spec|specs|e2e)(/|$)|\.(test|spec)\.[a-z]+$|_test\.[a-z]+$"),
    ("docs", r"(?i)(^|/)docs?(/|$)|\.(md|mdx|rst|txt|adoc)$|(^|/)(readme|changelog|license)"),
    ("config", r"(?i)\.(ya?ml|toml|ini|cfg|conf|json5?|lock|env)$|(^|/)\.[^/]+rc(\.[a-z]+)?$|(^|/)(dockerfile|makefile|\.github|\.gitlab)"),
]


def path_kind(path: Column) -> Column:
    first, *rest = PATH_KINDS
    out = F.when(path.rlike(first[1]), first[0])
    for name, pattern in rest:
        out = out.when(path.rlike(pattern), name)
    return out.otherwise("prod")


_KIND_SQL = "case " + " ".join(f"when regexp_matches(path, '{p}') then '{n}'" for n, p in PATH_KINDS) + " else 'prod' end"


@metric("code.path_kinds", f" select {_KIND_SQL} kind, count(*) files, sum(additions + deletions)::bigint as lines from files group by 1")
def path_kinds(t: Tables) -> DataFrame:
    """Changed files and lines by kind of path: generated, test, docs, config, else prod."""
    return t.files.groupBy(path_kind(F.col("path")).alias("kind")).agg(F.count(F.lit(1)).alias("files"), F.sum(F.col("additions") + F.col("deletions")).alias("lines"))
