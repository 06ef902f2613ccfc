"""Derived facts: links, identities, scores, flow states, and the operators on stored histories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.stats import fnv1a, noisy_or, poly31, ratio, rounded
from tidemark.functions.text import SIGNALS, is_bot, issue_keys, normalised_name, scrub, scrub_random, signal_weights, trailers
from tidemark.operators.graph import changed_clusters, clusters
from tidemark.operators.history import append_ignore, as_of, effective, latest, prune, tombstone, upsert
from tidemark.operators.stitch import stitched, suggestions
from tidemark.plans.catalog import metric
from tidemark.tables import Tables

_TITLE = "case o_orderkey % 5 when 0 then concat('PROJ-', o_custkey % 150, ' #close tidy up') when 1 then 'Use UTF-8 and SHA-256 everywhere' else concat('Work on part ', o_orderkey % 7) end"
_BRANCH = "case when o_orderkey % 3 = 0 then concat('feature/PROJ-', o_custkey % 90, '-thing') else concat('fix/', o_orderkey) end"
_BODY = "concat('See PROJ-', o_orderkey % 40, case when o_orderkey % 4 = 0 then concat(' and CORE-', o_orderkey % 11) else '' end, '. This is a comprehensive change.')"


def texts(t: Tables) -> DataFrame:
    """(pr_id, title, branch, body) of pull requests."""
    return t.raw("orders").selectExpr("o_orderkey as pr_id", f"{_TITLE} as title", f"{_BRANCH} as branch", f"{_BODY} as body")


_TEXTS = f"with tx as (select o_orderkey pr_id, {_TITLE} title, {_BRANCH} branch, {_BODY} body from orders)"
_LINKS = (
    _TEXTS
    + r""", f as (select pr_id, unnest(regexp_extract_all(title, '\b[A-Z][A-Z0-9]+-[0-9]+\b')) k, case when regexp_matches(title, '#(close|fix|resolve)') then 0.98 else 0.75 end c, case when regexp_matches(title, '#(close|fix|resolve)') then 'smart_commit' else 'text' end s from tx
 union all select pr_id, unnest(regexp_extract_all(branch, '\b[A-Z][A-Z0-9]+-[0-9]+\b')), 0.85, 'branch' from tx union all select pr_id, unnest(regexp_extract_all(body, '\b[A-Z][A-Z0-9]+-[0-9]+\b')), 0.75, 'text' from tx),
lk as (select pr_id, k issue_key, max(c) confidence, arg_max(s, c) link_source from f where split_part(k, '-', 1) not in ('UTF', 'SHA', 'ISO', 'RFC', 'CVE', 'HTTP', 'TLS', 'AES', 'MD', 'BASE') group by 1, 2)"""
)


def issue_links(t: Tables) -> DataFrame:
    x = texts(t)
    smart = F.col("title").rlike("#(close|fix|resolve)")
    found = [
        x.select("pr_id", F.explode(issue_keys(F.col("title"))).alias("issue_key"), F.when(smart, 0.98).otherwise(0.75).alias("c"), F.when(smart, "smart_commit").otherwise("text").alias("s")),
        x.select("pr_id", F.explode(issue_keys(F.col("branch"))), F.lit(0.85), F.lit("branch")),
        x.select("pr_id", F.explode(issue_keys(F.col("body"))), F.lit(0.75), F.lit("text")),
    ]
    return found[0].union(found[1]).union(found[2]).groupBy("pr_id", "issue_key").agg(F.max("c").alias("confidence"), F.max_by("s", "c").alias("link_source"))


@metric("link.issues", _LINKS + " select pr_id, issue_key, confidence::double confidence, link_source from lk", prelude=False)
def link_issues(t: Tables) -> DataFrame:
    """Keys that a pull request names: in a closing title, its branch, or any text, by the best evidence."""
    return issue_links(t)


@metric("link.rate", _LINKS + " select round((select count(distinct pr_id) from lk) / count(*)::double, 6) as value, count(*) prs from tx", prelude=False)
def link_rate(t: Tables) -> DataFrame:
    """Pull requests with a link / pull requests."""
    linked = issue_links(t).select("pr_id", F.lit(1).alias("l")).distinct()
    return texts(t).join(linked, "pr_id", "left").agg(rounded(ratio(F.count("l"), F.count(F.lit(1)))).alias("value"), F.count(F.lit(1)).alias("prs"))



@metric(
    "link.key_history",
    _LINKS
    + """, h as (select concat('PROJ-', k) issue_key, k + 1000 issue_id, timestamp '1995-01-01' + to_days((k * 20)::int) valid_from from (select unnest(range(0, 40)) k) union all select concat('PROJ-', k), k + 2000, timestamp '1998-01-01' + to_days(k::int) from (select unnest(range(0, 40)) k)),
e as (select *, lead(valid_from) over (partition by issue_key order by valid_from) valid_to from h)
select pr_id, issue_id from lk join e using (issue_key) join orders on pr_id = o_orderkey where valid_from <= o_orderdate and (valid_to is null or valid_to > o_orderdate)""",
    prelude=False,
)
def key_history(t: Tables) -> DataFrame:
    """Linked keys resolved to the issue that had the key when the pull request was opened."""
    k = t.spark.range(40)
    day = lambda base, n: F.expr(f"timestampadd(DAY, cast({n} as int), timestamp '{base}')")
    key = F.concat(F.lit("PROJ-"), F.col("id"))
    history = k.select(key.alias("issue_key"), (F.col("id") + 1000).alias("issue_id"), day("1995-01-01", "id * 20").alias("valid_from")).union(k.select(key, F.col("id") + 2000, day("1998-01-01", "id")))
    held = effective(history, ["issue_key"], "valid_from")
    opened = issue_links(t).join(t.raw("orders").select(F.col("o_orderkey").alias("pr_id"), F.col("o_orderdate").alias("at")), "pr_id")
    return opened.join(held, "issue_key").where("valid_from <= at and (valid_to is null or valid_to > at)").select("pr_id", "issue_id")


_MESSAGE = "concat('Change ', o_orderkey, chr(10), chr(10), case when o_orderkey % 2 = 0 then concat('Co-authored-by: Dev ', o_custkey % 9, ' <dev', o_custkey % 9, '@example.com>', chr(10)) else '' end, 'Signed-off-by: Lead <lead@example.com>')"


@metric("text.trailers", f"select o_orderkey id, regexp_extract(m, 'Co-authored-by: ([^\\n]+)', 1) co_author from (select o_orderkey, {_MESSAGE} m from orders) where o_orderkey % 2 = 0", prelude=False)
def commit_trailers(t: Tables) -> DataFrame:
    """Co-authors that commit messages name."""
    return t.raw("orders").selectExpr("o_orderkey as id", f"{_MESSAGE} as m").select("id", F.explode(trailers(F.col("m"), "co-authored-by")).alias("co_author"))


_SIGNAL_SQL = " * ".join(f"(1 - case when regexp_matches(body, '{p}') then {w} else 0 end)" for p, w in SIGNALS if "✨" not in p)


@metric("text.authorship_score", _TEXTS + f" select pr_id, round(1 - {_SIGNAL_SQL}, 6) score from tx", prelude=False, trust="probabilistic")
def authorship_score(t: Tables) -> DataFrame:
    """Noisy-or of the signals of machine-written text."""
    return texts(t).select("pr_id", rounded(noisy_or(signal_weights(F.col("body")))).alias("score"))


@metric("text.authorship_queue", _TEXTS + f", s as (select pr_id, round(1 - {_SIGNAL_SQL}, 6) + (pr_id % 10) * 0.1 score from tx) select pr_id, round(score, 6) score from s where round(score, 6) between 0.35 and 0.65 order by score desc, pr_id limit 50", prelude=False, trust="probabilistic")
def authorship_queue(t: Tables) -> DataFrame:
    """The 50 most likely of the ambiguous scores: what a reader is asked about next."""
    score = F.round(rounded(noisy_or(signal_weights(F.col("body")))) + (F.col("pr_id") % 10) * 0.1, 6)
    return texts(t).select("pr_id", score.alias("score")).where("score between 0.35 and 0.65").orderBy(F.desc("score"), "pr_id").limit(50)


_SCRUB_SQL = r"""regexp_replace(regexp_replace(regexp_replace(text, 'eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}', '[token]', 'g'), '(?i)(api_?key|secret|token|passw(?:or)?d)(["'' ]*[:=]["'' ]*)[A-Za-z0-9+/_.=-]{8,}', '\1\2[secret]', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[email]', 'g')"""
_RANDOM_SQL = """with d as (select row_number() over () rid, doc_id, {text} t from documents), m as (select rid, doc_id, t, string_split_regex(t, '[A-Za-z0-9+/_=-]{{32,}}') g, regexp_extract_all(t, '[A-Za-z0-9+/_=-]{{32,}}') x from d),
u as (select rid, unnest(x) run, unnest(range(1, len(x) + 1)) i from m where len(x) > 0), c as (select rid, i, run, unnest(string_split(run, '')) ch from u), k as (select rid, i, run, ch, count(*) n from c group by all),
e as (select rid, i, run, -sum(n / length(run)::double * log2(n / length(run)::double)) bits from k group by all), r as (select rid, i, case when bits >= 3.5 - 1e-12 then '[random]' else run end made from e),
j as (select m.rid, string_agg(g[i] || made, '' order by i) body from m join r using (rid) group by 1) select m.doc_id, md5(case when body is null then t else body || g[len(g)] end) digest, {more} from m left join j using (rid)"""


@metric("text.scrub", _RANDOM_SQL.format(text=_SCRUB_SQL, more="length(t)::bigint >= 0 is_text"), prelude=False)
def scrubbed(t: Tables) -> DataFrame:
    """Whole texts with tokens, secrets, addresses and long random runs masked, as digests."""
    return t.raw("documents").select("doc_id", F.md5(scrub(F.col("text"))).alias("digest"), (F.length("text") >= 0).alias("is_text"))


@metric("text.scrub_random", _RANDOM_SQL.format(text="text", more="coalesce(body || g[len(g)], t) <> t changed"), prelude=False)
def scrubbed_random(t: Tables) -> DataFrame:
    """Whole texts with long random runs masked by their entropy, as digests, and whether that changed them."""
    new = scrub_random(F.col("text"))
    return t.raw("documents").select("doc_id", "text", new.alias("new")).select("doc_id", F.md5("new").alias("digest"), (F.col("new") != F.col("text")).alias("changed"))


@metric("text.fingerprint", """with recursive c as (select c_custkey, c_name n, 1 i, 0::hugeint h, 2166136261::hugeint f from customer union all select c_custkey, n, i + 1, (h * 31 + ascii(substr(n, i, 1))) % 4294967296, (xor(f, ascii(substr(n, i, 1))::hugeint) * 16777619) % 4294967296 from c where i <= length(n)) select c_custkey, h::bigint poly31, f::bigint fnv1a from c where i = length(n) + 1""", prelude=False)
def fingerprint(t: Tables) -> DataFrame:
    """The 31-polynomial and FNV-1a of each customer's name."""
    return t.raw("customer").select("c_custkey", poly31(F.col("c_name")).alias("poly31"), fnv1a(F.col("c_name")).alias("fnv1a"))


@metric("identity.resolve", "with e as (select user_id, ts, event_id, cast(json_extract(props, '$.k') as int) k from events) select user_id, arg_min(k, (ts, event_id)) first_k, count(distinct k) variants from e where k is not null group by 1", prelude=False)
def resolve(t: Tables) -> DataFrame:
    """The first known value that raw records give for each login, and how many they give."""
    k = F.from_json("props", "k int")["k"]
    rows = t.raw("events").select("user_id", "ts", "event_id", k.alias("k")).where("k is not null")
    return rows.groupBy("user_id").agg(F.min_by("k", F.struct("ts", "event_id")).alias("first_k"), F.countDistinct("k").alias("variants"))


@metric("identity.bots", "select s_suppkey, s_suppkey % 25 = 0 or s_suppkey % 40 = 0 is_bot from supplier", prelude=False)
def bots(t: Tables) -> DataFrame:
    """Accounts that are automation, by type, suffix or known name."""
    login = F.when(F.col("s_suppkey") % 40 == 0, F.concat(F.lit("deploy"), F.col("s_suppkey"), F.lit("-bot"))).otherwise(F.col("s_name"))
    kind = F.when(F.col("s_suppkey") % 25 == 0, "Bot").otherwise("User")
    return t.raw("supplier").select("s_suppkey", is_bot(login, kind).alias("is_bot"))


@metric(
    "identity.name_match",
    """with a as (select c_custkey, unnest(string_split(trim(regexp_replace(regexp_replace(lower(c_name), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')), ' ')) w from customer), b as (select s_suppkey, unnest(string_split(trim(regexp_replace(regexp_replace(lower(s_name), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')), ' ')) w from supplier),
p as (select c_custkey, s_suppkey, count(*) overlap from a join b using (w) group by 1, 2) select c_custkey, s_suppkey, overlap, count(*) over (partition by s_suppkey) = 1 is_unique from p""",
    prelude=False,
)
def name_match(t: Tables) -> DataFrame:
    """Accounts of two sources whose names share a token, through an index of tokens; whether the match is the only one."""
    of = lambda table, key, name: t.raw(table).select(key, F.explode(F.array_distinct(F.split(normalised_name(F.col(name)), " "))).alias("w"))
    pairs = of("customer", "c_custkey", "c_name").join(of("supplier", "s_suppkey", "s_name"), "w").groupBy("c_custkey", "s_suppkey").agg(F.count(F.lit(1)).alias("overlap"))
    return pairs.withColumn("is_unique", F.count(F.lit(1)).over(W.partitionBy("s_suppkey")) == 1)


@metric(
    "identity.co_occurrence",
    "with p as (select o_custkey a, l_suppkey b, count(*) n from orders join lineitem on o_orderkey = l_orderkey group by 1, 2), s as (select *, sum(n) over (partition by a) total, row_number() over (partition by a order by n desc, b) r from p) select a author_id, b assignee_id, n, round(n / total::double, 6) share, n >= 5 and n / total::double >= 0.5 strong from s where r = 1",
    prelude=False,
)
def co_occurrence(t: Tables) -> DataFrame:
    """For each author the assignee most often linked, how often, and whether that is strong evidence of one person."""
    pairs = t.raw("orders").select("o_orderkey", F.col("o_custkey").alias("author_id")).join(t.lineitem.select("l_orderkey", F.col("l_suppkey").alias("assignee_id")), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("author_id", "assignee_id").agg(F.count(F.lit(1)).alias("n"))
    best = pairs.groupBy("author_id").agg(F.sum("n").alias("total"), F.max_by(F.struct("assignee_id", "n"), F.struct(F.col("n"), -F.col("assignee_id"))).alias("top"))
    share = ratio(F.col("top.n"), F.col("total"))
    return best.select("author_id", "top.assignee_id", "top.n", rounded(share).alias("share"), ((F.col("top.n") >= 5) & (share >= 0.5)).alias("strong"))


@metric("identity.clusters", "select c_custkey, c_custkey - (c_custkey // 100 % 3) * 100 \"cluster\" from customer", prelude=False)
def identity_clusters(t: Tables) -> DataFrame:
    """Accounts joined by confirmed matches: each with the smallest account it reaches."""
    people = t.raw("customer").select("c_custkey")
    matches = people.where("c_custkey div 100 % 3 <> 2").selectExpr("c_custkey as a", "c_custkey + 100 as b").join(people.withColumnRenamed("c_custkey", "b"), "b", "left_semi")
    return clusters(people, matches, "c_custkey")


@metric(
    "identity.edits",
    """with m as (select c_custkey a, c_custkey + 100 b from customer where c_custkey // 100 % 3 <> 2 and c_custkey + 100 in (select c_custkey from customer)),
chain as (select c_custkey, c_custkey // 100 % 3 pos, c_custkey - c_custkey // 100 % 3 * 100 root from customer),
cut as (select c_custkey, case when pos = 2 and c_custkey % 5 = 0 then c_custkey else root end root from chain),
last as (select c_custkey, case when root // 100 % 6 = 3 and root % 7 = 0 then root - 300 else root end root from cut)
select l.c_custkey, chain.root before, l.root as after, case when pos = 2 and l.c_custkey % 5 = 0 then 'split' when exists (select 1 from chain o where o.root = chain.root and o.pos = 2 and o.c_custkey % 5 = 0) then 'split' else 'merged' end cause
 from last l join chain using (c_custkey) where l.root <> chain.root""",
    prelude=False,
)
def identity_edits(t: Tables) -> DataFrame:
    """Accounts whose person changed after some matches were unmerged and others confirmed, and why."""
    people = t.raw("customer").select("c_custkey")
    pairs = lambda where, step: people.where(where).selectExpr("c_custkey as a", f"c_custkey + {step} as b").join(people.withColumnRenamed("c_custkey", "b"), "b", "left_semi")
    matches = pairs("c_custkey div 100 % 3 <> 2", 100)
    before = clusters(people, matches, "c_custkey")
    unmerged = pairs("c_custkey div 100 % 3 = 1 and c_custkey % 5 = 0", 100)
    confirmed = pairs("c_custkey div 100 % 6 = 0 and (c_custkey + 300) % 7 = 0", 300)
    return changed_clusters(before, matches, unmerged, confirmed, "c_custkey")[2]


#: The accounts of the sources, as expressions that Spark and DuckDB share.
_ACCOUNT_COLUMNS = ("id", "kind", "external_id", "email", "name", "is_bot")
_ACCOUNTS = {
    "supplier": ("s_suppkey", "'login'", "concat('dev', s_suppkey)", "case when s_suppkey % 3 = 0 then concat('U', s_suppkey, '@x.com') end", "concat('Ann', s_suppkey % 9, ' B', s_suppkey % 7)", "s_suppkey % 25 = 0"),
    "part": (
        "p_partkey + 1000000",
        "'tracker'",
        "concat('T', p_partkey)",
        "case when p_partkey % 2 = 0 then concat('u', p_partkey, '@x.com') end",
        "case when p_partkey % 50 = 1 then concat('Solo', p_partkey % 11) else concat('Ann', p_partkey % 13, ' C', p_partkey % 17, ' Lee') end",
        "false",
    ),
    "customer": (
        "c_custkey + 2000000",
        "'commit'",
        "case c_custkey % 4 when 0 then concat('u', c_custkey % 40, '@X.com') when 1 then concat('mail', c_custkey % 300, '@h', c_custkey % 2, '.com') when 2 then concat('mail', c_custkey % 290, '+x@h', c_custkey % 3, '.com') else concat('noreply@n', c_custkey, '.com') end",
        "cast(null as varchar(9))",
        "case c_custkey % 5 when 0 then concat('Solo', c_custkey % 23) when 1 then concat('Lee ', 'Ann', c_custkey % 13) when 2 then concat('B', c_custkey % 7, ' ann', c_custkey % 9, ' Q') when 3 then 'Lee Zed' end",
        "c_custkey % 97 = 0",
    ),
}
_ACCOUNTS_SQL = " union all ".join("select " + ", ".join(f"{x} {n}" for x, n in zip(own, _ACCOUNT_COLUMNS, strict=True)) + f" from {table}" for table, own in _ACCOUNTS.items())
_STITCH_SQL = f"""with ac as ({_ACCOUNTS_SQL}), nb as (select *, case when kind <> 'commit' then concat(kind, ':', external_id) end person, lower(external_id) address, regexp_replace(split_part(lower(external_id), '@', 1), '\\+.*$', '') lp, list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(name), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')), ' '), lambda x: x <> '')) w from ac where not is_bot),
ve as (select lower(email) address, min(person) p from nb where kind = 'login' and email is not null group by 1), te as (select lower(email) address, min(person) p from nb where kind = 'tracker' and email is not null group by 1),
st as (select id, person person_id, 'anchor' tier from nb where person is not null union all select nb.id, coalesce(ve.p, te.p), case when ve.p is not null then 'verified' else 'tracker' end from nb left join ve using (address) left join te using (address) where kind = 'commit' and (ve.p is not null or te.p is not null)),
lo as (select * from nb where kind = 'commit' and id not in (select id from st)),
lq as (select a.id, min(b.id) other_id from lo a join nb b on b.kind = 'commit' and b.lp = a.lp and b.address <> a.address where a.lp <> 'noreply' and a.lp <> '' group by 1),
nq as (select a.id, min(b.id) other_id from lo a join nb b on b.person is not null and len(list_intersect(a.w, b.w)) >= case when len(a.w) = 1 or len(b.w) = 1 then 1 else 2 end where a.id not in (select id from lq) group by 1)"""


def accounts(t: Tables) -> DataFrame:
    """(id, kind, external_id, email, name, is_bot, person_id): logins, tracker accounts and addresses of commits."""
    made = [t.raw(table).selectExpr(*[f"{x} as {n}" for x, n in zip(own, _ACCOUNT_COLUMNS, strict=True)]) for table, own in _ACCOUNTS.items()]
    return made[0].union(made[1]).union(made[2]).withColumn("person_id", F.lit(None).cast("string"))


@metric("identity.stitch", _STITCH_SQL + " select id, person_id, tier from st", prelude=False)
def identity_stitch(t: Tables) -> DataFrame:
    """Accounts that belong to a person, by an anchor, a verified address or a tracker's."""
    return stitched(accounts(t))


@metric("identity.queue", _STITCH_SQL + " select id, other_id, 'local_part' reason, 0.8::double confidence from lq union all select id, other_id, 'like_name', 0.5 from nq", prelude=False)
def identity_queue(t: Tables) -> DataFrame:
    """What a reader is asked about each address that belongs to nobody: one other account at most, and why."""
    return suggestions(accounts(t))


@metric("history.as_of", "with v as (select user_id, event_type, ts valid_from, lead(ts) over (partition by user_id order by ts) valid_to from events qualify row_number() over (partition by user_id, ts order by event_id desc) = 1) select user_id, event_type from v where valid_from <= timestamp '2024-01-15' and (valid_to is null or valid_to > timestamp '2024-01-15')", prelude=False)
def history_as_of(t: Tables) -> DataFrame:
    """Each issue's effective-dated status as of a day."""
    rows = latest(t.raw("events").select("user_id", "ts", "event_id", "event_type"), ["user_id", "ts"], ["event_id"])
    held = effective(rows.withColumnRenamed("ts", "valid_from"), ["user_id"], "valid_from")
    return as_of(held, ["user_id"], F.lit("2024-01-15").cast("timestamp")).select("user_id", "event_type")


def _versions(t: Tables) -> tuple[DataFrame, DataFrame]:
    orders = t.raw("orders").selectExpr("o_orderkey as id", "o_totalprice as v", "o_orderdate as updated_at")
    new = orders.where("id % 3 = 0").selectExpr("id + case when id % 6 = 0 then 0 else 1000000 end as id", "v * 2 as v", "timestampadd(DAY, case when id % 4 = 0 then -1 else 1 end, updated_at) as updated_at")
    return orders, new


_VERSIONS = "with old as (select o_orderkey id, o_totalprice v, o_orderdate updated_at from orders), new as (select id + case when id % 6 = 0 then 0 else 1000000 end id, v * 2 v, updated_at + to_days(case when id % 4 = 0 then -1 else 1 end) updated_at from old where id % 3 = 0)"


@metric("store.upsert", _VERSIONS + ", b as (select *, 0 f from old union all select *, 1 from new) select id, round(v, 6) v from (select *, row_number() over (partition by id order by updated_at desc, f desc) r from b) where r = 1", prelude=False)
def store_upsert(t: Tables) -> DataFrame:
    """Last writer wins on the time of the update."""
    old, new = _versions(t)
    return upsert(old, new, ["id"], "updated_at").select("id", rounded(F.col("v")).alias("v"))


@metric("store.append_ignore", _VERSIONS + " select id, round(v, 6) v from old union all select id, round(v, 6) from new where id not in (select id from old)", prelude=False)
def store_append_ignore(t: Tables) -> DataFrame:
    """Appended rows whose key is there already are ignored."""
    old, new = _versions(t)
    return append_ignore(old, new, ["id"]).select("id", rounded(F.col("v")).alias("v"))


@metric("store.tombstone", "select count(*) n, count(*) filter (c_custkey % 7 = 0 or c_custkey % 11 = 0) deleted from customer", prelude=False)
def store_tombstone(t: Tables) -> DataFrame:
    """Rows that the live listing lacks are marked deleted."""
    stored = t.raw("customer").select("c_custkey", F.when(F.col("c_custkey") % 11 == 0, F.lit("2020-01-01").cast("timestamp")).alias("deleted_at"))
    marked = tombstone(stored, stored.where("c_custkey % 7 <> 0"), ["c_custkey"], F.lit("2024-01-01").cast("timestamp"))
    return marked.agg(F.count(F.lit(1)).alias("n"), F.count("deleted_at").alias("deleted"))


@metric("store.prune", "with o as (select * from orders where o_orderdate >= timestamp '1998-01-01') select 'orders' \"table\", (select count(*) from orders) before, count(*) after from o union all select 'lineitem', (select count(*) from lineitem), (select count(*) from lineitem where l_orderkey in (select o_orderkey from o))", prelude=False)
def store_prune(t: Tables) -> DataFrame:
    """What retention would keep of orders and their lines: the dry run."""
    tables = {"orders": t.raw("orders").withColumn("l_orderkey", F.col("o_orderkey")), "lineitem": t.lineitem}
    kept = prune(tables, {"orders": "o_orderdate"}, F.lit("1998-01-01 13:00:00").cast("timestamp"), {"lineitem": ("orders", ["l_orderkey"])})
    row = lambda name: tables[name].agg(F.count(F.lit(1)).alias("before")).join(kept[name].agg(F.count(F.lit(1)).alias("after"))).select(F.lit(name).alias("table"), "before", "after")  # noqa: E731  a row each
    return row("orders").union(row("lineitem"))
