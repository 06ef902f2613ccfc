"""The queries of this subpackage, by name, and DuckDB SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Whoever runs this on real data passes a key of their own.
KEY = b"tidemark public example key"


def op1_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.pii import with_pseudonyms

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_pseudonyms(docs, KEY).select("doc_id", "text", "private.*")


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.licences import licence_report

    return licence_report(_table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.bpe import round_trip

    return round_trip(_table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.secrets import secret_report

    return secret_report(_table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.tokenstore import token_file_round_trip

    return token_file_round_trip(_table(spark, sf_dir, "documents"), end_id=2)


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.ann import nearest

    return nearest(_table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", k=20)


#: The target weights of the mixing query: the largest source most, the pool of unnamed sources least.
WEIGHTS = {"src0": 8} | {f"src{i}": 3 for i in range(1, 5)} | {f"src{i}": 2 for i in range(5, 10)} | {f"src{i}": 1 for i in range(10, 20)}


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.mixing import mix

    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs, WEIGHTS).select("doc_id", "source", "mix.*")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.sharding import shard_documents

    return shard_documents(_table(spark, sf_dir, "documents"), shards=24)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.simhash import simhash_components

    return simhash_components(_table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.quality import with_quality

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return with_quality(docs).select("doc_id", "quality.*")


def op11_pareto(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.pareto import offer_layers

    return offer_layers(*(_table(spark, sf_dir, t) for t in ("sale_lines", "sales", "items")))


def op12_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.winnowing import edited_report

    return edited_report(_table(spark, sf_dir, "documents"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.divergence import source_divergence

    return source_divergence(_table(spark, sf_dir, "documents").select("text", "lang", "source"))


def _pareto_sql(most: int = 12) -> str:
    """Layers by peeling: what nothing left dominates goes, again and again; null is the least number here."""
    cents = lambda x: f"case when isfinite({x}) then floor(100.0::double * {x} + 0.5::double)::bigint end"
    floor_div = lambda a, b: f"(({a}) // nullif({b}, 0) - case when ({a}) % nullif({b}, 0) <> 0 and (({a}) < 0) <> (({b}) < 0) then 1 else 0 end)::bigint"
    worse = "b.p <= a.p and b.d <= a.d and b.y <= a.y and b.q <= a.q and (b.p < a.p or b.d < a.d or b.y < a.y or b.q < a.q)"
    peel = ", ".join(f"l{i} as materialized (select * from r{i - 1} a where not exists (select 1 from r{i - 1} b where b.t = a.t and {worse})), r{i} as materialized (select * from r{i - 1} anti join l{i} using (t, p, d, y, q))" for i in range(1, most + 1))
    return f"""with s as (select sale_id, min(sold_at)::date sold from sales group by 1), i as (select item_id, min(brand) brand, min(price) filter (not isnan(price)) price from items group by 1),
n as (select l.item_id, vendor_id, quantity::bigint q, {cents("amount")} c, {cents("discount")} d, date_diff('day', sold, shipped_at::date) y from sale_lines l left join s using (sale_id) where l.item_id is not null and vendor_id is not null),
g as (select item_id, vendor_id, sum(c::hugeint * (100 - d)) filter (q is not null) cd, sum(q) filter (c is not null and d is not null) qs, sum(d) ds, count(d) dn, sum(y) ys, count(y) yn, max(q) quantity from n group by 1, 2),
m as (select item_id, vendor_id, brand part_type, case when {cents("price")} >= 1 then {floor_div("cd", f"{cents('price')}::hugeint * qs")} end price, {floor_div("ds", "dn")} discount, {floor_div("ys", "yn")} delay, quantity from g left join i using (item_id)),
k as (select *, coalesce(price, -9223372036854775808) p, coalesce(-discount, -9223372036854775808) d, coalesce(delay, -9223372036854775808) y, coalesce(-quantity, -9223372036854775808) q, coalesce('=' || part_type, '') t from m),
r0 as materialized (select distinct t, p, d, y, q from k union all select distinct 'all', p, d, y, q from k), {peel},
l as ({" union all ".join(f"select *, {i}::bigint layer from l{i}" for i in range(1, most + 1))}),
e as (select p, d, y, q, count(*) n_equal from k group by 1, 2, 3, 4)
select item_id, vendor_id, part_type, price, discount, delay, quantity, coalesce(a.layer, 0)::bigint type_layer, coalesce(b.layer, 0)::bigint global_layer, n_equal
from k join e using (p, d, y, q) left join l a on a.t = k.t and a.p = k.p and a.d = k.d and a.y = k.y and a.q = k.q left join l b on b.t = 'all' and b.p = k.p and b.d = k.d and b.y = k.y and b.q = k.q"""


def _divergence_sql() -> str:
    """The audit of op13 in SQL: every kept term against every source of its language."""
    share = lambda n, total, v: f"(1 + (1000000000::hugeint * ({n} + 5)) // ({total} + 5 * {v}))::bigint"
    return f"""with d as (select row_number() over () rid, coalesce(lang, '') lang, coalesce(source, '') source, coalesce(text, '') t from documents),
o as (select rid, lang, source, translate(unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') term from d),
k as (select lang, term, count(*) total from o group by 1, 2 having count(distinct rid) >= 30),
v as (select lang, count(*) v, sum(total)::bigint total from k group by 1),
g as (select distinct lang, source from d),
c as (select lang, source, term, count(*) n from o semi join k using (lang, term) group by 1, 2, 3),
s as (select lang, source, sum(n)::bigint total from c group by 1, 2),
p as (select lang, source, term, coalesce(n, 0) n, {share("coalesce(n, 0)", "coalesce(s.total, 0)", "v.v")} p, {share("k.total", "v.total", "v.v")} q from g join k using (lang) join v using (lang) left join s using (lang, source) left join c using (lang, source, term)),
f as (select a.lang, a.source, b.source item, sum(abs(a.p - b.p))::bigint f from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
r as (select g.lang, g.source, 'pair' part, h.source item, coalesce(f, 0)::bigint as value from g join g h on g.lang = h.lang and g.source <> h.source left join f on f.lang = g.lang and f.source = g.source and f.item = h.source
 union all select lang, source, 'term', term, p - q from p where n > 0 and p > q)
select lang, source, part, item, value, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank from r qualify part = 'pair' or rank <= 50"""


def _secrets_sql() -> str:
    """The scan of op4 in SQL: spans from what splitting at a pattern leaves, weak parts by an interval join."""
    from tidemark.llm.secrets import ACCESS, ASSIGN, ENDPOINT, HEX, ID, KINDS, MIXED, SCOPE, TOKEN

    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    found = " union all ".join(f"select rid, {k} k, string_split_regex(t, {quoted(p)}) g, regexp_extract_all(t, {quoted(p)}) x from d where regexp_matches(t, {quoted(p)})" for k, p in enumerate((ASSIGN, ACCESS, HEX, ID, TOKEN, ENDPOINT)))
    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    near = lambda kinds: f"exists (select 1 from p q where q.rid = p.rid and q.k in {kinds} and abs(q.s - p.s) <= {SCOPE})"
    return f"""with d as (select row_number() over () rid, doc_id, coalesce(text, '') t from documents), m as ({found}),
u as (select rid, k, unnest(x) part, unnest(g[:len(x)]) gap, unnest(range(1, len(x) + 1)) i from m),
o as (select rid, k, part, sum(length(gap)) over w + sum(length(part)) over w - length(part) s from u window w as (partition by rid, k order by i)),
a as (select rid, k, s::bigint s, (s + length(part))::bigint e from o where (k <> 0 or length(regexp_extract(part, {quoted(ASSIGN)}, 2)) >= 8) and (k <> 4 or ({" and ".join(f"regexp_matches(part, '{m}')" for m in MIXED)}))),
p as (select * from a where k not in (3, 4) or not exists (select 1 from a b where b.rid = a.rid and (b.k = 5 or (a.k = 4 and b.k < 3)) and b.s < a.e and a.s < b.e)),
f as (select * from p where k < 3 or (k = 3 and {near("(0, 2, 4)")}) or (k = 4 and {near("(1, 3)")}) or (k = 5 and {near("(1, 3)")} and {near("(0, 2, 4)")})),
r as (select rid, count(*) filter (k = 0) n_assign, count(*) filter (k = 1) n_access, count(*) filter (k = 2) n_hex, count(*) filter (k >= 3) n_linked,
 string_agg({names}[k + 1] || ':' || s || ':' || e, ',' order by s, k) filter (k < 3) base, string_agg({names}[k + 1] || ':' || s || ':' || e, ',' order by s, k) spans from f group by 1)
select doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans, coalesce(n_linked, 0) n_linked from d left join r using (rid)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pseudonyms, op2_licences, op3_bpe, op4_secrets, op5_token_files, op6_nearest, op7_mixing, op8_sharding, op9_simhash, op10_quality, op11_pareto, op12_winnowing, op13_divergence)}


def oracle_sql() -> dict[str, str]:
    """The other operators hold tokenisers, XXH64, keyed permutations, trees, schedules or a trained model."""
    return {"op4_secrets": _secrets_sql(), "op11_pareto": _pareto_sql(), "op13_divergence": _divergence_sql()}
