"""The read-only SQL door: one query of known views and functions, told by its parsed plan, within time, rows and bytes."""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.sinks import MOST_BYTES, ROWS, within_budget

SECONDS = 10


#: Functions that a query may call: none reads files, calls Java, or looks at the session, and none makes much of a
#: little (repeat, sequence, pads, widths of formats): constants are folded before any budget holds.
FUNCTIONS = frozenset(
    """abs acos any between approx_count_distinct array array_agg array_contains array_distinct array_join array_max array_min array_position array_size array_sort arrays_overlap
    ascii asin atan atan2 avg bit_and bit_count bit_or bool_and bool_or bround btrim cardinality cast cbrt ceil ceiling char_length character_length coalesce collect_list collect_set
    concat concat_ws contains corr cos count count_if covar_pop covar_samp cume_dist current_date current_timestamp curdate date date_add date_diff date_format date_from_unix_date date_part date_sub date_trunc
    dateadd datediff day dayofmonth dayofweek dayofyear degrees dense_rank element_at elt endswith every exists exp explode extract filter find_in_set first first_value flatten floor forall format_number format_string
    from_json from_unixtime get get_json_object greatest hash hour if ifnull in initcap instr isnan isnotnull isnull json_array_length kurtosis lag last last_day last_value lcase lead least left len length levenshtein like ln locate
    log log10 log2 lower ltrim make_date map map_from_arrays map_keys map_values max max_by md5 mean median min min_by minute mod mode month months_between named_struct negative nth_value ntile nullif nullifzero nvl nvl2
    octet_length overlay percent_rank percentile percentile_approx percentile_cont percentile_disc pi pmod position pow power quarter radians rank regexp regexp_count regexp_extract regexp_extract_all regexp_instr regexp_like regexp_replace
    regexp_substr regr_count regr_r2 regr_slope replace reverse right rint rlike round row_number rtrim second sha2 sign signum sin size skewness slice some sort_array split split_part sqrt startswith std stddev stddev_pop
    stddev_samp str_to_map struct substr substring substring_index sum tan timestamp timestamp_micros timestamp_millis timestamp_seconds timestampadd timestampdiff to_char to_date to_json to_number to_timestamp to_unix_timestamp
    transform translate trim trunc try_add try_avg try_cast try_divide try_element_at try_multiply try_subtract try_sum try_to_date try_to_number try_to_timestamp typeof ucase unix_date unix_micros unix_millis unix_seconds unix_timestamp upper
    var_pop var_samp variance weekday weekofyear width_bucket window xxhash64 year zeroifnull""".split()
)
#: Kinds of nodes of a parsed query.
NODES = frozenset(
    """Project Filter Aggregate Sort GlobalLimit LocalLimit Limit LimitAll Offset Join LateralJoin AsOfJoin UnresolvedRelation SubqueryAlias UnresolvedSubqueryColumnAliases UnresolvedWith OneRowRelation Distinct Union Intersect Except
    Window WithWindowDefinition UnresolvedHaving UnresolvedInlineTable ResolvedInlineTable LocalRelation Pivot Unpivot UnpivotTransformer Generate Sample GroupingSets UnresolvedOrdinal Deduplicate""".split()
)
SUBQUERIES = ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery")


class Refused(ValueError):
    """The text is no single read-only query of the engine's views."""


def _each(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _walk(plan, views: set[str]) -> None:
    """Refuse what a parsed plan holds besides known nodes over ``views`` and known functions, in subqueries, too."""
    kind = plan.getClass().getSimpleName().rstrip("$")
    if kind not in NODES:
        raise Refused(f"only queries may run, without {kind}")
    if kind == "UnresolvedRelation":
        name = [str(x) for x in _each(plan.multipartIdentifier())]
        if len(name) != 1 or name[0].lower() not in views:
            raise Refused(f"no such table: {'.'.join(name)}")
    if kind == "UnresolvedWith":
        for relation in _each(plan.cteRelations()):
            views = views | {str(relation._1()).lower()}
        for relation in _each(plan.cteRelations()):
            _walk(relation._2(), views)
    todo = _each(plan.expressions())
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind in ("UnresolvedFunction", "UnresolvedGenerator", "UnresolvedTVFAliases"):
            parts = [str(x) for x in (_each(node.nameParts()) if kind == "UnresolvedFunction" else [node.name().funcName()])]
            if len(parts) != 1 or parts[0].lower() not in FUNCTIONS:
                raise Refused(f"no such function: {'.'.join(parts)}")
        if "Identifier" in kind or "Parameter" in kind or "Variable" in kind or "Invoke" in kind or "Reflect" in kind:
            raise Refused(f"only queries may run, without {kind}")
        if kind in SUBQUERIES:
            _walk(node.plan(), views)
        elif "Subquery" in kind and kind != "InSubquery":
            raise Refused(f"only queries may run, without {kind}")
        todo += _each(node.children())
    for child in _each(plan.children()):
        _walk(child, views)


def read_only(spark: SparkSession, text: str, views: list[str] | None = None) -> DataFrame:
    """The query's plan, if it is one; nothing runs.

    Spark's own parser decides, so comments and literals can't hide anything: the parsed plan may hold
    nodes of queries, calls of ``FUNCTIONS`` and relations named in ``views`` (by default the session's
    temporary views) or by the query itself.  Paths of files, functions that call Java or look at the
    session, commands and several statements are refused.  Commands would run as soon as they are analysed,
    so the text is only parsed until it is known to be none.
    """
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parseQuery(text)
    except Exception as e:
        raise Refused(str(e).splitlines()[0]) from None
    known = views if views is not None else [x.name for x in spark.catalog.listTables() if x.isTemporary]
    _walk(plan, {v.lower() for v in known})
    return spark.sql(text)


def run(spark: SparkSession, text: str, rows: int = ROWS, most_bytes: int = MOST_BYTES, seconds: float = SECONDS, views: list[str] | None = None) -> dict:
    """The query's rows within its budget; its jobs are cancelled when its time is over."""
    df = read_only(spark, text, views)
    tag = f"query-{uuid.uuid4().hex}"
    spark.addTag(tag)
    clock = threading.Timer(seconds, lambda: spark.interruptTag(tag))
    clock.start()
    try:
        return within_budget(df, rows, most_bytes)
    finally:
        clock.cancel()
        spark.removeTag(tag)
