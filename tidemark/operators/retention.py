"""Retention over tables that refer to each other: what is old goes, what hangs on it follows, texts go before rows."""

from __future__ import annotations

from dataclasses import dataclass, field
from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import fresh_folder, staged


@dataclass(frozen=True)
class Rule:
    """How one table ages.

    ``time`` is the column that rows age by (null times never do); ``parents`` maps a table to the columns
    {own: its} that refer to it; ``needs`` names tables of which one has to refer here still, of rows to which any
    did before; ``texts`` are columns that are emptied once ``texts_time`` is older than the texts' cutoff.
    """

    time: str | None = None
    parents: dict[str, dict[str, str]] = field(default_factory=dict)
    needs: tuple[str, ...] = ()
    texts: tuple[str, ...] = ()
    texts_time: str | None = None


def _refers(child: DataFrame, on: dict[str, str], parent: DataFrame, how: str) -> DataFrame:
    keys = parent.select(*[F.col(p).alias(f"__p{i}") for i, p in enumerate(on.values())]).distinct()
    match = [F.col(c) == F.col(f"__p{i}") for i, c in enumerate(on)]
    return child.join(keys, match, how)


def retained(tables: dict[str, DataFrame], rules: dict[str, Rule], cutoff: Column, texts_cutoff: Column | None = None) -> dict[str, DataFrame]:
    """What each table keeps: a plan, nothing is written.

    A row goes if it is older than the day of ``cutoff`` or one that it refers to goes or is not there; a null
    reference refers to nothing.  Parents come before children; then rows that others have to refer to go once
    none does any more, from the children up, which lets nothing else go.  A table that refers to itself is gone
    over until nothing more goes.
    """
    day = F.date_trunc("DAY", cutoff)
    kept = {}
    order = list(TopologicalSorter({n: {p for p in r.parents if p != n} for n, r in rules.items()}).static_order())
    for name in order:
        rule, rows = rules[name], tables[name]
        if rule.time:
            rows = rows.where(F.col(rule.time).isNull() | (F.col(rule.time) >= day))
        for parent, on in rule.parents.items():
            if parent == name:
                rows = _without_lost(rows, on)
                continue
            nothing = F.lit(False)
            for own in on:
                nothing = nothing | F.col(own).isNull()
            rows = _refers(rows.where(~nothing), on, kept[parent], "left_semi").unionByName(rows.where(nothing))
        if rule.texts:
            gone = F.col(rule.texts_time or rule.time) < F.date_trunc("DAY", texts_cutoff if texts_cutoff is not None else cutoff)
            rows = rows.withColumns({c: F.when(~F.coalesce(gone, F.lit(False)), F.col(c)) for c in rule.texts})
        kept[name] = rows
    for name in reversed(order):
        for child in rules[name].needs:
            on = {p: c for c, p in rules[child].parents[name].items()}
            never = _refers(kept[name], on, tables[child], "left_anti")
            kept[name] = _refers(kept[name], on, kept[child], "left_semi").unionByName(never)
    return kept


def _without_lost(rows: DataFrame, on: dict[str, str]) -> DataFrame:
    """Rows whose chain of references within the table reaches no row that is gone."""
    now = staged(rows, "retained")
    while True:
        whole = F.lit(False)
        for own in on:
            whole = whole | F.col(own).isNull()
        after = staged(_refers(now.where(~whole), on, now, "left_semi").unionByName(now.where(whole)), "retained")
        if after.count() == now.count():
            return after
        now = after


def counts(tables: dict[str, DataFrame], kept: dict[str, DataFrame], rules: dict[str, Rule]) -> DataFrame:
    """(table, before, after, texts): the dry run's report; ``texts`` counts texts that rows which stay lose."""
    out = None
    for name, rows in kept.items():
        texts = list(rules[name].texts)
        full = lambda df, texts=texts: sum((F.count(c) for c in texts), F.lit(0)).cast("long")
        had = tables[name].agg(F.count(F.lit(1)).alias("before"))
        has = rows.agg(F.count(F.lit(1)).alias("after"), full(rows).alias("full"))
        stay = sum(1 for _ in texts)
        row = had.join(has).select(F.lit(name).alias("table"), "before", "after", (F.col("after") * stay - F.col("full")).alias("texts"))  # a row each
        out = row if out is None else out.union(row)
    return out


def apply(tables: dict[str, DataFrame], rules: dict[str, Rule], cutoff: Column, texts_cutoff: Column | None = None, path: str | None = None) -> dict[str, DataFrame]:
    """Write what is kept to new folders and read it back: the real run; the old folders stay until their owner drops them."""
    spark = next(iter(tables.values())).sparkSession
    kept = retained(tables, rules, cutoff, texts_cutoff)
    out = {}
    for name, rows in kept.items():
        folder = f"{path or fresh_folder(spark, 'retained')}/{name}"
        rows.write.parquet(folder)
        out[name] = spark.read.schema(rows.schema).parquet(folder)
    return out
