"""Sliding windows of counted values, backfills, and the store of snapshots."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.operators.sliding import counted_days, trailing
from tidemark.plans import backfill
from tidemark.plans.catalog import ENGINE_VERSION
from tidemark.session import fresh_folder, staged
from tidemark.sources.snapshot_store import SCHEMA, SnapshotStore
from tidemark.tables import Tables

D = dt.date


def r7(xs, p):
    xs = sorted(xs)
    at = (len(xs) - 1) * p
    low = int(at)
    return xs[low] + (at - low) * (xs[min(low + 1, len(xs) - 1)] - xs[low])


@pytest.mark.parametrize(("slices", "days", "spread"), [(2, 7, 3), (8, 30, 1000), (64, 5, 10**9)])
def test_trailing_percentiles(spark, slices, days, spread):
    r = random.Random(spread)
    rows = [(r.choice(["a", "a", "b", None]), D(2024, 1, 1) + dt.timedelta(r.randint(0, 59)), r.choice([None, float("nan"), float(r.randint(-spread, spread)), r.random()])) for _ in range(700)]
    rows.append(("lone", D(2024, 2, 3), 4.5))
    facts = spark.createDataFrame(rows, "k string, day date, v double").where("k is not null")
    got = trailing(staged(counted_days(facts, ["k"]), "t"), ["k"], "2024-01-20", "2024-02-28", days, {"low": 0.1, "mid": 0.5, "top": 1.0}, slices).collect()
    by = defaultdict(list)
    for k, day, v in rows:
        if k and v is not None and v == v:
            by[k].append((day, v))
    assert len(got) == 40 * 3 and len({(x.k, x.day) for x in got}) == len(got)
    for x in got:
        own = [v for day, v in by[x.k] if x.day - dt.timedelta(days) < day <= x.day]
        assert x.n == len(own) and x.total == pytest.approx(sum(own))
        for name, p in (("low", 0.1), ("mid", 0.5), ("top", 1.0)):
            assert x[name] == (pytest.approx(r7(own, p)) if own else None)


@pytest.fixture
def store(spark):
    return SnapshotStore(spark, fresh_folder(spark, "store"))


def cell(scope, day, value, watermark="2024-02-01", version=ENGINE_VERSION, stale=False):
    return (scope, "m", day, 1, value, None, "ok", version, dt.datetime.fromisoformat(watermark), stale)


def as_table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_a_write_replaces_its_days_only(spark, store):
    days = [D(2024, 1, d) for d in range(1, 11)]
    assert store.read().count() == 0
    store.put(as_table(spark, [cell(s, d, float(d.day)) for s in "ab" for d in days]))
    files = {f: f.split("day=")[1][:10] for f in store.read().inputFiles()}
    store.put(as_table(spark, [cell("a", D(2024, 1, 4), -1.0), cell("c", D(2024, 1, 12), 9.0)]))
    after = set(store.read().inputFiles())
    assert {f for f, d in files.items() if d != "2024-01-04"} <= after and not {f for f, d in files.items() if d == "2024-01-04"} & after
    got = {(r.scope, r.day.day): r.value for r in store.read().collect()}
    assert got == {(s, d.day): float(d.day) for s in "ab" for d in days} | {("a", 4): -1.0, ("c", 12): 9.0}


def test_a_range_lists_its_days_only(spark, store):
    store.put(as_table(spark, [cell("a", D(2024, 1, d), 1.0) for d in range(1, 31)]))
    some = store.read("2024-01-10", "2024-01-12")
    assert {r.day.day for r in some.collect()} == {10, 11, 12}
    listed = {f.split("day=")[1][:10] for f in some.inputFiles()}
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    scan = some._jdf.queryExecution().sparkPlan()
    while not scan.children().isEmpty():
        scan = scan.children().head()
    parts = scan.relation().location().listFiles(scan.partitionFilters(), scan.dataFilters())
    assert parts.size() == 3 and listed >= {"2024-01-10", "2024-01-11", "2024-01-12"}


def test_closed_fresh_cells_are_not_worked_out_again(spark, store):
    asked = spark.createDataFrame([("a", "m", D(2024, 1, d)) for d in range(1, 11)], "scope string, metric string, day date")
    seen = []

    def compute(due):
        seen.append(sorted(r.day.day for r in due.collect()))
        return due.select("*", F.lit(1).cast("long").alias("n"), F.lit(2.0).alias("value"), F.lit(None).cast("double").alias("p90"), F.lit("ok").alias("data_quality"))

    at = lambda s: F.lit(s).cast("timestamp")
    run = lambda mark, now: store.snapshot(asked, compute, at(mark), at(now))
    assert run("2024-01-11", "2024-01-11") == 10
    first = sorted(map(tuple, store.read().collect()))
    # Days 1 to 8 ended 48 hours ago or more; the others are open still.
    assert run("2024-01-11", "2024-01-11") == 2 and seen[-1] == [9, 10]
    assert sorted(map(tuple, store.read().collect())) == first
    assert run("2024-01-11", "2024-02-11") == 0 and len(seen) == 2
    store.mark_late(spark.createDataFrame([("a", D(2024, 1, 2)), ("b", D(2024, 1, 5))], "scope string, day date"), 3)
    assert run("2024-01-11", "2024-02-11") == 3 and seen[-1] == [2, 3, 4]
    store.put(as_table(spark, [cell("a", D(2024, 1, 7), 2.0, "2024-01-11", "0.0.0")]))
    assert run("2024-01-11", "2024-02-11") == 1 and seen[-1] == [7]
    assert run("2024-02-10", "2024-02-11") == 10
    assert {(r.value, r.stale, str(r.watermark)[:10]) for r in store.read().collect()} == {(2.0, False, "2024-02-10")}


def test_one_job_for_all_days_reads_each_table_once(spark, data):
    """Days don't multiply plans: scans are the same for a day and for a year."""
    t = Tables(spark, data)
    states = staged(backfill.day_states(t, ["pr.time_to_merge"]), "t")
    scans = [backfill.cells(states, first, "1998-12-31")._jdf.queryExecution().optimizedPlan().toString().count("Relation [") for first in ("1998-12-31", "1998-01-01")]
    assert scans[0] == scans[1]
