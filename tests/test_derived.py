"""Blame, retention over tables that refer to each other, reports against a baseline, weekly panels."""

import datetime as dt
import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import retention
from tidemark.operators.blame import blame_of, owned_bits, work_types, work_types_by_author
from tidemark.plans import report_model
from tidemark.plans.catalog import ENGINE_VERSION
from tidemark.session import fresh_folder
from tidemark.sources.snapshot_store import SCHEMA, SnapshotStore
from tidemark.tables import Tables

T0 = datetime(2024, 1, 1)
CHANGES = "path long, id long, author long, at timestamp, first_line int, last_line int"


def some_changes(r, n, lines=400):
    out = []
    for i in range(n):
        first = r.randint(1, lines)
        out.append((r.randint(0, 2), i // 2, r.randint(0, 3), T0 + timedelta(hours=r.randint(0, 24 * 90)), first, first + r.choice([-1, 0, 5, 70, 200])))
    return out


def test_blame_and_work_types_line_by_line(spark):
    r = random.Random(6)
    history, hunks = some_changes(r, 120), some_changes(r, 80)
    owner = {}
    for path, i, author, at, a, b in sorted(history, key=lambda c: (c[3], c[1], c[2])):
        for line in range(a, b + 1):
            held = owner.get((path, line))
            if held is None or (at, i) >= held[:2]:
                owner[path, line] = (at, i, author)
    blame = blame_of(spark.createDataFrame(history, CHANGES))
    got = {}
    for x in blame.collect():
        for line in range(x.first_line, x.last_line + 1):
            assert (x.path, line) not in got
            got[x.path, line] = (x.changed_at, x.author)
    assert got == {k: (v[0], v[2]) for k, v in owner.items()}
    rows = [(i, *h[0:1], *h[2:]) for i, h in enumerate(hunks)]
    kinds = work_types(spark.createDataFrame(rows, "hunk long, path long, author long, at timestamp, first_line int, last_line int"), blame, 30).collect()
    assert len(kinds) == len(rows)
    for x in kinds:
        _, path, author, at, a, b = rows[x.hunk]
        want = defaultdict(int)
        for line in range(a, b + 1):
            if (path, line) not in owner:
                want["new"] += 1
            elif at > owner[path, line][0] + timedelta(days=30):
                want["legacy_refactor"] += 1
            else:
                want["rework" if owner[path, line][2] == author else "help_others"] += 1
        assert (x.lines, x.new, x.legacy_refactor, x.help_others, x.rework) == (max(b - a + 1, 0), want["new"], want["legacy_refactor"], want["help_others"], want["rework"])


def test_work_by_author_needs_no_row_a_line(spark):
    r = random.Random(9)
    edges = [(0, 900, 1, T0, 1, 64), (0, 901, 2, T0, 64, 65), (0, 902, 3, T0 + timedelta(days=80), 128, 128), (1, 903, 1, T0, 65, 128)]
    history, later = edges + some_changes(r, 60), [(*c[:3], c[3] + timedelta(days=60), *c[4:]) for c in edges + some_changes(r, 60)]
    owner = {}
    for path, i, author, at, a, b in sorted(history, key=lambda c: (c[3], c[1], c[2])):
        owner |= {(path, line): (at, author) for line in range(a, b + 1)}
    want = defaultdict(lambda: defaultdict(int))
    for path, _, author, at, a, b in later:
        for line in range(a, b + 1):
            held = owner.get((path, line))
            kind = "new" if held is None else "legacy_refactor" if at > held[0] + timedelta(days=30) else "rework" if held[1] == author else "help_others"
            want[author][kind] += 1
    got = work_types_by_author(spark.createDataFrame(later, CHANGES), spark.createDataFrame(history, CHANGES), 30).where("lines > 0").collect()
    kinds = ("new", "legacy_refactor", "help_others", "rework")
    assert {x.author: [x[k] for k in kinds] for x in got} == {k: [v[c] for c in kinds] for k, v in want.items()}
    assert all(x.lines == sum(x[k] for k in kinds) for x in got)
    # A hundred changes of all of 6,400 lines are a row a stretch each, of which the latest are left.
    whole = spark.range(100).selectExpr("0L as path", "id", "id as author", "timestamp '2024-01-01' as at", "1 as first_line", "6400 as last_line")
    owned = owned_bits(whole)
    assert [tuple(x) for x in owned.select("id", "bits").distinct().collect()] == [(99, -1)] and owned.count() == 100


def test_retention_goes_down_and_up_the_tables(spark):
    day = lambda d: datetime(2024, 1, d, 13)
    tables = {
        "person": spark.createDataFrame([(1,), (2,), (3,)], "person_id long"),
        "pr": spark.createDataFrame([(10, 1, day(5)), (11, 1, day(20)), (12, 2, day(3)), (13, None, None), (14, 9, day(20))], "pr_id long, owner long, at timestamp"),
        "file": spark.createDataFrame([(100, 10, "a"), (101, 11, "b"), (102, 12, "c"), (103, 13, "d"), (104, 11, "e")], "file_id long, pr long, patch string").withColumn("at", F.when(F.col("file_id") == 104, F.lit(day(12))).otherwise(F.lit(day(25)))),
        "note": spark.createDataFrame([(1000, 100, None), (1001, 101, None), (1002, 103, 1001), (1003, 101, 1000), (1004, 101, 1003)], "note_id long, file long, reply long"),
    }
    rules = {
        "person": retention.Rule(needs=("pr",)),
        "pr": retention.Rule(time="at", parents={"person": {"owner": "person_id"}}),
        "file": retention.Rule(parents={"pr": {"pr": "pr_id"}}, texts=("patch",), texts_time="at"),
        "note": retention.Rule(parents={"file": {"file": "file_id"}, "note": {"reply": "note_id"}}),
    }
    cutoff, texts = F.lit("2024-01-10 18:00:00").cast("timestamp"), F.lit("2024-01-15").cast("timestamp")
    kept = retention.retained(tables, rules, cutoff, texts)
    ids = {n: {r[0] for r in df.collect()} for n, df in kept.items()}
    # 10 and 12 are old, 14 names nobody; 1's other request stays; 3 never had any; 1003 answers what is gone, 1004 that.
    assert ids == {"pr": {11, 13}, "person": {1, 3}, "file": {101, 103, 104}, "note": {1001, 1002}}
    assert {r.file_id: r.patch for r in kept["file"].collect()} == {101: "b", 103: "d", 104: None}
    said = {r["table"]: (r.before, r.after, r.texts) for r in retention.counts(tables, kept, rules).collect()}
    assert said == {"person": (3, 2, 0), "pr": (5, 2, 0), "file": (5, 3, 1), "note": (5, 2, 0)}
    written = retention.apply(tables, rules, cutoff, texts)
    assert {n: {r[0] for r in df.collect()} for n, df in written.items()} == ids
    again = retention.retained(written, rules, cutoff, texts)
    assert {n: df.count() for n, df in again.items()} == {n: len(x) for n, x in ids.items()}


def told(spark, v, base):
    n, values = len(base), spark.createDataFrame([("k", float(x)) for x in base], "key string, value double")
    row = report_model.summaries(values, ["key"]).withColumn("v", F.lit(v))
    parts = report_model.judged(F.col("v"), *[F.col(c) for c in ("n", "p50", "mean", "sd", "mad")])
    x = row.select(*[c.alias(k) for k, c in parts.items()], report_model.drifted(F.col("v"), F.col("p50"), F.col("sd"), F.col("mad")).alias("drift")).first()
    assert n == len(base)
    return x


@pytest.mark.parametrize(("v", "band", "drift"), [(10.05, "in_line", "stable"), (11.5, "above", "shifting"), (14.0, "well_above", "regime_change"), (8.9, "below", "shifting"), (10.0, "in_line", "stable"), (5.0, "well_below", "regime_change")])
def test_a_flat_baseline_judges_by_shares(spark, v, band, drift):
    x = told(spark, v, [10] * 6)
    assert (x.band, x.drift, x.z) == (band, drift, None)


def test_a_baseline_with_spread_judges_by_deviations(spark):
    base = [8, 9, 10, 11, 12, 10]
    x = told(spark, 14.0, base)
    assert x.band == "well_above" and x.arrow == "up" and x.significant and x.drift == "regime_change" and x.z == pytest.approx(4 / (10 / 5) ** 0.5)
    assert told(spark, 10.2, base).band == "in_line" and told(spark, 9.0, base).band == "below"
    assert told(spark, 1.0, [0] * 5).band == "well_above" and told(spark, 1.0, [10] * 4).band == "unknown"


def test_only_cells_without_a_snapshot_are_worked_out(spark):
    D = lambda m, d: dt.date(2024, m, d)
    cell = lambda s, m, day, v, stale=False: (s, m, day, 1, v, None, "ok", ENGINE_VERSION, T0, stale)
    rows = [cell("a", "x", D(1, d), 10.0) for d in range(2, 12)] + [cell("a", "x", D(3, 5), 14.0), cell("a", "x", D(3, 6), None), cell("a", "x", D(3, 7), 99.0, True), cell("b", "x", D(3, 9), None), cell("a", "y", D(3, 9), 5.0, True)]
    store = SnapshotStore(spark, fresh_folder(spark, "s"))
    store.put(spark.createDataFrame(rows, SCHEMA))
    asked = spark.createDataFrame([("a", "x"), ("b", "x"), ("a", "y"), ("c", "x")], "scope string, metric string")
    seen = []

    def live(missing):
        seen.append({tuple(r) for r in missing.collect()})
        return missing.where("scope <> 'c'").withColumn("value", F.lit(7.0))

    got = {(r.scope, r.metric): r for r in report_model.report_cells(store, asked, "2024-03-01", "2024-03-30", live).collect()}
    assert seen == [{("a", "y"), ("c", "x")}]
    x = got["a", "x"]
    assert (x.value, x.source, x.n, x.baseline_p50, x.band, x.arrow, x.percentile) == (14.0, "stored", 10, 10.0, "well_above", "up", 1.0)
    assert (got["b", "x"].value, got["b", "x"].source, got["b", "x"].band) == (None, "stored", "unknown")
    assert (got["a", "y"].value, got["a", "y"].source) == (7.0, "live") and got["c", "x"].source is None


def test_more_weeks_read_no_more(spark, data):
    t = Tables(spark, data)
    scans = [report_model.weekly_panel(t, w)._jdf.queryExecution().optimizedPlan().toString().count("Relation [") for w in (1, 13)]
    assert scans[0] == scans[1]
    rows = report_model.weekly_panel(t, 13).collect()
    assert len(rows) == 13 * len({r.person_id for r in rows}) == len({(r.person_id, r.week) for r in rows})
