"""Snapshots with late data, versions, freshness, people and cohorts."""

import datetime as dt
import statistics

import pytest
from pyspark.sql import functions as F

from tidemark.plans import person_report, rederive
from tidemark.plans.catalog import ENGINE_VERSION
from tidemark.sources import sinks
from tidemark.tables import Tables

D = dt.date
CELLS = "scope string, metric string, day date, value double, data_quality string, engine_version string, stale boolean"


@pytest.fixture
def cells(spark):
    rows = [("a", "m", D(2024, 1, d), float(d), "ok", ENGINE_VERSION, False) for d in (1, 2, 3, 4)]
    return spark.createDataFrame([*rows, ("b", "m", D(2024, 1, 2), 9.0, "ok", "0.0.1", False)], CELLS)


def test_late_days_make_trailing_cells_stale(spark, cells):
    late = spark.createDataFrame([("a", D(2024, 1, 2)), ("a", D(2024, 1, 2))], "scope string, day date")
    got = {(r["scope"], r["day"].day) for r in rederive.mark_stale(cells, late, 2).where("stale").collect()}
    assert got == {("a", 2), ("a", 3)}


def test_rederive_replaces_what_is_due_and_flags_what_fails(cells):
    stale = cells.withColumn("stale", F.col("day") == F.lit("2024-01-03").cast("date"))
    compute = lambda due: due.where("scope = 'a'").withColumns({"value": F.lit(-1.0), "data_quality": F.lit("ok")})
    got = {(r["scope"], r["day"].day): (r["value"], r["data_quality"], r["stale"]) for r in rederive.rederive(stale, compute).collect()}
    assert got == {("a", 1): (1.0, "ok", False), ("a", 2): (2.0, "ok", False), ("a", 3): (-1.0, "ok", False), ("a", 4): (4.0, "ok", False), ("b", 2): (9.0, "rederive_failed", False)}


def test_versions_dont_mix(cells):
    assert rederive.one_version(cells).count() == 5
    with pytest.raises(rederive.MixedVersions):
        rederive.one_version(cells.withColumn("engine_version", F.when(F.col("day") == F.lit("2024-01-01").cast("date"), "x").otherwise("y")))


def test_windows_close_and_old_data_is_refused(spark, cells):
    at = lambda s: F.lit(s).cast("timestamp")
    day = spark.createDataFrame([(D(2024, 1, 1),)], "day date")
    told = lambda mark, now: day.select(rederive.closed(F.col("day"), at(mark), at(now))).first()[0]
    assert told("2024-01-02", "2024-01-04") and not told("2024-01-01 23:59:59", "2024-01-09") and not told("2024-01-02", "2024-01-03 23:00:00") and not told(None, "2024-01-09")
    served = {now: rederive.serve(cells, at("2024-01-05"), at(now)).first() for now in ("2024-01-05 01:00:00", "2024-01-05 05:00:00", "2024-01-06")}
    assert [r["freshness"] for r in served.values()] == ["ok", "warn", "refused"] and served["2024-01-06"]["value"] is None


def test_cohorts(spark):
    xs = [1.0, 2.0, 2.0, 3.0, 3.0, 4.0, 5.0, 30.0]
    rows = spark.createDataFrame([("person.bugfix_share", i, x) for i, x in enumerate(xs)] + [("person.pr_atomicity", i, 1.0) for i in range(7)], "metric string, person_id long, value double")
    got = {(r["metric"], r["person_id"]): r for r in person_report.against_cohort(rows).collect()}
    med, mad = statistics.median(xs), statistics.median(abs(x - 3.0) for x in xs)
    sd = max(statistics.stdev(xs), 1.4826 * mad)
    r = got[("person.bugfix_share", 7)]
    assert abs(r["z"] - (30 - med) / sd) < 1e-9 and r["band"] == "outlier" and r["percentile"] == 1.0
    assert got[("person.bugfix_share", 1)]["percentile"] == 3 / 8 and got[("person.pr_atomicity", 0)]["z"] is None


def test_difference_in_differences(spark):
    schema = "metric string, person_id long, value double"
    a = spark.createDataFrame([("m", 1, 1.0), ("m", 2, 1.0), ("m", 3, 2.0)], schema)
    b = spark.createDataFrame([("m", 1, 5.0), ("m", 2, 2.0), ("m", 3, 3.0), ("m", 4, 9.0)], schema)
    assert person_report.difference_in_differences(a, b, [1]).first()["did"] == 3.0


def test_a_persons_report(spark, data):
    only = ["person.bugfix_share", "person.ticket_linkage_rate"]
    got = person_report.values(Tables(spark, data), only)
    someone = got.first()["person_id"]
    report = person_report.person(Tables(spark, data), someone, only)
    assert {r["metric"] for r in report.collect()} <= set(only) and report.count() >= 1


def test_files_out(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c')], "x int, y string")
    sinks.write_csv(df, f"file://{tmp_path}/c")
    sinks.write_json(df, f"file://{tmp_path}/j")
    assert spark.read.option("header", True).option("escape", '"').csv(f"file://{tmp_path}/c").first()["y"] == 'a "b", c'
    assert spark.read.json(f"file://{tmp_path}/j").first()["y"] == 'a "b", c'
