"""Ties and halves: results that the order of rows and the digits of doubles must not decide."""

import datetime as dt
from types import SimpleNamespace

import duckdb
from pyspark.sql import functions as F

from tidemark.functions.units import formatted
from tidemark.plans.people import feedback_response_latency
from tidemark.session import fresh_folder

T0 = dt.datetime(1996, 3, 1)


def test_reviews_of_one_instant_come_by_reviewer(spark):
    prs = spark.createDataFrame([(i, 9, "merged", T0) for i in range(5)], "id long, author_id long, state string, merged_at timestamp")
    bots = spark.createDataFrame([(77,)], "bot_id long")
    rows = [(i, 1, r, s, T0 + dt.timedelta(seconds=x)) for i in range(5) for r, s, x in ((2, "changes_requested", 0), (3, "approved", 0), (4, "commented", 100))]
    for order in (rows, rows[::-1]):
        # A file each way, since a scan and what follows keep the order of a small file.
        path = fresh_folder(spark, "reviews")
        spark.createDataFrame(order, "pr_id long, n int, reviewer_id long, state string, submitted_at timestamp").coalesce(1).write.parquet(path)
        reviews = spark.read.parquet(path)
        t = SimpleNamespace(prs=prs, bots=bots, reviews=reviews, within=lambda c: F.col(c).isNotNull())
        assert [tuple(r) for r in feedback_response_latency(t).collect()] == [(9, 5, 0.0, 0.0, None)]


def test_values_are_shown_as_the_oracle_rounds_them(spark):
    values = [4.015, 9.915, 0.575, 1.005, 85.66499999999999, 66.945, 0.285, -1.005, 7.0, 99.999, 0.001, 12.5]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(formatted(F.col("v"), F.lit("count"))).collect()]
    want = duckdb.execute(r"select case when v = floor(v) then printf('%.0f', v) else regexp_replace(printf('%.2f', round(v, 2)), '\.?0+$', '') end from (select unnest(?) v)", [values]).fetchall()
    assert got == [r[0] for r in want]
