"""Streams that get their events out of order, twice, or not to the end."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.operators.history import latest
from tidemark.session import fresh_folder
from tidemark.streaming import incremental, states, sync

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double"
T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def some_events(seed, n=300, days=20):
    r = random.Random(seed)
    at = sorted(r.randint(0, days * 86400) for _ in range(n))
    return [(i, T0 + dt.timedelta(seconds=s), r.randint(0, 5), r.choice(["view", "click", "purchase", "error"]), float(r.randint(0, 9))) for i, s in enumerate(at)]


def landed(spark, events, seed, parts=6, jitter_hours=40):
    """The events in files, one after the other, each event up to ``jitter_hours`` out of its place."""
    r = random.Random(seed)
    mixed = sorted(events, key=lambda e: e[1] + dt.timedelta(hours=r.uniform(0, jitter_hours)))
    folder = fresh_folder(spark, "landed")
    size = -(-len(mixed) // parts)
    for i in range(parts):
        spark.createDataFrame(mixed[i * size : (i + 1) * size], EVENTS).coalesce(1).write.mode("append").parquet(folder)
    return folder


def as_moves(df):
    return df.select(F.col("user_id").alias("issue_id"), F.col("event_id").alias("n"), F.col("event_type").alias("to_status"), F.col("ts").alias("moved_at"))


def batch_answer(events):
    out = {}
    for user in {e[2] for e in events}:
        state = states.START
        for e in sorted((e for e in events if e[2] == user), key=lambda e: (e[1], e[0])):
            state = states.step(state, e[3], int(e[1].timestamp() * 1e6), ("purchase",))
        out[user] = state
    return out


def told_by_stream(spark, folder, forget_days=90):
    stream = as_moves(incremental.events_stream(spark, folder, 1))
    with states.rocksdb(spark):
        return incremental.drained_with_progress(states.followed(stream, "48 hours", forget_days=forget_days), "update")


def test_out_of_order_events_give_the_batch_answer(spark):
    events = some_events(1)
    told, progress = told_by_stream(spark, landed(spark, events, 2))
    assert len([p for p in progress if p["numInputRows"]]) == 6
    last = latest(told, ["issue_id"], ["n", "settled"]).collect()
    us = lambda t: -1 if t is None else int(t.replace(tzinfo=t.tzinfo or dt.timezone.utc).timestamp() * 1e6)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    got = {r.issue_id: (r.status, r.reopens, r.n) for r in last}
    want = batch_answer(events)
    assert got == {k: (v[0], v[3], v[4]) for k, v in want.items()}
    firsts = {r.issue_id: (r.a, r.b) for r in latest(told, ["issue_id"], ["n", "settled"]).select("issue_id", F.coalesce(F.unix_micros("first_done"), F.lit(-1)).alias("a"), F.coalesce(F.unix_micros("last_done"), F.lit(-1)).alias("b")).collect()}
    assert firsts == {k: (v[1], v[2]) for k, v in want.items()}
    assert all(r.settled > 0 for r in last)  # the watermark has passed some events of each


def test_python_is_handed_no_instants(spark):
    stream = as_moves(incremental.events_stream(spark, landed(spark, some_events(2), 1), 1))
    plan = states.followed(stream, "48 hours")._jdf.queryExecution().analyzed().toString().splitlines()
    at = next(i for i, line in enumerate(plan) if "TransformWithState" in line)
    handed = next(line for line in plan[at + 1 :] if "Project" in line)
    assert "to_status" in handed and "moved_at" not in handed


def test_an_issue_that_stays_done_is_forgotten(spark):
    early = [(i, T0 + dt.timedelta(hours=i), i % 3, "purchase" if i > 5 else "view", 1.0) for i in range(9)]
    later = [(100 + i, T0 + dt.timedelta(days=30 + i), 7, "view", 1.0) for i in range(6)]
    folder = fresh_folder(spark, "landed")
    for part in (early, later[:3], later[3:]):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(folder)
    kept = {}
    for days in (5, 400):
        told, progress = told_by_stream(spark, folder, days)
        assert {r.issue_id: r.n for r in latest(told, ["issue_id"], ["n", "settled"]).collect()} == {0: 3, 1: 3, 2: 3, 7: 6}
        kept[days] = progress[-1]["stateOperators"][0]["numRowsTotal"]
    # The three that are done leave state and timer only where they may be forgotten later.
    assert kept[5] < kept[400]


def test_windows_slide_once_and_their_state_goes(spark):
    events = some_events(5, 400, 60)
    twice = events + events[::7]
    folder = landed(spark, twice, 3)
    told, progress = incremental.drained_with_progress(incremental.sliding(incremental.events_stream(spark, folder, 1), 10), "append")
    rows = told.collect()
    mark = max(e[1] for e in events) - dt.timedelta(hours=48)
    want = defaultdict(lambda: [0, 0.0])
    for _, ts, _, kind, value in events:
        end = (ts + dt.timedelta(days=1)).replace(hour=0, minute=0, second=0)
        for i in range(10):
            last = end + dt.timedelta(days=i)
            if last <= mark:
                want[last.date(), kind][0] += 1
                want[last.date(), kind][1] += value
    assert {(r.end, r.event_type): [r.n, r.total] for r in rows} == dict(want) and len(rows) == len(want)
    assert {(r.end - r.first).days for r in rows} == {10}
    windows = [op for op in progress[-1]["stateOperators"] if op["operatorName"] == "stateStoreSave"][0]
    removed = sum(op["numRowsRemoved"] for p in progress for op in p["stateOperators"] if op["operatorName"] == "stateStoreSave")
    assert removed == len(rows) and windows["numRowsTotal"] <= 13 * 4


def test_days_are_told_again_until_they_close(spark):
    events = some_events(9, 300, 20)
    folder = landed(spark, events, 4)
    got = {(r.day, r.event_type): (r.n, r.total) for r in incremental.daily_counts(spark, folder).collect()}
    want = defaultdict(lambda: [0, 0.0])
    for _, ts, _, kind, value in events:
        want[ts.date(), kind][0] += 1
        want[ts.date(), kind][1] += value
    assert got == {k: tuple(v) for k, v in want.items()}


@pytest.fixture
def store(spark):
    return sync.SyncStore(spark, fresh_folder(spark, "sync"), "id long, v string, at timestamp", ["id"], "at", 4)


def batch(spark, rows):
    return spark.createDataFrame([(i, v, T0 + dt.timedelta(hours=h) if h is not None else None) for i, v, h in rows], "id long, v string, at timestamp")


def contents(store):
    hours = lambda c: ((F.unix_timestamp(c) - int(T0.timestamp())) / 3600).alias("h")
    return {(r.id, r.v) for r in store.read().collect()}, {r.scope: r.h for r in store.watermarks().select("scope", hours("watermark")).collect()}


def merge(store, rows, number, stream="s"):
    return store.merge(batch(store.spark, rows), stream, number, "host", "prs", F.col("id") % 2, F.col("at"))


def test_upserts_and_watermarks_go_together(store):
    assert contents(store) == (set(), {})
    assert merge(store, [(1, "a", 1), (2, "b", 2), (3, "c", 3)], 0)
    assert merge(store, [(1, "a2", 5), (2, "old", 1), (4, "d", None)], 1)
    assert contents(store) == ({(1, "a2"), (2, "b"), (3, "c"), (4, "d")}, {"0": 2.0, "1": 5.0})
    assert {(r.source, r.resource) for r in store.since().collect()} == {("host", "prs")}


def test_a_replayed_batch_changes_nothing(store):
    merge(store, [(1, "a", 1), (2, "b", 2)], 0)
    before, version = contents(store), store.manifest()
    assert not merge(store, [(1, "other", 9)], 0)
    assert contents(store) == before and store.manifest() == version
    assert merge(store, [(1, "other", 9)], 0, "another stream")


@pytest.mark.parametrize("where", ["rows", "marks", "manifest"])
def test_a_batch_that_fails_half_way_changes_nothing_until_replayed(store, monkeypatch, where):
    merge(store, [(1, "a", 1), (2, "b", 2), (7, "x", 0)], 0)
    before = contents(store)
    with monkeypatch.context() as m:
        if where == "rows":
            m.setattr(sync, "upsert", lambda *a: 1 / 0)
        elif where == "marks":
            m.setattr(sync.SyncStore, "watermarks", lambda self: 1 / 0)
        else:
            m.setattr(sync.SyncStore, "_publish", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            merge(store, [(1, "a2", 5), (3, "c", 3)], 1)
    assert contents(store) == before
    assert merge(store, [(1, "a2", 5), (3, "c", 3)], 1)
    after = contents(store)
    assert after == ({(1, "a2"), (2, "b"), (3, "c"), (7, "x")}, {"0": 2.0, "1": 5.0})
    store.vacuum(1)
    assert contents(store) == after


def test_a_second_writer_of_a_version_is_refused(store, monkeypatch):
    merge(store, [(1, "a", 1)], 0)
    stale = store.manifest()
    merge(store, [(2, "b", 2)], 1)
    monkeypatch.setattr(sync.SyncStore, "manifest", lambda self: stale)
    with pytest.raises(RuntimeError):
        merge(store, [(3, "c", 3)], 1, "other")


def test_a_stream_that_stops_goes_on_where_it_was(spark, store):
    folder, checkpoint = fresh_folder(spark, "in"), fresh_folder(spark, "checkpoint")

    def run():
        stream = spark.readStream.schema("id long, v string, at timestamp").option("maxFilesPerTrigger", 1).parquet(folder)
        sync.follow(stream, store, checkpoint, "s", "host", "prs", F.col("id") % 2, F.col("at"))

    for rows in ([(1, "a", 1)], [(1, "a2", 3), (2, "b", 1)]):
        batch(spark, rows).coalesce(1).write.mode("append").parquet(folder)
    run()
    assert contents(store)[0] == {(1, "a2"), (2, "b")} and store.manifest()["version"] == 2
    run()
    assert store.manifest()["version"] == 2
    batch(spark, [(2, "b2", 4)]).coalesce(1).write.mode("append").parquet(folder)
    run()
    assert contents(store)[0] == {(1, "a2"), (2, "b2")} and store.manifest()["version"] == 3
