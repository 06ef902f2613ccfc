"""Landed records and source text."""

import datetime as dt
import json

from pyspark.sql import functions as F

from tidemark.functions.source import complexity, functions_of, unified, unified_diff
from tidemark.plans.code import haloc
from tidemark.sources import ingest


def at(s):
    return dt.datetime.fromisoformat(s)


def landed(spark, tmp_path, rows, schema):
    (tmp_path / "raw.json").write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in rows))
    return ingest.read_landed(spark, f"file://{tmp_path}/raw.json", schema)


def test_pulls(spark, tmp_path):
    raw = landed(spark, tmp_path, [{"id": "a", "number": 1, "state": "CLOSED", "mergedAt": "2024-01-02T00:00:00Z", "author": {"login": "x"}}, {"id": "b", "state": "OPEN"}, {"id": "c", "state": "CLOSED"}, "{broken"], ingest.PULLS)
    got = {r["id"]: (r["state"], r["author"], r["is_draft"]) for r in ingest.pulls(raw, "r").collect()}
    assert got == {"a": ("merged", "x", False), "b": ("open", None, False), "c": ("closed", None, False)}


def test_deployments_fall_back(spark):
    schema = "repo_id string, id string, environment string, status string, created_at timestamp, finished_at timestamp"
    api = spark.createDataFrame([("a", "1", "prod", "success", at("2024-01-01"), at("2024-01-01")), ("a", "2", "prod", "pending", at("2024-01-01"), at("2024-01-01"))], schema)
    releases = spark.createDataFrame([("a", "r1", "prod", "success", None, None), ("b", "r2", "prod", "success", None, None)], schema)
    merges = spark.createDataFrame([(x, f"m{x}", "prod", "success", None, None) for x in "abc"], schema)
    got = {r["id"]: (r["source"], r["finished_at"] is not None) for r in ingest.deployments(api, releases, merges).collect()}
    assert got == {"1": ("api", True), "2": ("api", False), "r2": ("release", False), "mc": ("merge_proxy", False)}


def history(i, when, **item):
    return {"id": i, "created": when, "author": {"accountId": "u"}, "items": [item]}


def test_changelog(spark, tmp_path):
    raw = landed(
        spark,
        tmp_path,
        [
            {
                "id": "1",
                "key": "NEW-1",
                "fields": {"created": "2024-01-01T00:00:00Z", "status": {"id": "30"}},
                "changelog": {
                    "histories": [
                        history("h1", "2024-01-02T00:00:00Z", field="status", **{"from": "10", "to": "20"}),
                        history("h2", "2024-01-03T00:00:00Z", field="status", **{"from": "20", "to": "30"}),
                        history("h3", "2024-01-04T00:00:00Z", field="Key", fromString="OLD-1", toString="NEW-1"),
                        history("h4", "2024-01-05T00:00:00Z", field="Sprint", **{"from": "1, 2", "to": "2,3"}),
                    ]
                },
            },
            {"id": "2", "key": "NEW-2", "fields": {"created": "2024-01-01T00:00:00Z", "status": {"id": "10"}}},
        ],
        ingest.ISSUES,
    )
    moves = {(r["issue_id"], r["id"], r["from_status"], r["to_status"]) for r in ingest.status_transitions(raw).collect()}
    assert moves == {("1", "h1-0", "10", "20"), ("1", "h2-0", "20", "30"), ("1", "1-init", "10", "10"), ("2", "2-init", "10", "10")}
    keys = {(r["issue_id"], r["key"], r["valid_to"] is None) for r in ingest.key_validity(raw).collect()}
    assert keys == {("1", "OLD-1", False), ("1", "NEW-1", True), ("2", "NEW-2", True)}
    sprints = spark.createDataFrame([("3", at("2024-01-06")), ("1", at("2024-01-01"))], "sprint_id string, start_at timestamp")
    got = {(r["sprint_id"], r["change"], r["was_present_at_start"]) for r in ingest.sprint_changes(raw, sprints).collect()}
    assert got == {("3", "added", True), ("1", "removed", False)}


def test_sprint_fields_and_boards(spark):
    row = spark.createDataFrame([("x[id=7,name=a],y[id=9]", "4, 5", None)], "a string, b string, c string").select(*[ingest.sprint_ids(F.col(c)).alias(c) for c in "abc"]).first()
    assert (row["a"], row["b"], row["c"]) == (["7", "9"], ["4", "5"], [])
    board = spark.createDataFrame([("1", " To Do "), ("1", "In Review"), ("1", "Done")], "board_id string, column_name string")
    assert [(r["is_started_col"], r["is_done_col"]) for r in ingest.board_columns(board).collect()] == [(False, False), (True, False), (False, True)]


def test_review_states(spark):
    got = [r[0] for r in spark.createDataFrame([("APPROVED",), (" Changes_Requested",), ("odd",), (None,)], "s string").select(ingest.review_state(F.col("s"))).collect()]
    assert got == ["approved", "changes_requested", "commented", "commented"]


def test_diffs(spark):
    assert unified("a\nb\nc", "a\nx\nc") == "@@ -1,3 +1,3 @@\n a\n-b\n+x\n c" and unified("a\r\nb", "a\nb") == "" and unified("", "") == ""
    long = "\n".join(map(str, range(2000)))
    assert unified(long, "y").startswith("@@ -1,2000 +1,1 @@\n-0")
    df = spark.createDataFrame([(1, "a\nb", "a\nc\nd"), (2, None, "q"), (3, "q", "q")], "id int, x string, y string").select("id", unified_diff("x", "y").alias("patch"))
    assert {r["id"]: r["haloc"] for r in haloc(df).collect()} == {1: 2, 2: 1}


def test_complexity(spark):
    source = "def f(a):\n    if a and a > 1:\n        for x in a:\n            pass\n    elif a:\n        return 1 if a else 2\n    def g():\n        return 0\n    return g\n"
    assert [x[:2] for x in complexity(source)] == [("f", 6), ("g", 1)]
    assert complexity("def h(a):\n    if a:\n        while a:\n            pass\n    elif not a:\n        pass\n") == [("h", 4, 4)]
    assert complexity("def (") is None
    row = spark.createDataFrame([(source,), (None,), ("def (",)], "s string").select(functions_of("s").alias("f")).collect()
    assert row[0]["f"][0]["cyclomatic"] == 6 and row[1]["f"] is None and row[2]["f"] is None
