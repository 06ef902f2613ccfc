"""Clusters under edits, stitching in passes, and lookups in versions, against plain Python."""

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import graph, stitch
from tidemark.operators.ranges import held_at


def components(nodes, edges):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            if (label[a], label[b]) != (low, low):
                label[a] = label[b] = low
                changed = True
    return label


def edge_table(spark, edges):
    return spark.createDataFrame([*edges], "a long, b long")


@pytest.mark.parametrize("seed", [1, 2])
def test_random_edits_agree_with_full_recomputation(spark, monkeypatch, seed):
    r = random.Random(seed)
    nodes = range(60)
    some = lambda n: {tuple(sorted(r.sample(nodes, 2))) for _ in range(n)}
    edges, removed, added = some(45), some(8), some(5)
    removed |= set(r.sample(sorted(edges), 6))
    turned = {(b, a) for a, b in removed}
    before = components(nodes, edges)
    worked = []
    plain = graph.clusters
    monkeypatch.setattr(graph, "clusters", lambda n, e, node="id": worked.append(({x[node] for x in n.select(node).collect()}, e.count())) or plain(n, e, node))
    labels = spark.createDataFrame([*before.items()], "id long, cluster long")
    now, kept, audit = graph.changed_clusters(labels, edge_table(spark, edges), edge_table(spark, turned), edge_table(spark, added))
    want_edges = {e for e in edges | added if e not in removed or e in added}
    want = components(nodes, want_edges)
    assert {x.id: x.cluster for x in now.collect()} == want
    assert {(x.a, x.b) for x in kept.collect()} == want_edges
    gone = (edges & removed) - added
    touched = {n for n in nodes if before[n] in {before[a] for a, _ in gone}}
    assert {(x.id, x.before, x.after, x.cause) for x in audit.collect()} == {(n, before[n], want[n], "split" if n in touched else "merged") for n in nodes if want[n] != before[n]}
    # What was worked out again: the nodes of clusters that lost an edge, then one node a cluster that gained one.
    assert worked[0][0] == touched and len(worked[1][0]) <= 2 * len(added)


def test_clusters_that_lose_nothing_are_not_read(spark, monkeypatch):
    labels = spark.createDataFrame([(i, i - i % 10) for i in range(1000)], "id long, cluster long")
    edges = spark.sql("select id - 1 a, id b from range(1000) where id % 10 > 0")
    sizes = []
    plain = graph.clusters
    monkeypatch.setattr(graph, "clusters", lambda n, e, node="id": sizes.append((n.count(), e.count())) or plain(n, e, node))
    now, _, audit = graph.changed_clusters(labels, edges, edge_table(spark, [(5, 4), (7, 999)]), edge_table(spark, [(20, 30)]))
    assert sizes == [(10, 8), (2, 1)]
    assert {(x.id, x.after, x.cause) for x in audit.collect()} == {(i, 5, "split") for i in range(5, 10)} | {(i, 20, "merged") for i in range(30, 40)}
    assert now.count() == 1000


ACCOUNTS = "id long, kind string, external_id string, email string, name string, is_bot boolean, person_id string"


def plain_stitch(rows):
    rows = sorted(x for x in rows if not x[5])
    person = {x[0]: x[6] or (f"{x[1]}:{x[2]}" if x[1] != "commit" else None) for x in rows}
    told = {x[0]: (person[x[0]], "known" if x[6] else "anchor") for x in rows if person[x[0]]}
    by = {k: {} for k in ("login", "tracker")}
    for x in rows:
        if x[1] in by and x[3]:
            e = x[3].lower()
            by[x[1]][e] = min(by[x[1]].get(e, "￿"), person[x[0]])
    split = lambda n: set(re.sub(" +", " ", re.sub("[^a-z0-9 ]", " ", (n or "").lower())).strip().split(" ")) - {""}
    part = lambda e: re.sub(r"\+.*$", "", e.lower().split("@")[0])
    asked = {}
    for x in rows:
        if x[1] != "commit" or x[6]:
            continue
        e = x[2].lower()
        if e in by["login"] or e in by["tracker"]:
            told[x[0]] = (by["login"][e], "verified") if e in by["login"] else (by["tracker"][e], "tracker")
            continue
        lp = part(e)
        others = [y[0] for y in rows if y[1] == "commit" and part(y[2]) == lp and y[2].lower() != e] if lp and lp != "noreply" else []
        if others:
            asked[x[0]] = (min(others), "local_part")
            continue
        mine = split(x[4])
        alike = [y[0] for y in rows if person[y[0]] and mine and split(y[4]) and len(mine & split(y[4])) >= (1 if 1 in (len(mine), len(split(y[4]))) else 2)]
        if alike:
            asked[x[0]] = (min(alike), "like_name")
    return told, asked


def test_stitching_against_plain_python(spark):
    r = random.Random(7)
    names = ["Ann", "Bo", "Cy", "Dee", "Eve", "Flo", "Ann-Bo", "", "Cher"]
    rows = []
    for i in range(1000):
        kind = r.choice(["login", "tracker", "commit", "commit", "commit"])
        mail = f"{r.choice(['u', 'V', 'noreply', 'x+tag'])}{r.choice(['', r.randint(0, 60)])}@{r.choice(['a', 'B'])}.com"
        name = r.choice([None, " ".join(r.choices(names, k=r.randint(1, 3)))])
        rows.append((i, kind, mail if kind == "commit" else f"{kind}{i}", r.choice([None, mail]) if kind != "commit" else None, name, r.random() < 0.05, r.choice([None] * 9 + ["p1"])))
    table = spark.createDataFrame(rows, ACCOUNTS)
    told, asked = plain_stitch(rows)
    assert {x.id: (x.person_id, x.tier) for x in stitch.stitched(table).collect()} == told
    got = stitch.suggestions(table).collect()
    assert {x.id: (x.other_id, x.reason) for x in got} == asked and len(got) == len(asked)


def test_a_word_that_all_share_stays_linear(spark):
    """100,000 accounts named alike: no step makes more rows than a few for each of them."""
    n = 100_000
    table = spark.range(n).selectExpr(
        "id", "if(id % 2 = 0, 'login', 'commit') kind", "if(id % 2 = 0, concat('l', id), concat('m', id, '@x.com')) external_id", "cast(null as string) email", "concat('Smith ', if(id % 3 = 0, 'Ann', cast(id as string))) name", "false is_bot", "cast(null as string) person_id"
    )
    asked = stitch.suggestions(table)
    assert asked.where("reason = 'like_name'").count() == asked.count() == table.where("kind = 'commit' and id % 3 = 0").count()
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("bucket", ["DAY", "MONTH"])
def test_what_held_at_an_instant(spark, bucket):
    r = random.Random(3)
    t0 = datetime(2024, 1, 1)
    at = lambda: t0 + timedelta(hours=r.randint(0, 24 * 100))
    versions = [(r.choice("ab"), i, s, r.choice([None, s + timedelta(hours=r.randint(1, 900))])) for i in range(40) for s in [at()]]
    rows = [(r.choice(["a", "b", "c", None]), r.choice([None, at(), at()]), 5) for _ in range(300)]
    rows += [("a", v[2], 6) for v in versions]
    got = held_at(spark.createDataFrame(rows, "k string, at timestamp, v int"), spark.createDataFrame(versions, "name string, n int, valid_from timestamp, valid_to timestamp"), {"k": "name"}, "at", ["n"], bucket=bucket)
    assert got.columns == ["k", "at", "v", "held"]

    def expected(k, when):
        fit = [v for v in versions if v[0] == k and when and v[2] <= when and (v[3] is None or v[3] > when)]
        newest = max((v[2] for v in fit), default=None)
        return {v[1] for v in fit if v[2] == newest} or {None}

    found = got.collect()
    assert len(found) == len(rows)
    for x in found:
        assert (x.held.n if x.held else None) in expected(x.k, x.at)


def test_flow_efficiency_of_a_reopened_issue(spark, data):
    """Time after the first done counts between transitions; the last status is cut at the first done."""
    from tidemark.plans import flow
    from tidemark.tables import Tables

    t = Tables(spark, data)
    hour = lambda h: datetime(2024, 1, 3) + timedelta(hours=h)
    moves = [(1, 1, None, "view", hour(0)), (1, 2, "view", "purchase", hour(4)), (1, 3, "purchase", "view", hour(6)), (1, 4, "view", "purchase", hour(16)), (2, 1, None, "click", hour(0)), (2, 2, "click", "signup", hour(24 * 13)), (2, 3, "signup", "click", hour(24 * 14))]
    t.__dict__["transitions"] = spark.createDataFrame(moves, "issue_id long, n long, from_status string, to_status string, moved_at timestamp")
    t.__dict__["issues"] = spark.createDataFrame([(1, hour(0)), (2, hour(0))], "issue_id long, created_at timestamp")
    got = {x.issue_id: (x.active / 3600, x.total / 3600, x.open_s / 3600) for x in flow.efficiencies(t).collect()}
    # 1: view 4 h, done 2 h, view 10 h, and nothing of the last done, which is cut at the first.
    assert got[1] == (14.0, 16.0, 4.0)
    # 2: a click that was entered before the 15th is active throughout, one entered after it waits.
    end = (datetime(2024, 1, 29) - hour(0)).total_seconds() / 3600
    assert got[2] == (24.0 * 13, end, end)
    assert flow.stated(t).where("issue_id = 2").select(F.collect_list("state")).first()[0] == ["active", "new", "wait"]
