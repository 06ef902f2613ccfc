"""Metrics over other windows and for teams and people, against oracles with the same parameters."""

import duckdb
import pytest

from tidemark.api import Engine
from tidemark.plans import catalog
from tidemark.tables import Scope, Tables, Window, said
from test_oracles import same

WINDOWS = {"usual": Window(), "year": Window("1997-01-01", "1997-12-31", "2024-01-03", "2024-01-16", "2024-01-20"), "month": Window("1996-05-01", "1996-05-31", "2024-01-10", "2024-01-12", "2024-01-13")}
SCOPES = {"everyone": Scope(), "team": Scope(repos=(1, 2, 3, 4, 5, 6)), "people": Scope(people=tuple(range(1, 80))), "nobody": Scope(repos=())}
METRICS = ["dora.deployment_frequency", "dora.lead_time", "dora.change_failure_rate", "pr.cycle_time", "pr.review_coverage", "pr.size", "flow.cycle_time", "flow.throughput", "flow.weekly_throughput", "flow.active_span", "agile.sprint_velocity", "code.nagappan_ball", "person.worktype_mix", "person.design_bearing_ratio", "gaming.trivial_splitting", "gaming.deploy_inflation", "report.snapshots", "store.window_slice", "flow.flow_efficiency", "flow.cycle_time_by_state", "person.weekly_trend", "code.rework_churn", "report.backfill", "report.against_baseline"]


@pytest.fixture(scope="module")
def duck(data):
    from pathlib import Path

    con = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


ASKED = [("year", "everyone"), ("month", "team"), ("usual", "people"), ("year", "nobody")]


@pytest.mark.parametrize("name, window, scope", [(m, *ASKED[(i + k) % 4]) for i, m in enumerate(METRICS) for k in (0, 1)])
def test_agrees(spark, data, duck, name, window, scope):
    m, w, s = catalog.load()[name], WINDOWS[window], SCOPES[scope]
    same(m.compute(Tables(spark, data), w, s), duck.execute(m.oracle_for(w, s)))


def test_windows_make_a_difference(spark, data):
    engine = Engine(spark, data)
    total = lambda **asked: engine.metric("dora.deployment_frequency", **asked).first()["total"]
    assert total() > total(window=WINDOWS["year"]) > total(window=WINDOWS["month"]) and total() > total(scope=SCOPES["team"])
    row = engine.metric("dora.lead_time", window=Window.of("1997-01-01", "1997-03-31")).first()
    assert (row["metric_first"], row["metric_last"], row["metric_as_of"], row["metric_unit"]) == ("1997-01-01", "1997-03-31", "1997-04-01", "seconds")
    both = {r["period"]: r["row"] for r in engine.compared("pr.size", WINDOWS["year"], Window.of("1996-01-01", "1996-12-31")).collect()}
    assert set(both) == {"current", "prior"} and both["current"] != both["prior"]


def test_windows_end_behind_their_beginning():
    with pytest.raises(ValueError):
        Window("1997-01-02", "1997-01-01").days
    assert Window.of("1997-01-01", "1997-12-31").days == 365
    assert "@" not in said("@first @last @days @issues_first @issues_last @as_of @issue_days @prs @deploys @issues @lines")


def test_every_goodhart_metric_is_known():
    from tidemark.api import GOODHART

    assert len(GOODHART) == 8 and set(GOODHART) <= set(catalog.load())


def test_people_in_scope_are_alone(spark, data):
    t = Tables(spark, data, scope=Scope(people=(3, 4)))
    assert {r[0] for r in t.prs.select("author_id").distinct().collect()} <= {3, 4}
    ids = {r[0] for r in t.prs.select("id").collect()}
    assert {r[0] for r in t.reviews.select("pr_id").collect()} <= ids and {r[0] for r in t.files.select("pr_id").collect()} <= ids
    assert t.by_key("prs", "id", [min(ids)]).count() == 1
