"""What a user of the engine calls: metric bundles, explanations, reports, exports, the SQL door."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans import catalog
from tidemark.sources import guard, sinks
from tidemark.tables import EVERYONE, USUAL, Scope, Tables, Window

FAMILIES = {"dora": ("dora.",), "flow": ("flow.",), "pr": ("pr.",), "code": ("code.",), "agile": ("agile.",), "person": ("person.",), "gaming": ("gaming.",)}
#: Report presets: the audience and period, and the metrics of the report.
PRESETS: dict[str, list[str]] = {
    "sprint:team": ["dora.lead_time", "dora.deployment_frequency", "flow.cycle_time", "flow.aging_wip", "agile.sprint_velocity", "agile.say_do", "flow.flow_distribution"],
    "monthly:team": ["dora.lead_time", "dora.deployment_frequency", "dora.change_failure_rate", "flow.time_in_status", "agile.sprint_predictability", "flow.monte_carlo_forecast", "agile.resolution_mix"],
    "quarterly:dept": ["dora.lead_time", "dora.deployment_frequency", "dora.change_failure_rate", "dora.recovery_time", "dora.benchmark", "pr.cycle_time", "report.periods"],
    "monthly:company": ["dora.deployment_frequency", "dora.lead_time", "dora.change_failure_rate", "flow.throughput", "flow.wip_load", "report.rollup"],
    "annual:company": ["report.snapshots", "report.periods", "report.trend_pivot", "code.maintainability_index", "code.haloc_aggregate"],
    "monthly:team.risk": ["flow.aging_wip", "flow.wip_load", "pr.reviewer_load_gini", "pr.review_coverage", "pr.review_latency", "code.complexity_delta", "code.nagappan_ball", "code.change_impact", "code.rework_churn"],
    "quarterly:company.benchmark": ["dora.benchmark", "dora.lead_time", "dora.deployment_frequency", "dora.change_failure_rate", "dora.recovery_time"],
    "annual:person": ["flow.cycle_time", "pr.cycle_time", "pr.review_latency", "flow.aging_wip", "person.worktype_mix", "person.self_baseline_drift"],
    "weekly:team": ["flow.throughput", "pr.time_to_first_review", "flow.aging_wip"],
}
# Metrics that stop measuring once they are a target.
GOODHART = (
    "dora.deployment_frequency",
    "dora.lead_time",
    "dora.change_failure_rate",
    "dora.recovery_time",
    "flow.cycle_time",
    "flow.throughput",
    "flow.flow_efficiency",
    "pr.cycle_time",
)


#: Entities that queries of the SQL door may name.
ENTITIES = ("prs", "reviews", "files", "functions", "deploys", "checks", "links", "transitions", "issues", "incidents", "verdicts")


class Engine:
    """The engine over one folder of tables, for a window and a scope; each call may ask for others."""

    def __init__(self, spark: SparkSession, folder: str, window: Window = USUAL, scope: Scope = EVERYONE):
        self.spark, self.folder, self.window, self.scope = spark, folder, window, scope
        self.tables = Tables(spark, folder, window, scope)

    def over(self, window: Window | None = None, scope: Scope | None = None) -> Engine:
        """The same engine for another window or scope."""
        return Engine(self.spark, self.folder, window or self.window, scope or self.scope)

    def metrics(self, family: str) -> list[str]:
        if family not in FAMILIES:
            raise ValueError(f"no such family: {family}")
        return [m for m in catalog.load() if m.startswith(FAMILIES[family])]

    def metric(self, name: str, window: Window | None = None, scope: Scope | None = None) -> DataFrame:
        """A metric with the envelope that all share in front of its own columns."""
        m, asked = catalog.load()[name], self.over(window, scope)
        head = {"id": name, "unit": m.unit, "trust_tier": m.trust, "formula_doc": m.doc, "engine_version": catalog.ENGINE_VERSION, "as_of": asked.window.as_of, "first": asked.window.first, "last": asked.window.last, "goodhart_warning": name in GOODHART}
        df = m.plan(asked.tables)
        return df.select(*[F.lit(v).alias(f"metric_{k}") for k, v in head.items()], *df.columns)

    def bundle(self, names: list[str], window: Window | None = None, scope: Scope | None = None) -> DataFrame:
        """(id, unit, trust_tier, as_of, row): each metric's rows as JSON under one schema, in one plan."""
        asked, known = self.over(window, scope), catalog.load()
        head = lambda n: [F.lit(v).alias(k) for k, v in (("id", n), ("unit", known[n].unit), ("trust_tier", known[n].trust), ("as_of", asked.window.as_of))]
        plans = {n: known[n].plan(asked.tables) for n in names}
        rows = [df.select(*head(n), F.to_json(F.struct(*df.columns)).alias("row")) for n, df in plans.items()]
        return reduce(DataFrame.unionByName, rows)

    def compared(self, name: str, window: Window, prior: Window, scope: Scope | None = None) -> DataFrame:
        """(period, row) of a metric in a window and in the one before it: what a report sets side by side."""
        parts = [self.bundle([name], w, scope).select(F.lit(p).alias("period"), "row") for p, w in (("current", window), ("prior", prior))]
        return parts[0].union(parts[1])

    def ranking(self, name: str, by: str, columns: list[str], window: Window | None = None, scope: Scope | None = None) -> DataFrame:
        """One metric's rows by falling ``by``, for teams: people are not ranked, and metrics not added up."""
        self.guard_ranking([name])
        if {c.lower() for c in columns} & {"person_id", "author_id", "reviewer_id"}:
            raise ValueError("people are not ranked")
        return self.metric(name, window, scope).orderBy(F.desc(by), *columns)

    def guard_ranking(self, names: list[str]) -> None:
        """Refuse to make one number, or a ranking of people, of several metrics."""
        if len(names) != 1 or names[0].startswith("person."):
            raise ValueError("metrics are not added up to one number, and people are not ranked")

    def explain(self, name: str) -> dict[str, str]:
        return catalog.explain(name)

    def query(self, text: str, **budget) -> dict:
        """A read-only query of the entities, in the engine's scope."""
        return guard.run(self._door, text, views=list(ENTITIES), **budget)

    @cached_property
    def _door(self) -> SparkSession:
        """A session of this engine's own: its views are of its scope, whatever other engines ask at the time."""
        own = self.spark.newSession()
        tables = Tables(own, self.folder, self.window, self.scope)
        for name in ENTITIES:
            getattr(tables, name).createOrReplaceTempView(name)
        return own

    def schema(self) -> dict[str, list[tuple[str, str]]]:
        return {n: getattr(self.tables, n).dtypes for n in ENTITIES}

    def status(self) -> DataFrame:
        """Rows of the main entities and their newest day."""
        return catalog.load()["serve.status"].plan(self.tables)

    def doctor(self) -> list[str]:
        """What is wrong with the folder: entities that can't be read or are empty."""
        wrong = []
        for name in ENTITIES:
            try:
                if getattr(self.tables, name).isEmpty():
                    wrong.append(f"{name}: no rows")
            except Exception as e:  # the tables are a user's
                wrong.append(f"{name}: {str(e).splitlines()[0]}")
        return wrong

    def presets(self) -> list[str]:
        return list(PRESETS)

    def report(self, preset: str, form: str = "markdown") -> str:
        """A preset's metrics, one table after the other, as Markdown or HTML."""
        if form not in ("markdown", "html"):
            raise ValueError(f"no such form: {form}")
        write = sinks.markdown if form == "markdown" else sinks.as_html
        parts = [write(catalog.load()[n].plan(self.tables), n, 50) for n in PRESETS[preset]]
        return "\n".join(parts)

    def export(self, name: str, path: str, form: str = "csv") -> None:
        {"csv": sinks.write_csv, "json": sinks.write_json}[form](catalog.load()[name].plan(self.tables), path)
