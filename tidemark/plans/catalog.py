"""The catalogue: each metric is a plan over ``Tables`` with the oracle that says what it computes."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from tidemark.tables import EVERYONE, ORACLE, USUAL, Scope, Tables, Window, said

ENGINE_VERSION = "0.1.0"


class Metric(NamedTuple):
    name: str
    plan: Callable[[Tables], DataFrame]
    doc: str
    trust: str
    oracle: str | None
    unit: str = "count"

    def compute(self, tables: Tables, window: Window = USUAL, scope: Scope = EVERYONE) -> DataFrame:
        """The metric over the same folder for a window and a scope."""
        return self.plan(Tables(tables.spark, tables.folder, window, scope))

    def oracle_for(self, window: Window = USUAL, scope: Scope = EVERYONE) -> str | None:
        """The oracle's SQL for a window and a scope; scopes hold for what reads the entities."""
        return self.oracle and said(self.oracle, window, scope)


METRICS: dict[str, Metric] = {}


def metric(name: str, oracle: str | None = None, trust: str = "deterministic", prelude: bool = True, unit: str = "count"):
    """Register a plan under ``name``; its docstring is the formula that ``explain`` tells."""

    def register(plan: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        sql = None if oracle is None else (ORACLE.strip() + "\n" + oracle if prelude else oracle)
        METRICS[name] = Metric(name, plan, (plan.__doc__ or "").strip(), trust, sql, unit)
        return plan

    return register


def load() -> dict[str, Metric]:
    from tidemark.plans import agile, backfill, code, dora, flow, people, pipelines, pull_requests, report_model, reports, stored  # noqa: F401

    return METRICS


def explain(name: str) -> dict[str, str]:
    m = load()[name]
    return {"id": m.name, "trustTier": m.trust, "unit": m.unit, "formulaDoc": m.doc, "engineVersion": ENGINE_VERSION}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name.replace(".", "_"): (lambda spark, folder, plan=m.plan: plan(Tables(spark, folder))) for name, m in load().items()}


def oracle_sql() -> dict[str, str]:
    return {name.replace(".", "_"): m.oracle_for() for name, m in load().items() if m.oracle}
