"""Code metrics over every line item, counted apart from the plans."""

import pandas as pd
import pytest

from tidemark.plans import catalog

QUERIES = catalog.queries()


@pytest.fixture(scope="module")
def lines(data):
    return pd.read_parquet(f"{data}/lineitem.parquet")


def test_patches_of_all_line_items(spark, data, lines):
    plus, minus = lines.l_quantity.astype(float).round().astype(int) % 5 + 1, lines.l_linenumber % 4
    got = QUERIES["code_haloc_patches"](spark, data).first()
    assert (got["patches"], got["value"]) == (len(lines), int((plus.where(plus > minus, minus) + minus).sum()))


def test_complexity_of_all_files(spark, data, lines):
    a = lines.l_quantity.astype(float).round().astype(int) % 12 - lines.l_partkey % 9
    b = lines.l_linenumber * 2 - (lines.l_linenumber + 3)
    got = QUERIES["code_complexity_delta"](spark, data).first()
    gained, lost = (int(sum((s * x).clip(lower=0).sum() for x in (a, b))) for s in (1, -1))
    assert (got["increased"], got["decreased"], got["added"], got["removed"]) == (gained, lost, len(lines), len(lines))


def test_a_file_is_dealt_out_once_not_each_of_its_functions(spark, data):
    plan = QUERIES["code_complexity_delta"](spark, data)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "hashpartitioning(" in line]
    assert dealt and not any("name" in line for line in dealt)
