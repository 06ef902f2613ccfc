"""Layers of the frontier against peeling by definition, and offers of awkward lines."""

import random
from collections import Counter, defaultdict
from datetime import datetime
from fractions import Fraction
from math import floor

import numpy as np
import pytest

from tidemark.llm import pareto

ROW = "id long, kind string, a long, b long, c long, k0 string, label string, z int"


def peeled(points, most):
    """Layer of each distinct point (None is best), by taking away what nothing left dominates."""
    low = lambda x: float("-inf") if x is None else x
    left, out = {p: tuple(map(low, p)) for p in points}, dict.fromkeys(points, 0)
    for layer in range(1, most + 1):
        free = [p for p, v in left.items() if not any(w != v and all(x <= y for x, y in zip(w, v, strict=True)) for w in left.values())]
        for p in free:
            out[p] = layer
            del left[p]
    return out


def some_rows(r, n, spread):
    draw = lambda: r.choice([None, r.randint(-3, 3), *[r.randint(0, spread)] * 6])
    rows = [(i, r.choice(["x", "x", "x", "y", None]), draw(), draw(), draw(), "own", "own", 1) for i in range(n)]
    return rows + rows[: n // 10]


@pytest.mark.parametrize(("n", "spread", "region", "shard"), [(300, 12, 128, 1024), (900, 1000, 8, 16), (900, 40, 16, 20)])
def test_layers(spark, monkeypatch, n, spread, region, shard):
    for name, value in (("REGION", region), ("SHARD", shard), ("TOGETHER", 60 if shard < 100 else 32768)):
        monkeypatch.setattr(pareto, name, value)
    rows = some_rows(random.Random(n + spread), n, spread)
    got = pareto.with_layers(spark.createDataFrame(rows, ROW), ["a", "c"], ["b"], {"own": "kind", "whole": None}, most=5)
    assert got.columns == [*spark.createDataFrame(rows, ROW).columns, "own", "whole", "n_equal"]
    point = lambda x: (x[2], None if x[3] is None else -x[3], x[4])
    whole = peeled({point(x) for x in rows}, 5)
    kinds = {k: peeled({point(x) for x in rows if x[1] == k}, 5) for k in ("x", "y", None)}
    equal = Counter(map(point, rows))
    expected = Counter((*x, kinds[x[1]][point(x)], whole[point(x)], equal[point(x)]) for x in rows)
    assert Counter(map(tuple, got.collect())) == expected


def test_worst_case_of_the_curve(spark, monkeypatch):
    """Points of which none dominates another, and one long chain."""
    monkeypatch.setattr(pareto, "SHARD", 32)
    monkeypatch.setattr(pareto, "TOGETHER", 60)
    rows = [(i, "flat", i, i, 0, "", "", 0) for i in range(500)] + [(i, "chain", i, -i, i, "", "", 0) for i in range(500)]
    got = pareto.with_layers(spark.createDataFrame(rows, ROW), ["a", "c"], ["b"], {"layer": "kind"}, most=7).collect()
    assert all(r.layer == 1 for r in got if r.kind == "flat")
    assert all(r.layer == (r.id + 1 if r.id < 7 else 0) for r in got if r.kind == "chain")


def test_tree_agrees_with_definition():
    r = np.random.default_rng(2)
    points = np.unique(r.integers(0, 9, (400, 3)), axis=0)
    z = pareto.places(points, [np.arange(9)] * 3)
    order = np.lexsort((*points.T[::-1], z))
    layers = pareto.settled(points[order], np.ones(len(points), np.int32), 4)
    want = peeled({tuple(p) for p in points.tolist()}, 4)
    assert [x if x <= 4 else 0 for x in layers.tolist()] == [want[tuple(p)] for p in points[order].tolist()]


LINES = "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, discount double, flag string, shipped_at timestamp_ntz, price long"


def test_offers(spark):
    r = random.Random(11)
    nan, inf = float("nan"), float("inf")
    day = lambda: r.choice([None, datetime(2024, r.randint(1, 5), r.randint(1, 28), r.randint(0, 23))])
    sales = [(i, day()) for i in range(30)] + [(None, day())]
    items = [(i, r.choice(["B1", "B2", None]), r.choice([None, nan, 0.004, 3.335, 10.0, 99.99])) for i in range(8)]
    lines = [(r.choice([None, *range(32)]), 1, r.choice([None, *range(9)]), r.choice([None, 0, 0, 1]), r.choice([None, 1, 7, 50]), r.choice([None, nan, inf, -5.5, 12.345, 700.0]), r.choice([None, nan, 0.0, 0.05, 0.1, 1.5]), "f", day(), 4) for _ in range(600)]
    lines += lines[:100]
    got = pareto.offers(spark.createDataFrame(lines, LINES), spark.createDataFrame(sales, "sale_id long, sold_at timestamp_ntz"), spark.createDataFrame(items, "item_id long, brand string, price double"))
    sold, item = dict(sales), {i: (b, p) for i, b, p in items}
    cents = lambda x: None if x is None or x != x or abs(x) == inf else floor(100 * x + 0.5)
    groups = defaultdict(list)
    for s, _, i, v, q, a, d, _, at, _ in lines:
        if i is not None and v is not None:
            bought = sold.get(s) if s is not None else None
            groups[i, v].append((q, cents(a), cents(d), (at.date() - bought.date()).days if at and bought else None))
    mean = lambda xs: floor(Fraction(sum(xs), len(xs))) if xs else None
    want = set()
    for (i, v), rows in groups.items():
        brand, p = item.get(i, (None, None))
        p = cents(p)
        full = [(q, c, d) for q, c, d, _ in rows if None not in (q, c, d)]
        price = floor(Fraction(sum(c * (100 - d) for _, c, d in full), p * sum(q for q, *_ in full))) if full and p and p >= 1 else None
        want.add((i, v, brand, price, mean([d for _, _, d, _ in rows if d is not None]), mean([y for *_, y in rows if y is not None]), max((q for q, *_ in rows if q is not None), default=None)))
    found = [tuple(x) for x in got.collect()]
    assert len(found) == len(set(found)) and set(found) == want


def test_empty(spark):
    got = pareto.offer_layers(spark.createDataFrame([], LINES), spark.createDataFrame([], "sale_id long, sold_at timestamp_ntz"), spark.createDataFrame([], "item_id long, brand string, price double"))
    assert got.count() == 0
