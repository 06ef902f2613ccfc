"""Layers of the Pareto frontier along a Z-order curve.

Measures become numbers of which less is better.  Each has its rank among quantiles, and the ranks' bits,
interleaved, are a row's place on the curve: who dominates stands before whom it dominates.  Distinct
measures are range-partitioned by that place.  A partition is read along the curve into a ZB-tree, whose
regions of successive rows are skipped or dropped whole by their best corner; a row's layer is one more than
the highest among those that dominate it.  What a partition alone puts beyond the last layer is there in the
whole table too, and can lift nothing into it, so it goes.  What successive partitions have left is put
together and thinned again, as many of them as make no more than a bounded number of rows, up the curve.

Where that doesn't end in one stretch of the curve, layers are settled between shards of what is left.  Pairs of shards are found by descending the tree of
their regions, by joins on the parents; in each round a pair's rows meet in a task of their own, which tells
by how much the earlier shard's lift the later one's, and every shard then settles its own rows.  Layer n is
right after round n at the latest, and the rounds end when nothing is lifted.  No task, broadcast or result
at the driver holds more than a shard, a pair of shards or a fixed number of quantiles.

Null measures are better than any number and equal to each other.  NaN and infinite figures of lines count as
missing.  An empty table gives no rows; repeated lines all count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import drop_staged, own_names, quoted, staged

#: Rows of a region of the tree, of a shard, and the most rows of successive partitions that are put together.
REGION, SHARD, TOGETHER = 128, 1024, 32768
#: Bits of a rank, and of the number of a shard within its partition.
RANK_BITS, SHARD_BITS, FAN_BITS = 8, 24, 5
_BEST = -(1 << 63)


def dominated_by(a: np.ndarray, layer: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each row of ``b`` the highest layer among rows of ``a`` that dominate it, else 0; no row is in both."""
    at = np.flatnonzero((a <= b.max(axis=0)).all(axis=1)) if len(a) and len(b) else []
    out = np.zeros(len(b), np.int32)
    for i in range(0, len(at), 4096):
        own = at[i : i + 4096]
        better = a[own, 0][:, None] <= b[:, 0]
        for d in range(1, a.shape[1]):
            better &= a[own, d][:, None] <= b[:, d]
        np.maximum(out, np.where(better, layer[own][:, None], 0).max(axis=0), out=out)
    return out


class ZBTree:
    """Rows kept in the order of the curve, in regions that know their best corner."""

    def __init__(self, dims: int, most: int):
        self.most, self.rows, self.layers = most, [np.empty((0, dims), np.int64)], [np.empty(0, np.int32)]
        self.corners = np.empty((0, dims), np.int64)
        self.last = np.empty((0, dims), np.int64)  # rows of the last layer: whom they dominate is beyond it

    def settle(self, rows: np.ndarray, layer: np.ndarray) -> np.ndarray:
        """Layers of the next ``rows`` of the curve, no less than ``layer``; those within the last are kept."""
        if (self.last <= rows.min(axis=0)).all(axis=1).any():
            return np.full(len(rows), self.most + 1, np.int32)
        may = np.flatnonzero((self.corners <= rows.max(axis=0)).all(axis=1))
        layer = layer.copy()
        if len(may):
            layer = np.maximum(layer, 1 + dominated_by(np.concatenate([self.rows[i + 1] for i in may]), np.concatenate([self.layers[i + 1] for i in may]), rows))
        better = rows[:, 0][:, None] <= rows[:, 0]
        for d in range(1, rows.shape[1]):
            better &= rows[:, d][:, None] <= rows[:, d]
        for j in range(1, len(rows)):
            above = layer[:j][better[:j, j]]
            if len(above):
                layer[j] = max(layer[j], above.max() + 1)
        stay = layer <= self.most
        if stay.any():
            self.rows.append(rows[stay])
            self.layers.append(layer[stay])
            self.corners = np.vstack([self.corners, rows[stay].min(axis=0)])
            self.last = np.vstack([self.last, rows[layer == self.most]])
        return layer


def settled(rows: np.ndarray, layer: np.ndarray, most: int, tree: ZBTree | None = None) -> np.ndarray:
    """Layers of ``rows``, which stand in the order of the curve."""
    tree = tree or ZBTree(rows.shape[1], most)
    return np.concatenate([tree.settle(rows[i : i + REGION], layer[i : i + REGION]) for i in range(0, len(rows), REGION)] or [layer])


def places(rows: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Interleaved bits of each measure's rank among its cuts."""
    z = np.zeros(len(rows), np.int64)
    for d, cut in enumerate(cuts):
        rank = np.searchsorted(cut, rows[:, d])
        for bit in range(RANK_BITS):
            z |= ((rank >> bit) & 1).astype(np.int64) << (bit * len(cuts) + d)
    return z


def _thinned(points: DataFrame, keys: list[str], parts: int, most: int) -> DataFrame:
    """Points within the last layer, as far as their partition tells, with their shard; points stand in ranges of the curve."""
    from pyspark import TaskContext

    def thin(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        label, tree, shard, held = None, None, -1, 0
        for frame in frames:
            for own, rows in frame.groupby("label", sort=False):
                if own != label:
                    label, tree, shard, held = own, ZBTree(len(keys), most), shard + 1, 0
                layers = settled(rows[keys].to_numpy(np.int64), rows["layer"].to_numpy(np.int32), most, tree)
                rows = rows.assign(layer=layers)[layers <= most]
                order = held + np.arange(len(rows))
                rows["shard"] = (np.int64(part) << SHARD_BITS) + shard + order // SHARD
                if len(rows):
                    shard, held = shard + int(order[-1] // SHARD), int(order[-1] % SHARD) + 1
                yield rows

    order = ["label", "z", *keys]
    schema = f"label string, z long, {', '.join(f'{k} long' for k in keys)}, layer int, shard long"
    return points.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(*order, "layer").mapInPandas(thin, schema)


def _put_together(found: DataFrame, keys: list[str], most: int) -> tuple[DataFrame, bool]:
    """Points thinned in stretches of successive partitions, longer ones while they stay small; whether each label is one stretch."""

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["z", *keys])
        layers = settled(rows[keys].to_numpy(np.int64), rows["layer"].to_numpy(np.int32), most)
        rows = rows.assign(layer=layers)[layers <= most]
        return rows.assign(shard=(rows["part"].to_numpy(np.int64) << SHARD_BITS) + np.arange(len(rows)) // SHARD).drop(columns="part")

    schema = f"label string, z long, {', '.join(f'{k} long' for k in keys)}, layer int, shard long"
    while True:
        parts = found.groupBy("label", F.shiftright("shard", SHARD_BITS).alias("part")).agg(F.count("*").alias("n"))
        told = parts.select("label", "part", "n", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("by")).groupBy("label", "by", F.expr("shiftright(part, by)")).agg(F.sum("n").alias("n"), F.max("part").alias("part"))
        rows = told.groupBy("by").agg(F.max("n").alias("n"), F.max("part").alias("part")).collect()
        longest = max((r["part"] for r in rows), default=0).bit_length()
        if not longest:
            return found, True
        fits = [r["by"] for r in rows if 0 < r["by"] <= longest and r["n"] <= TOGETHER]
        if not fits:
            return found, False
        before = found
        stretched = before.withColumn("part", F.shiftright(F.shiftright("shard", SHARD_BITS), max(fits)))
        found = staged(stretched.groupBy("label", "part").applyInPandas(settle, schema), "pareto")
        drop_staged(before)


def _pairs(found: DataFrame, keys: list[str]) -> DataFrame:
    """label, a, b, best corner of a, worst of b: pairs of different shards whose regions let a row of a dominate one of b."""
    low, high = [f"low_{k}" for k in keys], [f"high_{k}" for k in keys]
    shards = staged(found.groupBy("label", "shard").agg(*[F.min(k).alias(n) for k, n in zip(keys, low, strict=True)], *[F.max(k).alias(n) for k, n in zip(keys, high, strict=True)]), "pareto_shards")
    shifts = [0, SHARD_BITS]
    last = shards.agg(F.max("shard")).first()[0] or 0
    while last >> shifts[-1]:
        shifts.append(shifts[-1] + FAN_BITS)
    pairs = shards.select("label", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")).distinct()
    for shift, above in reversed(list(zip(shifts, shifts[1:], strict=False))):
        node = F.shiftright("shard", shift)
        regions = shards.groupBy("label", node.alias("node")).agg(*[F.min(n).alias(n) for n in low], *[F.max(n).alias(n) for n in high]).withColumn("up", F.shiftright("node", above - shift))
        a = regions.select("label", F.col("up").alias("a"), F.col("node").alias("own_a"), *low)
        b = regions.select("label", F.col("up").alias("b"), F.col("node").alias("own_b"), *high)
        may = F.col("own_a") <= F.col("own_b") if shift else F.col("own_a") < F.col("own_b")
        for n, m in zip(low, high, strict=True):
            may = may & (F.col(n) <= F.col(m))
        pairs = pairs.join(a, ["label", "a"]).join(b, ["label", "b"]).where(may)
        pairs = pairs.select("label", F.col("own_a").alias("a"), F.col("own_b").alias("b"), *(low + high if not shift else []))
    return pairs


def _round(found: DataFrame, pairs: DataFrame, keys: list[str], most: int) -> DataFrame:
    """``found`` with layers lifted between shards once, and settled within each."""
    named = [F.col(k) for k in keys]
    under = lambda side, which, test: found.join(pairs, (found["label"] == pairs["label"]) & (found["shard"] == pairs[which])).where(test).select(found["label"], "a", "b", F.lit(side).alias("side"), "shard", "z", *keys, "layer")
    better = under(0, "a", ~F.exists(F.array(*[k > F.col(f"high_{k_}") for k, k_ in zip(named, keys, strict=True)]), lambda x: x))
    worse = under(1, "b", ~F.exists(F.array(*[k < F.col(f"low_{k_}") for k, k_ in zip(named, keys, strict=True)]), lambda x: x))

    def lift(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = rows[rows["side"] == 0], rows[rows["side"] == 1]
        layers = 1 + dominated_by(a[keys].to_numpy(np.int64), a["layer"].to_numpy(np.int32), b[keys].to_numpy(np.int64))
        up = layers > b["layer"].to_numpy()
        return b.assign(layer=layers)[up][["label", "shard", "z", *keys, "layer"]]

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["z", *keys])
        layers = settled(rows[keys].to_numpy(np.int64), rows["layer"].to_numpy(np.int32), most)
        return rows.assign(layer=layers)[layers <= most]

    columns = ["label", "shard", "z", *keys, "layer"]
    schema = f"label string, shard long, z long, {', '.join(f'{k} long' for k in keys)}, layer int"
    lifted = better.union(worse).groupBy("label", "a", "b").applyInPandas(lift, schema)
    highest = found.select(*columns).union(lifted).repartition("label", "shard").groupBy("label", "shard", "z", *keys).agg(F.max("layer").alias("layer"))
    return highest.groupBy("label", "shard").applyInPandas(settle, schema)


def frontier_layers(points: DataFrame, keys: list[str], most: int) -> DataFrame:
    """label, ``keys``, layer of the points of layers 1 to ``most`` of each label.

    ``points`` are distinct (label string, ``keys`` long); less is better in each key.
    """
    spark = points.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = [i / (1 << RANK_BITS) for i in range(1, 1 << RANK_BITS)]
    quantiles = points.agg(*[F.percentile_approx(k, share, 10_000).alias(k) for k in keys]).first()
    cuts = [np.unique(np.asarray(quantiles[k] or [], np.int64)) for k in keys]

    def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(z=places(frame[keys].to_numpy(np.int64), cuts), layer=np.int32(1))

    longs = ", ".join(f"{k} long" for k in keys)
    curve = points.select("label", *keys).mapInPandas(placed, f"label string, {longs}, z long, layer int")
    found = staged(_thinned(curve, keys, parts, most), "pareto")
    found, whole = _put_together(found, keys, most)
    if whole:
        return found.select("label", *keys, "layer")
    pairs = staged(_pairs(found, keys), "pareto_pairs")
    if pairs.isEmpty():
        return found.select("label", *keys, "layer")
    total = lambda df: tuple(df.agg(F.count("*"), F.sum("layer")).first())
    sums = total(found)
    for _ in range(most + 1):
        before, found = found, staged(_round(found, pairs, keys, most), "pareto")
        drop_staged(before)
        if sums == (sums := total(found)):
            break
    return found.select("label", *keys, "layer")


def _others(rows: DataFrame, out: list[str]) -> list[Column]:
    """The caller's columns without those that are replaced."""
    gone = {c.lower() for c in out}
    return [F.col(quoted(c)) for c in rows.columns if c.lower() not in gone]


def with_layers(rows: DataFrame, lower: list[str], higher: list[str], groups: dict[str, str | None], n_equal: str = "n_equal", most: int = 12) -> DataFrame:
    """``rows`` with a layer for each of ``groups`` (name: column within whose values layers count, None for all rows).

    ``lower`` and ``higher`` are long measures of which less or more is better, null best of all; layers beyond
    ``most`` are 0.  ``n_equal`` is the number of rows, of any group, with the same measures.
    """
    own = own_names(rows, n_equal, *groups)
    keys = [f"k{i}" for i in range(len(lower) + len(higher))]
    values = [F.coalesce(F.col(quoted(c)).cast("long"), F.lit(_BEST)) for c in lower] + [F.coalesce(-F.col(quoted(c)).cast("long"), F.lit(_BEST)) for c in higher]
    label = lambda i, c: F.concat(F.lit(f"{i}:"), F.lit("") if c is None else F.coalesce(F.concat(F.lit("="), F.col(quoted(c)).cast("string")), F.lit("")))
    labels = {own(name): label(i, c) for i, (name, c) in enumerate(groups.items())}
    keyed = rows.withColumns({own(k): v for k, v in zip(keys, values, strict=True)} | labels)
    ks = [own(k) for k in keys]
    distinct = staged(keyed.groupBy(*labels, *ks).agg(F.count("*").alias("n")).select(*[F.col(c).alias(f"l{i}") for i, c in enumerate(labels)], *[F.col(c).alias(k) for c, k in zip(ks, keys, strict=True)], "n"), "pareto_points")
    points = None
    for i, c in enumerate(groups.values()):
        each = distinct.select(F.col(f"l{i}").alias("label"), *keys)
        points = each if points is None else points.union(each)
    layers = frontier_layers(staged(points.distinct(), "pareto_labels"), keys, most)
    facts = distinct.join(distinct.groupBy(*keys).agg(F.sum("n").alias("equal")), keys)
    for i in range(len(labels)):
        facts = facts.join(layers.where(F.col("label").startswith(f"{i}:")).select(F.col("label").alias(f"l{i}"), *keys, F.col("layer").cast("long").alias(f"layer{i}")), [f"l{i}", *keys], "left")
    back = facts.select(*[F.col(f"l{i}").alias(c) for i, c in enumerate(labels)], *[F.col(k).alias(c) for c, k in zip(ks, keys, strict=True)], *[F.coalesce(f"layer{i}", F.lit(0).cast("long")).alias(own(f"out{i}")) for i in range(len(labels))], F.col("equal").alias(own("equal")))
    joined = keyed.join(back, [*labels, *ks])
    return joined.select(*_others(rows, [*groups, n_equal]), *[F.col(own(f"out{i}")).alias(name) for i, name in enumerate(groups)], F.col(own("equal")).alias(n_equal))


def _hundredths(x: Column) -> Column:
    """floor(100 * x + 0.5) of a finite number, else null."""
    good = ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(good, F.floor(F.lit(100.0) * x + F.lit(0.5))).cast("long")


def _floor_div(a: Column, b: Column) -> Column:
    """Exact floor of a quotient of decimals; null where the divisor is 0."""
    some = F.when(b != 0, b)
    return F.call_function("div", a, some) - F.when((a % some != 0) & ((a < 0) != (some < 0)), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))


def offers(lines: DataFrame, sales: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, vendor_id, part_type, price, discount, delay, quantity of each pair of item and vendor with a line.

    A sale or an item that is listed more than once counts by its least time, brand and price.
    """
    wide = lambda c: c.cast("decimal(19,0)")
    sold = staged(sales.where(F.col("sale_id").isNotNull()).groupBy("sale_id").agg(F.min(F.to_date("sold_at")).alias("sold")), "pareto_sales")
    item = staged(items.where(F.col("item_id").isNotNull()).groupBy("item_id").agg(F.min("brand").alias("part_type"), F.min(F.when(~F.isnan("price"), F.col("price"))).alias("price")), "pareto_items").withColumn("p", _hundredths(F.col("price"))).drop("price")
    used = lines.where(F.col("item_id").isNotNull() & F.col("vendor_id").isNotNull())
    read = used.select("sale_id", "item_id", "vendor_id", F.col("quantity").cast("long").alias("q"), _hundredths(F.col("amount")).alias("c"), _hundredths(F.col("discount")).alias("d"), F.to_date("shipped_at").alias("shipped"))
    dated = read.join(sold, "sale_id", "left").withColumn("days", F.date_diff("shipped", "sold").cast("long"))
    whole = F.col("q").isNotNull() & F.col("c").isNotNull() & F.col("d").isNotNull()
    sums = dated.groupBy("item_id", "vendor_id").agg(
        F.sum(F.when(whole, wide(F.col("c")) * wide(100 - F.col("d")))).alias("cd"),
        F.sum(F.when(whole, F.col("q"))).alias("qs"),
        F.sum("d").alias("ds"),
        F.count("d").alias("dn"),
        F.sum("days").alias("ts"),
        F.count("days").alias("tn"),
        F.max("q").alias("quantity"),
    )
    both = sums.join(item, "item_id", "left")
    price = F.when(F.col("p") >= 1, _floor_div(F.col("cd"), wide(F.col("p")) * wide(F.col("qs"))))
    return both.select("item_id", "vendor_id", "part_type", price.alias("price"), _floor_div(wide(F.col("ds")), wide(F.col("dn"))).alias("discount"), _floor_div(wide(F.col("ts")), wide(F.col("tn"))).alias("delay"), "quantity")


def offer_layers(lines: DataFrame, sales: DataFrame, items: DataFrame, most: int = 12) -> DataFrame:
    """The offers with type_layer, global_layer and n_equal."""
    made = staged(offers(lines, sales, items), "pareto_offers")
    return with_layers(made, ["price", "delay"], ["discount", "quantity"], {"type_layer": "part_type", "global_layer": None}, most=most)
