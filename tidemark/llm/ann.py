"""Nearest neighbours by inner product: vantage-point trees per shard, exact by default.

Inner products become distances by one more coordinate, sqrt(M^2 - |x|^2) with M the largest norm and
zero for a query: the nearest are then those of the largest inner product.  Vectors are assigned to the
nearest of a bounded number of centres; a region's vectors are dealt over as many shards as keep each
bounded, by a hash of their id.  A query first searches one shard of its own region, which bounds the
distance of its k-th neighbour, then the shards of each region that can hold a nearer one.  Within a
shard, and for a region as a whole, the triangle inequality gives a lower bound of the distance; what
lies behind it is skipped if ``factor`` times the bound is over that distance.  Factor one skips only
what can't be among the nearest, so the search is exact, and is the default; a larger one skips more, and
nearly all where one long vector makes M large and every distance alike.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm.shared import quoted, staged

#: Bytes of a shard's vectors, queries of a block, centres, points of a leaf, and queries that a leaf is held against at once.
SHARD_BYTES, BLOCK, CENTRES, LEAF, AT_ONCE = 8 << 20, 4096, 64, 256, 1024


class VantageTree:
    """A tree over rows of ``points``: inner nodes keep a vantage point and the distance range of each half."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF, seed: int = 7):
        self.points, self.leaf = points, leaf
        self.order = np.arange(len(points))
        self.nodes: list[tuple] = []  # (first, last) of a leaf, or (vantage, [(low, high, node), ...])
        rng = np.random.default_rng(seed)
        self.root = self._build(0, len(points), rng)

    def _build(self, first: int, last: int, rng) -> int:
        at = len(self.nodes)
        self.nodes.append((first, last))
        own = self.order[first:last]
        if len(own) <= self.leaf:
            return at
        vantage = self.points[own[rng.integers(len(own))]]
        far = np.linalg.norm(self.points[own] - vantage, axis=1)
        by = np.argsort(far, kind="stable")
        self.order[first:last], far = own[by], far[by]
        half = len(own) // 2
        if far[0] == far[-1]:
            return at  # all as far: nothing to tell them apart by, one large leaf
        inner, outer = self._build(first, first + half, rng), self._build(first + half, last, rng)
        self.nodes[at] = (vantage, [(far[0], far[half - 1], inner), (far[half], far[-1], outer)])
        return at

    def search(self, queries: np.ndarray, most: np.ndarray, factor: float, visit) -> None:
        """Call ``visit(query rows, point rows)`` for each leaf that is not skipped; it may lower ``most``."""

        def go(node: int, rows: np.ndarray) -> None:
            if not len(rows):
                return
            a, b = self.nodes[node]
            if isinstance(b, (int, np.integer)):
                own = self.order[a:b]
                for k in range(0, len(own), 4 * self.leaf):
                    visit(rows, own[k : k + 4 * self.leaf])
                return
            far = np.linalg.norm(queries[rows] - a, axis=1)
            near_first = far <= b[0][1]
            for low, high, child in b if near_first.mean() >= 0.5 else b[::-1]:
                bound = np.maximum(np.maximum(low - far, far - high), 0.0)
                go(child, rows[factor * bound <= most[rows]])

        go(self.root, np.arange(len(queries)))


def _vectors(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if column.num_chunks else pa.array([], pa.float64())
    return np.asarray(flat, dtype=np.float64).reshape(-1, dims)


def search_shard(points: np.ndarray, ids: np.ndarray, rows_of: np.ndarray, queries: np.ndarray, query_rows: np.ndarray, floor: np.ndarray, largest: float, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of up to ``k`` nearest for each query among ``points``, no worse than ``floor``; its own row is none."""
    lift = np.sqrt(np.maximum(largest**2 - (points**2).sum(1), 0.0))
    tree = VantageTree(np.column_stack([points, lift]))
    square = (queries**2).sum(1) + largest**2
    lifted = np.column_stack([queries, np.zeros(len(queries))])
    best = np.full((len(queries), k), -np.inf)
    best_id = np.full((len(queries), k), np.iinfo(np.int64).max)
    least = floor.copy()  # the worst score that still counts
    slack = 1e-9 * max(1.0, largest**2)
    reach = lambda score: np.sqrt(np.maximum(square - 2 * np.where(np.isfinite(score), score, -np.inf), 0.0)) + slack
    most = np.where(np.isfinite(least), reach(least), np.inf)

    def visit(every: np.ndarray, own: np.ndarray) -> None:
        for i in range(0, len(every), AT_ONCE):
            compare(every[i : i + AT_ONCE], own)

    def compare(rows: np.ndarray, own: np.ndarray) -> None:
        score = queries[rows] @ points[own].T
        good = (score >= least[rows][:, None] - slack) & (rows_of[own][None] != query_rows[rows][:, None])
        r, c = np.nonzero(good)
        if not len(r):
            return
        exact = (queries[rows[r]] * points[own[c]]).sum(1)  # summed alike wherever a vector stands: ties are ties
        hit = np.unique(r)
        all_r = np.concatenate([r, np.repeat(hit, k)])
        all_s = np.concatenate([exact, best[rows[hit]].ravel()])
        all_i = np.concatenate([ids[own[c]], best_id[rows[hit]].ravel()])
        by = np.lexsort((all_i, -all_s, all_r))
        all_r, all_s, all_i = all_r[by], all_s[by], all_i[by]
        place = np.arange(len(all_r)) - np.searchsorted(all_r, all_r)
        keep = place < k
        best[rows[all_r[keep]], place[keep]] = all_s[keep]
        best_id[rows[all_r[keep]], place[keep]] = all_i[keep]
        worst = best[rows[hit], k - 1]
        least[rows[hit]] = np.maximum(least[rows[hit]], worst)
        known = np.isfinite(least[rows[hit]])
        most[rows[hit][known]] = reach(least)[rows[hit][known]]

    tree.search(lifted, most, factor, visit)
    r, c = np.nonzero(np.isfinite(best))
    return r, best_id[r, c], best[r, c]


def nearest(vectors: DataFrame, query: str, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", factor: float = 1.0, shard: int | None = None, block: int = BLOCK, centres: int = CENTRES) -> DataFrame:
    """The ``k`` nearest found of each vector that meets the SQL condition ``query``, among all rows but its own.

    Returns query_id, rank (from 1), vec_id, score: the inner product in double precision, largest
    first, ties to the smaller id.  Rows that share an id are rows of their own, as queries and as
    candidates.  Vectors that are null, empty, zero or hold null or non-finite components take no part, nor
    do null ids; vectors of different lengths have no inner product, so each length is searched apart.
    Fewer candidates than ``k`` give what there are; no vectors, an empty table.  ``query`` is a condition on
    ``id_col``.  The centres are the vectors of the ``centres`` smallest hashed ids: a bounded sample; every
    vector is indexed.  ``shard`` is how many vectors a tree holds, by default ``SHARD_BYTES`` of them.
    """
    spark = vectors.sparkSession
    given = vectors.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(vector_col)).cast("array<double>").alias("v")).where("id is not null")
    given = given.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    # A row's number is made once and written, so it is the same whoever reads it.
    given = staged(given.withColumn("row", F.monotonically_increasing_id()), "vectors")
    lengths = [(r["n"], r["count"]) for r in given.groupBy(F.size("v").alias("n")).count().orderBy("n").collect()]
    found = [_nearest(given.where(F.size("v") == dims), dims, count, query, k, id_col, factor, shard or max(LEAF, SHARD_BYTES // (8 * dims)), block, centres) for dims, count in lengths]
    return reduce(DataFrame.union, found) if found else spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _nearest(given: DataFrame, dims: int, count: int, query: str, k: int, id_col: str, factor: float, shard: int, block: int, centres: int) -> DataFrame:
    """``nearest`` for vectors (id, v, row) of one length."""
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    largest = given.agg(F.max(norm)).first()[0]
    seeds = np.array([r["v"] for r in given.orderBy(F.xxhash64("id"), "id", "row").limit(min(centres, max(1, count // shard))).collect()])
    lift = lambda x: np.column_stack([x, np.sqrt(np.maximum(largest**2 - (x**2).sum(1), 0.0))])
    seeds_up = lift(seeds)

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            x = lift(_vectors(table.column("v"), dims))
            far = np.linalg.norm(x[:, None, :] - seeds_up[None], axis=2) if len(seeds_up) <= 8 else np.sqrt(np.maximum((x**2).sum(1)[:, None] + (seeds_up**2).sum(1) - 2 * x @ seeds_up.T, 0))
            region = far.argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(region, pa.int32()), pa.array(np.linalg.norm(x - seeds_up[region], axis=1))], ["id", "v", "row", "region", "far"])

    placed = staged(given.select("id", "v", "row").mapInArrow(assign, "id long, v array<double>, row long, region int, far double"), "placed")
    regions = {r["region"]: (r["radius"], -(-r["n"] // shard)) for r in placed.groupBy("region").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("n")).collect()}
    salts = F.create_map(*[F.lit(x) for region, (_, n) in regions.items() for x in (region, n)])
    placed = placed.select("id", "v", "row", "region", F.pmod(F.xxhash64("row"), salts[F.col("region")]).cast("int").alias("salt"))
    asked = placed.withColumn(id_col, F.col("id")).where(query).select("id", "v", "row", "region", "salt")
    blocks = max(1, -(-asked.count() // block))
    asked = staged(asked.withColumn("block", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks)).cast("int")), "queries")
    radius = np.array([regions[r][0] if r in regions else -np.inf for r in range(len(seeds))])

    def search(key, left: pa.Table, right: pa.Table) -> pa.Table:
        none = {"query_row": pa.array([], pa.int64()), "query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())}
        if not left.num_rows or not right.num_rows:
            return pa.table(none)
        query_ids, query_rows = left.column("id").to_numpy(), left.column("row").to_numpy()
        floor = left.column("floor").to_numpy(zero_copy_only=False).astype(np.float64)
        r, ids, score = search_shard(_vectors(right.column("v"), dims), right.column("id").to_numpy(), right.column("row").to_numpy(), _vectors(left.column("v"), dims), query_rows, np.where(np.isnan(floor), -np.inf, floor), largest, k, factor)
        return pa.table({"query_row": query_rows[r], "query_id": query_ids[r], "vec_id": ids, "score": score})

    def searched(queries: DataFrame) -> DataFrame:
        """``queries`` has id, row, v, block, floor and the (region, salt) to search."""
        pairs = queries.select(F.col("block").alias("b"), F.col("region").alias("r"), F.col("salt").alias("s")).distinct()
        there = placed.join(pairs, (F.col("region") == F.col("r")) & (F.col("salt") == F.col("s"))).select(F.col("b").alias("block"), F.col("r").alias("region"), F.col("s").alias("salt"), "id", "row", "v")
        by = ["block", "region", "salt"]
        return queries.groupBy(*by).cogroup(there.groupBy(*by)).applyInArrow(search, "query_row long, query_id long, vec_id long, score double")

    def best(found: DataFrame) -> DataFrame:
        by = W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)

    home = searched(asked.withColumn("floor", F.lit(None).cast("double")))
    first = staged(home, "home")
    floors = first.groupBy("query_row").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k).select(F.col("query_row").alias("row"), "floor")

    def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            q = _vectors(table.column("v"), dims)
            far = np.sqrt(np.maximum((q**2).sum(1)[:, None] + (seeds_up**2).sum(1) - 2 * q @ seeds.T, 0))
            floor = table.column("floor").to_numpy(zero_copy_only=False).astype(np.float64)
            reach = np.where(np.isnan(floor), np.inf, np.sqrt(np.maximum((q**2).sum(1) + largest**2 - 2 * np.nan_to_num(floor), 0)))
            slack = 1e-6 * max(1.0, largest)
            r, c = np.nonzero(factor * np.maximum(far - radius[None] - slack, 0) <= reach[:, None])
            yield pa.RecordBatch.from_pydict({"row": table.column("row").to_numpy()[r], "to": pa.array(c, pa.int32())})

    with_floor = asked.join(floors, "row", "left")
    routed = with_floor.select("row", "v", "floor").mapInArrow(route, "row long, to int")
    visits = with_floor.withColumnsRenamed({"region": "own", "salt": "own_salt"}).join(routed, "row").where(F.col("to").isin(*regions))
    visits = visits.withColumn("salt", F.explode(F.sequence(F.lit(0), salts[F.col("to")].cast("int") - 1))).withColumnRenamed("to", "region")
    visits = visits.where(~((F.col("own") == F.col("region")) & (F.col("own_salt") == F.col("salt"))))
    rest = searched(staged(visits.select("id", "row", "v", "block", "floor", "region", "salt"), "visits"))
    found = best(first.union(rest))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
