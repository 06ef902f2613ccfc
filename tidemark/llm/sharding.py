"""Sharding by Karmarkar-Karp differencing: indivisible groups of rows into shards of near equal bytes.

A partial partition is the sorted sums of the k shards of some groups.  The two with the largest
spread are combined oppositely ordered, largest sum onto smallest, until one is left.  Groups are
dealt into buckets of bounded size that are differenced apart; each leaves one partial partition, and
those are differenced in turn, ``FAN`` at a time, so no task ever holds more than a bounded number.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import quoted, staged, with_ordinals

BUCKET, FAN = 50_000, 1_000
#: Rows that are numbered at once: buckets grow in number with the rows, not in size.
_SLOTS = 1 << 20


def difference(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combine partial partitions (rows of k sums).

    Returns the sorted sums of the last one and, for each row and column of ``parts``, the column of
    the last one that it went to.  Ties go to the row that came first.
    """
    n, k = parts.shape
    order = np.argsort(parts, axis=1, kind="stable")
    sums = np.empty((2 * n - 1, k), dtype=np.int64)
    sums[:n] = np.take_along_axis(parts, order, axis=1)
    goes = np.empty((2 * n - 1, k), dtype=np.int32)  # each column's column in the combination
    children = np.empty((2 * n - 1, 2), dtype=np.int64)
    heap = list(zip((sums[:n, 0] - sums[:n, -1]).tolist(), range(n), strict=True))
    heapq.heapify(heap)
    place = np.arange(k)
    for z in range(n, 2 * n - 1):
        x, y = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        both = sums[x] + sums[y][::-1]
        by = both.argsort(kind="stable")
        at = np.empty(k, dtype=np.int32)
        at[by] = place
        goes[x], goes[y] = at, at[::-1]
        sums[z], children[z] = both[by], (x, y)
        heapq.heappush(heap, (int(sums[z, 0] - sums[z, -1]), z))
    label = np.empty((2 * n - 1, k), dtype=np.int32)
    label[-1] = place
    for z in range(2 * n - 2, n - 1, -1):
        for x in children[z]:
            label[x] = label[z][goes[x]]
    out = np.empty((n, k), dtype=np.int32)
    np.put_along_axis(out, order, label[:n], axis=1)
    return sums[-1], out


def shard_groups(groups: DataFrame, shards: int, bucket_size: int = BUCKET, fan: int = FAN) -> DataFrame:
    """(key, shard) of a table of (key, weight): differencing over all of them.  Keys must be distinct."""
    n = groups.count()
    buckets = max(1, -(-n // bucket_size))

    def leaves(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["weight", "key"], ascending=[False, True], kind="stable").reset_index(drop=True)
        parts = np.zeros((len(pdf), shards), dtype=np.int64)
        parts[:, -1] = pdf["weight"].to_numpy()
        sums, label = difference(parts)
        rows = pd.DataFrame({"node": pdf["node"], "key": pdf["key"], "column": label[:, -1]})
        rows["sums"] = None
        return pd.concat([rows, pd.DataFrame({"node": pdf["node"][:1], "key": [None], "column": [-1], "sums": [sums.tolist()]})], ignore_index=True)

    dealt = groups.select(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("node"), "key", "weight")
    first = staged(dealt.groupBy("node").applyInPandas(leaves, "node long, key binary, column int, sums array<long>"), "leaves")
    nodes = first.where("key is null").select("node", "sums")
    #: (node, goes): where each bucket's columns are in the partial partition that holds it by now.
    within = nodes.select("node", F.col("node").alias("top"), F.sequence(F.lit(0), F.lit(shards - 1)).alias("goes"))

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node").reset_index(drop=True)
        sums, label = difference(np.array(pdf["sums"].tolist(), dtype=np.int64))
        rows = pd.DataFrame({"node": pdf["node"], "up": pdf["up"], "moved": label.tolist()})
        rows["sums"] = None
        return pd.concat([rows, pd.DataFrame({"node": [-1], "up": pdf["up"][:1], "moved": [None], "sums": [sums.tolist()]})], ignore_index=True)

    while buckets > 1:
        buckets = -(-buckets // fan)
        up = nodes.withColumn("up", F.pmod("node", F.lit(buckets)))
        level = staged(up.groupBy("up").applyInPandas(combine, "node long, up long, moved array<int>, sums array<long>"), "level")
        step = level.where("moved is not null").select(F.col("node").alias("from"), "up", "moved")
        within = within.join(step, F.col("top") == F.col("from")).select("node", F.col("up").alias("top"), F.transform("goes", lambda c: F.get(F.col("moved"), c)).alias("goes"))
        nodes = level.where("sums is not null").select(F.col("up").alias("node"), "sums")
    held = first.where("key is not null").join(within, "node")
    return held.select("key", F.get("goes", F.col("column")).alias("shard"))


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", bucket_size: int = BUCKET) -> DataFrame:
    """Put every row in one of ``shards`` shards so that equal texts share a shard and sizes are near equal.

    Returns doc_id, size (UTF-8 bytes and 8; a null text has none and is grouped with empty ones),
    text_crc32, law (``bytes``), shard, slot (gapless from 0 in each shard, in no order that means
    anything), grown_shard (null: this law moves rows when a shard is added).  Copies of a text are one
    weight before anything is dealt out, however many they are; a group heavier than the mean shard
    fills a shard alone.  Repeated rows and null ids keep their rows; an empty table gives an empty one.
    """
    text = F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit(""))
    slim = docs.select(
        F.col(quoted(id_col)).alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("key"),
    )
    slim = staged(slim, "sizes")
    groups = staged(slim.groupBy("key").agg(F.sum("size").alias("weight")), "groups")
    where = shard_groups(groups, shards, bucket_size).withColumnRenamed("key", "of")
    dealt = staged(slim.join(where, F.col("key") == F.col("of")).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard")), "dealt")
    buckets = max(512, -(-dealt.count() // _SLOTS))
    slots = with_ordinals(dealt, ["shard"], ["doc_id", "text_crc32", "size"], "slot", buckets=buckets, groups=shards)
    return slots.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
