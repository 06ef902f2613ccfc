"""Identity clusters: the smallest node that edges reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import shared_folder


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the folder that driver and executors share, its lineage cut."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def clusters(nodes: DataFrame, edges: DataFrame, node: str = "id") -> DataFrame:
    """(node, cluster) by spreading the smallest label along edges (a, b) and jumping to its label, until none changes.

    Labels only get smaller, so it ends.  Each round is checkpointed, so the lineage stays short.
    """
    both = checkpointed(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = nodes.select(F.col(node).alias("id"), F.col(node).alias("label")).distinct()
    while True:
        heard = both.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("label").alias("heard"))
        new = labels.join(heard, F.col("id") == F.col("a"), "left").select("id", F.col("label").alias("old"), F.least("label", F.coalesce("heard", "label")).alias("label"))
        jump = new.select(F.col("id").alias("to"), F.col("label").alias("far"))
        after = checkpointed(new.join(jump, F.col("label") == F.col("to"), "left").select("id", "old", F.least("label", "far").alias("label")))
        labels = after.select("id", "label")
        if after.where("old <> label").isEmpty():
            return labels.select(F.col("id").alias(node), F.col("label").alias("cluster"))


def changed_clusters(labels: DataFrame, edges: DataFrame, removed: DataFrame, added: DataFrame, node: str = "id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labels, edges and an audit after edges were taken away and put in: only clusters that lose an edge are worked out again.

    ``labels`` (node, cluster) are those of ``edges`` (a, b).  An edge that is not there can't be removed, one that
    is removed and added at once stays.  A cluster that only gains edges is renamed as a whole, through the
    graph of clusters, and none of its edges is read.  The audit has (node, before, after, cause) of each node whose
    cluster changed: ``split`` if its cluster lost an edge, else ``merged``.
    """
    both = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    known, new = both(edges), both(added)
    gone = checkpointed(known.join(both(removed), ["a", "b"], "left_semi").join(new, ["a", "b"], "left_anti"))
    fresh = checkpointed(new.join(known, ["a", "b"], "left_anti"))
    kept = known.join(gone, ["a", "b"], "left_anti").union(fresh)
    of = labels.select(F.col(node).alias("id"), F.col("cluster").alias("was"))

    touched = of.join(gone.select(F.col("a").alias("id")).distinct(), "id").select("was").distinct()
    nodes = checkpointed(of.join(touched, "was", "left_semi"))
    inner = known.join(nodes.select(F.col("id").alias("a")), "a", "left_semi").join(gone, ["a", "b"], "left_anti")
    split = clusters(nodes, inner, "id").withColumnRenamed("cluster", "now")
    between = checkpointed(of.join(split, "id", "left").select("id", "was", F.coalesce("now", "was").alias("now"), F.col("now").isNotNull().alias("lost")))

    at = lambda c: between.select(F.col("id").alias(c), F.col("now").alias(f"{c}_now"))
    bridges = checkpointed(fresh.join(at("a"), "a").join(at("b"), "b").where("a_now <> b_now").select(F.col("a_now").alias("a"), F.col("b_now").alias("b")))
    ends = bridges.select(F.col("a").alias("id")).union(bridges.select("b")).distinct()
    renamed = clusters(ends, bridges, "id").select(F.col("id").alias("now"), F.col("cluster").alias("after"))
    last = checkpointed(between.join(renamed, "now", "left").select("id", "was", F.coalesce("after", "now").alias("now"), "lost"))
    audit = last.where("was <> now").select(F.col("id").alias(node), F.col("was").alias("before"), F.col("now").alias("after"), F.when(F.col("lost"), "split").otherwise("merged").alias("cause"))
    return last.select(F.col("id").alias(node), F.col("now").alias("cluster")), kept, audit
