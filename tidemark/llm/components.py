"""Connected components of an edge table, without ever gathering a component in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import drop_staged, own_names, quoted, staged


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _star(pairs: DataFrame) -> DataFrame:
    """(u, v) -> (u, v, m): m is the smallest of u's neighbours and u itself."""
    least = pairs.groupBy("u").agg(F.min("v").alias("lv")).select(F.col("u").alias("lu"), F.least("u", "lv").alias("m"))
    # What is joined grows with the edges, so it is merged at every size, never broadcast while it is small.
    return pairs.join(least.hint("merge"), F.col("u") == F.col("lu")).select("u", "v", "m")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Label each node of ``edges`` with the smallest node of its component: (node, root).

    Alternates large-star and small-star rounds until the edges stop changing; the result is a star
    around each root.  Minima are pre-aggregated before the shuffle and hot nodes are left to the
    skew join, so one huge component is spread over all tasks.  Each round is written to the shared
    folder.  Nulls in either column and self loops are ignored; an empty table gives an empty table.
    """
    now = staged(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b").distinct(), "edges")
    before = None
    while (seen := _signature(now)) != before and seen[0]:
        before = seen
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _star(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v"))
        after = staged(small.select(F.col("v").alias("a"), F.col("m").alias("b")).union(small.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct(), "edges")
        drop_staged(now)
        now = after
    stars = now.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())


def one_of_each(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``labels`` (doc_id, component_id) names smallest; columns stay whatever their names.

    Rows of a null id all stay.  Rows that repeat an id and its text leave one; those that repeat an id
    with another text go or stay together.
    """
    own = own_names(docs)
    doc_id, mark = F.col(quoted(id_col)), own("id")
    which = staged(labels.select("doc_id", "component_id"), "components")
    # What goes grows with the input, so it is merged at every size; broadcast while small, it would make
    # the texts' shuffle set in at some size.
    gone = which.where("doc_id <> component_id").select(F.col("doc_id").alias(mark)).distinct().hint("merge")
    kept = docs.join(gone, doc_id == F.col(mark), "left_anti")
    again = staged(which.where("doc_id = component_id").groupBy(F.col("doc_id").alias(mark)).count().where("count > 1").select(mark), "repeated")
    if again.isEmpty():
        return kept
    once = kept.join(again.hint("merge"), doc_id == F.col(mark), "left_semi").dropDuplicates([id_col, text_col])
    return kept.join(again.hint("merge"), doc_id == F.col(mark), "left_anti").unionByName(once)
