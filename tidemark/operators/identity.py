"""Identity: accounts of several sources stitched into people, and merges that can be undone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.text import normalised_name

AUTO = 0.95
#: Evidence for one person behind two accounts, and whether it is enough on its own.
EMAIL, NAME_AND_WORK, WORK, NAME, WEAK_WORK = 1.0, 0.95, 0.85, 0.6, 0.5
SHARE, COUNT = 0.5, 5


def plain_email(email: Column) -> Column:
    """Lower case, without a plus tag; null if it is none or a host's relay."""
    e = F.regexp_replace(F.lower(F.trim(email)), r"\+[^@]*@", "@")
    return F.when(e.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$") & ~e.contains("noreply"), e)


def name_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a_id, b_id, is_unique) of accounts (id, name) whose names are one set of words, through an index of words.

    Single letters are no evidence; a pair is unique if neither side has another.
    """
    words = lambda df: df.select("id", F.filter(F.array_sort(F.array_distinct(F.split(normalised_name(F.col("name")), " "))), lambda w: F.length(w) > 1).alias("w")).where(F.size("w") > 0)
    left, right = words(a).selectExpr("id as a_id", "w"), words(b).selectExpr("id as b_id", "w")
    same = left.join(right, "w").select("a_id", "b_id").distinct()
    n = lambda c: F.count(F.lit(1)).over(W.partitionBy(c))
    return same.withColumn("is_unique", (n("a_id") == 1) & (n("b_id") == 1))


def candidates(a: DataFrame, b: DataFrame, work: DataFrame) -> DataFrame:
    """(a_id, b_id, evidence, confidence, is_auto) for accounts (id, name, email) of two sources.

    ``work`` has (a_id, b_id, n): how often a's changes were linked to b's issues.  Each pair is told with
    its best evidence.
    """
    email = a.select(F.col("id").alias("a_id"), plain_email(F.col("email")).alias("e")).join(b.select(F.col("id").alias("b_id"), plain_email(F.col("email")).alias("e")), "e").select("a_id", "b_id", F.lit(True).alias("email")).distinct()
    total = work.groupBy("a_id").agg(F.sum("n").alias("total"))
    share = work.groupBy("a_id", "b_id").agg(F.sum("n").alias("n")).join(total, "a_id").withColumn("share", F.col("n") / F.col("total")).select("a_id", "b_id", "n", "share")
    names = name_pairs(a, b).withColumn("name", F.lit(True))
    both = email.join(names, ["a_id", "b_id"], "full_outer").join(share, ["a_id", "b_id"], "full_outer")
    strong = F.coalesce((F.col("share") >= SHARE) & (F.col("n") >= COUNT), F.lit(False))
    some = F.coalesce(F.col("share") >= SHARE, F.lit(False))
    named = F.coalesce("name", F.lit(False))
    kind = F.when(F.col("email"), "email").when(named & strong, "name_and_work").when(strong, "work").when(named & F.coalesce("is_unique", F.lit(False)), "name").when(some, "weak_work")
    sure = F.create_map(*[F.lit(x) for x in ("email", EMAIL, "name_and_work", NAME_AND_WORK, "work", WORK, "name", NAME, "weak_work", WEAK_WORK)])
    return both.select("a_id", "b_id", kind.alias("evidence")).where("evidence is not null").withColumn("confidence", sure[F.col("evidence")]).withColumn("is_auto", F.col("confidence") >= AUTO)


def claim(pairs: DataFrame) -> DataFrame:
    """Add ``taken``: each account is claimed once, by its best pair; ties go to the smaller ids.

    What taking pairs in the order of their confidence gives, in rounds: a pair that is the best of both its
    accounts is taken, and what shares an account with it goes; that ends, since the best pair left is always
    taken.  No group of pairs is gathered, and each round is checkpointed.
    """
    from tidemark.operators.graph import checkpointed

    order = F.struct((-F.col("confidence")).alias("c"), F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    left = checkpointed(pairs.select("a_id", "b_id", order.alias("key")))
    taken = []
    while not left.isEmpty():
        best = lambda c, left=left: left.groupBy(F.col(c).alias(f"{c}2")).agg(F.min("key").alias(f"{c}_best"))
        now = checkpointed(left.join(best("a_id"), F.col("a_id") == F.col("a_id2")).join(best("b_id"), F.col("b_id") == F.col("b_id2")).where("key = a_id_best and key = b_id_best").select("a_id", "b_id").distinct())
        taken.append(now)
        left = checkpointed(left.join(now.select("a_id"), "a_id", "left_anti").join(now.select("b_id"), "b_id", "left_anti").select("a_id", "b_id", "key"))
    if not taken:
        return pairs.withColumn("taken", F.lit(False))
    all_ = reduce(DataFrame.union, taken).withColumn("taken", F.lit(True))
    return pairs.join(all_, ["a_id", "b_id"], "left").select(*pairs.columns, F.coalesce("taken", F.lit(False)).alias("taken"))


def decide(edges: DataFrame, decisions: DataFrame) -> DataFrame:
    """Edges (a_id, b_id) after decisions (a_id, b_id, verdict, at): the latest verdict on a pair counts.

    ``confirmed`` adds a pair, ``rejected`` and ``unmerged`` take it away.
    """
    last = decisions.groupBy("a_id", "b_id").agg(F.max_by("verdict", "at").alias("verdict"))
    return edges.join(last.where("verdict <> 'confirmed'"), ["a_id", "b_id"], "left_anti").select("a_id", "b_id").union(last.where("verdict = 'confirmed'").select("a_id", "b_id")).distinct()


def backfill_actors(transitions: DataFrame, history: DataFrame) -> DataFrame:
    """Fill ``actor`` of transitions (issue_id, id, at, actor) from raw history (issue_id, at, n, login).

    Rows at one instant are paired in order; more transitions than records take the last record.
    """
    spot = ["issue_id", "at"]
    left = transitions.withColumn("__i", F.row_number().over(W.partitionBy(*spot).orderBy("id")))
    right = history.withColumn("__r", F.row_number().over(W.partitionBy(*spot).orderBy("n"))).groupBy(*spot).agg(F.sort_array(F.collect_list(F.struct("__r", "login"))).alias("__all"))  # the records of one instant of one issue
    joined = left.join(right, spot, "left")
    found = F.get("__all", F.least(F.col("__i"), F.size("__all")) - 1)["login"]
    return joined.withColumn("actor", F.coalesce("actor", found)).select(*transitions.columns)
