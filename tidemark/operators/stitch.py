"""Accounts stitched into people in passes, each of which leaves out what the ones before have claimed.

Accounts with an anchor (a host's or a tracker's) are people of their own.  Addresses of commits belong to
the person whose verified address they are, else to whose tracker names them.  What is left gets at most one
suggestion for a reader to confirm: another address of the same local part, else a person of a like name.
Names are alike if they share two words, or one where either has no more.  A suggestion is the smallest id of
those that fit, so each key of an index (a local part, a word, a pair of words) holds that one id, worked out
before anything is joined: a word that all names share costs a row an account, never a pair of accounts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import normalised_name

#: Kinds of accounts that stand for a person by themselves.
ANCHORS = ("login", "tracker")
# How sure a suggestion is, and local parts of machines that send.
LOCAL_PART, LIKE_NAME = 0.8, 0.5
NO_REPLY = r"^(no-?reply|do-?not-?reply|donotreply|notifications?|mailer-daemon|postmaster|bounces?)$"


def local_part(email: Column) -> Column:
    """What stands before the @, in lower case and without a plus tag; null for senders that nobody reads."""
    part = F.regexp_replace(F.substring_index(F.lower(email), "@", 1), r"\+.*$", "")
    return F.when((part != "") & ~part.rlike(NO_REPLY), part)


def words(name: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(normalised_name(name), " "), lambda w: w != "")))


def _pairs(w: Column) -> Column:
    """Every two of a name's words, in order."""
    return F.flatten(F.transform(w, lambda a, i: F.transform(F.slice(w, i + 2, F.size(w)), lambda b: F.concat_ws(" ", a, b))))


def _person(accounts: DataFrame) -> DataFrame:
    anchor = F.when(F.col("kind").isin(*ANCHORS), F.concat_ws(":", "kind", "external_id"))
    return accounts.where("not is_bot").withColumn("person", F.coalesce("person_id", anchor))


def stitched(accounts: DataFrame) -> DataFrame:
    """(id, person_id, tier) of accounts (id, kind, external_id, email, name, is_bot, person_id) that belong to a person.

    Tiers: ``known`` (had a person), ``anchor``, ``verified``, ``tracker``.  Of several people of one address
    the smallest counts.  Bots belong to nobody.
    """
    rows = _person(accounts)
    held = rows.where("person is not null").select("id", F.col("person").alias("person_id"), F.when(F.col("person_id").isNotNull(), "known").otherwise("anchor").alias("tier"))
    of = lambda kind, tier: rows.where((F.col("kind") == kind) & F.col("person").isNotNull() & F.col("email").isNotNull()).groupBy(F.lower("email").alias("address")).agg(F.min("person").alias(tier))
    mails = rows.where("kind = 'commit' and person is null").select("id", F.lower("external_id").alias("address"))
    found = mails.join(of("login", "verified"), "address", "left").join(of("tracker", "tracker"), "address", "left").where("verified is not null or tracker is not null")
    tier = F.when(F.col("verified").isNotNull(), "verified").otherwise("tracker")
    return held.unionByName(found.select("id", F.coalesce("verified", "tracker").alias("person_id"), tier.alias("tier")))


def suggestions(accounts: DataFrame) -> DataFrame:
    """(id, other_id, reason, confidence): one suggestion at most for each address of a commit that belongs to nobody."""
    rows = _person(accounts)
    mails = rows.where("kind = 'commit'").select("id", F.lower("external_id").alias("address"), local_part(F.col("external_id")).alias("part"))
    loose = rows.where("kind = 'commit' and person is null").select("id", "name").join(stitched(accounts).select("id"), "id", "left_anti").join(mails, "id")

    # The first account of a local part, and the first of those with another address than that one's.
    first = mails.where("part is not null").groupBy("part").agg(F.min("id").alias("first"), F.min_by("address", "id").alias("first_address"))
    second = mails.join(first, "part").where("address <> first_address").groupBy("part").agg(F.min("id").alias("second"))
    other = F.when(F.col("address") != F.col("first_address"), F.col("first")).otherwise(F.col("second"))
    by_part = loose.join(first, "part").join(second, "part", "left").select("id", other.alias("other_id"), F.lit("local_part").alias("reason"), F.lit(LOCAL_PART).alias("confidence")).where("other_id is not null")

    left = loose.join(by_part.select("id"), "id", "left_anti").select("id", words(F.col("name")).alias("w")).where(F.size("w") > 0)
    people = rows.where("person is not null").select(F.col("id").alias("other_id"), words(F.col("name")).alias("w")).where(F.size("w") > 0)
    index = lambda df, key: df.select("other_id", F.explode(key).alias("key")).groupBy("key").agg(F.min("other_id").alias("other_id"))
    w = F.col("w")
    looked_up = [
        (left, _pairs(w), people, _pairs(w)),  # two words of each
        (left.where(F.size("w") == 1), w, people, w),  # the only word of this one
        (left.where(F.size("w") > 1), w, people.where(F.size("w") == 1), w),  # the only word of the other
    ]
    hits = None
    for mine, key, theirs, other_key in looked_up:
        hit = mine.select("id", F.explode(key).alias("key")).join(index(theirs, other_key), "key").select("id", "other_id")
        hits = hit if hits is None else hits.union(hit)
    by_name = hits.groupBy("id").agg(F.min("other_id").alias("other_id")).select("id", "other_id", F.lit("like_name").alias("reason"), F.lit(LIKE_NAME).alias("confidence"))
    return by_part.unionByName(by_name)
