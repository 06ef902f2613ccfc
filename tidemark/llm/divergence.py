"""How far the sources of a language lie apart in their use of words.

Documents are counted into one row for each language and term, the term's wide vector: its occurrences in
each source of the language, by the source's place.  Shares, and what each pair of sources differs by at a
term, are worked out from that vector by functions of arrays in the JVM; the sums over terms are combined
where the terms are before anything is shuffled.  All figures are integers, so no order of adding shows.

Null texts, languages and sources read as empty strings.  An empty table gives no rows; a source without
terms is a group like any other, all of whose counts are zero.  Repeated rows count each time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.llm.shared import staged

#: What stands between terms: ASCII but for letters.
_BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Shares are in units of one over this many; every count gets so many for nothing.
SCALE, PRIOR = 1_000_000_000, 5
#: Groups of at most so many rows (some MB) are broadcast to the terms; more are joined in slices.
_MOST_BROADCAST, _SLICES = 1 << 16, 64


def lowered(term: Column) -> Column:
    """A-Z in lower case and nothing else."""
    return F.when(F.lower(term) == term, term).otherwise(F.translate(term, _UPPER, _LOWER))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents that have the term), from whole texts.

    Each text is cut up once; its terms and its distinct terms are added up in the same pass, so a document
    is never gathered again to tell in how many a term occurs.
    """
    read = lambda c: F.coalesce(F.col(c), F.lit(""))
    terms = F.transform(F.filter(F.split(read("text"), _BETWEEN), lambda t: t != ""), lowered)
    cut = docs.select(read("lang").alias("lang"), read("source").alias("source"), terms.alias("terms"))
    each = cut.select("lang", "source", F.explode(F.array(F.struct(F.lit(0).alias("once"), "terms"), F.struct(F.lit(1).alias("once"), F.array_distinct("terms").alias("terms")))).alias("x"))
    rows = each.select("lang", "source", F.col("x.once").alias("once"), F.explode("x.terms").alias("term"))
    return rows.groupBy("lang", "source", "term").agg(F.sum((1 - F.col("once")).cast("long")).alias("n"), F.sum(F.col("once").cast("long")).alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms)), exactly."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", wide(count + PRIOR) * F.lit(SCALE).cast("decimal(10,0)"), wide(total + PRIOR * terms))


def _vectors(counts: DataFrame, least_docs: int) -> DataFrame:
    """lang, term, total, by: the occurrences by source, for the terms that enough documents of the language have."""
    wide = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("by"))
    return wide.where(F.col("docs") >= least_docs).select("lang", "term", "total", F.map_from_entries("by").alias("by"))


def _groups(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """A row for each language: terms (how many are kept), total, sources in order of bytes, and each one's occurrences."""
    read = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    there = docs.select(read("lang"), read("source")).distinct()
    each = vectors.select("lang", F.explode("by").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    sums = vectors.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("total"))
    by_source = there.join(each, ["lang", "source"], "left").select("lang", F.struct("source", F.coalesce("n", F.lit(0)).alias("n")).alias("s"))
    by_lang = by_source.groupBy("lang").agg(F.sort_array(F.collect_list("s")).alias("s"))
    return by_lang.join(sums, "lang", "left").select("lang", F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("total", F.lit(0)).alias("total"), F.col("s.source").alias("sources"), F.col("s.n").alias("ns"))


def _with_groups(vectors: DataFrame, groups: DataFrame) -> DataFrame:
    """Join each term with its language's groups, whose number is looked at before they are broadcast."""
    size = groups.agg(F.sum(F.size("sources"))).first()[0] or 0
    if size <= _MOST_BROADCAST:
        return vectors.join(F.broadcast(groups), "lang")
    sliced = groups.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(_SLICES - 1))))
    return vectors.withColumn("slice", F.pmod(F.hash("term"), F.lit(_SLICES))).join(sliced, ["lang", "slice"]).drop("slice")


def source_divergence(docs: DataFrame, least_docs: int = 30, top_terms: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank of every (lang, source) group.

    Part ``pair`` holds each other source of the language and the sum, over all kept terms, of what their
    shares differ by; part ``term`` the kept terms that the group has more of than its language, at most
    ``top_terms`` of them.  Ranks go by falling value, then by the item's UTF-8 bytes.
    """
    vectors = staged(_vectors(term_counts(docs), least_docs), "term_vectors")
    groups = staged(_groups(docs, vectors), "term_groups")
    zero = F.lit(0).cast("long")
    counts = F.transform("sources", lambda s: F.coalesce(F.element_at("by", s), zero))
    joined = _with_groups(vectors, groups.withColumnRenamed("total", "lang_total")).withColumn("counts", counts)
    shares = F.transform("counts", lambda n, i: share(n, F.get("ns", i), F.col("terms")))
    wide = joined.select("lang", "term", "total", "lang_total", "terms", "sources", "counts", shares.alias("p"))

    # every place but the last, and how far the places behind it are from it
    steps = wide.where(F.size("p") > 1).select("lang", "p", F.explode(F.sequence(F.lit(0), F.size("p") - 2)).alias("i"))
    apart = steps.select("lang", "i", F.posexplode(F.transform(F.slice("p", F.col("i") + 2, F.size("p")), lambda x: F.abs(x - F.get("p", F.col("i"))))).alias("k", "f"))
    sums = apart.groupBy("lang", "i", (F.col("i") + 1 + F.col("k")).alias("j")).agg(F.sum("f").alias("value"))
    each = groups.select("lang", F.posexplode("sources").alias("i", "source"))
    other = each.select(F.col("lang"), F.col("i").alias("j"), F.col("source").alias("item"))
    both = sums.select("lang", "i", "j", "value").union(sums.select("lang", F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    pairs = each.join(other, "lang").where(F.col("i") != F.col("j")).join(both, ["lang", "i", "j"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", zero).alias("value"))

    above = wide.select("lang", "term", F.explode(F.arrays_zip("sources", "counts", "p")).alias("g"), share(F.col("total"), F.col("lang_total"), F.col("terms")).alias("q"))
    more = above.where((F.col("g.counts") > 0) & (F.col("g.p") > F.col("q")))
    terms = more.select("lang", F.col("g.sources").alias("source"), F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("g.p") - F.col("q")).alias("value"))

    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).union(ranked(terms).where(F.col("rank") <= top_terms))
