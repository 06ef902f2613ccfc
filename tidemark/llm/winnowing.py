"""Fingerprints of documents by winnowing, with functions of arrays alone.

Every run of ``k`` code points has a hash; of each window of ``w`` successive hashes the least is marked, the
rightmost of equal ones, and its position is kept.  So two texts that share ``k + w - 1`` or more code points
in a row share a mark, wherever the passage stands.

A text is worked through in chunks whose windows follow on each other, so what is held at a time doesn't
grow with the text.  A window's least hash is found by halving: the least of 4, of 16, of 32 successive
hashes.  Hash and position stand in one number, so that the least number is the least hash furthest right.

Null and empty texts have no mark and an empty fingerprint; a text of under ``k`` code points has one mark,
that of the whole text; one of fewer than ``w`` hashes has their least.  Equal texts have equal fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.llm.shared import bound, kept_columns, own_names, quoted

#: Code points a hash, hashes a window (a power of two), hashes a chunk.
K, WINDOW, CHUNK = 16, 32, 4096
_PLACE = CHUNK.bit_length() - 1
#: Hexadecimal digits of a mark in a fingerprint, the leading ones of its hash.
_DIGITS = 10


def _least_of(values: Column, w: int) -> Column:
    """The least of each ``w`` successive values, for a power of two; four or two at a time."""
    have = 1

    def pass_over(values: Column, step: int, times: int) -> Column:
        last = F.size(values) - 1 - step * (times - 1)
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.least(*[F.get(values, i + step * j if j else i) for j in range(times)]))

    def further(values: Column, have: int) -> Column:
        if have == w:
            return values
        times = 4 if have * 4 <= w else 2
        return bound(pass_over(values, have, times), lambda v: further(v, have * times))

    return further(values, have)


def _chunk_marks(points: Column, chunk: Column, k: int, w: int) -> Column:
    """The marks of one chunk: ``points`` are its code points, four bytes each."""
    hashes = F.greatest((F.octet_length(points) / 4).cast("int") - (k - 1), F.lit(1))
    # from the right end of a full chunk, so that a lesser number stands further right
    places = F.sequence(F.lit(CHUNK - 1), F.lit(CHUNK) - hashes, F.lit(-1))
    numbers = F.transform(places, lambda r: F.shiftleft(F.xxhash64(F.substring(points, F.lit(4 * CHUNK - 3) - r * 4, F.lit(4 * k))), _PLACE).bitwiseOR(r.cast("long")))
    least = bound(numbers, lambda v: F.when(F.size(v) >= w, _least_of(v, w)).otherwise(F.array(F.array_min(v))))
    first = chunk.cast("long") * (CHUNK - w + 1) + (CHUNK - 1)
    return F.transform(F.array_distinct(least), lambda v: F.struct((first - v.bitwiseAND(F.lit(CHUNK - 1).cast("long"))).alias("pos"), F.shiftrightunsigned(v, 64 - 4 * _DIGITS).alias("hash")))


def chunk_marks(text: Column, k: int = K, w: int = WINDOW, start: Column | None = None) -> Column:
    """An array of each chunk's marks, from chunk ``start`` on; what both of two chunks mark is in both."""
    step = CHUNK - w + 1
    start = F.lit(0) if start is None else start

    def cut(points: Column) -> Column:
        length = (F.octet_length(points) / 4).cast("int")
        windows = F.greatest(length - (k + w - 2), F.least(length, F.lit(1)))
        last = F.ceil(windows / step).cast("int") - 1
        each = lambda c: bound(F.substring(points, c * (4 * step) + 1, F.lit(4 * (CHUNK + k - 1))), lambda p: _chunk_marks(p, c, k, w))
        return F.when(last >= start, F.transform(F.sequence(start, last), each)).otherwise(F.array().cast("array<array<struct<pos:bigint,hash:bigint>>>"))

    return bound(F.encode(F.coalesce(text, F.lit("")), "UTF-32"), cut)


def joined(chunks: Column) -> Column:
    """All chunks' marks by rising position, each position once."""
    return bound(F.flatten(chunks), lambda m: F.filter(m, lambda x, i: (i == 0) | (F.get(m, i - 1)["pos"] != x["pos"])))


def marks(text: Column, k: int = K, w: int = WINDOW) -> Column:
    """array<struct<pos, hash>>: what winnowing marks in the text; positions count code points from 0."""
    return joined(chunk_marks(text, k, w))


def fingerprint(found: Column) -> Column:
    """The marks' hashes as hexadecimal words, in the order of their positions."""
    return F.array_join(F.transform(found, lambda m: F.lower(F.lpad(F.hex(m["hash"]), _DIGITS, "0"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of hashes; two empty ones are alike."""
    both = F.array_union(a, b)
    return F.when(F.size(both) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(both))


def with_marks(docs: DataFrame, out: str = "marks", k: int = K, w: int = WINDOW) -> DataFrame:
    """``docs`` with ``out``, the marks of its column ``text``, in place of any column of that name."""
    return docs.select(*kept_columns(docs, out), marks(F.col("text"), k, w).alias(out))


def with_next(docs: DataFrame, order: str, columns: list[str], out: str, extra: dict[str, Column] | None = None) -> DataFrame:
    """``docs`` with ``extra`` and ``out``, a struct of ``columns`` and ``extra`` of the next row by ``order``.

    The last row is followed by the first.  Nulls of ``order`` come first; rows of one go by their columns'
    hash.  The order is cut into ranges of about equal numbers of rows, whose starts the driver is told; rows are
    dealt out once, and each range is lent the first row of the next.  ``extra`` is worked out after that, so
    that it needn't travel.  Equal rows may stand in several ranges: it is all the same which follows which.
    """
    spark, extra = docs.sparkSession, extra or {}
    own = own_names(docs, out, *extra)
    at, h, salt, part, lent = map(own, ("at", "h", "salt", "part", "lent"))
    key = lambda df: df.withColumns({at: F.col(quoted(order)), h: F.xxhash64(*map(quoted, columns))})
    salted = lambda df: df.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(1021)))
    ranges = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    narrow = salted(key(docs.select(*map(quoted, dict.fromkeys([order, *columns]))))).select(at, h, salt)
    dealt = narrow.repartitionByRange(ranges, at, h, salt).groupBy(F.spark_partition_id()).agg(F.min(F.struct(at, h, salt)).alias("first"))
    firsts = dealt.select("first.*").sort(F.asc_nulls_first(at), h, salt).collect() or [(None, 0, 0)]
    start = lambda a, b, *names: [F.lit(a).cast(narrow.schema[at].dataType).alias(names[0]), F.lit(b).cast("long").alias(names[1])]
    starts = F.array(*[F.struct(*start(a, b, at, h), F.lit(c).cast("long").alias(salt)) for a, b, c in firsts])
    halves = F.array(*[F.lit(1 << i) for i in reversed(range(len(firsts).bit_length()))])
    place = lambda x: F.aggregate(halves, F.lit(0), lambda had, step: F.when((had + step < len(firsts)) & (F.get(starts, had + step) <= x), had + step).otherwise(had))
    rows = salted(key(docs)).withColumn(part, bound(F.struct(at, h, salt), place)).withColumn(lent, F.lit(False))

    to: dict[tuple, list[int]] = {}
    for i, (a, b, _) in enumerate(firsts):
        to.setdefault((a, b), []).append((i - 1) % len(firsts))
    lending = spark.range(1).select(F.inline(F.array(*[F.struct(*start(a, b, "a", "b"), F.array(*map(F.lit, parts)).alias("parts")) for (a, b), parts in to.items()])))
    heads = key(docs).join(F.broadcast(lending), F.col(at).eqNullSafe(F.col("a")) & (F.col(h) == F.col("b")))  # a row for each start
    first_of = heads.groupBy(at, h).agg(*[F.min(quoted(c)).alias(c) for c in columns], F.first("parts").alias(own("parts")))
    visitors = first_of.select(*map(quoted, columns), at, h, F.explode(own("parts")).alias(part), F.lit(0).cast("long").alias(salt), F.lit(True).alias(lent))
    together = rows.unionByName(visitors, allowMissingColumns=True).repartition(part).withColumns(extra)
    following = F.lead(F.struct(*map(quoted, [*columns, *extra]))).over(W.partitionBy(part).orderBy(lent, F.asc_nulls_first(at), h, salt))
    return together.withColumn(out, following).where(~F.col(lent)).select(*map(quoted, [*docs.columns, *extra, out]))


def edited_report(docs: DataFrame, k: int = K, w: int = WINDOW) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, positions.

    The edited text has its last quarter replaced by the beginning of the next document's.  Chunks that lie
    wholly within what stays keep their marks; the others are marked anew.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(texts, "doc_id", ["text"], "next", {"chunks": chunk_marks(F.col("text"), k, w)})
    n = F.length("text")
    cut = rows.withColumn("n_chars", n.cast("long")).withColumn("gone", F.floor(n / 4).cast("int")).withColumn("kept", n - F.col("gone"))
    cut = cut.withColumn("edited", F.concat(F.expr("substring(text, 1, kept)"), F.expr("substring(next.text, 1, gone)")))
    # the chunks before this one end where the edit begins or earlier
    cut = cut.withColumn("same", F.greatest(F.floor((F.col("kept") - (CHUNK + k - 1)) / (CHUNK - w + 1)).cast("int") + 1, F.lit(0)))
    anew = chunk_marks(F.col("edited"), k, w, F.col("same"))
    found = cut.withColumns({"a": joined(F.col("chunks")), "b": joined(F.concat(F.slice("chunks", F.lit(1), F.col("same")), anew)), "c": joined(F.col("next.chunks"))})
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("a")).alias("fingerprint"),
        fingerprint(F.col("b")).alias("edited_fingerprint"),
        likeness(F.col("a.hash"), F.col("b.hash")).alias("near_edited"),
        likeness(F.col("a.hash"), F.col("c.hash")).alias("near_next"),
        F.col("a.pos").alias("positions"),
    )
