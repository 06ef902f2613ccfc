"""SimHash near-duplicates found through pivot distance tables.

Each fingerprint gets a table of its Hamming distances to many reference fingerprints (pivots).  By
the triangle inequality two fingerprints within ``k`` bits have distances that differ by at most ``k``
at every pivot.  The pivots are the origin and, for each of four 16-bit segments, its 16 Walsh words (the
first of them has all bits): what a segment's pivots say less the origin's distance is the segment's Walsh
transform, so it depends on that segment alone and tells it from every other.  At most ``k`` bits differ,
so all but ``k`` segments have equal coordinates: candidates are an equi-join on those, never all pairs.
Candidates whose largest coordinate difference over the pivots is over ``k`` are discarded; survivors are
verified bit by bit.  Where many fingerprints share coordinates, what of them may still differ is cut into
four segments again, with pivots of their own, until few do: the same way, on finer pivots.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components, one_of_each
from tidemark.llm.shared import quoted, staged

SEGMENTS = 4
_CHUNK = 1 << 16


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def walsh_words(bits: list[int]) -> list[int]:
    """The Walsh words of some bit positions, a power of two of them: the h-th has the bits of odd parity with h, the first all."""
    n = len(bits)
    return [sum(1 << b for b in bits)] + [sum((bin(h & i).count("1") & 1) << b for i, b in enumerate(bits)) for h in range(1, n)]


def quarters(bits: list[int]) -> list[list[int]]:
    n = len(bits) // SEGMENTS
    return [bits[s * n : s * n + n] for s in range(SEGMENTS)]


def walsh_pivots() -> list[list[int]]:
    """The Walsh words of each segment, as 64-bit fingerprints that are zero elsewhere."""
    return [walsh_words(own) for own in quarters(list(range(64)))]


def simhash(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit fingerprint of a whole text: bit set if set in over half its shingles' XXH64."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, seed)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts, stops = [0, *ends], ends[shingle - 1 :]
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(stops), _CHUNK):
        part = np.array([digest(joined[s : e - 1], seed) for s, e in zip(starts[i : i + _CHUNK], stops[i : i + _CHUNK], strict=False)], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(stops), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the fingerprint of every row's whole text as a signed long; null text is empty, a null id stays."""

    def run(batches):
        for batch in batches:
            fps = [simhash(t, shingle, seed) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64), pa.int64())], ["doc_id", "fp"])

    slim = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, fp long")


def pivot_table(fps: DataFrame) -> DataFrame:
    """Add ``origin`` (distance to 0) and ``pivots`` (distances to the Walsh words, segment by segment)."""
    words = F.array(*[F.lit(_signed(p)) for own in walsh_pivots() for p in own])
    return fps.withColumns({"origin": F.bit_count("fp"), "pivots": F.transform(words, lambda p: F.bit_count(F.col("fp").bitwiseXOR(p)))})


def _cuts(paths: dict[int, list[int]], distance: int) -> tuple[list[tuple[int, int, list[int]]], dict[int, list[int]]]:
    """For each path, whose bits may differ: (path, child, pivots of the segments that stay equal), and the children's bits."""
    rows, children = [], {}
    for path, bits in paths.items():
        segments = quarters(bits)
        for equal in combinations(range(SEGMENTS), SEGMENTS - distance):
            child = len(children)
            rows.append((path, child, [_signed(w) for s in equal for w in walsh_words(segments[s])]))
            children[child] = [b for s in range(SEGMENTS) if s not in equal for b in segments[s]]
    return rows, children


def links(fps: DataFrame, distance: int = 2, cap: int = 256) -> DataFrame:
    """Edges (a, b): all pairs of distinct ``fp`` within ``distance`` (0 to 2) bits.

    Buckets hold fingerprints of equal coordinates in the segments that may not differ.  One of more than
    ``cap`` is dealt into buckets by the coordinates of finer segments of what may still differ, and so
    on: 32, 16, then 8 bits at distance 2, which hold 256 fingerprints at most.  Every pair of a bucket
    that is cut no further is filtered by the pivot table and verified.
    """
    if not 0 <= distance <= 2:
        raise ValueError("distance must be 0, 1 or 2")
    found = fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    if not distance:
        return found
    rows = fps.select("fp", F.lit(0).alias("path"), F.lit(0).cast("long").alias("key"))
    paths = {0: list(range(64))}
    while True:
        cuts, paths = _cuts(paths, distance)
        table = F.broadcast(fps.sparkSession.createDataFrame(cuts, "path int, child int, words array<long>"))  # 6, 36, then 216 rows at distance 2
        told = F.transform("words", lambda w: F.bit_count(F.col("fp").bitwiseXOR(w)) - F.bit_count("fp"))
        keyed = rows.join(table, "path").select("fp", F.col("child").alias("path"), F.xxhash64("key", "child", told).alias("key"))
        # Nearly every bucket holds one fingerprint: those go before the tables are joined.
        sizes = keyed.groupBy("path", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        held = staged(keyed.join(sizes.hint("merge"), ["path", "key"]), "buckets")
        last = len(paths[0]) < SEGMENTS
        small = pivot_table(held if last else held.where(F.col("n") <= cap)).drop("n")
        other = small.select(*[F.col(c).alias(f"{c}2") for c in small.columns]).hint("merge")
        apart = F.array_max(F.zip_with("pivots", "pivots2", lambda x, y: F.abs(x - y)))
        near = small.join(
            other,
            (F.col("path") == F.col("path2"))
            & (F.col("key") == F.col("key2"))
            & (F.col("fp") < F.col("fp2"))
            & (F.abs(F.col("origin") - F.col("origin2")) <= distance)
            & (apart <= distance)
            & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= distance),
        ).select(F.col("fp").alias("a"), F.col("fp2").alias("b"))
        found = found.union(near)
        if last or held.where(F.col("n") > cap).isEmpty():
            return found
        rows = held.where(F.col("n") > cap).select("fp", "path", "key")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42, distance: int = 2, cap: int = 256) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row for each row of ``docs``.

    ``component_id`` is the smallest doc_id that links of at most ``distance`` differing bits reach.
    Equal fingerprints are one node, so exact copies cost one row each.  Null texts count as empty,
    texts without words have fingerprint zero and link like any other; a null doc_id keeps its row and
    is never the smallest; repeated rows are repeated in the result; other columns are not used.
    """
    of = staged(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    nodes = staged(of.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    found = components(links(nodes, distance, cap))
    reached = found.join(nodes, F.col("node") == F.col("fp")).groupBy("root").agg(F.min("first").alias("least"))
    labels = staged(found.join(reached, "root").select("node", "least"), "labels")
    labelled = nodes.join(labels, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("of_fp"), F.coalesce("least", "first").alias("component_id"))
    joined = of.join(labelled, F.col("fp") == F.col("of_fp"))
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """One row of ``docs`` for each component: that of its smallest id; columns stay.

    Rows of a null id all stay.  Rows that repeat an id and its text leave one; those that repeat an id
    with another text go or stay together.
    """
    return one_of_each(docs, simhash_components(docs, id_col, text_col, **parameters), id_col, text_col)
