"""Near copies by SimHash and exact Jaccard similarity of word shingles.

Fingerprints within two bits, found through the pivot distance tables of ``simhash``, are compared in whole
first: nearly equal texts meet there.  Texts of similarity ``t`` may differ in more bits, so the rest are
found by prefixes: in any one order of all shingles, two sets of that similarity share one of their first
``n - ceil(t n) + 1`` shingles, so candidates are an equi-join on those and no pair is missed.  The order
puts shingles last that a sample of the texts has often; it changes the work, never the result.

A set's bitmap has a bit for each hash of shingles, set if an odd number of its shingles have it: two bitmaps
differ in no more bits than their sets in shingles.  Small buckets give all their pairs whose bitmaps let them be
similar, and each but where both texts' bucket before is the same one, which gave the pair already.  First each
text is compared with one of its candidates, then only candidates that this leaves in different components.

A large group of near copies shares its prefixes, and its pairs would be a square.  So links of large buckets are
sought in rounds: each text that others of its buckets are not yet joined to is compared with that one of a few
of them whose bitmap is nearest, and components are formed anew.  Where very many pairs of large buckets still
lie in different components, texts share a passage without being near copies: its shingle goes to the end of the
order, and the texts that had it among their first get others instead, while that at least halves such pairs.  Any
order misses no pair; those that then still lie in different components are all held against each other's bitmaps,
and compared where these let them be similar, so no link between components is lost.
"""

from __future__ import annotations

import math
import operator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm import simhash
from tidemark.llm.components import components
from tidemark.llm.shared import drop_staged, own_names, quoted, release, staged

#: One text in so many is looked at for common shingles, and so many of the commonest are put last.
_SAMPLE, _COMMON = 16, 100_000
#: A bucket of at most so many gives all its pairs at once; no more than such a shingle of the sample is common.
_SMALL = 48
#: Heads of a bucket that its texts are held against in a round, and the most rounds; rounds end when what
#: pairs are left are few for each text, or a round leaves over half of them.
_HEADS, _ROUNDS, _FEW = 8, 6, 2
#: The order changes while there are over so many pairs for each text; then a shingle goes last if its bucket has over
#: so many; how many go at once, and how often that may be.
_LINEAR, _MANY, _MOVED, _ORDERS = 4, 8, 100_000, 3
#: Longs of a set's bitmap, and of how many bits on a pair's bitmaps may differ that says little of unlike texts.
_LONGS, _WEAK = 8, 192


def shingles(text: str | None, n: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted distinct XXH64 of a whole text's ``n``-word shingles; fewer words are one shingle, none are none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    hashes = [digest(b" ".join(words[i : i + n]), seed) for i in range(max(1, len(words) - n + 1))]
    return np.unique(np.array(hashes, dtype=np.uint64).view(np.int64))


def _name(own: np.ndarray) -> int:
    h = xxhash.xxh64_intdigest(own.tobytes(), 7)
    return h - (1 << 64) if h >> 63 else h


def fingerprint(own: np.ndarray) -> int:
    """The signed 64-bit SimHash of a set of shingles: a bit is set that over half of them have; none, zero."""
    if not len(own):
        return 0
    bits = np.unpackbits(own.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(own), bitorder="little").view("<i8")[0])


def bitmap(own: np.ndarray) -> np.ndarray:
    """A set's bitmap as longs: a bit is set if an odd number of its shingles have that bit's number at their end."""
    odd = np.bincount(own & (64 * _LONGS - 1), minlength=64 * _LONGS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def bits_apart(one: Column, other: Column) -> Column:
    """In how many bits two bitmaps differ."""
    return reduce(operator.add, [F.bit_count(one[f"b{k}"].bitwiseXOR(other[f"b{k}"])) for k in range(_LONGS)])


def may_match(size: Column, bits: Column, size2: Column, bits2: Column, similarity: float) -> Column:
    """Whether sets of those sizes and bitmaps can be so similar: bitmaps differ in no more bits than sets in shingles."""
    near = F.least(size, size2) >= similarity * F.greatest(size, size2) - 1e-6
    return near & (bits_apart(bits, bits2) <= (1 - similarity) / (1 + similarity) * (size + size2) + 1e-6)


def prefix_length(size: int, similarity: float) -> int:
    """Of so many first shingles of a set, two similar ones share one; rounding may lengthen it, never shorten it."""
    return size - math.ceil(similarity * size - 1e-6) + 1


def common_shingles(docs: DataFrame, shingle: int):
    """The commonest shingles of a sample, rarest first, on every executor: what comes last in the order."""
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(_SAMPLE)) == 0)

    def every(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                own = [shingles(t, shingle) for t in batch.column(0).slice(at, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own))], ["key"])

    seen = sample.select("text").mapInArrow(every, "key long").groupBy("key").count().where("count > 2")
    common = seen.orderBy(F.desc("count"), "key").limit(_COMMON).toArrow()
    return docs.sparkSession.sparkContext.broadcast(rarest_first(common["key"], common["count"]))


def rarest_first(keys: pa.ChunkedArray, n: pa.ChunkedArray) -> np.ndarray:
    """The keys by their number ``n``, then by themselves; as arrays, since rows of Python are large."""
    keys, n = keys.to_numpy().astype(np.int64), n.to_numpy()
    return keys[np.lexsort((keys, n))]


def in_order(last: np.ndarray):
    """A function that puts a set of shingles in order: those of ``last`` come last, in its order."""
    by = np.argsort(last)
    sorted_last = last[by]

    def ordered(own: np.ndarray) -> np.ndarray:
        rank = np.full(len(own), -1)
        if len(last):
            at = np.minimum(np.searchsorted(sorted_last, own), len(last) - 1)
            rank = np.where(sorted_last[at] == own, by[at], -1)
        return own[np.lexsort((own, rank))]

    return ordered


def first_shingles(docs: DataFrame, shingle: int, similarity: float, last) -> DataFrame:
    """(doc_id, same, node, size, fp, bits, keys): the shingles of which a set of that similarity must share one.

    ``same`` is a hash of the text itself, which tells rows that repeat an id apart.  Of equal sets in one task one
    has the shingles, the others none: a large group of copies makes no large buckets.
    """
    names = [f"b{k}" for k in range(_LONGS)]

    def run(batches):
        ordered, seen = in_order(last.value), set()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                own = [shingles(t, shingle) for t in batch.column(2).slice(at, 256).to_pylist()]
                nodes = [_name(s) for s in own]
                out = [ordered(s)[: prefix_length(len(s), similarity)] if node not in seen and not seen.add(node) else s[:0] for s, node in zip(own, nodes, strict=True)]
                ends = pa.array(np.cumsum([0, *map(len, out)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(out)))
                maps = np.stack([bitmap(s) for s in own])
                bits = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(maps[:, k])) for k in range(_LONGS)], names)
                of = [pa.array(nodes, pa.int64()), pa.array([len(s) for s in own], pa.int32()), pa.array([fingerprint(s) for s in own], pa.int64()), bits, lists]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, 256) for c in (0, 1)), *of], ["doc_id", "same", "node", "size", "fp", "bits", "keys"])

    told = f"doc_id long, same long, node long, size int, fp long, bits struct<{', '.join(f'{n}: long' for n in names)}>, keys array<long>"
    return docs.select("doc_id", F.xxhash64("text").alias("same"), "text").mapInArrow(run, told)


def moved_last(last, moved: np.ndarray, spark):
    """The order ``last`` with the shingles ``moved`` behind all others."""
    return spark.sparkContext.broadcast(np.concatenate([last.value[~np.isin(last.value, moved)], moved]))


def weak(size: Column, size2: Column, similarity: float) -> Column:
    """Whether sets are so large that the bitmaps of unlike ones may pass as those of similar ones."""
    return (1 - similarity) / (1 + similarity) * (size + size2) > _WEAK


def candidates(shared: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of ``shared`` (a, size, bits, more, b, size2, bits2, more2) that may be similar.

    Pairs whose bitmaps say little have a row for each prefix shingle of both.  With ``k`` of them at most ``k`` and the
    rest behind a prefix are in both sets, and as many as ``more`` and ``more2`` tell of shingles that ``shared`` leaves out.
    """
    size, size2 = F.col("size"), F.col("size2")
    behind = F.ceil(similarity * F.greatest(size, size2) - 1e-6) - 1
    k = F.count(F.lit(1)) + F.least(F.min("more"), F.min("more2"))
    pairs = shared.where(may_match(size, F.col("bits"), size2, F.col("bits2"), similarity)).groupBy("a", "b", "size", "size2").agg(k.alias("k"))
    return pairs.where(~weak(size, size2, similarity) | (F.col("k") + behind >= similarity / (1 + similarity) * (size + size2) - 1e-6)).select("a", "b")


def texts_of(asked: DataFrame, docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """(node, text) of the nodes ``asked``, each the text of its smallest id.

    Where an id is repeated with other texts, those come along under the node's name; ``similar`` knows them.
    """
    used = nodes.join(asked.distinct().hint("merge"), "node", "left_semi").select("node", F.col("first").alias("__id"))
    named = docs.join(used.where("__id is not null").hint("merge"), F.col("doc_id") == F.col("__id")).select("doc_id", "node", "text").dropDuplicates()
    nameless = docs.where("doc_id is null").select("doc_id", "text").distinct()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                texts = batch.column(1).slice(at, 256)
                yield pa.RecordBatch.from_arrays([pa.array([_name(shingles(t, shingle)) for t in texts.to_pylist()], pa.int64()), texts], ["node", "text"])

    rest = nameless.mapInArrow(run, "node long, text string").join(used.where("__id is null").select("node").hint("merge"), "node", "left_semi").dropDuplicates(["node"])
    return named.select("node", "text").union(rest)


def similar(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts' sets have at least that Jaccard similarity, each compared in whole.

    Texts go to their pairs, as they take less room than their sets.
    """
    pairs = staged(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "pairs")
    left, right = (texts.join(pairs.select(F.col(c).alias("node")).distinct().hint("merge"), "node", "left_semi").select(F.col("node").alias(c), F.col("text").alias(f"{c}_text")).hint("merge") for c in "ab")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, found = batch.slice(at, 256).to_pydict(), []
                for a, b, x, y in zip(part["a"], part["b"], part["a_text"], part["b_text"], strict=True):
                    own, other = shingles(x, shingle), shingles(y, shingle)
                    both = len(np.intersect1d(own, other, assume_unique=True))
                    if both >= similarity * (len(own) + len(other) - both) - 1e-6 and _name(own) == a and _name(other) == b:
                        found.append((a, b))
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in range(2)], ["a", "b"])

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "a_text", "b_text")
    return joined.mapInArrow(run, "a long, b long").distinct()


def pivot_pairs(nodes: DataFrame, distance: int = 2) -> DataFrame:
    """(a, b) of nodes whose fingerprints are within ``distance`` bits, through the pivot tables; of one fingerprint all with the smallest."""
    least = staged(nodes.groupBy("fp").agg(F.min("node").alias("least")), "fingerprints")
    near = simhash.links(least.select("fp"), distance)
    of = lambda c: least.select(F.col("fp").alias(f"{c}_fp"), F.col("least").alias(f"{c}_node")).hint("merge")
    apart = near.join(of("a"), F.col("a") == F.col("a_fp")).join(of("b"), F.col("b") == F.col("b_fp")).select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    return apart.union(nodes.join(least.hint("merge"), "fp").where("least < node").select(F.col("least").alias("a"), F.col("node").alias("b")))


def nearest_heads(held: DataFrame, similarity: float, turn: int) -> DataFrame:
    """(a, b): each node of ``held`` (key, node, size, bits, root) with the head of another component whose bitmap is nearest.

    A bucket's heads are the nodes of the smallest hashes, which differ from turn to turn; one that can't be similar isn't told.
    """
    member = F.struct("node", "size", "bits", "root")
    smallest = [F.min_by(member, F.xxhash64("node", F.lit(turn * _HEADS + k))).alias(f"h{k}") for k in range(_HEADS)]
    heads = held.groupBy("key").agg(*smallest).select("key", F.array(*[f"h{k}" for k in range(_HEADS)]).alias("heads"))
    fits = lambda h: (h["root"] != F.col("root")) & may_match(F.col("size"), F.col("bits"), h["size"], h["bits"], similarity)
    nearest = F.array_min(F.transform(F.filter("heads", fits), lambda h: F.struct(bits_apart(F.col("bits"), h["bits"]).alias("bits"), h["node"].alias("node"))))
    told = held.join(heads.hint("merge"), "key").select("node", nearest.alias("head")).where("head is not null")
    return told.groupBy("node").agg(F.min("head").alias("head")).select(F.col("node").alias("a"), F.col("head.node").alias("b"))


def shared_buckets(of: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, node, pos, n, size, bits, more) of the keys that more than one node has, each with its place in the node's order.

    ``more`` is in how many large buckets a node is.

    Nearly every bucket holds one node: those go where the keys meet, and keys move once.
    """
    of_key = W.partitionBy("key")
    keyed = of.select("node", F.posexplode("keys").alias("pos", "key")).select("key", "node", "pos", F.min("node").over(of_key).alias("least"), F.max("node").over(of_key).alias("most"))
    shared = keyed.where("least < most").select("key", "node", "pos").distinct().withColumn("n", F.count(F.lit(1)).over(of_key))
    known = shared.join(nodes.select("node", "size", "bits").hint("merge"), "node")
    return staged(known.select("key", "node", "pos", "n", "size", "bits", F.count(F.when(F.col("n") > _SMALL, 1)).over(W.partitionBy("node")).alias("more")), "buckets")


def met(held: DataFrame, similarity: float, *also: str) -> DataFrame:
    """(a, size, bits, more, b, size2, bits2, more2): pairs of ``held`` (key, node, pos, size, bits) that share a key and may be similar.

    Where the key before in both nodes' order is the same one, it has told the pair; so most pairs are told once,
    and each at the first key that it shares; those that ``candidates`` counts are told for each.  Nodes that agree in a
    column of ``also`` are no pair.
    """
    if "more" not in held.columns:
        held = held.withColumn("more", F.lit(0))
    at = held.withColumn("before", F.lag("key").over(W.partitionBy("node").orderBy("pos")))
    left = at.select("key", F.col("node").alias("a"), "size", "bits", "more", "before", *also)
    right = at.select(F.col("key").alias("key2"), F.col("node").alias("b"), *(F.col(c).alias(f"{c}2") for c in ("size", "bits", "more", "before", *also))).hint("merge")
    first = F.coalesce(F.col("before") != F.col("before2"), F.lit(True)) | weak(F.col("size"), F.col("size2"), similarity)
    on = (F.col("key") == F.col("key2")) & (F.col("a") < F.col("b")) & first & may_match(F.col("size"), F.col("bits"), F.col("size2"), F.col("bits2"), similarity)
    for c in also:
        on = on & (F.col(c) != F.col(f"{c}2"))
    return left.join(right, on).select("a", "size", "bits", "more", "b", "size2", "bits2", "more2")


def apart_still(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """The pairs (a, b) whose nodes ``edges`` leave in different components."""
    root = staged(components(edges), "roots")
    of = lambda c: root.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")).hint("merge")
    placed = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return placed.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b")


def pairs_apart(left: DataFrame) -> DataFrame:
    """(key, n, apart): a bucket's nodes, and how many pairs of them are of different components."""
    each = left.groupBy("key", "root").agg(F.count(F.lit(1)).cast("double").alias("c")).groupBy("key").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("q"))
    return each.select("key", "n", ((F.col("n") * F.col("n") - F.col("q")) / 2).alias("apart"))


def links(docs: DataFrame, of: DataFrame, nodes: DataFrame, shingle: int, similarity: float, last) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of nodes of at least ``similarity``.

    ``of`` is ``first_shingles`` in the order of ``last``; ``nodes`` has each node's smallest id, size and fingerprint.
    """
    spark = docs.sparkSession
    close = staged(pivot_pairs(nodes), "close")
    count = nodes.count()
    release(spark)
    edges, texts, moved, most = close.limit(0), None, np.zeros(0, dtype=np.int64), math.inf
    for order in range(_ORDERS + 1):
        held = shared_buckets(of, nodes)
        drop_staged(of)
        release(spark)
        pairs = staged(candidates(met(held.where(F.col("n") <= _SMALL), similarity), similarity), "candidates")
        left = staged(held.where(F.col("n") > _SMALL).select("key", "node", "pos", "size", "bits"), "large")
        drop_staged(held)
        release(spark)
        asked = left.select("node").union(pairs.select("a")).union(pairs.select("b"))
        if texts is None:
            asked = asked.union(close.select("a")).union(close.select("b"))
        else:
            asked = asked.distinct().join(texts.select("node").distinct().hint("merge"), "node", "left_anti")
        found = staged(texts_of(asked, docs, nodes, shingle), "texts")
        texts = found if texts is None else texts.union(found)
        release(spark)
        one = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
        edges = staged(edges.union(similar(one if order else one.union(close), texts, shingle, similarity)), "links")
        edges = staged(edges.union(similar(apart_still(pairs, edges), texts, shingle, similarity)), "links")
        drop_staged(pairs)
        before = math.inf
        for turn in range(_ROUNDS + 1):
            root = staged(components(edges), "roots")
            placed = staged(left.join(root.hint("merge"), "node", "left").select("key", "node", "pos", "size", "bits", F.coalesce("root", "node").alias("root")), "placed")
            mixed = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
            rest = staged(placed.join(mixed.hint("merge"), "key", "left_semi"), "mixed")
            for done in (left, placed, root):
                drop_staged(done)
            each = staged(pairs_apart(rest), "apart")
            rows, apart = each.agg(F.coalesce(F.sum("n"), F.lit(0.0)), F.coalesce(F.sum("apart"), F.lit(0.0))).first()
            # Heads join what is near; where they leave over half apart, texts share a passage and no more.
            if turn == _ROUNDS or apart <= _FEW * rows or apart > before / 2:
                break
            before = apart
            edges = staged(edges.union(similar(nearest_heads(rest, similarity, turn), texts, shingle, similarity)), "links")
            left = rest.drop("root")
        release(spark)
        # An order that doesn't halve what is apart won't mend it.
        if order == _ORDERS or apart <= _LINEAR * count or apart > most / 2:
            break
        worst = each.where(F.col("apart") > _MANY * F.col("n")).orderBy(F.desc("apart"), "key").limit(_MOVED).toArrow()
        worst = rarest_first(worst["key"], worst["n"])
        if np.isin(worst, moved).all():
            break
        most, moved = apart, np.union1d(moved, worst)
        last = moved_last(last, worst, spark)
        drop_staged(rest)
        # Texts are read again rather than all their shingles shuffled.
        of = staged(first_shingles(docs, shingle, similarity, last).select("node", "keys"), "shingles")
    return edges.union(similar(candidates(met(rest, similarity, "root"), similarity), texts, shingle, similarity))


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, same, least): one row for each row of ``docs``; ``least`` (doc_id, same) is the smallest that links reach.

    ``same`` is ``xxhash64`` of the text and tells rows that repeat an id with other texts apart.
    """
    slim = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).cast("string").alias("text"))
    last = common_shingles(slim, shingle)
    first = staged(first_shingles(slim, shingle, similarity, last), "shingles")
    of = staged(first.select("doc_id", "same", "node", "size", "fp", "bits"), "named")
    own = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "same")))
    nodes = staged(of.groupBy("node").agg(own.alias("own"), *(F.first(c).alias(c) for c in ("size", "fp", "bits"))).withColumn("first", F.col("own.doc_id")), "nodes")
    found = staged(components(links(slim, first.select("node", "keys"), nodes, shingle, similarity, last)), "components")
    reached = found.join(nodes.select("node", "own").hint("merge"), "node").groupBy("root").agg(F.min("own").alias("least"))
    labels = staged(found.join(reached.hint("merge"), "root").select("node", "least"), "labels")
    labelled = nodes.join(labels.hint("merge"), "node", "left").select("node", F.coalesce("least", "own").alias("least"))
    return of.select("doc_id", "same", "node").join(labelled.hint("merge"), "node").select("doc_id", "same", "least")


def jaccard_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """The rows of ``docs`` that are the smallest of their component by id, then by a hash of the text; all columns stay.

    Each row goes by its own text: where an id is repeated, a text that is no copy stays, and of near copies one does,
    as of rows that repeat an id and its text.  Rows of a null id all stay.
    """
    mine = own_names(docs)
    doc_id, text = F.col(quoted(id_col)), F.col(quoted(text_col))
    on = (doc_id.cast("long") == F.col(mine("id"))) & (F.xxhash64(text.cast("string")) == F.col(mine("same")))
    which = staged(jaccard_classes(docs, id_col, text_col, **parameters).where("doc_id is not null"), "classes")
    rows = which.select(F.col("doc_id").alias(mine("id")), F.col("same").alias(mine("same")), (F.struct("doc_id", "same") == F.col("least")).alias("stays"))
    # What goes grows with the input, so it is merged at every size, never broadcast while it is small.
    kept = docs.join(rows.where("not stays").drop("stays").distinct().hint("merge"), on, "left_anti")
    again = staged(rows.where("stays").groupBy(mine("id"), mine("same")).count().where("count > 1").drop("count"), "repeated")
    if again.isEmpty():
        return kept
    once = kept.join(again.hint("merge"), on, "left_semi").dropDuplicates([id_col, text_col])
    return kept.join(again.hint("merge"), on, "left_anti").unionByName(once)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id): one row for each row of ``docs``, the smallest doc_id that links reach.

    Texts of equal shingle sets are one node; null and empty ones and those without words are one, too.  A
    null doc_id keeps its row and is never the smallest; repeated rows are repeated in the result; other
    columns are not used; an empty table gives an empty one.
    """
    return jaccard_classes(docs, id_col, text_col, shingle, similarity).select("doc_id", F.col("least.doc_id").alias("component_id"))
