"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions.

Each source is a stream of bytes cut into blocks.  With whole-number weights that sum to P, block j of
a source of weight e is released at slot floor(j P / e) and due by slot ceil((j + 1) P / e); the next
slot goes to the released block with the earliest deadline.  The weights' utilisation is one, so each
block runs in its window and after t slots each source is within one block of t e / P.  The schedule
repeats every P slots: it is worked out for P slots and applied to rows by arithmetic.  When a source
runs out, the next phase shares its slots among the others by their weights, so no row is dropped.

A document stands where its first byte does and is never cut: what a source has delivered by a slot's
end is within one block of its target, and ahead of it by what the last document reaches over at most.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm.shared import kept_columns, own_names, quoted, staged, with_ordinals

BLOCK = 1 << 16
#: The most slots of a period, and the most slots of all phases' tables that are broadcast.
MOST_SLOTS, MOST_TABLE = 100_000, 1 << 20
#: Bytes of a part of the mixed order, and the most rows of the table that says where parts begin.
PART, MOST_SPLITS = 128 << 20, 1 << 20


def windows(weight: int, period: int) -> list[tuple[int, int]]:
    """(release, deadline) of each block of a source of ``weight`` in a period: it runs in [release, deadline)."""
    return [(j * period // weight, -(-(j + 1) * period // weight)) for j in range(weight)]


def earliest_deadline_first(weights: dict[str, int]) -> dict[str, list[int]]:
    """For each source the slots of its blocks in one period.  Ties in the deadline go to the earlier name."""
    period = sum(weights.values())
    coming = sorted((release, deadline, s) for s, w in weights.items() for release, deadline in windows(w, period))
    slots: dict[str, list[int]] = {s: [] for s in weights}
    ready: list[tuple[int, str]] = []
    at = 0
    for slot in range(period):
        while at < len(coming) and coming[at][0] <= slot:
            heapq.heappush(ready, coming[at][1:])
            at += 1
        deadline, s = heapq.heappop(ready)
        assert slot < deadline
        slots[s].append(slot)
    return slots


def phases(weights: dict[str, int], blocks: dict[str, int]) -> list[tuple]:
    """(stream, phase, first, last, slot, period, weight, slots): blocks [first, last) of the stream run in this phase from ``slot`` on."""
    done = {s: 0 for s in weights}
    rows, slot, phase = [], 0, 0
    while left := {s: w for s, w in weights.items() if done[s] < blocks.get(s, 0)}:
        period, own = sum(left.values()), earliest_deadline_first(left)
        ends = []
        for s, w in left.items():
            cycles, rest = divmod(blocks[s] - done[s] - 1, w)
            ends.append(cycles * period + own[s][rest] + 1)
        length = min(ends)
        cycles, rest = divmod(length, period)
        for s, w in left.items():
            n = cycles * w + sum(t < rest for t in own[s])
            rows.append((s, phase, done[s], done[s] + n, slot, period, w, own[s]))
            done[s] += n
        slot, phase = slot + length, phase + 1
    return rows


class _Streams:
    """What of a row decides its place: its stream, size and hash, under names that the caller's columns don't have."""

    def __init__(self, docs: DataFrame, weights: dict[str, int], rest: int, block: int, id_col: str, source_col: str, text_col: str, out: str):
        if rest < 1 or any(not isinstance(w, int) or w < 1 for w in weights.values()):
            raise ValueError("weights are whole numbers from 1")
        if sum(weights.values()) + rest > MOST_SLOTS:
            raise ValueError(f"weights sum to over {MOST_SLOTS}")
        self.name, self.block = own_names(docs, out), block
        self.source, text = F.col(quoted(source_col)).cast("string"), F.col(quoted(text_col)).cast("string")
        self.weights = {f"={s}": w for s, w in weights.items()} | {"*": rest}  # the pooled stream's name can't be a source's
        stream = F.when(self.source.isin(*weights), F.concat(F.lit("="), self.source)).otherwise(F.lit("*"))
        # The hash is a row's position in its stream: rows of one id and text alone share one.
        self.rows = docs.withColumns({self.name("stream"): stream, self.name("size"): (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long"), self.name("hash"): F.xxhash64(F.col(quoted(id_col)), text)})

    def col(self, name: str) -> Column:
        return F.col(self.name(name))

    def totals(self) -> list:
        """(stream, rows, bytes), one for each weight."""
        return self.rows.groupBy(self.name("stream")).agg(F.count(F.lit(1)).alias("rows"), F.sum(self.name("size")).alias("bytes")).collect()

    def bucket(self, n_rows: int) -> Column:
        """Ranges of hashes: 512, and twice as many for each doubling of the rows from 100 million on."""
        bits = 9 + max(0, (n_rows // 100_000_000).bit_length())
        return F.shiftright(self.col("hash"), 64 - bits)

    def scheduled(self, placed: DataFrame, totals: list) -> DataFrame:
        """Add each row's turn to ``placed``, which says at which byte of its stream it starts."""
        schedule = phases(self.weights, {r[0]: -(-r["bytes"] // self.block) for r in totals})
        own = self.name
        fields = f"{own('of')} string, {own('phase')} int, {own('first')} long, {own('last')} long, {own('slot0')} long, {own('period')} long, {own('weight')} long, {own('slots')} array<long>"
        table = placed.sparkSession.createDataFrame(schedule, fields)  # a row for each stream and phase, with its slots of a period
        table = F.broadcast(table) if sum(len(r[-1]) for r in schedule) <= MOST_TABLE else table
        numbered = placed.withColumn(own("block"), F.floor(self.col("at") / self.block).cast("long"))
        return numbered.join(table, (self.col("stream") == self.col("of")) & (self.col("block") >= self.col("first")) & (self.col("block") < self.col("last")))

    def turn(self) -> dict[str, Column]:
        j = self.col("block") - self.col("first")
        cycle = F.floor(j / self.col("weight")).cast("long") * self.col("period") + self.col("slot0")
        nth = j % self.col("weight")
        slot = cycle + F.get(self.col("slots"), nth.cast("int"))
        return {
            "stream": F.when(self.col("stream") != "*", self.source),
            "block": self.col("block"),
            "phase": self.col("phase"),
            "slot": slot,
            "release": cycle + F.floor(nth * self.col("period") / self.col("weight")).cast("long"),
            "deadline": cycle + F.ceil((nth + 1) * self.col("period") / self.col("weight")).cast("long"),
            "place": slot * self.block + self.col("at") % self.block,
        }

    def placed(self, totals: list) -> DataFrame:
        n = sum(r["rows"] for r in totals)
        numbered = with_ordinals(self.rows, [self.name("stream")], [self.name("hash")], self.name("at"), bucket=self.bucket(n), weight=self.col("size"), groups=len(self.weights))
        return self.scheduled(numbered, totals)


def mix(docs: DataFrame, weights: dict[str, int], rest: int = 1, block: int = BLOCK, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", out: str = "mix") -> DataFrame:
    """Add ``out``: struct(stream, block, phase, slot, release, deadline, place) to every row.

    ``weights`` names sources and their whole-number weights; all other sources and null ones are one
    stream, null, of weight ``rest``; weights may sum to ``MOST_SLOTS``.  A row's size is its text's UTF-8
    bytes and one (null: none).  Its block is that in which it starts; ``slot`` is when that block runs,
    ``release`` and ``deadline`` its window, and ``place``, unique and ascending in the mixed order, its
    byte in the whole.  A stream's order is by hash of the id and text (either may be null); repeated rows
    stand next to each other.  No stream is gathered in one task.  Other columns stay whatever their
    names; an empty table stays empty.
    """
    streams = _Streams(docs, weights, rest, block, id_col, source_col, text_col, out)
    made = F.struct(*[c.alias(k) for k, c in streams.turn().items()])
    return streams.placed(streams.totals()).select(*kept_columns(docs, out), made.alias(out))


def mixed(docs: DataFrame, weights: dict[str, int], rest: int = 1, block: int = BLOCK, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", place: str | None = None, part: int = PART) -> DataFrame:
    """``docs`` in the mixed order: rows and columns stay; with ``place`` a column says each row's byte in the whole.

    The order is that of the partitions and of the rows in each, hence of files written and their rows.
    Places are worked out on rows without their texts, of which a small table remains: for each stream the
    hash with which each part of the order begins.  It tells a row's part, so texts move once, to their
    part, and are sorted there.
    """
    streams = _Streams(docs, weights, rest, block, id_col, source_col, text_col, place or "")
    totals = streams.totals()
    own, col = streams.name, streams.col
    n, total = sum(r["rows"] for r in totals), sum(r["bytes"] for r in totals)
    parts = max(1, min(-(-total // part), MOST_SPLITS // len(streams.weights)), min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total >> 22))
    slim = streams.placed(totals).select(own("stream"), own("hash"), own("at"), streams.turn()["place"].alias(own("place")))
    slots = 1 + max((r[4] + -(-(r[3] - r[2]) * r[5] // r[6]) + r[5] for r in phases(streams.weights, {r[0]: -(-r["bytes"] // block) for r in totals})), default=0)
    width = -(-slots * block // parts)
    begins = slim.groupBy(own("stream"), F.floor(col("place") / width).cast("int").alias(own("part"))).agg(F.min(own("hash")).alias(own("from")), F.min(own("at")).alias(own("base")))
    begins = staged(begins, "parts")
    until = F.lead(own("from")).over(W.partitionBy(own("stream")).orderBy(own("from")))  # a row for each part
    bits = 9 + max(0, parts.bit_length() - 9)
    bucket = lambda h: F.shiftright(h, 64 - bits)
    reach = begins.withColumn(own("until"), F.coalesce(until, F.lit((1 << 63) - 1)))
    spans = reach.select(F.col(own("stream")).alias(own("s")), F.explode(F.sequence(bucket(col("from")), bucket(col("until")))).alias(own("b")), F.struct(own("from"), own("part"), own("base")).alias(own("begin")))
    table = spans.groupBy(own("s"), own("b")).agg(F.sort_array(F.collect_list(own("begin"))).alias(own("begins")))  # about two begins each
    dealt = streams.rows.withColumn(own("bucket"), bucket(col("hash"))).join(F.broadcast(table), (col("stream") == col("s")) & (col("bucket") == col("b")))
    at = F.element_at(F.filter(own("begins"), lambda x: x[own("from")] <= col("hash")), -1)
    dealt = dealt.withColumn(own("at_part"), at).withColumns({own("part"): F.col(own("at_part"))[own("part")], own("base"): F.col(own("at_part"))[own("base")]})
    slimmed = [*[F.col(quoted(c)) for c in docs.columns], *[own(c) for c in ("stream", "size", "hash", "part", "base")]]
    moved = dealt.select(*slimmed).repartitionById(parts, F.col(own("part")))
    before = W.partitionBy(own("part"), own("stream")).orderBy(own("hash")).rowsBetween(W.unboundedPreceding, -1)
    numbered = moved.withColumn(own("at"), col("base") + F.coalesce(F.sum(own("size")).over(before), F.lit(0)))
    placed = streams.scheduled(numbered, totals).withColumn(own("place"), streams.turn()["place"]).sortWithinPartitions(own("place"))
    kept = kept_columns(docs, place) if place else [F.col(quoted(c)) for c in docs.columns]
    return placed.select(*kept, *([col("place").alias(place)] if place else []))
