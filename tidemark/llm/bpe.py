"""Byte-level BPE by recursive queries in an embedded DuckDB, one in each Python worker.

A text is cut into the pattern's matches; each distinct match becomes rows of (word, position, token),
first its bytes.  A recursive query joins neighbouring tokens with the merge table and contracts each
word's leftmost pair of least rank until none is left.  Decoding joins ids with the vocabulary and
concatenates in an ordered aggregation.

As in the public library, a match that is itself a token is that token.  A query's rows are bounded by
``_ROWS``, whatever a match's length: a long match is cut into segments that are contracted apart, and its seams
are proved.  Tokens are those of their text if each two neighbours are those of the text of the two: a contraction
across a seam would be the least of its two tokens, too.  Where two neighbours aren't, the tokens around the
seam are contracted together, then whole segments, until all seams hold.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import quoted
from tidemark.llm.vocabularies import broadcast_file, default_path, default_pattern, once_per_worker

# A token's place is one number, x: its word's number and, in the low half, its position, so one sort
# orders all.  Ranks are kept in the high half too: the least of rank and position is the leftmost
# pair of least rank.
#: The least pair of each word, contracted where it stands first.
_ENCODE = """
with recursive step(x, t, fixed) as (
  select x, t, false from start
  union all
  (with pairs as (select x, x >> 32 as w, t, t * 65536 + lead(t) over o as both, lag(x) over o as before, lead(x) over o as following from step where not fixed window o as (order by x)),
   ranked as (select a.w, a.x, a.t, a.before, m.t + (a.x & 4294967295) as k from pairs a left join merges m on m.both = a.both and a.following >> 32 = a.w),
   best as (select w, min(k) as k from ranked group by w)
   select r.x, case when r.k = b.k then b.k >> 32 else r.t end, b.k is null
   from ranked r join best b using (w) where b.k is null or r.before is null or r.before <> (r.w << 32) + (b.k & 4294967295))
)
select x >> 32 as w, t from step where fixed order by x
"""
#: For long words: every place of the least pair, from the left without overlap, in one step.  That is what the
#: next steps would do one by one, unless a contraction makes a pair of a lower rank.  One that it makes with
#: the beginning of the next place would be gone: merges that can make one are told as risky, and places of one
#: next to each other mark their word.  Any other is the least of the next step, so a word whose least rank falls
#: is marked, too.  Marked words are contracted one by one.
_ENCODE_LONG = """
with recursive step(x, t, fixed, last, odd) as (
  select x, t, false, -1::bigint, false from start
  union all
  (with pairs as (select x, x >> 32 as w, t, last, odd, t * 65536 + lead(t) over o as both, lead(x) over o as following, row_number() over o as n from step where not fixed window o as (order by x)),
   ranked as (select a.w, a.x, a.t, a.n, a.last, a.odd, m.t as k, m.risky from pairs a left join merges m on m.both = a.both and a.following >> 32 = a.w),
   best as (select w, min(k) as k from ranked group by w),
   hits as (select r.*, b.k as least, coalesce(r.k = b.k, false) as hit from ranked r join best b using (w)),
   runs as (select *, n - coalesce(max(case when not hit then n end) over (order by x rows unbounded preceding), 0) as nth from hits),
   chosen as (select *, hit and nth % 2 = 1 as takes from runs),
   kept as (select *, coalesce(lag(takes) over o, false) as taken, odd or coalesce(least < last, false) or (takes and (lead(odd) over o or (risky and coalesce(lead(takes, 2) over o, false)))) as marked from chosen window o as (order by x))
   select x, case when takes then least >> 32 else t end, least is null, coalesce(least, last), marked from kept where not taken)
)
select x >> 32 as w, t, odd from step where fixed order by x
"""
_DECODE = "select d, unhex(string_agg(h, '' order by p)) as b from ids join vocab using (t) group by d order by d"
_LONG, _ROWS, _STRETCHES, _WORDS, _TEXTS = 64, 200_000, 700_000, 400_000, 500
#: A match of over so many bytes is cut into segments of so many; tokens on either side of a seam that doesn't hold.
_APART, _SEGMENT, _AROUND = 2048, 96, 4
#: Before a blank that one of these follows, a match of the usual pattern ends, whatever stands before it.
_SURE = "!-~À-ɏͰ-ϿЀ-ӿ"
_UNSURE, _CUT = regex.compile(f" (?![{_SURE}])"), regex.compile(f"(?= [{_SURE}])")


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The ranks of a vocabulary file: a base64 token and its rank a line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


class ByteBpe:
    """One vocabulary in one embedded database; ids of distinct stretches of text are kept up to a bound, the latest longest."""

    def __init__(self, vocabulary: bytes, pattern: str):
        import duckdb

        self.pattern, ranks = regex.compile(pattern), read_ranks(vocabulary)
        self.in_stretches = pattern == default_pattern()  # other patterns may match across blanks
        self.whole = ranks
        if max(ranks.values()) >= 1 << 16:
            raise ValueError("ranks are below 65,536")
        self.of_byte = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "500MB", "temp_directory": ""})
        merges = [(ranks[a], ranks[b], rank) for token, rank in ranks.items() for i in range(1, len(token)) if (a := token[:i]) in ranks and (b := token[i:]) in ranks]
        columns = np.array(merges, dtype=np.int64).reshape(-1, 3)
        # Risky: the contraction's token, with the beginning of a place that follows, makes a pair of no higher rank.
        rank_of = dict(zip((columns[:, 0] * 65536 + columns[:, 1]).tolist(), columns[:, 2].tolist(), strict=True))
        again = (columns[:, 2] * 65536 + columns[:, 0]).tolist()
        risky = [rank_of.get(both, 1 << 30) <= rank for both, rank in zip(again, columns[:, 2].tolist(), strict=True)]
        self._table("merges", {"both": columns[:, 0] * 65536 + columns[:, 1], "t": columns[:, 2] << 32, "risky": risky})
        self._table("vocab", {"t": np.fromiter(ranks.values(), np.int32), "h": [token.hex() for token in ranks]})
        self.bytes_of = [token for token, _ in sorted(ranks.items(), key=lambda x: x[1])]
        self.kept, self.aged = {}, {}  # stretches' ids, and those of the generation before
        self.words: dict[str, bytes] = {}
        self.holds: dict[tuple[int, int], bool] = {}  # neighbours that stay apart

    def _table(self, name: str, columns: dict) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"create table {name} as select * from given")
        self.db.unregister("given")

    def _contract(self, words: list, query: str, to: dict | None = None) -> None:
        """Learn the words' ids; those that the query marks as odd are left to contracting one by one."""
        odd: list = []
        to = self.words if to is None else to
        data = [w if isinstance(w, bytes) else w.encode("utf-8", "surrogatepass") for w in words]
        for part in self._parts([len(d) for d in data]):
            own = data[part]
            size = np.array([len(d) for d in own])
            w = np.repeat(np.arange(len(own), dtype=np.int64), size)
            p = np.arange(len(w)) - np.repeat(np.cumsum(size) - size, size)
            self.db.register("start", pa.table({"x": (w << 32) + p, "t": self.of_byte[np.frombuffer(b"".join(own), dtype=np.uint8)]}))
            found = self.db.execute(query).fetchnumpy()
            self.db.unregister("start")
            if "odd" in found:
                odd += [words[part][k] for k in np.unique(found["w"][found["odd"]]).tolist()]
            ends = np.searchsorted(found["w"], np.arange(len(own)), side="right") * 4
            ids, at = found["t"].astype("<u4").tobytes(), 0
            for word, end in zip(words[part], ends.tolist(), strict=True):
                to[word] = ids[at:end]
                at = end
        if odd:
            self._contract(odd, _ENCODE, to)

    def _tokens(self, parts: list[bytes]) -> list[list[int]]:
        """The tokens of each stretch of bytes, contracted without a look at whole tokens."""
        to: dict[bytes, bytes] = {}
        self._contract(sorted({p for p in parts if len(p) <= _LONG}), _ENCODE, to)
        self._contract(sorted({p for p in parts if len(p) > _LONG}), _ENCODE_LONG, to)
        return [np.frombuffer(to[p], "<u4").tolist() for p in parts]

    def _hold(self, seams: list[tuple[int, int]]) -> list[bool]:
        """Whether two tokens are those of the text of both."""
        if len(self.holds) > _WORDS:
            self.holds.clear()
        missing = sorted({s for s in seams if s not in self.holds})
        for s, found in zip(missing, self._tokens([self.bytes_of[a] + self.bytes_of[b] for a, b in missing]), strict=True):
            self.holds[s] = found == [*s]
        return [self.holds[s] for s in seams]

    def _apart(self, data: bytes) -> bytes:
        """The ids of one long match: segments apart, then what the seams that don't hold ask for."""
        parts = [(tokens, False) for tokens in self._tokens([data[i : i + _SEGMENT] for i in range(0, len(data), _SEGMENT)])]
        text = lambda tokens: b"".join(map(self.bytes_of.__getitem__, tokens))
        while True:
            held = self._hold([(a[-1], b[0]) for (a, _), (b, _) in zip(parts, parts[1:], strict=False)])
            if all(held):
                return np.array([t for tokens, _ in parts for t in tokens], dtype="<u4").tobytes()
            out, again, i = [], [], 0
            while i < len(parts):
                tokens, mended = parts[i]
                if i == len(held) or held[i]:
                    out.append((tokens, mended))
                    i += 1
                    continue
                after, mended_too = parts[i + 1]
                # What was mended before and still doesn't hold goes together as a whole, so this ends.
                left, right = (0, len(after)) if mended or mended_too else (max(len(tokens) - _AROUND, 0), min(_AROUND, len(after)))
                if tokens[:left]:
                    out.append((tokens[:left], mended))
                again.append(len(out))
                out.append((tokens[left:] + after[:right], True))
                if after[right:]:
                    out.append((after[right:], mended_too))
                i += 2
            for at, tokens in zip(again, self._tokens([text(out[at][0]) for at in again]), strict=True):
                out[at] = (tokens, True)
            parts = out

    @staticmethod
    def _parts(sizes: list[int]) -> Iterator[slice]:
        """Slices of about ``_ROWS`` rows."""
        first, n = 0, 0
        for i, size in enumerate(sizes):
            if n and n + size > _ROWS:
                yield slice(first, i)
                first, n = i, 0
            n += size
        if sizes:
            yield slice(first, len(sizes))

    def _learn(self, stretches: list[str]) -> None:
        found = {s: self.pattern.findall(s) for s in stretches}
        every = {w for own in found.values() for w in own}
        missing = every.difference(self.words)
        if len(self.words) + len(missing) > _WORDS:
            self.words.clear()
            missing = every
        todo = []
        for w in missing:
            rank = self.whole.get(w.encode("utf-8", "surrogatepass"))
            if rank is None:
                todo.append(w)
            else:
                self.words[w] = rank.to_bytes(4, "little")
        todo.sort()
        self._contract([w for w in todo if len(w) <= _LONG], _ENCODE)
        self._contract([w for w in todo if _LONG < len(w) <= _APART // 4], _ENCODE_LONG)
        for w in todo:
            if len(w) > _APART // 4:
                data = w.encode("utf-8", "surrogatepass")
                if len(data) > _APART:
                    self.words[w] = self._apart(data)
                else:
                    self._contract([w], _ENCODE_LONG)
        for s, own in found.items():
            self.kept[s] = b"".join(map(self.words.__getitem__, own))

    def _stretches(self, text: str) -> list[str]:
        """Parts of a text whose matches are those of the text; the whole text where that isn't known."""
        if not self.in_stretches or "\0" in text:
            return [text]
        return _CUT.split(text) if _UNSURE.search(text) else text.replace(" ", "\0 ").split("\0")

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each whole text, as little-endian unsigned 32-bit integers."""
        out, at = [], 0
        while at < len(texts):  # so many texts at once that what they add is bounded
            group, size = [], 0
            while at < len(texts) and (not group or size + len(texts[at]) < 8 * _ROWS):
                size += len(texts[at])
                group.append(self._stretches(texts[at]))
                at += 1
            missing = {s for cut in group for s in cut if s not in self.kept}
            if len(self.kept) + len(missing) > _STRETCHES // 2:
                self.aged, self.kept = self.kept, {}
                missing = {s for cut in group for s in cut}
            for s in missing.intersection(self.aged):
                self.kept[s] = self.aged[s]
            missing.difference_update(self.aged)
            if missing:
                self._learn(list(missing))
            out += [b"".join(map(self.kept.__getitem__, cut)) for cut in group]
        return out

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes of each sequence of ids; an id that the vocabulary lacks raises, and so does part of one."""
        if any(len(x) % 4 for x in ids):
            raise ValueError("ids are unsigned 32-bit integers: their bytes are a multiple of four")
        whole: list[list[bytes]] = [[] for _ in ids]
        pieces = [(i, part) for i, x in enumerate(ids) for k in range(0, len(x), 4 * _ROWS) if (part := x[k : k + 4 * _ROWS])]
        for part in self._parts([len(x) // 4 for _, x in pieces]):
            own = pieces[part]
            size = np.array([len(x) // 4 for _, x in own])
            t = np.frombuffer(b"".join(x for _, x in own), dtype="<u4")
            if len(t) and t.max() >= len(self.whole):
                raise ValueError("no such id")
            self.db.register("ids", pa.table({"d": np.repeat(np.arange(len(own), dtype=np.int32), size), "p": np.arange(len(t), dtype=np.int32), "t": t.astype(np.int32)}))
            for d, b in self.db.execute(_DECODE).fetchall():
                whole[own[d][0]].append(b)
            self.db.unregister("ids")
        return [b"".join(x) for x in whole]


def _udf(docs: DataFrame, vocabulary_path: str | None, pattern: str | None, what: str):
    vocabulary = broadcast_file(docs.sparkSession, vocabulary_path or default_path("byte_bpe_50k.tiktoken"))
    cut_at = pattern or default_pattern()

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = once_per_worker(("bpe", hash(vocabulary.value), cut_at), lambda: ByteBpe(vocabulary.value, cut_at))
        for batch in batches:
            for k in range(0, len(batch), _TEXTS):
                given = batch.slice(k, _TEXTS).to_pylist()
                if what == "decoded":
                    yield pa.array(bpe.decode([x or b"" for x in given]), pa.binary())
                    continue
                ids = bpe.encode([x or "" for x in given])
                if what == "ids":
                    yield pa.array(ids, pa.binary())
                else:
                    yield pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(bpe.decode(ids), pa.binary())], ["token_ids", "decoded"])

    kind = "token_ids binary, decoded binary" if what == "both" else "binary"
    return F.arrow_udf(run, returnType=kind).asNondeterministic()  # must not run again for each use of its result


def with_token_ids(docs: DataFrame, out: str = "token_ids", text_col: str = "text", vocabulary_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Add ``out``: the ids of the row's whole text as binary, little-endian unsigned 32-bit integers.

    The same ids as the public library gives without special tokens, whose strings are ordinary text.
    A null or empty text has no ids; repeated rows agree; other columns stay whatever their names; an empty
    table stays empty; a very long text is encoded whole, in time that grows with its length.
    """
    return docs.withColumn(out, _udf(docs, vocabulary_path, pattern, "ids")(F.col(quoted(text_col)).cast("string")))


def with_decoded(docs: DataFrame, out: str = "decoded", ids_col: str = "token_ids", vocabulary_path: str | None = None) -> DataFrame:
    """Add ``out``: the bytes that the ids in ``ids_col`` stand for; null ids are none.  An unknown id, or part of one, raises."""
    return docs.withColumn(out, _udf(docs, vocabulary_path, None, "decoded")(F.col(quoted(ids_col))))


def unpacked(ids: Column) -> Column:
    """Binary ids as an array of long."""
    n = (F.octet_length(ids) / 4).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    byte = lambda i, k: F.conv(F.hex(F.substring(ids, i * 4 + 1 + k, F.lit(1))), 16, 10).cast("long")
    return F.transform(at, lambda i: sum((byte(i, k) * 256**k for k in range(1, 4)), byte(i, 0)))


def with_round_trip(docs: DataFrame, out: str = "coded", text_col: str = "text", vocabulary_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Add ``out``: struct(token_ids, decoded), as ``with_token_ids`` and then ``with_decoded`` give, in one pass."""
    return docs.withColumn(out, _udf(docs, vocabulary_path, pattern, "both")(F.col(quoted(text_col)).cast("string")))


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, exact: each row encoded, its ids decoded, both digested.

    ``exact`` says that decoding gave the text's bytes back.  A null text is an empty one; null ids and
    repeated rows keep their rows; an empty table gives an empty one.
    """
    given = docs.select(F.col(quoted(id_col)).alias("doc_id"), F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).alias("text"))
    coded = with_round_trip(given, **parameters).select("doc_id", "text", "coded.*")
    return coded.select(
        "doc_id",
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.col("text").cast("binary")).alias("exact"),
    )
