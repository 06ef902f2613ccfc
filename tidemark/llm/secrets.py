"""Secret scans in DataFrame functions: patterns, then linking of the parts of multipart credentials.

Three kinds of base span stand on their own: an assignment to a secret's name, a cloud access key, a
long hex string.  Three weak kinds (an account identifier, a mixed token, an endpoint) are common in
harmless text and are reported only where complementary parts are in scope: an interval join of the
parts' positions, ``scope`` code points apart at most.  An access key or identifier must be among them:
an endpoint vouches for nothing, and an identifier or token within an endpoint is part of an address.
A text's parts are sorted by start and parts of a kind don't overlap, so at most ``_near`` parts on either
side can be in scope: the join looks at those.  What sums up along a text is summed in slices of
``_SLICE`` parts, so work grows with the parts, within the row, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import bound, kept_columns, own_names, quoted

#: Kinds in the order in which spans at one start are listed; the first three are base kinds.
KINDS = ("assign", "access", "hex", "id", "token", "endpoint")
_NAMED = r"""["']?\x20*[:=]\x20*["']?"""
ASSIGN = rf"((?i:password|passwd|secret|token|api_?key)){_NAMED}([A-Za-z0-9+/_.=-]+)"
#: These find exactly the runs that are long enough: a run starts at its first character or not at all.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
ID = rf"(?i:access_?key_?id|client_?id|account_?id|user_?name|user_?id|login){_NAMED}[A-Za-z0-9@._-]{{3,}}"
TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: What a token must hold to be no word, path or date.
MIXED = ("[0-9]", "[A-Z]", "[a-z]")
ENDPOINT = r"(?i:https?|jdbc:[a-z]+|postgres|mysql|mongodb|redis|amqp|s3)://[^\x00-\x20\"'<>]{4,}"
SCOPE = 400
#: The least length of a part of each kind: what bounds the parts in a scope.
_LEAST = {"assign": 14, "access": 16, "hex": 32, "id": 9, "token": 20, "endpoint": 9}
_SLICE = 256


def _near(scope: int) -> int:
    return sum(scope // n + 1 for n in _LEAST.values())


def _running(items: Column, first: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """What ``step(so far, item)`` makes of each item, an array of ``kind``; it returns the next "so far" and that.

    An array that grows item by item is copied for each: items are taken in slices, whose results are
    joined at the end.
    """
    none = F.expr(f"cast(array() as array<{kind}>)")
    start = F.struct(first.alias("at"), F.expr(f"cast(array() as array<array<{kind}>>)").alias("out"))

    def one(acc: Column, x: Column) -> Column:
        at, made = step(acc["at"], x)
        return F.struct(at.alias("at"), F.array_append(acc["out"], made).alias("out"))

    def whole(acc: Column, part: Column) -> Column:
        done = F.aggregate(part, F.struct(acc["at"].alias("at"), none.alias("out")), one)
        return bound(done, lambda d: F.struct(d["at"].alias("at"), F.array_append(acc["out"], d["out"]).alias("out")))

    slices = lambda own: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(own) - 1) / _SLICE)).cast("int")), lambda i: F.slice(own, i * _SLICE + 1, _SLICE))
    return bound(items, lambda own: F.flatten(F.aggregate(slices(own), start, whole, lambda acc: acc["out"])))


_SPAN = "struct<start:int,kind:int,end:int,part:string>"


def _spans(text: Column, found: Column, pattern: str, kind: str) -> Column:
    """Spans of the matches ``found``: the text between them is what splitting at the pattern leaves."""
    zipped = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(found)).alias("gap"), found.alias("part"))

    def add(at: Column, x: Column) -> tuple[Column, Column]:
        begin = at + F.length(x["gap"])
        end = begin + F.length(x["part"])
        return end, F.struct(begin.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"), x["part"].alias("part"))

    return F.when(F.size(found) > 0, _running(zipped, F.lit(0), _SPAN, add)).otherwise(F.expr(f"cast(array() as array<{_SPAN}>)"))


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def with_secrets(docs: DataFrame, out: str = "secrets", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """Add ``out``: array of struct(start, kind, end), sorted, of every span in the row's whole text.

    Positions are code points, ``end`` is exclusive, ``kind`` indexes ``KINDS``.  Base spans are
    leftmost and non-overlapping within their kind and always stay.  Parts are base spans, endpoints,
    identifiers outside endpoints, and tokens with a digit, a capital and a small letter outside base
    spans and endpoints.  A weak part is added if, with starts at most ``scope`` apart: an identifier,
    with a secret (assignment, hex or token); a token, with an access key or identifier; an endpoint,
    with both.  A null or empty text has none.  Each row is scanned alone: repeated rows agree, other
    columns stay whatever their names, an empty table stays empty.
    """
    own, near = own_names(docs, out), _near(scope)
    t, parts, base = own("text"), own("parts"), own("base")
    df = docs.withColumn(t, F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")))
    every = lambda pattern: F.regexp_extract_all(F.col(t), F.lit(pattern), F.lit(0))
    df = df.withColumns({own(k): every(p) for k, p in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("id", ID), ("endpoint", ENDPOINT))})
    # Tokens count only beside an access key or an identifier, so other texts need no search for them.
    df = df.withColumn(own("token"), F.when(F.size(own("access")) + F.size(own("id")) > 0, every(TOKEN)).otherwise(F.expr("cast(array() as array<string>)")))
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "id": ID, "token": TOKEN, "endpoint": ENDPOINT}
    df = df.withColumns({own(k): _spans(F.col(t), F.col(own(k)), p, k) for k, p in patterns.items()})
    long_enough = F.filter(own("assign"), lambda s: F.length(F.regexp_extract(s["part"], ASSIGN, 2)) >= 8)
    mixed = F.filter(own("token"), lambda s: s["part"].rlike(MIXED[0]) & s["part"].rlike(MIXED[1]) & s["part"].rlike(MIXED[2]))
    plain = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    df = df.withColumn(base, F.array_sort(plain(F.concat(long_enough, F.col(own("access")), F.col(own("hex"))))))
    df = df.withColumn(parts, F.array_sort(F.concat(base, plain(F.concat(F.col(own("id")), mixed, F.col(own("endpoint")))))))
    is_kind = lambda p, kind: p["kind"] == KINDS.index(kind)

    def reach(at: Column, p: Column) -> tuple[Column, Column]:
        """How far the base spans and the endpoints before a part reach."""
        after = F.struct(F.greatest(at["base"], F.when(p["kind"] < 3, p["end"])).alias("base"), F.greatest(at["url"], F.when(is_kind(p, "endpoint"), p["end"])).alias("url"))
        return after, F.struct(p["start"].alias("start"), p["kind"].alias("kind"), p["end"].alias("end"), at["base"].alias("base"), at["url"].alias("url"))

    def beside(of: Column, i: Column, test: Callable[[Column], Column]) -> Column:
        return F.exists(F.slice(of, F.greatest(i + 1 - near, F.lit(1)), 2 * near + 1), test)

    def alone(of: Column, p: Column, i: Column) -> Column:
        """Neither before nor behind a part's start does a span begin that holds some of it and may not."""
        starts_within = lambda kinds: F.exists(F.slice(of, i + 2, near), lambda q: kinds(q) & (q["start"] < p["end"]))
        url, any_base = lambda q: is_kind(q, "endpoint"), lambda q: q["kind"] < 3
        free = ~(p["url"] > p["start"]) & ~starts_within(url)
        return F.when(is_kind(p, "id"), free).when(is_kind(p, "token"), free & ~(p["base"] > p["start"]) & ~starts_within(any_base)).otherwise(F.lit(True))

    who, what = ("access", "id"), ("assign", "hex", "token")

    def linked(of: Column) -> Column:
        near_kinds = lambda p, i, kinds: beside(of, i, lambda q: (F.abs(q["start"] - p["start"]) <= scope) & q["kind"].isin(*map(KINDS.index, kinds)))
        return F.filter(
            of,
            lambda p, i: (p["kind"] < 3)
            | (is_kind(p, "id") & near_kinds(p, i, what))
            | (is_kind(p, "token") & near_kinds(p, i, who))
            | (is_kind(p, "endpoint") & near_kinds(p, i, who) & near_kinds(p, i, what)),
        )

    none = F.struct(F.lit(-1).alias("base"), F.lit(-1).alias("url"))
    reached = _running(F.col(parts), none, "struct<start:int,kind:int,end:int,base:int,url:int>", reach)
    apart = bound(reached, lambda of: F.filter(of, lambda p, i: alone(of, p, i)))
    # A weak part needs an identifier or access key and something besides: other texts are done.
    weak = (F.size(parts) > F.size(base)) & (F.size(own("access")) + F.size(own("id")) > 0)
    return df.select(*kept_columns(docs, out), F.when(weak, plain(bound(apart, linked))).otherwise(F.col(base)).alias(out))


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked: one row for each row of ``docs``.

    Rows are handled as ``with_secrets`` says; a null id stays null.
    """
    found = with_secrets(docs.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).alias("text")), "found")
    base = F.filter("found", lambda s: s["kind"] < 3)
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.col("found")).alias("spans"),
        F.size(F.filter("found", lambda s: s["kind"] >= 3)).cast("long").alias("n_linked"),
    )


def redact_secrets(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every reported span, overlapping ones as one, replaced by ``mask``; columns and rows stay."""
    own = own_names(docs)
    found = with_secrets(docs, own("found"), text_col)
    text = F.col(quoted(text_col))

    def cut(at: Column, s: Column) -> tuple[Column, Column]:
        """Before a span that the ones before don't reach: the text from their end, and the mask."""
        return F.greatest(at, s["end"]), F.struct(at.alias("from"), s["start"].alias("to"), s["end"].alias("end"))

    cuts = _running(F.col(own("found")), F.lit(0), "struct<from:int,to:int,end:int>", cut)

    def piece(of: Column, c: Column, offset: Column) -> Column:
        return F.when(c["to"] >= c["from"], F.concat(F.substr(of, c["from"] - offset + 1, c["to"] - c["from"]), F.lit(mask))).otherwise(F.lit(""))

    def pieces(all_cuts: Column, i: Column) -> Column:
        """A slice of spans, cut from the stretch of text that they lie in: a text isn't read from its start for each."""
        part = F.slice(all_cuts, i * 64 + 1, 64)
        first = F.get(part, F.lit(0))["from"]
        last = F.array_max(F.transform(part, lambda c: F.greatest(c["to"], c["from"])))
        return bound(
            F.struct(part.alias("part"), first.alias("first"), F.substr(text, first + 1, last - first).alias("text")),
            lambda s: F.array_join(F.transform(s["part"], lambda c: piece(s["text"], c, s["first"])), ""),
        )

    def whole(all_cuts: Column) -> Column:
        slices = F.sequence(F.lit(0), F.floor((F.size(all_cuts) - 1) / 64).cast("int"))
        end = F.array_max(F.transform(all_cuts, lambda c: c["end"]))
        return F.concat(F.array_join(F.transform(slices, lambda i: pieces(all_cuts, i)), ""), F.substr(text, end + 1, F.length(text)))

    masked = F.when(F.size(own("found")) > 0, bound(cuts, whole)).otherwise(text)
    return found.select(*[masked.alias(c) if c.lower() == text_col.lower() else F.col(quoted(c)) for c in docs.columns])
