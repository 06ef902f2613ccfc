"""Format-preserving pseudonyms: a keyed Feistel permutation within each value's own format.

A value that validates is reduced to its canonical number (digits without their punctuation, days of
a date), permuted within the numbers of its kind and length, and written back in the shape it came in.
The permutation depends on the key and the kind alone, so equal values, however they are punctuated
and wherever they stand, get equal pseudonyms, different ones different pseudonyms, and the holder of
the key can undo it.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import own_names, quoted

ROUNDS = 10


class Feistel:
    """Keyed permutations of range(n): alternating modular rounds on two halves, walked until within."""

    def __init__(self, key: bytes):
        if not key:
            raise ValueError("a key is needed")
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, kind: str, n: int, i: int, x: int, m: int) -> int:
        told = f"{kind}:{n}:{i}:{x}".encode()
        return int.from_bytes(hashlib.blake2b(told, key=self.key, digest_size=max(16, m.bit_length() // 8 + 9)).digest(), "big") % m

    def permute(self, kind: str, n: int, x: int) -> int:
        return self._walk(kind, n, x, range(ROUNDS), 1)

    def undo(self, kind: str, n: int, x: int) -> int:
        return self._walk(kind, n, x, reversed(range(ROUNDS)), -1)

    def _walk(self, kind: str, n: int, x: int, order, sign: int) -> int:
        if not 0 <= x < n:
            raise ValueError("outside the format")
        a = math.isqrt(n - 1) + 1 if n > 1 else 1
        b = -(-n // a)
        order = list(order)
        while True:
            left, right = divmod(x, b)
            for i in order:
                if i % 2:
                    left = (left + sign * self._round(kind, n, i, right, a)) % a
                else:
                    right = (right + sign * self._round(kind, n, i, left, b)) % b
            x = left * b + right
            if x < n:
                return x


def luhn_digit(payload: str) -> str:
    """The check digit behind ``payload``."""
    total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(payload))))
    return str(-total % 10)


def _reshape(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def _digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def _card(s: str, f: Callable) -> str | None:
    d = _digits(s)
    if luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
        return None
    n = len(d) - 1
    new = f"{f('card', 10**n, int(d[:-1])):0{n}d}"
    return _reshape(s, new + luhn_digit(new))


# The country calling codes of one and of two digits; all others have three.
CODES_1 = ("1", "7")
CODES_2 = ("20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98")


def country_code(digits: str) -> str:
    return digits[:1] if digits[:1] in CODES_1 else digits[:2] if digits[:2] in CODES_2 else digits[:3]


def _north_american(d: str) -> bool:
    return len(d) == 10 and d[0] in "23456789" and d[3] in "23456789"


# The least and most digits of national numbers, by country code; elsewhere six to ten.
NATIONAL = {
    "1": (10, 10), "7": (10, 10), "20": (8, 10), "27": (9, 9), "30": (10, 10), "31": (9, 9), "32": (8, 9), "33": (9, 9), "34": (9, 9), "36": (8, 9), "39": (6, 11), "40": (9, 9), "41": (9, 9), "43": (7, 13), "44": (9, 10), "45": (8, 8),
    "46": (7, 10), "47": (8, 8), "48": (9, 9), "49": (6, 11), "51": (8, 9), "52": (10, 10), "54": (10, 11), "55": (10, 11), "56": (9, 9), "57": (8, 10), "60": (8, 10), "61": (9, 9), "62": (8, 12), "63": (8, 10), "64": (8, 10), "65": (8, 8),
    "66": (8, 9), "81": (9, 10), "82": (8, 11), "84": (9, 10), "86": (10, 11), "90": (10, 10), "91": (10, 10), "92": (9, 10), "98": (10, 10),
    "351": (9, 9), "353": (7, 9), "354": (7, 7), "358": (6, 10), "359": (8, 9), "370": (8, 8), "371": (8, 8), "372": (7, 8), "380": (9, 9), "385": (8, 9), "386": (8, 8), "420": (9, 9), "421": (9, 9), "852": (8, 8), "886": (8, 9), "971": (8, 9), "972": (8, 9),
}


def _phone(s: str, f: Callable) -> tuple[str, int] | None:
    """The number that ``s`` begins with and how much of it that is.

    The country's code stays, as does a trunk zero in parentheses; the rest is one number, however it is written.
    Groups of digits behind a number belong to it as long as its country's numbers are that long: so a number
    is the same whatever follows it.  Where no end of a group fits, the longest that may be a number counts.
    A number without a code is a North American one: it is linked with the same number behind +1, and
    stays within the form of such numbers.
    """
    ends = [m.end() for m in re.finditer(r"[0-9](?![0-9])", s)]
    sized = [(end, _national(s[:end])) for end in ends]
    least, most = NATIONAL.get(country_code(_digits(s)) if s.startswith("+") else "1", (6, 10))
    fits = [x for x in sized if least <= len(x[1][1]) <= most] or [x for x in sized if 6 <= len(x[1][1]) <= 14 and len(x[1][0]) + len(x[1][1]) <= 15]
    if not fits:
        return None
    end, (code, national) = fits[-1]
    n, kind = 10 ** len(national), f"phone+{code}/{len(national)}"
    x = f(kind, n, int(national))
    if code == "1" and _north_american(national):
        while not _north_american(f"{x:010d}"):  # walks a cycle through such a number, so it ends
            x = f(kind, n, x)
    d = _digits(s[:end])
    return _reshape(s[:end], d[: len(d) - len(national)] + f"{x:0{len(national)}d}"), end


def _national(s: str) -> tuple[str, str]:
    """(country code, national digits) of a whole number."""
    d = _digits(s)
    code = country_code(d) if s.startswith("+") else "1"
    kept = len(code) if s.startswith("+") else 0
    trunk = re.match(r"[^0-9]*\(0\)", _behind(s, kept))
    return code, d[kept + (1 if trunk else 0) :]


def _behind(s: str, n: int) -> str:
    """``s`` behind its first ``n`` digits."""
    for i, c in enumerate(s):
        if not n:
            return s[i:]
        n -= c.isdigit()
    return ""


def _ip(s: str, f: Callable) -> str | None:
    parts = [int(x) for x in s.split(".")]
    if max(parts) > 255 or any(x != str(int(x)) for x in s.split(".")):
        return None
    new = f("ip", 1 << 32, int.from_bytes(bytes(parts), "big"))
    return ".".join(map(str, new.to_bytes(4, "big")))


def _ssn_valid(n: int) -> bool:
    area, group, serial = n // 1_000_000, n // 10_000 % 100, n % 10_000
    return 0 < area < 900 and area != 666 and group > 0 and serial > 0


def _ssn(s: str, f: Callable) -> str | None:
    x = int(_digits(s))
    if not _ssn_valid(x):
        return None
    x = f("ssn", 10**9, x)
    while not _ssn_valid(x):  # walks a cycle through an issued number, so it ends
        x = f("ssn", 10**9, x)
    return _reshape(s, f"{x:09d}")


def _iban_check(country: str, rest: str) -> str:
    moved = "".join(str(int(c, 36)) for c in rest + country + "00")
    return f"{98 - int(moved) % 97:02d}"


def _iban(s: str, f: Callable) -> str | None:
    plain = re.sub(r"\s", "", s).upper()
    country, check, rest = plain[:2], plain[2:4], plain[4:]
    if not 11 <= len(rest) <= 30 or _iban_check(country, rest) != check:
        return None
    new = _letters("iban" + country, rest.lower(), f).upper()
    it = iter(country + _iban_check(country, new) + new)
    return "".join(c if c.isspace() else next(it) for c in s)


@lru_cache(maxsize=512)
def _alphabet(block: int) -> str:
    """The letters of 128 neighbouring code points that are their own lower case; in the first ones a to z."""
    points = map(chr, range(block * 128, block * 128 + 128))
    return "".join(c for c in points if c.isalpha() and c.lower() == c and (not c.isascii() or "a" <= c <= "z"))


def _class_of(c: str) -> str:
    """What a character may become: a digit, a letter of its own block, or itself alone."""
    if "0" <= c <= "9":
        return "0123456789"
    own = _alphabet(ord(c) // 128)
    return own if c in own else c


def _letters(kind: str, s: str, f: Callable) -> str:
    """Each digit becomes a digit, each lower letter one of its script's block; the rest stays.  Distinct strings stay so."""
    classes = [_class_of(c) for c in s]
    shape = ".".join("9" if k == "0123456789" else f"{ord(k[0]) // 128}" if len(k) > 1 else "=" + c for k, c in zip(classes, s, strict=True))
    x, total = 0, 1
    for c, k in zip(s, classes, strict=True):
        x = x * len(k) + k.index(c)
        total *= len(k)
    x = f(f"{kind}/{shape}", total, x)
    out = []
    for k in reversed(classes):
        x, r = divmod(x, len(k))
        out.append(k[r])
    return "".join(reversed(out))


def _email(s: str, f: Callable) -> str | None:
    """The domain stays; the name, in lower case, is permuted and gets its capitals back where a letter has one."""
    name, _, domain = s.rpartition("@")
    new = _letters("email@" + domain.lower(), name.lower(), f)
    if len(name) == len(new):
        new = "".join(c.upper() if a != a.lower() and len(c.upper()) == 1 and c.upper().lower() == c else c for a, c in zip(name, new, strict=True))
    return new + "@" + domain


_FIRST, _LAST = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()


def _date(order: str) -> Callable:
    def of(s: str, f: Callable) -> str | None:
        parts = re.findall(r"[0-9]+", s)
        at = {k: order.index(k) for k in "ymd"}
        try:
            day = dt.date(*(int(parts[at[k]]) for k in "ymd")).toordinal()
        except ValueError:
            return None
        if not _FIRST <= day <= _LAST:
            return None
        new = dt.date.fromordinal(_FIRST + f("date", _LAST - _FIRST + 1, day - _FIRST))
        value = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
        it = iter(value[k] for k in order)
        return re.sub(r"[0-9]+", lambda _: next(it), s)

    return of


_B, _E = r"(?<![\w])", r"(?![\w])"
#: Kind, pattern, and what validates and rewrites a match, or its beginning, whose length it tells; at one place
#: the first that validates counts.
KINDS: list[tuple[str, str, Callable]] = [
    ("email", r"(?<![\w.+-])[^\W_][\w.+-]{0,63}@(?:[^\W_](?:[\w-]{0,61}[^\W_])?\.)+[^\W\d_]{2,24}" + _E, _email),
    ("iban", _B + r"[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?" + _E, _iban),
    ("phone", r"(?<![\w+])\+[0-9]{1,3}(?:[ .-]?\([0-9]{1,5}\)|[ .-]?[0-9]{1,5})(?:[ .-]?[0-9]{2,5}){1,4}" + _E, _phone),
    ("phone", r"(?<![\w(])\([2-9][0-9]{2}\) ?[2-9][0-9]{2}[-.][0-9]{4}" + _E, _phone),
    ("phone", r"(?<![\w.-])[2-9][0-9]{2}([-.])[2-9][0-9]{2}\1[0-9]{4}" + r"(?![\w-])", _phone),
    ("ip", r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\w|\.[0-9])", _ip),
    # An hour behind T or an underscore doesn't make it another day.
    ("date", r"(?<![^\W_])(?<!-)[0-9]{4}-[0-9]{2}-[0-9]{2}(?!-)(?!(?!T[0-9])[^\W_])", _date("ymd")),
    ("date", r"(?<![\w/])[0-9]{4}/[0-9]{2}/[0-9]{2}(?![\w/])", _date("ymd")),
    ("date", r"(?<![\w.])[0-9]{2}\.[0-9]{2}\.[0-9]{4}(?!\w|\.[0-9])", _date("dmy")),
    ("date", r"(?<![\w/])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![\w/])", _date("dmy")),
    ("date", r"(?<![\w/])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![\w/])", _date("mdy")),
    ("ssn", r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])", _ssn),
    ("card", r"(?<![\w.])[0-9]{13,19}" + _E, _card),
    ("card", r"(?<![\w-])[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}" + r"(?![\w-])", _card),
    ("card", r"(?<![\w-])[0-9]{4}([ -])[0-9]{6}\1[0-9]{5}" + r"(?![\w-])", _card),
]
NAMES = tuple(dict.fromkeys(k for k, _, _ in KINDS))
_COMPILED = [(k, re.compile(p), rewrite) for k, p, rewrite in KINDS]
#: Every kind has five characters of numbers and their punctuation, or an at sign.
_MAYBE = re.compile(r"@|[0-9][0-9 ().+/-]{4}|[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}")


class Pseudonyms:
    def __init__(self, key: bytes):
        self.feistel = Feistel(key)
        self.kept: dict[tuple, int] = {}

    def _permute(self, kind: str, n: int, x: int) -> int:
        if len(self.kept) > 100_000:
            self.kept.clear()
        if (at := (kind, n, x)) not in self.kept:
            self.kept[at] = self.feistel.permute(kind, n, x)
        return self.kept[at]

    def spans(self, text: str) -> list[tuple[int, int, str, str]]:
        """(start, end, kind, pseudonym) of every value, leftmost first, then by the order of ``KINDS``."""
        if not _MAYBE.search(text):
            return []
        found = []
        for i, (kind, pattern, rewrite) in enumerate(_COMPILED):
            if kind == "email" and "@" not in text:
                continue
            for m in pattern.finditer(text):
                if (new := rewrite(m[0], self._permute)) is not None:
                    new, length = new if isinstance(new, tuple) else (new, len(m[0]))
                    found.append((m.start(), i, m.start() + length, kind, new))
        out, at = [], 0
        for start, _, end, kind, new in sorted(found):
            if start >= at:
                out.append((start, end, kind, new))
                at = end
        return out

    def rewrite(self, text: str) -> tuple[str, list[tuple[int, int, str, str]]]:
        spans, parts, at = self.spans(text), [], 0
        for start, end, _, new in spans:
            parts += [text[at:start], new]
            at = end
        return "".join([*parts, text[at:]]), spans


def with_pseudonyms(docs: DataFrame, key: bytes, out: str = "private", text_col: str = "text") -> DataFrame:
    """Replace the text of every row by one with pseudonyms, and add ``out``: struct(n_<kind>..., spans).

    ``spans`` lists kind:start:end of what was replaced, in code points of the old text, comma-joined.
    Numbers that don't validate (a card's check digit, an address's bytes, a calendar's dates) stay.  A
    null text stays null with zero counts, an empty one empty; repeated rows agree; other columns stay
    whatever their names; an empty table stays empty.  A text is scanned in time that grows with its length.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = Pseudonyms(key)
        for batch in batches:
            new, spans = [], []
            for text in batch.to_pylist():
                changed, found = names.rewrite(text) if text else (text, [])
                new.append(changed if found else None)
                spans.append(found)
            counts = [pa.array([sum(s[2] == k for s in own) for own in spans], pa.int64()) for k in NAMES]
            listed = pa.array([",".join(f"{k}:{a}:{b}" for a, b, k, _ in own) for own in spans], pa.string())
            yield pa.StructArray.from_arrays([pa.array(new, pa.string()), *counts, listed], ["text", *(f"n_{k}" for k in NAMES), "spans"])

    kind = "text string, " + ", ".join(f"n_{k} long" for k in NAMES) + ", spans string"
    udf = F.arrow_udf(run, returnType=kind).asNondeterministic()
    text = F.col(quoted(text_col)).cast("string")
    made = own_names(docs, out)("private")
    found = docs.withColumn(made, udf(text))
    kept = [F.coalesce(F.col(f"{made}.text"), text).alias(c) if c.lower() == text_col.lower() else F.col(quoted(c)) for c in docs.columns if c.lower() != out.lower()]
    return found.select(*kept, F.struct(*[F.col(f"{made}.n_{k}") for k in NAMES], F.col(f"{made}.spans")).alias(out))
