"""Text rules: issue keys, trailers, scrubbing, signals of automation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY = r"\b[A-Z][A-Z0-9]+-[0-9]+\b"
#: What looks like an issue's key and is none.
NOT_KEYS = ("UTF", "SHA", "ISO", "RFC", "CVE", "HTTP", "TLS", "AES", "MD", "BASE")


def issue_keys(text: Column) -> Column:
    """The keys in a text, without the usual false ones, each once."""
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(KEY), F.lit(0)))
    return F.filter(found, lambda k: ~F.substring_index(k, "-", 1).isin(*NOT_KEYS))


def trailers(message: Column, name: str) -> Column:
    """The values of a trailer in a commit message, in order."""
    return F.regexp_extract_all(message, F.lit(rf"(?im)^{name}:[ \t]*(.+?)[ \t]*$"), F.lit(1))


#: Replaced in this order.
SCRUBS = [
    (r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}", "[token]"),
    (r"(?i)(api_?key|secret|token|passw(?:or)?d)([\"' ]*[:=][\"' ]*)[A-Za-z0-9+/_.=-]{8,}", "$1$2[secret]"),
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[email]"),
]


def scrub(text: Column) -> Column:
    """Tokens, secrets and addresses masked, and then what of the rest looks random.

    Most texts have no run of 32 characters: only the others are taken apart.
    """
    for pattern, mask in SCRUBS:
        text = F.regexp_replace(text, pattern, mask)
    return F.when(text.rlike(_RUN), scrub_random(text)).otherwise(text)


def char_entropy(run: Column) -> Column:
    """Shannon entropy of a string's characters in bits."""
    chars = F.filter(F.split(run, ""), lambda c: c != "")
    share = lambda c: F.size(F.filter(chars, lambda d: d == c)) / F.size(chars)
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c)))


_RUN = "[A-Za-z0-9+/_=-]{32,}"
RANDOM_BITS = 3.5


def scrub_random(text: Column) -> Column:
    """Runs of 32 or more whose characters have at least 3.5 bits of entropy are masked, the rest is as it was.

    The runs and what splitting at them leaves are put together again: no Python function is needed.
    """
    runs = F.transform(F.regexp_extract_all(text, F.lit(_RUN), F.lit(0)), lambda r: F.when(char_entropy(r) >= RANDOM_BITS - 1e-12, "[random]").otherwise(r))
    gaps = F.split(text, _RUN, -1)
    return F.array_join(F.flatten(F.zip_with(gaps, F.concat(runs, F.array(F.lit(""))), lambda a, b: F.array(a, b))), "")


def normalised_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9 ]", " "), " +", " "))


#: Signals that a text was written by a machine, and their weights.
SIGNALS = [
    (r"(?i)co-authored-by:.*(copilot|assistant|\[bot\])", 0.9),
    (r"(?i)generated (with|by)", 0.6),
    (r"(?i)\bas an? (ai|language model)\b", 0.9),
    (r"(?i)^## summary", 0.3),
    (r"(?i)\btest plan\b", 0.25),
    ("✨|🤖", 0.5),
    (r"(?i)\bcomprehensive\b", 0.15),
    (r"(?i)\bleverag(e|es|ing)\b", 0.15),
    (r"(?i)\brobust\b", 0.1),
    (r"(?i)\bseamless(ly)?\b", 0.1),
]


def signal_weights(text: Column) -> Column:
    return F.array(*[F.when(text.rlike(pattern), weight) for pattern, weight in SIGNALS])


def is_bot(login: Column, kind: Column) -> Column:
    name = F.lower(login)
    return F.coalesce((F.lower(kind) == "bot") | name.endswith("[bot]") | name.endswith("-bot") | name.isin("dependabot", "renovate", "github-actions"), F.lit(False))
