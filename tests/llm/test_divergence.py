"""The source audit against a plain Python version, and its awkward rows."""

import random
import re
from collections import Counter, defaultdict

from tidemark.llm import divergence

SCHEMA = "text string, lang string, source string, term string, n long, by string"


def plain(rows, least_docs, top):
    docs, n, groups = defaultdict(int), Counter(), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        for t in set(found):
            docs[lang, t] += 1
        n.update((lang, source, t) for t in found)
    kept = defaultdict(list)
    for (lang, t), k in docs.items():
        if k >= least_docs:
            kept[lang].append(t)
    out = set()
    for lang, source in groups:
        v, ts = len(kept[lang]), kept[lang]
        shares = lambda s: {t: 1 + 10**9 * (n[lang, s, t] + 5) // (sum(n[lang, s, u] for u in ts) + 5 * v) for t in ts}  # noqa: B023, E731
        mine, names = shares(source), [s for x, s in groups if x == lang and s != source]
        whole = {t: sum(n[lang, s, t] for x, s in groups if x == lang) for t in ts}
        q = {t: 1 + 10**9 * (whole[t] + 5) // (sum(whole.values()) + 5 * v) for t in ts}
        pairs = [("pair", s, sum(abs(mine[t] - p) for t, p in shares(s).items())) for s in names]
        terms = [("term", t, mine[t] - q[t]) for t in ts if n[lang, source, t] and mine[t] > q[t]]
        for part, most in ((pairs, None), (terms, top)):
            for rank, (kind, item, value) in enumerate(sorted(part, key=lambda x: (-x[2], x[1].encode()))[:most], 1):
                out.add((lang, source, kind, item, value, rank))
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, "own", 7, "x") for r in rows], SCHEMA)


def test_against_plain(spark):
    r = random.Random(5)
    words = ["The", "the", "ÉTÉ", "été", "straße", "a", "Z", "don't", "x1y2", "İ", "\U0001f600", "kelvin K", "of"]
    rows = [(r.choice([None, "", "...", " ".join(r.choices(words, k=r.randint(1, 12)))]), r.choice(["en", "fr", None, ""]), r.choice(["s0", "s0", "s0", "s1", "é", None])) for _ in range(150)]
    rows += rows[:20] + [("lone words that no other has", "xx", "s9"), (None, "yy", "s1"), ("a", "yy", "s2")]
    found = [tuple(x) for x in divergence.source_divergence(table(spark, rows), 5, 4).collect()]
    assert len(found) == len(set(found))
    assert set(found) == plain(rows, 5, 4)


def test_slices_agree_with_broadcast(spark, monkeypatch):
    rows = [(f"w{'abc'[i % 3]} {'all ' * (i % 4)}", "en", f"s{i % 5}") for i in range(60)]
    one = {tuple(x) for x in divergence.source_divergence(table(spark, rows), 3).collect()}
    monkeypatch.setattr(divergence, "_MOST_BROADCAST", 0)
    assert {tuple(x) for x in divergence.source_divergence(table(spark, rows), 3).collect()} == one


def test_counts_beyond_64_bits_of_product(spark):
    df = spark.sql("select 40000000000L n, 90000000000L total, 7L v").select(divergence.share(*map(divergence.F.col, ("n", "total", "v"))))
    assert df.first()[0] == 1 + 10**9 * 40000000005 // 90000000035


def test_empty(spark):
    assert divergence.source_divergence(table(spark, [])).count() == 0
