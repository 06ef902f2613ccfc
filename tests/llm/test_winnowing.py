"""Winnowing against a plain version, its guarantee, and the rows that follow each other."""

import hashlib
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import winnowing

SCHEMA = "doc_id long, text string, marks string, next long, kept int"


def plain(text, k, w):
    """(pos, hash) of each window's least hash, the rightmost of equal ones, without chunks."""
    if not text:
        return []
    grams = [text[i : i + k] for i in range(max(len(text) - k + 1, 1))]
    # what stands above the place in a signed number of 64 bits; a hash is its leading 40
    order = [((xxhash.xxh64(g.encode("utf-32-be"), seed=42).intdigest() << 12) & (1 << 64) - 1) for g in grams]
    signed = [x - (1 << 64) if x >> 63 else x for x in order]
    marks = dict.fromkeys(max((i for i in range(s, min(s + w, len(grams)))), key=lambda i: (-signed[i], i)) for s in range(max(len(grams) - w + 1, 1)))
    return [(i, order[i] >> 24) for i in marks]


def words(found):
    return " ".join(f"{h:010x}" for _, h in found)


def like(a, b):
    a, b = {h for _, h in a}, {h for _, h in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def some_texts(r, n, most):
    letters = "ab \né\U0001f600xyzw"
    return [r.choice(["", None, "a", "a" * r.randint(1, most), "".join(r.choices(letters, k=r.randint(1, most)))]) for _ in range(n)]


@pytest.mark.parametrize(("k", "w"), [(4, 8), (5, 2), (16, 32), (3, 1)])
def test_marks(spark, monkeypatch, k, w):
    monkeypatch.setattr(winnowing, "CHUNK", 4096)
    texts = some_texts(random.Random(k), 40, 400) + ["b" * 9000, "".join(random.Random(1).choices("abc", k=13000))]
    df = spark.createDataFrame([(i, t, "x", 1, 1) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: [tuple(m) for m in r.marks] for r in winnowing.with_marks(df, k=k, w=w).collect()}
    assert got == {i: plain(t, k, w) for i, t in enumerate(texts)}


def test_edited(spark):
    r = random.Random(3)
    texts = some_texts(r, 60, 300) + ["".join(r.choices("abcdef ", k=n)) for n in (4111, 4112, 8200, 8213, 20000)]
    rows = [(i * 3 - 50, t, "x", 1, 1) for i, t in enumerate(texts)] + [(None, "no id " * 30, "x", 1, 1)]
    shuffled = rows[:]
    r.shuffle(shuffled)
    got = {x.doc_id: x for x in winnowing.edited_report(spark.createDataFrame(shuffled, SCHEMA)).collect()}
    rows = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0))
    assert len(got) == len(rows)
    k, w = winnowing.K, winnowing.WINDOW
    for (i, t, *_), (_, u, *_) in zip(rows, rows[1:] + rows[:1], strict=True):
        t, u = t or "", u or ""
        gone = len(t) // 4
        edited = t[: len(t) - gone] + u[:gone]
        a, b, c = (plain(x, k, w) for x in (t, edited, u))
        x = got[i]
        assert (x.n_chars, x.edited_sha256, x.fingerprint, x.edited_fingerprint) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), words(a), words(b))
        assert x.positions == [p for p, _ in a]
        assert (x.near_edited, x.near_next) == (like(a, b), like(a, c))


def test_shared_passages_share_a_mark(spark):
    r = random.Random(8)
    k, w = 6, 16
    passage = "".join(r.choices("abcdefgh", k=k + w - 1))
    texts = ["".join(r.choices("ijklmnop", k=r.randint(0, 6000))) + passage + "".join(r.choices("qrstuvwx", k=r.randint(0, 5000))) for _ in range(30)]
    df = spark.createDataFrame([(i, t, "x", 1, 1) for i, t in enumerate(texts)], SCHEMA)
    found = winnowing.with_marks(df, k=k, w=w).collect()
    held = [{m.hash for m in r.marks if texts[r.doc_id].find(passage) <= m.pos <= texts[r.doc_id].find(passage) + w - 1} for r in found]
    assert set.intersection(*held)


def test_repeated_rows_and_ranges(spark):
    """Half of all rows are one row over and over; each is followed by itself but for the last."""
    rows = [(7, "same text " * 5, "x", 1, 1)] * 300 + [(i, f"text {i} " * 8, "x", 1, 1) for i in range(100) if i != 7]
    got = winnowing.edited_report(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert len(got) == 399
    same = [r for r in got if r.doc_id == 7]
    assert sum(r.near_next == 1.0 for r in same) == 299
    by_id = {r.doc_id: r for r in got}
    for i in (6, 99):
        t, u = f"text {i} " * 8, "same text " * 5 if i == 6 else "text 0 " * 8
        assert by_id[i].edited_sha256 == hashlib.sha256((t[: len(t) - len(t) // 4] + u[: len(t) // 4]).encode()).hexdigest()


def test_next_keeps_callers_columns(spark):
    df = spark.createDataFrame([(2, "b", "x", 1, 5), (1, "a", "y", 2, 6), (3, "c", "z", 3, 7)], SCHEMA)
    got = winnowing.with_next(df, "doc_id", ["text"], "follower").select("*", F.col("follower.text").alias("t")).orderBy("doc_id").collect()
    assert [(r.doc_id, r.marks, r.next, r.kept, r.t) for r in got] == [(1, "y", 2, 6, "b"), (2, "x", 1, 5, "c"), (3, "z", 3, 7, "a")]


def test_one_row_and_none(spark):
    one = winnowing.edited_report(spark.createDataFrame([(1, "abcd" * 20, "x", 1, 1)], SCHEMA)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert winnowing.edited_report(spark.createDataFrame([], SCHEMA)).count() == 0
