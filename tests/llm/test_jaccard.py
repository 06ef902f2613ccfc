"""The pipeline's near copies against all pairs of 5-word shingle sets."""

import itertools
import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline
from tidemark.llm import jaccard

R = random.Random(4)
WORDS = ["".join(R.choices("abcdefgh", k=R.randint(2, 7))) for _ in range(300)]


def texts():
    line = " ".join(R.choices(WORDS, k=30))
    out = [" ".join(R.choices(WORDS, k=R.randint(50, 200))) for _ in range(12)]
    out += [f"{line} {t}" for t in out[:6]]
    for base in out[:12]:
        for _ in range(6):
            words = base.split()
            for _ in range(R.randint(0, 5)):
                words[R.randrange(len(words))] = R.choice(WORDS)
            out.append(" ".join(words))
    return [*out, None, "", "one two", "One  two"]


def survivors(rows):
    sets = {}
    for i, t in rows:
        words = (t or "").lower().split()
        sets[i] = {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
    label = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) and label[a] != label[b]:
            x, y = sorted((label[a], label[b]))
            label = {k: x if v == y else v for k, v in label.items()}
    return {i for i in sets if label[i] == i}


@pytest.mark.parametrize("common", [0, 100_000])
def test_every_pair_of_that_similarity_is_joined(spark, monkeypatch, common):
    monkeypatch.setattr(jaccard, "_SAMPLE", 1)
    monkeypatch.setattr(jaccard, "_COMMON", common)
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert len(got) == len(set(got)) and set(got) == survivors(rows)


def test_near_copies_of_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, data).collect()}
    assert got == survivors([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])


def heads_of_many(n, families):
    """Unlike texts behind a few common heads, some of which have a near copy."""
    rows = []
    for i in range(n):
        own = R.choices(range(10**6), k=40)
        text = " ".join([*families[i % len(families)], *(f"w{x}" for x in own)])
        rows.append((i, text))
        if i % 50 == 0:
            rows.append((n + i, f"{text} more"))
    return rows


def test_unlike_texts_behind_one_head_stay_linear(spark, monkeypatch):
    """A five-word head that very many unlike texts share makes few pairs, and the near copies among them are found."""
    monkeypatch.setattr(jaccard, "_COMMON", 0)
    monkeypatch.setattr(jaccard, "_ROUNDS", 1)
    joined = []
    before = jaccard.candidates
    monkeypatch.setattr(jaccard, "candidates", lambda shared, similarity: joined.append(shared.count()) or before(shared, similarity))
    heads = [[f"h{j}{k}" for k in range(n)] for j, n in enumerate((5, 5, 9, 12, 6))]
    rows = heads_of_many(3000, heads)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(docs).collect()}
    assert joined[-1] <= 2 * len(rows)
    assert got == {i: i - 3000 if i >= 3000 else i for i, _ in rows}


def test_orders_that_change_lose_no_pair(spark, monkeypatch):
    """The same with near copies that share most of a long head, against all pairs."""
    monkeypatch.setattr(jaccard, "_COMMON", 0)
    monkeypatch.setattr(jaccard, "_MANY", 0.5)
    monkeypatch.setattr(jaccard, "_ORDERS", 1)
    monkeypatch.setattr(jaccard, "_ROUNDS", 1)
    head = [f"head{k}" for k in range(30)]
    rows = []
    for i in range(120):
        rest = [f"r{R.randrange(40)}x{k}" if i % 4 else f"s{k % 7}" for k in range(R.randint(4, 14))]
        rows.append((i, " ".join(head[: R.randint(20, 30)] + rest)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.jaccard_components(docs).collect()
    assert {r["doc_id"] for r in got if r["component_id"] == r["doc_id"]} == survivors(rows)


def test_unlike_texts_with_a_shared_passage_are_not_compared(spark, monkeypatch):
    """Texts that share few of their first shingles can't be similar, so none of them is read again; their copies are."""
    compared = []
    before = jaccard.similar
    monkeypatch.setattr(jaccard, "similar", lambda pairs, *a: compared.append(pairs.count()) or before(pairs, *a))
    rows = []
    for i in range(300):
        passage = [f"p{i // 10}x{k}" for k in range(8)]
        rows.append((i, " ".join([*passage, *(f"w{R.randrange(10**6)}" for _ in range(60))])))
    rows.append((300, f"{rows[7][1]} more"))
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 7 if i == 300 else i for i, _ in rows}
    assert sum(compared) <= 2


def test_rows_of_one_id_go_by_their_own_text(spark):
    """A repeated id takes no unlike text with it when one of its texts is a copy, and near copies of one id leave one."""
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(80)) for x in "abcd")
    rows = [(1, a), (5, f"{a} more"), (5, b), (6, c), (6, f"{c} more"), (7, d), (7, d), (None, a)]
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()]
    assert [t for i, t in got if i == 6] in ([c], [f"{c} more"])
    assert sorted(r for r in got if r[0] and r[0] != 6) == [(1, a), (5, b), (7, d)] and [r for r in got if r[0] is None] == [(None, a)]


def test_near_copies_meet_once_not_for_each_shared_shingle(spark, monkeypatch):
    """A family of 30 gives about a row a pair, however many of their first shingles they share; unlike texts give none."""
    joined = []
    before = jaccard.candidates
    monkeypatch.setattr(jaccard, "candidates", lambda shared, similarity: joined.append(shared.count()) or before(shared, similarity))
    rows = []
    for i in range(30):
        words = [f"f{k}" for k in range(300)]
        words[290 - 9 * i] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join([*(f"p{k}" for k in range(60)), *(f"w{i}x{k}" for k in range(200))])) for i in range(30)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 0 if i < 30 else i for i, _ in rows}
    assert joined[0] <= 4 * 30 * 29 / 2


def test_bitmaps_differ_in_no_more_bits_than_sets_in_shingles():
    for n in (0, 1, 5, 300, 5000):
        one = [f"w{R.randrange(10**6)}" for _ in range(n)]
        other = [w if R.random() < 0.9 else "other" for w in one]
        x, y = jaccard.shingles(" ".join(one)), jaccard.shingles(" ".join(other))
        a, b = jaccard.bitmap(x), jaccard.bitmap(y)
        assert sum(int(v).bit_count() for v in (a ^ b).view("uint64")) <= len(set(x.tolist()) ^ set(y.tolist()))


def test_long_texts_with_a_shared_passage_are_not_compared(spark, monkeypatch):
    """Bitmaps of long unlike texts pass as similar; their shared first shingles are counted, and they aren't read again."""
    compared = []
    before = jaccard.similar
    monkeypatch.setattr(jaccard, "similar", lambda pairs, *a: compared.append(pairs.count()) or before(pairs, *a))
    rows = [(i, " ".join([*(f"p{i // 10}x{k}" for k in range(40)), *(f"w{i}x{k}" for k in range(2500))])) for i in range(30)]
    rows.append((30, f"{rows[7][1]} more"))
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 7 if i == 30 else i for i, _ in rows}
    assert sum(compared) <= 6  # that copy, found in more than one way; 135 pairs share a passage
