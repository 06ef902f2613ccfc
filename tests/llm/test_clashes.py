"""A caller's columns come back as they were, whatever their names."""

import random
import re
from pathlib import Path

import pytest

from tidemark import llm
from tidemark.llm import bpe, licences, mixing, pii, quality, secrets, simhash

#: Every name that the operators give to a column of their own: what stands in quotes after the usual prefix, or in ``own``.
SOURCE = "\n".join(p.read_text() for p in Path(llm.__file__).parent.glob("*.py"))
INTERNAL = sorted({f"__{n}" for n in re.findall(r"""(?:own|name|self\.name|streams\.name)\(f?["'](\w+)["']\)""", SOURCE)} | {n.lower() for n in re.findall(r"""["'](__[a-z]\w*)["']""", SOURCE) if not n.endswith("__")})
OUT = ["of", "found", "start", "part", "gap", "text_crc32", "size", "shard", "stream", "place", "block", "fp", "node", "root", "pivots", "origin", "a.b", "we`ird", "struct", "x y"]
R = random.Random(1)
WORDS = ["".join(R.choices("abcdefgh", k=R.randint(2, 7))) for _ in range(100)]
TEXTS = [" ".join(R.choices(WORDS, k=80)) for _ in range(6)] + [None, "", "access_key_id=foo123 aB3dE5gH7jK9mN1pQ3sT5v", "All rights reserved. Licensed under the MIT License.", "mail a.b@x.org"]


@pytest.fixture(scope="module", params=["lower", "upper"])
def docs(spark, request):
    assert len(INTERNAL) > 20
    more = [getattr(n, request.param)() for n in [*INTERNAL, *OUT]]
    rows = [(i, t, "en", f"src{i % 3}", *[f"{i}-{k}" for k in range(len(more))]) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", *more])


def others(df):
    columns = [c for c in df.columns if c not in ("doc_id", "text", "lang", "source")]
    return {r[df.columns.index("doc_id")]: tuple(r[df.columns.index(c)] for c in columns) for r in df.collect()}


ADDING = {
    "pii": lambda d, out: pii.with_pseudonyms(d, b"k", out=out),
    "licences": lambda d, out: licences.with_licences(d, out=out),
    "bpe": lambda d, out: bpe.with_token_ids(d, out=out),
    "secrets": lambda d, out: secrets.with_secrets(d, out=out),
    "mixing": lambda d, out: mixing.mix(d, {"src0": 2}, out=out),
    "quality": lambda d, out: quality.with_quality(d, out=out),
}


@pytest.mark.parametrize("name", sorted(ADDING))
def test_columns_stay_beside_what_is_added(docs, name):
    got = ADDING[name](docs, "added column")
    assert got.columns == [*docs.columns, "added column"]
    assert others(got.drop("added column")) == others(docs)
    replaced = ADDING[name](docs, "LANG")
    assert sorted(c.lower() for c in replaced.columns) == sorted(c.lower() for c in docs.columns)


KEEPING = {
    "redact": lambda d: secrets.redact_secrets(d),
    "mixed": lambda d: mixing.mixed(d, {"src0": 2}),
    "filter": lambda d: quality.quality_filter(d, min_words=0, most_repeated=1.0, bands={"en": [quality.Band(0, 0, 99, 1, 0)]}),
    "dedup": lambda d: simhash.simhash_dedup(d),
}


@pytest.mark.parametrize("name", sorted(KEEPING))
def test_columns_stay_as_they_were(docs, name):
    got = KEEPING[name](docs)
    want = others(docs)
    assert got.columns == docs.columns and got.count() > 0
    assert all(want[k] == v for k, v in others(got).items())
    texts = {r["text"] for r in got.collect()}
    if name == "redact":
        assert not any("aB3dE5gH7jK9mN1pQ3sT5v" in str(v) for row in got.collect() for v in row) and len(texts) == len(TEXTS)


def test_reports_read_odd_names(docs):
    odd = docs.withColumnsRenamed({"doc_id": "id.of", "text": "the text"})
    for report in (secrets.secret_report, licences.licence_report, bpe.round_trip, simhash.simhash_components, simhash.fingerprints):
        assert report(odd, id_col="id.of", text_col="the text").count() == len(TEXTS)
