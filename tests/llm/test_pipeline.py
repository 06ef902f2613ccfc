"""The pipeline against a brute-force version, stage by stage in plain Python."""

import hashlib
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_pipeline
from test_jaccard import survivors
from test_operators import all_spans, tiktoken_encoding  # noqa: F401
from tidemark.llm import quality
from tidemark.llm.queries import oracle_sql, queries
from tidemark.llm.vocabularies import default_path


def test_pipeline(spark, data, tiktoken_encoding):  # noqa: F811
    docs = [r.asDict() for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    fertility = quality.Fertility(open(default_path("piece_bpe_32k.model"), "rb").read())

    def kept(d):
        n, _, _, _, repeat = quality.word_rules(d["text"])
        _, chars, share, entropy = fertility.measure(d["text"])
        return n >= 50 and repeat <= 0.5 * n and quality.within(quality.BANDS[d["lang"]], n, chars, share, entropy)

    docs = [d for d in docs if kept(d)]
    alive = survivors([(d["doc_id"], d["text"]) for d in docs])
    docs = [d for d in docs if d["doc_id"] in alive]
    want = {}
    for d in docs:
        out, at, until = [], 0, 0
        for a, _, b in all_spans(d["text"]):
            if a >= until:
                out += [d["text"][at:a], "[SECRET]"] if a >= at else []
            at = until = max(until, b)
        text = "".join([*out, d["text"][at:]])
        want[d["doc_id"]] = (len(tiktoken_encoding.encode_ordinary(text)), hashlib.sha256(text.encode()).hexdigest())
    got = corpus_pipeline.run(spark, data).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["decoded_sha256"]) for r in got} == want and len(got) == len(want) and all(r["exact"] for r in got)


def test_stages_return_the_columns_of_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, data).dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), data).count() == 0


def test_the_mixed_order_reaches_the_trainer(spark, data, tmp_path):
    """The tokens' files, read in order, follow the places that mixing gave; every row is there."""
    import pyarrow.parquet as pq

    docs = spark.read.parquet(f"{data}/documents.parquet")
    corpus_pipeline.mixing(spark, docs, data).write.parquet(f"file://{tmp_path}/mixed")
    mixed = [i for f in sorted((tmp_path / "mixed").glob("part-*")) for i in pq.read_table(f)["doc_id"].to_pylist()]
    again = spark.read.parquet(f"file://{tmp_path}/mixed").repartition(7)
    corpus_pipeline.tokens(spark, again, data).write.parquet(f"file://{tmp_path}/tokens")
    rows = [x for f in sorted((tmp_path / "tokens").glob("part-*")) for x in pq.read_table(f).to_pylist()]
    assert [x["place"] for x in rows] == sorted(x["place"] for x in rows)
    assert [x["doc_id"] for x in rows] == mixed and len(mixed) == docs.count()


def test_stages_handle_awkward_rows(spark, data):
    long = "one two three " * 60_000
    plain = " ".join(f"w{i}" for i in range(80))
    rows = [(1, None, "en", "src0", None), (2, "", None, None, 0), (None, plain, "en", "src1", 3), (3, plain, None, None, 3), (3, plain, None, None, 3), (4, plain, "xx", "src9", 3), (5, long, "en", "src0", 9), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    near = [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, data).collect()]
    assert sorted(x for x in near if x) == [1, 3, 5] and near.count(None) == 2
    for name, stage in corpus_pipeline.STAGES[2:]:
        assert stage(spark, docs, data).count() == len(rows), name
    wide = docs.withColumns({"__id": F.lit(1), "__Text": F.lit("x"), "place": F.lit(2)})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, wide, data)
        assert got.columns == wide.columns and {(r["__id"], r["__Text"], r["place"]) for r in got.collect()} <= {(1, "x", 2)}, name
    assert corpus_pipeline.tokens(spark, docs.limit(0), data).count() == 0


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_oracles_agree(spark, data, name):
    import duckdb

    con = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    found = con.execute(oracle_sql()[name])
    columns = [d[0] for d in found.description]
    got = queries()[name](spark, data)
    key = lambda r: [(v is None, str(v)) for v in r]
    assert sorted(got.columns) == sorted(columns) and sorted(found.fetchall(), key=key) == sorted((tuple(r[c] for c in columns) for r in got.collect()), key=key)


@pytest.mark.parametrize("name", sorted(queries()))
def test_queries_return_a_row_for_each_document(spark, data, name):
    got = queries()[name](spark, data)
    if name not in ("op6_nearest", "op11_pareto", "op13_divergence"):  # pairs, offers and groups
        assert got.count() == spark.read.parquet(f"{data}/documents.parquet").count()
    assert set(oracle_sql()) <= set(queries())
