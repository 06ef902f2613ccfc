"""A corpus pipeline of the training-data operators, from raw documents to token ids.

Each stage works on all rows that the one before kept.  All but the last return the columns of
``documents``, whatever they are; the last returns what a trainer reads, in the mixed order.

All stages handle awkward rows alike: a null or empty text has no words and goes with the quality rules; a
null id stays null and is never the one that a copy is dropped for; a null language is judged by the text's
script; a null source belongs to the pool of unnamed ones; rows that repeat an id and its text leave one at
the near copies, and those that repeat it with other texts go each by its own; ties in places don't occur; an
empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe import with_round_trip
from tidemark.llm.jaccard import jaccard_dedup
from tidemark.llm.mixing import mixed
from tidemark.llm.quality import quality_filter
from tidemark.llm.queries import WEIGHTS
from tidemark.llm.secrets import redact_secrets
from tidemark.llm.shared import staged


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, null and empty ones among them."""
    return quality_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of 5-word Jaccard similarity 0.8 or more join: that of the smallest id.

    Nearly equal ones are found as near SimHash fingerprints, the rest by shared shingles; all are verified.
    """
    return jaccard_dedup(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every reported secret is masked in its text; n_chars follows the text, and no row goes."""
    return redact_secrets(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in the order of their sources' target weights: that of the partitions and, in each, of its rows."""
    return mixed(docs, WEIGHTS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """place, doc_id, source, n_tokens, token_ids (little-endian unsigned 32-bit), ids_sha256, decoded_sha256, exact.

    A file's rows may be read in any order, so each carries its place in the mixed order, and this stage's
    files are sorted by it; it follows from the rows themselves, so it is that of the stage before.
    """
    ordered = mixed(docs.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text")), WEIGHTS, place="place")
    coded = with_round_trip(ordered).select("*", "coded.*")
    return coded.select(
        "place",
        "doc_id",
        "source",
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        "token_ids",
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.col("text").cast("binary")).alias("exact"),
    )


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("secrets", secrets), ("mixing", mixing), ("tokens", tokens)]

#: No SQL expresses tokenisers and SimHash; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
