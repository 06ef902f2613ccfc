"""The bands of the quality rules, fitted to labelled clean documents.

``python -m tidemark.llm.bands FOLDER`` fits them to a folder's ``documents`` and ``labels`` and prints them with
what they keep of the half that they are fitted to and of the other one.  ``quality.BANDS`` are its output.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.quality import BANDS, PROSE, Band, with_quality, within
from tidemark.llm.shared import staged

#: The least words of each step, and what a band reaches beyond what the clean documents of a step show.
STEPS, MARGIN = (0, 100, 200, 400, 800), {"chars": 0.10, "entropy": 0.10, "byte_share": 0.05}
#: The most labelled documents that are looked at, those of the smallest hashes, and the salt that halves them.
MOST, SALT = 50_000, 5


def measured(docs: DataFrame, labels: DataFrame, most: int = MOST) -> DataFrame:
    """(lang, clean, fitted, n_words, chars, byte_share, entropy) of labelled documents that the word rules keep."""
    chosen = labels.where("doc_id is not null and quality is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = with_quality(docs.join(chosen.select("doc_id", (F.col("quality") == 1).alias("clean")), "doc_id"), out="q").where("not q.base_failed")
    fitted = F.pmod(F.xxhash64("doc_id", F.lit(SALT)), F.lit(2)) == 0
    return rows.select("lang", "clean", fitted.alias("fitted"), "q.n_words", F.col("q.chars_per_token").alias("chars"), "q.byte_share", F.col("q.token_entropy").alias("entropy"))


def fit(rows: DataFrame) -> dict[str, list[Band]]:
    """A language's band from a step's words on holds every clean document so long of the half that is fitted to."""
    clean = rows.where("clean and fitted and lang is not null")
    steps = clean.select("*", F.explode(F.array(*map(F.lit, STEPS))).alias("step")).where("n_words >= step")
    least = steps.groupBy("lang", "step").agg(F.min("chars").alias("low"), F.max("chars").alias("high"), F.max("byte_share").alias("share"), F.min("entropy").alias("entropy"))
    out: dict[str, list[Band]] = {}
    for r in least.orderBy("lang", "step").collect():  # a row for each language and step
        own = (round(r["low"] - MARGIN["chars"], 2), round(r["high"] + MARGIN["chars"], 2), round(r["share"] + MARGIN["byte_share"], 2), round(r["entropy"] - MARGIN["entropy"], 2))
        out.setdefault(r["lang"], []).append(Band(r["step"], *own, *PROSE[r["step"]]))
    return out


def figures(rows: DataFrame, bands: dict[str, list[Band]]) -> dict[tuple[bool, bool], tuple[int, int]]:
    """(clean, fitted): documents, and how many of them the bands keep."""
    out: dict[tuple[bool, bool], tuple[int, int]] = {}
    for r in rows.where(F.col("lang").isin(*bands)).toLocalIterator():  # at most ``MOST`` rows
        n, kept = out.get(at := (r["clean"], r["fitted"]), (0, 0))
        out[at] = n + 1, kept + within(bands[r["lang"]], r["n_words"], r["chars"], r["byte_share"], r["entropy"])
    return out


def main(folder: str) -> None:
    from tidemark.session import session

    spark = session("local[*]", 8, **{"spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    rows = staged(measured(read("documents"), read("labels")), "measured")
    made = fit(rows)
    for lang, steps in made.items():
        print(f'    "{lang}": [')
        for b in steps:
            print(f"        Band({b.min_words}, {b.least_chars}, {b.most_chars}, {b.most_byte_share}, {b.least_entropy}, *PROSE[{b.min_words}]),")
        print("    ],")
    for name, bands in (("fitted now", made), ("as they stand", BANDS)):
        for (clean, fitted), (n, kept) in sorted(figures(rows, {k: v for k, v in bands.items() if k in made}).items()):
            print(f"{name}: {'clean' if clean else 'other'} documents {'fitted to' if fitted else 'held out'}: {kept} of {n} kept ({kept / n:.4f})")


if __name__ == "__main__":
    main(sys.argv[1])
