"""Quality rules: word counts, repetition, and the fertility of a public tokenizer within bands.

Fertility is measured with a public SentencePiece vocabulary with byte fallback: characters for each
token, the share of byte-fallback tokens, and the entropy of the text's tokens in bits.  A band holds,
per language (else per script), what clean text shows; text outside is rejected.  Short texts scatter
more, so a band has steps by the number of words.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import own_names, quoted
from tidemark.llm.vocabularies import broadcast_file, default_path, once_per_worker


class Band(NamedTuple):
    """From ``min_words`` words on: what characters per token, byte share and token entropy may be."""

    min_words: int
    least_chars: float
    most_chars: float
    most_byte_share: float
    least_entropy: float
    prose_chars: float = 0.0  # over ``most_chars``, so many are allowed, too, from this entropy on
    prose_entropy: float = 0.0


#: Ordinary prose has more characters per token than the labelled documents, thus fewer tokens and, when
#: short, less entropy.  By words of a step: characters allowed and the least entropy, under what real texts of
#: the four languages show (the tests hold some against them).
PROSE = {0: (6.0, 4.5), 100: (6.0, 5.0), 200: (6.0, 5.5), 400: (6.0, 6.1), 800: (6.0, 6.6)}

#: Bands by language, then by script for text in other languages.  Those of languages are the output of
#: ``tidemark.llm.bands`` over the largest labelled table at hand, whose held-out half the README has figures of;
#: that module has the fit, its sample and its margins.  Scripts without labelled text get wide ones
#: that only catch garbled text.
BANDS: dict[str, list[Band]] = {
    "de": [
        Band(0, 2.15, 2.93, 0.08, 5.41, *PROSE[0]),
        Band(100, 2.24, 2.91, 0.07, 5.83, *PROSE[100]),
        Band(200, 2.24, 2.91, 0.07, 6.12, *PROSE[200]),
        Band(400, 2.37, 2.83, 0.06, 6.3, *PROSE[400]),
        Band(800, 2.41, 2.8, 0.06, 6.5, *PROSE[800]),
    ],
    "en": [
        Band(0, 2.07, 3.06, 0.08, 5.45, *PROSE[0]),
        Band(100, 2.2, 2.95, 0.07, 5.89, *PROSE[100]),
        Band(200, 2.23, 2.9, 0.07, 6.26, *PROSE[200]),
        Band(400, 2.36, 2.86, 0.07, 6.49, *PROSE[400]),
        Band(800, 2.44, 2.81, 0.06, 6.63, *PROSE[800]),
    ],
    "es": [
        Band(0, 1.93, 2.67, 0.07, 5.37, *PROSE[0]),
        Band(100, 1.99, 2.67, 0.07, 5.84, *PROSE[100]),
        Band(200, 2.07, 2.67, 0.07, 6.15, *PROSE[200]),
        Band(400, 2.1, 2.52, 0.06, 6.39, *PROSE[400]),
        Band(800, 2.15, 2.5, 0.06, 6.51, *PROSE[800]),
    ],
    "fr": [
        Band(0, 1.99, 2.73, 0.07, 5.52, *PROSE[0]),
        Band(100, 2.01, 2.69, 0.07, 5.89, *PROSE[100]),
        Band(200, 2.11, 2.69, 0.07, 6.08, *PROSE[200]),
        Band(400, 2.18, 2.58, 0.06, 6.3, *PROSE[400]),
        Band(800, 2.19, 2.54, 0.06, 6.45, *PROSE[800]),
    ],
    "latin": [Band(0, 1.3, 6.0, 0.15, 4.0)],
    "cyrillic": [Band(0, 1.0, 5.0, 0.15, 4.0)],
    "cjk": [Band(0, 0.3, 3.0, 0.75, 3.5)],
    "other": [Band(0, 0.2, 6.0, 1.0, 3.0)],
}
_SCRIPTS = (("latin", re.compile(r"[A-Za-zÀ-ɏ]")), ("cyrillic", re.compile(r"[Ѐ-ԯ]")), ("cjk", re.compile(r"[぀-ヿ㐀-鿿가-힯]")))
_SPACE = " \t\n\v\f\r"
_SYMBOLS = "#*$%&|<>"
#: A run of separators with what follows up to the next: no piece of the vocabulary crosses its start.
_PARTS = re.compile("[ ▁]+[^ ▁]*|[^ ▁]+")
_MOST_KEPT = 200_000


def script_of(text: str) -> str:
    """The commonest of the known scripts in the text."""
    n, name = max((len(p.findall(text)), s) for s, p in _SCRIPTS)
    return name if n * 2 > sum(map(str.isalpha, text)) else "other"


def word_rules(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode("utf-8", "surrogatepass").split()  # splits bytes at ASCII white space only
    chars = len(text) - sum(map(text.count, _SPACE))
    symbols = sum(map(text.count, _SYMBOLS))
    dup, seen = 0, set()
    for line in text.split("\n"):
        if line.strip(_SPACE):
            dup += line in seen
            seen.add(line)
    repeat = 0
    if len(words) >= 4:
        numbers: dict[bytes, int] = {}
        ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=len(words))
        pairs = np.unique(ids[:-1] * len(numbers) + ids[1:], return_inverse=True)[1]
        _, which, count = np.unique(pairs[:-1] * len(numbers) + ids[2:], return_inverse=True, return_counts=True)
        again = count[which] > 1
        covered = np.zeros(len(ids), dtype=bool)
        for k in range(3):
            covered[k : len(again) + k] |= again
        repeat = int(covered.sum())
    return len(words), chars, symbols, dup, repeat


class Fertility:
    """Counts of a text's tokens; each distinct part between separators is encoded once and kept, up to a bound."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = self.model.get_piece_size()
        self.is_byte = np.array([self.model.is_byte(i) for i in range(n)])
        mark = "▁"
        if any(mark in self.model.id_to_piece(i).lstrip(mark) for i in range(n)):
            raise ValueError("a piece crosses a word's start: texts can't be encoded in parts")
        self.kept: dict[str, list[int]] = {}

    def tokens(self, text: str) -> np.ndarray:
        """The ids of the whole text, as the library gives them."""
        if not text:
            return np.zeros(0, dtype=np.int64)
        parts = _PARTS.findall(" " + text)
        missing = [p for p in set(parts) if p not in self.kept]
        if len(self.kept) + len(missing) > _MOST_KEPT:
            self.kept.clear()
            missing = list(set(parts))
        if missing:  # the library puts a separator before each
            self.kept.update(zip(missing, self.model.encode([p[1:] for p in missing], num_threads=1), strict=True))
            self.kept.update({p: [self.model.piece_to_id("▁")] for p in missing if len(p) == 1 and p in " ▁"})  # but not before nothing
        return np.fromiter(itertools.chain.from_iterable(map(self.kept.__getitem__, parts)), dtype=np.int64)

    def measure(self, text: str) -> tuple[int, float, float, float]:
        """n_tokens, characters per token, byte share, entropy in bits."""
        ids = self.tokens(text)
        if not len(ids):
            return 0, 0.0, 0.0, 0.0
        _, count = np.unique(ids, return_counts=True)
        share = count / len(ids)
        return len(ids), len(text) / len(ids), float(self.is_byte[ids].mean()), float(-(share * np.log2(share)).sum())


def within(band: list[Band], n_words: int, chars: float, byte_share: float, entropy: float) -> bool:
    step = [b for b in band if b.min_words <= n_words][-1]
    if step.most_chars < chars <= step.prose_chars:
        return byte_share <= step.most_byte_share and entropy >= step.prose_entropy
    return step.least_chars <= chars <= step.most_chars and byte_share <= step.most_byte_share and entropy >= step.least_entropy


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, byte_share double, token_entropy double, band string, base_failed boolean, kept boolean"
_ARROW = pa.struct([(n, {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}[t]) for n, t in (x.split() for x in MEASURES.split(", "))])


def with_quality(docs: DataFrame, out: str = "quality", text_col: str = "text", lang_col: str | None = "lang", model_path: str | None = None, bands: dict[str, list[Band]] = BANDS, min_words: int = 50, most_repeated: float = 0.5) -> DataFrame:
    """Add the struct ``out`` of ``MEASURES`` to each row; other columns stay, whatever their names.

    ``base_failed``: fewer than ``min_words`` words, or over ``most_repeated`` of the words stand in a
    three-word window that the text has twice.  ``kept``: neither that nor outside the band of the
    language; where that is null, unknown or no such column, of the text's script.  A null or empty
    text has no words, counts zero, and isn't kept.  Rows are judged apart, so repeated rows agree;
    an empty table stays empty.
    """
    model = broadcast_file(docs.sparkSession, model_path or default_path("piece_bpe_32k.model"))

    def judge(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        fertility = once_per_worker(("fertility", hash(model.value)), lambda: Fertility(model.value))
        for texts, langs in batches:
            rows = []
            for text, lang in zip(texts.to_pylist(), langs.to_pylist(), strict=True):
                text = text or ""
                n_words, chars, symbols, dup, repeat = word_rules(text)
                n_tokens, per_token, byte_share, entropy = fertility.measure(text)
                failed = n_words < min_words or repeat > most_repeated * n_words
                band = lang if lang in bands else script_of(text)
                kept = not failed and within(bands[band], n_words, per_token, byte_share, entropy)
                rows.append((n_words, chars, symbols, dup, repeat, n_tokens, per_token, byte_share, entropy, band, failed, kept))
            columns = zip(*rows, strict=True) if rows else [[] for _ in _ARROW]
            yield pa.StructArray.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _ARROW, strict=True)], fields=list(_ARROW))

    # Not deterministic to Spark: it must not run again for a filter on its result.
    udf = F.arrow_udf(judge, returnType=MEASURES).asNondeterministic()
    lang = F.col(quoted(lang_col)).cast("string") if lang_col and lang_col.lower() in [c.lower() for c in docs.columns] else F.lit(None).cast("string")
    return docs.withColumn(out, udf(F.col(quoted(text_col)).cast("string"), lang))


def quality_filter(docs: DataFrame, **parameters) -> DataFrame:
    """The rows that the rules keep, with their columns as they were."""
    out = own_names(docs)("quality")
    judged = with_quality(docs, out=out, **parameters)
    return judged.where(f"{out}.kept").select(*[F.col(quoted(c)) for c in docs.columns])
