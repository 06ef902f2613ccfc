"""Public tokenizer files as broadcast bytes, and what executors build of them once for each worker.

A file is read on the driver (its path is a parameter) and broadcast: at most a few MB, whatever the
input.  Executors need no file of their own.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable

from pyspark.sql import SparkSession


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def broadcast_file(spark: SparkSession, path: str, most: int = 64 << 20):
    """Broadcast a vocabulary file; one over ``most`` bytes is refused."""
    with open(path, "rb") as f:
        data = f.read(most + 1)
    if len(data) > most:
        raise ValueError(f"{path} is no vocabulary file: over {most} bytes")
    return spark.sparkContext.broadcast(data)


def once_per_worker(key: tuple, make: Callable):
    """``make()``, kept in this Python worker under ``key`` so that its next tasks find it made.

    One thing is kept at a time: a worker serves several stages, and what one has learnt would stay in its
    memory while another runs.
    """
    kept = sys.modules.setdefault("_tidemark_kept", types.ModuleType("_tidemark_kept"))
    if getattr(kept, "key", None) != key:
        kept.key = kept.made = None
        kept.key, kept.made = key, make()
    return kept.made
