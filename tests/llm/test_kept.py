"""What the tokenisers keep of stretches they have seen, and that it changes no id."""

import random
import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from tidemark.llm import bpe, tokenstore
from tidemark.llm.vocabularies import default_path, default_pattern

R = random.Random(9)


def read(name):
    return Path(default_path(name)).read_bytes()


def test_bpe_keeps_stretches_that_come_again(monkeypatch):
    """Words of every text are learnt once, however often new ones fill what is kept."""
    monkeypatch.setattr(bpe, "_STRETCHES", 200)
    monkeypatch.setattr(bpe, "_ROWS", 50)
    coder, learnt = bpe.ByteBpe(read("byte_bpe_50k.tiktoken"), default_pattern()), []
    before = coder._learn
    monkeypatch.setattr(coder, "_learn", lambda stretches: learnt.extend(stretches) or before(stretches))
    often = [f"every{k}" for k in range(20)]
    texts = [" ".join([*often, *(f"n{R.randrange(10**9)}" for _ in range(30))]) for _ in range(40)]
    ids = coder.encode(texts)
    assert coder.decode(ids) == [t.encode() for t in texts]
    assert all(learnt.count(f" {w}") == 1 for w in often[1:])


def test_token_files_encode_stretches_together(monkeypatch):
    """Short stretches go to the library many at a time, and ids are those of whole texts, marks among them or not."""
    encoder, calls = tokenstore.Encoder(read("word_bpe_49k.json")), []

    class Counted:
        def encode_batch_fast(self, texts, **rest):
            calls.append(len(texts))
            return model.encode_batch_fast(texts, **rest)

    model, encoder.model = encoder.model, Counted()
    pool = ["'s", "'", "|", "||", "<|endoftext|>", "é", "é", "̸", "İ", " ", "中", "1", ".", ",", "\t", "\n", " ", "x" * 70, "\0", "word", "Other"]
    texts = ["".join(R.choice(pool) for _ in range(R.randrange(40))) for _ in range(2000)]
    texts += [" ".join(f"w{R.randrange(10**6)}" for _ in range(50)) for _ in range(200)]
    plain = [e.ids for e in model.encode_batch_fast(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == plain
    calls.clear()
    encoder.encode([" ".join(f"v{k}" for k in range(6400))])
    assert sum(calls) <= 101
