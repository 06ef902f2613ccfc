"""Token ids in binary files: independent zstandard frames, a seek table behind them, a checksum each.

A file holds the ids of consecutive documents as little-endian integers, each document in a frame of its
own, or in several of at most ``FRAME_IDS`` ids; then frames that name the documents, ``INDEX_DOCS`` each; then
one that says where those are; then a seek table in zstandard's public seekable format: a skippable frame
with each frame's compressed size, its size, and the low half of the XXH64 of its content.  Any zstandard
reader can read the whole file; ours reads the table, the names and the frames of the documents asked
for, and decompresses no other document.  Files are cut by bytes, so what a writer or a reader holds of
one, its table and names, is bounded whatever the input.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm.shared import fresh_path, quoted, staged
from tidemark.llm.vocabularies import broadcast_file, default_path, once_per_worker

# Fixed values of the public seekable format.
SKIPPABLE, SEEKABLE, HAS_CHECKSUM = 0x184D2A5E, 0x8F92EAB1, 0x80
FRAME_IDS, INDEX_DOCS = 1 << 16, 1 << 16
#: Bytes of text of a file at most, on average, and what a document costs besides; files are at least so small
#: that all tasks have some, down to ``_LEAST_FILE``.
FILE_BYTES, _ROW_BYTES, _LEAST_FILE = 128 << 20, 64, 4 << 20
_KEPT, _SLICE = 700_000, 20_000
#: Stretches of at most so many characters are encoded so many at once, between marks that none of them holds; a
#: blank on either side keeps the mark's id apart from theirs.
_SHORT, _TOGETHER, _MARK = 64, 64, "|"
#: A full stop or comma before a blank is a match of its own, unless more punctuation stands before it.
_MORE = re.compile(r"[^A-Za-z0-9À-ÖØ-öø-ÿ][.,][ \n]")


def _stretches(text: str) -> list[str]:
    if not _MORE.search(text):
        text = text.replace(", ", " , ").replace(". ", " . ").replace(",\n", " , ").replace(".\n", " . ")
    return text.replace("\n", " ").split(" ")


class Encoder:
    """Ids of whole texts; each distinct stretch between blanks is encoded once and kept, up to a bound.

    The usual vocabulary drops white space and no match of its pattern crosses it or the end of a word before
    punctuation, so that changes nothing.  Others (``in_stretches`` false) encode whole texts.
    """

    def __init__(self, vocabulary: bytes, in_stretches: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(vocabulary.decode())
        self.size, self.in_stretches = self.model.get_vocab_size(), in_stretches
        self.kept, self.aged = {}, {}  # stretches' ids, and those of the generation before
        self.mark = self.model.encode(_MARK, add_special_tokens=False).ids

    def _learn(self, stretches: list[str]) -> None:
        """Keep the ids of stretches without white space between their words."""
        short = [s for s in stretches if len(s) <= _SHORT and _MARK not in s] if len(self.mark) == 1 else []
        groups = [short[i : i + _TOGETHER] for i in range(0, len(short), _TOGETHER)]
        left = [s for s in stretches if len(s) > _SHORT or _MARK in s] if len(self.mark) == 1 else list(stretches)
        for group, e in zip(groups, self.model.encode_batch_fast([f" {_MARK} ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype="<u4")
            at = np.flatnonzero(ids == self.mark[0])
            if len(at) != len(group) - 1:  # a character that stands for the mark
                left += group
                continue
            data = ids.tobytes()
            self.kept.update(zip(group, [data[4 * i : 4 * j] for i, j in zip([0, *(at + 1).tolist()], [*at.tolist(), len(ids)], strict=True)], strict=True))
        for s, e in zip(left, self.model.encode_batch_fast(left, add_special_tokens=False), strict=True):
            self.kept[s] = np.array(e.ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers, a sequence for each text."""
        if not self.in_stretches:
            return [np.array(e.ids, dtype="<u4").tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]
        out = []
        for k in range(0, len(texts), 500):
            cut = [_stretches(t) for t in texts[k : k + 500]]
            missing = {s for own in cut for s in own if s not in self.kept}
            if len(self.kept) + len(missing) > _KEPT // 2:
                self.aged, self.kept = self.kept, {}
                missing = {s for own in cut for s in own}
            for s in missing.intersection(self.aged):
                self.kept[s] = self.aged[s]
            missing = list(missing.difference(self.aged))
            for i in range(0, len(missing), _SLICE):
                self._learn(missing[i : i + _SLICE])
            out += [b"".join(map(self.kept.__getitem__, own)) for own in cut]
        return out


class Writer:
    """Writes one file: first under another name, then, whole, under its own."""

    def __init__(self, folder: str, name: str, width: int, level: int = 3, frame_ids: int = FRAME_IDS, index_docs: int = INDEX_DOCS):
        self.fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        self.fs.create_dir(root, recursive=True)
        self.path, self.passing = f"{root}/{name}", f"{root}/.{name}-{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.passing)
        self.zip = zstandard.ZstdCompressor(level=level)
        self.type, self.frame_ids, self.index_docs = np.dtype(f"<u{width}"), frame_ids, index_docs
        self.table: list[tuple[int, int, int]] = []
        self.docs, self.sizes = [], []

    def _frame(self, content: bytes) -> None:
        packed = self.zip.compress(content)
        self.out.write(packed)
        self.table.append((len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        """A document without ids has no frame."""
        if len(ids) and int(ids.max()) > np.iinfo(self.type).max:
            raise ValueError(f"id {int(ids.max())} doesn't fit {self.type.itemsize} bytes")
        self.docs.append(doc_id)
        self.sizes.append(len(ids))
        data = ids.astype(self.type)
        for i in range(0, len(data), self.frame_ids):
            self._frame(data[i : i + self.frame_ids].tobytes())

    def close(self) -> tuple[str, int, int]:
        """Path, documents, ids."""
        first, entries = len(self.table), []
        for i in range(0, len(self.docs), self.index_docs):
            own, sizes = self.docs[i : i + self.index_docs], np.array(self.sizes[i : i + self.index_docs], dtype="<i8")
            known = np.array([d is not None for d in own], dtype=np.uint8)
            ids = np.array([d or 0 for d in own], dtype="<i8")
            least, most = (int(ids[known > 0].min()), int(ids[known > 0].max())) if known.any() else (0, -1)
            entries.append((len(own), int(sizes.sum()), int(-(-sizes // self.frame_ids).sum()), least, most))
            self._frame(ids.tobytes() + sizes.tobytes() + known.tobytes())
        self._frame(struct.pack("<QQIB", first, len(entries), self.frame_ids, self.type.itemsize) + b"".join(struct.pack("<QQQqq", *e) for e in entries))
        table = b"".join(struct.pack("<III", *x) for x in self.table)
        if len(table) + 9 >= 1 << 32:
            raise ValueError("too many frames for a file: write smaller ones")
        self.out.write(struct.pack("<II", SKIPPABLE, len(table) + 9) + table + struct.pack("<IBI", len(self.table), HAS_CHECKSUM, SEEKABLE))
        self.out.close()
        self.fs.move(self.passing, self.path)
        return self.path, len(self.docs), sum(self.sizes)


class Reader:
    """Random access to one file; raises ``ValueError`` if a frame isn't what its checksum says.

    Of the frames with names only those are read that may hold an id asked for, or all to go through the file.
    """

    def __init__(self, folder: str, name: str):
        self.fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        self.file = self.fs.open_input_file(f"{root}/{name}")
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE or flags != HAS_CHECKSUM:
            raise ValueError("no seek table")
        self.table = np.frombuffer(self._at(size - 9 - 12 * n, 12 * n), dtype="<u4").reshape(n, 3)
        self.begins = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])
        self.unzip = zstandard.ZstdDecompressor()
        self.read_frames = 0
        head = self.frame(n - 1)
        self.first_index, parts, self.frame_ids, width = struct.unpack("<QQIB", head[:21])
        self.type = np.dtype(f"<u{width}")
        self.parts = np.frombuffer(head, "<i8", 5 * parts, 21).reshape(parts, 5)  # documents, ids, frames, least and largest id

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def frame(self, k: int) -> bytes:
        packed, size, check = map(int, self.table[k])
        content = self.unzip.decompress(self._at(int(self.begins[k]), packed), max_output_size=size)
        self.read_frames += 1
        if len(content) != size or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return content

    def documents(self, only: list[int] | None = None) -> Iterator[tuple[int | None, int, int, int]]:
        """(doc_id, start, n_ids, first frame) of every document, or of those of some ids, in the file's order."""
        wanted = None if only is None else np.array(sorted(set(only)), dtype=np.int64)
        start, frame = 0, 0
        for k, (count, ids, frames, least, most) in enumerate(self.parts.tolist()):
            if wanted is None or ((wanted >= least) & (wanted <= most)).any():
                names = self.frame(self.first_index + k)
                docs, sizes = np.frombuffer(names, "<i8", count), np.frombuffer(names, "<i8", count, 8 * count)
                known = np.frombuffer(names, "u1", count, 16 * count).astype(bool)
                each = -(-sizes // self.frame_ids)
                starts, first = start + np.cumsum(sizes) - sizes, frame + np.cumsum(each) - each
                for i in range(count) if wanted is None else np.flatnonzero(known & np.isin(docs, wanted)).tolist():
                    yield int(docs[i]) if known[i] else None, int(starts[i]), int(sizes[i]), int(first[i])
            start, frame = start + ids, frame + frames

    def ids(self, n_ids: int, frame: int) -> np.ndarray:
        """The ids of a document: only its frames are decompressed."""
        parts = [np.frombuffer(self.frame(frame + k), self.type) for k in range(-(-n_ids // self.frame_ids))]
        return np.concatenate(parts) if parts else np.zeros(0, self.type)


def write_tokens(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str | None = None, end_id: int = 2, files: int | None = None) -> DataFrame:
    """Encode every whole text, append ``end_id`` to each, and write the ids in ascending ``id_col`` order.

    Returns the table of files: file (ascending as the ids), n_docs, n_tokens, start (ids in the files
    before it).  ``files`` is their number; by default it follows from the texts' bytes.  Null ids come
    first; rows of one id stand in the order of their texts; a null text is empty; repeated rows stay; an
    empty table gives no files.  A lost task writes its file anew under the same name.
    """
    spark = docs.sparkSession
    path = vocabulary_path or default_path("word_bpe_49k.json")
    vocabulary, usual = broadcast_file(spark, path), vocabulary_path is None or os.path.realpath(path) == os.path.realpath(default_path("word_bpe_49k.json"))
    if not 0 <= end_id < 1 << 32:
        raise ValueError("the end id is an unsigned 32-bit integer")
    slim = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).alias("text"))
    if files is None:
        total = slim.agg(F.sum(F.octet_length("text") + _ROW_BYTES)).first()[0] or 0
        files = max(1, -(-total // FILE_BYTES), min(int(spark.conf.get("spark.sql.shuffle.partitions")), total // _LEAST_FILE))

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = once_per_worker(("words", hash(vocabulary.value), usual), lambda: Encoder(vocabulary.value, usual))
        part, writer, end = TaskContext.get().partitionId(), None, np.array([end_id], dtype="<u4")
        name = f"tokens-{part:06d}.zst"
        for batch in batches:
            given = batch.column(1).to_pylist()
            for k in range(0, len(given), 500):
                for doc_id, ids in zip(batch.column(0).slice(k, 500).to_pylist(), encoder.encode(given[k : k + 500]), strict=True):
                    writer = writer or Writer(folder, name, 2 if max(encoder.size, end_id + 1) <= 1 << 16 else 4)
                    writer.add(doc_id, np.concatenate([np.frombuffer(ids, "<u4"), end]))
        if writer:
            _, n_docs, n_tokens = writer.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [name], "n_docs": [n_docs], "n_tokens": [n_tokens]})

    dealt = slim.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")
    written = staged(dealt.mapInArrow(write, "part long, file string, n_docs long, n_tokens long"), "token-files")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row for each file
    return written.select("part", "file", "n_docs", "n_tokens", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"))


def read_tokens(files: DataFrame, folder: str, only: list[int] | None = None) -> DataFrame:
    """(doc_id, start, ids) from the files of ``write_tokens``; ids as little-endian unsigned 32-bit integers.

    With ``only``, a list of ids, just those documents, from just the frames that hold them and their names.
    """

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader = Reader(folder, name)
                rows, held = [], 0
                for doc_id, start, n_ids, first in reader.documents(only):
                    ids = reader.ids(n_ids, first).astype("<u4").tobytes()
                    rows.append((doc_id, base + start, ids))
                    held += len(ids)
                    if held > 8 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    n = max(1, files.count())
    return files.select("file", "start").repartition(n).mapInArrow(read, "doc_id long, start long, ids binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["doc_id", "start", "ids"])


def token_file_round_trip(docs: DataFrame, folder: str | None = None, **parameters) -> DataFrame:
    """Write the files, read them back, and digest each document: doc_id, start, n_tokens, ids_crc32."""
    folder = folder or fresh_path(docs.sparkSession, "tokens")
    files = staged(write_tokens(docs, folder, **parameters), "file-table")
    back = read_tokens(files, folder)
    return back.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").cast("long").alias("ids_crc32"))
