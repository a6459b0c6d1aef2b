"""Token ids in seekable zstandard files: writer and readers.

A file holds whole documents in ascending id order:

* independent zstandard frames, each the ids (little-endian, 2 or 4 bytes) of
  consecutive whole documents;
* one skippable frame with the document table: a JSON head, then per document
  its id, frame, first id within the frame and number of ids, compressed;
* last, the seek table of the public seekable format: compressed size, original
  size and checksum (low 32 bits of XXH64) of every frame, in a skippable frame.

A reader finds a document in the table and decompresses its frame alone.
"""

from __future__ import annotations

import json
import os
import re
import struct
import sys
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from articlelab.llm.common import materialize

# Fixed values of the seekable format.
SKIPPABLE_TABLE, SKIPPABLE_SEEK, SEEK_MAGIC = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
CHECKSUM_FLAG = 0x80

#: Ids after which a frame is closed.
FRAME_IDS = 1 << 16
END_ID = 2
TOKENIZER = "word_bpe_49k.json"


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path(TOKENIZER)


class CachedTokenizer:
    """Ids of whole texts, word by word through a bounded cache.

    The vocabulary's splitting never joins characters across white space, nor a
    letter with ASCII punctuation after it, so a text's ids are those of its
    words one after another. The tokenizer composes a word, then lower-cases it.
    Most words are treated alike here first; one that holds a mark (or the letter
    whose lower case has one, or a character unknown to Python) goes to the
    tokenizer as it was read: what a change of case leaves must not be composed
    again, and the two may order marks differently. Texts that hold a special
    token's first characters or separators that Python and the tokenizer see
    differently are encoded whole by the tokenizer."""

    WHOLE = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")
    TAIL = ".,!?;:|%$&*#"
    #: Latin letters and signs before the International Phonetic Alphabet: no marks, no
    #: soft hyphen, and not the letter whose lower case holds a mark.
    LATIN = re.compile("[!-~\u00a1-\u00ac\u00ae-\u012f\u0131-\u024f]*")

    def __init__(self, path: str, cache_words: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.cache = _Filled(self._word)
        self.read = _Filled(self._as_read)
        self.limit = cache_words
        self.to_marks = _byte_marks()

    def pack(self, ids: list[int]) -> bytes:
        packed = array("H" if self.dtype.itemsize == 2 else "I", ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of a word: of what stands before trailing punctuation, and of that. Plain
        Latin letters are one piece, which the model itself can take in its byte alphabet."""
        core = word.rstrip(self.TAIL)
        if len(core) < len(word) and core and core[-1].isalnum():
            got = self.cache[core] + self.cache[word[len(core):]]
        elif word.isalpha() and (word.isascii() or self.LATIN.fullmatch(word)):
            marks = word if word.isascii() else word.encode().decode("latin-1").translate(self.to_marks)
            got = self.pack([t.id for t in self.tokenizer.model.tokenize(marks)])
        else:
            got = self.pack(self.tokenizer.encode(word, add_special_tokens=False).ids)
        if len(self.cache) >= 2 * self.limit:       # words, and what stands before their punctuation
            self.cache.clear()
        return got

    def _as_read(self, word: str) -> bytes:
        """Ids of a word before any change of form or case."""
        if word.isascii():
            got = self.cache[word.lower()]
        elif not self.LATIN.fullmatch(word) and any(c == "İ" or unicodedata.category(c)[0] in "MC" for c in word):
            got = self.pack(self.tokenizer.encode(word, add_special_tokens=False).ids)
        else:
            got = self.cache[unicodedata.normalize("NFC", word).replace("Σ", "σ").lower()]
        if len(self.read) >= self.limit:
            self.read.clear()
        return got

    def encode(self, text: str) -> bytes:
        """Packed ids of a whole text."""
        if any(w in text for w in self.WHOLE):
            return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if text.isascii():
            return b"".join(map(self.cache.__getitem__, text.lower().split()))
        return b"".join(map(self.read.__getitem__, text.split()))


class _Filled(dict):
    """A dictionary that computes and keeps what it lacks."""

    def __init__(self, compute):
        super().__init__()
        self.compute = compute

    def __missing__(self, key):
        self[key] = got = self.compute(key)
        return got


def _byte_marks() -> dict[int, int]:
    """The byte alphabet: printable bytes stand for themselves, the others for 256, 257, ..."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}


_TOKENIZERS: dict[str, CachedTokenizer] = {}


def tokenizer_at(path: str) -> CachedTokenizer:
    """One per process and file."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = CachedTokenizer(path)
    return _TOKENIZERS[path]


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI (or of an absolute path)."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    if "://" in uri:
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri


class FrameWriter:
    """Appends documents to one file object; ``close`` writes the two tables."""

    def __init__(self, sink, width: int, frame_ids: int = FRAME_IDS, level: int = 3):
        self.sink, self.width, self.frame_bytes = sink, width, frame_ids * width
        self.compressor = zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, int, int]] = []  # frame, first, count
        self.names: list[int | None] = []
        self.buffer, self.filled, self.total = [], 0, 0

    def add(self, name: int | None, packed: bytes) -> None:
        self.names.append(name)
        self.docs.append((len(self.frames), self.filled // self.width, len(packed) // self.width))
        self.buffer.append(packed)
        self.filled += len(packed)
        self.total += len(packed) // self.width
        if self.filled >= self.frame_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.buffer:
            raw = b"".join(self.buffer)
            body = self.compressor.compress(raw)
            self.sink.write(body)
            self.frames.append((len(body), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.buffer, self.filled = [], 0

    def close(self) -> None:
        self._flush()
        head = json.dumps({"width": self.width, "docs": len(self.names), "nulls": [i for i, n in enumerate(self.names) if n is None]}).encode()
        names = np.array([0 if n is None else n for n in self.names], "<i8").tobytes()
        places = np.array(self.docs, "<u4").reshape(-1, 3).tobytes()
        table = struct.pack("<I", len(head)) + head + self.compressor.compress(names + places)
        self.sink.write(struct.pack("<II", SKIPPABLE_TABLE, len(table)) + table)
        self.frames.append((len(table) + 8, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        entries = b"".join(struct.pack("<III", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), CHECKSUM_FLAG, SEEK_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_SEEK, len(entries) + len(footer)) + entries + footer)


class FrameReader:
    """Random access to one file: tables first, then only the frames asked for."""

    def __init__(self, uri: str):
        fs, path = open_store(uri)
        self.file, self.uri = fs.open_input_file(path), uri
        size = self.file.size()
        count, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEK_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError(f"{uri}: no seek table with checksums")
        start = size - 9 - 12 * count
        self.frames = list(struct.iter_unpack("<III", self.file.read_at(12 * count, start)))
        self.offsets = [0, *np.cumsum([f[0] for f in self.frames]).tolist()]
        table = self.file.read_at(self.frames[-1][0], self.offsets[-2])[8:]
        (head_size,) = struct.unpack_from("<I", table)
        head = json.loads(table[4:4 + head_size])
        self.dtype = np.dtype(f"<u{head['width']}")
        rest = zstandard.ZstdDecompressor().decompress(table[4 + head_size:]) if head["docs"] else b""
        n = head["docs"]
        names = np.frombuffer(rest[:8 * n], "<i8").tolist()
        for i in head["nulls"]:
            names[i] = None
        self.names, self.places = names, np.frombuffer(rest[8 * n:], "<u4").reshape(-1, 3)

    def frame(self, k: int) -> np.ndarray:
        packed, size, check = self.frames[k]
        raw = zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, self.offsets[k]), max_output_size=max(1, size))
        if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"{self.uri}: frame {k} is damaged")
        return np.frombuffer(raw, self.dtype)

    def documents(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(id, ids of the file before it, its ids), in file order; ``wanted``: only these documents' frames are read."""
        starts = np.concatenate([[0], np.cumsum(self.places[:, 2], dtype=np.int64)])
        pick = None if wanted is None else set(wanted)
        at, ids = -1, None
        for i, (name, (k, first, count)) in enumerate(zip(self.names, self.places.tolist(), strict=True)):
            if pick is not None and name not in pick:
                continue
            if k != at:
                at, ids = k, self.frame(k)
            yield name, int(starts[i]), ids[first:first + count]


def write_token_files(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text",
                      tokenizer: str | None = None, end_id: int | None = END_ID, frame_ids: int = FRAME_IDS) -> DataFrame:
    """Encode every whole text, append ``end_id``, write files in ascending id
    order under ``folder``; returns the written list ``part, file, n_docs, n_ids``.

    The texts are range-partitioned by id and sorted, then each partition is
    tokenised and written as one file: one shuffle, a frame in memory at a
    time. A file is written under another name and moved when whole, so a task
    that runs again replaces it by the same bytes. Null text counts as empty (its end id
    alone), null ids come first, equal ids follow one another; an empty table
    writes no file."""
    path = tokenizer or default_tokenizer()
    folder = folder.rstrip("/")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    rows = rows.repartitionByRange("id", F.xxhash64("t")).sortWithinPartitions("id", F.xxhash64("t"))

    def write(batches):
        words = tokenizer_at(path)
        end = words.pack([end_id]) if end_id is not None else b""
        part = TaskContext.get().partitionId()
        name = f"{folder}/part-{part:07d}.ids.zst"
        fs, target = open_store(name)
        draft = f"{target}.{uuid.uuid4().hex}.draft"
        sink = out = None
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if out is None:
                    fs.create_dir(os.path.dirname(target), recursive=True)
                    sink = fs.open_output_stream(draft)
                    out = FrameWriter(sink, words.dtype.itemsize, frame_ids)
                out.add(doc, words.encode(text) + end)
        if out is not None:
            out.close()
            sink.close()
            fs.move(draft, target)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [name],
                                              "n_docs": pa.array([len(out.names)], pa.int64()),
                                              "n_ids": pa.array([out.total], pa.int64())})

    return materialize(rows.mapInArrow(write, "part int, file string, n_docs long, n_ids long"), "token-files")


def read_token_files(written: DataFrame, with_ids: bool = False) -> DataFrame:
    """Every document of the files in ``written``: ``doc_id, start, n_tokens,
    ids_crc32`` (and ``ids``). ``start``: ids of all documents before it, from a
    running sum over one row per file and the document table within a file."""
    spark: SparkSession = written.sparkSession
    base = written.select("file", (F.sum("n_ids").over(Window.orderBy("part")) - F.col("n_ids")).alias("base"))
    n = max(1, base.count())
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def read(batches):
        for batch in batches:
            for file, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [[] for _ in range(5 if with_ids else 4)]
                for doc, start, ids in FrameReader(file).documents():
                    values = (doc, before + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), ids.astype(np.int32))
                    for column, value in zip(rows, values, strict=False):
                        column.append(value)
                    if len(rows[0]) >= 5000:
                        yield _batch(rows)
                        rows = [[] for _ in rows]
                yield _batch(rows)

    def _batch(rows):
        types = [pa.int64()] * 4 + [pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, types, strict=False)],
                                          names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][:len(rows)])

    parts = min(n, max(1, 4 * spark.sparkContext.defaultParallelism))
    return base.repartition(parts).mapInArrow(read, schema)
