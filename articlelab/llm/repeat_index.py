"""Repeated byte strings across a corpus, by run-length Burrows-Wheeler indexes.

A corpus-wide index does not fit a task, so it is built in shards that no match
crosses. Every string of ``length`` bytes chooses an anchor, the ``gram``-byte
string in it with the least hash (the rightmost of equals). Equal strings
choose equal anchors at equal places, so all occurrences of a string meet under
its anchor's hash. Neighbouring strings that choose one anchor occurrence form a
piece; a shard is a set of anchors with all their pieces.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from articlelab.llm.common import materialize

LENGTH, GRAM = 200, 64
#: Bytes of text that one index covers; anchors stay whole. Sorting its suffixes
#: takes some 150 times as much memory.
INDEX_BYTES = 1 << 20
#: Different pieces of an anchor that one index takes; more are parted by second anchors.
MOST_PIECES = 2048
#: Anchors of the first and of further rounds: bytes and seed. In the last round a string is its own anchor.
ROUNDS = ((GRAM, 11), (GRAM, 21), (GRAM, 31), (LENGTH, 41))
#: Strings whose anchors are chosen in one go (arrays of this size).
CHUNK = 1 << 17
_POS_BITS = np.uint64(19)
_POS_MASK = np.uint64((1 << 19) - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class GramHash:
    """64-bit hashes of all ``size``-byte strings of a text: differences of
    prefix sums of byte codes times powers of an odd number, modulo 2**64."""

    def __init__(self, size: int, seed: int, most: int):
        rng = np.random.default_rng(seed)
        self.size = size
        self.codes = rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        base = int(rng.integers(1 << 61, 1 << 62)) * 8 + 5
        back = pow(base, -1, 1 << 64)
        self.up, self.down = (self._powers(b, most) for b in (base, back))

    @staticmethod
    def _powers(base: int, most: int) -> np.ndarray:
        out = np.full(most, base % (1 << 64), np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def __call__(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.codes[data] * self.up[:n], out=sums[1:])
        m = n - self.size + 1
        return _mixed((sums[self.size:] - sums[:m]) * self.down[:m])


def _window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, from running minima within blocks."""
    n = len(keys)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    grid = padded.reshape(blocks, width)
    before = np.minimum.accumulate(grid, axis=1).ravel()
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n - width + 1], before[width - 1:n])


class Anchors:
    """Anchors and pieces of a text."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM, seed: int = ROUNDS[0][1]):
        self.length, self.gram = length, min(gram, length)
        self.hash = GramHash(self.gram, seed, CHUNK + length)

    def pieces(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor hash, first string, number of strings) of every piece in order."""
        f_out, at_out, n_out = [], [], []
        width = self.length - self.gram + 1
        for start in range(0, max(0, len(data) - self.length + 1), CHUNK):
            part = data[start:start + CHUNK + self.length - 1]
            h = self.hash(part)
            place = np.arange(len(h), dtype=np.uint64)
            least = _window_minima((h & ~_POS_MASK) | (_POS_MASK - place), width)
            anchor = (_POS_MASK - (least & _POS_MASK)).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
            f_out.append(h[anchor[first]])
            at_out.append(first + start)
            n_out.append(np.diff(np.append(first, len(anchor))))
        if not f_out:
            return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(f_out), np.concatenate(at_out), np.concatenate(n_out)


class RunLengthIndex:
    """Run-length Burrows-Wheeler transform of a set of strings, with samples at run ends.

    Its rows are the suffixes of ``depth`` bytes or more, in order; a row's
    character is the byte before the suffix, or a separator of the string's own.
    A string that occurs several times counts so often in the lengths of its
    runs, it is not laid out again. Kept are run heads, run lengths and, of the
    rows at run ends, text position and match with the row beyond the end, where
    it has ``depth`` bytes. Of a string that occurs more than once the first
    suffix matches its copy in full. Everything else follows: at a row inside a
    run the match is one shorter than at the text position before."""

    def __init__(self, strings: list[bytes], times: list[int] | None = None, depth: int = 1):
        sizes = np.array([len(s) for s in strings], np.int64)
        times = np.ones(len(strings), np.int64) if times is None else np.asarray(times, np.int64)
        self.depth, self.n = depth, int(sizes.sum())
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        joined = b"".join(strings)
        text = np.frombuffer(joined, np.uint8)
        rows = np.maximum(sizes - depth + 1, 0)
        owner = np.repeat(np.arange(len(strings)), rows)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(rows) - rows, rows) + self.starts[owner]
        suffixes = [joined[i:e] for i, e in zip(at.tolist(), self.ends[owner].tolist(), strict=True)]
        order = np.array(sorted(range(len(suffixes)), key=suffixes.__getitem__), np.int64)
        del suffixes
        at, owner = at[order], owner[order]
        transform = np.where(at == self.starts[owner], 256 + owner, text[at - 1]) if len(at) else at
        change = np.flatnonzero(np.concatenate([[True], transform[1:] != transform[:-1]])) if len(at) else at
        self.heads = transform[change]
        self.lengths = np.add.reduceat(times[owner], change) if len(at) else change
        cut = change[1:]  # between two runs: the last row of one and the first of the next
        match = self._common(joined, at[cut - 1], at[cut], self.ends[owner[cut - 1]], self.ends[owner[cut]])
        long = match >= depth
        twice = (times > 1) & (sizes >= depth)
        self.sample_at = np.concatenate([at[cut - 1][long], at[cut][long], self.starts[twice]])
        self.sample_match = np.concatenate([match[long], match[long], sizes[twice]])

    def _common(self, joined: bytes, a: np.ndarray, b: np.ndarray, a_end: np.ndarray, b_end: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes ``a`` and ``b``, which end where
        their strings do; compared eight bytes at a time, those still equal."""
        words = np.lib.stride_tricks.as_strided(np.frombuffer(joined + bytes(8), np.uint8), (len(joined) + 1, 8), (1, 1))
        most = np.minimum(a_end - a, b_end - b)
        out = np.zeros(len(a), np.int64)
        on = np.arange(len(a))
        while len(on):
            equal = words[a[on] + out[on]] == words[b[on] + out[on]]
            all_ = equal.all(axis=1)
            out[on] = np.minimum(out[on] + np.where(all_, 8, equal.argmin(axis=1)), most[on])
            on = on[all_ & (out[on] < most[on])]
        return out

    def matching_statistics(self) -> np.ndarray:
        """For every text position, the longest string from there that also
        starts elsewhere, where that has ``depth`` bytes (else less): streamed
        over the text from the samples."""
        reach = np.zeros(self.n, np.int64)   # how far the match sampled at a position goes
        np.maximum.at(reach, self.sample_at, self.sample_at + self.sample_match)
        return np.maximum(np.maximum.accumulate(reach) - np.arange(self.n), 0)

    def repeats(self) -> list[list[tuple[int, int]]]:
        """Per string, the spans covered by strings of ``depth`` bytes that occur twice."""
        long = self.matching_statistics() >= self.depth
        border = np.zeros(self.n + 1, bool)   # before a string's first byte, after its last
        border[self.starts] = border[self.ends] = True
        begin = np.flatnonzero(long & (border[:-1] | ~np.concatenate([[False], long[:-1]])))
        end = np.flatnonzero(long & (border[1:] | ~np.concatenate([long[1:], [False]]))) + 1
        out: list[list[tuple[int, int]]] = [[] for _ in self.starts]
        owner = np.searchsorted(self.ends, begin, side="right")
        for k, a, b in zip(owner.tolist(), begin.tolist(), end.tolist(), strict=True):
            out[k].append((int(a - self.starts[k]), int(b - 1 + self.depth - self.starts[k])))
        return out


def _anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """``f``: the anchor hash of every piece."""

    def run(batches):
        own = Anchors(length, gram)
        for batch in batches:
            found = [own.pieces(np.frombuffer(text, np.uint8))[0] for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64) if found else [], pa.int64())], names=["f"])

    return docs.select("t").mapInArrow(run, "f long")


def _pieces(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """``f, h, k, c, at, n``: anchor hash, digest of the piece's bytes, document
    (``k, c``), first string and number of strings of every piece."""

    def run(batches):
        own = Anchors(length, gram)
        for batch in batches:
            columns = [[] for _ in range(6)]
            for key, check, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                f, at, n = own.pieces(np.frombuffer(text, np.uint8))
                if len(f):
                    view = memoryview(text)
                    h = np.fromiter((xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(at.tolist(), (at + n + length - 1).tolist(), strict=True)),
                                    np.uint64, len(f))
                    for column, values in zip(columns, (f.view(np.int64), h.view(np.int64), np.full(len(f), key), np.full(len(f), check), at, n), strict=True):
                        column.append(values)
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=["f", "h", "k", "c", "at", "n"])

    return docs.select("k", "c", "t").mapInArrow(run, "f long, h long, k long, c long, at long, n long").select(
        "f", "h", "k", F.col("c").cast("int").alias("c"), F.col("at").cast("int").alias("at"), F.col("n").cast("int").alias("n"))


def _cut(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """``f, h, times, hot, piece``: the bytes of the wanted pieces (``k, c, list``)."""

    def run(batches):
        for batch in batches:
            rows = [(p["f"], p["h"], p["times"], p["hot"], text[p["at"]:p["at"] + p["n"] + length - 1])
                    for text, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for p in places]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(
                (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()))], names=["f", "h", "times", "hot", "piece"])

    return docs.join(wanted, ["k", "c"]).select("t", "list").mapInArrow(run, "f long, h long, times long, hot boolean, piece binary")


SPANS = "array<struct<a:int,b:int>>"
_SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _spans_array(spans: list) -> pa.Array:
    return pa.array([[{"a": a, "b": b} for a, b in s] for s in spans], _SPANS)


def _indexed(pieces: DataFrame, length: int, index_bytes: int) -> DataFrame:
    """``f, h, spans`` of pieces that share strings with other pieces of their
    anchor, with copies of themselves or within themselves: partitions by anchor,
    one index of whole anchors after another."""

    def flush(rows):
        spans = RunLengthIndex([r[3] for r in rows], [r[2] for r in rows], length).repeats()
        keep = [i for i, s in enumerate(spans) if s]
        return pa.RecordBatch.from_arrays(
            [pa.array([rows[i][0] for i in keep], pa.int64()), pa.array([rows[i][1] for i in keep], pa.int64()), _spans_array([spans[i] for i in keep])],
            names=["f", "h", "spans"])

    def run(batches):
        rows, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if row[0] != last and size >= index_bytes:
                    yield flush(rows)
                    rows, size = [], 0
                rows.append(row)
                size, last = size + len(row[3]), row[0]
        if rows:
            yield flush(rows)

    return pieces.select("f", "h", "times", "piece").repartition("f").sortWithinPartitions("f").mapInArrow(run, f"f long, h long, spans {SPANS}")


def _parted(pieces: DataFrame, length: int, gram: int, seed: int) -> DataFrame:
    """Pieces of anchors with very many of them, cut again by second anchors:
    ``f, h`` (of the cut piece; ``f`` from both anchors), ``of_f, of_h, at, times, piece``.
    Equal strings choose equal second anchors too."""

    def run(batches):
        own = Anchors(length, gram, seed)
        for batch in batches:
            f, h, of_f, of_h, at, times, piece = ([] for _ in range(7))
            for pf, ph, n_times, data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                g, first, n = own.pieces(np.frombuffer(data, np.uint8))
                f += _mixed(g * np.uint64(3) + np.int64(pf).view(np.uint64)).view(np.int64).tolist()
                cuts = [data[a:a + m + length - 1] for a, m in zip(first.tolist(), n.tolist(), strict=True)]
                h += [xxhash.xxh3_64_intdigest(c) - (1 << 63) for c in cuts]
                of_f += [pf] * len(cuts)
                of_h += [ph] * len(cuts)
                at += first.tolist()
                times += [n_times] * len(cuts)
                piece += cuts
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in (f, h, of_f, of_h, at, times)), pa.array(piece, pa.binary())],
                                             names=["f", "h", "of_f", "of_h", "at", "times", "piece"])

    return pieces.select("f", "h", "times", "piece").mapInArrow(run, "f long, h long, of_f long, of_h long, at long, times long, piece binary")


def _marks(pieces: DataFrame, length: int, index_bytes: int, most: int, rounds) -> DataFrame:
    """``f, h, spans`` of ``pieces`` (f, h, times, hot, piece): those of an anchor go
    to one index, or, of an anchor with more than ``most``, to the indexes of
    the second anchors, whose spans come back."""
    done = _indexed(pieces.filter("not hot"), length, index_bytes)
    hot = pieces.filter("hot")
    if not rounds or hot.isEmpty():
        return done
    cut = materialize(_parted(hot, length, *rounds[0]), "repeat-parted")
    classes = cut.groupBy("f", "h").agg(F.sum("times").alias("times"), F.min_by(F.struct("of_f", "of_h", "at"), F.struct("of_f", "of_h", "at")).alias("one"))
    sizes = classes.groupBy("f").agg(F.count(F.lit(1)).alias("_n"), F.sum("times").alias("_t")).filter("_t > 1")
    last = len(rounds) == 1
    wanted = materialize(classes.join(sizes.withColumnRenamed("f", "_f"), F.col("f") == F.col("_f")).select(
        F.col("f").alias("_f"), F.col("h").alias("_h"), F.col("times").alias("_times"), "one", (F.lit(not last) & (F.col("_n") > most)).alias("hot")), "repeat-classes")
    one = (F.col("f") == F.col("_f")) & (F.col("h") == F.col("_h")) & (F.struct("of_f", "of_h", "at") == F.col("one"))
    inner = materialize(cut.join(wanted, one).select("f", "h", F.col("_times").alias("times"), "hot", "piece"), "repeat-cuts")
    marks = _marks(inner, length, index_bytes, most, rounds[1:]).select(F.col("f").alias("_f"), F.col("h").alias("_h"), "spans")
    back = cut.select("f", "h", "of_f", "of_h", "at").join(marks, (F.col("f") == F.col("_f")) & (F.col("h") == F.col("_h")))
    moved = F.transform("spans", lambda s: F.struct((s["a"] + F.col("at")).cast("int").alias("a"), (s["b"] + F.col("at")).cast("int").alias("b")))
    return done.unionByName(back.groupBy(F.col("of_f").alias("f"), F.col("of_h").alias("h")).agg(F.flatten(F.collect_list(moved)).alias("spans")))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM,
                   index_bytes: int = INDEX_BYTES, most_pieces: int = MOST_PIECES) -> DataFrame:
    """One row per document row: ``doc_id, n_bytes, starts, ends`` (maximal spans
    of bytes covered by a ``length``-byte string that also starts elsewhere,
    same document included) and ``kept_sha256`` of the remaining bytes.

    1. Pieces whose anchor occurs once are dropped (partial counts, then a
       join that can split a hot anchor).
    2. Equal pieces fold into one with its multiplicity.
    3. Pieces go to run-length indexes, all of an anchor to one; matching
       statistics mark the shared strings. Anchors with over ``most_pieces``
       different pieces are parted by second and third anchors first, at last
       by the strings themselves, so that an index stays bounded.
    4. Spans return to all occurrences of their piece and to the documents.

    Texts move once (both joins use one exchange); of equal pieces one moves. Matches never cross documents. Null text counts
    as empty; texts shorter than ``length`` have no spans; rows that repeat id and text
    repeat each other in full; null ids are allowed; an empty table gives
    no rows; other columns are not read."""
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    # the key of a row is its id and a checksum of its text: rows that share it are equal, and share their spans
    integral = docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long")
    key = F.coalesce(F.col(id_col).cast("long") if integral else F.xxhash64(id_col), F.xxhash64(raw))
    rows = docs.select(F.col(id_col).alias("id"), raw.alias("t"), key.alias("k"), (F.crc32(raw) - (1 << 31)).cast("int").alias("c"))
    found = _pieces(rows, length, gram)
    # written, so that the join's sides are plain exchanges and a hot anchor can be split
    often = materialize(_anchors(rows, length, gram).groupBy("f").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(F.col("f").alias("_f")), "repeat-anchors")
    found = materialize(found.join(often, F.col("f") == F.col("_f")).drop("_f"), "repeat-pieces")
    classes = materialize(found.groupBy("f", "h").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("k", "c", "at", "n")).alias("one")), "repeat-classes")
    hot = materialize(classes.groupBy("f").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most_pieces).select(
        F.col("f").alias("_f"), F.lit(True).alias("hot")), "repeat-hot")
    open_ = classes.join(hot, F.col("f") == F.col("_f"), "left").select("f", "h", "times", F.coalesce("hot", F.lit(False)).alias("hot"), "one.*")
    wanted = open_.groupBy("k", "c").agg(F.collect_list(F.struct("f", "h", "times", "hot", "at", "n")).alias("list"))
    cut = materialize(_cut(rows, wanted, length), "repeat-cuts")
    rounds = [(min(g, length) if g < LENGTH else length, s) for g, s in ROUNDS[1:]]
    marks = _marks(cut, length, index_bytes, most_pieces, rounds).select(F.col("f").alias("_f"), F.col("h").alias("_h"), "spans")
    hits = found.join(marks, (F.col("f") == F.col("_f")) & (F.col("h") == F.col("_h"))).select(
        "k", "c", F.transform("spans", lambda s: F.struct((s["a"] + F.col("at")).alias("a"), (s["b"] + F.col("at")).alias("b"))).alias("spans"))
    per_doc = hits.groupBy("k", "c").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    kind = rows.schema["id"].dataType.simpleString()

    def finish(batches):
        for batch in batches:
            starts, ends, sizes, digests = [], [], [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                spans = merged([(s["a"], s["b"]) for s in spans or ()])
                digest, at = hashlib.sha256(), 0
                for a, b in spans:
                    digest.update(text[at:a])
                    at = b
                digest.update(text[at:])
                sizes.append(len(text))
                starts.append([a for a, _ in spans])
                ends.append([b for _, b in spans])
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())),
                 pa.array(digests, pa.string())], names=["doc_id", "n_bytes", "starts", "ends", "kept_sha256"])

    out = rows.join(per_doc, ["k", "c"], "left").select("id", "t", "spans")
    return out.mapInArrow(finish, f"doc_id {kind}, n_bytes long, starts array<long>, ends array<long>, kept_sha256 string")
