"""Benchmark decontamination by Wu-Manber multi-pattern search over words."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from articlelab.llm.common import materialize

WINDOW = 13
#: Benchmark text, and windows of it, indexed at a time; a larger benchmark takes several passes.
BLOCK_BYTES = 32 << 20
BLOCK_WINDOWS = 250_000
#: What ``words_of`` finds, before its change of case.
_WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: A-Z become a-z; digits, a-z and all bytes of non-ASCII characters are kept; the rest separates words.
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
                  for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a UTF-8 text in lower case (A-Z)."""
    return (text or b"").translate(_TO_WORDS).split()


class WuManber:
    """Search for all patterns of one length (sequences of word numbers) at once.

    ``shift``: for a block of two words, how far the end of the window may move
    without passing an occurrence; a block in no pattern allows the most.
    ``suffix``: for the blocks that end and begin a pattern (its suffix and prefix
    hash), a bucket of the patterns for the direct comparison."""

    def __init__(self, patterns: dict[tuple[int, ...], list], length: int):
        self.m, self.block = length, min(2, length)
        self.far = length - self.block + 1
        self.shift: dict[tuple[int, ...], int] = {}
        self.suffix: dict[tuple[int, ...], list] = defaultdict(list)
        for pattern, items in patterns.items():
            for end in range(self.block, length + 1):
                key = pattern[end - self.block:end]
                self.shift[key] = min(self.shift.get(key, self.far), length - end)
            self.suffix[pattern[-self.block:] + pattern[:self.block]].append((pattern, items))

    def find(self, ids: list[int]) -> Iterator[tuple[int, list]]:
        """(start, items) of every occurrence, overlapping ones included. 0 is a
        word of no pattern: no window may hold it."""
        m, b, far, shift, suffix = self.m, self.block, self.far, self.shift, self.suffix
        end, n = m, len(ids)
        while end <= n:
            if not ids[end - 1]:
                end += m
                continue
            key = tuple(ids[end - b:end])
            move = shift.get(key, far)
            if move:
                end += move
                continue
            start = end - m
            bucket = suffix.get(key + tuple(ids[start:start + b]))
            if bucket:
                here = tuple(ids[start:end])
                for pattern, items in bucket:
                    if here == pattern:
                        yield start, items
                        break  # patterns are distinct
            end += 1


class WindowIndex:
    """Windows of benchmark items: vocabulary and one searcher per window length."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        by_length: dict[int, dict] = defaultdict(lambda: defaultdict(list))
        for name, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            size = min(window, len(ids))
            for pattern in {tuple(ids[i:i + size]) for i in range(len(ids) - size + 1)} if size else ():
                by_length[size][pattern].append(name)
        self.searchers = [WuManber(dict(p), size) for size, p in sorted(by_length.items())]

    def scan(self, text: bytes | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, (start, end) word spans in occurrences, items that occur."""
        words = words_of(text)
        ids = [self.vocabulary.get(w, 0) for w in words]
        spans, found = [], set()
        for searcher in self.searchers:
            for start, items in searcher.find(ids):
                spans.append((start, start + searcher.m))
                found.update(items)
        return len(words), merge_spans(spans), found


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def segments(items: DataFrame, window: int, most: int) -> DataFrame:
    """``item, text, windows``: items of over ``most`` windows in overlapping
    segments of at most that many, which have the same windows together."""
    words = F.coalesce(F.regexp_extract_all(F.col("text").cast("string"), F.lit(_WORDS), F.lit(0)), F.array().cast("array<string>"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("_w") - window, F.lit(0)), F.lit(most))
    cut = items.select("item", words.alias("_w")).select("item", "_w", F.explode(starts).alias("_at"))
    own = F.slice("_w", F.col("_at") + 1, F.lit(most + window - 1))
    return cut.select("item", F.array_join(own, " ").cast("binary").alias("text"), F.greatest(
        F.when(F.size(own) > 0, 1).otherwise(0), F.size(own) - window + 1).cast("long").alias("windows"))


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                   block_bytes: int = BLOCK_BYTES, carry: bool = False, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row per document row: ``_id, _n_words, _starts, _ends`` (hit word spans,
    end exclusive) and ``_items`` (ids as strings); with ``carry`` also all
    columns of ``docs``, as ``_c0, _c1, ...``.

    Documents are scanned where they are: no shuffle. The window index of the
    benchmark is broadcast to them; its text and windows are measured first and,
    beyond ``block_bytes`` or ``block_windows``, dealt over several passes (long
    items in segments), each written before the next.

    Null or wordless texts have no words and no hits; a null item id is the
    string 'null'; items without words have no windows; an empty benchmark hits
    nothing; repeated rows count each; an empty table gives no rows."""
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"),
                             F.col(item_text_col).cast("string").cast("binary").alias("text"))
    items = segments(items, window, max(1, block_windows // 16))
    total, windows = items.agg(F.sum(F.octet_length("text")), F.sum("windows")).first()
    passes = max(1, math.ceil((total or 0) / block_bytes), math.ceil((windows or 0) / block_windows))
    state = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").cast("binary").alias("_t"),
                        *[docs[c].alias(f"_c{i}") for i, c in enumerate(docs.columns if carry else [])])
    state = state.withColumns({"_n_words": F.lit(0).cast("long"), "_starts": F.array().cast("array<int>"),
                               "_ends": F.array().cast("array<int>"), "_items": F.array().cast("array<string>")})
    for k in range(passes):
        block = items if passes == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == k)
        index = spark.sparkContext.broadcast(WindowIndex([(r["item"], r["text"]) for r in block.collect()], window))

        def scan(batches, index=index):
            own = index.value
            for batch in batches:
                n, starts, ends, names = [], [], [], []
                old = [batch.column(c).to_pylist() for c in ("_t", "_starts", "_ends", "_items")]
                for text, s0, e0, i0 in zip(*old, strict=True):
                    count, spans, found = own.scan(text)
                    spans = merge_spans([*zip(s0, e0, strict=True), *spans])
                    n.append(count)
                    starts.append([a for a, _ in spans])
                    ends.append([b for _, b in spans])
                    names.append(sorted(found.union(i0)))
                new = {"_n_words": pa.array(n, pa.int64()), "_starts": pa.array(starts, pa.list_(pa.int32())),
                       "_ends": pa.array(ends, pa.list_(pa.int32())), "_items": pa.array(names, pa.list_(pa.string()))}
                yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in batch.schema.names],
                                                 names=batch.schema.names)

        state = state.mapInArrow(scan, state.schema)
        if k < passes - 1:
            state = materialize(state, "decontamination")
    return state.drop("_t")


def contamination(hits: DataFrame) -> DataFrame:
    """``hits`` with ``_n_hit`` and ``_contaminated``: some hit, and at least a twentieth of the words."""
    n_hit = F.aggregate(F.zip_with("_ends", "_starts", lambda b, a: b - a), F.lit(0).cast("long"), lambda s, x: s + x)
    return hits.withColumn("_n_hit", n_hit).withColumn(
        "_contaminated", (F.col("_n_hit") > 0) & (20 * F.col("_n_hit") >= F.col("_n_words")))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated; same columns, no shuffle."""
    clean = contamination(benchmark_hits(docs, benchmark, carry=True, **options)).filter("not _contaminated")
    return clean.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])
