"""Resumable scans of large CSV files.

An index names, for stretches of about ``RANGE_BYTES`` of every file, the bytes
of whole records, the number of the first one and how many there are. It is
made by one pass and stored; a later run opens only the stretches that hold
rows it still needs.

A line break ends a record unless it stands inside quotes, which depends on all
quotes before it: each stretch is read once for either case, and a running
parity over the stretches tells which holds. Quotes within quotes are doubled,
as Spark and Polars write them. Empty lines are no records, as in Spark's reader.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from articlelab.sinks.image_tree import store_of
from articlelab.sources.files import ARTICLE_SCHEMA, CORRUPT, NULL_SENTINELS

#: Bytes of a stretch: what one task of a scan reads at a time.
RANGE_BYTES = 32 << 20

INDEX = "file string, size long, start long, stop long, first_row long, n_rows long"


def files_of(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``file, size`` of the CSV files under ``path``, without reading them."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(
        path if isinstance(path, str) else list(path)).select(F.col("path").alias("file"), F.col("length").alias("size")).where("size > 0")


def _ends(data: np.ndarray, inside: bool) -> np.ndarray:
    """Places after the line breaks that are outside quotes."""
    quotes = np.cumsum(data == 0x22, dtype=np.int64) & 1
    return np.flatnonzero((data == 0x0A) & (quotes == int(inside))) + 1


def _records(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of the stretches between ``ends`` (from 0) hold anything but a line break."""
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    size = ends - starts
    first = data[np.minimum(starts, max(len(data) - 1, 0))] if len(data) else np.zeros(len(starts), np.uint8)
    return (size > 2) | ((size == 2) & (first != 0x0D)) | ((size == 1) & (first != 0x0A))


def _dealt(ranges: DataFrame) -> DataFrame:
    """Stretches over tasks by their bytes: one of ``RANGE_BYTES`` or many small ones
    to a task, and no more tasks than stretches. A task reads one at a time."""
    n, size = ranges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("stop") - F.col("start")), F.lit(0))).first()
    least = 2 * ranges.sparkSession.sparkContext.defaultParallelism
    return ranges.repartition(max(1, min(n, max(least, -(-size // RANGE_BYTES)))), "file", "start")


PROBE = "file string, size long, k long, start long, odd long, " + ", ".join(f"first{p} long, whole{p} long, last{p} long" for p in (0, 1))


def _probe(ranges: DataFrame) -> DataFrame:
    """Per stretch and for either case (its start outside or inside quotes): the
    end of the first record (-1: none), the records after it, and the end of the last."""
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for r in batch.to_pylist():
                fs, path = store_of(r["file"])
                with fs.open_input_file(path) as f:
                    data = np.frombuffer(f.read_at(r["stop"] - r["start"], r["start"]), np.uint8)
                out = {"file": [r["file"]], "size": [r["size"]], "k": [r["k"]], "start": [r["start"]], "odd": [int((data == 0x22).sum()) & 1]}
                for p in (0, 1):
                    ends = _ends(data, bool(p))
                    first = int(ends[0]) if len(ends) else -1
                    rest = ends[1:] - first if len(ends) else ends
                    out[f"first{p}"] = [r["start"] + first if first >= 0 else -1]
                    out[f"whole{p}"] = [int(_records(data[first:], rest).sum()) if len(rest) else 0]
                    out[f"last{p}"] = [r["start"] + int(ends[-1]) if len(ends) else -1]
                yield pa.RecordBatch.from_pydict(out, schema=ARROW_PROBE)

    return ranges.mapInArrow(run, PROBE)


ARROW_PROBE = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in PROBE.split(", ")])


def build_index(spark: SparkSession, path: str | Sequence[str], range_bytes: int = RANGE_BYTES, header: bool = True) -> DataFrame:
    """The index of the files under ``path`` in order of name (``INDEX``); one pass
    over their bytes. A stretch starts after the first record end inside
    it (the file's first one at 0), so a record belongs to where it starts."""
    cut = files_of(spark, path).select("file", "size", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long"))).alias("k", "start"))
    cut = cut.withColumn("k", F.col("k").cast("long")).withColumn("stop", F.least(F.col("start") + range_bytes, F.col("size")))
    seen = _probe(_dealt(cut))
    in_file = Window.partitionBy("file").orderBy("k")
    inside = F.coalesce(F.sum("odd").over(in_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2 == 1
    pick = lambda c: F.when(F.col("inside"), F.col(f"{c}1")).otherwise(F.col(f"{c}0")).alias(c)
    held = seen.withColumn("inside", inside).select("file", "size", "k", "start", pick("first"), pick("whole"), pick("last"))
    # the first stretch begins with a record; others with the end of one
    held = held.where((F.col("k") == 0) | (F.col("first") >= 0)).withColumn("begin", F.when(F.col("k") == 0, 0).otherwise(F.col("first")))
    following = F.lead("begin").over(in_file)
    stop = F.coalesce(following, F.col("size"))
    last = F.greatest("last", "begin")
    # records between: those after the first end, the first of a file, and the one that ends in the next stretch (or with the file)
    own_first = F.when((F.col("k") == 0) & (F.col("first") >= 0), 1).otherwise(0)
    open_end = F.when(following.isNotNull(), F.when((F.col("k") > 0) | (F.col("first") >= 0) | (F.col("k") == 0), 1)).when(last < F.col("size"), 1).otherwise(0)
    rows = held.select("file", "size", "k", F.col("begin").alias("start"), stop.alias("stop"), (F.col("whole") + own_first + open_end).alias("n"))
    rows = rows.withColumn("n_rows", F.col("n") - F.when((F.col("k") == 0) & F.lit(header), 1).otherwise(0))
    before = Window.orderBy("file", "k").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("file", "size", "start", "stop", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("first_row"), F.greatest("n_rows", F.lit(0)).alias("n_rows"))


def stored_index(spark: SparkSession, path: str | Sequence[str], index_path: str, range_bytes: int = RANGE_BYTES, header: bool = True) -> tuple[DataFrame, bool]:
    """The index stored under ``index_path``, made again if a file is new, gone or
    of another size; and whether it was made again."""
    try:
        have = spark.read.schema(INDEX).parquet(index_path)
        now = files_of(spark, path)
        known = have.select("file", "size").distinct()
        if now.exceptAll(known).isEmpty() and known.exceptAll(now).isEmpty():
            return have, False
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    build_index(spark, path, range_bytes, header).coalesce(1).write.mode("overwrite").parquet(index_path)
    return spark.read.schema(INDEX).parquet(index_path), True


def pending_ranges(index: DataFrame, finished: DataFrame, batch_size: int, batch_col: str = "batch_no", stop_before: int | None = None) -> DataFrame:
    """Stretches that hold rows of a batch that is not finished (and before ``stop_before``)."""
    some = index.where("n_rows > 0")
    batches = some.select("file", "start", F.explode(F.sequence(F.floor(F.col("first_row") / batch_size), F.floor((F.col("first_row") + F.col("n_rows") - 1) / batch_size))).alias(batch_col))
    open_ = batches.join(finished.select(batch_col).distinct(), batch_col, "left_anti")
    if stop_before is not None:
        open_ = open_.where(F.col(batch_col) < stop_before)
    return some.join(open_.select("file", "start").distinct(), ["file", "start"], "left_semi")


def read_ranges(ranges: DataFrame, schema: str = ARTICLE_SCHEMA, null_values: Sequence[str] = NULL_SENTINELS, header: bool = True) -> DataFrame:
    """Rows of the stretches ``ranges`` (of an index): the columns of ``schema``,
    ``repaired`` and ``file_row``, as the tolerant reader gives them (short rows
    null-filled, long ones cut, sentinels null). No other bytes are opened."""
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for r in batch.to_pylist():
                fs, path = store_of(r["file"])
                with fs.open_input_file(path) as f:
                    data = f.read_at(r["stop"] - r["start"], r["start"])
                view = np.frombuffer(data, np.uint8)
                ends = _ends(view, False)
                if not len(ends) or ends[-1] < len(data):
                    ends = np.append(ends, len(data))
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                keep = np.flatnonzero(_records(view, ends))
                texts = [data[a:b].rstrip(b"\r\n").decode("utf-8", "replace") for a, b in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)]
                texts = texts[1:] if header and r["start"] == 0 else texts
                for a in range(0, len(texts), 4096):
                    part = texts[a:a + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array(range(r["first_row"] + a, r["first_row"] + a + len(part)), pa.int64()), pa.array(part, pa.string())],
                                                     names=["file_row", "record"])

    lines = _dealt(ranges.select("file", "start", "stop", "first_row")).mapInArrow(run, "file_row long, record string")
    parsed = lines.select("file_row", F.from_csv("record", F.lit(f"{schema}, {CORRUPT} string"), {
        "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "multiLine": "true"}).alias("r"))
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = dict(parsed.select("r.*").dtypes)
    cols = [F.when(F.col(f"r.{c}").isin(list(null_values)), F.lit(None)).otherwise(F.col(f"r.{c}")).alias(c) if kinds[c] == "string" else F.col(f"r.{c}").alias(c)
            for c in names]
    return parsed.select(*cols, F.col(f"r.{CORRUPT}").isNotNull().alias("repaired"), "file_row")
