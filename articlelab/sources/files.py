"""File sources.

All readers take an explicit schema (no inference pass over the data),
read multi-line quoted text, and never collect rows to the driver.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from articlelab.operators.rows import spread
from articlelab.session import materialize

ARTICLE_SCHEMA = "type string, text string"
WIKIHOW_SCHEMA = "title string, headline string, sectionLabel string, text string"
CORRUPT = "_corrupt_record"
# Fixed value: the sentinel string the batched encoders declare null.
NULL_SENTINELS = ("Grow Plants from Seeds",)


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: str = ARTICLE_SCHEMA,
             columns: Sequence[str] | None = None, header: bool = True,
             file_order: str | None = None) -> DataFrame:
    """A1/A2: CSV with a header, quoted multi-line fields and doubled
    quotes; ``columns`` projects (pruned by Catalyst). ``file_order`` names
    a column holding each row's position in file order
    (:func:`with_file_order`)."""
    df = (spark.read.schema(schema).option("header", header).option("multiLine", True)
          .option("escape", '"').option("mode", "PERMISSIVE").csv(path))
    if file_order:
        df = with_file_order(df, file_order)
        columns = [*columns, file_order] if columns else None
    df = df.select(*columns) if columns else df
    # a multi-line CSV file is never split: one task per file
    return spread(df)


def with_file_order(df: DataFrame, name: str = "file_row") -> DataFrame:
    """The 0-based position of every row of a file scan, in order of file
    name, then of place in the file.

    Ids taken at the scan are consecutive within a split of a file, so a row's
    position is its id less the split's first id, plus the rows of the splits
    before it: one row per split is counted, nothing is sorted."""
    tagged = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__at"),
                       F.monotonically_increasing_id().alias("__id"))
    part = F.shiftright("__id", 33)
    splits = tagged.groupBy("__file", "__at", part.alias("__part")).agg(
        F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__file", "__at", "__first").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(splits.select("__file", "__at", "__part", (
        F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift")), "file-splits")
    out = tagged.withColumn("__part", part).join(offsets, ["__file", "__at", "__part"])
    return out.withColumn(name, F.col("__id") + F.col("__shift")).drop("__file", "__at", "__part", "__id", "__shift")


def read_csv_tolerant(spark: SparkSession, path: str | Sequence[str], schema: str = ARTICLE_SCHEMA,
                      null_values: Sequence[str] = NULL_SENTINELS, header: bool = True,
                      file_order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A3: ragged rows and bad cells do not fail the scan. Returns
    ``(rows, flagged)``: every parsed row (short rows null-filled, long rows
    cut) with ``repaired``, and the rows Spark had to repair with their raw
    text. Sentinel strings become null. ``file_order`` as in :func:`read_csv`."""
    df = (spark.read.schema(f"{schema}, {CORRUPT} string").option("header", header)
          .option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", CORRUPT).csv(path))
    if file_order:
        df = with_file_order(df, file_order)
    df = spread(df)
    cols = [c for c in df.columns if c != CORRUPT]
    cleaned = df.select(*[F.when(F.col(c).isin(list(null_values)), F.lit(None)).otherwise(F.col(c)).alias(c)
                          if dict(df.dtypes)[c] == "string" else F.col(c) for c in cols],
                        F.col(CORRUPT).isNotNull().alias("repaired"))
    # Spark refuses a scan for the raw text alone: the condition names a data column too
    named = F.length(F.coalesce(F.col(cols[0]).cast("string"), F.lit(""))) >= 0
    flagged = df.where(F.col(CORRUPT).isNotNull() & named)
    return cleaned, flagged


def rename_positional(df: DataFrame, names: Sequence[str] = ("type", "text")) -> DataFrame:
    """A5: positional rename of the first columns."""
    keep = df.columns[:len(names)]
    return df.select(*[F.col(c).alias(n) for c, n in zip(keep, names)])


def read_embedded_csv(spark: SparkSession, path: str | Sequence[str], dim: int,
                      prefix: str = "f", keys: str = "", file_order: str | None = None) -> DataFrame:
    """``[keys,] label, f0 .. f{dim-1}`` CSV -> ``([keys,] label,
    features ARRAY<DOUBLE>)``; ``keys`` is a DDL list of leading columns."""
    lead = f"{keys}, " if keys else ""
    schema = lead + "label int, " + ", ".join(f"{prefix}{i} double" for i in range(dim))
    df = spark.read.schema(schema).option("header", True).csv(path)
    key_cols = [c.strip().split()[0] for c in keys.split(",")] if keys else []
    if file_order:
        df, key_cols = with_file_order(df, file_order), [*key_cols, file_order]
    return df.select(*key_cols, "label", F.array(*[F.col(f"{prefix}{i}") for i in range(dim)]).alias("features"))


def read_word_vectors(spark: SparkSession, path: str | Sequence[str], dim: int) -> DataFrame:
    """Text word vectors ``token v1 .. vd`` -> ``(token, vec, line_no)``.
    Lines of the wrong width (a ``count dim`` header, Q12) are dropped.
    ``line_no`` keeps file order for A8 (file name, then line position)."""
    raw = with_file_order(spark.read.text(path), "line_no")
    parts = F.split(F.col("value"), " ", 2)
    vec = F.transform(F.split(F.trim(F.element_at(parts, 2)), " +"), lambda x: x.try_cast("double"))
    out = raw.select(F.element_at(parts, 1).alias("token"), vec.alias("vec"), "line_no")
    ok = (F.size("vec") == dim) & F.forall("vec", lambda x: x.isNotNull())
    return out.where(ok)


def train_test_pair(spark: SparkSession, ds: str, test_ds: str | None, dim: int,
                    seed: int = 42, share: float = 0.8) -> DataFrame:
    """Two embedded files, or one file split exactly (D4). Returns one
    table with ``split`` and ``row_id`` (position in file order, unique over
    both files: even in the first, odd in the second)."""
    from articlelab.operators.sampling import with_split
    if test_ds:
        a = read_embedded_csv(spark, ds, dim, file_order="row_id").withColumn("split", F.lit("train"))
        b = read_embedded_csv(spark, test_ds, dim, file_order="row_id").withColumn("split", F.lit("test"))
        return a.withColumn("row_id", F.col("row_id") * 2).unionByName(b.withColumn("row_id", F.col("row_id") * 2 + 1))
    return with_split(read_embedded_csv(spark, ds, dim, file_order="row_id"), "row_id", seed, share)
