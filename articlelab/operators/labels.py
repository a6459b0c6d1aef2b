"""Class numbers and label re-indexing.

The distinct values are found and numbered by distributed jobs, however many
there are; the map is broadcast back to the rows only when its counted size
allows it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from articlelab.operators.keys import with_row_number
from articlelab.session import materialize

# Largest class table that is broadcast, in bytes (names have any length); beyond
# it the join shuffles.
BROADCAST_BYTES = 16 << 20
# Values that are few enough to be numbered by one task.
FEW_CLASSES = 10_000
# Values that an error names.
NAMED = 20


def class_map(df: DataFrame, col: str = "type", index_col: str = "label") -> DataFrame:
    """``(col, index)``, index = position in the sorted distinct values.

    A distributed ``distinct``, written and counted; few values are numbered
    by one window, more by exact row numbers from value ranges: no collect and
    no bound on the number of classes."""
    values = materialize(df.select(col).where(F.col(col).isNotNull()).distinct(), "class-values")
    if values.count() <= FEW_CLASSES:
        return values.select(col, (F.row_number().over(Window.orderBy(col)) - 1).cast("bigint").alias(index_col))
    numbered = with_row_number(values, col, name="_no")
    return materialize(numbered.select(col, (F.col("_no") - 1).alias(index_col)), "class-map")


def _maybe_broadcast(small: DataFrame) -> DataFrame:
    """Broadcast hint for a table whose measured bytes allow it."""
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) if t == "string" else F.lit(8) for c, t in small.dtypes), F.lit(16))
    n_bytes = small.agg(F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()[0]
    return F.broadcast(small) if n_bytes <= BROADCAST_BYTES else small


def apply_class_map(df: DataFrame, mapping: DataFrame, col: str = "type") -> DataFrame:
    """add the class number of each row (inner join: rows whose class
    has no number are dropped; run :func:`unmapped` first to catch them)."""
    return df.join(_maybe_broadcast(mapping), on=col, how="inner")


def unmapped(df: DataFrame, mapping: DataFrame, col: str = "type") -> DataFrame:
    """The distinct values of ``col`` that have no class number,
    with their row counts (the reference raises on a non-empty result)."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    return counts.join(_maybe_broadcast(mapping.select(col)), on=col, how="left_anti")


def assert_mapped(df: DataFrame, mapping: DataFrame, col: str = "type") -> None:
    """C13 strict mode: fail with the number of values without a class number,
    naming the first ``NAMED`` in order."""
    without = materialize(unmapped(df, mapping, col).select(F.col(col).cast("string").alias("v")), "unmapped")
    n = without.count()
    if n:
        first = [str(r["v"]) for r in without.orderBy("v").limit(NAMED).collect()]
        raise ValueError(f"{n} value(s) of {col!r} are not in the class map: {', '.join(first)}{', ...' if n > NAMED else ''}")


def dense_labels(df: DataFrame, col: str = "label", out: str = "label") -> DataFrame:
    """re-index labels to 0..K-1 in ascending (numeric) order. One
    index table is fitted on the whole input (train and test together), so
    a class missing from one split does not shift the others (Q2)."""
    mapping = class_map(df, col, "_dense")
    joined = apply_class_map(df, mapping, col)
    return joined.withColumn(out, F.col("_dense")).drop("_dense") if out != col else \
        joined.drop(col).withColumnRenamed("_dense", col)


def literal_map(spark, values: dict, col: str = "type", index_col: str = "label") -> DataFrame:
    """A caller-supplied class map (M4) as a two-column table."""
    rows = sorted(values.items(), key=lambda kv: kv[1])
    return spark.createDataFrame(rows, f"{col} string, {index_col} bigint")
