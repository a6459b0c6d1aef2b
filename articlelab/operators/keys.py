"""Order keys and exact global row numbers.

A seeded shuffle is an order by ``md5(seed:id)``: deterministic, the same
under any repartitioning, and identical in SQL engines (``rand(seed)``
depends on the partition layout and is never used).

Exact row numbers never use an un-partitioned window over the data.
Rows are cut into order-preserving ranges: the first hex digits of an md5 key,
or, for any other key, sampled quantiles of (key, tie-break), so neither
outliers nor a value that very many rows share make a large range. A tiny
per-range count table is turned into running offsets, and each row gets its
place in its range + the offset. Rows are shuffled once, by range, and never
meet in one task. Callers number narrow rows (ids, not texts): a sample or a
split needs only the key at which it cuts (:func:`within_first`), so texts stay
where they are. Ties on the order key are broken by ``tiebreak`` columns.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from articlelab.session import materialize

# Fixed defaults of the reference: seed and train share.
DEFAULT_SEED = 42
TRAIN_SHARE = 0.8


def shuffle_key(id_col, seed: int = DEFAULT_SEED) -> Column:
    """Seeded order key ``md5('<seed>:<id>')`` (hex string)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(F.lit(str(seed)), F.lit(":"), c.cast("string")))


def with_row_number(df: DataFrame, order_col: str, *, by: Sequence[str] = (),
                    tiebreak: Sequence[str] = (), name: str = "row_no",
                    total_name: str | None = None, hex_key: bool = False, hex_digits: int = 3) -> DataFrame:
    """Add an exact 1-based ``row_number() over (partition by <by> order by
    <order_col>, <tiebreak>)`` without a single-task window; nulls come first.

    A lower-case md5 string (``hex_key``) is cut by its first ``hex_digits``
    digits; any other key, of any type and spread, by sampled ranges.
    If ``total_name`` is given, the group's row count is added too.
    """
    if not hex_key:
        return _numbered_by_ranges(ranged(df, [*by, order_col, *tiebreak]), list(by), name, total_name)
    by = list(by)
    b = "__bucket"
    # non-nullable bucket: no inferred null filter on one side of the join,
    # so both uses of the ranked rows stay identical and share one shuffle
    # (a null order key sorts first, and bucket 0 is the first bucket)
    bucket = F.conv(F.substring(F.col(order_col), 1, hex_digits), 16, 10).cast("int")
    keyed = df.withColumn(b, F.coalesce(bucket, F.lit(0)))
    # rank inside each bucket first; the bucket sizes are read off the ranked
    # rows (same shuffle, reused), so the input plan is computed only once
    w = Window.partitionBy(*by, b).orderBy(F.col(order_col), *[F.col(t) for t in tiebreak])
    ranked = keyed.withColumn("__rn", F.row_number().over(w))
    counts = ranked.groupBy(*by, b).agg(F.max("__rn").alias("__cnt"))
    offsets = _offsets(counts, by, b, total_name)
    # The offset table has at most 16**hex_digits rows per group of `by`.
    if not by and hex_digits <= 4:
        offsets = F.broadcast(offsets)
    out = ranked.join(offsets, on=[*by, b], how="inner")
    return out.withColumn(name, (F.col("__rn") + F.col("__off")).cast("bigint")).drop("__rn", "__off", b)


def _offsets(counts: DataFrame, by: list[str], bucket: str, total_name: str | None, first: str | None = None) -> DataFrame:
    """Running sums of ``__cnt`` over the buckets before (``__off``), less ``first``."""
    running = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    off = F.coalesce(F.sum("__cnt").over(running), F.lit(0))
    out = counts.withColumn("__off", off - F.col(first) if first else off)
    if total_name:
        out = out.withColumn(total_name, F.sum("__cnt").over(Window.partitionBy(*by)))
    return out.drop("__cnt", *([first] if first else []))


def ranged(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` sorted over sampled ranges of ``keys`` and written, with each row's
    place as ``__at`` (range in the upper bits, place in the range below)."""
    laid = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id())
    return materialize(laid, "ranges")


def _numbered_by_ranges(laid: DataFrame, by: list[str], name: str, total_name: str | None) -> DataFrame:
    """Row numbers from places: a row's place less the first of its group in its
    range, and the group's rows in the ranges before."""
    b = "__range"
    laid = laid.withColumn(b, F.shiftright("__at", 33))
    counts = laid.groupBy(*by, b).agg(F.count(F.lit(1)).alias("__cnt"), F.min("__at").alias("__first"))
    offsets = _offsets(counts, by, b, total_name, "__first")
    if not by:              # a row per range
        out = laid.join(F.broadcast(offsets), b)
    else:                   # a row per range and per group: Spark measures it
        on = F.col(b) == F.col("__l_" + b)
        for c in by:
            on &= F.col(c).eqNullSafe(F.col("__l_" + c))
        right = offsets.select(*[F.col(c).alias("__l_" + c) for c in [*by, b]], "__off", *([total_name] if total_name else []))
        out = laid.join(right, on).drop(*["__l_" + c for c in [*by, b]])
    return out.withColumn(name, (F.col("__at") + F.col("__off") + 1).cast("bigint")).drop("__at", "__off", b)


def within_first(df: DataFrame, id_col: str, n: int, total: int, seed: int = DEFAULT_SEED) -> Column:
    """Condition: a row is among the first ``n`` of ``total`` in seeded order.

    One job over the ids finds the n-th (key, id); every row then compares
    its own, so nothing but ids is shuffled. Rows that repeat the id at the
    cut are all in."""
    if n <= 0 or n >= total:
        return F.lit(n > 0)
    ids = df.select(F.col(id_col).alias("_id")).withColumn("_key", shuffle_key("_id", seed))
    cut = with_row_number(ids, "_key", tiebreak=["_id"], name="_no", hex_key=True).where(F.col("_no") == n).first()
    key = shuffle_key(id_col, seed)
    return (key < cut["_key"]) | ((key == cut["_key"]) & (F.col(id_col) <= F.lit(cut["_id"])))
