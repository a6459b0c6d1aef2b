"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from articlelab.session import ensure_checkpoint_dir, materialize, scratch_path, ship_package

__all__ = ["prepare", "table", "materialize", "scratch_path", "unit_hash", "small_lookup", "text_or_empty", "value_bytes"]

#: A lookup table is broadcast only up to this many rows and this many bytes,
#: both measured: keys and values may be texts of any length.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20
#: Bytes of a value or of a row besides its text.
VALUE_BYTES = 16
#: Beyond it the lookup is a shuffle join whose key is spread over this many salts.
LOOKUP_SALTS = 64


def prepare(spark: SparkSession) -> None:
    """Shared checkpoint folder and the package on the Python workers."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def unit_hash(key: Column, seed: str) -> Column:
    """A number in [0, 1) from 52 bits of ``md5(seed:key)``; the same in every
    run, on every partitioning, and in plain SQL. A null key counts as ''."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def value_bytes(text: Column) -> Column:
    """Bytes that a text takes in a lookup table; null: none but the overhead."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(VALUE_BYTES)


def small_lookup(big: DataFrame, lookup: DataFrame, keys: list[str], salt_by: Column | None = None) -> DataFrame:
    """Left join of ``lookup`` (one row per key, nulls match nulls; texts and
    numbers, no lists: those have no bound on their bytes here).

    The lookup is measured first. Up to ``BROADCAST_ROWS`` rows and
    ``BROADCAST_BYTES`` it is broadcast, so no row of ``big`` moves. A larger one is copied once per
    salt and joined on (keys, salt): a key that holds a third of ``big`` is
    then met by ``LOOKUP_SALTS`` tasks."""
    right = lookup.select(*[F.col(k).alias(f"_l_{k}") for k in keys],
                          *[c for c in lookup.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [big[k].eqNullSafe(right[f"_l_{k}"]) for k in keys])
    drop = [f"_l_{k}" for k in keys]
    size = reduce(lambda a, b: a + b, [value_bytes(right[c]) if t == "string" else F.lit(VALUE_BYTES) for c, t in right.dtypes])
    n, n_bytes = right.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    if n <= BROADCAST_ROWS and n_bytes <= BROADCAST_BYTES:
        return big.join(F.broadcast(right), on, "left").drop(*drop)
    by = salt_by if salt_by is not None else F.monotonically_increasing_id()
    big = big.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(LOOKUP_SALTS)))
    right = right.withColumn("_l_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(LOOKUP_SALTS - 1).cast("long"))))
    on = reduce(lambda a, b: a & b, [big[k].eqNullSafe(right[f"_l_{k}"]) for k in keys])
    return big.join(right.hint("merge"), on & (big["_salt"] == right["_l_salt"]), "left").drop(*drop, "_salt", "_l_salt")
