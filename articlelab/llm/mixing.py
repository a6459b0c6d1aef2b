"""Mixing sources to target weights (native)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from articlelab.llm.common import small_lookup, unit_hash

SEED = "mix-1"


def word_count(text: Column) -> Column:
    """Runs of characters other than space and tab..carriage return; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_rates(sized: DataFrame, source: str, size: str,
                 weights: Sequence[int] = (1, 2, 3), max_rate: int = 3) -> DataFrame:
    """One row per source: ``source, source_size, target, rate``.

    Sources in code point order (null last) take ``weights`` in turn and share
    the sum of all sizes. No target exceeds ``max_rate`` times its source's
    size; the excess is shared by weight among the rest until none is above.
    In the order of cap / weight the capped sources are a prefix: a source is
    capped if its cap is at most its share of what the sources before it leave.
    The windows run over one row per source."""
    per = sized.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size"))
    pick = F.element_at(F.array(*[F.lit(int(w)) for w in weights]),
                        ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
                         % len(weights) + 1).cast("int"))
    per = per.withColumn("_w", pick.cast("long")).withColumn("_cap", F.col("source_size") * F.lit(int(max_rate)))
    order = Window.orderBy((F.col("_cap") / F.col("_w")).asc(), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    per = per.select(
        "*", F.sum("source_size").over(everything).alias("_all"),
        F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("_w_left"))
    per = per.withColumn("_capped", F.col("_cap") * F.col("_w_left") <= (F.col("_all") - F.col("_before")) * F.col("_w"))
    per = per.withColumn("_rest", F.col("_all") - F.coalesce(F.sum(F.when(F.col("_capped"), F.col("_cap"))).over(everything), F.lit(0)))
    per = per.withColumn("_w_rest", F.sum(F.when(~F.col("_capped"), F.col("_w"))).over(everything))
    target = F.when(F.col("_capped"), F.col("_cap").cast("double")).otherwise(
        (F.col("_rest") * F.col("_w")).cast("double") / F.col("_w_rest").cast("double"))
    per = per.select("source", "source_size", target.alias("target"))
    return per.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))


def with_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights: Sequence[int] = (1, 2, 3), max_rate: int = 3, seed: str = SEED) -> DataFrame:
    """``docs`` with ``_size, _source_size, _target, _copies``: floor(rate) copies
    of each document plus one if the hash of its id is under the fraction.

    Only per-source sums are shuffled; the rates come back as a counted lookup
    (``small_lookup``), so a source holding a third of all rows stays where it
    is. Null or wordless text has size 0; a null source is a source of its
    own; repeated ids draw alike; an empty table stays empty. ``docs`` must not
    have columns of these four names (``mix`` takes any)."""
    sized = docs.withColumn("_size", word_count(F.col(text_col)))
    slim = docs.select(F.col(source_col).alias("_src"), word_count(F.col(text_col)).alias("_n"))
    rates = source_rates(slim, "_src", "_n", weights, max_rate).select(
        F.col("source").alias(source_col), F.col("source_size").alias("_source_size"),
        F.col("target").alias("_target"), F.col("rate").alias("_rate"))
    out = small_lookup(sized, rates, [source_col], salt_by=F.col(id_col))
    extra = unit_hash(F.col(id_col), seed) < F.col("_rate") - F.floor("_rate")
    return out.withColumn("_copies", (F.floor("_rate") + extra.cast("long")).cast("long")).drop("_rate")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as its copies say, same
    columns (whatever their names)."""
    plain = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    copied = with_copies(docs.toDF(*plain.values()), plain[id_col], plain[text_col], plain[source_col], **options)
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))
    return copied.filter("_copies > 0").select(*plain.values(), each.alias("_copy")).drop("_copy").toDF(*docs.columns)
