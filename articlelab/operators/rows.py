"""Row-expansion helper shared by the text operators."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_rows(df: DataFrame, keep: Sequence[str], arr: Column | str, name: str = "token",
                 pos: str | None = None) -> DataFrame:
    """Inner explode of an (expensive) array expression.

    A plain ``explode`` makes the optimizer infer a ``size(arr) > 0``
    filter and push it below the projection, which evaluates a tokenizer
    twice per row. ``explode_outer`` gets no inferred filter; the null row
    it emits for an empty array is removed after the generator instead.
    Arrays here never hold null elements (tokens, sentences).
    """
    a = F.col(arr) if isinstance(arr, str) else arr
    if pos:
        out = df.select(*keep, F.posexplode_outer(a).alias(pos, name))
    else:
        out = df.select(*keep, F.explode_outer(a).alias(name))
    return out.where(F.col(name).isNotNull())


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Give CPU-heavy per-row work (tokenising long texts) enough tasks.

    A single large row group or an unsplittable multi-line CSV file arrives
    as one or a few partitions, so a tokeniser would run on one core. When
    the input has fewer partitions than twice the default parallelism, it
    is round-robin repartitioned (Spark sorts before a round-robin
    repartition, so a retried task gets the same rows). Large inputs with
    many splits are returned unchanged: no extra shuffle at scale.
    """
    try:
        target = min_partitions or df.sparkSession.sparkContext.defaultParallelism * 2
        n = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - sessions without RDD access (Spark Connect)
        return df
    return df.repartition(target) if n < target else df
