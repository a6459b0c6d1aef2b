"""Evaluation metrics over scored rows.

Everything is a hash aggregate with map-side partial aggregation: rows ->
(group, batch) partials -> group totals. Confusion matrices are kept in
long form ``(keys, true_label, pred_label, n)``; dense grids and nested maps
are derived from it and are bounded by the number of classes, not rows.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from articlelab.functions.vectors import argmax, cross_entropy, softmax
from articlelab.session import materialize


def score_rows(df: DataFrame, logits: str = "logits", label: str = "label",
               output: str = "logits") -> DataFrame:
    """H1/H2 + row loss: ``pred`` (first argmax), ``p_max`` (softmax of the
    winner), ``loss`` (cross-entropy) and ``correct``. ``output='reference'``
    applies the loss to softmax outputs, as the reference's networks do
    (softmax twice, Q16)."""
    z = F.col(logits)
    staged = df.withColumn("_m", F.array_max(z))
    if output == "reference":
        staged = staged.withColumn("_p", softmax(z, "_m"))
        loss = cross_entropy("_p", label)
    else:
        loss = cross_entropy(z, label, "_m")
    return (staged.withColumn("pred", argmax(z))
                  .withColumn("p_max", F.lit(1.0) / F.aggregate(
                      z, F.lit(0.0), lambda acc, x: acc + F.exp(x - F.col("_m"))))
                  .withColumn("loss", loss)
                  .withColumn("correct", (F.col("pred") == F.col(label)).cast("bigint"))
                  .drop("_m", "_p"))


def batch_losses(scored: DataFrame, keys: Sequence[str], batch: str = "batch_id") -> DataFrame:
    """Per (keys, batch): rows, correct, summed and mean loss."""
    return scored.groupBy(*keys, batch).agg(
        F.count(F.lit(1)).cast("bigint").alias("n"),
        F.sum("correct").cast("bigint").alias("correct"),
        F.sum("loss").alias("sum_loss"),
        F.avg("loss").alias("mean_loss"))


def epoch_metrics(scored: DataFrame, keys: Sequence[str], batch: str = "batch_id") -> DataFrame:
    """E10 + E11 + E16 + M11 in one pass: per keys, rows, correct,
    accuracy, ``loss`` = mean of batch means (Q9, as the reference) and
    ``row_loss`` = plain mean."""
    b = batch_losses(scored, keys, batch)
    return b.groupBy(*keys).agg(
        F.sum("n").cast("bigint").alias("n"),
        F.sum("correct").cast("bigint").alias("correct"),
        (F.sum("correct") / F.sum("n")).alias("accuracy"),
        F.avg("mean_loss").alias("loss"),
        (F.sum("sum_loss") / F.sum("n")).alias("row_loss"))


def confusion(scored: DataFrame, keys: Sequence[str], label: str = "label",
              pred: str = "pred") -> DataFrame:
    """``(keys, true_label, pred_label, n)``."""
    return scored.groupBy(*keys, F.col(label).cast("bigint").alias("true_label"),
                          F.col(pred).cast("bigint").alias("pred_label")).agg(
        F.count(F.lit(1)).cast("bigint").alias("n"))


def label_set(conf: DataFrame) -> DataFrame:
    """``label``: the labels seen as true or predicted."""
    return (conf.select(F.col("true_label").alias("label"))
            .unionByName(conf.select(F.col("pred_label").alias("label"))).distinct())


def dense_confusion(conf: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Zero-filled K x K grid per keys, integer label order, the full
    label set on both axes (Q10). The long counts are written once, so the
    scored rows are read once; the K labels sit in one array, which each of
    the (few) keys expands twice: the K^2 rows are the result itself."""
    conf = materialize(conf, "confusion")
    labels = label_set(conf).agg(F.sort_array(F.collect_list("label")).alias("_l")).withColumn("_g", F.lit(0))
    grid = (conf.select(*keys).distinct().withColumn("_g", F.lit(0)).join(F.broadcast(labels), "_g").drop("_g")
            .withColumn("true_label", F.explode("_l")).withColumn("pred_label", F.explode("_l")).drop("_l"))
    return (grid.join(conf, on=[*keys, "true_label", "pred_label"], how="left")
            .withColumn("n", F.coalesce(F.col("n"), F.lit(0).cast("bigint"))))


def at_epoch(conf: DataFrame, epoch: int | None, group: Sequence[str] = (),
             strict: bool = False) -> DataFrame:
    """Rows of the chosen epoch; unset -> the last epoch; beyond the
    last -> the last (lenient path) or a failed job (strict path)."""
    if group:
        df = conf.withColumn("_last", F.max("epoch").over(Window.partitionBy(*group)))
    else:   # one scalar: the last epoch overall
        df = conf.withColumn("_last", F.lit(conf.agg(F.max("epoch")).first()[0]))
    if epoch is None:
        chosen = F.col("_last")
    elif strict:
        chosen = F.when((F.lit(epoch) >= 1) & (F.lit(epoch) <= F.col("_last")), F.lit(epoch)).otherwise(
            F.raise_error(F.concat(F.lit(f"no epoch {epoch}: the run has "), F.col("_last").cast("string"))))
    else:
        chosen = F.least(F.lit(epoch), F.col("_last"))
    return df.where(F.col("epoch") == chosen).drop("_last")


def label_pairs(conf: DataFrame, keys: Sequence[str], expand: bool = False) -> DataFrame:
    """Confusion counts as (true, predicted) pairs; counts stay weights
    (``n``) unless ``expand`` asks for one row per counted sample."""
    pairs = conf.select(*keys, "true_label", "pred_label", "n")
    if not expand:
        return pairs
    return pairs.select(*keys, "true_label", "pred_label",
                        F.explode(F.sequence(F.lit(1), F.col("n"))).alias("_i")).drop("_i")


def weighted_f1(conf: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Support-weighted F1 per keys, from counts (no row
    expansion). Per class: f1 = 2 tp / (support + predicted)."""
    roles = conf.select(*keys, F.explode(F.array(
        F.struct(F.col("true_label").alias("c"), F.col("n").alias("sup"), F.lit(0).cast("bigint").alias("prd"),
                 F.when(F.col("true_label") == F.col("pred_label"), F.col("n")).otherwise(F.lit(0))
                 .cast("bigint").alias("tp")),
        F.struct(F.col("pred_label").alias("c"), F.lit(0).cast("bigint").alias("sup"), F.col("n").alias("prd"),
                 F.lit(0).cast("bigint").alias("tp")))).alias("r")).select(*keys, "r.*")
    per_class = roles.groupBy(*keys, "c").agg(F.sum("sup").alias("sup"), F.sum("prd").alias("prd"),
                                             F.sum("tp").alias("tp"))
    f1 = F.when(F.col("sup") + F.col("prd") > 0,
                F.lit(2.0) * F.col("tp") / (F.col("sup") + F.col("prd"))).otherwise(F.lit(0.0))
    return per_class.groupBy(*keys).agg(
        (F.sum(f1 * F.col("sup")) / F.sum("sup")).alias("f1"),
        F.sum("sup").cast("bigint").alias("n"))


def final_values(metrics: DataFrame, keys: Sequence[str], cols: Sequence[str],
                 order: str = "epoch") -> DataFrame:
    """Value of each metric at the last ``order`` per keys."""
    return metrics.groupBy(*keys).agg(
        F.max(order).alias(order), *[F.max_by(c, order).alias(c) for c in cols])
