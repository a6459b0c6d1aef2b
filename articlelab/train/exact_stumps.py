"""Exact decision stumps for SAMME boosting (M10): every distinct value is a cut.

Features are laid out by column once: the distinct values of a feature, sorted,
in ranges ("shards") of about ``SHARD_ROWS`` rows each, one written row per
(feature, shard). A round tries all cuts between neighbouring values:

1. class weights of every (feature, shard), summed over the partitions, and
   their running sums over the shards before (the prefix scan; left out when
   each feature has one shard);
2. every partition folds its rows' weights by (feature, value, class), each
   shard adds them up along its sorted values, starts from its prefix, and
   reports its best cut; the best of all is the stump.

Row weights follow from the stumps so far (``weights``), so nothing but the
column layout is ever stored. A value that a third of all rows share is one
entry per fold of a partition, not a row of its own; a shard's task holds the
distinct values of its range, whatever the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from articlelab.session import materialize
from articlelab.train.samme import LEARNING_RATE, N_ROUNDS, HistSammeModel, Stump

# Rows of a feature whose values one task lays out and searches.
SHARD_ROWS = 200_000
# Rows that a partition folds before it hands entries on.
FOLD_ROWS = 100_000
# Impurities and class weights that agree to so many digits are equal; the lower
# feature, cut and class win.
TIE_DIGITS = 12


def weights(x: np.ndarray, y: np.ndarray, stumps: list[tuple], alphas: list[float], shift: float) -> np.ndarray:
    """Weight of each row after the rounds so far, in units of exp(shift)."""
    score = np.full(len(y), -shift)
    for (f, cut, left, right), a in zip(stumps, alphas, strict=True):
        score += a * (np.where(x[:, f] <= cut, left, right) != y)
    return np.exp(score)


def _rows(batches: Iterator[pa.RecordBatch], width: int, at_least: int = FOLD_ROWS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (x, y) in lots of ``at_least`` or more; the last lot is what is left."""
    xs, ys, n = [], [], 0
    for b in batches:
        if b.num_rows:
            xs.append(b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, width))
            ys.append(b.column(1).to_numpy(zero_copy_only=False).astype(np.int64))
            n += b.num_rows
        if n >= at_least:
            yield np.concatenate(xs), np.concatenate(ys)
            xs, ys, n = [], [], 0
    if n:
        yield np.concatenate(xs), np.concatenate(ys)


def best_cut(hist: np.ndarray, before: np.ndarray, total: np.ndarray, values: np.ndarray, after: float | None) -> tuple | None:
    """Best Gini cut of a range of sorted ``values`` with class weights ``hist``.

    ``before`` / ``total``: class weights of all smaller values / of the feature;
    ``after``: the feature's next value beyond the range. Returns (impurity,
    cut, left class, right class, weight misjudged), cut halfway to the next
    value; None where there is none."""
    left = before + np.cumsum(hist, axis=0)
    following = np.append(values[1:], np.nan if after is None else after)
    left, cuts, following = (a[~np.isnan(following)] for a in (left, values, following))
    if not len(cuts):
        return None
    right = np.maximum(total - left, 0)
    whole, nl, nr = total.sum(), left.sum(axis=1), right.sum(axis=1)
    with np.errstate(all="ignore"):
        impurity = 1 - ((left ** 2).sum(axis=1) / nl + (right ** 2).sum(axis=1) / nr) / whole
    impurity = np.where((nl > 0) & (nr > 0), impurity, np.inf)
    i = int(np.argmin(np.round(impurity, TIE_DIGITS)))
    if not math.isfinite(impurity[i]):
        return None
    cut = (cuts[i] + following[i]) / 2
    cut = cut if cuts[i] <= cut < following[i] else cuts[i]  # neighbouring doubles
    return (float(impurity[i]), float(cut), int(np.argmax(np.round(left[i], TIE_DIGITS))), int(np.argmax(np.round(right[i], TIE_DIGITS))),
            float(whole - left[i].max() - right[i].max()))


def _splitters(data: DataFrame, width: int, shards: int) -> list[np.ndarray]:
    """First values of the second and later shards of each feature (approximate
    quantiles: they only shape the shards)."""
    if shards <= 1:
        return [np.zeros(0)] * width
    at = [i / shards for i in range(1, shards)]
    rows = data.select(F.posexplode("x").alias("f", "v")).groupBy("f").agg(F.percentile_approx("v", at, 10 * shards).alias("t")).collect()
    cut = {r["f"]: np.unique(np.asarray(r["t"], dtype=np.float64)) for r in rows}
    return [cut[f] for f in range(width)]


def _columns(data: DataFrame, width: int, splitters) -> DataFrame:
    """``f, shard, vals`` (sorted distinct values, packed), ``following`` (first value of
    the next shard of the feature, or null)."""
    def distinct(batches):
        for x, _ in _rows(batches, width):
            out = []
            for f in range(width):
                v = np.unique(x[:, f])
                at = np.searchsorted(splitters.value[f], v, side="right")
                out += [(f, int(s), v[at == s].tobytes()) for s in np.unique(at)]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int32()),
                                              pa.array([o[2] for o in out], pa.binary())], names=["f", "shard", "vals"])

    def merge(t: pa.Table) -> pa.Table:
        v = np.unique(np.concatenate([np.frombuffer(b) for b in t.column("vals").to_pylist()]))
        return pa.table({"f": t.column("f").slice(0, 1), "shard": t.column("shard").slice(0, 1),
                         "vals": pa.array([v.tobytes()], pa.binary()), "lowest": pa.array([v[0]], pa.float64())})

    laid = materialize(data.mapInArrow(distinct, "f int, shard int, vals binary").groupBy("f", "shard").applyInArrow(
        merge, "f int, shard int, vals binary, lowest double"), "stump-columns")
    following = laid.select("f", "shard", F.lead("lowest").over(Window.partitionBy("f").orderBy("shard")).alias("following"))
    return laid.drop("lowest").join(following, ["f", "shard"])


def _entries(data: DataFrame, width: int, k: int, splitters, so_far) -> DataFrame:
    """``f, shard, vals, cells``: weights by (value, class) of every lot of rows,
    packed: distinct values, and a (values x classes) table."""
    def fold(batches):
        stumps, alphas, shift = so_far.value
        for x, y in _rows(batches, width):
            w = weights(x, y, stumps, alphas, shift)
            f_, s_, v_, c_ = [], [], [], []
            for f in range(width):
                v, inverse = np.unique(x[:, f], return_inverse=True)
                cells = np.bincount(inverse * k + y, w, len(v) * k).reshape(len(v), k)
                edges = np.concatenate([[0], np.searchsorted(v, splitters.value[f], side="left"), [len(v)]])
                for s in np.flatnonzero(np.diff(edges)):
                    f_.append(f)
                    s_.append(s)
                    v_.append(v[edges[s]:edges[s + 1]].tobytes())
                    c_.append(cells[edges[s]:edges[s + 1]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(f_, pa.int32()), pa.array(s_, pa.int32()), pa.array(v_, pa.binary()),
                                              pa.array(c_, pa.binary())], names=["f", "shard", "v", "cells"])

    return data.mapInArrow(fold, "f int, shard int, v binary, cells binary")


def _prefixes(data: DataFrame, width: int, k: int, splitters, so_far) -> DataFrame:
    """``f, shard, before, total``: class weights of the shards before, and of the feature."""
    def totals(batches):
        stumps, alphas, shift = so_far.value
        acc = [np.zeros((len(splitters.value[f]) + 1, k)) for f in range(width)]
        for x, y in _rows(batches, width, 1):
            w = weights(x, y, stumps, alphas, shift)
            for f in range(width):
                at = np.searchsorted(splitters.value[f], x[:, f], side="right")
                acc[f] += np.bincount(at * k + y, w, acc[f].size).reshape(-1, k)
        for f in range(width):
            keep = np.flatnonzero(acc[f].any(axis=1))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(f, len(keep) * k), pa.int32()), pa.array(np.repeat(keep, k), pa.int32()),
                pa.array(np.tile(np.arange(k), len(keep)), pa.int32()), pa.array(acc[f][keep].ravel())], names=["f", "shard", "c", "w"])

    sums = data.mapInArrow(totals, "f int, shard int, c int, w double").groupBy("f", "shard", "c").agg(F.sum("w").alias("w"))
    column = Window.partitionBy("f", "c")
    run = sums.select("f", "shard", "c", F.sum("w").over(column).alias("total"),
                      F.coalesce(F.sum("w").over(column.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("before"))
    ordered = F.array_sort(F.collect_list(F.struct("c", "before", "total")))
    return run.groupBy("f", "shard").agg(ordered.alias("p")).select("f", "shard", F.col("p.before").alias("before"), F.col("p.total").alias("total"))


def _best_cuts(columns: DataFrame, entries: DataFrame, k: int) -> DataFrame:
    """Best cut of every (feature, shard)."""
    out = "f int, impurity double, cut double, left_class int, right_class int, bad double, total double"
    names = [c.split()[0] for c in out.split(", ")]

    def search(key, layout: pa.Table, folded: pa.Table) -> pa.Table:
        if not layout.num_rows or not folded.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, KINDS, strict=True)})
        values = np.frombuffer(layout.column("vals")[0].as_py())
        hist = np.zeros((len(values), k))
        for v, c in zip(folded.column("v"), folded.column("cells"), strict=True):
            v = np.frombuffer(v.as_py())
            hist[np.searchsorted(values, v)] += np.frombuffer(c.as_py()).reshape(len(v), k)
        if "before" in layout.column_names:
            before, total = (np.array(layout.column(n)[0].as_py()) for n in ("before", "total"))
        else:
            before, total = np.zeros(k), hist.sum(axis=0)
        found = best_cut(hist, before, total, values, layout.column("following")[0].as_py())
        rows = [] if found is None else [(key[0].as_py(), *found, float(total.sum()))]
        return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(names, KINDS, strict=True))})

    return columns.groupBy("f", "shard").cogroup(entries.groupBy("f", "shard")).applyInArrow(search, out)


KINDS = (pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.float64(), pa.float64())


def usable(features: str, width: Column) -> Column:
    """Condition: the vector has the table's width and finite entries only."""
    bad = F.exists(features, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    return F.col(features).isNotNull() & (F.size(features) == width) & ~bad


def fit_exact(train: DataFrame, n_classes: int, n_rounds: int = N_ROUNDS, learning_rate: float = LEARNING_RATE,
              features: str = "features", label: str = "label", shard_rows: int = SHARD_ROWS) -> HistSammeModel:
    """SAMME with exact stumps (see module doc) on rows (``features``
    ARRAY<DOUBLE>, ``label`` 0..K-1).

    A cut lies halfway between neighbouring values; of equally good ones the
    lowest feature, then the lowest cut wins. Vectors must be finite and of one
    width, else ValueError. Stops as the histogram learner does: after a
    perfect stump, and before one that is no better than chance."""
    data = materialize(train.select(F.col(features).cast("array<double>").alias("x"), F.col(label).cast("int").alias("y")), "stump-rows")
    width = data.agg(F.max(F.size("x"))).first()[0]
    if not width or width < 0:
        raise ValueError("no rows to train on")
    n, good = data.agg(F.count(F.lit(1)), F.count(F.when(usable("x", F.lit(width)) & F.col("y").between(0, n_classes - 1), 1))).first()
    if good < n:
        raise ValueError(f"{n - good} of {n} rows have no finite vector of width {width} or no label below {n_classes}")
    sc, k = data.sparkSession.sparkContext, n_classes
    splitters = sc.broadcast(_splitters(data, width, -(-n // shard_rows)))
    columns = materialize(_columns(data, width, splitters), "stump-columns")
    sharded = any(len(s) for s in splitters.value)
    model = HistSammeModel(n_classes=k)
    stumps, shift = [], 0.0
    for _ in range(n_rounds):
        so_far = sc.broadcast((list(stumps), list(model.alphas), shift))
        layout = columns.join(materialize(_prefixes(data, width, k, splitters, so_far), "stump-prefixes"), ["f", "shard"]) if sharded else columns
        found = _best_cuts(layout, _entries(data, width, k, splitters, so_far), k)
        win = found.orderBy(F.round("impurity", TIE_DIGITS), "f", "cut").first()
        so_far.unpersist()
        if win is None:         # one value everywhere: nothing to separate
            break
        err = max(float(win["bad"] / win["total"]), 0.0)
        if err >= 1.0 - 1.0 / k:
            if not model.stumps:
                raise ValueError("the first stump is no better than chance")
            break
        model.stumps.append(Stump(win["f"], win["cut"], win["left_class"], win["right_class"]))
        model.errors.append(err)
        stumps.append((win["f"], win["cut"], win["left_class"], win["right_class"]))
        shift += math.log(win["total"])
        if err <= 1e-15:
            model.alphas.append(1.0)
            break
        model.alphas.append(learning_rate * (math.log((1.0 - err) / err) + math.log(k - 1.0)))
    return model
