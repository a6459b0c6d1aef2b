"""AdaBoost SAMME with decision stumps.

Two stump learners:

* ``fit_hist`` (default): features are binned once by approximate
  quantiles over all rows; each round is **one** job (:func:`boost`): class
  histograms per feature, summed and searched for the best Gini split by one
  task per 64 features. Weights are never stored, so lineage does not grow with
  rounds.
* ``fit`` (MLlib): the loop below with ``DecisionTreeClassifier``.

Each round fits Spark ML's ``DecisionTreeClassifier(maxDepth=1)`` on the
weighted training rows, measures the weighted error with one aggregate,
re-weights the rows (``w * exp(alpha * miss)``, normalised; the new total
follows from the error, so no second pass) and cuts the lineage every
``CUT_EVERY`` rounds by writing the weighted rows to the shared checkpoint
folder, so a lost executor recomputes at most that many rounds. The vote is the argmax
of the summed ``alpha`` per class, evaluated JVM-side.

Stump split points come from Spark's binned features (``maxBins``), so
they approximate exact-split stumps.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from articlelab.session import ensure_checkpoint_dir, materialize

# Defaults of the reference's boosting call (library defaults).
N_ROUNDS = 50
LEARNING_RATE = 1.0
# Features whose histograms one task sums and searches.
FEATURES_A_TASK = 64
# Rounds between lineage cuts (a lost executor recomputes at most this many).
CUT_EVERY = 5


@dataclass
class SammeModel:
    stumps: list = field(default_factory=list)
    alphas: list[float] = field(default_factory=list)
    errors: list[float] = field(default_factory=list)
    n_classes: int = 2

    def decision(self, df: DataFrame, features: str = "features") -> DataFrame:
        """Add ``pred`` = argmax of the summed alpha per class."""
        x = df.withColumn("_fv", array_to_vector(features))
        cols = []
        for m, stump in enumerate(self.stumps):
            stump = stump.copy()
            stump.setFeaturesCol("_fv").setPredictionCol(f"_p{m}").setRawPredictionCol(f"_raw{m}") \
                .setProbabilityCol(f"_prob{m}")
            x = stump.transform(x).drop(f"_raw{m}", f"_prob{m}")
            cols.append(f"_p{m}")
        preds = F.array(*[F.col(c) for c in cols])
        alphas = F.array(*[F.lit(float(a)) for a in self.alphas])
        pairs = F.arrays_zip(preds.alias("p"), alphas.alias("a"))
        votes = F.transform(F.sequence(F.lit(0), F.lit(self.n_classes - 1)), lambda k: F.aggregate(
            pairs, F.lit(0.0), lambda acc, e: acc + F.when(e["p"] == k, e["a"]).otherwise(F.lit(0.0))))
        x = x.withColumn("_votes", votes)
        pred = (F.array_position("_votes", F.array_max("_votes")) - 1).cast("int")
        return x.withColumn("pred", pred).drop("_fv", "_votes", *cols)


def fit(train: DataFrame, n_classes: int, n_rounds: int = N_ROUNDS, learning_rate: float = LEARNING_RATE,
        features: str = "features", label: str = "label", seed: int = 42, max_bins: int = 32) -> SammeModel:
    """Fit SAMME on ``train`` (features ARRAY<DOUBLE>, label 0..K-1)."""
    from pyspark.ml.classification import DecisionTreeClassifier
    ensure_checkpoint_dir(train.sparkSession)
    n = train.count()
    data = (train.select(array_to_vector(features).alias("fv"), F.col(label).cast("double").alias("y"))
            .withColumn("w", F.lit(1.0 / n)))
    data = materialize(data, "samme-weights")
    model = SammeModel(n_classes=n_classes)
    for m in range(n_rounds):
        dt = DecisionTreeClassifier(maxDepth=1, featuresCol="fv", labelCol="y", weightCol="w",
                                    predictionCol="p", maxBins=max_bins, seed=seed + m)
        stump = dt.fit(data)
        scored = stump.transform(data).select("fv", "y", "w", (F.col("p") != F.col("y")).alias("miss"))
        agg = scored.agg(F.sum(F.when(F.col("miss"), F.col("w")).otherwise(F.lit(0.0))).alias("bad"),
                         F.sum("w").alias("tot")).first()
        err = float(agg["bad"]) / float(agg["tot"])
        if err <= 0.0:          # perfect stump: keep it, stop
            model.stumps.append(stump)
            model.alphas.append(1.0)
            model.errors.append(err)
            break
        if err >= 1.0 - 1.0 / n_classes:   # no better than chance: stop
            if not model.stumps:
                raise ValueError("the first stump is no better than chance")
            break
        alpha = learning_rate * (math.log((1.0 - err) / err) + math.log(n_classes - 1.0))
        model.stumps.append(stump)
        model.alphas.append(alpha)
        model.errors.append(err)
        # new total weight follows from err and alpha: tot * ((1 - err) + err * e^alpha)
        total = float(agg["tot"]) * ((1.0 - err) + err * math.exp(alpha))
        data = scored.select("fv", "y", (F.col("w") * F.exp(F.when(F.col("miss"), F.lit(alpha))
                                                             .otherwise(F.lit(0.0))) / F.lit(total)).alias("w"))
        if (m + 1) % CUT_EVERY == 0:
            data = materialize(data, "samme-weights")
    return model


@dataclass
class Stump:
    feature: int
    threshold: float
    left: int
    right: int


@dataclass
class HistSammeModel:
    stumps: list[Stump] = field(default_factory=list)
    alphas: list[float] = field(default_factory=list)
    errors: list[float] = field(default_factory=list)
    n_classes: int = 2

    def decision(self, df: DataFrame, features: str = "features") -> DataFrame:
        """``pred`` = argmax of summed alpha per class; JVM expressions only."""
        votes = F.array(*[F.lit(0.0)] * self.n_classes) if not self.stumps else None
        preds = [F.when(F.col(features)[s.feature] <= F.lit(s.threshold), F.lit(s.left))
                 .otherwise(F.lit(s.right)) for s in self.stumps]
        if preds:
            pairs = F.arrays_zip(F.array(*preds).alias("p"),
                                 F.array(*[F.lit(float(a)) for a in self.alphas]).alias("a"))
            votes = F.transform(F.sequence(F.lit(0), F.lit(self.n_classes - 1)), lambda k: F.aggregate(
                pairs, F.lit(0.0), lambda acc, e: acc + F.when(e["p"] == k, e["a"]).otherwise(F.lit(0.0))))
        x = df.withColumn("_votes", votes)
        pred = (F.array_position("_votes", F.array_max("_votes")) - 1).cast("int")
        return x.withColumn("pred", pred).drop("_votes")


def fit_hist(train: DataFrame, n_classes: int, n_rounds: int = N_ROUNDS,
             learning_rate: float = LEARNING_RATE, features: str = "features", label: str = "label",
             max_bins: int = 32, accuracy: int = 10_000) -> HistSammeModel:
    """SAMME with histogram stumps (see module doc). ``max_bins`` bounds the
    thresholds tried per feature: with as many bins as distinct values the
    stumps are exact."""
    data = train.select(F.col(features).alias("x"), F.col(label).cast("int").alias("y"))
    probs = [i / max_bins for i in range(1, max_bins)]
    q = (data.select(F.posexplode("x").alias("f", "v")).groupBy("f")
         .agg(F.percentile_approx("v", probs, accuracy).alias("t")).collect())
    if not q:
        raise ValueError("no rows to train on")
    # thresholds per feature (bounded: features x (bins - 1)), distinct and sorted
    thr = [np.unique(np.asarray(r.t, dtype=np.float64)) for r in sorted(q, key=lambda r: r.f)]
    return boost(data, thr, n_classes, n_rounds, learning_rate)


def boost(data: DataFrame, thr: list[np.ndarray], n_classes: int, n_rounds: int = N_ROUNDS,
          learning_rate: float = LEARNING_RATE) -> HistSammeModel:
    """Boosting rounds over ``data`` (x ARRAY<DOUBLE>, y) and given thresholds.

    Rows are binned and written once. A round is one job: every partition
    recomputes its rows' weights from the stumps so far and emits one weighted
    class histogram per feature; those of ``FEATURES_A_TASK`` features are
    summed and searched for their best splits by one task; one row per feature
    returns. Weights are kept in units of the last round's total, so they stay
    finite."""
    spark, d, k = data.sparkSession, len(thr), n_classes
    n_bins = max(len(t) for t in thr) + 1
    thresholds = spark.sparkContext.broadcast(thr)

    def bins(batches):
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["x"].to_numpy()).astype(np.float64)
                b = np.stack([np.searchsorted(t, x[:, f], side="left") for f, t in enumerate(thresholds.value)], axis=1)
                yield pd.DataFrame({"b": list(b.astype(np.int32)), "y": pdf["y"]})

    binned = materialize(data.mapInPandas(bins, "b array<int>, y int"), "binned-rows")
    levels = math.isqrt(max(binned.rdd.getNumPartitions() - 1, 0)) + 1
    model = HistSammeModel(n_classes=k)
    cuts: list[tuple[int, int, int, int]] = []
    log_total = 0.0
    for _ in range(n_rounds):
        so_far = spark.sparkContext.broadcast((list(cuts), np.asarray(model.alphas), log_total))

        def partial(batches, so_far=so_far):
            stumps, alphas, shift = so_far.value
            acc = np.zeros(d * n_bins * k)
            for pdf in batches:
                if pdf.empty:
                    continue
                b, y = np.stack(pdf["b"].to_numpy()), pdf["y"].to_numpy()
                w = np.full(len(y), np.exp(-shift))
                if stumps:
                    miss = np.stack([np.where(b[:, f] <= s, left, right) != y for f, s, left, right in stumps], axis=1)
                    w = np.exp(miss @ alphas - shift)
                cell = (np.arange(d) * n_bins + b) * k + y[:, None]
                acc += np.bincount(cell.ravel(), np.repeat(w, d), len(acc))
            if acc.any():
                acc = acc.reshape(d, -1)
                for g, at in enumerate(range(0, d, FEATURES_A_TASK)):
                    yield pd.DataFrame({"p": [TaskContext.get().partitionId()], "g": [g], "h": [acc[at:at + FEATURES_A_TASK].tobytes()]})

        def summed(pdf):
            total = sum(np.frombuffer(h) for h in pdf["h"])
            return pd.DataFrame({"p": pdf["p"].iloc[:1], "g": pdf["g"].iloc[:1], "h": [total.tobytes()]})

        def best(pdf):
            first = int(pdf["g"].iloc[0]) * FEATURES_A_TASK
            hists = sum(np.frombuffer(h) for h in pdf["h"]).reshape(-1, n_bins, k)
            rows = [(first + f, *best_split(h)) for f, h in enumerate(hists)]
            return pd.DataFrame(rows, columns=["f", "impurity", "s", "left", "right", "bad", "total"])

        parts = binned.mapInPandas(partial, "p int, g int, h binary")
        if levels > 1:     # in two levels: no task adds up more than about the root of the partitions
            parts = parts.groupBy("g", F.pmod("p", F.lit(levels)).alias("level")).applyInPandas(summed, "p int, g int, h binary")
        found = (parts.groupBy("g")
                 .applyInPandas(best, "f int, impurity double, s int, left int, right int, bad double, total double").collect())
        so_far.unpersist()
        usable = sorted((r for r in found if np.isfinite(r.impurity)), key=lambda r: r.f)
        if not usable:          # no split separates anything
            break
        win = usable[0]
        for r in usable[1:]:
            if r.impurity < win.impurity - 1e-15:
                win = r
        err = float(win.bad / win.total)
        stump = Stump(win.f, float(thr[win.f][win.s]) if win.s < len(thr[win.f]) else float("inf"), win.left, win.right)
        if err >= 1.0 - 1.0 / k:
            if not model.stumps:
                raise ValueError("the first stump is no better than chance")
            break
        model.stumps.append(stump)
        model.errors.append(max(err, 0.0))
        cuts.append((win.f, win.s, win.left, win.right))
        log_total += math.log(win.total)
        if err <= 0.0:
            model.alphas.append(1.0)
            break
        model.alphas.append(learning_rate * (math.log((1.0 - err) / err) + math.log(k - 1.0)))
    return model


def best_split(hist: np.ndarray) -> tuple[float, int, int, int, float, float]:
    """Best Gini split of a feature's (bins x classes) weight histogram:
    (impurity, last bin of the left side, left class, right class, weight
    misjudged, total weight); impurity inf when nothing is separated."""
    every = hist.sum(axis=0)
    total = float(every.sum())
    left = np.cumsum(hist, axis=0)[:-1]
    if not len(left):
        return math.inf, 0, 0, 0, 0.0, total
    right = every - left
    nl, nr = left.sum(axis=1), right.sum(axis=1)
    both = (nl > 0) & (nr > 0)
    # n * gini = n - (sum of squares) / n, per side
    impurity = np.full(len(left), math.inf)
    impurity[both] = 1.0 - ((left[both] ** 2).sum(axis=1) / nl[both] + (right[both] ** 2).sum(axis=1) / nr[both]) / total
    s = int(np.argmin(impurity))
    return (float(impurity[s]), s, int(np.argmax(left[s])), int(np.argmax(right[s])),
            float(total - left[s].max() - right[s].max()), total)


def save_stumps(spark, model: HistSammeModel, path: str) -> None:
    """One parquet row per stump, in order, with its vote."""
    rows = [(i, m.feature, m.threshold, m.left, m.right, a, e, model.n_classes)
            for i, (m, a, e) in enumerate(zip(model.stumps, model.alphas, model.errors, strict=True))]
    spark.createDataFrame(rows, "round int, feature int, threshold double, left int, right int, alpha double, "
                                "error double, n_classes int").write.mode("overwrite").parquet(path)


def load_stumps(spark, path: str) -> HistSammeModel:
    rows = sorted(spark.read.parquet(path).collect(), key=lambda r: r["round"])
    return HistSammeModel([Stump(r["feature"], r["threshold"], r["left"], r["right"]) for r in rows],
                          [r["alpha"] for r in rows], [r["error"] for r in rows], rows[0]["n_classes"] if rows else 2)
