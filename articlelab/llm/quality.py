"""Quality classifier: random Fourier features, ridge scores, isotonic calibration."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from articlelab.llm.common import materialize

#: Fourier features, ridge penalty, folds of the out-of-fold scores, calibration bins.
FOURIER, RIDGE, FOLDS, BINS = 256, 1.0, 3, 2000
#: Kernel width in units of the square root of the number of statistics.
BANDWIDTH = 0.7
THRESHOLD = 0.7

_CLASS = np.zeros(256, np.int64)  # 0 other ASCII
for _i, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\v\f",
                             b".,;:?'\"()-", b"!", b"|", b"#$%&*@^~<>{}[]\\/=+_`"), start=1):
    _CLASS[list(_chars)] = _i
_CLASS[128:] = 9
_SYMBOLS = frozenset(b"#$%&*@^~<>{}[]\\/=+_`|!")
STATISTICS = 27


def statistics(text: bytes | None) -> list[float]:
    """``STATISTICS`` numbers of a whole UTF-8 text: sizes, shares of kinds of
    characters, word and line shapes, repetition. Null counts as empty."""
    text = text or b""
    n = len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    shares = np.bincount(_CLASS, counts, 10) / max(1, n)
    p = counts[counts > 0] / max(1, n)
    words = text.split()
    w = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    seen = Counter(words)
    lines = [x for x in text.split(b"\n") if x]
    ends = sum(x[-1] in _SYMBOLS for x in words)
    pairs = len(set(zip(words, words[1:])))
    stops = counts[ord(".")] + counts[ord("!")] + counts[ord("?")]
    no_space = counts.copy()
    no_space[32] = 0
    return [math.log1p(n), math.log1p(len(words)), float(sizes.mean()), float(sizes.std()), float(sizes.max()) ** 0.5,
            *shares.tolist(), float(-(p * np.log2(p)).sum()), len(seen) / w, len(seen) / math.sqrt(w),
            max(seen.values(), default=0) / w, ends / w, pairs / max(1, w - 1), math.log1p(n / max(1, len(lines))),
            1 - len(set(lines)) / max(1, len(lines)), math.log1p(w / (1 + int(stops))), float(no_space.max()) / max(1, n),
            float((sizes <= 2).mean()), 1.0 if not words else 0.0]


@dataclass
class QualityModel:
    """Everything a score needs; a few hundred kilobytes whatever the corpus."""

    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    beta: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def fourier(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([np.cos(z @ self.omega + self.phase) * math.sqrt(2 / len(self.phase)), np.ones((len(z), 1))], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated scores, strictly inside (0, 1), never falling with the ridge score."""
        raw = self.fourier(x) @ self.beta
        return 0.99 * np.interp(raw, self.knots, self.levels) + 0.01 / (1 + np.exp(-4 * (raw - 0.5)))


def pool_adjacent(count: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Isotonic regression of positive / count over ordered bins (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for c, p in zip(count, positive, strict=True):
        blocks.append([p / c, c, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, c2, k = blocks.pop()
            blocks[-1] = [(blocks[-1][0] * blocks[-1][1] + v * c2) / (blocks[-1][1] + c2), blocks[-1][1] + c2, blocks[-1][2] + k]
    return np.concatenate([np.full(int(k), v) for v, _, k in blocks])


def held_out(id_col: Column) -> Column:
    """Rows never learnt from: crc32 of the id as text is 2 modulo 4."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, x`` (the statistics) of every document, one pass over the texts."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("t"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            x = [statistics(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["id", "x"])

    return rows.mapInArrow(run, f"id {kind}, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _normal_equations(train: DataFrame, model: QualityModel, folds: int) -> np.ndarray:
    """Z'Z with Z'y as last column, per fold: summed within each partition, then
    by slices of rows, so neither a task nor the driver sees more than matrices."""
    size = len(model.phase) + 1
    shared = train.sparkSession.sparkContext.broadcast(model)
    cuts = np.array_split(np.arange(size), 16)

    def partial(batches):
        total, some = np.zeros((folds, size, size + 1)), False
        for batch in batches:
            if batch.num_rows:
                some = True
                z, y, fold = shared.value.fourier(_matrix(batch.column(0))), batch.column(1).to_numpy(), batch.column(2).to_numpy()
                for k in range(folds):
                    at = fold == k
                    total[k] += z[at].T @ np.concatenate([z[at], y[at, None]], axis=1)
        if some:
            yield pa.RecordBatch.from_pydict({
                "p": pa.array([TaskContext.get().partitionId()] * len(cuts), pa.int32()), "k": pa.array(range(len(cuts)), pa.int32()),
                "m": pa.array([total[:, c].tobytes() for c in cuts], pa.binary())})

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(0)
        for m in t.column("m"):
            m = np.frombuffer(m.as_py(), np.float64)
            total = total + m if len(total) else m
        return pa.table({"p": t.column("p").slice(0, 1), "k": t.column("k").slice(0, 1), "m": pa.array([total.tobytes()], pa.binary())})

    # in two levels, so that a task adds up about the root of the partitions' slices
    state = "p int, k int, m binary"
    rows = train.select("x", "y", "fold")
    groups = math.isqrt(max(rows.rdd.getNumPartitions() - 1, 0)) + 1
    parts = rows.mapInArrow(partial, state)
    if groups > 1:
        parts = parts.groupBy("k", F.pmod("p", F.lit(groups)).alias("group")).applyInArrow(add, state)
    sums = parts.groupBy("k").applyInArrow(add, state).collect()
    out = np.zeros((folds, size, size + 1))
    for r in sums:
        c = cuts[r["k"]]
        out[:, c] = np.frombuffer(r["m"], np.float64).reshape(folds, len(c), size + 1)
    return out


def fit_quality(stats: DataFrame, labels: DataFrame, label_id: str = "doc_id", label_col: str = "quality", fourier: int = FOURIER,
                ridge: float = RIDGE, bandwidth: float = BANDWIDTH, folds: int = FOLDS, seed: int = 7) -> QualityModel:
    """Fit on every labelled row of ``stats`` (``id, x``) that is not held out.

    A ridge regression of the label on random Fourier features (a Gaussian
    kernel over standardised statistics), from partition-summed normal
    equations. Scores of each fold by the model of the other folds are counted
    in ``BINS`` bins, on which isotonic regression gives the calibration. Labels
    other than 0 and 1 and null ids are not used; an id with several labels has
    their mean. Without any label every score is 1; with one kind, near it."""
    spark: SparkSession = stats.sparkSession
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("_id")).agg(
        F.avg(label_col).alias("y"))
    train = materialize(stats.filter(~held_out(F.col("id"))).join(known, F.col("id") == F.col("_id")).select(
        "x", "y", F.pmod(F.xxhash64("id"), F.lit(folds)).cast("int").alias("fold")), "quality-train")
    moments = train.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(
        F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).collect()
    width = STATISTICS
    mean, scale = np.zeros(width), np.ones(width)
    for r in moments:
        mean[r["i"]], scale[r["i"]] = r["m"], r["s"] if r["s"] and r["s"] > 1e-9 else 1.0
    rng = np.random.default_rng(seed)
    model = QualityModel(mean, scale, rng.normal(size=(width, fourier)) / (bandwidth * math.sqrt(width)),
                         rng.uniform(0, 2 * math.pi, fourier), np.zeros(fourier + 1), np.array([0.0, 1.0]), np.array([1.0, 1.0]))
    if not moments:
        return model
    sums = _normal_equations(train, model, folds)
    penalty = np.diag([ridge] * fourier + [1e-6])
    solve = lambda m: np.linalg.solve(m[:, :-1] + penalty, m[:, -1])
    model.beta = solve(sums.sum(axis=0))
    others = spark.sparkContext.broadcast((model, np.stack([solve(sums.sum(axis=0) - sums[k]) for k in range(folds)], axis=1)))

    def out_of_fold(batches):
        own, betas = others.value
        for batch in batches:
            if batch.num_rows:
                raw = (own.fourier(_matrix(batch.column(0))) @ betas)[np.arange(batch.num_rows), batch.column(2).to_numpy()]
                place = np.clip((raw + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(place), batch.column(1)], names=["b", "y"])

    bins = train.select("x", "y", "fold").mapInArrow(out_of_fold, "b int, y double").groupBy("b").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("p")).orderBy("b").collect()
    n, p = np.array([r["n"] for r in bins], float), np.array([r["p"] for r in bins], float)
    share = p.sum() / n.sum()
    model.knots = (np.array([r["b"] for r in bins]) + 0.5) / BINS * 2 - 0.5
    levels = pool_adjacent(n, p)
    # a block's level leans on the overall share as one more row would
    weight = np.array([n[levels == v].sum() for v in levels])
    model.levels = np.maximum.accumulate((levels * weight + share) / (weight + 1))
    return model


def score_statistics(stats: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """``id, held_out, score, predicted`` of ``stats``."""
    shared = stats.sparkSession.sparkContext.broadcast(model)
    kind = stats.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(_matrix(batch.column(1))))], names=["id", "score"])

    out = stats.select("id", "x").mapInArrow(run, f"id {kind}, score double")
    return out.select("id", held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``; same columns. Fitted
    on the labelled rows among ``docs``; each row is scored where it is.
    Null and empty texts are scored by their (zero) statistics; an empty table
    stays empty, and without labels every row stays."""
    labelled = docs.select(id_col, text_col).join(
        labels.select(F.col("doc_id").alias("_l")).distinct(), F.col(id_col) == F.col("_l"), "left_semi")
    model = fit_quality(materialize(document_statistics(labelled, id_col, text_col), "statistics"), labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        own = shared.value
        x = np.array([statistics(None if t is None else bytes(t)) for t in text]).reshape(-1, STATISTICS)
        return pd.Series(own.score(x))

    return docs.filter(score(F.col(text_col).cast("string").cast("binary")) >= threshold)
