"""Data-parallel network trainers.

An epoch is one job of local steps by default (``local_steps``): replicas run
the reference's 32-row steps on their rows and average their weights. The
synchronous alternative (``batch_size``) makes one job of each step: every
partition computes the gradient of its rows with NumPy (weights arrive as a
broadcast variable) in slices of ``SLICE`` weights, each slice is summed in two
levels, and the driver, which only receives the summed gradient (size = number
of weights, not rows), applies SGD or Adam. Rows are dealt to steps by a
per-epoch hash, so each epoch sees every row once in a new grouping.

After each epoch the model scores train and test in one pass and the
metrics come from the same aggregates as stored scores (E10-E12).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import ClassVar

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from articlelab.operators import metrics as M
from articlelab.operators import sampling as D
from articlelab.session import materialize, scratch_path
from articlelab.train import local_steps as LS

# Folders that the steps of a synchronous epoch are laid out in.
STEP_FOLDERS = 256
# Weights summed by one task.
SLICE = 1 << 16


class Network:
    """Trainer registry by class name."""
    registry: ClassVar[dict[str, type["Network"]]] = {}
    optimizer_name = "SGD"
    criterion_name = "CrossEntropyLoss"
    moments: ClassVar[tuple[str, ...]] = ()

    def __init_subclass__(cls, **kw):
        super().__init_subclass__(**kw)
        Network.registry.setdefault(cls.__name__, cls)

    def __init__(self, input_dim: int, output_dim: int, learning_rate: float = 0.001,
                 seed: int = 42, output: str = "logits"):
        self.d, self.k, self.lr, self.seed, self.output = input_dim, output_dim, learning_rate, seed, output
        self.params = self.init_params(np.random.RandomState(seed))
        self.t = 0
        self.state: dict = {}

    # -- model -----------------------------------------------------------
    def init_params(self, rng) -> list[np.ndarray]:
        raise NotImplementedError

    @staticmethod
    def forward(params, x, output):
        raise NotImplementedError

    @staticmethod
    def grads(params, x, y, output):
        raise NotImplementedError

    # -- flat views --------------------------------------------------------
    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.params])

    def unflat(self, v: np.ndarray) -> list[np.ndarray]:
        out, i = [], 0
        for p in self.params:
            out.append(v[i:i + p.size].reshape(p.shape))
            i += p.size
        return out

    def apply(self, g: np.ndarray) -> None:
        """Update with the mean gradient ``g``."""
        self.params = [p - self.lr * gi for p, gi in zip(self.params, self.unflat(g))]

    # -- state as one vector (averaged over replicas) ----------------------
    def copy(self) -> "Network":
        out = object.__new__(type(self))
        out.__dict__.update(self.__dict__, params=[p.copy() for p in self.params], state=dict(self.state))
        return out

    def state_vector(self) -> np.ndarray:
        """Weights, then the optimiser's moments."""
        return np.concatenate([self.flat(), *[self.state[k] for k in sorted(self.state)]])

    def take_state(self, v: np.ndarray, steps: int) -> None:
        """Weights and moments from :meth:`state_vector`, ``steps`` further on."""
        size = self.flat().size
        self.params = self.unflat(v[:size])
        self.t += steps
        self.state = {k: v[size * (i + 1):size * (i + 2)] for i, k in enumerate(self.moments)} if len(v) > size else {}


def _softmax(z):
    z = z - z.max(axis=1, keepdims=True)
    e = np.exp(z)
    return e / e.sum(axis=1, keepdims=True)


def _ce(z, y):
    """Per-row cross-entropy of scores z and integer labels y."""
    m = z.max(axis=1, keepdims=True)
    lse = np.log(np.exp(z - m).sum(axis=1)) + m[:, 0]
    return lse - z[np.arange(len(y)), y]


class SoftmaxRegression(Network):
    """M8: one linear layer, SGD, cross-entropy. ``output='reference'``
    adds the reference's ReLU on the scores (Q16)."""
    optimizer_name = "SGD"

    def init_params(self, rng):
        b = 1.0 / np.sqrt(self.d)
        return [rng.uniform(-b, b, (self.d, self.k)), rng.uniform(-b, b, self.k)]

    @staticmethod
    def forward(params, x, output):
        w, b = params
        a = x @ w + b
        return np.maximum(a, 0.0) if output == "reference" else a

    @staticmethod
    def grads(params, x, y, output):
        w, b = params
        a = x @ w + b
        z = np.maximum(a, 0.0) if output == "reference" else a
        dz = _softmax(z)
        dz[np.arange(len(y)), y] -= 1.0
        if output == "reference":
            dz = dz * (a > 0)
        loss = _ce(z, y)
        return [x.T @ dz, dz.sum(axis=0)], loss, z


class SimpleMLP(Network):
    """M9: 128 hidden units with ReLU, Adam, cross-entropy.
    ``output='reference'`` applies softmax to the output before the loss,
    which applies it again (Q16)."""
    optimizer_name = "Adam"
    moments = ("m", "v")
    hidden = 128

    def init_params(self, rng):
        b1, b2 = 1.0 / np.sqrt(self.d), 1.0 / np.sqrt(self.hidden)
        return [rng.uniform(-b1, b1, (self.d, self.hidden)), rng.uniform(-b1, b1, self.hidden),
                rng.uniform(-b2, b2, (self.hidden, self.k)), rng.uniform(-b2, b2, self.k)]

    @staticmethod
    def forward(params, x, output):
        w1, b1, w2, b2 = params
        h = np.maximum(x @ w1 + b1, 0.0)
        o = h @ w2 + b2
        return _softmax(o) if output == "reference" else o

    @staticmethod
    def grads(params, x, y, output):
        w1, b1, w2, b2 = params
        a1 = x @ w1 + b1
        h = np.maximum(a1, 0.0)
        o = h @ w2 + b2
        if output == "reference":
            s = _softmax(o)
            ds = _softmax(s)
            ds[np.arange(len(y)), y] -= 1.0
            do = s * (ds - (ds * s).sum(axis=1, keepdims=True))
            z = s
        else:
            do = _softmax(o)
            do[np.arange(len(y)), y] -= 1.0
            z = o
        loss = _ce(z, y)
        dh = (do @ w2.T) * (a1 > 0)
        return [x.T @ dh, dh.sum(axis=0), h.T @ do, do.sum(axis=0)], loss, z

    def apply(self, g: np.ndarray) -> None:
        b1, b2, eps = 0.9, 0.999, 1e-8
        self.t += 1
        m = self.state.get("m", np.zeros_like(g))
        v = self.state.get("v", np.zeros_like(g))
        m = b1 * m + (1 - b1) * g
        v = b2 * v + (1 - b2) * g * g
        self.state = {"m": m, "v": v}
        mh, vh = m / (1 - b1 ** self.t), v / (1 - b2 ** self.t)
        step = self.lr * mh / (np.sqrt(vh) + eps)
        self.params = [p - s for p, s in zip(self.params, self.unflat(step))]


def _stack(series: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in series]) if len(series) else np.zeros((0, 0))


@dataclass
class TrainResult:
    model: Network
    history: list[dict] = field(default_factory=list)
    confusion: list[dict] = field(default_factory=list)


def _add_slices(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sum of the partial rows of one slice (and group of partitions)."""
    total = sum(np.frombuffer(g) for g in pdf["g"])
    return pd.DataFrame({"p": pdf["p"].iloc[:1], "k": pdf["k"].iloc[:1], "g": [total.tobytes()], "loss": [pdf["loss"].sum()], "n": [pdf["n"].sum()]})


def gradient_step(model: Network, rows: DataFrame) -> tuple[np.ndarray, float, int]:
    """One synchronous step over ``rows`` (features, label): returns the
    mean gradient, mean loss and row count."""
    spark = rows.sparkSession
    bc = spark.sparkContext.broadcast(model.params)
    cls, output = type(model), model.output

    def partial(batches):
        params = bc.value
        acc, loss, n = None, 0.0, 0
        for pdf in batches:
            if pdf.empty:
                continue
            x = _stack(pdf["features"])
            y = pdf["label"].to_numpy().astype(np.int64)
            g, lrow, _ = cls.grads(params, x, y, output)
            flat = np.concatenate([gi.ravel() for gi in g])
            acc = flat if acc is None else acc + flat
            loss += float(lrow.sum())
            n += len(y)
        if n:  # an empty partition emits no row
            for k, at in enumerate(range(0, len(acc), SLICE)):
                yield pd.DataFrame({"p": [TaskContext.get().partitionId()], "k": [k], "g": [acc[at:at + SLICE].tobytes()], "loss": [loss], "n": [n]})

    rows = rows.select("features", "label")
    parts = rows.mapInPandas(partial, "p int, k int, g binary, loss double, n long")
    groups = math.isqrt(max(rows.rdd.getNumPartitions() - 1, 0)) + 1
    if groups > 1:   # no task adds up more than about the root of the partitions
        parts = parts.groupBy("k", F.pmod("p", F.lit(groups)).alias("group")).applyInPandas(_add_slices, parts.schema)
    out = sorted(parts.groupBy("k").applyInPandas(_add_slices, parts.schema).collect(), key=lambda r: r["k"])
    bc.unpersist()
    if not out:
        return np.zeros(model.flat().size), 0.0, 0
    n = int(out[0]["n"])
    return np.concatenate([np.frombuffer(r["g"]) for r in out]) / n, float(out[0]["loss"]) / n, n


def score(model: Network, rows: DataFrame, keep: list[str]) -> DataFrame:
    """H7: add ``logits`` (ARRAY<DOUBLE>) with the model's forward pass,
    vectorised per Arrow batch; weights are broadcast once."""
    spark = rows.sparkSession
    bc = spark.sparkContext.broadcast(model.params)
    cls, output = type(model), model.output

    def fwd(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            z = cls.forward(bc.value, _stack(pdf["features"]), output)
            out = pdf[keep].copy()
            out["logits"] = list(z)
            yield out

    schema = rows.select(*keep).schema.add("logits", ArrayType(DoubleType()))
    return rows.select(*keep, "features").mapInPandas(fwd, schema)


def _sync_epoch(model: Network, rows: DataFrame, id_col: str, epoch: int, n: int, batch_size: int) -> None:
    """An epoch of synchronous steps, each one gradient of ``batch_size`` rows of the
    whole cluster. The rows are laid out by step once, in at most ``STEP_FOLDERS``
    folders of one sorted file each, so a step reads little but its own."""
    steps = max(1, -(-n // batch_size))
    dealt = rows.withColumn("step", D.epoch_step(id_col, epoch, steps, model.seed))
    each = -(-steps // STEP_FOLDERS)
    if steps > 1:
        path = scratch_path(rows.sparkSession, "epoch-steps")
        folder = F.floor(F.col("step") / each).cast("int")
        dealt.withColumn("folder", folder).repartition(-(-steps // each), "folder").sortWithinPartitions("folder", "step").write.partitionBy(
            "folder").parquet(path)
        dealt = rows.sparkSession.read.parquet(path)
    for s in range(steps):
        g, _, n_rows = gradient_step(model, dealt.where((F.col("folder") == s // each) & (F.col("step") == s)) if steps > 1 else dealt)
        if n_rows:
            model.apply(g)


def train(model: Network, data: DataFrame, epochs: int = 10, batch_size: int | None = None,
          id_col: str = "vec_id", batch_rows: int = 32, replicas: int | None = None) -> TrainResult:
    """P11 training loop: ``data`` has (id, label, split, features). History
    rows: (epoch, split, n, accuracy, loss, row_loss); confusion rows:
    (epoch, split, true_label, pred_label, n). The batch-mean loss (Q9) is
    over batches of ``batch_rows`` rows in id order within a split.

    An epoch is one round of local steps of ``batch_rows`` rows in ``replicas``
    replicas (default: one per core, of 1,024 rows or more; see
    ``local_steps``). With ``batch_size`` it is a series of synchronous steps
    of so many rows instead, a job each."""
    spark = data.sparkSession
    data = data.select(id_col, F.col("label").cast("int").alias("label"), "split", "features")
    data = materialize(D.fixed_batches(data, id_col, batch_rows, ["split"]), "training-rows")
    train_rows = data.where(F.col("split") == "train").drop("split", "batch_id")
    n = train_rows.count()
    replicas = replicas or LS.replicas_for(n, spark.sparkContext.defaultParallelism)
    dealt = None if batch_size else materialize(LS.deal(train_rows, id_col, replicas, model.seed), "dealt-rows")
    res = TrainResult(model)
    for epoch in range(1, epochs + 1):
        if batch_size:
            _sync_epoch(model, train_rows, id_col, epoch, n, batch_size)
        else:
            LS.local_round(model, dealt, replicas, batch_rows, epoch)
        scored = M.score_rows(score(model, data, [id_col, "label", "split", "batch_id"]))
        # one pass: counts and losses by batch and label pair, folded to metrics and confusion
        cells = materialize(scored.groupBy("split", "batch_id", F.col("label").cast("bigint").alias("true_label"),
                                           F.col("pred").cast("bigint").alias("pred_label")).agg(
            F.count(F.lit(1)).alias("n"), F.sum("loss").alias("loss")), "epoch-cells")
        batches = cells.groupBy("split", "batch_id").agg(
            F.sum("n").alias("n"), F.sum("loss").alias("l"),
            F.sum(F.when(F.col("true_label") == F.col("pred_label"), F.col("n")).otherwise(0)).alias("c"))
        hist = batches.groupBy("split").agg(
            F.sum("n").alias("n"), F.sum("c").alias("correct"), (F.sum("c") / F.sum("n")).alias("accuracy"),
            F.avg(F.col("l") / F.col("n")).alias("loss"), (F.sum("l") / F.sum("n")).alias("row_loss")).collect()
        conf = cells.groupBy("split", "true_label", "pred_label").agg(F.sum("n").alias("n")).collect()
        res.history += [dict(r.asDict(), epoch=epoch) for r in hist]
        res.confusion += [dict(r.asDict(), epoch=epoch) for r in conf]
    return res


def history_frame(spark: SparkSession, res: TrainResult) -> DataFrame:
    """The training history as a DataFrame."""
    rows = [(h["epoch"], h["split"], int(h["n"]), float(h["accuracy"]), float(h["loss"]), float(h["row_loss"]))
            for h in res.history]
    return spark.createDataFrame(rows, "epoch bigint, split string, n bigint, accuracy double, "
                                       "loss double, row_loss double")


def save_weights(spark: SparkSession, model: Network, path: str) -> None:
    """One parquet row per weight tensor (+ optimiser moments and step count)."""
    rows = [(f"param{i}", list(p.shape), p.ravel().tolist()) for i, p in enumerate(model.params)]
    rows.append(("step_count", [1], [float(model.t)]))
    for name, arr in model.state.items():
        rows.append((f"opt_{name}", [arr.size], arr.ravel().tolist()))
    spark.createDataFrame(rows, "name string, shape array<int>, values array<double>") \
        .write.mode("overwrite").parquet(path)


def load_weights(spark: SparkSession, model: Network, path: str) -> Network:
    rows = {r["name"]: r for r in spark.read.parquet(path).collect()}
    model.params = [np.asarray(rows[f"param{i}"]["values"]).reshape(rows[f"param{i}"]["shape"])
                    for i in range(len(model.params))]
    model.t = int(rows["step_count"]["values"][0])
    model.state = {k[4:]: np.asarray(r["values"]) for k, r in rows.items() if k.startswith("opt_")}
    return model
