"""Local-step training of networks (M8, M9): the reference's 32-row steps, run
where the rows are.

The rows are dealt to replicas. In a round every replica starts from the same
weights and takes its rows in order, one optimiser step for every ``batch_rows``
of them; then weights and moments are averaged, each replica counting by its
rows. A round is one job, however many rows and steps it has: replicas emit
their state in slices, which are summed by slice and group of replicas, then by
slice, so no task adds up more than about the root of the replicas' slices.

With one replica the result is the reference's sequential training; with more,
weights meet once a round.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from articlelab.operators.keys import shuffle_key

# Fixed value of the reference: rows of one step.
BATCH_ROWS = 32
# Numbers of a replica's state that one slice holds.
SLICE = 1 << 16
# Rows below which a replica is not worth its own start.
LEAST_ROWS = 1024

PARTIAL = "replica int, k int, v binary, loss double, n long, steps long"


def replica_of(id_col: str, replicas: int, seed: int) -> Column:
    """Replica of a row: 28 bits of its seeded key, modulo their number."""
    return F.pmod(F.conv(F.substring(shuffle_key(id_col, seed), 1, 7), 16, 10).cast("long"), F.lit(replicas)).cast("int")


def deal(rows: DataFrame, id_col: str, replicas: int, seed: int) -> DataFrame:
    """``replica, features, label`` with each replica's rows together, in the order
    of a seeded key: the same whatever the input's partitions. One shuffle."""
    keyed = rows.select(replica_of(id_col, replicas, seed).alias("replica"), shuffle_key(id_col, seed + 1).alias("key"),
                        F.col(id_col).alias("id"), F.col("features").cast("array<double>").alias("features"), F.col("label").cast("int").alias("label"))
    return keyed.repartition(replicas, "replica").sortWithinPartitions("replica", "key", "id").select("replica", "features", "label")


def replicas_for(n: int, parallelism: int) -> int:
    return max(1, min(parallelism, n // LEAST_ROWS))


def _slices(replica: int, state: np.ndarray, loss: float, n: int, steps: int) -> pa.RecordBatch:
    cuts = range(0, len(state), SLICE)
    same = lambda v, t: pa.array([v] * len(cuts), t)
    return pa.RecordBatch.from_arrays([
        same(replica, pa.int32()), pa.array(range(len(cuts)), pa.int32()),
        pa.array([(n * state[c:c + SLICE]).tobytes() for c in cuts], pa.binary()),
        same(loss, pa.float64()), same(n, pa.int64()), same(steps, pa.int64())], names=["replica", "k", "v", "loss", "n", "steps"])


def _add(t: pa.Table) -> pa.Table:
    total = np.zeros(0)
    for v in t.column("v"):
        v = np.frombuffer(v.as_py())
        total = v.copy() if not len(total) else total + v
    first = lambda c: t.column(c).slice(0, 1)
    return pa.table({"replica": first("replica"), "k": first("k"), "v": pa.array([total.tobytes()], pa.binary()),
                     "loss": pa.array([math.fsum(t.column("loss").to_pylist())], pa.float64()),
                     "n": pa.array([sum(t.column("n").to_pylist())], pa.int64()), "steps": pa.array([max(t.column("steps").to_pylist())], pa.int64())})


def local_round(model, dealt: DataFrame, replicas: int, batch_rows: int = BATCH_ROWS, epoch: int = 0) -> tuple[float, int]:
    """One round over ``dealt`` (replica, features, label; a replica's rows next to
    each other); ``model`` takes the averaged state. ``epoch`` above 0 puts the
    rows of each Arrow batch in another order. Returns mean loss and row count.
    Without rows the model stays as it is."""
    spark = dealt.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]):
        own, replica, loss, n, steps = None, None, 0.0, 0, 0
        xs, ys = np.zeros((0, model_width)), np.zeros(0, np.int64)

        def step(x, y):
            nonlocal loss, n, steps
            g, row_loss, _ = type(own).grads(own.params, x, y, own.output)
            own.apply(np.concatenate([gi.ravel() for gi in g]) / len(y))
            loss, n, steps = loss + float(row_loss.sum()), n + len(y), steps + 1

        for at, batch in enumerate(batches):
            if not batch.num_rows:
                continue
            who = batch.column(0).to_numpy()
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            y = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            edges = [0, *(np.flatnonzero(np.diff(who)) + 1).tolist(), len(who)]
            for a, b in zip(edges, edges[1:]):
                if who[a] != replica:
                    if own is not None:
                        if len(ys):
                            step(xs, ys)
                        yield _slices(replica, own.state_vector(), loss, n, steps)
                    own, replica, loss, n, steps = shared.value.copy(), int(who[a]), 0.0, 0, 0
                    xs, ys = x[:0], y[:0]
                order = np.random.default_rng((own.seed, epoch, replica, at)).permutation(b - a) + a if epoch else np.arange(a, b)
                xs, ys = np.concatenate([xs, x[order]]), np.concatenate([ys, y[order]])
                whole = len(ys) // batch_rows * batch_rows
                for s in range(0, whole, batch_rows):
                    step(xs[s:s + batch_rows], ys[s:s + batch_rows])
                xs, ys = xs[whole:], ys[whole:]
        if own is not None:
            if len(ys):
                step(xs, ys)
            yield _slices(replica, own.state_vector(), loss, n, steps)

    model_width = model.d
    groups = math.isqrt(max(replicas - 1, 0)) + 1
    parts = dealt.mapInArrow(run, PARTIAL)
    some = parts.groupBy("k", F.pmod("replica", F.lit(groups)).alias("g")).applyInArrow(_add, PARTIAL)
    rows = sorted(some.groupBy("k").applyInArrow(_add, PARTIAL).collect(), key=lambda r: r["k"])
    shared.unpersist()
    if not rows:
        return 0.0, 0
    n = rows[0]["n"]
    model.take_state(np.concatenate([np.frombuffer(r["v"]) for r in rows]) / n, rows[0]["steps"])
    return rows[0]["loss"] / n, n
