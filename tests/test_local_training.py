"""Exact stumps, local-step training and word vectors against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from articlelab.train import exact_stumps as EX
from articlelab.train import local_steps as LS
from articlelab.train import networks as NN
from articlelab.train import word_vectors as WV

ROWS = "id long, label int, features array<double>"


def _best_stump(x, y, w, k):
    """Every cut of every feature, one after another."""
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for a, b in zip(values, values[1:]):
            left = x[:, f] <= a
            wl, wr = (np.bincount(y[m], w[m], k) for m in (left, ~left))
            impurity = 1 - ((wl ** 2).sum() / wl.sum() + (wr ** 2).sum() / wr.sum()) / w.sum()
            key = (round(impurity, 12), f, (a + b) / 2)
            if best is None or key < best[0]:
                best = key, int(np.argmax(np.round(wl, 12))), int(np.argmax(np.round(wr, 12)))
    return best


def _samme(x, y, k, rounds):
    w, out = np.full(len(y), 1 / len(y)), []
    for _ in range(rounds):
        (_, f, cut), left, right = _best_stump(x, y, w, k)
        miss = np.where(x[:, f] <= cut, left, right) != y
        err = w[miss].sum() / w.sum()
        if err <= 1e-15:
            return [*out, (f, cut, left, right, 0.0, 1.0)]
        if err >= 1 - 1 / k:
            return out
        alpha = math.log((1 - err) / err) + math.log(k - 1)
        out.append((f, cut, left, right, err, alpha))
        w = w * np.exp(alpha * miss)
        w /= w.sum()
    return out


@pytest.mark.parametrize("shard_rows", [EX.SHARD_ROWS, 25])
def test_exact_stumps_equal_plain_boosting(spark, shard_rows):
    rng = np.random.default_rng(3)
    n, k = 160, 3
    x = np.round(rng.normal(size=(n, 4)), 1)
    x[:, 2] = np.where(rng.random(n) < 0.6, 0.0, x[:, 2])       # a value most rows share
    x[:, 3] = 1.0                                               # a constant feature
    y = (x[:, 0] + 0.5 * x[:, 1] + rng.normal(size=n) * 0.4 > 0).astype(int) + (x[:, 2] > 0.5)
    df = spark.createDataFrame([(i, int(y[i]), x[i].tolist()) for i in range(n)], ROWS).repartition(5)
    m = EX.fit_exact(df, k, n_rounds=6, shard_rows=shard_rows)
    want = _samme(x, y, k, 6)
    assert len(m.stumps) == len(want)
    for s, e, a, w in zip(m.stumps, m.errors, m.alphas, want, strict=True):
        assert (s.feature, s.left, s.right) == (w[0], w[2], w[3]) and math.isclose(s.threshold, w[1])
        assert math.isclose(e, w[4], rel_tol=1e-9, abs_tol=1e-12) and math.isclose(a, w[5], rel_tol=1e-9)


def test_exact_stumps_stop_and_refuse(spark):
    rows = [(i, int(i >= 6), [float(i), 0.0]) for i in range(10)]
    m = EX.fit_exact(spark.createDataFrame(rows, ROWS), 2)
    assert [(s.feature, s.threshold, s.left, s.right) for s in m.stumps] == [(0, 5.5, 0, 1)] and m.alphas == [1.0]
    flat = EX.fit_exact(spark.createDataFrame([(i, i % 2, [1.0]) for i in range(6)], ROWS), 2)
    assert flat.stumps == []
    for bad in ([float("nan")], [float("inf")], [1.0, 2.0], None):
        with pytest.raises(ValueError):
            EX.fit_exact(spark.createDataFrame([(0, 0, [0.0]), (1, 1, bad), (2, 1, [2.0])], ROWS), 2)
    with pytest.raises(ValueError):
        EX.fit_exact(spark.createDataFrame([], ROWS), 2)


def _replica_rows(df, replicas, seed):
    out = {}
    for r in LS.deal(df, "id", replicas, seed).withColumn("p", F.monotonically_increasing_id()).collect():
        out.setdefault(r["replica"], []).append((r["p"], r["features"], r["label"]))
    return {k: [(f, y) for _, f, y in sorted(v, key=lambda t: t[0])] for k, v in out.items()}


@pytest.mark.parametrize("cls", [NN.SoftmaxRegression, NN.SimpleMLP])
@pytest.mark.parametrize("replicas", [1, 5])
def test_local_round_equals_sequential_steps(spark, cls, replicas):
    rng = np.random.default_rng(8)
    data = [(i, int(rng.integers(3)), rng.normal(size=4).tolist()) for i in range(230)]
    df = spark.createDataFrame(data, ROWS).repartition(7)
    model, states, sizes = cls(4, 3, learning_rate=0.05), [], []
    for rows in _replica_rows(df, replicas, 42).values():
        own = cls(4, 3, learning_rate=0.05)
        x, y = np.array([f for f, _ in rows]), np.array([v for _, v in rows])
        for a in range(0, len(y), 32):
            g, _, _ = cls.grads(own.params, x[a:a + 32], y[a:a + 32], own.output)
            own.apply(np.concatenate([v.ravel() for v in g]) / len(y[a:a + 32]))
        states.append(own.state_vector())
        sizes.append(len(y))
    LS.SLICE, keep = 7, LS.SLICE
    try:
        loss, n = LS.local_round(model, LS.deal(df, "id", replicas, 42), replicas)
    finally:
        LS.SLICE = keep
    assert n == 230 and loss > 0
    assert np.allclose(model.state_vector(), np.average(states, axis=0, weights=sizes), atol=1e-12)
    assert model.t == math.ceil(max(sizes) / 32)


def test_jobs_of_an_epoch_do_not_grow_with_rows(spark):
    """A round is one job, whatever the rows."""
    jobs = []
    for n in (200, 2000):
        df = spark.range(n).select(F.col("id"), (F.col("id") % 2).cast("int").alias("label"), F.array(F.col("id").cast("double") / n).alias("features"))
        dealt, model = LS.deal(df, "id", 4, 1), NN.SoftmaxRegression(1, 2)
        group = f"round-{n}"
        spark.sparkContext.setJobGroup(group, group)
        LS.local_round(model, dealt, 4)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]


def test_local_round_without_rows(spark):
    model = NN.SoftmaxRegression(2, 2)
    before = model.flat()
    assert LS.local_round(model, LS.deal(spark.createDataFrame([], ROWS), "id", 3, 1), 3) == (0.0, 0)
    assert (model.flat() == before).all()


def test_both_ways_of_training_learn(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(i % 2), "test" if i % 5 == 0 else "train", (rng.normal(size=3) + (2 if i % 2 else -2)).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, label int, split string, features array<double>")
    for kw in ({"replicas": 3}, {"batch_size": 100}):
        res = NN.train(NN.SoftmaxRegression(3, 2, learning_rate=0.3), df, epochs=2, **kw)
        last = {h["split"]: h for h in res.history if h["epoch"] == 2}
        assert last["test"]["accuracy"] > 0.95 and last["train"]["n"] == 320


def test_slices_are_summed_in_two_levels(spark):
    df = spark.range(300).select((F.col("id") % 2).cast("int").alias("label"), F.array(F.col("id").cast("double")).alias("features")).repartition(25)
    model = NN.SoftmaxRegression(1, 2)
    g, loss, n = NN.gradient_step(model, df)
    x, y = np.arange(300.0)[:, None], np.arange(300) % 2
    want, _, _ = NN.SoftmaxRegression.grads(model.params, x, y, "logits")
    assert n == 300 and np.allclose(g, np.concatenate([v.ravel() for v in want]) / 300)


# --- word vectors ----------------------------------------------------------

def test_sentences_are_laid_apart():
    words, sent, place = WV.laid_out([np.array([4, 5, 6]), np.array([], int), np.array([9])], 2, 99)
    assert words.tolist() == [99, 99, 4, 5, 6, 99, 99, 99, 99, 9, 99, 99]
    assert sent.tolist() == [-1, -1, 0, 0, 0, -1, -1, -1, -1, 2, -1, -1] and place[:5].tolist() == [0, 0, 0, 1, 2]
    assert WV._around(np.arange(6.0), 2).tolist() == [3, 5, 8, 12, 10, 7]


@pytest.mark.parametrize("step", [100, 3])
def test_updates_equal_plain_loops(step):
    rng = np.random.default_rng(1)
    sents, window, pad, rate = [np.array([0, 1, 2, 2, 3, 0, 4]), np.array([5]), np.array([1, 5])], 2, 6, 0.3
    inward, outward = (np.vstack([rng.normal(size=(6, 4)), np.zeros(4)]) for _ in range(2))
    words, sent, place = WV.laid_out(sents, window, pad)
    negative = WV.picks(["a", "b", "c"], sent, place, words, np.array([0, 0, 3, 5]), 3)
    assert ((negative < 0) | (negative != words[:, None])).all() and (negative[sent < 0] == -1).all() and (negative >= 0).any()
    got = [inward.copy(), outward.copy(), np.zeros(7), np.zeros(7)]
    want = [inward.copy(), outward.copy(), np.zeros(7), np.zeros(7)]
    s = lambda z: 1 / (1 + np.exp(-z))
    for a in range(window, len(words) - window, step):
        b = min(a + step, len(words) - window)
        WV.update(*got, words, negative, a, b, window, rate)
        i, o = want[0].copy(), want[1].copy()
        for p in range(a, b):
            near = [q for q in range(p - window, p + window + 1) if q != p and sent[q] == sent[p]]
            if sent[p] < 0 or not near:
                continue
            h, back = i[words[near]].mean(axis=0), np.zeros(4)
            for w, wanted in [(words[p], 1), *[(w, 0) for w in negative[p] if w >= 0]]:
                g = rate * (wanted - s(h @ o[w]))
                back += g * o[w]
                want[1][w] += g * h
                want[3][w] += 1
            for q in near:
                want[0][words[q]] += back
                want[2][words[q]] += 1
    for x, y in zip(got, want, strict=True):
        assert np.allclose(x, y, atol=1e-12)


def test_synonyms_are_neighbours(spark):
    """Words of a planted corpus that share their contexts end up side by side, over several lots."""
    rng = np.random.default_rng(4)
    groups = {g: [f"{g}{i}" for i in range(3)] for g in ("cat", "car", "sun", "sea")}
    context = {g: [f"{g}ctx{i}" for i in range(4)] for g in groups}
    sents = []
    for i in range(2400):
        g = ("cat", "car", "sun", "sea")[i % 4]
        c = rng.choice(context[g], 4).tolist()
        sents.append((str(i), [*c[:2], str(rng.choice(groups[g])), *c[2:]]))
    df = spark.createDataFrame([*sents, ("none", []), ("null", None)], "sid string, tokens array<string>")
    vec = {r["word"]: np.array(r["vec"]) for r in WV.fit_cbow(df, dim=16, epochs=12, lot_tokens=4000, pool=400, batch=32).collect()}
    unit = {w: v / np.linalg.norm(v) for w, v in vec.items()}
    for g, words in groups.items():
        for w in words:
            near = max((x for x in unit if x != w and "ctx" not in x), key=lambda x: unit[w] @ unit[x])
            assert near in words, (w, near)


def test_word_vectors_repeat_and_drop_rare_words(spark):
    df = spark.createDataFrame([(str(i), ["a", "b", "c", f"rare{i}"]) for i in range(50)], "sid string, tokens array<string>")
    one, two = ({r["word"]: r["vec"] for r in WV.fit_cbow(d, dim=4, min_count=2, epochs=2, lot_tokens=60, pool=20).collect()} for d in (df, df.repartition(9)))
    assert sorted(one) == ["a", "b", "c"] and all(np.allclose(one[w], two[w]) for w in one)
    assert WV.fit_cbow(df.limit(0), dim=4, epochs=1).count() == 0
