"""Embedding whitening by incremental eigendecomposition.

Each partition keeps the spectrum (eigenvalues and eigenvectors) of the centred
scatter of the rows it has seen and applies every further row as one rank-one
update: deflation, then the roots of the secular equation. Spectra of partitions
are combined by successive rank-one updates too, in two levels, and one more
distributed pass projects all rows on the combined basis (Rayleigh-Ritz), which
takes away what rounding the many updates have gathered."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from articlelab.operators.rows import spread

#: Whole steps of an entry, and what keeps them positive (both from the contract).
STEPS, SHIFT = 1024, 100_000
#: Entries beyond this many times one saturate, so that sums of a batch stay exact in 64 bits.
LARGEST = float(1 << 38)
#: A component whose share of the variance is below this has none but rounding.
NO_VARIANCE = 1e-13
EPS = float(np.finfo(np.float64).eps)


# --- one rank-one update ---------------------------------------------------

def _inside(a: np.ndarray, b: np.ndarray, c: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The root of c x^2 - a x + b between low and high; their middle where there is none."""
    q = (a + np.copysign(np.sqrt(np.maximum(a * a - 4 * b * c, 0)), a)) / 2
    one, two = q / c, b / q
    x = np.where((one > low) & (one < high), one, two)
    return np.where((x > low) & (x < high), x, (low + high) / 2)


def secular_roots(d: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Roots of 1 + sum(w_j / (d_j - x)) for rising, distinct ``d`` and positive ``w``.

    Root i lies between d_i and the next pole (the last one within sum(w) of
    its pole). It is found as an offset from the nearer pole, so that its
    distances to all poles keep full relative precision. All roots are iterated
    at once, those not yet exact: the terms of the two poles around a root are
    kept, the others replaced by what matches value and slope, and the result
    is held inside a shrinking bracket.
    Returns (pole of each root, offset, distances d_j - root_i as [i, j])."""
    k = len(d)
    root = np.arange(k)
    gap = np.append(np.diff(d), w.sum())
    half = gap / 2
    beside = np.append(w[1:], 0.0)
    rest = 1 + (w / (d - (d + half)[:, None])).sum(axis=1)
    upper = rest < 0
    rest += w / half - beside / half
    far = upper & (root < k - 1)
    pole = root + far
    low = np.where(far, -half, np.where(upper, half, 0.0))
    high = np.where(far, 0.0, np.where(upper, gap, half))
    around = np.where(far, -rest, rest) * gap + w + beside
    offset = _inside(around, np.where(far, -beside, w) * gap, rest, low, high)
    offset[-1] = half[-1] if not rest[-1] else w[-1] / rest[-1]
    if not low[-1] < offset[-1] < high[-1]:
        offset[-1] = (low[-1] + high[-1]) / 2
    delta = d - d[pole][:, None]
    below = np.tri(k)
    at, gaps, sides, own, lo, hi = root, delta, below, offset, low, high
    for _ in range(80):
        den = gaps - own[:, None]
        term = w / den
        slope = term / den
        total, psi = term.sum(axis=1), np.einsum("ij,ij->i", term, sides)
        left, both = np.einsum("ij,ij->i", slope, sides), slope.sum(axis=1)
        f = 1 + total
        lo, hi = np.where(f < 0, own, lo), np.where(f < 0, hi, own)
        here = np.arange(len(at))
        p, q = den[here, at], den[here, np.minimum(at + 1, k - 1)]
        step = _inside((p + q) * f - p * q * both, p * q * f, f - p * left - q * (both - left), lo - own, hi - own)
        if at[-1] == k - 1:
            alone = p[-1] + left[-1] * p[-1] ** 2 / (f[-1] - p[-1] * left[-1])
            step[-1] = alone if lo[-1] < own[-1] + alone < hi[-1] else (lo[-1] + hi[-1]) / 2 - own[-1]
        new = own + step
        go = (np.abs(f) > EPS * k * (1 + total - 2 * psi)) & (new != own) & (hi - lo > 2 * EPS * np.abs(new))
        if not go.any():
            break
        if not go.all():
            at, gaps, sides, lo, hi, new = at[go], gaps[go], sides[go], lo[go], hi[go], new[go]
        own = offset[at] = new
    return pole, offset, delta - offset[:, None]


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors of Q diag(values) Q' + rho v v', rho > 0.

    Entries of Q'v that are too small to matter are deflated, and of two
    eigenvalues that cannot be told apart one is, after a rotation; the others
    come from the secular equation, their vectors from weights recomputed for
    the roots found (so that they are orthogonal to rounding)."""
    z = vectors.T @ v
    size = math.sqrt(z @ z)
    if not size or not rho:
        return values, vectors
    z, rho = z / size, rho * size * size
    tiny = 8 * EPS * max(abs(values[-1]), abs(values[0]), rho)
    keep = np.flatnonzero(rho * np.abs(z) > tiny)
    if len(keep) > 1:
        x, y = z[keep[:-1]], z[keep[1:]]
        if (np.diff(values[keep]) * np.abs(x * y) <= tiny * (x * x + y * y)).any():
            values, vectors, z = values.copy(), vectors.copy(), z.copy()
            a, stay = keep[0], []
            for b in keep[1:]:
                r = math.hypot(z[a], z[b])
                c, s = z[b] / r, z[a] / r
                if abs((values[b] - values[a]) * c * s) <= tiny:
                    qa = vectors[:, a].copy()
                    vectors[:, a], vectors[:, b] = c * qa - s * vectors[:, b], s * qa + c * vectors[:, b]
                    da, db = values[a], values[b]
                    values[a], values[b] = da * c * c + db * s * s, da * s * s + db * c * c
                    z[a], z[b] = 0.0, r
                else:
                    stay.append(a)
                a = b
            keep = np.array([*stay, a])
            keep = keep[np.argsort(values[keep], kind="stable")]
    if not len(keep):
        return values, vectors
    d, zk = values[keep], z[keep]
    out, basis = values.copy(), vectors.copy()
    if len(keep) == 1:
        out[keep] = d + rho * zk * zk
    else:
        with np.errstate(all="ignore"):
            pole, offset, dist = secular_roots(d, rho * zk * zk)
            k = len(d)
            # the product over roots of root_i - d_j, each over another pole's distance
            others = (d - d[:, None]).ravel()[1:].reshape(k - 1, k + 1)[:, :-1].reshape(k, k - 1)
            weight = np.sqrt(np.abs((dist.T[:, :-1] / others).prod(axis=1) * dist[-1]))
            turn = (np.copysign(weight, zk) / dist).T
        turn /= np.sqrt(np.einsum("ij,ij->j", turn, turn))
        out[keep] = d[pole] + offset
        basis[:, keep] = vectors[:, keep] @ turn
    order = np.argsort(out, kind="stable")
    return out[order], basis[:, order]


# --- spectra ---------------------------------------------------------------

@dataclass
class Spectrum:
    """Centred scatter of ``n`` integer vectors with exact sums."""
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray

    @staticmethod
    def empty(width: int) -> Spectrum:
        return Spectrum(0, [0] * width, np.zeros(width), np.eye(width))

    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def add_rows(self, x: np.ndarray) -> None:
        """One centred rank-one update for each row."""
        total = np.array(self.sums, dtype=object)
        if not len(x):
            return
        run = np.zeros(x.shape[1], np.int64)
        base = np.array(self.sums, dtype=np.float64)
        for row in x:
            if self.n:
                v = row - (base + run) / self.n
                self.values, self.vectors = rank_one(self.values, self.vectors, v, self.n / (self.n + 1))
            run += row
            self.n += 1
        self.sums = [int(s) for s in total + run.astype(object)]

    def add(self, other: Spectrum) -> None:
        """The spectrum of both: an update for each component of ``other`` and one for the distance of the means."""
        if not other.n:
            return
        if not self.n:
            self.n, self.sums, self.values, self.vectors = other.n, other.sums, other.values, other.vectors
            return
        apart = other.mean() - self.mean()
        for value, vector in zip(other.values, other.vectors.T, strict=True):
            if value > 0:
                self.values, self.vectors = rank_one(self.values, self.vectors, vector, value)
        self.values, self.vectors = rank_one(self.values, self.vectors, apart, self.n * other.n / (self.n + other.n))
        self.n, self.sums = self.n + other.n, [a + b for a, b in zip(self.sums, other.sums, strict=True)]

    def batch(self, key: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({
            "part": pa.array([key], pa.int32()), "n": pa.array([self.n], pa.int64()),
            "sums": pa.array([[str(s) for s in self.sums]], pa.list_(pa.string())),
            "spectrum": pa.array([np.concatenate([self.values, self.vectors.ravel()]).tobytes()], pa.binary())})

    @staticmethod
    def of(row: dict) -> Spectrum:
        sums = [int(s) for s in row["sums"]]
        flat = np.frombuffer(row["spectrum"], np.float64)
        return Spectrum(row["n"], sums, flat[:len(sums)].copy(), flat[len(sums):].reshape(len(sums), -1).copy())


STATE = "part int, n long, sums array<string>, spectrum binary"


@dataclass
class Whitening:
    """What whitening needs: row count, exact sums, all eigenvalues (falling) and
    the eigenvectors as columns."""
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S: exact, as 64-bit numbers where they fit, else as Python's."""
        most = self.n * max(float(np.abs(x).max(initial=0)), max((abs(s) / max(self.n, 1) for s in self.sums), default=0))
        if most < 2.0**61:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, dtype=object)

    def whiten(self, x: np.ndarray, k: int) -> np.ndarray:
        """Projections over the root of the variance; NaN where there is no variance."""
        centred = self.deviations(x).astype(np.float64) / max(self.n, 1)
        e = np.where(self.values[:k] > NO_VARIANCE * max(self.values.sum(), 0), self.values[:k], 0)
        with np.errstate(all="ignore"):
            out = centred @ self.vectors[:, :k] / np.sqrt(e)
        out[:, e == 0] = np.nan
        return out


def squared_length(dev: np.ndarray) -> list[int | None]:
    """Exact sums of squares; None beyond 64 bits."""
    if dev.dtype != object and (not dev.size or float(np.abs(dev).max()) ** 2 * dev.shape[1] < 2.0**62):
        return (dev * dev).sum(axis=1).tolist()
    sums = [sum(int(v) ** 2 for v in row) for row in dev]
    return [s if s < 1 << 63 else None for s in sums]


def integer_vectors(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that count, their x) of a column of lists; see :func:`whiten`."""
    lengths = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    fit = np.flatnonzero((lengths == width) & column.is_valid().to_numpy(zero_copy_only=False))
    c = column.take(pa.array(fit)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(fit), width)
    good = np.isfinite(c).all(axis=1)
    c = np.clip(c[good], -LARGEST, LARGEST)
    return fit[good], np.floor(STEPS * c).astype(np.int64) + SHIFT


def vector_width(df: DataFrame, vector_col: str) -> int:
    """The length that most usable vectors have (of equally many, the longer);
    0 without any."""
    c = F.col(vector_col)
    good = c.isNotNull() & ~F.exists(c, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    counts = df.filter(good).groupBy(F.size(c).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    first = counts.orderBy(F.desc("n"), F.desc("w")).first()
    return first["w"] if first else 0


def fit_spectrum(vectors: DataFrame, vector_col: str, width: int) -> Spectrum:
    """Spectrum of all rows: one per partition, then about the root of their
    number by groups, then one. A task holds one group's spectra (width squared
    numbers each), the driver one."""
    def partition(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext
        own = Spectrum.empty(width)
        for batch in batches:
            own.add_rows(integer_vectors(batch.column(0), width)[1])
        if own.n:
            yield own.batch(TaskContext.get().partitionId())

    def combine(batches: Iterator[pa.RecordBatch]):
        own, key = Spectrum.empty(width), 0
        for batch in batches:
            for row in batch.to_pylist():
                own.add(Spectrum.of(row))
                key = row["part"]
        if own.n:
            yield own.batch(key)

    states = vectors.select(vector_col).mapInArrow(partition, STATE)
    groups = max(1, math.isqrt(vectors.rdd.getNumPartitions()))
    by = F.pmod(F.col("part"), F.lit(groups))
    # the order in which spectra meet is fixed, so that a lost task gives the same again
    few = states.repartition(groups, by).sortWithinPartitions("part").mapInArrow(combine, STATE)
    rows = few.repartition(1).sortWithinPartitions("part").mapInArrow(combine, STATE).collect()
    return Spectrum.of(rows[0].asDict()) if rows else Spectrum.empty(width)


def _summed(vectors: DataFrame, vector_col: str, width: int, make) -> np.ndarray | None:
    """Sum over all rows of make(x), an array of fixed shape: by partition, by
    groups of partitions, then here (about the root of their number)."""
    def partition(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext
        total = None
        for batch in batches:
            x = integer_vectors(batch.column(0), width)[1]
            if len(x):
                total = make(x) if total is None else total + make(x)
        if total is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()),
                                              "m": pa.array([total.tobytes()], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]):
        total, key = None, 0
        for batch in batches:
            for key, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                m = np.frombuffer(m, np.float64)
                total = m if total is None else total + m
        if total is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([key], pa.int32()), "m": pa.array([total.tobytes()], pa.binary())})

    sums = vectors.select(vector_col).mapInArrow(partition, "part int, m binary")
    groups = max(1, math.isqrt(vectors.rdd.getNumPartitions()))
    sums = sums.repartition(groups, F.pmod(F.col("part"), F.lit(groups))).sortWithinPartitions("part").mapInArrow(add, "part int, m binary")
    rows = sorted(sums.collect(), key=lambda r: r["part"])
    return sum(np.frombuffer(r["m"], np.float64) for r in rows) if rows else None


def refine(vectors: DataFrame, vector_col: str, fitted: Spectrum) -> Whitening:
    """Rayleigh-Ritz: the covariance of all rows in the fitted basis (summed by
    partition), and its eigenvectors carried back."""
    width = len(fitted.sums)
    basis = np.linalg.qr(fitted.vectors[:, ::-1])[0]
    plain = Whitening(fitted.n, fitted.sums, np.ones(width), basis)
    shared = vectors.sparkSession.sparkContext.broadcast(plain)

    def scatter(x: np.ndarray) -> np.ndarray:
        own = shared.value
        y = (own.deviations(x).astype(np.float64) / own.n) @ own.vectors
        return y.T @ y

    total = _summed(vectors, vector_col, width, scatter)
    values, turn = np.linalg.eigh(total.reshape(width, width) / fitted.n)
    out = basis @ turn[:, ::-1]
    sign = np.sign(out[np.abs(out).argmax(axis=0), np.arange(width)])
    return Whitening(fitted.n, fitted.sums, np.maximum(values[::-1], 0), out * sign)


def identity_error(vectors: DataFrame, vector_col: str, model: Whitening, k: int) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity,
    over the components that have variance; 0 without any."""
    shared = vectors.sparkSession.sparkContext.broadcast(model)
    width = len(model.sums)
    has = int((model.values[:k] > NO_VARIANCE * model.values.sum()).sum())
    if not has:
        return 0.0

    def moments(x: np.ndarray) -> np.ndarray:
        w = shared.value.whiten(x, has)
        return np.concatenate([w.T @ w, w.sum(axis=0)[None]])

    total = _summed(vectors, vector_col, width, moments).reshape(has + 1, has) / model.n
    return float(np.abs(total[:-1] - np.outer(total[-1], total[-1]) - np.eye(has)).max())


OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 8) -> DataFrame:
    """One row per usable vector and component (up to ``components``):
    ``<id>, component, n, deviation, whitened, explained, identity_error``.

    An entry c counts as floor(1024 * c) + 100000. Left out are null vectors,
    vectors with a null or non-finite entry, and vectors (also empty ones) of
    another length than most usable vectors have. Entries beyond 2**38 saturate.
    Null and repeated ids are rows like any other; other columns are not read.
    ``deviation`` is null where it exceeds 64 bits. A component without variance
    (one vector, all equal, fewer dimensions than rows span) has ``whitened`` null
    and ``explained`` 0 and is left out of ``identity_error``. Without a usable
    vector the result is empty. The width is held squared in every task, so it is
    meant for vectors of some thousand entries at most.

    Five scans of the two columns (length, updates, Rayleigh-Ritz, check, result);
    rows are never gathered, only spectra are. The updates are the costly one: a
    table of few files is dealt over more tasks for it."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col), F.col(vector_col))
    kind = rows.schema[id_col].dataType.simpleString()
    out = f"`{id_col}` {kind}, {OUT}"
    width = vector_width(df, vector_col)
    if not width:
        return spark.createDataFrame([], out)
    model = refine(rows, vector_col, fit_spectrum(spread(rows), vector_col, width))
    k = min(components, width)
    error = identity_error(rows, vector_col, model, k)
    trace = float(model.values.sum())
    share = np.where(model.values[:k] > NO_VARIANCE * trace, model.values[:k] / (trace or 1.0), 0.0)
    shared = spark.sparkContext.broadcast(model)

    def result(batches: Iterator[pa.RecordBatch]):
        own = shared.value
        for batch in batches:
            at, x = integer_vectors(batch.column(1), width)
            if len(x):
                white = own.whiten(x, k).ravel()
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                    pa.array(np.full(len(x) * k, own.n)),
                    pa.array(squared_length(own.deviations(x)), pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k))),
                    pa.array(white, pa.float64(), mask=np.isnan(white)), pa.array(np.tile(share, len(x))),
                    pa.array(np.full(len(x) * k, error))],
                    names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(result, out)
