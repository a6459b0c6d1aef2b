"""Vector and image column expressions (H1-H6, E24, hash word vectors).

Vectors are ``ARRAY<DOUBLE>`` columns; all maths is done with Spark's
higher-order functions so it stays JVM-side.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# ---------------------------------------------------------------------------
# Fixed values of the test word vectors (FIXTURES.md "wordvec"):
# v_i = int(hex digits 3i+1..3i+3 of md5(token), base 16) / 4095 - 0.5,
# and a token whose md5 ends in "0" has no vector.
HASH_VECTOR_DIM = 8
HASH_DIGITS = 3
HASH_SCALE = 4095.0
HASH_OOV_LAST_DIGIT = "0"
# Image side after resizing, pixel scale, normalisation mean and std.
IMAGE_SIDE = 100
PIXEL_SCALE = 255.0
NORM_MEAN, NORM_STD = 0.5, 0.5
# ---------------------------------------------------------------------------


def hash_vector(token, dim: int = HASH_VECTOR_DIM) -> Column:
    """Deterministic test word vector of a token (both engines agree): eight
    values from each md5, of the token, then of ``token:1``, ``token:2``, ..."""
    t = _c(token)
    per = HASH_VECTOR_DIM * HASH_DIGITS
    blocks = [F.substring(F.md5(t if b == 0 else F.concat(t, F.lit(f":{b}"))), 1, per)
              for b in range(-(-dim // HASH_VECTOR_DIM))]
    digits = F.substring(F.concat(*blocks), 1, HASH_DIGITS * dim)
    # the three-digit groups are cut once a token, not once a dimension
    return F.transform(F.regexp_extract_all(digits, F.lit("[0-9a-f]{%d}" % HASH_DIGITS), F.lit(0)),
                       lambda x: F.conv(x, 16, 10).cast("double") / F.lit(HASH_SCALE) - F.lit(0.5))


def has_hash_vector(token) -> Column:
    return F.substring(F.md5(_c(token)), 32, 1) != F.lit(HASH_OOV_LAST_DIGIT)


def softmax(z, m=None) -> Column:
    """H1: numerically stable softmax of an array column (``m`` = its max,
    pass a column to avoid recomputing it per element)."""
    z = _c(z)
    m = F.array_max(z) if m is None else _c(m)
    e = F.transform(z, lambda x: F.exp(x - m))
    s = F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(e, lambda x: x / s)


def argmax(z) -> Column:
    """H2: 0-based position of the first maximum."""
    z = _c(z)
    return (F.array_position(z, F.array_max(z)) - 1).cast("int")


def logsumexp(z, m=None) -> Column:
    z = _c(z)
    m = F.array_max(z) if m is None else _c(m)
    return F.log(F.aggregate(z, F.lit(0.0), lambda acc, x: acc + F.exp(x - m))) + m


def cross_entropy(z, label, m=None) -> Column:
    """Row loss ``logsumexp(z) - z[label]`` on raw scores."""
    return logsumexp(z, m) - F.element_at(_c(z), _c(label) + 1)


def min_max_scale(v, lo=None, hi=None) -> Column:
    """H3: scale to [0, 1]; a constant vector gives null (0/0 in the
    reference). Pass ``lo``/``hi`` columns so they are not recomputed per
    element inside the lambda."""
    v = _c(v)
    lo = F.array_min(v) if lo is None else _c(lo)
    hi = F.array_max(v) if hi is None else _c(hi)
    return F.when(hi > lo, F.transform(v, lambda x: (x - lo) / (hi - lo)))


def outer_image(u, scale: float = PIXEL_SCALE) -> Column:
    """H4: ``scale * u u^T`` flattened row major (d*d pixels)."""
    u = _c(u)
    return F.flatten(F.transform(u, lambda a: F.transform(u, lambda b: a * b * F.lit(scale))))


def resize_weights(src: int, dst: int = IMAGE_SIDE) -> list[list[tuple[int, float]]]:
    """Per output pixel, the (source index, weight) pairs of a bilinear
    resize with half-pixel centres; when shrinking, the triangle filter is
    widened by the ratio (anti-aliased resize). Weights sum to 1."""
    scale = src / dst
    widen = max(scale, 1.0)
    out = []
    for i in range(dst):
        centre = (i + 0.5) * scale
        lo = max(int(centre - widen + 0.5), 0)
        hi = min(int(centre + widen + 0.5), src)
        pairs = [(j, max(0.0, 1.0 - abs((j - centre + 0.5) / widen))) for j in range(lo, hi)]
        pairs = [(j, w) for j, w in pairs if w > 0.0]
        total = sum(w for _, w in pairs)
        out.append([(j, w / total) for j, w in pairs])
    return out


def resample_linear(v, src: int, dst: int = IMAGE_SIDE) -> Column:
    """Resample a length-``src`` vector to ``dst`` (the 1-D factor of the
    image resize). The image is an outer product, so
    ``resize(v v^T) = (Rv)(Rv)^T`` for this separable filter: resizing costs
    d + side^2 work instead of a 2-D resample of d^2 pixels."""
    v = _c(v)
    terms = []
    for pairs in resize_weights(src, dst):
        expr = None
        for j, w in pairs:
            t = v[j] * F.lit(w)
            expr = t if expr is None else expr + t
        terms.append(expr)
    return F.array(*terms)


def normalise(pixels, mean: float = NORM_MEAN, std: float = NORM_STD,
              scale: float = PIXEL_SCALE) -> Column:
    """H6: pixel/255 mapped to ``(x - mean) / std``."""
    return F.transform(_c(pixels), lambda x: (x / F.lit(scale) - F.lit(mean)) / F.lit(std))


def array_sum(v) -> Column:
    return F.aggregate(_c(v), F.lit(0.0), lambda acc, x: acc + x)
