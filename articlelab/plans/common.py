"""Small helpers shared by the query registry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(c: Column, digits: int = 6) -> Column:
    """Rounded double; ``+ 0.0`` turns a rounded -0.0 into 0.0."""
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def expand(features: str, dim: int, prefix: str = "f", digits: int = 6) -> list[Column]:
    """B1: vector column -> ``f0 .. f{dim-1}`` rounded doubles."""
    return [r6(F.col(features)[i], digits).alias(f"{prefix}{i}") for i in range(dim)]
