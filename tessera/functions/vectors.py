"""Vector expressions on array<double> columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_usable(column: str, dim: int) -> Column:
    """The array has `dim` finite numbers that are not all zero."""
    c = F.col(column)
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return c.isNotNull() & (F.size(c) == dim) & ~bad & F.exists(c, lambda x: x != 0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 where either vector is zero, kept within -1 and 1."""
    n = norm(a) * norm(b)
    return F.when(n > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / n))).otherwise(F.lit(0.0))


def angular(a: Column, b: Column) -> Column:
    """Angle between two vectors as a share of pi, from 0 to 1."""
    return F.acos(cosine(a, b)) / math.pi


def one_minus_dot(a: Column, b: Column) -> Column:
    """The second angular distance of the store: 1 minus the dot product, for unit vectors."""
    return 1 - dot(a, b)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
