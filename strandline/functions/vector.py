"""Column expressions over arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def normalize(v: Column) -> Column:
    """The unit vector; null for a zero vector."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x / n))


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """1 - cosine of unit vectors, held within 0..2."""
    return F.least(F.lit(2.0), F.greatest(F.lit(0.0), 1 - dot(a, b)))


def euclidean(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))
