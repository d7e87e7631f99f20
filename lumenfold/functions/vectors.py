"""Functions of arrays as vectors, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2))))


def cosine_distance(a: Column, b: Column) -> Column:
    """Null where a vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, F.lit(1.0) - dot(a, b) / size)


def menger(a: Column, b: Column, c: Column) -> Column:
    """Curvature of the circle through three points, 4 * area / (product of the sides); null where two coincide."""
    x, y, z = distance(a, b), distance(b, c), distance(a, c)
    s = (x + y + z) / 2
    area = F.sqrt(F.greatest(s * (s - x) * (s - y) * (s - z), F.lit(0.0)))
    return F.when((x > 0) & (y > 0) & (z > 0), 4 * area / (x * y * z))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; two empty ones are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))
