"""Vector functions as column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product."""
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalised(v: Column) -> Column:
    """Divided by its length; an all-zero vector stays as it is."""
    return F.when(norm(v) > 0, F.transform(doubles(v), lambda x: x / norm(v))).otherwise(doubles(v))


def cosine(a: Column, b: Column) -> Column:
    """Null where one of the vectors is all zeros."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def sign_code(v: Column) -> Column:
    """One bit per dimension: 1 where the number is above 0."""
    return F.array_join(F.transform(v, lambda x: F.when(x > 0, "1").otherwise("0")), "")
