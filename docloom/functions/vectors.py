"""Vector arithmetic on ``array`` columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(as_doubles(left), as_doubles(right), lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(as_doubles(vector), F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(vector: Column) -> Column:
    """Unit length; a zero vector has no direction and becomes null."""
    length = norm(vector)
    scaled = F.transform(F.arrays_zip(as_doubles(vector).alias("x"), F.array_repeat(length, F.size(vector)).alias("n")),
                         lambda p: p["x"] / p["n"])
    return F.when(length > 0, scaled)


def cosine_distance(left: Column, right: Column) -> Column:
    return F.lit(1.0) - F.try_divide(dot(left, right), norm(left) * norm(right))
