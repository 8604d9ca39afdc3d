"""Vector functions as Column builders; arithmetic in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-12


def total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def l2_normalized(v: Column) -> Column:
    """Of length one; vectors shorter than 1e-12 stay."""
    length = norm(v)
    return F.when(length > EPSILON, F.transform(v, lambda x: x.cast("double") / length)).otherwise(F.transform(v, lambda x: x.cast("double")))


def problem(v: Column, dimension: int) -> Column:
    """What is wrong with a query vector, or null."""
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(v.isNull(), "query vector is missing").when(F.size(v) != dimension, "query vector has the wrong dimension").when(~whole, "query vector is not finite")


def checked(v: Column, dimension: int) -> Column:
    """The vector, or an error in the plan."""
    wrong = problem(v, dimension)
    return F.when(wrong.isNull(), v).otherwise(F.raise_error(wrong).cast("array<float>"))
