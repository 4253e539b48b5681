"""Voice-embedding columns (arrays of floats, summed in double precision)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stands for "no distance": unequal widths, empty or zero vectors.
NO_DISTANCE = float("inf")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, v: acc + v,
    )


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    scale = norm(a) * norm(b)
    return F.when(
        (F.size(a) == F.size(b)) & (F.size(a) > 0) & (scale > 0),
        F.lit(1.0) - dot(a, b) / scale,
    ).otherwise(F.lit(NO_DISTANCE))


def max_abs_difference(a: Column, b: Column) -> Column:
    return F.array_max(
        F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    )


def blend(a: Column, weight_a: Column, b: Column, weight_b: Column) -> Column:
    """Weighted mean of two vectors; falls back to ``a`` (to ``b`` if ``a`` is empty)."""
    wa, wb = F.greatest(weight_a, F.lit(0.0)), F.greatest(weight_b, F.lit(0.0))
    mixed = F.zip_with(
        a, b, lambda x, y: (x.cast("double") * wa + y.cast("double") * wb) / (wa + wb)
    )
    as_double = lambda v: F.transform(v, lambda x: x.cast("double"))
    return (
        F.when(F.size(a) == 0, as_double(b))
        .when((F.size(a) != F.size(b)) | (wa + wb <= 0), as_double(a))
        .otherwise(mixed)
    )


def decibels(energy: Column) -> Column:
    return F.lit(10.0) * F.log10(F.greatest(energy, F.lit(1e-12)))
