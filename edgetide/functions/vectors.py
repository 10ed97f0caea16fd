"""Array-valued features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def one_hot(value, vocabulary: Sequence[str]) -> Column:
    """0/1 vector over ``vocabulary``; an unknown or missing value gives zeros."""
    value = _col(value)
    return F.array(*[F.coalesce((value == v).cast("int"), F.lit(0)) for v in vocabulary])


def zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0), dim)


BROADCAST_NUMBERS = 2_000_000  # 16 MB of vectors


def brought(vectors: DataFrame, dim: int, most: int = BROADCAST_NUMBERS) -> DataFrame:
    """``vectors`` with a hint to broadcast them where they fit every task, else as they are: they then meet rows in a shuffle."""
    return F.broadcast(vectors) if vectors.count() * dim <= most else vectors


def pad_vector(vector, dim: int) -> Column:
    """Right-padded with zeros to ``dim``; a longer vector is an error."""
    vector = _col(vector)
    padded = F.concat(vector, F.array_repeat(F.lit(0.0), F.greatest(F.lit(dim) - F.size(vector), F.lit(0))))
    return F.when(
        F.size(vector) > dim, F.raise_error(F.lit("vector longer than padding")).cast("array<double>")
    ).otherwise(padded)


def sum_of(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda total, x: total + x)


def cosine(left, right) -> Column:
    left, right = _col(left), _col(right)
    dot = sum_of(F.zip_with(left, right, lambda a, b: a.cast("double") * b))
    norm = F.sqrt(sum_of(F.transform(left, lambda a: a.cast("double") * a))) * F.sqrt(
        sum_of(F.transform(right, lambda b: b.cast("double") * b))
    )
    return F.try_divide(dot, norm)


def scale(vector, factor) -> Column:
    return F.transform(_col(vector), lambda x: x * factor)


def add(left, right) -> Column:
    return F.zip_with(_col(left), _col(right), lambda a, b: a + b)


def mean_by_position(vector, dim: int) -> Column:
    """Aggregate: position-wise mean of a fixed-width vector column (partial sums run map-side)."""
    return F.array(*[F.avg(_col(vector)[i]) for i in range(dim)])


def weighted_mean_by_position(vector, weight, dim: int) -> Column:
    """Aggregate: position-wise mean in which a row counts ``weight`` times; missing components take no part."""
    vector, weight = _col(vector), _col(weight)
    return F.array(*[F.sum(vector[i] * weight) / F.sum(F.when(vector[i].isNotNull(), weight)) for i in range(dim)])


def time_encode(delta, dim: int = 100) -> Column:
    """cos(delta * w) over ``dim`` frequencies falling from 1 to 1e-9; a missing delta gives zeros."""
    delta = _col(delta)
    span = max(dim - 1, 1)
    waves = F.array(*[F.cos(delta * F.lit(10.0 ** (-9.0 * n / span))) for n in range(dim)])
    return F.when(delta.isNull(), zeros(dim)).otherwise(waves)


def position_weight(k, n, mode: str = "const", last: int = 0, q: float = 0.1, nth=None) -> Column:
    """Weight of token ``k`` (from 0) among ``n``.

    ``const``: 1. ``combine``: linear decay, with the ``last`` closing tokens on a rising line.
    ``geo``: q to the power of ``nth`` (the token's rank among known ones, from 1); closing tokens q squared.
    """
    k, n = _col(k), _col(n)
    body = k < n - F.lit(last)
    if mode == "combine":
        fall = F.lit(1.0) - k / (n + 1)
        rise = (k / F.lit(last) + (F.lit(2.0) - n / F.lit(last))) / 2 if last else fall
        return F.when(body, fall).otherwise(rise)
    if mode == "geo":
        rank = _col(nth) if nth is not None else k + 1
        return F.when(body, F.pow(F.lit(q), rank)).otherwise(F.lit(q * q))
    return F.lit(1.0)


def minmax_normalize(df: DataFrame, vector: str, dim: int, bounds: DataFrame | None = None) -> DataFrame:
    """Each dimension scaled to [0, 1] by the column's own bounds or by ``bounds`` of another table.

    A constant dimension becomes 0. Bounds are one row, read as a scalar subquery.
    """
    limits = (minmax_bounds(df, vector, dim) if bounds is None else bounds).select(
        F.struct("low", "high")
    ).scalar()
    scaled = F.transform(
        F.arrays_zip(F.col(vector).alias("x"), F.col("_limits.low").alias("l"), F.col("_limits.high").alias("h")),
        lambda t: F.when(t["h"] == t["l"], F.lit(0.0)).otherwise((t["x"] - t["l"]) / (t["h"] - t["l"])),
    )
    return df.withColumn("_limits", limits).withColumn(vector, scaled).drop("_limits")


def minmax_bounds(df: DataFrame, vector: str, dim: int) -> DataFrame:
    element = [F.col(vector)[i].cast("double") for i in range(dim)]
    return df.agg(
        F.array(*[F.min(e) for e in element]).alias("low"), F.array(*[F.max(e) for e in element]).alias("high")
    )
