"""Vector arithmetic on ``array<double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed
from .binding import bind


def squared(v: Column) -> Column:
    """Sum of squares."""
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x)


def floored_norm(square: Column) -> Column:
    """Norm from a squared norm, never below the floor."""
    return F.greatest(F.sqrt(square), F.lit(fixed.NORM_FLOOR))


def l2_normalize(v: Column) -> Column:
    return bind(floored_norm(squared(v)), lambda norm: F.transform(v, lambda x: x / norm))


def diversity_from_sums(n: Column, squared_sum: Column, sum_of_squares: Column) -> Column:
    """1 - mean cosine over pairs, from |sum u|^2 and sum |u|^2; NULL below two."""
    pairs = (n * (n - 1)).cast("double")
    return F.when(n > 1, 1 - (squared_sum - sum_of_squares) / pairs)


def diversity_of_rows(vectors: Column) -> Column:
    """Diversity of one row's ``array<array<double>>``, without any shuffle."""
    n = F.size(vectors)
    zeros = F.array_repeat(F.lit(0.0), F.size(F.get(vectors, F.lit(0))))

    def from_units(units: Column) -> Column:
        added = F.aggregate(units, zeros, lambda acc, u: F.zip_with(acc, u, lambda a, b: a + b))
        own = F.aggregate(units, F.lit(0.0), lambda acc, u: acc + squared(u))
        return diversity_from_sums(n, squared(added), own)

    return F.when(n > 1, bind(F.transform(vectors, l2_normalize), from_units))
