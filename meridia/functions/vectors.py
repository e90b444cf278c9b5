"""Vector columns: dot products, norms, cosine. Arrays are read as doubles; null or zero vectors give 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    n = norm(a) * norm(b)
    return F.coalesce(F.when(n > 0, dot(a, b) / F.nullif(n, F.lit(0.0))), F.lit(0.0))


def smoothed_cosine(a, b, epsilon: float = 1e-8) -> Column:
    """Cosine with a small number added to each norm."""
    return dot(a, b) / ((norm(a) + epsilon) * (norm(b) + epsilon))


def normalised(a) -> Column:
    n = norm(a)
    return F.transform(_doubles(a), lambda x: F.when(n > 0, x / F.nullif(n, F.lit(0.0))).otherwise(0.0))


def clipped(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def scaled(a, weights: list[float]) -> Column:
    return F.zip_with(_doubles(a), F.array(*[F.lit(w) for w in weights]), lambda x, w: x * w)


def rounded(x: Column, places: int) -> Column:
    """x at so many places as SQL engines take it in doubles: x times a power of ten, halves away from zero.

    F.round() goes by the shortest decimal form: 0.50655 is taken up by it, though the double times 10,000 may be below the half.
    """
    power = F.lit(10.0**places)
    scaled = F.abs(x) * power
    whole = F.floor(scaled).cast("double")
    return F.signum(x) * (whole + F.when(scaled - whole >= 0.5, 1.0).otherwise(0.0)) / power
