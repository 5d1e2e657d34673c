"""Vector arithmetic as Column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(vector: list[float]) -> Column:
    return F.lit([float(x) for x in vector]) if vector else F.array().cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 if either norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x))


def score(a: Column, b: Column, metric: str = "cosine") -> Column:
    """Similarity in 0..1: cosine clamped, 1 / (1 + distance), or the inner product from 0."""
    if metric == "cosine":
        return F.least(F.greatest(cosine(a, b), F.lit(0.0)), F.lit(1.0))
    if metric == "l2":
        return 1.0 / (1.0 + l2(a, b))
    if metric == "inner_product":
        return F.greatest(F.lit(0.0), dot(a, b))
    raise ValueError(f"unknown metric {metric!r}")
