"""Vector columns, computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    scale = norm(v) + F.lit(1e-12)
    return F.transform(v, lambda x: x.cast("double") / scale)


def cosine01(raw: Column) -> Column:
    """Map a cosine in [-1, 1] to [0, 1]."""
    return (raw + 1.0) / 2.0
