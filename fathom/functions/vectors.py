"""Vector functions on array columns; components are doubles before they are multiplied."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def normalize(v: Column) -> Column:
    """Unit length; vectors shorter than 1e-12 are left as they are."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm < 1e-12, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / norm))
