"""Dense vector expressions. Products accumulate in double whatever the element type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    squares = F.transform(a, lambda x: x.cast("double") * x.cast("double"))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))


def cosine(a: Column, b: Column) -> Column:
    """0.0 for missing, empty or unequal-length vectors; a zero norm counts as 1."""

    def safe(x: Column) -> Column:
        length = norm(x)
        return F.when(length == 0.0, F.lit(1.0)).otherwise(length)

    comparable = a.isNotNull() & b.isNotNull() & (F.size(a) > 0) & (F.size(a) == F.size(b))
    return F.when(comparable, dot(a, b) / (safe(a) * safe(b))).otherwise(F.lit(0.0))
