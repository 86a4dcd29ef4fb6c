"""Vector columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorespark.functions.text import as_col


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def is_sound(c: Column | str, dim: int) -> Column:
    """Not null, of the dimension, finite, not all zero."""
    c = as_col(c)
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(c) == dim) & finite & F.exists(c, lambda x: x != 0), F.lit(False))


def check_query(v: list[float], dim: int) -> list[float]:
    if len(v) != dim or not all(map(math.isfinite, v)) or not any(v):
        raise ValueError(f"a query vector needs {dim} finite values, not all zero")
    return [round(float(x), 6) for x in v]


def cosine_distance(c: Column | str, query: list[float]) -> Column:
    """1 - cosine, the query's norm folded into its literal, so a row costs one dot product and one norm."""
    size = math.sqrt(sum(x * x for x in query))
    q = F.array(*[F.lit(float(x) / size) for x in query])
    return 1 - dot(as_col(c), q) / norm(as_col(c))
