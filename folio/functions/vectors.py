"""Vector functions in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions.core import bind


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, query: list[float]) -> Column:
    """Cosine similarity of a vector column with one query vector; null for zero vectors."""
    norm = sum(x * x for x in query) ** 0.5
    q = F.lit([float(x) for x in query])
    squares = F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return bind(squares, lambda n: F.when((n > 0) & F.lit(norm > 0), dot(a, q) / (n * F.lit(norm or 1.0))))
