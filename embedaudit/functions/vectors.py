"""Vector arithmetic as Columns, without Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: str | Column, b: str | Column, eps: float = 1e-12) -> Column:
    """``eps`` is added to each norm, so that a zero vector has similarity 0."""
    return dot(a, b) / ((norm(a) + eps) * (norm(b) + eps))
