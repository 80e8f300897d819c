"""Rounding that agrees with engines which round in binary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_away(x: Column, digits: int) -> Column:
    """``x`` times a power of ten, halves of that product rounded away from 0: what SQL's ``round`` of a double is in an
    engine that works in binary. Spark's own rounds the shortest decimal of ``x``, whose halves fall differently, and has
    no negative zero, which is what a small negative ``x`` is rounded to there."""
    return F.signum(x) * F.round(F.abs(x) * 10.0**digits) / 10.0**digits
