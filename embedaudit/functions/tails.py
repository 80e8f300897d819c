"""Tail probabilities of the usual distributions, evaluated on the JVM by the math library Spark ships with."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_SPECIAL = "org.apache.commons.math3.special."


def _special(kind: str, name: str, *args: Column) -> Column:
    # a null argument would reach the library: such rows get a harmless one, and a null result
    known = args[0].isNotNull() & ~F.isnan(args[0])
    for a in args[1:]:
        known = known & a.isNotNull() & ~F.isnan(a)
    value = F.reflect(F.lit(_SPECIAL + kind), F.lit(name), *[F.when(known, a).otherwise(F.lit(0.5)).cast("double") for a in args])
    return F.when(known, value.cast("double"))


def erfc(x: Column) -> Column:
    return _special("Erf", "erfc", x.cast("double"))


def normal_two_sided(z: Column) -> Column:
    return erfc(F.abs(z) / F.sqrt(F.lit(2.0)))


def normal_quantile(p: Column) -> Column:
    return F.sqrt(F.lit(2.0)) * _special("Erf", "erfInv", (2 * p - 1).cast("double"))


def student_two_sided(t: Column, df: Column) -> Column:
    """I_{df/(df+t^2)}(df/2, 1/2)."""
    return _special("Beta", "regularizedBeta", (df / (df + t * t)).cast("double"), (df / 2).cast("double"), F.lit(0.5) + t * 0)


def f_upper(f: Column, df1: Column, df2: Column) -> Column:
    return _special("Beta", "regularizedBeta", (df2 / (df2 + df1 * f)).cast("double"), (df2 / 2).cast("double"), (df1 / 2).cast("double"))


def chi2_upper(x: Column, df: Column) -> Column:
    return _special("Gamma", "regularizedGammaQ", (df / 2).cast("double"), (x / 2).cast("double"))


def _u_tail(u: float, m: int, n: int) -> float:
    """P(U >= u) without ties: the numbers of ways are the coefficients of a Gaussian binomial."""
    ways = np.zeros(m * n + 1)
    ways[0] = 1.0
    for i in range(1, m + 1):
        ways[n + i :] -= ways[: len(ways) - n - i].copy() if n + i <= m * n else 0
        for k in range(i):
            ways[k::i] = np.cumsum(ways[k::i])
    return float(ways[int(np.ceil(u)) :].sum() / ways.sum())


@F.pandas_udf(DoubleType())
def mann_whitney_exact(u: pd.Series, n_a: pd.Series, n_b: pd.Series) -> pd.Series:
    """Two-sided exact p of U; null of null."""
    one = lambda x, m, n: None if pd.isna(x) else min(1.0, 2 * _u_tail(max(x, m * n - x), int(min(m, n)), int(max(m, n))))
    return pd.Series([one(*x) for x in zip(u, n_a, n_b, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def wilcoxon_exact(w: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided exact p of the lesser rank sum of n differences without ties or zeros; null of null."""

    def one(x, size):
        if pd.isna(x):
            return None
        ways = np.ones(1)
        for i in range(1, int(size) + 1):
            ways = np.append(ways, np.zeros(i)) + np.append(np.zeros(i), ways)
        return min(1.0, 2 * float(ways[: int(x) + 1].sum() / ways.sum()))

    return pd.Series([one(*x) for x in zip(w, n, strict=True)], dtype="float64")
