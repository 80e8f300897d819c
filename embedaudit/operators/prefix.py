"""Running totals and selection over whole tables without one task for all rows of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from embedaudit.sources.scratch import written

#: Rows of a range, about; there are as many ranges as the rows need.
RANGE_ROWS = 100_000


def ranged(df: DataFrame, keys: list[str], order: str, rows: int | None = None) -> DataFrame:
    """``df`` dealt to ranges of (keys, order) by sampled splitters and written, with each row's ``__range``. Ranges grow
    in number with the rows, not in size; one key's rows lie in as many of them as they need."""
    n = max(1, -(-df.count() // (rows or RANGE_ROWS)))
    return written(df.repartitionByRange(n, *keys, order).withColumn("__range", F.spark_partition_id()), "ranges")


def starts(dealt: DataFrame, keys: list[str], amount: str) -> DataFrame:
    """A row for each key and range: ``__range``, the ``__start`` of the running total in it and its ``__sum``."""
    sums = dealt.groupBy(*keys, "__range").agg(F.sum(amount).alias("__sum"))
    ahead = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn("__start", F.coalesce(F.sum("__sum").over(ahead), F.lit(0)))


def _within(dealt: DataFrame, found: DataFrame, keys: list[str], order: str, amount: str, into: str) -> DataFrame:
    within = Window.partitionBy(*keys, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    joined = dealt.join(found.select(*keys, "__range", "__start"), [*keys, "__range"])
    return joined.withColumn(into, F.col("__start") + F.coalesce(F.sum(amount).over(within), F.lit(0))).drop("__range", "__start")


def before(df: DataFrame, order: str, amount: str, into: str = "before", keys: list[str] | None = None, rows: int | None = None) -> DataFrame:
    """``df`` with the sum of ``amount`` over rows of a lesser ``order`` (of the same ``keys``); ``order`` is a number
    that no two rows of a key share, and keys are not null. Rows are summed within their range, on top of all ranges
    before it."""
    keys = keys or []
    dealt = ranged(df, keys, order, rows)
    return _within(dealt, starts(dealt, keys, amount), keys, order, amount, into)


def medians(df: DataFrame, keys: list[str], columns: list[str], rows: int | None = None) -> DataFrame:
    """Exact medians of each key, ``median_<column>``: the mean of the two middle values where their number is even;
    nulls and NaN are left out, and keys are not null.

    Distinct values are counted and dealt to ranges; the ranges' counts say in which range a key's middle lies, and
    only that one is put in order. No task holds a key's values, however many it has.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("__of"), F.col(c).cast("double").alias("__value")) for c in columns])
    long = df.select(*keys, F.inline(pairs)).filter("__value IS NOT NULL AND NOT isnan(__value)")
    by = [*keys, "__of"]
    dealt = ranged(long.groupBy(*by, "__value").agg(F.count(F.lit(1)).alias("__n")), by, "__value", rows)
    at = starts(dealt, by, "__n")
    total = at.withColumn("__all", F.sum("__sum").over(Window.partitionBy(*by)))
    total = total.withColumn("__low", F.floor((F.col("__all") - 1) / 2)).withColumn("__high", F.floor(F.col("__all") / 2))
    middle = total.filter("__start <= __high AND __start + __sum > __low")
    ordered = _within(dealt, middle, by, "__value", "__n", "__before")
    ends = middle.groupBy(*by).agg(F.first("__low").alias("__low"), F.first("__high").alias("__high"))
    met = ordered.join(ends, by)
    holds = lambda place: F.max(F.when((F.col("__before") <= F.col(place)) & (F.col("__before") + F.col("__n") > F.col(place)), F.col("__value")))
    each = met.groupBy(*by).agg(((holds("__low") + holds("__high")) / 2).alias("__median"))
    return each.groupBy(*keys).agg(*[F.max(F.when(F.col("__of") == c, F.col("__median"))).alias(f"median_{c}") for c in columns])
