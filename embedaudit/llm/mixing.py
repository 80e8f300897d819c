"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions alone.

Every document draws an exponential key scaled by its quality weight; sorted by key within its source, documents
form a weighted random order. A source's target is met by whole epochs of all its documents first, then by the
documents at the front of that order until their prefix sum of words reaches what is left of the budget.

Prefix sums are taken in two levels, so that a source with a third of all rows is not one task: keys are dealt to
buckets in key order, the buckets' sums are accumulated, and only rows of one bucket are summed in a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes 0x20 and 0x09-0x0D separate words.
WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: The mix takes this share of all words; a source gives at most so many epochs.
BUDGET, EPOCHS = 1.5, 2.0
#: Rows of one bucket of a source's key order, about.
BUCKET_ROWS = 10_000
_DIGITS = 8  # hex digits of the digest that make the uniform draw


def uniform(id_col: Column, seed: str) -> Column:
    """A draw in (0, 1) from the id alone: the same in every run and partitioning."""
    head = F.substring(F.md5(F.concat_ws(":", F.coalesce(id_col.cast("string"), F.lit("null")), F.lit(seed)).cast("binary")), 1, _DIGITS)
    return (F.conv(head, 16, 10).cast("double") + 0.5) / float(16**_DIGITS)


def words(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, budget: float = BUDGET, epochs: float = EPOCHS, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """``source, source_size`` with ``target``: shares by weight, none above ``epochs`` times its size.

    Sources that reach their limit are those with the least limit for a weight; in that order the level of the rest
    is (budget - limits so far) / (weights from here on), and the first source whose limit is above it ends them.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    table = F.array(*map(F.lit, weights))
    placed = sources.withColumn("weight", F.get(table, (rank - 1) % len(weights))).withColumn("cap", F.col("source_size") * epochs)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    left = F.sum("source_size").over(every) * budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = placed.withColumn("level", left / F.sum("weight").over(after))
    open_ = F.col("cap") / F.col("weight") >= F.col("level")
    final = F.min(F.when(open_, F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(every)["level"]
    target = F.when(F.col("cap") / F.col("weight") >= F.coalesce(final, F.lit(float("inf"))), F.col("weight") * final).otherwise(F.col("cap"))
    return level.withColumn("target", target).select("source", "source_size", "target")


def mixed(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality: Column | None = None, size: Column | None = None,
    budget: float = BUDGET, epochs: float = EPOCHS, weights: tuple[float, ...] = WEIGHTS, seed: str = "mix",
) -> DataFrame:
    """``df`` with ``size``, ``source_size``, ``target``, ``repeats`` and ``taken`` (= repeats * size).

    ``size`` counts words (null or empty text: 0), or is the column given. Sources weigh ``weights`` by code point, null last, repeating; a
    null source is a source of its own. ``quality`` is a positive column that scales the keys (default 1; null: 1).
    The document at the end of a source's budget is taken if that brings the source nearer to its target, so a
    source's words are within half a document of it. Documents of size 0 are taken with the epochs only. Rows with
    the same id, or a null id, draw the same key and are ordered by size; each is still taken for itself. An empty
    table gives an empty result. Columns of ``df`` named as the new ones are replaced.
    """
    added = ("size", "source_size", "target", "repeats", "taken")
    kept = [c for c in df.columns if c not in added]
    size = words(F.col(text_col)) if size is None else size
    weight = F.greatest(F.coalesce(quality if quality is not None else F.lit(1.0), F.lit(1.0)).cast("double"), F.lit(1e-6))
    docs = df.select(*(F.col(c) for c in kept), F.col(source_col).alias("__source"), F.col(id_col).alias("__id"), size.alias("size"), weight.alias("__weight"))
    docs = docs.withColumn("__key", -F.log(uniform(F.col("__id"), seed)) / F.col("__weight"))
    # about as many buckets as a source's share of all rows would need; a key's bucket follows the key's order
    buckets = max(1, -(-df.count() // BUCKET_ROWS))
    docs = docs.withColumn("__bucket", F.floor(F.lit(float(buckets)) * (F.lit(1.0) - F.exp(-F.col("__key")))))
    sums = docs.groupBy("__source", "__bucket").agg(F.sum("size").alias("words"))
    sizes = sums.groupBy(F.col("__source").alias("source")).agg(F.sum("words").alias("source_size"))
    aims = targets(sizes, budget, epochs, weights)
    ahead = Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("__start", F.coalesce(F.sum("words").over(ahead), F.lit(0)))
    starts = starts.join(aims, F.col("__source").eqNullSafe(F.col("source"))).select(
        F.col("__source").alias("__s"), F.col("__bucket").alias("__b"), "__start", "source_size", "target"
    )
    joined = docs.join(starts, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__bucket") == F.col("__b")))
    within = Window.partitionBy("__source", "__bucket").orderBy("__key", F.col("__id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("__start") + F.coalesce(F.sum("size").over(within), F.lit(0))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    rest = F.col("target") - whole * F.col("source_size")
    picked = (F.col("size") > 0) & (before + F.col("size") / 2.0 <= rest)
    return joined.withColumn("__repeats", whole + picked.cast("int")).select(
        *(F.col(c) for c in kept), "size", "source_size", F.col("target").cast("double").alias("target"),
        F.col("__repeats").alias("repeats"), (F.col("__repeats") * F.col("size")).alias("taken"),
    )


def repeated(mix: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: every row as often as it is taken."""
    return mix.filter("repeats > 0").withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("repeats")))).select(*columns)
