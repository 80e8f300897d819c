"""Append-only ledgers: current state, verification against a listing, and what is still to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from embedaudit.sources.scratch import released, written


def latest_per_key(ledger: DataFrame, key: str, order: Column | str) -> DataFrame:
    """The last row of each key, found by a partial maximum rather than a sort of the key's history."""
    columns = [F.col(c) for c in ledger.columns]
    return ledger.groupBy(F.col(key).alias("__key")).agg(F.max_by(F.struct(*columns), order).alias("r")).select("r.*")


def verify_complete(ledger: DataFrame, listing: DataFrame, key: str) -> DataFrame:
    """Ledger rows with ``complete``: listed, of more than 0 bytes, and of the expected size unless that is 0."""
    seen = listing.select(F.col(key).alias("__k"), F.col("found_size"))
    expected = F.coalesce(F.col("size"), F.lit(0))
    good = F.coalesce((F.col("found_size") > 0) & ((expected == 0) | (expected == F.col("found_size"))), F.lit(False))
    return ledger.join(seen, F.col(key) == F.col("__k"), "left").withColumn("complete", good).drop("__k")


def pending(expected: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return expected.join(done.select(*keys).distinct(), keys, "left_anti")


def missing_members(df: DataFrame, column: str, wanted: list[str]) -> DataFrame:
    """``missing``: those of the wanted values that no row has."""
    expected = df.sparkSession.createDataFrame([(w,) for w in wanted], "missing string")
    return pending(expected, df.select(F.col(column).alias("missing")), ["missing"])


def require_members(df: DataFrame, column: str, wanted: list[str]) -> DataFrame:
    """The rows of the wanted values; a ValueError that names what is missing and what there is if a value has no row."""
    missing = sorted(r["missing"] for r in missing_members(df, column, wanted).collect())  # at most the wanted ones
    if missing:
        there = [str(r[0]) for r in df.select(column).distinct().orderBy(column).limit(20).collect()]
        raise ValueError(f"{column}: no rows of {', '.join(missing)}; there are {', '.join(there)}")
    return df.filter(F.col(column).isin(*wanted))


def resume(expected: DataFrame, ledger: DataFrame, listing: DataFrame, key: str, order: Column | str, dry_run: bool = False) -> DataFrame:
    """What is still to do: expected keys whose last ledger row is not a verified, successful one (``status`` DONE and the
    file listed with its size). Failed ones are tried again. ``dry_run`` keeps all keys, with ``action`` skip or do."""
    last = verify_complete(latest_per_key(ledger, key, order), listing, key)
    done = last.filter("complete AND status = 'DONE'").select(F.col(key).alias("__done")).distinct()
    tagged = expected.join(done, F.col(key) == F.col("__done"), "left").withColumn("action", F.when(F.col("__done").isNull(), "do").otherwise("skip")).drop("__done")
    return tagged if dry_run else tagged.filter("action = 'do'").drop("action")


def incremental(cells: DataFrame, store: DataFrame, keys: list[str], force: bool = False) -> DataFrame:
    """Cells that the store does not hold, or with ``force`` all of them."""
    return cells if force else pending(cells, store, keys)


def upsert(store: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The store with the new rows, which replace those of their keys."""
    return store.join(new.select(*keys).distinct(), keys, "left_anti").select(*store.columns).unionByName(new.select(*store.columns))


def first_rows(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key in the order given."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("__n = 1").drop("__n")


def _doubled(nodes: DataFrame, *more) -> DataFrame:
    """One round of pointer doubling over (id, up, ...): each node's ``up`` becomes that of its ``up``. Nodes whose ``up`` is
    not there are left out; ``more`` are columns of the result, with ``a_`` before the upper node's."""
    above = nodes.select(*(F.col(c).alias(f"a_{c}") for c in nodes.columns))
    joined = nodes.join(above, F.col("up") == F.col("a_id"), "left").filter("up IS NULL OR a_id IS NOT NULL")
    return written(joined.select("id", F.col("a_up").alias("up"), *more), "folders")


def require_no_cycle(folders: DataFrame) -> None:
    """A ValueError where folders (``id, parent``) lead round in a circle: there a walk upwards takes more steps than there
    are folders. Only ids are followed, no paths."""
    count = folders.count()
    nodes = folders.select("id", F.col("parent").alias("up"), F.lit(1).cast("long").alias("steps"))
    while not nodes.filter("up IS NOT NULL").isEmpty():
        if not nodes.filter((F.col("steps") > count) & F.col("up").isNotNull()).isEmpty():
            raise ValueError("folders form a cycle")
        before = nodes
        nodes = _doubled(nodes, (F.col("steps") + F.coalesce("a_steps", F.lit(0))).alias("steps"))
        released(*(x for x in (before,) if hasattr(x, "_written")))


def folder_paths(folders: DataFrame, files: DataFrame) -> DataFrame:
    """``file_id, path`` of every file: folders (``id, parent, name``; null parent is a root) take over their parents'
    paths, whose length doubles in each round, until all lead to a root; each round is written. A file whose folder or
    one of whose folder's parents is missing has no row. Folders in a cycle are an error, found before any path is made."""
    require_no_cycle(folders)
    paths = folders.select("id", F.col("parent").alias("up"), F.col("name").alias("path"))
    while not paths.filter("up IS NOT NULL").isEmpty():
        before = paths
        paths = _doubled(paths, F.concat_ws("/", "a_path", "path").alias("path"))
        released(*(x for x in (before,) if hasattr(x, "_written")))
    return files.join(paths, F.col("parent") == F.col("id")).select("file_id", F.concat_ws("/", "path", "name").alias("path"))


def shard(df: DataFrame, order: str, index: int, count: int) -> DataFrame:
    """Every ``count``-th row from ``index`` in an order, without one task for all rows: ranges are sorted apart, and
    each starts at the number of rows before it."""
    spark = df.sparkSession
    parts = spark.sparkContext.defaultParallelism
    ranged = df.repartitionByRange(parts, order).sortWithinPartitions(order).withColumn("__at", F.monotonically_increasing_id())
    ranged = ranged.withColumn("__part", F.shiftright("__at", 33)).withColumn("__row", F.col("__at") - F.shiftleft(F.shiftright("__at", 33), 33))
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("n"))
    # one row for each range
    starts = sizes.withColumn("__start", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__part", "__start")
    return ranged.join(F.broadcast(starts), "__part").filter((F.col("__start") + F.col("__row")) % count == index).select(*df.columns)
