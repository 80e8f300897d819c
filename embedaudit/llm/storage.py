"""How operators read their tables, and joins by keys that may be hot. Tables between steps are the library's own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embedaudit.sources.scratch import released, shared_dir, written

__all__ = ["documents", "join_counted", "released", "shared_dir", "written"]

#: Keys that hold more than one in so many of all rows are met by a broadcast; there are at most as many of them.
FEW = 10_000


def join_counted(rows: DataFrame, table: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``table``, which has a row for each key and in ``count`` how many of the ``total``
    rows have it. Keys with more than a FEW-th of the rows are broadcast (at most FEW of them, whatever the input), so
    that no key's rows meet in one task; the rest is an ordinary join, none of whose keys is large."""
    more = [c for c in table.columns if c != key]
    hot = F.col(count) * FEW > total
    top = F.broadcast(table.filter(hot).select(F.col(key), F.struct(*more).alias("__more")))
    marked = rows.join(top, key, "left")
    met = marked.filter("__more IS NOT NULL").select(*rows.columns, *(F.col(f"__more.{c}").alias(c) for c in more))
    rest = marked.filter("__more IS NULL").drop("__more").join(table.filter(~hot), key).select(*rows.columns, *more)
    return met.unionByName(rest)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    """A table of the folder, as Spark splits it by bytes. Only a table of texts with fewer splits than the session has
    cores is dealt out row by row: it is smaller than a split for each core, so that costs little, and a single file
    would keep one core busy. The rows are the same."""
    read, cores = spark.read.parquet(f"{sf_dir}/{table}.parquet"), spark.sparkContext.defaultParallelism
    return read.repartition(cores) if "text" in read.columns and read._jdf.rdd().getNumPartitions() < cores else read
