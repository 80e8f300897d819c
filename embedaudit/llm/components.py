"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import join_counted, released, written


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Each node's larger neighbours are linked to the least of its neighbours and itself."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
    return join_counted(both.filter("b > a"), least, "a", "n", 2 * total).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of these (edges lead from larger to smaller)."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    moved = join_counted(edges, least, "a", "n", total).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``links`` (two columns of one type), label being the component's least node.

    Links to oneself, repeated ones and ones with a null are left out. Every round's links are written to the shared
    folder, and those of the round before deleted; rounds grow with the logarithm of the longest chain. A node that
    many links meet at is no single task. No links: no rows.
    """
    first, second = links.columns
    x, y = F.col(first), F.col(second)
    edges = links.filter(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b"))
    edges, seen = written(edges.distinct(), "links"), None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
        star = written(_large_star(edges, state[0]), "star")
        after = written(_small_star(star, state[0]), "links")
        released(edges, star)
        edges = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
