"""Tables of vectors: the rows that take part, bounded samples, and blocks of rows met by the queries that visit them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block, and queries that meet a block in one task, about.
BLOCK_ROWS, VISITORS = 2048, 4096
#: Bounds of a sample that comes to the driver.
SAMPLE_ROWS, SAMPLE_BYTES = 32_768, 16 << 20
_UNIT = 1 << 30


def usable(df: DataFrame, id_col: str, vector_col: str, *more: str, zeros: bool = True) -> tuple[DataFrame, int]:
    """``id, vector`` (array of doubles) and ``more`` of the rows that take part, and the vectors' width.

    Left out are rows with a null id, a null or empty vector, or a null or non-finite component; without ``zeros``
    also vectors of zeros. The width is the most frequent one (of several, the largest); others take no part.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), *more)
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & (F.size("vector") > 0) & finite)
    if not zeros:
        rows = rows.filter(F.exists("vector", lambda x: x != 0))
    found = rows.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    width = found["width"] if found else 1
    return rows.filter(F.size("vector") == width), width


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of arrays of ``width`` doubles as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def packed(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as bytes."""
    rows = np.ascontiguousarray(rows)
    step = rows.shape[1] * rows.dtype.itemsize
    ends = np.arange(len(rows) + 1, dtype=np.int64) * step
    return pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(rows.tobytes())]).cast(pa.binary())


def unpacked(column: pd.Series, width: int, dtype: str = "<f8") -> np.ndarray:
    """Undoes :func:`packed`."""
    return np.frombuffer(b"".join(column), dtype).reshape(-1, width)


def sampled(rows: DataFrame, total: int, width: int, most: int = SAMPLE_ROWS) -> np.ndarray:
    """Vectors of a sample drawn by a hash of the id: all rows if there are few, never more than ``most`` or
    SAMPLE_BYTES. What one id repeats is drawn together, so a limit stands behind the hash."""
    most = max(1, min(most, SAMPLE_BYTES // (8 * width)))
    drawn = rows if total <= most else rows.filter(F.pmod(F.xxhash64("id"), F.lit(_UNIT)) < int(0.95 * most / total * _UNIT))
    found = drawn.select("id", "vector").limit(most).toArrow().sort_by("id")
    return matrix(found["vector"].combine_chunks(), width) if len(found) else np.zeros((0, width))


def met(blocks: DataFrame, visitors: DataFrame, work: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``work`` over each block's rows and the queries that visit it (both have ``block``, visitors also ``query_id``).

    A block that many queries visit is met in parts of some VISITORS queries, so no group grows with the input.
    """
    counts = visitors.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / VISITORS).cast("int").alias("__parts"))
    left = blocks.join(counts, "block").withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).drop("__parts")
    mine = counts.select(F.col("block").alias("__at"), F.col("__parts").alias("__of"))
    right = visitors.withColumnRenamed("block", "__at").join(mine, "__at").withColumn("__turn", F.pmod(F.xxhash64("query_id"), F.col("__of")).cast("int")).drop("__of")
    return left.groupBy("block", "__part").cogroup(right.groupBy("__at", "__turn")).applyInPandas(work, schema)
