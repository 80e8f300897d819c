"""Exact dedup by content sort.

Sampled splitters range-partition the rows by the leading characters and a hash of the lower-cased text, then by
id; Spark's external sort places equal texts next to each other; neighbours are compared in full. A run of equal
texts may cross a partition's end (the id is part of the range key, so one text with a third of all rows is dealt
to many tasks); runs are joined again by the SHA-256 of the normalised text over rows without text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import written

#: Characters of a text that are part of the range key; with the hash they bound what splitters bring to the driver.
PREFIX_CHARS = 24
_LEAD, _HASH, _SHA, _HEAD, _ROW, _PART = "__lead", "__hash", "__sha256", "__head", "__row", "__part"


def _runs(batches: Iterator[pa.RecordBatch], text: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in sort order, each with its text's digest and whether it is the first of its run in this partition."""
    group, seen = None, {}
    for batch in batches:
        table = pa.Table.from_batches([batch])
        keys = zip(batch.column(_LEAD).to_pylist(), batch.column(_HASH).to_pylist(), strict=True)
        digests, heads = [], []
        for key, value in zip(keys, batch.column(text), strict=True):
            content = (value.as_py() or "").encode().lower()  # bytes.lower changes A-Z alone
            if key != group:
                group, seen = key, {}
            heads.append(content not in seen)
            if heads[-1]:
                seen[content] = hashlib.sha256(content).hexdigest()
            digests.append(seen[content])
        table = table.append_column(_SHA, pa.array(digests, pa.string())).append_column(_HEAD, pa.array(heads, pa.bool_()))
        yield from table.select(schema.names).cast(schema).to_batches()


def content_sorted(df: DataFrame, id_col: str, text_col: str, keep: str, columns: list[str]) -> DataFrame:
    """``columns`` of ``df`` with ``__sha256``, ``__head`` (first of a run within its partition) and ``__row`` (unique),
    written once. Within a run the id to keep comes first."""
    if keep not in ("min", "max"):
        raise ValueError("keep is 'min' or 'max'")
    lowered = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    order = F.col(id_col).asc_nulls_last() if keep == "min" else F.col(id_col).desc_nulls_last()
    taken = list(dict.fromkeys([*columns, id_col, text_col]))
    keyed = df.select(*taken, F.substring(lowered, 1, PREFIX_CHARS).alias(_LEAD), F.xxhash64(lowered).alias(_HASH))
    keys = [F.col(_LEAD), F.col(_HASH), order]
    dealt = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys)
    out = T.StructType([*(df.schema[c] for c in columns), T.StructField(_SHA, T.StringType()), T.StructField(_HEAD, T.BooleanType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)
    return written(dealt.mapInArrow(lambda it: _runs(it, text_col, arrow), out).withColumn(_ROW, F.monotonically_increasing_id()), "content-sorted")


def _keepers(rows: DataFrame, id_col: str, keep: str) -> DataFrame:
    """For each run (``__part``, digest): the rows of its text in all runs, and the one that stays (the id to keep, then
    the first row; null ids last). A text with many rows has a run in each of many partitions, none larger than one."""
    # ordered, never negated: the least long has no negative. Row numbers are not negative
    least = keep == "min"
    known, row = (F.col(id_col).isNull(), F.col(_ROW)) if least else (F.col(id_col).isNotNull(), -F.col(_ROW))
    pick = F.min if least else F.max
    runs = rows.groupBy(_PART, _SHA).agg(F.count(F.lit(1)).alias("n"), pick(F.struct(known.alias("a"), F.col(id_col).alias("b"), row.alias("r"))).alias("best"))
    texts = runs.groupBy(_SHA).agg(F.sum("n").alias("group_size"), pick("best").alias("__best"))
    return runs.select(_PART, _SHA).join(texts, _SHA)


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when identical after lower-casing A-Z; null text counts as empty, and all empty texts are one
    group. Ids are numeric. The smallest (``keep='min'``) or largest id of a group stays; a null id stays only where
    all are null; of rows that tie on the id exactly one stays. An empty table gives an empty result. Other columns
    are not read, whatever their names.
    """
    source = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = content_sorted(source, "doc_id", "text", keep, ["doc_id"]).withColumn(_PART, F.shiftright(_ROW, 33))
    best = _keepers(rows, "doc_id", keep)
    joined = rows.join(best, [_PART, _SHA])
    return joined.select(
        F.col("doc_id").alias(id_col), F.col("__best.b").cast(df.schema[id_col].dataType).alias("keep_id"), "group_size",
        (F.col(_ROW) == F.abs("__best.r")).alias("kept"), F.col(_SHA).alias("text_sha256"),
    )


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """``df`` with all its columns, one row of each group of equal texts (see :func:`exact_duplicates`).

    The first row of a run is the one to keep, so texts are not shuffled again: only runs that cross a partition's
    end have several first rows, and those (at most a few for each partition) are taken out by an anti-join.
    """
    rows = content_sorted(df, id_col, text_col, keep, df.columns)
    heads = rows.filter(_HEAD)
    # the runs that meet at partition ends: the first rows of a text beyond its best
    wanted = F.col(id_col).asc_nulls_last() if keep == "min" else F.col(id_col).desc_nulls_last()
    several = heads.groupBy(_SHA).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(_SHA)
    again = heads.select(_SHA, id_col, _ROW).join(several, _SHA, "left_semi")
    place = F.row_number().over(Window.partitionBy(_SHA).orderBy(wanted, F.col(_ROW)))
    losers = again.withColumn("__place", place).filter("__place > 1").select(_ROW)
    return heads.join(losers, _ROW, "left_anti").select(*df.columns)
