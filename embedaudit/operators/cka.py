"""Linear CKA of paired vectors from cross-moments: the n x n Gram matrices are never built.

A task adds up its cells' moments: sums of both sides and the three product matrices, as one flat array of doubles cut
into pieces of bounded size. Pieces travel as bytes and are added up in two levels, some dozen tasks' first, then a
cell's; no entry is a row of its own and no cell's whole matrix is in one place. Of wide vectors a task would hold few
rows of a cell and still hand on its whole matrix, so there rows are dealt by cell first, a large cell's to several
tasks. Cohorts' moments add up to the pooled ones.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of matrices that a task holds before it hands them on.
MOST_BYTES = 128 << 20
#: Doubles of a piece, and tasks whose pieces are added up first.
PIECE, FAN = 1 << 14, 64
#: Vectors wider than this are dealt by cell; a task then has this many rows of a cell for each component, about.
NARROW, ROWS_EACH = 64, 32


def _dealt(rows: DataFrame, keys: list[str], x: str, y: str, width: int) -> DataFrame:
    """Rows of a cell together, those of a large one in several parts of some ROWS_EACH * width rows."""
    largest = rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 1
    parts = max(1, -(-largest // (ROWS_EACH * width)))
    part = F.pmod(F.xxhash64(x, y, F.spark_partition_id()), F.lit(parts))
    return rows.withColumn("__part", part).repartition(*keys, "__part").sortWithinPartitions(*keys, "__part").drop("__part")


def cross_moments(pairs: DataFrame, keys: list[str], x: str = "baseline", y: str = "vector", pooled: str | None = None, width: int | None = None) -> DataFrame:
    """Per cell: ``n, width`` and ``moments``, the flat array [sum x, sum y, xx', xy', yy'] over rows with both vectors,
    in rows of one ``piece`` each, as bytes. With ``pooled``, one of the keys, also the cells of all its values together
    (POOLED there): no row of the input is read twice.

    Vectors have the same ``width`` throughout (looked up if it is not given); NaN and null vectors are left out.
    """
    rows = pairs.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y)
    if width is None:
        one = rows.select(F.size(x).alias("width")).first()
        width = one["width"] if one else 0
    if width > NARROW:
        rows = _dealt(rows, keys, x, y, width)
    of = ", ".join(f"`{k}` {pairs.schema[k].dataType.simpleString()}" for k in keys)
    schema = ", ".join(filter(None, [of, "n long, piece int, moments binary"]))

    def table(sums: dict) -> pa.RecordBatch:
        out = [(*k, n, i // PIECE, m[i : i + PIECE].tobytes()) for k, (n, m) in sums.items() for i in range(0, len(m), PIECE)]
        return pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=[*keys, "n", "piece", "moments"]).astype({"piece": "int32"}), preserve_index=False)

    def partial(batches):
        # one array for each cell and task, unless the cells' matrices outgrow MOST_BYTES
        sums, held = {}, 0
        for batch in batches:
            frame = batch.select(keys).to_pandas()
            groups = frame.groupby(keys, dropna=False, sort=False).indices if keys else {(): np.arange(batch.num_rows)}
            xs, ys = batch.column(len(keys)), batch.column(len(keys) + 1)
            for at in groups.values():
                take, cell = pa.array(at), tuple(frame.iloc[at[0]].tolist()) if keys else ()
                a, b = (np.array(c.take(take).flatten()).reshape(len(at), -1) for c in (xs, ys))
                good = ~(np.isnan(a).any(1) | np.isnan(b).any(1))
                a, b = a[good], b[good]
                moments = np.concatenate([a.sum(0), b.sum(0), (a.T @ a).ravel(), (a.T @ b).ravel(), (b.T @ b).ravel()])
                if cell in sums:
                    sums[cell] = (sums[cell][0] + len(a), sums[cell][1].__iadd__(moments))
                else:
                    held += moments.nbytes
                    sums[cell] = (len(a), moments)
                if held > MOST_BYTES:
                    yield table(sums)
                    sums, held = {}, 0
        if sums:
            yield table(sums)

    parts = rows.mapInArrow(partial, schema)
    if pooled:
        others = [k for k in keys if k != pooled]
        parts = parts.select(*others, F.explode(F.array(pooled, F.lit("POOLED"))).alias(pooled), "n", "piece", "moments").select(*keys, "n", "piece", "moments")
    # planning alone tells how many tasks there will be
    if rows._jdf.rdd().getNumPartitions() > FAN:
        parts = _added(parts.withColumn("__few", F.floor(F.spark_partition_id() / FAN).cast("int")), [*keys, "__few"]).drop("__few")
    out = _added(parts, keys).withColumn("width", F.lit(width))
    out._width = width
    return out


def _added(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Pieces of one cell and place added up: ``keys, n, piece, moments``."""
    by = [*keys, "piece"]

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = np.zeros(len(table["moments"][0].as_py()) // 8)
        for chunk in table["moments"].chunks:
            for value in chunk:
                total += np.frombuffer(value.as_buffer(), np.float64)
        n = sum(table["n"].to_pylist())
        return table.slice(0, 1).select(by).append_column("n", pa.array([n], pa.int64())).append_column("moments", pa.array([total.tobytes()], pa.binary()))

    schema = ", ".join([*(f"`{k}` {parts.schema[k].dataType.simpleString()}" for k in by), "n long, moments binary"])
    return parts.groupBy(*by).applyInArrow(add, schema)


def _squares(n: int, piece: int, moments: bytes, sums: bytes, width: int) -> tuple[float, float, float]:
    """Sums of squared entries of the centred xx', xy' and yy' within one piece."""
    flat, d = np.frombuffer(moments, np.float64), width
    both = np.frombuffer(sums, np.float64)
    place = np.arange(piece * PIECE, piece * PIECE + len(flat)) - 2 * d
    flat, place = flat[place >= 0], place[place >= 0]
    kind, row, column = place // (d * d), place % (d * d) // d, place % d
    left, right = both[row + d * (kind == 2)], both[column + d * (kind >= 1)]
    return tuple(np.bincount(kind, (flat - left * right / n) ** 2, 3).tolist())


def linear_cka(moments: DataFrame, keys: list[str], least: int = 3, decimals: int = 6) -> DataFrame:
    """``n_tiles, linear_cka`` of each cell; cells below ``least`` rows are dropped, NaN where a side has no spread.

    Each piece gives three sums of squares; the sums of the vectors, which centre it, are at the beginning of piece 0.
    """
    width = getattr(moments, "_width", None)
    if width is None:
        one = moments.select("width").first()
        width = one["width"] if one else 0
    kept = moments.filter(F.col("n") >= least).select(*keys, "n", "piece", "moments")
    if 2 * width + 3 * width * width <= PIECE:  # there is no other piece
        whole = kept.withColumn("sums", F.substring("moments", 1, 16 * width))
    else:
        from embedaudit.sources.scratch import written

        kept = written(kept, "moments")
        heads = kept.filter(F.col("piece") <= (2 * width - 1) // PIECE).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("piece", "moments"))).alias("h"))
        heads = heads.select(*(F.col(k).alias(f"__{k}") for k in keys), F.substring(F.aggregate("h", F.lit(b""), lambda s, x: F.concat(s, x["moments"])), 1, 16 * width).alias("sums"))
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
        whole = kept.join(heads, same).select(*keys, "n", "piece", "moments", "sums")

    @F.pandas_udf("xx double, xy double, yy double")
    def squares(n: pd.Series, piece: pd.Series, part: pd.Series, sums: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_squares(*x, width) for x in zip(n, piece, part, sums, strict=True)], columns=["xx", "xy", "yy"])

    found = whole.select(*keys, "n", squares("n", "piece", "moments", "sums").alias("s"))
    cells = found.groupBy(*keys).agg(F.first("n").alias("n_tiles"), *(F.sum(f"s.{c}").alias(c) for c in ("xx", "xy", "yy")))
    spread = F.col("xx") * F.col("yy")
    value = F.when(spread > 0, F.col("xy") / F.sqrt(F.when(spread > 0, spread))).otherwise(F.lit(float("nan")))
    return cells.select(*keys, "n_tiles", F.round(value, decimals).alias("linear_cka"))
