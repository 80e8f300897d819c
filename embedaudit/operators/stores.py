"""Vectors computed for what a store lacks, what the registry says of cells, and summaries of both."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from embedaudit.functions.text import FAMILIES

from . import kernels

MODELS = ("uni", "conch", "quilt_llava", "gigapath_tile")


def grid_mean_model() -> Callable[..., np.ndarray]:
    """The model without weights: means of 4 x 4 cells of the three channels in 0..1, cell by cell, with zeros up to 64."""

    def predict(red: np.ndarray, green: np.ndarray, blue: np.ndarray) -> np.ndarray:
        edge = int(round(red.shape[1] ** 0.5))
        tiles = np.stack([red, green, blue], -1).reshape(len(red), 4, edge // 4, 4, edge // 4, 3) / 255.0
        return np.pad(tiles.mean((2, 4)).reshape(len(red), 48), ((0, 0), (0, 16)))

    return predict


def profile_model(rows: bool, columns: bool) -> Callable[[], Callable[..., np.ndarray]]:
    """A model without weights: the means of all rows, all columns or both, over the channels, in 0..1."""

    def make() -> Callable[..., np.ndarray]:
        def predict(red: np.ndarray, green: np.ndarray, blue: np.ndarray) -> np.ndarray:
            edge = int(round(red.shape[1] ** 0.5))
            gray = ((red + green + blue) / 3.0 / 255.0).reshape(len(red), edge, edge)
            return np.concatenate([gray.mean(2)] * rows + [gray.mean(1)] * columns, axis=1)

        return predict

    return make


def embed(tiles: DataFrame, make_model: Callable[[], Callable[..., np.ndarray]], done: DataFrame | None, pixels: int, batch: int = 256) -> DataFrame:
    """``sample_id, vector`` of the tiles that ``done`` does not hold: ``make_model`` is called once in each worker and
    gives a function of batches of the three channels. Tiles without pixels are left out."""
    todo = tiles.filter("red IS NOT NULL")
    if done is not None:
        todo = todo.join(done.select("sample_id").distinct(), "sample_id", "left_anti")
    vector = predict_batch_udf(make_model, return_type=ArrayType(DoubleType()), batch_size=batch, input_tensor_shapes=[[pixels]] * 3)
    return todo.select("sample_id", vector(*[F.col(c).cast("array<double>") for c in ("red", "green", "blue")]).alias("vector"))


def mapped_tiles(tiles: DataFrame, change: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``sample_id, red``: the first channel, as text, of each tile changed by a function of its pixels."""

    def work(batches):
        for batch in batches:
            channels = [np.array(batch.column(c).flatten()).reshape(batch.num_rows, -1) for c in ("red", "green", "blue")]
            edge = int(round(channels[0].shape[1] ** 0.5))
            out = [change(np.stack([c[k].reshape(edge, edge) for c in channels], -1).astype(np.uint8))[..., 0] for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("sample_id"), pa.array([",".join(map(str, x.ravel().tolist())) for x in out])], ["sample_id", "red"])

    return tiles.select("sample_id", "red", "green", "blue").mapInArrow(work, "sample_id string, red string")


def _literals(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for item in table.items() for x in item]), key)


def with_registry(df: DataFrame) -> DataFrame:
    """``name`` and ``category`` of each row's perturbation, ``family`` of its model; null for unknown ones."""
    p = F.col("perturbation_id")
    out = df.withColumn("name", _literals({k: v[0] for k, v in kernels.REGISTRY.items()}, p)).withColumn("category", _literals({k: v[1] for k, v in kernels.REGISTRY.items()}, p))
    return out.withColumn("family", _literals(FAMILIES, F.col("model")))


def cell_order(model: str = "model", perturbation: str = "perturbation_id", severity: str = "severity") -> list[Column]:
    """The study's order of cells: models, perturbations by number, severities from mild to severe; unknown ones last."""
    place = lambda c, names: F.coalesce(_literals({n: k for k, n in enumerate(names)}, F.col(c)), F.lit(len(names)))
    return [place(model, MODELS), F.col(perturbation), place(severity, kernels.SEVERITIES)]


def condition_map(df: DataFrame, keys: list[str], condition: str, conditions: list[str], value: str) -> DataFrame:
    """Long rows as one row for each key with a column for each condition; conditions are named, so none is looked for."""
    return df.groupBy(*keys).pivot(condition, conditions).agg(F.max(value))


def weighted_mean(df: DataFrame, a: str, b: str, n_a: str, n_b: str, fixed_n: list[str] | None = None) -> DataFrame:
    """``weighted_mean`` of two means by their sizes: each row's own, or those of the first row in the order given."""
    sizes = [F.col(n_a), F.col(n_b)]
    if fixed_n:
        first = df.agg(F.min(F.struct(*fixed_n, F.col(n_a).alias("__a"), F.col(n_b).alias("__b"))).alias("f")).select("f.__a", "f.__b")
        df, sizes = df.crossJoin(F.broadcast(first)), [F.col("__a"), F.col("__b")]  # one row
    mean = (F.col(a) * sizes[0] + F.col(b) * sizes[1]) / F.nullif(sizes[0] + sizes[1], F.lit(0))
    return df.withColumn("weighted_mean", mean).drop("__a", "__b")


def completeness(tiles: DataFrame, listing: DataFrame, group: str, cells: int) -> DataFrame:
    """``expected`` (tiles times the grid's cells), ``found`` and ``status`` of each group: ok, missing or extra."""
    want = tiles.groupBy(group).agg((F.count("*") * cells).alias("expected"))
    got = listing.groupBy(group).agg(F.count("*").alias("found"))
    both = want.join(got, group, "full").select(group, F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("found", F.lit(0)).alias("found"))
    return both.withColumn("status", F.when(F.col("found") == F.col("expected"), "ok").when(F.col("found") < F.col("expected"), "missing").otherwise("extra"))


def ranked(df: DataFrame, value: str, tie: str, into: str = "place", by: list[str] | None = None) -> DataFrame:
    """Places by value; without ``by`` for tables of a row for each level."""
    return df.withColumn(into, F.row_number().over(Window.partitionBy(*(by or [])).orderBy(value, tie)))
