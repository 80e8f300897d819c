"""The perturbation job: images of any size, brought to the models' size, perturbed, and written beside their baselines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels, stores

#: Pixels of a tile's side, as the models take it.
EDGE = 224


def decoded(images: DataFrame, edge: int = EDGE) -> DataFrame:
    """``sample_id`` (the file's name without its ending) and the three channels of each image (``origin, height, width,
    channels, data``, blue first), gray ones three times the same; bicubic to ``edge`` x ``edge`` where the size differs.
    Transparent images are laid on white. Images of one size and kind are worked on in stacks."""

    def work(batches):
        for batch in batches:
            kinds = np.stack([np.array(batch.column(c)) for c in ("height", "width", "channels")], -1)
            for h, w, n in np.unique(kinds, axis=0).tolist():
                alike = np.flatnonzero((kinds == (h, w, n)).all(1))
                step = max(1, kernels._AT_ONCE // max(3 * edge * edge, h * w * n))
                for at in range(0, len(alike), step):
                    some = batch.take(pa.array(alike[at : at + step]))
                    x = np.stack([np.frombuffer(v.as_buffer(), np.uint8).reshape(h, w, n) for v in some.column("data")])
                    if n == 4:
                        share = x[..., 3:] / 255.0
                        x = kernels._bytes(x[..., :3] * share + 255 * (1 - share))
                    x = kernels.fit_tile(np.repeat(x, 3, -1) if n == 1 else x[..., ::-1], edge)
                    ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * edge * edge)
                    flat = [pa.ListArray.from_arrays(ends, pa.array(x[..., k].astype(np.int32).ravel())) for k in range(3)]
                    yield pa.RecordBatch.from_arrays([some.column("sample_id"), *flat], ["sample_id", "red", "green", "blue"])

    named = images.select(F.regexp_extract("origin", r"([^/]+)\.\w+$", 1).alias("sample_id"), "height", "width", "channels", "data")
    return named.mapInArrow(work, "sample_id string, red array<int>, green array<int>, blue array<int>")


def corpus(tiles: DataFrame, grid: DataFrame) -> DataFrame:
    """``sample_id, perturbation_id, category, name, severity, status, notes, data``: every tile through every cell of the
    grid, and as it is (category ``baseline``, no perturbation)."""
    made = kernels.perturb(tiles, grid).withColumn("model", F.lit(None).cast("string"))
    named = stores.with_registry(made).select("sample_id", "perturbation_id", "category", "name", "severity", "status", "notes", "data")

    def packed(batches):
        for batch in batches:
            channels = [np.array(batch.column(c).flatten()).reshape(batch.num_rows, -1) for c in ("red", "green", "blue")]
            data = [np.stack([c[k] for c in channels], -1).astype(np.uint8).tobytes() for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("sample_id"), pa.array(data, pa.binary())], ["sample_id", "data"])

    base = tiles.select("sample_id", "red", "green", "blue").mapInArrow(packed, "sample_id string, data binary")
    none = F.lit(None).cast("string")
    base = base.select(
        "sample_id", F.lit(None).cast("int").alias("perturbation_id"), F.lit("baseline").alias("category"), none.alias("name"), none.alias("severity"),
        F.lit("DONE").alias("status"), F.lit("").alias("notes"), "data",
    )
    return named.unionByName(base)
