"""Conditions held out from the battery: applied to baseline tiles alone, stored under keys of their own, tested apart.

A condition is a function of a tile's pixels. Tiles are brought to the models' input size, changed, and embedded by
each model's adapter; what a store holds already, by key, is not computed again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embedaudit.functions.text import FAMILIES, held_out_key, p_value_stars
from embedaudit.functions.vectors import cosine

from . import cells, families, kernels, stores

# The conditions' names and the threshold from which solarize inverts.
PAIRED, BETWEEN_FAMILIES, THRESHOLD = ("flip_h", "flip_v"), "solarize", 128
# Labels of what is predicted and observed; models trained in the first way against all others.
FLIP_LABELS = ("hflip_greater", "vflip_greater", "no_significant_difference")
FAMILY_LABELS = ("dinov2_greater", "clip_greater", "no_significant_difference")
PREDICTED_FLIP = {"dinov2": "hflip_greater"}
PREDICTED_SOLARIZE = "dinov2_greater"
LEAST = 10

CONDITIONS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "flip_h": lambda x: x[..., ::-1, :],
    "flip_v": lambda x: x[..., ::-1, :, :],
    "solarize": lambda x: np.where(x < THRESHOLD, x, 255 - x),
}
#: Conditions that take a stack of tiles at once; those registered later take one tile.
_STACKED = dict(CONDITIONS)
#: Tiles that a model takes at once, at most, and pixel values of the tiles that are worked on at once, about.
BATCH, _AT_ONCE = 256, 1 << 22


def register_condition(name: str, change: Callable[[np.ndarray], np.ndarray]) -> None:
    """Adds a condition, a function of pixels (rows, columns, 3). Jobs carry their conditions to the workers, so what is
    registered on the driver is known there. A name that is taken, or that a key can't be parsed with, is an error."""
    if name in CONDITIONS or "__" in name or name == "baseline":
        raise ValueError(f"a condition can't be named {name}")
    CONDITIONS[name] = change


def _stacks(batch: pa.RecordBatch, edge: int):
    """The batch's rows with tiles of one size, some at a time, and these tiles as a stack, resized to ``edge``."""
    sizes = batch.column("red").value_lengths().to_numpy()
    for size in np.unique(sizes).tolist():
        alike, side = np.flatnonzero(sizes == size), int(round(size**0.5))
        step = max(1, min(BATCH, _AT_ONCE // max(1, 3 * size, 3 * edge * edge)))
        for at in range(0, len(alike), step):
            some = batch.take(pa.array(alike[at : at + step]))
            channels = [some.column(c).flatten().to_numpy().reshape(-1, side, side) for c in ("red", "green", "blue")]
            yield some, kernels.fit_tile(np.stack(channels, -1).astype(np.uint8), edge)


def _changes(names) -> dict[str, tuple[Callable[[np.ndarray], np.ndarray], bool]]:
    """The conditions as they are now on the driver, and whether they take a stack at once."""
    known = CONDITIONS | {"baseline": lambda x: x}
    return {n: (known[n], n == "baseline" or known[n] is _STACKED.get(n)) for n in names}


def _channels(stack: np.ndarray, change: tuple) -> list[np.ndarray]:
    """The three channels of a stack's tiles under a condition, a row of integers for each tile."""
    f, at_once = change
    changed = f(stack) if at_once else np.stack([f(x) for x in stack])
    return [changed[..., k].reshape(len(stack), stack.shape[1] * stack.shape[2]).astype(np.int32) for k in range(3)]


def _lists(rows: np.ndarray) -> pa.ListArray:
    ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1])
    return pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(rows).ravel()))


def conditioned(tiles: DataFrame, todo: DataFrame, edge: int) -> DataFrame:
    """``sample_id`` (the key) and channels of the tiles under the conditions of ``todo`` (sample_id, condition); the
    condition ``baseline`` leaves the tile as it is. Tiles of another size are resized to ``edge`` first."""
    changes = _changes([*CONDITIONS, "baseline"])
    rows = tiles.select("sample_id", "red", "green", "blue").join(todo, "sample_id")

    def work(batches):
        for batch in batches:
            for some, stack in _stacks(batch, edge):
                names = np.array(some.column("condition").to_pylist())
                for name in np.unique(names).tolist():
                    mine = np.flatnonzero(names == name)
                    keys = [f"{name}__{x}" for x in some.column("sample_id").take(pa.array(mine)).to_pylist()]
                    arrays = [pa.array(keys, pa.string()), *map(_lists, _channels(stack[mine], changes[name]))]
                    yield pa.RecordBatch.from_arrays(arrays, ["sample_id", "red", "green", "blue"])

    return rows.filter("red IS NOT NULL").mapInArrow(work, "sample_id string, red array<int>, green array<int>, blue array<int>")


_MODELS: dict = {}


def _model(job: str, name: str, make: Callable) -> Callable[..., np.ndarray]:
    """The adapter's model, made once in each worker; those of the job before are let go."""
    if job not in _MODELS:
        _MODELS.clear()
        _MODELS[job] = {}
    made = _MODELS[job]
    if name not in made:
        made[name] = make()
    return made[name]


def embedded(tiles: DataFrame, adapters: dict[str, Callable], store: DataFrame | None = None, conditions: tuple[str, ...] | None = None, edge: int = 224) -> DataFrame:
    """``model, key, vector`` of every tile, model and condition whose key the ``store`` (model, key, ...) lacks.

    ``conditions`` are all that are registered, and may name ``baseline``. Only what is lacking is changed and embedded. A
    tile comes to Python once, with the numbers of its lacking cells, and is changed and embedded there in small stacks.
    """
    names = tuple(dict.fromkeys(CONDITIONS if conditions is None else conditions))
    changes, adapters, job = _changes(names), dict(adapters), uuid.uuid4().hex
    pairs = [(name, model) for name in names for model in adapters]
    rows = tiles.select(F.col("sample_id").cast("string").alias("sample_id"), "red", "green", "blue").filter("red IS NOT NULL AND sample_id IS NOT NULL")
    every = F.array(*map(F.lit, range(len(pairs)))).cast("array<int>")
    if store is None:
        rows = rows.withColumn("cells", every)
    else:
        numbered = F.array(*[F.struct(F.lit(k), F.lit(model), held_out_key(F.lit(name), F.lit(""))) for k, (name, model) in enumerate(pairs)])
        numbered = numbered.cast("array<struct<cell: int, model: string, prefix: string>>")
        met = F.filter(numbered, lambda c: (c["model"] == F.col("model")) & F.startswith(F.col("key"), c["prefix"]))
        held = store.select("key", F.explode(met).alias("c")).groupBy(F.expr("substring(key, length(c.prefix) + 1)").alias("sample_id")).agg(F.collect_set("c.cell").alias("held"))
        left = F.coalesce(F.array_except(every, "held"), every)
        rows = rows.join(held, "sample_id", "left").select("sample_id", "red", "green", "blue", left.alias("cells"))

    def run(batches):
        for batch in batches:
            for some, stack in _stacks(batch, edge):
                ids, wanted = np.array(some.column("sample_id").to_pylist(), object), some.column("cells")
                lacks = np.zeros((len(pairs), len(ids)), bool)
                lacks[wanted.flatten().to_numpy(), wanted.value_parent_indices().to_numpy()] = True
                out = []
                for (name, change), models in zip(changes.items(), lacks.reshape(len(names), len(adapters), len(ids)), strict=True):
                    some_model = np.flatnonzero(models.any(0))
                    if not len(some_model):
                        continue
                    channels = [x.astype(float) for x in _channels(stack[some_model], change)]
                    for (model, make), lacking in zip(adapters.items(), models[:, some_model], strict=True):
                        if lacking.any():
                            vectors = np.asarray(_model(job, model, make)(*(x[lacking] for x in channels)), float)
                            mine = ids[some_model[lacking]]
                            if vectors.ndim != 2 or len(vectors) != len(mine):
                                raise ValueError(f"{model} made {vectors.shape} of {len(mine)} tiles")
                            out.append([pa.array([model] * len(mine)), pa.array([f"{name}__{x}" for x in mine], pa.string()), _lists(vectors)])
                if out:
                    yield pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(*out, strict=True)], ["model", "key", "vector"])

    return rows.filter(F.size("cells") > 0).mapInArrow(run, "model string, key string, vector array<double>")


def similarities(store: DataFrame, decimals: int = 6) -> DataFrame:
    """``model, condition, sample_id, similarity``: every held-out vector against its tile's baseline vector."""
    parsed = store.select("model", F.split_part("key", F.lit("__"), F.lit(1)).alias("condition"), F.expr("substring(key, instr(key, '__') + 2)").alias("sample_id"), "vector")
    base = parsed.filter("condition = 'baseline'").select("model", "sample_id", F.col("vector").alias("baseline"))
    met = parsed.filter("condition <> 'baseline'").join(base, ["model", "sample_id"])
    return met.select("model", "condition", "sample_id", F.round(cosine("baseline", "vector"), decimals).alias("similarity"))


def family_of(model: Column) -> Column:
    return stores._literals(FAMILIES, model)


def flip_test(sims: DataFrame, predicted: dict[str, str] = PREDICTED_FLIP) -> DataFrame:
    """Per model the paired test of the two flips, with what its family was predicted to show, what it shows and whether
    that confirms it. Models with fewer than LEAST pairs have no row."""
    a, b = PAIRED
    pairs = families.paired_conditions(sims, ["model"], "sample_id", "condition", a, b, "similarity")
    tests = families.wilcoxon_signed_rank(pairs, ["model"], least=LEAST).filter(F.col("n_pairs") >= LEAST)
    label = F.coalesce(stores._literals(predicted, family_of(F.col("model"))), F.lit(FLIP_LABELS[2]))
    return families.with_prediction(tests.withColumn("family", family_of(F.col("model"))), *FLIP_LABELS, label)


def solarize_test(sims: DataFrame) -> DataFrame:
    """One row: the condition's similarities of the first family's models against all others', by the two-sample test;
    no row if a side has fewer than LEAST values. ``cliffs_delta`` from the rank sums beside Cohen's d."""
    rows = sims.filter(F.col("condition") == BETWEEN_FAMILIES).withColumn("family", family_of(F.col("model"))).filter("family IS NOT NULL")
    first = F.col("family") == "dinov2"
    test = cells.two_sample_test(rows, ["condition"], "similarity", first, LEAST).filter("NOT skipped")
    ranks = cells.mann_whitney(rows, ["condition"], "similarity", first).select("condition", "u")
    delta = families.cliffs_delta(F.col("u"), F.col("n_a"), F.col("n_b"))
    seen = test.join(ranks, "condition").withColumn("cliffs_delta", delta).drop("u").withColumn("difference", F.col("mean_a") - F.col("mean_b"))
    return families.with_prediction(seen, *FAMILY_LABELS, F.lit(PREDICTED_SOLARIZE), "difference").drop("difference")


def summary(flips: DataFrame) -> DataFrame:
    """Per model: its family, the median difference, 2g, stars and whether the prediction was confirmed."""
    return flips.select("model", "family", F.col("n_pairs").alias("n"), "median_diff", "cohens_2g", p_value_stars(F.col("p_value")).alias("stars"), "confirmed")


def family_means(solarized: DataFrame) -> DataFrame:
    """``family, mean, n`` of the two sides of :func:`solarize_test`."""
    sides = F.array(*[F.struct(F.lit(name).alias("family"), F.col(f"mean_{s}").alias("mean"), F.col(f"n_{s}").alias("n")) for name, s in (("dinov2", "a"), ("clip", "b"))])
    return solarized.select(F.inline(sides))


def bounded_effects(flips: DataFrame, solarized: DataFrame) -> DataFrame:
    """``label, statistic, value``: effect sizes between -1 and 1, one for each model and one for the families."""
    paired = flips.select("model", F.lit("cohens_2g").alias("statistic"), F.col("cohens_2g").alias("value")).withColumnRenamed("model", "label")
    return paired.unionByName(solarized.select(F.lit("dinov2 against clip").alias("label"), F.lit("cliffs_delta").alias("statistic"), F.col("cliffs_delta").alias("value")))
