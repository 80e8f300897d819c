"""Slide geometry: audit of resolutions, resampling plans and tile plans, all as arithmetic on metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedaudit.functions.text import input_path, output_path

TARGET, TOLERANCE = 0.5, 0.05


def nearest_level(levels: str, mpp, target: float = TARGET):
    """Place of the level whose resolution is nearest to the target, the first on ties; null without a resolution."""
    gaps = F.transform(levels, lambda d, i: F.struct(F.abs(mpp * d - target).alias("gap"), i.alias("i")))
    return F.when(mpp.isNotNull(), F.array_min(gaps)["i"])


def audit(slides: DataFrame, target: float = TARGET) -> DataFrame:
    """``best_level, achieved_mpp, mpp_deviation, needs_resize, status`` of each slide."""
    level = nearest_level("levels", F.col("mpp"), target)
    achieved = F.col("mpp") * F.get("levels", F.col("best_level"))
    out = slides.withColumn("best_level", level).withColumn("achieved_mpp", F.round(achieved, 5))
    gap = F.round(F.abs(F.col("achieved_mpp") - target), 5)
    out = out.withColumn("mpp_deviation", gap).withColumn("needs_resize", gap > TOLERANCE)
    status = F.when(F.col("width").isNull(), "MISSING_FILE").when(F.col("levels").isNull(), "OPEN_ERROR").when(F.col("mpp").isNull(), "MISSING_MPP").otherwise("OK")
    out = out.withColumn("status", status)
    resize = F.format_string(f"no level within tolerance of {target} MPP (nearest: %.3f); needs a resize step", F.col("achieved_mpp"))
    note = F.when(status == "MISSING_FILE", "file not found").when(status == "OPEN_ERROR", "could not be opened").when(status == "MISSING_MPP", "no resolution in metadata").when(F.col("needs_resize"), resize)
    return out.withColumn("notes", F.coalesce(note, F.lit("")))


def large_enough(slides: DataFrame, edge: int = 512) -> DataFrame:
    """Slides that exceed the tile's edge in both dimensions."""
    return slides.filter((F.col("width") > edge) & (F.col("height") > edge))


def build_jobs(manifest: DataFrame, in_root: str, out_root: str) -> DataFrame:
    """One job for each case, and one for each control allocated to a case: ``job_id, kind, source, target``."""
    job = lambda kind, rows, key: rows.select(key.alias("job_id"), F.lit(kind).alias("kind"), input_path(in_root, F.col("case_id").cast("string"), F.col("f"), F.col("file_name")).alias("source"), output_path(out_root, F.col("case_id").cast("string"), F.col("f")).alias("target"))
    case = job("case", manifest.withColumn("f", F.lit(None).cast("string")), F.col("case_id").cast("string"))
    control = job("control", manifest.filter("file_id IS NOT NULL").withColumn("f", F.col("file_id").cast("string")), F.col("file_id").cast("string"))
    return case.unionByName(control)


def attach_files(rows: DataFrame, path: str, listing: DataFrame) -> DataFrame:
    """``rows`` with ``found`` and ``found_size`` of the expected path in a listing (``path, length``); rows without
    a file stay. A path that is listed twice counts once, with its largest size."""
    seen = listing.groupBy(F.col("path").alias("__path")).agg(F.max("length").alias("found_size"))
    return rows.join(seen, F.col(path) == F.col("__path"), "left").withColumn("found", F.col("__path").isNotNull()).drop("__path")


def resample_report(jobs: DataFrame, listing: DataFrame, results: DataFrame) -> DataFrame:
    """``job_id, status``: SKIPPED_EXISTING where the target is listed with more than 0 bytes, MISSING_INPUT without the
    source, else what the run says (``results``: job_id, ok): DONE or ERROR."""
    there = attach_files(jobs, "target", listing).select("job_id", "source", (F.coalesce("found_size", F.lit(0)) > 0).alias("made"))
    ran = results.select(F.col("job_id").alias("__job"), "ok")
    both = attach_files(there, "source", listing).join(ran, F.col("job_id") == F.col("__job"), "left")
    return both.select("job_id", F.when(F.col("made"), "SKIPPED_EXISTING").when(~F.col("found"), "MISSING_INPUT").when(F.col("ok"), "DONE").otherwise("ERROR").alias("status"))


def sample_tiles(slides: DataFrame, tiles: DataFrame, k: int, seed: int, max_attempts: int = 25) -> DataFrame:
    """``slide_id, slot, attempt, place``: k tiles a slide that are no background. ``slides`` has ``places``, the number
    of a slide's places; ``tiles`` says of (slide_id, place) whether it ``is_background``.

    Each slot tries hashed places, ``max_attempts`` at most, and takes the first that will do; a slot without one has
    no row. Slots may take the same place."""
    tries = slides.select("slide_id", "places", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("slot")).select("*", F.explode(F.sequence(F.lit(0), F.lit(max_attempts - 1))).alias("attempt"))
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("slide_id"), F.col("slot"), F.col("attempt"), F.lit(seed)).cast("binary")), 1, 8), 16, 10).cast("long")
    met = tries.withColumn("place", F.pmod(draw, F.col("places"))).join(tiles.filter("NOT is_background").select("slide_id", "place"), ["slide_id", "place"])
    return met.groupBy("slide_id", "slot").agg(F.min(F.struct("attempt", "place")).alias("b")).select("slide_id", "slot", "b.attempt", "b.place")


def resample_plan(audited: DataFrame, target: float = TARGET) -> DataFrame:
    """Output size of each slide at the target resolution, from its best level; slides without resolution have none."""
    down = F.get("levels", F.col("best_level"))
    scale = F.col("mpp") * down / target
    side = lambda c: F.greatest(F.lit(1), F.floor(F.col(c) / down * scale + 0.5)).cast("int")
    return audited.filter("mpp IS NOT NULL").select("slide_id", "best_level", F.round(scale, 6).alias("scale"), side("width").alias("out_width"), side("height").alias("out_height"))


def tile_plan(plan: DataFrame, edge: int = 512) -> DataFrame:
    """Row-major tiles that cover each output, the last of a row or column with its valid size only."""
    count = lambda c: F.ceil(F.col(c) / edge).cast("int")
    rows = plan.withColumn("tile_row", F.explode(F.sequence(F.lit(0), count("out_height") - 1)))
    cells = rows.withColumn("tile_col", F.explode(F.sequence(F.lit(0), count("out_width") - 1)))
    x, y = F.col("tile_col") * edge, F.col("tile_row") * edge
    return cells.select(
        "slide_id", "tile_row", "tile_col", x.alias("x"), y.alias("y"), F.least(F.lit(edge), F.col("out_width") - x).alias("valid_width"), F.least(F.lit(edge), F.col("out_height") - y).alias("valid_height"),
        F.round(x / F.col("scale"), 4).alias("source_x"), F.round(y / F.col("scale"), 4).alias("source_y"),
    )
