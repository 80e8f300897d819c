"""Images of any size and kind as tiles, packed bitmaps, and a corpus with baselines."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from embedaudit.operators import kernels, tile_job
from embedaudit.sources import files

IMAGES = "origin string, height int, width int, channels int, data binary"


def _images(spark):
    rng = np.random.default_rng(2)
    made = {"rgb": rng.integers(0, 256, (20, 31, 3)), "gray": rng.integers(0, 256, (40, 40, 1)), "clear": rng.integers(0, 256, (9, 9, 4)), "same": rng.integers(0, 256, (32, 32, 3))}
    return made, spark.createDataFrame([(f"file:/x/{k}.png", *v.shape, bytearray(v.astype(np.uint8).tobytes())) for k, v in made.items()], IMAGES)


def test_images_become_tiles_of_one_size(spark):
    made, images = _images(spark)
    got = {r["sample_id"]: np.stack([r[c] for c in ("red", "green", "blue")], -1).reshape(32, 32, 3) for r in tile_job.decoded(images, 32).collect()}
    assert set(got) == set(made)
    assert (got["same"] == made["same"][..., ::-1]).all()  # stored blue first
    assert (got["rgb"] == kernels.fit_tile(made["rgb"][..., ::-1].astype(np.uint8), 32)).all()
    assert (got["gray"][..., 0] == got["gray"][..., 2]).all()
    white = tile_job.decoded(spark.createDataFrame([("a/b.png", 4, 4, 4, bytearray(64))], IMAGES), 4).first()
    assert set(white["red"]) == {255}
    assert len(tile_job.decoded(images).filter("sample_id = 'rgb'").first()["red"]) == 224 * 224


def test_a_corpus_has_baselines_and_comes_back(spark, tmp_path):
    made, images = _images(spark)
    tiles = tile_job.decoded(images, 16).cache()
    grid = spark.createDataFrame([(10, "severe"), (11, "mild"), (97, "mild")], "perturbation_id int, severity string")
    path = str(tmp_path / "corpus")
    rows = tile_job.corpus(tiles, grid)
    assert {r["status"] for r in rows.filter("perturbation_id = 97").collect()} == {"ERROR"}
    files.write_corpus(rows.filter("status = 'DONE'"), path)
    back = files.read_corpus(spark, path)
    assert back.count() == 4 * 3 and back.filter("severity IS NULL AND perturbation_id IS NULL AND category = 'baseline'").count() == 4
    turned = {r["sample_id"]: r["data"] for r in back.filter("perturbation_id = 11").collect()}
    base = {r["sample_id"]: np.frombuffer(r["data"], np.uint8).reshape(16, 16, 3) for r in back.filter("category = 'baseline'").collect()}
    assert all((np.frombuffer(turned[k], np.uint8).reshape(16, 16, 3) == np.rot90(x)).all() for k, x in base.items())
    assert back.filter(F.col("name").isNotNull()).select("name").distinct().count() == 2


def _bitmap(rng, height, width, bits, palette=None, packing=0):
    """A bitmap of random pixels; a negative height stores the top row first."""
    step = -(-width * bits // 32) * 4
    table, pixels = b"" if palette is None else bytes(palette), rng.integers(0, 256, abs(height) * step).astype(np.uint8).tobytes()
    head = struct.pack("<2sIHHI", b"BM", 54 + len(table) + len(pixels), 0, 0, 54 + len(table))
    return head + struct.pack("<IiiHHIIiiII", 40, width, height, 1, bits, packing, len(pixels), 2835, 2835, len(table) // 4, 0) + table + pixels


def test_packed_bitmaps_are_decoded_as_the_image_source_decodes_files(spark, tmp_path):
    rng = np.random.default_rng(4)
    gray, colours = bytes(v for k in range(256) for v in (k, k, k, 0)), bytes(rng.integers(0, 256, 1024).astype(np.uint8) & 0xFF)
    colours = bytes(0 if k % 4 == 3 else v for k, v in enumerate(colours))
    made = {"gray": _bitmap(rng, 7, 5, 8, gray), "colours": _bitmap(rng, 6, 9, 8, colours), "down": _bitmap(rng, -4, 3, 24), "up": _bitmap(rng, 5, 6, 24), "wide": _bitmap(rng, 3, 4, 32)}
    for name, content in made.items():
        (tmp_path / f"{name}.bmp").write_bytes(content)
    packed = str(tmp_path / "packed")
    spark.createDataFrame([(f"/{k}.bmp", bytearray(v)) for k, v in made.items()], "path string, content binary").coalesce(1).write.parquet(packed)
    shown = lambda df: {r["origin"].rsplit("/", 1)[1]: (r["height"], r["width"], r["channels"], bytes(r["data"])) for r in df.collect()}
    want, got = shown(files.read_tiles(spark, f"file://{tmp_path}/*.bmp")), shown(files.read_packed(spark, packed))
    assert len(want) == len(made) and got == want


@pytest.mark.parametrize("content", [b"BM", b"no bitmap" * 20, _bitmap(np.random.default_rng(0), 4, 4, 24, packing=1), _bitmap(np.random.default_rng(0), 4, 4, 24)[:-1]])
def test_what_is_no_whole_bitmap_is_an_error_with_its_path(spark, tmp_path, content):
    path = str(tmp_path / "packed")
    spark.createDataFrame([("/bad.bmp", bytearray(content))], "path string, content binary").write.parquet(path)
    with pytest.raises(Exception, match=r"/bad.bmp can't be decoded"):
        files.read_packed(spark, path).count()


def test_images_don_t_grow_in_files_with_the_tiles(spark, tmp_path):
    """300 tiles of two tasks are two files, and come back as they are."""
    rng = np.random.default_rng(5)
    tiles = spark.createDataFrame([(f"t{k}", rng.integers(0, 256, 25).tolist()) for k in range(300)], "sample_id string, red array<int>").repartition(2).cache()
    path = str(tmp_path / "images")
    files.write_gray_images(tiles, "sample_id", "red", 5, path)
    assert len([x for x in (tmp_path / "images").rglob("*") if x.is_file() and not x.name.startswith((".", "_"))]) == 2
    back = tile_job.decoded(files.read_packed(spark, path), 5).select("sample_id", "red", "green", "blue")
    want = tiles.select("sample_id", "red", F.col("red").alias("green"), F.col("red").alias("blue"))
    assert back.count() == 300 and back.exceptAll(want).count() == 0
