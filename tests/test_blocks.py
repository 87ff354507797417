"""Dense blocks: whole tiles for a model, cut back to the image's cells; raster files of them."""

from __future__ import annotations

import numpy as np

from landcube.operators import blocks, model
from landcube.sources import rastersource, sinks


def scene(spark, rows=11, columns=9, pixels=96, years=(2000, 2002)):
    rng = np.random.default_rng(2)
    cells = [(y, p // columns, p % columns, float(rng.normal()), float(rng.normal())) for y in years for p in range(pixels) if rng.random() > 0.1]
    return cells, spark.createDataFrame(cells + [(1999, 0, 0, 1.0, 1.0), (2000, -1, 0, 1.0, 1.0)], "yr int, r int, c int, a double, b double")


def test_round_trip(spark):
    cells, df = scene(spark)
    made = blocks.to_blocks(df, [2000, 2002], ["a", "b"], 4)
    assert made.count() == 9
    whole = {(r["yr"], r["r"], r["c"]): (r["a"], r["b"]) for r in blocks.to_cells(made, 9, 96, ["a", "b"]).collect()}
    assert len(whole) == 2 * 96  # every pixel of the image, none beyond
    own = {(y, r, c): (a, b) for y, r, c, a, b in cells}
    assert all(v == own.get(k, (0.0, 0.0)) for k, v in whole.items())


def test_model_gets_whole_tiles(spark):
    cells, df = scene(spark)
    made = blocks.to_blocks(df, [2000, 2002], ["a", "b"], 4)

    def load():
        def run(x):
            assert x.shape == (2, 2, 4, 4)
            # what no batch of cells could know: the tile's own mean
            return np.where(x[:, 0] > x[:, 0].mean(), 1.0, 0.0)

        return run

    got = {(r["yr"], r["r"], r["c"]): r["cls"] for r in blocks.to_cells(model.segmented(made, load, [2000, 2002]), 9, 96, ["cls"]).collect()}
    x = np.zeros((2, 12, 12))
    for y, r, c, a, _ in cells:
        x[(y - 2000) // 2, r, c] = a
    for (y, r, c), cls in got.items():
        tile = x[:, r // 4 * 4 : r // 4 * 4 + 4, c // 4 * 4 : c // 4 * 4 + 4]
        assert cls == float(x[(y - 2000) // 2, r, c] > tile.mean())


def test_files_of_blocks(spark, tmp_path):
    _, df = scene(spark)
    made = blocks.to_blocks(df, [2000, 2002], ["a", "b"], 4)
    for form, dtype in (("npy", "<f8"), ("tif", "<f4"), ("png", "u1")):
        for _ in range(2):  # a task that is run again
            sinks.write_files(blocks.encoded(made, form, dtype, "t"), str(tmp_path / form))
        listed = rastersource.info(spark, str(tmp_path / form), f"*.{form}")
        assert listed.where("error is null and bands = 2 and rows = 4 and columns = 4").count() == 18
        assert len(list((tmp_path / form).iterdir())) == 18


def test_no_cells(spark):
    none = spark.createDataFrame([], "yr int, r int, c int, a double")
    made = blocks.to_blocks(none, [2000], ["a"], 4)
    assert blocks.to_cells(made, 9, 81, ["a"]).count() == 0


def test_repeated_and_null_cells(spark):
    df = spark.createDataFrame([(1, 0, 0, 2.0), (1, 0, 0, 7.0), (1, 0, 0, None), (1, 1, 1, None)], "yr int, r int, c int, a double")
    got = {(r["r"], r["c"]): r["a"] for r in blocks.to_cells(blocks.to_blocks(df, [1], ["a"], 2), 2, 4, ["a"]).collect()}
    assert got == {(0, 0): 7.0, (0, 1): 0.0, (1, 0): 0.0, (1, 1): 0.0}
