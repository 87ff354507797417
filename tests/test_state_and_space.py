"""Yearly state, mosaics, boxes joined through cells of several sizes, resampling by any factor and shift."""

from __future__ import annotations

import random
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from landcube.operators import composite, store, tiles, transitions
from landcube.sources import cube as cubes
from landcube.sources import raster

SF = "/root/testdata/sf0.001"


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_adding_a_year_reads_one_year(spark, tmp_path):
    path = str(tmp_path / "state")
    composite.write_state(composite.year_sums(cubes.index_cube(spark, SF, list(range(1995, 2001)))), path, 2000)
    one = cubes.index_cube(spark, SF, [2001])
    for _ in range(2):  # adding it again changes nothing
        composite.add_year(spark, path, one, 2000, 2001)
    got = composite.state_slopes(composite.read_state(spark, path, 2001)).select("px", F.round("ndvi_slope", 9), F.round("ndbi_slope", 9))
    whole = cubes.index_cube(spark, SF).groupBy("px").agg(*composite.slopes()).select("px", F.round("ndvi_slope", 9), F.round("ndbi_slope", 9))
    assert found(got) == found(whole)
    assert sorted(p.name for p in (tmp_path / "state").iterdir() if p.is_dir()) == ["upto=2000", "upto=2001"]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "2001-01-01" in plan and "2002-01-01" in plan and plan.count("FileScan") == 1
    scan = composite.read_state(spark, path, 2000)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in scan and "upto" in scan.split("PartitionFilters")[1].split("]")[0]


def test_mosaic_takes_the_first_valid_pixel(spark):
    rng = random.Random(3)
    rows = [(p, s, rng.choice([None, 0.0, 5.0, 5.0, 96.0]), date(2020, 1, 1 + s % 3), rng.random() < 0.5, float(s)) for p in range(30) for s in range(6)]
    got = {r["px"]: (r["valid"], r["id"], r["v"]) for r in store.mosaic(spark.createDataFrame(rows, "px int, id int, cloud double, start date, valid boolean, v double"), ["px"], ["v"]).collect()}
    for p in range(30):
        own = [r for r in rows if r[0] == p and r[2] is not None and r[2] <= 95]
        if not own:
            assert p not in got
            continue
        usable = sorted([r for r in own if r[4]], key=lambda r: (r[2], -r[3].toordinal(), r[1]))
        assert got[p] == ((True, usable[0][1], usable[0][5]) if usable else (False, None, None))


def boxes(seed, n, size):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        w, s, k = rng.uniform(-200, 190), rng.uniform(-100, 80), size(rng)
        out.append((i, w, s, w + k, s + k * rng.uniform(0.1, 1.5)))
    return out


BOX = "west double, south double, east double, north double"


def test_boxes_of_all_sizes(spark):
    p = boxes(1, 150, lambda r: 10 ** r.uniform(-3, 2)) + [(150, -180.0, -90.0, 180.0, 90.0), (151, 0.0, 0.0, 0.0, 1.0), (152, 10.0, 10.0, 20.0, 20.0)]
    a = boxes(2, 80, lambda r: 10 ** r.uniform(-3, 2.3)) + [(80, -180.0, -90.0, 180.0, 90.0), (81, 20.0, 10.0, 30.0, 20.0), (82, 5.0, 5.0, 5.0, 5.0)]
    products = spark.createDataFrame([(i, 1.0, date(2020, 1, 5), *b) for i, *b in p], f"id int, cloud double, start date, {BOX}")
    areas = spark.createDataFrame([(i, date(2020, 1, 1), *b) for i, *b in a], f"aoi int, target date, {BOX}")
    inside = lambda b: b[2] < b[4] and b[1] < b[3]
    want = [(y[0], x[0]) for x in p for y in a if inside((0, *x[1:])) and inside((0, *y[1:])) and x[1] < y[3] and x[3] > y[1] and x[2] < y[4] and x[4] > y[2]]
    assert found(store.search_products(products, areas, 10, 50.0)) == sorted(want, key=str)


def test_rows_stay_bounded(spark):
    """A box over the globe is four rows, not 2,592; ten thousand small products in one place meet only areas near them."""
    globe = store.levelled(spark.createDataFrame([(-180.0, -90.0, 180.0, 90.0)], BOX))
    assert store.covered(globe, list(range(17)), False).count() <= 4
    rng = random.Random(4)
    some = [(w, s, w + 0.01, s + 0.01) for w, s in ((rng.uniform(10, 14.9), rng.uniform(10, 14.9)) for _ in range(10_000))]
    near = [(w, s, w + 0.02, s + 0.02) for w, s in ((rng.uniform(10, 14.9), rng.uniform(10, 14.9)) for _ in range(300))]
    products, areas = spark.createDataFrame(some, BOX), spark.createDataFrame([*near, (-180.0, -90.0, 180.0, 90.0)], BOX)
    assert store.covered(store.levelled(products), [0, 14], False).count() <= 8 * 10_000
    # the area of the globe meets all; the small ones a few each, where cells of five degrees would pair 3,000,000
    assert 10_000 <= store.candidates(products, areas).count() < 14_000


@pytest.mark.parametrize("tile", [5, 512])
def test_resample_equals_the_whole_factors(spark, tile):
    rng = np.random.default_rng(1)
    cells = spark.createDataFrame([(r, c, float(rng.normal())) for r in range(9) for c in range(8) if rng.random() > 0.2], "r int, c int, v double")
    near = lambda df: {(r["r"], r["c"]): round(r["v"], 9) for r in df.collect()}
    assert near(tiles.resample(cells, "v", (9, 8), (18, 16), (0.5, 0.5), tile=tile)) == near(tiles.bilinear_double(cells, "v", 9, 8))
    assert near(tiles.resample(cells, "v", (9, 8), (5, 4), (2.0, 2.0), method="area", tile=tile)) == near(tiles.shrink(cells, "v", 2))


@pytest.mark.parametrize("scale, shift, target, method", [
    ((2 / 3, 2 / 3), (0.0, 0.0), (16, 18), "bilinear"), ((2 / 3, 0.75), (0.25, -1.5), (15, 20), "bilinear"), ((1.5, 2.5), (0.0, 0.3), (8, 5), "area"), ((0.4, 3.7), (-2.0, 1.1), (30, 3), "area"), ((1.0, 1.0), (40.0, -40.0), (6, 6), "bilinear"), ((1.0, 1.0), (40.0, -40.0), (6, 6), "area"), ((7.0, 5.0), (0.5, 0.5), (2, 3), "bilinear"),
])
def test_resample_equals_numpy(spark, scale, shift, target, method):
    rows, columns = 11, 13
    rng = np.random.default_rng(2)
    x, known = rng.normal(size=(rows, columns)), rng.random((rows, columns)) > 0.15
    want = {}
    for r in range(target[0]):
        for c in range(target[1]):
            weights = np.zeros((rows, columns))
            if method == "bilinear":
                y, z = (r + 0.5) * scale[0] + shift[0] - 0.5, (c + 0.5) * scale[1] + shift[1] - 0.5
                for i, wy in ((int(np.floor(y)), 1 - (y - np.floor(y))), (int(np.floor(y)) + 1, y - np.floor(y))):
                    for j, wz in ((int(np.floor(z)), 1 - (z - np.floor(z))), (int(np.floor(z)) + 1, z - np.floor(z))):
                        weights[min(max(i, 0), rows - 1), min(max(j, 0), columns - 1)] += wy * wz
            else:
                for i in range(rows):
                    for j in range(columns):
                        high = min((r + 1) * scale[0] + shift[0], i + 1) - max(r * scale[0] + shift[0], i)
                        wide = min((c + 1) * scale[1] + shift[1], j + 1) - max(c * scale[1] + shift[1], j)
                        weights[i, j] = max(0, high) * max(0, wide)
            weights *= known
            if weights.sum() > 1e-9:
                want[(r, c)] = round(float((weights * x).sum() / weights.sum()), 6)
    cells = spark.createDataFrame([(int(r), int(c), float(x[r, c])) for r, c in np.argwhere(known)], "r int, c int, v double")
    for tile in (4, 512):
        got = {(r["r"], r["c"]): round(r["v"], 6) for r in tiles.resample(cells, "v", (rows, columns), target, scale, shift, method, tile).collect()}
        assert got == pytest.approx(want)


def test_tiles_of_unlike_shape_are_not_compared(spark):
    cells = [(y, r * 8 + c, r, c, 2 if y == 1 else 1) for y in (1, 2) for r in range(4) for c in range(8) if not (y == 2 and c == 7)]
    df = spark.createDataFrame(cells, "yr int, px int, r int, c int, cls int")
    assert transitions.paired(df, 1, 2, F.col("cls")).count() == 28
    assert {r["c"] for r in transitions.paired(df, 1, 2, F.col("cls"), tile=4).collect()} == {0, 1, 2, 3}


def test_years_of_a_request():
    assert composite.year_range(2020, 2024, 2026) == list(range(2016, 2027))
    assert composite.year_range(2024, 2020, 2021, first=2018) == [2018, 2019, 2020, 2021]


def test_slope_is_by_year_also_where_one_is_missing(spark):
    """Stated departure: a system that counts positions would find 0.1 a step here."""
    rows = [(1, y, True, v, 0.0, 0.0) for y, v in ((2000, 0.0), (2001, 0.1), (2004, 0.4))]
    df = spark.createDataFrame(rows, "px int, yr int, valid boolean, ndvi double, ndbi double, ndwi double")
    assert composite.period_composites(df, [2000], [2004]).first()["ndvi_slope"] == pytest.approx(0.1)
    gap = spark.createDataFrame([(1, 2000, True, 0.0, 0.0, 0.0), (1, 2002, True, 0.1, 0.0, 0.0)], df.schema)
    assert composite.period_composites(gap, [2000], [2002]).first()["ndvi_slope"] == pytest.approx(0.05)


def test_terrain_tile(spark):
    made = {(r["r"], r["c"]): (r["terrain"], list(r["rgb"])) for r in raster.synthetic_terrain(spark, 0.01, 0.02, 2024, 20, 30).collect()}
    colours = ((100, [34, 139, 34]), (150, [128, 128, 128]), (180, [65, 105, 225]), (256, [139, 90, 43]))
    for (r, c), (v, rgb) in made.items():
        assert v == pytest.approx((r + c + 30 + 2024) % 255) and rgb == next(x for top, x in colours if v < top)
    assert len(made) == 600
