from __future__ import annotations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from landcube.functions import geo
from landcube.functions import indices as ix
from landcube.operators import change, components, composite, morphology, store, tiles, transitions
from landcube.sources import raster

CUBE = "yr int, px long, ndvi double, ndbi double, ndwi double, valid boolean"


def only(frame):
    return frame.collect()[0]


def cube(spark, rows):
    return spark.createDataFrame([(y, p, a, b, 0.0, v) for y, p, a, b, v in rows], CUBE)


def mask(spark, cells):
    return spark.createDataFrame([(int(r), int(c)) for r, c in cells], "r long, c long")


def cells_of(frame):
    return {(r["r"], r["c"]) for r in frame.collect()}


def test_period_fallbacks():
    assert composite.select_periods([2018, 2019, 2020, 2021], 2019, 2020) == ([2018, 2019], [2020, 2021])
    assert composite.select_periods([2016, 2017], 2010, 2020)[0] == [2016, 2017]
    assert composite.select_periods([2016, 2017], 2018, 2030)[1] == [2017]
    assert composite.year_range(2020, 2024, 2026) == list(range(2016, 2027))


def test_all_years_invalid(spark):
    r = only(change.trends(composite.period_composites(cube(spark, [(2000, 1, 0.5, 0.1, False), (2001, 1, 0.6, 0.2, False)]), [2000], [2001])))
    assert (r["ndvi_before"], r["ndvi_after"], r["valid_before"], r["ndvi_slope"], r["trend"]) == (0.0, 0.0, False, 0.0, 0)


def test_even_median_and_one_year_slope(spark):
    r = only(composite.period_composites(cube(spark, [(2000, 1, 0.2, 0.0, True), (2001, 1, 0.4, 0.0, True)]), [2000, 2001], [2001]))
    assert r["ndvi_before"] == pytest.approx(0.3)
    assert only(composite.period_composites(cube(spark, [(2000, 1, 0.2, 0.0, True)]), [2000], [2000]))["ndvi_slope"] == 0.0


def test_both_trends_count(spark):
    r = only(change.trends(composite.period_composites(cube(spark, [(2000 + i, 1, 0.5 - 0.1 * i, 0.1 * i, True) for i in range(4)]), [2000], [2003])))
    assert (r["falling"], r["rising"], r["trend"]) == (True, True, 2)


def test_strict_thresholds(spark):
    one = spark.range(1)
    p = ix.tier_one(F.lit(0.70), F.lit(0.0), F.lit(0.2), F.lit(0.0), F.lit(0.1))
    q = ix.tier_two(F.lit(0.55), F.lit(0.0), F.lit(0.2), F.lit(0.0), F.lit(-0.2), F.lit(0.2))
    nd = ix.normalized_difference(F.lit(0.001), F.lit(0.0))
    assert tuple(only(one.select(p, q, nd))) == (False, False, 0.0)


@pytest.mark.parametrize(("std", "label"), [(45.0, "Good"), (20.0, "Acceptable"), (1.0, "Poor")])
def test_quality(spark, std, label):
    assert only(spark.range(1).select(ix.quality_label(F.lit(std))))[0] == label


def test_class_maps(spark):
    r = only(spark.range(1).select(transitions.batch_class(F.lit(4)), transitions.batch_class(F.lit(6)), transitions.stream_class(F.lit(17)), transitions.stream_class(F.lit(99))))
    assert tuple(r) == (2, 5, 5, 0)


def test_vegetation_to_urban_counts_twice(spark):
    pairs = spark.createDataFrame([(1, 2, 1)], "px long, cls_before int, cls_after int")
    assert {r["change_type"] for r in transitions.transition_pixels(pairs).collect()} == {"deforestation", "construction"}


def test_transition_join_is_an_equality_join(spark):
    pairs = spark.createDataFrame([(1, 2, 1)], "px long, cls_before int, cls_after int")
    plan = transitions.transition_pixels(pairs)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan


def test_morphology_against_numpy(spark):
    rng = np.random.default_rng(5)
    image = rng.random((9, 7)) < 0.3
    padded = np.pad(image, 1)
    wide = np.any([padded[i : i + 9, j : j + 7] for i in range(3) for j in range(3)], axis=0)
    ring = np.pad(wide, 1, constant_values=True)
    closed = np.all([ring[i : i + 9, j : j + 7] for i in range(3) for j in range(3)], axis=0)
    m = mask(spark, np.argwhere(image))
    assert cells_of(morphology.dilate(m, 7, 63, 3)) == {tuple(map(int, x)) for x in np.argwhere(wide)}
    once = morphology.close(m, 7, 63, 3)
    assert cells_of(once) == {tuple(map(int, x)) for x in np.argwhere(closed)}
    assert cells_of(morphology.close(once, 7, 63, 3)) == cells_of(once)


def test_blur_against_numpy(spark):
    rng = np.random.default_rng(6)
    image = (rng.random((6, 8)) < 0.4).astype(float)
    big = np.pad(image, 2, mode="reflect")
    kernel = np.outer([1, 4, 6, 4, 1], [1, 4, 6, 4, 1]) / 256
    want = np.array([[(big[r : r + 5, c : c + 5] * kernel).sum() for c in range(8)] for r in range(6)])
    got = np.zeros((6, 8))
    for x in morphology.blur(mask(spark, np.argwhere(image)), 6, 8).collect():
        got[x["r"], x["c"]] = x["v"]
    assert np.allclose(got, want)


def flood(cells):
    left, out = set(cells), {}
    while left:
        start = min(left)
        group, stack = set(), [start]
        left.discard(start)
        while stack:
            r, c = stack.pop()
            group.add((r, c))
            for n in [(r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                if n in left:
                    left.discard(n)
                    stack.append(n)
        out |= dict.fromkeys(group, min(r * 12 + c for r, c in group))
    return out


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.tuples(st.integers(0, 11), st.integers(0, 11)), min_size=1, max_size=70))
def test_regions_across_tiles(spark, cells):
    got = {(r["r"], r["c"]): r["region"] for r in components.regions(mask(spark, cells), 12, tile=4).collect()}
    assert got == flood(cells)


def test_region_size_is_strict(spark):
    labelled = components.regions(mask(spark, [(0, c) for c in range(5)] + [(5, c) for c in range(6)]), 12)
    assert {r for r, _ in cells_of(components.large_regions(labelled, 5))} == {5}


def test_holes(spark):
    ring = [(r, c) for r in range(1, 4) for c in range(1, 4) if (r, c) != (2, 2)]
    assert cells_of(components.fill_holes(mask(spark, ring), 6, 6)) == set(ring) | {(2, 2)}


def test_tiles(spark):
    cells = spark.createDataFrame([(r, c, 1.0) for r in range(10) for c in range(7)], "r long, c long, v double")
    assert tiles.assign_tiles(cells, 8, 10, 7).count() == 0
    assert tiles.assign_tiles(cells, 4, 10, 7, overlap=2).groupBy("tile_row", "tile_col").count().where("count = 16").count() == 4 * 2
    doubled = tiles.bilinear_double(cells, "v", 10, 7)
    assert doubled.count() == 280 and only(doubled.agg(F.max("v"), F.min("v")))[0] == pytest.approx(1.0)


def test_boxes(spark):
    box = [F.lit(float(x)) for x in (10, 20, 11, 21)]
    r = only(spark.range(1).select(geo.is_box(*box), geo.is_box(box[2], *box[1:]), geo.is_box(F.lit(None).cast("double"), *box[1:]), geo.position_overlap_percent(F.lit(0), F.lit(0), F.lit(0), F.lit(256), 512)))
    assert tuple(r) == (True, False, False, 50.0)


def test_best_product_without_cloud(spark):
    rows = [(1, "a", None, 5), (2, "a", 99.0, 1), (3, "a", 99.0, 4)]
    assert only(store.best_product(spark.createDataFrame(rows, "id int, aoi string, cloud double, start int"), ["aoi"]))["id"] == 3


def test_files(spark, tmp_path):
    np.save(tmp_path / "before_1_2_mask.npy", np.arange(6).reshape(2, 3))
    (tmp_path / "before_9_9_mask.npy").write_bytes(b"no array")
    got = raster.npy_cells(spark, str(tmp_path), "before_*.npy")
    assert got.count() == 6 and only(got.agg(F.sum("value")))[0] == 15
    assert {(r["tile_row"], r["tile_col"]) for r in raster.listing(spark, str(tmp_path), "*.npy").collect()} == {(1, 2), (9, 9)}


def test_year_store(spark, tmp_path):
    path = str(tmp_path / "years")
    scene = raster.synthetic_year(spark, 2018, 8).withColumns({"aoi_id": F.lit("a"), "size": F.lit(8)})
    raster.write_years(scene, path)
    raster.write_years(raster.synthetic_year(spark, 2019, 8).withColumns({"aoi_id": F.lit("a"), "size": F.lit(8)}), path)
    raster.write_years(raster.synthetic_year(spark, 2018, 16).withColumns({"aoi_id": F.lit("a"), "size": F.lit(16)}), path)
    found = raster.read_years(spark, path, "a", 8, [2018])
    assert found.count() == 64 and "PartitionFilters: [isnotnull(aoi_id" in found._jdf.queryExecution().executedPlan().toString()
    asked = spark.createDataFrame([("a", 8, 2018), ("a", 8, 2020), ("a", 16, 2019)], "aoi_id string, size int, year int")
    assert sorted(r["year"] for r in raster.missing_years(asked, spark.read.parquet(path)).collect()) == [2019, 2020]


def test_results_fall_back(spark, tmp_path):
    assert raster.json_results(spark, str(tmp_path / "new.json"), str(tmp_path / "old.json"), schema="change_type string").count() == 0


def test_synthetic_scene_is_deterministic(spark):
    a, b = raster.synthetic_year(spark, 2020, 16), raster.synthetic_year(spark, 2020, 16).repartition(3)
    assert a.exceptAll(b).count() == 0


def test_decoder_plug_in(spark, tmp_path):
    import pandas as pd

    (tmp_path / "a.raw").write_bytes(b"\1\2")
    (tmp_path / "b.raw").write_bytes(b"")
    frame = raster.decoded_files(spark, str(tmp_path), "*.raw", lambda path, content: pd.DataFrame({"dn": list(content)}) if content else None, "dn int")
    assert sorted(r["dn"] for r in frame.collect()) == [1, 2]


def test_probability_plug_in(spark):
    from landcube.operators.model import with_probability

    frame = spark.createDataFrame([(1, None), (2, 3.0)], "px int, m double")
    assert [r["model_prob"] for r in with_probability(frame, F.col("m")).orderBy("px").collect()] == [0.5, 1.0]


def test_band_files(spark, tmp_path):
    for name in ("B04.tiff", "B04.JP2", "B03.TIF", "B03.jp2.aux", "B02.xml"):
        (tmp_path / name).write_bytes(b"x")
    assert raster.band_file(spark, str(tmp_path), "B04").endswith("/B04.tiff") and raster.band_file(spark, str(tmp_path), "B03").endswith("/B03.TIF")
    with pytest.raises(FileNotFoundError):
        raster.band_file(spark, str(tmp_path), "B02")
    assert [r["name"] for r in raster.listing(spark, str(tmp_path), "*", contains="B02").collect()] == ["B02.xml"]


def test_smoothing_against_numpy(spark):
    rng = np.random.default_rng(8)
    image = rng.random((14, 13)) < 0.25
    around = lambda x, k, edge: np.lib.stride_tricks.sliding_window_view(np.pad(x, k, constant_values=edge), (2 * k + 1, 2 * k + 1))
    closed = around(around(image, 2, False).any(axis=(2, 3)), 2, True).all(axis=(2, 3)).astype(float)
    kernel = np.outer([1, 4, 6, 4, 1], [1, 4, 6, 4, 1]) / 256
    soft = np.einsum("rcij,ij->rc", np.lib.stride_tricks.sliding_window_view(np.pad(closed, 2, mode="reflect"), (5, 5)), kernel) > 0.4
    assert cells_of(morphology.smooth(mask(spark, np.argwhere(image)), 13, 14 * 13)) == {tuple(map(int, x)) for x in np.argwhere(soft)}


def test_small_regions_are_no_construction(spark):
    spots = [(r, c) for r in range(2, 6) for c in range(2, 6)] + [(r, c) for r in range(2, 14) for c in range(20, 30)]
    rows = [(r * 40 + c, 3 if (r, c) in spots else 0) for r in range(20) for c in range(40)]
    made = change.smoothed(spark.createDataFrame(rows, "px long, class int"), 40, 800, above=50, tile=16)
    found = {(r["px"] // 40, r["px"] % 40) for r in made.where("class = 3").collect()}
    assert made.count() == 800 and found and all(c >= 18 for _, c in found) and {(r, c) for r in range(3, 13) for c in range(21, 29)} <= found


def test_unlike_shapes_are_not_compared(spark):
    cells = [(y, 0, t, r, c) for y in (1, 2) for t in (0, 1) for r in range(3) for c in range(4 - (t == 1 and y == 2))]
    frame = spark.createDataFrame(cells, "yr int, tile_row int, tile_col int, r int, c int")
    assert [tuple(r) for r in transitions.comparable_tiles(frame, 1, 2).collect()] == [(0, 0, 3, 4)]


def test_sinks(spark, tmp_path):
    from landcube.sources import sinks

    cells = spark.createDataFrame([("s", 0, 1, r, c, "x" if r else "y") for r in range(2) for c in range(3)], "scene string, tile_row int, tile_col int, r int, c int, change_type string")
    raster.write_tiles(cells, str(tmp_path / "tiles"))
    assert tuple(only(raster.tile_index(spark.read.parquet(str(tmp_path / "tiles"))).select("tile_row", "tile_col", "rows", "columns"))) == (0, 1, 2, 3)
    sinks.write_masks(cells, str(tmp_path / "masks"))
    assert spark.read.parquet(str(tmp_path / "masks")).where("change_type = 'x'").count() == 3
    sinks.write_json(cells, str(tmp_path / "json"))
    assert raster.json_results(spark, str(tmp_path / "none"), str(tmp_path / "json"), schema="r int, c int", lines=True).count() == 6
    rows = sinks.history_rows(cells.limit(1), F.lit("u"), F.lit("2024-01-01"), "r", "c")
    for _ in range(2):
        sinks.append(rows, str(tmp_path / "history"))
    assert [r["result_json"] for r in spark.read.parquet(str(tmp_path / "history")).collect()] == [only(rows)["result_json"]] * 2
    now = F.lit("2024-01-10").cast("timestamp_ntz")
    cache = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-09")], "id int, created string").withColumn("created", F.col("created").cast("timestamp_ntz"))
    sinks.replace_live(cache, now, 3, str(tmp_path / "live"))
    assert [r["id"] for r in spark.read.parquet(str(tmp_path / "live")).collect()] == [2]


def test_tiles_are_a_file_a_row_of_tiles(spark, tmp_path):
    """However many tasks hold cells of a tile, and however many tiles a row has."""
    from landcube.sources import raster

    n = F.col("id")
    cells = spark.range(0, 3200, 1, 8).select((n % 2).alias("scene"), (n % 4).cast("int").alias("tile_row"), (n % 10).cast("int").alias("tile_col"), (n % 7).alias("r"), (n % 5).alias("c"))
    raster.write_tiles(cells, str(tmp_path / "tiles"))
    files = list((tmp_path / "tiles").rglob("*.parquet"))
    assert len(files) == len({f.parent for f in files}) == 4  # each scene has two of the rows here
    back = spark.read.parquet(str(tmp_path / "tiles")).select(*cells.columns)
    assert back.exceptAll(cells.select(F.col("scene").cast("int"), "tile_row", "tile_col", "r", "c")).count() == 0 and back.count() == 3200


def test_mosaic_and_bands(spark):
    cells = spark.createDataFrame([(1, 2, 3, 4)], "tile_row int, tile_col int, r int, c int")
    assert tuple(only(tiles.mosaic(cells, 10, 20).select("mosaic_r", "mosaic_c"))) == (13, 44)
    a, b = (spark.createDataFrame(x, "r int, c int, value double") for x in ([(0, 0, 1.0)], [(0, 0, 2.0), (0, 1, 3.0)]))
    assert {tuple(r) for r in raster.composite({"x": a, "y": b}).collect()} == {(0, 0, 1.0, 2.0), (0, 1, None, 3.0)}
