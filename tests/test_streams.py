"""Tile files as a stream: totals without the unreadable ones, which are listed, each once, over restarts too."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from landcube.sources import rasterfiles
from landcube.streaming import totals


def arriving(spark, folder):
    files = totals.arriving_files(spark, str(folder), "*.npy", 2)
    part = lambda k: F.split_part(F.element_at(F.split("path", "/"), -1), F.lit("_"), F.lit(k)).cast("long")
    return totals.tile_pairs(files.withColumns({"city": part(1), "tile": part(2)}))


def test_broken_files_are_set_aside_once(spark, tmp_path):
    folder, state, out = tmp_path / "in", str(tmp_path / "state"), str(tmp_path / "out")
    folder.mkdir()
    rng = np.random.default_rng(1)
    want = {}

    def put(city, tile, broken=None):
        x = rng.integers(0, 5, (2, 6, 5)).astype("u1")
        data = rasterfiles.npy_bytes(x)
        (folder / f"{city}_{tile}_x.npy").write_bytes({"cut": data[:100], "none": b"x", "bands": rasterfiles.npy_bytes(x[0])}.get(broken, data))
        if not broken:
            b, a = (v.astype(int) - 1 for v in x)
            ok = (b >= 0) & (a >= 0)
            own = want.setdefault(city, [0, 0, 0])
            own[0] += int(ok.sum())
            own[1] += 1
            own[2] += int((ok & (b == 2) & (a != 2)).sum())

    def check(bad):
        got = {r["city"]: [r["pixels_processed"], r["tiles_processed"], round(r["deforestation_hectares"] * 100)] for r in totals.city_totals(totals.latest_tiles(spark, out)).collect()}
        assert got == want
        assert sorted((r["city"], r["tile"]) for r in totals.bad_tiles(spark, out).collect()) == bad
        assert totals.bad_tiles(spark, out).where("error is null or path not like '%.npy'").count() == 0

    for city, tile, broken in ((1, 1, None), (1, 2, "cut"), (2, 1, None), (2, 2, "none"), (1, 3, None)):
        put(city, tile, broken)
    totals.stream_tiles(arriving(spark, folder), state, out)
    check([(1, 2), (2, 2)])
    put(3, 1)
    put(3, 2, "bands")
    totals.stream_tiles(arriving(spark, folder), state, out)  # goes on from its checkpoint
    check([(1, 2), (2, 2), (3, 2)])
    totals.stream_tiles(arriving(spark, folder), state, out)
    check([(1, 2), (2, 2), (3, 2)])


def test_a_tile_in_several_batches_counts_once(spark, tmp_path):
    folder, state, out = str(tmp_path / "in"), str(tmp_path / "state"), str(tmp_path / "out")
    for k in range(4):
        rows = [(1, 7, 10 * k + i, 2, 1) for i in range(10)] + [(1, 8, k, None, 1)]
        spark.createDataFrame(rows, totals.SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    totals.stream_tiles(spark.readStream.schema(totals.SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder), state, out)
    [r] = totals.city_totals(totals.latest_tiles(spark, out)).collect()
    assert (r["pixels_processed"], r["tiles_processed"], r["deforestation_hectares"]) == (40, 1, 0.4)


def test_small_tile_files_share_a_batch(spark):
    """A grid of nine small tiles is one batch: the number of batches doesn't follow the number of tiles at once."""
    from pathlib import Path

    from landcube.plans.queries import _tile_stream

    out = Path(_tile_stream(spark, "/root/testdata/sf0.01").removeprefix("file:"))
    assert len(list((out / "tiles").glob("batch=*"))) == 1
    assert totals.latest_tiles(spark, str(out)).count() + totals.bad_tiles(spark, str(out)).count() == 9
