"""Raster and result files as tables: tiles, listings, yearly stores, synthetic scenes and JSON results."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from io import BytesIO

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landcube.functions.indices import dequantize, is_clear
from landcube.operators import store
from landcube.sources import rastersource


#: Endings that a band's file can have, in the order in which they are tried (fixed values).
BAND_ENDINGS = (".jp2", ".tif", ".tiff", ".JP2", ".TIF")


def band_file(spark: SparkSession, folder: str, band: str) -> str:
    """The path of a band's file, by the first ending that there is; FileNotFoundError without any."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"{band}.*").load(folder).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    rank = F.array_position(F.array(*[F.lit(band + e) for e in BAND_ENDINGS]), name)
    found = files.where(rank > 0).orderBy(rank).first()  # at most one file for each ending
    if found is None:
        raise FileNotFoundError(f"Band {band} not found in {folder}")
    return found["path"]


def band_cells(spark: SparkSession, folder: str, band: str) -> DataFrame:
    """Cells (path, name, band, r, c, value) of a band's file, read by its rows; FileNotFoundError without any."""
    return rastersource.cells(spark, band_file(spark, folder, band)).where("band = 0")


def band_ground(spark: SparkSession, folder: str, band: str) -> DataFrame:
    """The band's form and its place on the ground, as its file states them."""
    return rastersource.info(spark, band_file(spark, folder, band), unreadable="fail")


def year_scene(spark: SparkSession, path: str) -> DataFrame:
    """r, c, ndvi, ndbi, ndwi and valid from an image of four 8-bit channels, PNG or TIFF; the fourth is the scene class."""
    four = rastersource.cells(spark, path, wide="4")
    u8 = {"ndvi_u8": F.col("b0"), "ndbi_u8": F.col("b1"), "ndwi_u8": F.col("b2"), "scl": F.col("b3").cast("int")}
    return decoded(four.withColumns(u8)).select("r", "c", "ndvi", "ndbi", "ndwi", "valid")


def rgb_images(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, name, r, c, red, green and blue of images; of grey ones all three are the grey, a fourth channel is left out."""
    three = rastersource.cells(spark, path, pattern, wide="3")
    grey = F.col("b2").isNull()
    return three.select("path", "name", "r", "c", F.col("b0").cast("int").alias("red"), *[F.when(grey, F.col("b0")).otherwise(F.col(b)).cast("int").alias(n) for b, n in (("b1", "green"), ("b2", "blue"))])


def listing(spark: SparkSession, folder: str, pattern: str, contains: str | None = None) -> DataFrame:
    """path, name, mb, tile_row and tile_col (from ``_row_col`` in the name) of the files that match, and whose name
    contains a text (a date, say)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    place = [F.try_to_number(F.nullif(F.regexp_extract(name, r"_(\d+)_(\d+)(?:_mask)?\.", i), F.lit("")), F.lit("999999")).cast("int") for i in (1, 2)]
    files = files if contains is None else files.where(F.contains(name, F.lit(contains)))
    return files.select("path", name.alias("name"), (F.col("length") / 1e6).alias("mb"), place[0].alias("tile_row"), place[1].alias("tile_col"))


def npy_cells(spark: SparkSession, folder: str, pattern: str = "*.npy") -> DataFrame:
    """path, band, r, c, value of every cell of .npy arrays of two or three dimensions; a file that is none gives no rows."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    x = np.load(BytesIO(content), allow_pickle=False)
                except ValueError:
                    continue
                x = x[None] if x.ndim == 2 else x
                for k in range(len(x)):
                    r, c = np.indices(x[k].shape)
                    values = pa.array(x[k].ravel().astype(np.float64))
                    yield pa.RecordBatch.from_arrays([pa.array([path] * x[k].size), pa.array(np.full(x[k].size, k, np.int32)), pa.array(r.ravel().astype(np.int32)), pa.array(c.ravel().astype(np.int32)), values], names=["path", "band", "r", "c", "value"])

    return files.mapInArrow(run, "path string, band int, r int, c int, value double")


def decoded_files(spark: SparkSession, folder: str, pattern: str, decode: Callable[[str, bytes], pd.DataFrame | None], schema: str) -> DataFrame:
    """Rows that ``decode(path, content)`` makes of each file: the place for GeoTIFF, JPEG 2000 or PNG decoders.

    A file for which it returns nothing, or raises a ValueError, gives no rows.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    made = decode(path, bytes(content))
                except ValueError:
                    continue
                if made is not None:
                    yield made

    return files.mapInPandas(run, schema)


def decoded(encoded: DataFrame) -> DataFrame:
    """Indices and validity from three 8-bit channels and the scene class."""
    return encoded.select("*", *[dequantize(F.col(f"{x}_u8")).alias(x) for x in ("ndvi", "ndbi", "ndwi")], is_clear(F.col("scl")).alias("valid"))


#: What a year's scene is stored under: area, grid size and year.
YEAR_KEY = ["aoi_id", "size", "year"]
#: Scenes with more cloud than this are not used for a year (fixed value).
CLOUDIEST = 95.0


def write_years(cube: DataFrame, path: str) -> None:
    """Store a cube by area, size and year; only what is written is replaced."""
    cube.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*YEAR_KEY).parquet(path)


def read_years(spark: SparkSession, path: str, aoi: str, size: int, years: list[int]) -> DataFrame:
    """Only the partitions asked for are read."""
    return spark.read.parquet(path).where((F.col("aoi_id") == aoi) & (F.col("size") == size) & F.col("year").isin(*years))


def missing_years(requested: DataFrame, stored: DataFrame) -> DataFrame:
    """Requested (aoi_id, size, year) that the store doesn't have."""
    return requested.join(stored.select(*YEAR_KEY).distinct(), YEAR_KEY, "left_anti")


def year_sources(products: DataFrame) -> DataFrame:
    """The scene that stands for each (aoi, yr): the one with the least cloud, none above ``CLOUDIEST``."""
    return store.best_product(products, ["aoi", "yr"], CLOUDIEST)


def write_tiles(cells: DataFrame, path: str) -> None:
    """Store cells by scene and place: a folder and a file for each row of tiles, in the file's order of tile_col.

    So there are as many files as rows of tiles, whatever the number of tasks and tiles; a tile is found by its row's folder
    and the file's statistics of tile_col.
    """
    placed = cells.repartition("scene", "tile_row").sortWithinPartitions("scene", "tile_row", "tile_col")
    placed.write.mode("overwrite").partitionBy("scene", "tile_row").parquet(path)


def tile_index(cells: DataFrame) -> DataFrame:
    """One row per tile: its place and shape."""
    return cells.groupBy("scene", "tile_row", "tile_col").agg((F.max("r") - F.min("r") + 1).alias("rows"), (F.max("c") - F.min("c") + 1).alias("columns"))


def json_results(spark: SparkSession, *paths: str, schema: str, lines: bool = False) -> DataFrame:
    """The first of the paths that can be read; none gives an empty table. ``lines``: an object in each line, as the sink writes."""
    for path in paths:
        try:
            return spark.read.schema(schema).option("multiLine", str(not lines).lower()).json(path)
        except AnalysisException:
            continue
    return spark.createDataFrame([], schema)


def composite(bands: dict[str, DataFrame], keys: tuple[str, ...] = ("r", "c")) -> DataFrame:
    """One column per band, by name; a missing band doesn't move the others."""
    named = [b.select(*keys, F.col("value").alias(n)) for n, b in bands.items()]
    return reduce(lambda a, b: a.join(b, list(keys), "full"), named)


def synthetic_year(spark: SparkSession, year: int, size: int, first: int = 2016) -> DataFrame:
    """A wavy scene that drifts by year; noise and invalid pixels come from a hash, so partitioning doesn't show."""
    px = spark.range(size * size).select((F.col("id") / size).cast("int").alias("r"), (F.col("id") % size).cast("int").alias("c"))
    drift = 0.02 * (year - first)
    wave = F.sin(F.col("r") / 20.0) * F.cos(F.col("c") / 25.0)

    def noise(k: int):
        return F.pmod(F.xxhash64("r", "c", F.lit(year), F.lit(k)), F.lit(2001)) / 1000.0 - 1

    return px.select(
        F.lit(year).alias("year"), "r", "c", (0.45 + 0.25 * wave - drift + 0.03 * noise(1)).alias("ndvi"), (-0.05 + 0.2 * wave + drift + 0.03 * noise(2)).alias("ndbi"),
        (0.1 - 0.15 * wave + 0.02 * noise(3)).alias("ndwi"), (F.pmod(F.xxhash64("r", "c", F.lit(year), F.lit(4)), F.lit(100)) >= 5).alias("valid"),
    )


def synthetic_terrain(spark: SparkSession, west: float, south: float, year: int, height: int, width: int) -> DataFrame:
    """A tile of four terrains by position; without noise."""
    px = spark.range(height * width).select((F.col("id") / width).cast("int").alias("r"), (F.col("id") % width).cast("int").alias("c"))
    v = F.pmod(F.col("r") + F.col("c") + F.lit((west + south) * 1000 + year), F.lit(255.0))
    # The terrains' colours.
    colours = [(100, (34, 139, 34)), (150, (128, 128, 128)), (180, (65, 105, 225)), (256, (139, 90, 43))]
    out = F.lit(None).cast("array<int>")
    for top, rgb in reversed(colours):
        out = F.when(v < top, F.array(*[F.lit(x) for x in rgb])).otherwise(out)
    return px.withColumns({"terrain": v, "rgb": out})
