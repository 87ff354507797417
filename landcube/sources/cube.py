"""The pixel cube: one row per year and pixel, keyed by grid position, derived from ``lineitem``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landcube.functions.indices import is_clear, normalized_difference


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid_width(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """(columns, pixels) of the grid: the smallest square that holds all parts, its last row maybe partial."""
    n = table(spark, sf_dir, "part").agg(F.max("p_partkey")).first()[0]
    n = -1 if n is None else n
    width = 1
    while width * width < n + 1:
        width += 1
    return width, n + 1


def years(spark: SparkSession, sf_dir: str, only: list[int] | None = None) -> DataFrame:
    """yr: the years there are, or those of ``only`` that there are."""
    return _of_years(table(spark, sf_dir, "lineitem"), only).select(F.year("l_shipdate").alias("yr")).distinct()


def _of_years(source: DataFrame, only: list[int] | None) -> DataFrame:
    """Rows of some years. They are also a range of dates, which the scan can skip row groups by."""
    if not only:
        return source
    day = F.col("l_shipdate")
    return source.where((day >= F.lit(f"{min(only)}-01-01").cast("timestamp_ntz")) & (day < F.lit(f"{max(only) + 1}-01-01").cast("timestamp_ntz")) & F.year(day).isin(*only))


def of_year(cube: DataFrame, year: int) -> DataFrame:
    return cube.where(F.col("yr") == year)


def _units(name: str, scale: int = 1) -> Column:
    return F.floor(F.col(name) * scale + 0.5).cast("long")


def pixel_cube(spark: SparkSession, sf_dir: str, only: list[int] | None = None) -> DataFrame:
    """yr, px, r, c, n, nir, red, green, swir, valid, ade, cls. Whole numbers are summed and divided once.

    Of the years in ``only``, or all.
    """
    width, _ = grid_width(spark, sf_dir)
    source = _of_years(table(spark, sf_dir, "lineitem"), only)
    rows = source.select(F.year("l_shipdate").alias("yr"), F.col("l_partkey").alias("px"), "l_quantity", "l_extendedprice", "l_tax", "l_discount", "l_linenumber", "l_suppkey")
    sums = rows.groupBy("yr", "px").agg(
        F.count("*").alias("n"), F.sum(_units("l_quantity")).alias("q"), F.sum(_units("l_extendedprice", 100)).alias("e"), F.sum(_units("l_tax", 100)).alias("t"),
        F.sum(_units("l_discount", 100)).alias("d"), F.bool_or(is_clear(F.col("l_linenumber"))).alias("valid"), F.sum("l_suppkey").alias("s"),
    )
    n = F.col("n")
    return sums.select(
        "yr", "px", F.floor(F.col("px") / width).alias("r"), (F.col("px") % width).alias("c"), "n", (F.col("q") / n).alias("nir"), (F.col("e") / (200000 * n)).alias("red"),
        (6 * F.col("t") / n).alias("green"), (5 * F.col("d") / n).alias("swir"), "valid", (F.col("s") % 60).cast("int").alias("ade"), (F.col("s") % 6).cast("int").alias("cls"),
    )


def index_cube(spark: SparkSession, sf_dir: str, only: list[int] | None = None) -> DataFrame:
    """The cube with ndvi, ndbi and ndwi."""
    c = pixel_cube(spark, sf_dir, only)
    nd = normalized_difference
    return c.withColumns({"ndvi": nd(c["nir"], c["red"]), "ndbi": nd(c["swir"], c["nir"]), "ndwi": nd(c["green"], c["nir"])})
