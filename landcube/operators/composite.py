"""Temporal medians: filling, period composites and the choice of periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHANNELS = ("ndvi", "ndbi", "ndwi")


def select_periods(years: list[int], before: int, after: int, most: int = 2) -> tuple[list[int], list[int]]:
    """The years nearest to two dates: at most ``most`` up to ``before`` and from ``after`` on.

    Where a side has none, years between the two dates serve, and then the first or the last year.
    """
    years = sorted(set(years))
    old = [y for y in years if y <= before] or [y for y in years if before <= y < after][:most]
    new = [y for y in years if y >= after][:most] or [y for y in years if before < y <= after]
    return (old[-most:] or years[:1]), (new[-most:] or years[-1:])


def year_range(before: int, after: int, now: int, first: int = 2016) -> list[int]:
    """From four years before the earlier date, not before ``first``, to two after the later, not after ``now``."""
    return list(range(max(first, min(before, after) - 4), min(now, max(before, after) + 2) + 1))


def period_years(years: DataFrame, before: int, after: int, most: int = 2) -> DataFrame:
    """side, yr: :func:`select_periods` over the years (yr) there are: a row for each year of the data, however large it is."""
    ordered = F.array_sort(F.collect_set("yr"))
    own = years.agg(ordered.alias("y"))
    old, new = F.filter("y", lambda y: y <= before), F.filter("y", lambda y: y >= after)
    between = F.filter("y", lambda y: (y >= before) & (y < after)), F.filter("y", lambda y: (y > before) & (y <= after))
    old = F.when(F.size(old) > 0, F.slice(F.reverse(old), 1, most)).when(F.size(between[0]) > 0, F.slice(between[0], 1, most)).otherwise(F.slice("y", 1, 1))
    new = F.when(F.size(new) > 0, F.slice(new, 1, most)).when(F.size(between[1]) > 0, F.slice(F.reverse(between[1]), 1, most)).otherwise(F.slice(F.reverse("y"), 1, 1))
    sides = [own.select(F.lit(side).alias("side"), F.explode(ys).alias("yr")) for side, ys in (("before", old), ("after", new))]
    return sides[0].union(sides[1])


def median_fill(cube: DataFrame) -> DataFrame:
    """Invalid values take the pixel's median over valid years; a pixel without any keeps NULL."""
    px = Window.partitionBy("px")
    fills = {f"{x}_filled": F.when(F.col("valid"), F.col(x)).otherwise(F.median(F.when(F.col("valid"), F.col(x))).over(px)) for x in CHANNELS}
    return cube.withColumns(fills)


def period_composites(cube: DataFrame, before: list[int], after: list[int]) -> DataFrame:
    """One row per pixel: medians of both periods (else of all years, else 0), whether a period has a valid year, slopes, and
    the first and last filled values, all from one grouping, so from one shuffle.
    """
    aggregates = []
    for side, years in (("before", before), ("after", after)):
        inside = F.col("valid") & F.col("yr").isin(*years)
        for x in CHANNELS:
            own, ever = F.median(F.when(inside, F.col(x))), F.median(F.when(F.col("valid"), F.col(x)))
            aggregates.append(F.coalesce(own, ever, F.lit(0.0)).alias(f"{x}_{side}"))
        aggregates.append(F.coalesce(F.bool_or(inside), F.lit(False)).alias(f"valid_{side}"))
    return cube.groupBy("px").agg(*aggregates, *slopes(), *ends())


def ends() -> list:
    """First and last values of each channel by year; an invalid one is the pixel's median over valid years, else 0."""
    made = []
    for n, by in (("first", F.min_by), ("last", F.max_by)):
        at = by(F.struct("valid", *CHANNELS), "yr")
        for x in CHANNELS:
            filled = F.when(at["valid"], at[x]).otherwise(F.median(F.when(F.col("valid"), F.col(x))))
            made.append(F.coalesce(filled, F.lit(0.0)).alias(f"{x}_{n}"))
    return made


def slopes() -> list:
    """Least-squares slope of ndvi and ndbi over the valid years; 0 with fewer than two."""
    made = []
    for x in ("ndvi", "ndbi"):
        n = F.count(F.when(F.col("valid"), F.col(x)))
        slope = F.regr_slope(F.when(F.col("valid"), F.col(x)), F.when(F.col("valid"), F.col("yr").cast("double")))
        made.append(F.when(n >= 2, slope).otherwise(0.0).alias(f"{x}_slope"))
    return made


# what a slope over years needs, as sums: so years can be added one by one
_SUMS = ("n", "t", "tt", "ndvi", "tndvi", "ndbi", "tndbi")
#: Years count from here in the sums, which keeps them small.
YEAR_ZERO = 2000


def year_sums(cube: DataFrame) -> DataFrame:
    """px and the sums over its valid years that slopes are made of; a pixel without any has zeros."""
    t, ok = (F.col("yr") - YEAR_ZERO).cast("double"), F.col("valid")
    terms = {"n": F.lit(1.0), "t": t, "tt": t * t, "ndvi": F.col("ndvi"), "tndvi": t * F.col("ndvi"), "ndbi": F.col("ndbi"), "tndbi": t * F.col("ndbi")}
    return cube.groupBy("px").agg(*[F.sum(F.when(ok, v).otherwise(0.0)).alias(f"s_{k}") for k, v in terms.items()])


def write_state(sums: DataFrame, path: str, upto: int) -> None:
    """Store the sums up to a year under that year; what was stored for it before is replaced, others stay."""
    sums.withColumn("upto", F.lit(upto)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("upto").parquet(path)


def read_state(spark: SparkSession, path: str, upto: int) -> DataFrame:
    return spark.read.parquet(path).where(F.col("upto") == upto).drop("upto")


def add_year(spark: SparkSession, path: str, cube_of_year: DataFrame, before: int, year: int) -> None:
    """The state up to ``year`` from that up to ``before`` and one year's cube: older years are not read again.

    Adding a year a second time replaces what the first time wrote.
    """
    both = read_state(spark, path, before).unionByName(year_sums(cube_of_year))
    write_state(both.groupBy("px").agg(*[F.sum(f"s_{k}").alias(f"s_{k}") for k in _SUMS]), path, year)


def state_slopes(state: DataFrame) -> DataFrame:
    """px, ndvi_slope and ndbi_slope: the least-squares slopes by year; 0 with fewer than two valid years."""
    c = F.col
    below = c("s_n") * c("s_tt") - c("s_t") * c("s_t")
    made = [F.when((c("s_n") >= 2) & (below > 0), (c("s_n") * c(f"s_t{x}") - c("s_t") * c(f"s_{x}")) / below).otherwise(0.0).alias(f"{x}_slope") for x in ("ndvi", "ndbi")]
    return state.select("px", *made)
