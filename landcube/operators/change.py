"""Change scores, construction tiers, trends and their summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landcube.functions import geo
from landcube.functions import indices as ix
from landcube.operators import components, halo
from landcube.operators.composite import CHANNELS


def temporal_score() -> Column:
    """From first and last filled values of composites; a pixel without valid years counts as unchanged."""
    return ix.temporal_prior(*[(F.col(f"{x}_first"), F.col(f"{x}_last")) for x in CHANNELS])


def with_prior(composites: DataFrame) -> DataFrame:
    """Differences of the periods and the period prior."""
    d = {f"d_{x}": F.col(f"{x}_after") - F.col(f"{x}_before") for x in CHANNELS}
    return composites.withColumns(d).withColumn("period_prior", ix.period_prior(*[F.col(f"d_{x}") for x in CHANNELS]))


def fused(composites: DataFrame, model: Column | None = None) -> DataFrame:
    """``prob`` from the model's probability (a column of ``composites``; 0.5 without a model) and both priors."""
    scored = with_prior(composites).withColumn("prior", temporal_score())
    return scored.withColumn("prob", ix.fuse(F.lit(0.5) if model is None else model, F.col("prior"), F.col("period_prior")))


def construction(scored: DataFrame, prob: str = "prob") -> DataFrame:
    """``tier``: 1 or 2 where a pixel looks newly built, else 0; ``class``: 3 for those, else 0."""
    c, both = F.col, F.col("valid_before") & F.col("valid_after")
    one = both & ix.tier_one(c(prob), c("ndvi_after"), c("ndbi_after"), c("ndwi_after"), c("d_ndbi"))
    two = both & ix.tier_two(c(prob), c("ndvi_after"), c("ndbi_after"), c("ndwi_after"), c("d_ndvi"), c("d_ndbi"))
    return scored.withColumn("tier", F.when(one, 1).when(two, 2).otherwise(0)).withColumn("class", F.when(c("tier") > 0, 3).otherwise(0))


def smoothed(classified: DataFrame, columns: int, pixels: int, above: int = 50, tile: int = components.TILE) -> DataFrame:
    """``class`` anew: regions of class 3, closed 5 x 5, blurred, cut at 0.4, of more than ``above`` pixels; else 0.

    ``classified`` is read twice, so it should be a written table. Pixels that it doesn't have get no class.
    """
    found = classified.where("class = 3").select(F.floor(F.col("px") / columns).alias("r"), (F.col("px") % columns).alias("c"))
    kept = components.large_regions(components.regions(found, columns, tile, pixels=pixels, chain=halo.smooth()), above).select((F.col("r") * columns + F.col("c")).alias("_px"))
    joined = classified.join(kept, F.col("px") == F.col("_px"), "left")
    return joined.withColumn("class", F.when(F.col("_px").isNotNull(), 3).otherwise(0)).drop("_px")


def trends(composites: DataFrame) -> DataFrame:
    """``trend``: 1 falling vegetation, 2 rising built-up index, which overrides; and a flag for each."""
    fall, rise = F.col("ndvi_slope") < ix.NDVI_FALL, F.col("ndbi_slope") > ix.NDBI_RISE
    return composites.withColumns({"falling": fall, "rising": rise, "trend": F.when(rise, 2).when(fall, 1).otherwise(0)})


def summary(classified: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """One row: counts, the union of class and trend, percent and hectares within ``box`` (west, south, east, north)."""
    changed = (F.col("class") != 0) | (F.col("trend") != 0)
    counts = classified.agg(
        F.count("*").alias("total_pixels"), F.count_if(F.col("class") == 3).alias("construction_pixels"), F.count_if("falling").alias("deforestation_trend_pixels"),
        F.count_if("rising").alias("urban_trend_pixels"), F.count_if(changed).alias("changed_pixels"),
    )
    ground = geo.ground_area(*[F.lit(x) for x in box])
    ha, total = F.round(F.col("changed_pixels") * (ground / F.greatest(F.lit(1), F.col("total_pixels"))) / 10000, 2), F.round(ground / 10000, 2)
    percent = F.round(F.col("changed_pixels") / F.greatest(F.lit(1), F.col("total_pixels")) * 100, 2)
    return counts.withColumns({"change_percent": percent, "change_hectares": F.least(ha, total), "total_hectares": total})


def yearly_frames(cube: DataFrame, box: tuple[float, float, float, float], pixels: int) -> DataFrame:
    """One row per year: index means over valid pixels (all, if none is), class percents, cloud and change since the first year."""
    first = {f"{x}0": F.first(x).over(Window.partitionBy("px").orderBy("yr")) for x in ("ndvi", "ndbi")}
    c, ok = F.col, F.col("valid")
    rows = cube.withColumns(first)
    moved = 0.6 * F.abs(c("ndvi") - c("ndvi0")) + 0.4 * F.abs(c("ndbi") - c("ndbi0")) > 0.12
    n = F.greatest(F.lit(1), F.count_if(ok))

    def mean(x: str) -> Column:
        return F.round(F.coalesce(F.avg(F.when(ok, c(x))), F.avg(x)), 4)

    ground = geo.ground_area(*[F.lit(v) for v in box])
    hectares = F.round(F.least(F.count_if(moved & ok) * (ground / max(1, pixels)) / 10000, F.round(ground / 10000, 2)), 2)
    return rows.groupBy("yr").agg(
        mean("ndvi").alias("ndvi_mean"), mean("ndbi").alias("ndbi_mean"), F.round(F.count_if(ix.is_vegetation(c("ndvi"), c("ndwi")) & ok) / n * 100, 1).alias("vegetation_pct"),
        F.round(F.count_if(ix.is_urban(c("ndvi"), c("ndbi"), c("ndwi")) & ok) / n * 100, 1).alias("urban_pct"), F.round(100 * (1 - F.avg(F.when(ok, 1.0).otherwise(0.0))), 1).alias("cloud_pct"), hectares.alias("change_area_ha"),
    )


def cloud_percent(cube: DataFrame) -> DataFrame:
    return cube.groupBy("yr").agg(F.round(100 * (1 - F.count_if("valid") / F.count("*")), 4).alias("cloud_percent"))


def image_quality(images: DataFrame, key: str, value: Column) -> DataFrame:
    """Population deviation and mean by image; blank below 1; label by deviation."""
    made = images.groupBy(key).agg(F.stddev_pop(value).alias("s"), F.avg(value).alias("m"))
    return made.select(key, F.round("s", 4).alias("std"), F.round("m", 4).alias("mean"), (F.col("s") >= 1).alias("is_valid"), ix.quality_label(F.col("s")).alias("quality"))


def percentile_normalize(images: DataFrame, key: str, value: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Stretch between two exact percentiles of each image, clipped to 0..1; a flat image is 0.

    Equal values are counted first, so one large image is a percentile over counts and not over pixels.
    """
    counted = images.groupBy(key, value).agg(F.count("*").alias("_n"))
    ends = counted.groupBy(key).agg(F.percentile(value, F.lit(low), F.col("_n")).alias("low"), F.percentile(value, F.lit(high), F.col("_n")).alias("high"))
    spread = F.col("high") - F.col("low")
    # one row per image, a broadcast only while Spark finds it small; else images are split by the skew join
    return images.join(ends, key).withColumn("stretched", F.when(spread > 0, ix.clamp((F.col(value) - F.col("low")) / spread, 0.0, 1.0)).otherwise(0.0))
