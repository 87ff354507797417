"""Spectral indices, scores and colours of a pixel, as columns. Invalid is NULL, never NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scene classes that count as clear, thresholds and weights of the published rules.
CLEAR_CLASSES = (2, 4, 5, 6, 7, 11)
PERIOD_WEIGHTS = {"ndvi": 0.50, "ndbi": 0.35, "ndwi": 0.15}
NDVI_FALL, NDBI_RISE = -0.02, 0.015


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def normalized_difference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b), and 0 where the sum is 0.001 or less."""
    return F.when(a + b > 0.001, (a - b) / (a + b)).otherwise(0.0)


def quantize(index: Column) -> Column:
    """An index in -1..1 as 0..255, half up."""
    return clamp(F.floor((index + 1) * 127.5 + 0.5), 0, 255).cast("int")


def dequantize(value: Column) -> Column:
    return value / F.lit(127.5) - 1


def is_clear(scene_class: Column) -> Column:
    return scene_class.isin(*CLEAR_CLASSES)


def period_prior(d_ndvi: Column, d_ndbi: Column, d_ndwi: Column) -> Column:
    """Change score from the absolute differences of two periods."""
    w = PERIOD_WEIGHTS
    return clamp(sigmoid(10 * (w["ndvi"] * F.abs(d_ndvi) + w["ndbi"] * F.abs(d_ndbi) + w["ndwi"] * F.abs(d_ndwi) - 0.10)), 0.0, 1.0)


def temporal_prior(*first_last: tuple[Column, Column]) -> Column:
    """Change score from the mean absolute difference of first and last filled values over the channels."""
    moved = sum((F.abs(b - a) for a, b in first_last), F.lit(0.0)) / len(first_last)
    return sigmoid(14 * (moved - 0.08))


def fuse(model: Column, temporal: Column, period: Column) -> Column:
    return clamp(0.55 * clamp(0.2 * model + 0.8 * temporal, 0.0, 1.0) + 0.45 * period, 0.0, 1.0)


def heat_alpha(p: Column) -> Column:
    return clamp((p - 0.45) / 0.45, 0.0, 1.0) * 230


# Fixed values in the rules below: gains, thresholds and the darkening of invalid pixels.
def frame_colour(index: Column, gain: int, offset: int, valid: Column) -> Column:
    """One channel of the false-colour frame, darkened where invalid."""
    bright = F.floor(clamp((index + 1) / 2 * gain + offset, 0, 255))
    return F.when(valid, bright).otherwise(F.floor(bright * 0.3)).cast("int")


def tier_one(p: Column, ndvi: Column, ndbi: Column, ndwi: Column, d_ndbi: Column) -> Column:
    return (p > 0.70) & (ndbi > 0.15) & (ndvi < 0.25) & (ndwi < 0.25) & (d_ndbi > 0.05)


def tier_two(p: Column, ndvi: Column, ndbi: Column, ndwi: Column, d_ndvi: Column, d_ndbi: Column) -> Column:
    return (p > 0.55) & (ndbi > 0.10) & (ndvi < 0.25) & (ndwi < 0.25) & (d_ndbi > 0.12) & (d_ndvi < -0.10)


def is_vegetation(ndvi: Column, ndwi: Column) -> Column:
    return (ndvi > 0.3) & (ndwi < 0.2)


def is_urban(ndvi: Column, ndbi: Column, ndwi: Column) -> Column:
    return (ndbi > 0.05) & (ndvi < 0.25) & (ndwi < 0.2)


def is_real_tile(std: Column) -> Column:
    """Whether an image varies enough to be shown in place of the drawn frame."""
    return std > 15


def quality_label(std: Column) -> Column:
    return F.when(std >= 45, "Good").when(std >= 20, "Acceptable").otherwise("Poor")


def display_channel(reflectance: Column) -> Column:
    """A band in 0..1 as 0..255, clipped."""
    return F.floor(clamp(reflectance * 255, 0, 255)).cast("int")


def rgb(red: Column, green: Column, blue: Column) -> Column:
    """True colour, or false colour with other bands in the places."""
    return F.array(display_channel(red), display_channel(green), display_channel(blue))
