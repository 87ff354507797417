"""Neighbourhood operators on sparse masks (r, c): each is a chain of windows run tile by tile after one halo exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame

from landcube.operators import halo
from landcube.operators.halo import TILE


def dilate(mask: DataFrame, columns: int, pixels: int, height: int, width: int | None = None, tile: int = TILE) -> DataFrame:
    return halo.through(mask, columns, pixels, halo.dilate(height, width), tile)


def erode(mask: DataFrame, columns: int, pixels: int, height: int, width: int | None = None, tile: int = TILE) -> DataFrame:
    """Pixels whose window, as far as it lies in the image, is all in the mask."""
    return halo.through(mask, columns, pixels, halo.erode(height, width), tile)


def close(mask: DataFrame, columns: int, pixels: int, height: int, width: int | None = None, tile: int = TILE) -> DataFrame:
    return halo.through(mask, columns, pixels, halo.close(height, width), tile)


def opened(mask: DataFrame, columns: int, pixels: int, height: int, width: int | None = None, tile: int = TILE) -> DataFrame:
    return halo.through(mask, columns, pixels, halo.opened(height, width), tile)


def border(mask: DataFrame, columns: int, pixels: int, size: int = 4, tile: int = TILE) -> DataFrame:
    """What a dilation adds."""
    return halo.through(mask, columns, pixels, halo.border(size), tile)


def thin_lines(mask: DataFrame, columns: int, pixels: int, length: int = 13, tile: int = TILE) -> DataFrame:
    """Long thin parts: opened along rows or along columns, then closed."""
    return halo.through(mask, columns, pixels, halo.thin_lines(length), tile)


def blur(mask: DataFrame, rows: int, columns: int, tile: int = TILE) -> DataFrame:
    """(r, c, v) of the mask (as 0 and 1) under a 5 x 5 binomial blur, where v is above 0."""
    return halo.through(mask, columns, rows * columns, halo.BLURRED, tile, schema="r long, c long, v double")


def smooth(mask: DataFrame, columns: int, pixels: int, threshold: float = 0.4, tile: int = TILE) -> DataFrame:
    """Close 5 x 5, blur, and keep what is above the threshold, within the image (its last row may be partial)."""
    return halo.through(mask, columns, pixels, halo.smooth(threshold), tile)
