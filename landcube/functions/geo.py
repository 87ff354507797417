"""Areas, bounding boxes and their keys, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Factors from square metres, metres per degree.
HECTARES, ACRES, SQUARE_KM, DEGREE = 0.0001, 0.000247105, 0.000001, 111_000.0


def area_units(square_metres: Column) -> dict[str, Column]:
    return {"area_sqm": square_metres, "area_hectares": square_metres * HECTARES, "area_acres": square_metres * ACRES, "area_sqkm": square_metres * SQUARE_KM}


def pixel_area(pixels: Column, resolution: float = 10.0) -> Column:
    return pixels * F.lit(resolution * resolution)


def ground_area(west: Column, south: Column, east: Column, north: Column) -> Column:
    """Square metres of a box, at the mean latitude's length of a degree."""
    return (north - south) * DEGREE * (east - west) * DEGREE * F.cos(F.radians((north + south) / 2))


def is_box(west: Column, south: Column, east: Column, north: Column) -> Column:
    """All there, north above south, east of west, on the globe."""
    there = west.isNotNull() & south.isNotNull() & east.isNotNull() & north.isNotNull()
    fine = (north > south) & (east > west) & south.between(-90, 90) & north.between(-90, 90) & west.between(-180, 180) & east.between(-180, 180)
    return there & F.coalesce(fine, F.lit(False))


def box_key(west: Column, south: Column, east: Column, north: Column, *more: Column) -> Column:
    """md5 of the corners to six places and of what else tells requests apart (date, size)."""
    return F.md5(F.concat_ws("_", F.format_string("%.6f_%.6f_%.6f_%.6f", west, south, east, north), *more))


def box_wkt(west: Column, south: Column, east: Column, north: Column) -> Column:
    """A closed ring of five points from the south-west corner."""
    return F.format_string("POLYGON((%.6f %.6f, %.6f %.6f, %.6f %.6f, %.6f %.6f, %.6f %.6f))", west, south, east, south, east, north, west, north, west, south)


def overlap_percent(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    """What part of box ``a`` (west, south, east, north) lies in ``b``, in percent."""
    wide = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    high = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    own = (a[2] - a[0]) * (a[3] - a[1])
    return F.when(own > 0, 100 * wide * high / own).otherwise(0.0)


def position_overlap_percent(row_a: Column, col_a: Column, row_b: Column, col_b: Column, tile: int) -> Column:
    """What part of a tile at one pixel position another of the same size covers, in percent."""
    high = F.greatest(F.lit(0), tile - F.abs(row_a - row_b))
    wide = F.greatest(F.lit(0), tile - F.abs(col_a - col_b))
    return 100 * high * wide / F.lit(tile * tile)


def category_hectares(pixels: Column, pixel_area_m2: Column) -> Column:
    return pixels * pixel_area_m2 / 10000
