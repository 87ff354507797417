"""Land-cover class maps, transitions between two periods, and their areas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landcube.functions.geo import area_units, pixel_area
from landcube.operators.tiles import inference_tiles
from landcube.sources.dimensions import BATCH_CLASSES, CHANGES, GREY, STREAM_CLASSES, change_classes, change_pairs, cities


def batch_class(model_class: Column) -> Column:
    """Land cover of a model's class id; of two classes that claim an id the later wins."""
    out = F.lit(0)
    for cover, ids in BATCH_CLASSES.items():
        out = F.when(model_class.isin(*ids), cover).otherwise(out)
    return out.cast("int")


def stream_class(model_class: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in STREAM_CLASSES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, model_class), F.lit(0)).cast("int")


def paired(cube: DataFrame, before: int, after: int, cls: Column, tile: int | None = None) -> DataFrame:
    """px, r, c, cls_before, cls_after of pixels that both years have; one grouping instead of a self-join.

    With ``tile``, only within tiles of that size which have one shape in both years (:func:`comparable_tiles`).
    """
    if tile is not None:
        tiled = inference_tiles(cube, tile)
        same = comparable_tiles(tiled, before, after).select("tile_row", "tile_col")  # a row for each tile
        cube = tiled.join(same, ["tile_row", "tile_col"], "left_semi")
    both = cube.where(F.col("yr").isin(before, after)).groupBy("px", "r", "c")
    made = both.agg(F.max(F.when(F.col("yr") == before, cls)).alias("cls_before"), F.max(F.when(F.col("yr") == after, cls)).alias("cls_after"))
    return made.where("cls_before is not null and cls_after is not null")


def tile_shapes(cells: DataFrame) -> DataFrame:
    """Rows and columns of each tile (tile_row, tile_col) of each year."""
    high, wide = F.max("r") - F.min("r") + 1, F.max("c") - F.min("c") + 1
    return cells.groupBy("yr", "tile_row", "tile_col").agg(high.alias("rows"), wide.alias("columns"))


def comparable_tiles(cells: DataFrame, before: int, after: int) -> DataFrame:
    """tile_row, tile_col of the tiles that both years have in one shape; tiles of unlike shapes are not compared."""
    shape = F.struct("rows", "columns")
    both = tile_shapes(cells.where(F.col("yr").isin(before, after))).groupBy("tile_row", "tile_col")
    made = both.agg(F.max(F.when(F.col("yr") == before, shape)).alias("b"), F.max(F.when(F.col("yr") == after, shape)).alias("a"))
    return made.where("a = b").select("tile_row", "tile_col", "b.rows", "b.columns")


def transition_pixels(pairs: DataFrame) -> DataFrame:
    """A row for each pixel and change type; types overlap, so a pixel may be in several."""
    return pairs.join(F.broadcast(change_pairs(pairs.sparkSession)), ["cls_before", "cls_after"])  # 11 rows


def overlay_colour(before: Column, after: Column) -> Column:
    """The colour of the last change type that a pixel is in."""
    out = F.lit(None).cast("array<int>")
    for source, target, colour, _ in CHANGES.values():
        out = F.when(before.isin(*source) & after.isin(*target), F.array(*[F.lit(c) for c in colour])).otherwise(out)
    return out


def transition_stats(pixels: DataFrame, by: list[str], resolution: float = 10.0) -> DataFrame:
    counted = pixels.groupBy(*by).agg(F.count("*").alias("pixels"))
    return counted.withColumns({k: F.round(v, 6) for k, v in area_units(pixel_area(F.col("pixels"), resolution)).items()})


def transition_rollup(pixels: DataFrame) -> DataFrame:
    """Pixels by type and tile, by type, and all; NULL stands for all."""
    return pixels.rollup("change_type", "tile").agg(F.count("*").alias("pixels"))


def stream_rules(before: Column, after: Column) -> dict[str, Column]:
    """The four rules of the streaming variant, on its own classes."""
    return {
        "deforestation": (before == 2) & (after != 2), "construction": (before != 1) & (after == 1), "water_loss": (before == 3) & (after != 3),
        "urbanization": (before == 0) & after.isin(1, 4),
    }


def stream_colour(before: Column, after: Column) -> Column:
    """Grey where nothing changed; else the last rule's colour, of red, blue and yellow; NULL without any."""
    rules, out = stream_rules(before, after), F.lit(None).cast("array<int>")
    for rule, colour in (("deforestation", [255, 0, 0]), ("construction", [0, 0, 255]), ("water_loss", [255, 255, 0])):
        out = F.when(rules[rule], F.array(*[F.lit(c) for c in colour])).otherwise(out)
    return F.when(before == after, F.array(*[F.lit(c) for c in GREY])).otherwise(out)


def stream_rule_stats(pairs: DataFrame, by: list[str], resolution: float = 10.0) -> DataFrame:
    """Hectares under each rule by group."""
    rules = stream_rules(F.col("cls_before"), F.col("cls_after"))
    return pairs.groupBy(*by).agg(*[F.round(pixel_area(F.count_if(v), resolution) / 10000, 6).alias(f"{k}_hectares") for k, v in rules.items()])


def class_histogram(cells: DataFrame, by: list[str], cls: str) -> DataFrame:
    return cells.groupBy(*by, cls).agg(F.count("*").alias("pixels"))


def merge_statistics(*parts: DataFrame) -> DataFrame:
    """Sum statistics of several runs by change type."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy("change_type").agg(F.sum("pixels").alias("pixels"), F.round(F.sum("area_hectares"), 6).alias("area_hectares"))


def with_city(results: DataFrame, city: str) -> DataFrame:
    """name and country of the column ``city``, whatever its case; an unknown city is named by itself, its country Unknown."""
    known = cities(results.sparkSession).select(F.col("city").alias("_city"), "name", "country")
    joined = results.join(F.broadcast(known), F.lower(city) == F.col("_city"), "left").drop("_city")  # 4 rows
    return joined.withColumns({"name": F.coalesce("name", city), "country": F.coalesce("country", F.lit("Unknown"))})


def report(stats: DataFrame) -> DataFrame:
    """Types with an area, with names and colours; an unknown type is named by its key and grey."""
    known = change_classes(stats.sparkSession).select("change_type", "name", "color")
    joined = stats.where(F.col("area_hectares") > 0).join(F.broadcast(known), "change_type", "left")  # 5 rows
    colour = F.coalesce("color", F.array(*[F.lit(c) for c in GREY]))
    return joined.select("change_type", F.coalesce("name", "change_type").alias("name"), F.concat_ws(",", colour.cast("array<string>")).alias("color"), "pixels", "area_hectares")
