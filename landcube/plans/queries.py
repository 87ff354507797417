"""Registered queries over the driver's tables; :mod:`landcube.plans.sql` has the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landcube.functions import geo
from landcube.functions import indices as ix
from landcube.operators import blocks, change, composite, model, morphology, outlines, store, tiles, transitions
from landcube.operators import components as regions_of
from landcube.sources import cube as cubes
from landcube.sources import raster, rastersource, sinks
from landcube.sources.cube import table
from landcube.sources.dimensions import change_classes
from landcube.sources.shared import shared_path, written
from landcube.streaming import cache
from landcube.streaming import totals as streaming

#: Dates of the two periods; which years stand for them is chosen from those there are.
BEFORE, AFTER = 1997, 2000
#: west, south, east, north of the area that the grid stands for; tile size; year of masks.
BOX, TILE, MASK_YEAR = (77.37, 12.734, 77.88, 13.173), 16, 2001
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def r6(*names: str) -> list:
    """Rounded to six places; no negative zero."""
    return [(F.round(n, 6) + F.lit(0.0)).alias(n) for n in names]


def _composites(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [r["yr"] for r in cubes.years(spark, sf_dir).collect()]  # a row for each year
    return composite.period_composites(cubes.index_cube(spark, sf_dir), *composite.select_periods(found, BEFORE, AFTER))


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change.trends(change.construction(change.fused(_composites(spark, sf_dir))))


def _smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classified pixels, with regions in place of single pixels."""
    made = written(_classified(spark, sf_dir).select("px", "class", "trend", "falling", "rising"), "classified")
    return change.smoothed(made, *cubes.grid_width(spark, sf_dir))


def _pairs(spark: SparkSession, sf_dir: str, cls: Column | None = None) -> DataFrame:
    pairs = transitions.paired(cubes.pixel_cube(spark, sf_dir, [1996, 2001]), 1996, 2001, F.col("cls") if cls is None else cls)
    return pairs.withColumn("tile", F.floor(F.col("r") / TILE) * 1000 + F.floor(F.col("c") / TILE))


def _mask(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int, int]:
    width, n = cubes.grid_width(spark, sf_dir)
    return cubes.pixel_cube(spark, sf_dir, [MASK_YEAR]).where("cls = 1").select("r", "c"), width, n


def _key() -> Column:
    return F.regexp_extract("props", r'"k": *([0-9]+)', 1).cast("long")


def _cache(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, Column]:
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", "user_id", _key().alias("key"))
    entries = events.where("event_type = 'purchase'").select("key", F.col("event_id").alias("id"), F.col("ts").alias("created"))
    return events.where("event_type = 'view'").select("event_id", "key"), entries, F.lit("2024-01-25").cast("timestamp_ntz")


@query
def spectral_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cubes.index_cube(spark, sf_dir).select("yr", "px", *r6("ndvi", "ndbi", "ndwi"), "valid")


@query
def index_quantize_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = cubes.index_cube(spark, sf_dir).withColumn("u8", ix.quantize(F.round("ndvi", 9)))
    return q.select("yr", "px", "u8", F.round(ix.dequantize(F.col("u8")), 6).alias("ndvi_back"))


@query
def cloud_percent_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change.cloud_percent(cubes.pixel_cube(spark, sf_dir))


@query
def temporal_median_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return composite.median_fill(cubes.index_cube(spark, sf_dir)).select("yr", "px", *r6("ndvi_filled", "ndbi_filled", "ndwi_filled"))


@query
def period_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The years that stand for two dates, and for dates where only years between them, or the first and last, are left."""
    cases = [(1, BEFORE, AFTER), (2, 1980, 1993), (3, 1996, 2030), (4, 1985, 1990), (5, 2010, 2020)]
    made = [composite.period_years(cubes.years(spark, sf_dir), b, a).select(F.lit(k).alias("case"), "side", "yr") for k, b, a in cases]
    return reduce(DataFrame.union, made)


@query
def period_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [f"{x}_{s}" for s in ("before", "after") for x in composite.CHANNELS]
    return _composites(spark, sf_dir).select("px", *r6(*names), "valid_before", "valid_after")


@query
def change_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change.with_prior(_composites(spark, sf_dir)).select("px", *r6("period_prior"))


@query
def temporal_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _composites(spark, sf_dir).withColumn("prior", change.temporal_score()).select("px", *r6("prior"))


@query
def change_score_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change.fused(_composites(spark, sf_dir)).select("px", *r6("prob"), F.round(ix.heat_alpha(F.col("prob")), 4).alias("alpha"))


@query
def construction_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).where("tier > 0").select("px", "tier", "class")


@query
def construction_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of class 3 after smoothing."""
    return _smoothed(spark, sf_dir).where("class = 3").select("px", "class", "trend")


@query
def mask_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask, w, n = _mask(spark, sf_dir)
    return morphology.smooth(mask, w, n)


@query
def solid_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With windows and sizes for this small grid."""
    mask, w, n = _mask(spark, sf_dir)
    return regions_of.solid_regions(mask, w, n, size=3, least=8, tile=16)


@query
def trend_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change.trends(_composites(spark, sf_dir)).select("px", *r6("ndvi_slope", "ndbi_slope"), "trend")


@query
def trend_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = change.trends(_composites(spark, sf_dir))
    return made.agg(F.count_if("falling").alias("falling"), F.count_if("rising").alias("rising"), F.count_if(F.col("trend") == 1).alias("shown_falling"), F.count_if(F.col("trend") == 2).alias("shown_rising"))


#: A fixed linear model over years and indices: the later years count for, the earlier against.
YEARS = list(range(1995, 2002))
WEIGHTS = [[0.25 * (y - 1998) * w for w in (-0.5, 0.35, 0.15)] for y in YEARS]


@query
def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities that a model gives whole tiles, and the scores fused with them; a pixel's missing years are zeros."""
    width, n = cubes.grid_width(spark, sf_dir)
    cube = cubes.index_cube(spark, sf_dir)
    tiled = blocks.to_blocks(cube, YEARS, list(composite.CHANNELS), 64)
    probable = blocks.to_cells(model.segmented(tiled, model.linear_model(np.array(WEIGHTS), -0.1), [0], "p"), width, n, ["p"])
    probable = probable.select((F.col("r") * width + F.col("c")).alias("px"), "p")
    scored = change.fused(model.with_probability(_composites(spark, sf_dir).join(probable, "px"), F.col("p")), F.col("model_prob"))
    return scored.select("px", *r6("model_prob", "prob"))


@query
def block_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two years of the cube as padded blocks, written as TIFF tiles, read back by rows and placed by the tiles' names."""
    tiled = blocks.to_blocks(cubes.pixel_cube(spark, sf_dir, [1996, 2001]), [1996, 2001], ["nir", "swir"], 32)
    folder = shared_path(spark, "tiles")
    sinks.write_files(blocks.encoded(tiled, "tif"), folder)
    back = rastersource.cells(spark, folder, "*.tif", wide="2")
    part = lambda k: F.split_part(F.regexp_replace("name", "[.]tif$", ""), F.lit("_"), F.lit(k)).cast("long")
    width, n = cubes.grid_width(spark, sf_dir)
    placed = back.select(part(2).cast("int").alias("yr"), (part(3) * 32 + F.col("r")).alias("r"), (part(4) * 32 + F.col("c")).alias("c"), F.round("b0", 6).alias("nir"), F.round("b1", 6).alias("swir"))
    return placed.where((F.col("c") < width) & (F.col("r") * width + F.col("c") < n))


@query
def change_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed between the two periods: fused score, tiers, smoothed regions and trends, counted over the grid."""
    return change.summary(_smoothed(spark, sf_dir), BOX)


@query
def change_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formatting of the answer: whether there is change, square kilometres and confidence."""
    s, p = change.summary(_smoothed(spark, sf_dir), BOX), F.col("change_percent")
    return s.select((p > 1).alias("change_detected"), F.round(F.col("change_hectares") / 100, 4).alias("area_km2"), F.when(p > 2, "High").otherwise("Medium").alias("confidence"))


@query
def yearly_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change.yearly_frames(cubes.index_cube(spark, sf_dir), BOX, cubes.grid_width(spark, sf_dir)[1])


@query
def frame_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cubes.index_cube(spark, sf_dir)
    made = {n: ix.frame_colour(F.round(x, 9), gain, offset, F.col("valid")) for n, x, gain, offset in (("red8", "ndbi", 200, 30), ("green8", "ndvi", 220, 20), ("blue8", "ndwi", 180, 30))}
    return c.select("yr", "px", *[v.alias(k) for k, v in made.items()])


@query
def image_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cubes.index_cube(spark, sf_dir).withColumn("grey", ix.quantize(F.round("ndvi", 9)))
    return change.image_quality(c, "yr", F.col("grey"))


@query
def percentile_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cubes.pixel_cube(spark, sf_dir).withColumn("dn", F.floor(F.col("nir") * 1000))
    return change.percentile_normalize(c, "yr", "dn").select("yr", "px", *r6("stretched"))


@query
def classmap_remap_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cubes.pixel_cube(spark, sf_dir).select("yr", "px", transitions.batch_class(F.col("ade")).alias("cover"))


@query
def classmap_remap_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cubes.pixel_cube(spark, sf_dir).select("yr", "px", transitions.stream_class(F.col("ade")).alias("cover"))


@query
def tile_class_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = tiles.inference_tiles(cubes.pixel_cube(spark, sf_dir), TILE)
    return transitions.class_histogram(cells, ["yr", "tile_row", "tile_col"], "cls")


@query
def transition_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transitions.transition_pixels(_pairs(spark, sf_dir)).select("px", "change_type")


@query
def transition_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transitions.transition_stats(transitions.transition_pixels(_pairs(spark, sf_dir)), ["change_type"])


@query
def transition_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = transitions.transition_rollup(transitions.transition_pixels(_pairs(spark, sf_dir)))
    return made.select(F.coalesce("change_type", F.lit("all")).alias("change_type"), F.coalesce("tile", F.lit(-1)).alias("tile"), "pixels")


@query
def transition_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, a = F.col("cls_before"), F.col("cls_after")
    text = lambda c: F.coalesce(F.concat_ws(",", c.cast("array<string>")), F.lit(""))
    return _pairs(spark, sf_dir).select("px", text(transitions.overlay_colour(b, a)).alias("overlay"), text(transitions.stream_colour(b, a)).alias("stream"))


@query
def stream_rule_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transitions.stream_rule_stats(_pairs(spark, sf_dir, transitions.stream_class(F.col("ade"))), ["tile"])


@query
def merge_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = transitions.transition_pixels(_pairs(spark, sf_dir))
    halves = [transitions.transition_stats(hit.where(F.col("px") % 2 == k), ["change_type"]) for k in (0, 1)]
    return transitions.merge_statistics(*halves)


@query
def report_with_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = transitions.transition_stats(transitions.transition_pixels(_pairs(spark, sf_dir)), ["change_type"]).select("change_type", "pixels", "area_hectares")
    other = stats.select(F.concat(F.col("change_type"), F.lit("_new")).alias("change_type"), "pixels", "area_hectares")
    return transitions.report(stats.union(other))


@query
def change_class_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of the first class of each change type, from the dimension with arrays."""
    counted = cubes.pixel_cube(spark, sf_dir).groupBy("cls").agg(F.count("*").alias("pixels"))
    first = change_classes(spark).select("change_type", F.explode("from").alias("cls"))
    return counted.join(F.broadcast(first), "cls").select("change_type", "cls", "pixels")  # 7 rows


@query
def tile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer as a box, split 4 x 4."""
    n = table(spark, sf_dir, "customer").select("c_custkey", *_boxes("c_custkey"))
    return tiles.split_box(n, 4).select("c_custkey", "i", "j", "tile_west", "tile_south", "tile_east", "tile_north")


def _boxes(key: str) -> list:
    """A box for each number; every fourth is empty, and some lie beyond the globe."""
    k = (F.col(key) % 50).cast("double")
    return [(k * 5 - 60).alias("west"), (k * 3 - 40).alias("south"), (k * 5 - 60 + (F.col(key) % 4) * 0.5).alias("east"), (k * 3 - 40 + 1.25).alias("north")]


@query
def tile_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    width, n = cubes.grid_width(spark, sf_dir)
    cells = cubes.pixel_cube(spark, sf_dir, [MASK_YEAR])
    made = tiles.assign_tiles(cells, 8, -(-n // width), width, overlap=2)
    return made.groupBy("tile_row", "tile_col").agg(F.count("*").alias("pixels"), F.sum("px").alias("sum_px"))


@query
def tile_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of each customer's box with the same box moved by 0.3 degrees."""
    n = table(spark, sf_dir, "customer").select("c_custkey", *_boxes("c_custkey"))
    box = lambda d: tuple(F.col(x) + d for x in ("west", "south", "east", "north"))
    return n.select("c_custkey", F.round(geo.overlap_percent(box(0), box(0.3)), 6).alias("overlap_pct"))


@query
def bbox_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "customer").select("c_custkey", *_boxes("c_custkey"))
    box = [F.col(x) for x in ("west", "south", "east", "north")]
    area = F.round(geo.ground_area(*box) / 10000, 4)
    area = area + F.lit(0.0)  # no negative zero
    return n.select("c_custkey", geo.is_box(*box).alias("valid_box"), geo.box_key(*box, F.lit("2024-01-01"), F.lit("512")).alias("box_key"), geo.box_wkt(*box).alias("wkt"), area.alias("ground_ha"))


@query
def mask_dilate(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask, w, n = _mask(spark, sf_dir)
    return morphology.dilate(mask, w, n, 3)


@query
def mask_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask, w, n = _mask(spark, sf_dir)
    return morphology.close(mask, w, n, 3)


@query
def mask_border(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask, w, n = _mask(spark, sf_dir)
    return morphology.border(mask, w, n)


@query
def mask_blur(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask, w, n = _mask(spark, sf_dir)
    return morphology.blur(mask, -(-n // w), w).select(F.col("r").cast("long"), F.col("c").cast("long"), "v")


@query
def thin_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask, w, n = _mask(spark, sf_dir)
    return morphology.thin_lines(mask, w, n, 2)


@query
def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask, w, _ = _mask(spark, sf_dir)
    return regions_of.regions(mask, w, tile=16)


@query
def regions_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask, w, _ = _mask(spark, sf_dir)
    return regions_of.large_regions(regions_of.regions(mask, w, tile=16), 3).select("r", "c", "region")


@query
def holes_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask, w, n = _mask(spark, sf_dir)
    return regions_of.fill_holes(mask, -(-n // w), w, tile=16)


@query
def resample_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    width, n = cubes.grid_width(spark, sf_dir)
    cells = cubes.pixel_cube(spark, sf_dir, [MASK_YEAR]).select("r", "c", "nir")
    return tiles.bilinear_double(cells, "nir", -(-n // width), width).select(F.col("r").cast("long"), F.col("c").cast("long"), F.round("nir", 9).alias("nir"))


@query
def shrink_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = cubes.pixel_cube(spark, sf_dir, [MASK_YEAR]).select("r", "c", "nir")
    return tiles.shrink(cells, "nir", 2).select("r", "c", *r6("nir"))


@query
def road_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With lengths and sizes for this small grid."""
    mask, w, n = _mask(spark, sf_dir)
    return regions_of.roads(mask, w, n, length=2, least=6, tile=16)


@query
def real_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cubes.index_cube(spark, sf_dir).withColumn("grey", ix.quantize(F.round("ndvi", 9)))
    return c.groupBy("yr").agg(ix.is_real_tile(F.stddev_pop("grey")).alias("is_real_tile"))


@query
def true_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = ix.rgb(F.round(F.col("red"), 9), F.round(F.col("green"), 9), F.round(F.col("swir"), 9))
    return cubes.pixel_cube(spark, sf_dir).select("yr", "px", F.concat_ws(",", made.cast("array<string>")).alias("rgb"))


@query
def category_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = cubes.pixel_cube(spark, sf_dir).groupBy("yr", "cls").agg(F.count("*").alias("n"))
    return counted.select("yr", "cls", F.round(geo.category_hectares(F.col("n"), F.lit(100.0)), 6).alias("hectares"))


@query
def comparable_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = tiles.inference_tiles(cubes.pixel_cube(spark, sf_dir, [1996, 2001]), 8)
    return transitions.comparable_tiles(cells, 1996, 2001)


@query
def city_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers dealt to cities, known and unknown, with the cities' names and countries."""
    names = F.array(*[F.lit(x) for x in ("bangalore", "Delhi", "mumbai", "HYDERABAD", "pune")])
    c = table(spark, sf_dir, "customer").select(F.get(names, (F.col("c_custkey") % 5).cast("int")).alias("city"))
    return transitions.with_city(c.groupBy("city").agg(F.count("*").alias("n")), "city").select("city", "name", "country", "n")


@query
def history_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    made = sinks.history_rows(events, F.col("user_id"), F.col("ts"), "event_id", "event_type")
    return made.select("user_id", "status", "result_json")


@query
def year_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.year_sources(_products(spark, sf_dir)).select("aoi", "yr", "id", "cloud")


@query
def best_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.best_product(_products(spark, sf_dir), ["aoi", "yr"]).select("aoi", "yr", "id", "cloud")


def _products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a product catalogue: customer's number as area, cents of the price as cloud cover, open orders without."""
    o = table(spark, sf_dir, "orders")
    cloud = F.when(F.col("o_orderstatus") != "P", (F.floor(F.col("o_totalprice") * 100 + 0.5) % 10001) / 100)
    return o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 100).alias("aoi"), F.year("o_orderdate").alias("yr"), F.col("o_orderdate").alias("start"), cloud.alias("cloud"))


@query
def catalogue_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten products within 30 days of mid-1997 for each area, below 20 percent cloud."""
    p = _products(spark, sf_dir).where((F.col("cloud") < 20) & (F.col("start") > "1997-06-01") & (F.col("start") < "1997-07-31"))
    return store.first_by(p, ["aoi"], F.col("start"), F.col("id"), most=10).select("aoi", "id", "rank")


@query
def catalogue_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products that meet each nation's box around a date; a product's box is two degrees wide, placed by customer."""
    west, south = ((F.col("aoi") % 25) * 5 - 61).cast("double"), ((F.col("aoi") % 25) * 3 - 41).cast("double")
    products = _products(spark, sf_dir).withColumns({"west": west, "south": south, "east": west + 2, "north": south + 2})
    areas = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("aoi"), *_boxes("n_nationkey"), F.lit("1997-07-01").cast("date").alias("target"))
    return store.search_products(products.drop("aoi"), areas, 60, 30.0)


@query
def total_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hectares over all change types (types overlap), and over the pixels that changed in any way."""
    hit = transitions.transition_pixels(_pairs(spark, sf_dir))
    stats = transitions.transition_stats(hit, ["change_type"]).where("area_hectares > 0")
    once = hit.select("px").distinct().agg((F.count("*") / 100).alias("changed_hectares"))
    return stats.agg(F.round(F.sum("area_hectares"), 6).alias("type_hectares")).join(once)  # one row each


@query
def history_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.newest(table(spark, sf_dir, "events"), 20).select("user_id", "event_id", "rank")


@query
def latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.latest_status(table(spark, sf_dir, "events"))


@query
def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests, entries, now = _cache(spark, sf_dir)
    return store.hits(requests, store.live(entries, now, 3)).select("event_id", "key", "entry")


@query
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests, entries, now = _cache(spark, sf_dir)
    return store.misses(requests, store.live(entries, now, 1))


@query
def cache_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, entries, now = _cache(spark, sf_dir)
    return store.expired(entries, now, 3).select("id", "key")


@query
def cache_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views answered by purchases of their key at most three days old, and purchases as they expire, from a stream."""
    events = table(spark, sf_dir, "events").where("event_type in ('purchase', 'view')")
    kind = F.when(F.col("event_type") == "purchase", F.lit(cache.ENTRY)).otherwise(F.lit(cache.REQUEST))
    made = events.select(_key().alias("key"), F.col("event_id").cast("long").alias("id"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"))
    folder, day = shared_path(spark, "arrivals"), F.dayofmonth("ts")
    for first in range(1, 32, 6):  # arrivals of six days each, in the order of time; its own files are in none
        made.where((day >= first) & (day < first + 6)).write.mode("append").parquet(folder)
    end = spark.range(1).select(F.lit(-1).cast("long").alias("key"), F.lit(-1).cast("long").alias("id"), F.lit("2024-02-07").cast("timestamp").alias("ts"), F.lit(cache.TICK).alias("kind"))
    end.write.mode("append").parquet(folder)
    found = cache.stream_cache(spark, folder, 3, late="6 days")
    return found.select("kind", "key", "id", F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), F.coalesce("entry", F.lit(-1)).alias("entry"))


@query
def areas_with_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    areas = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return store.with_results(areas, table(spark, sf_dir, "orders").where("o_totalprice > 400000"), "o_custkey")


@query
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = streaming.windowed_activity(table(spark, sf_dir, "events"))
    return made.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("value", 2).alias("value"))


@query
def streaming_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(spark, sf_dir, transitions.stream_class(F.col("ade"))).select((F.col("tile") % 7).alias("city"), "tile", "px", "cls_before", "cls_after")
    folder = shared_path(spark, "pairs")
    pairs.repartition(6, "tile").write.parquet(folder)
    return streaming.stream_totals(spark, folder)


def _tile_stream(spark: SparkSession, sf_dir: str) -> str:
    """Pairs of classes as tile files, of which those with (row + column) % 5 = 0 are cut off, read as a stream."""
    pairs = _pairs(spark, sf_dir, transitions.stream_class(F.col("ade")))
    cells = pairs.select(F.lit(0).alias("yr"), "r", "c", (F.col("cls_before") + 1).alias("b"), (F.col("cls_after") + 1).alias("a"))
    files = blocks.encoded(blocks.to_blocks(cells, [0], ["b", "a"], TILE), "npy", "u1", "pair")
    at = [F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"_(\d+)_(\d+)[.]npy$", k).cast("long") for k in (1, 2)]
    named = files.withColumn("path", F.col("name"))
    broken = (at[0] + at[1]) % 5 == 0
    cut = named.withColumn("content", F.when(broken, F.expr("substring(content, 1, cast(length(content) / 2 as int))")).otherwise(F.col("content")))
    folder, state, out = (shared_path(spark, n) for n in ("files", "state", "counts"))
    sinks.write_files(cut, folder)
    arriving = streaming.arriving_files(spark, folder, "pair_*.npy").withColumn("tile", at[0] * 1000 + at[1]).withColumn("city", F.col("tile") % 7)
    streaming.stream_tiles(streaming.tile_pairs(arriving), state, out)
    return out


@query
def streaming_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by city over a stream of tile files, without those that can't be read."""
    return streaming.city_totals(streaming.latest_tiles(spark, _tile_stream(spark, sf_dir)))


@query
def streaming_bad_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tile files that the stream has set aside."""
    return streaming.bad_tiles(spark, _tile_stream(spark, sf_dir)).select("city", "tile", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("error").isNotNull().alias("has_error"))


@query
def pixel_mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a scene of its lines' pixels: the least cloudy valid one for each area, year and pixel."""
    scenes = _products(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_partkey") % 256).alias("px"), ix.is_clear(F.col("l_linenumber")).alias("valid"), F.col("l_linenumber").alias("line"))
    found = store.mosaic(lines.join(scenes, "id"), ["aoi", "yr", "px"], ["line"])
    return found.select("aoi", "yr", "px", "valid", F.coalesce("id", F.lit(-1)).alias("id"), F.coalesce("line", F.lit(-1)).alias("line"))


@query
def trend_from_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`trend_map` from a state of the years up to 2000, to which 2001 is added without reading them again."""
    path = shared_path(spark, "trends")
    composite.write_state(composite.year_sums(cubes.index_cube(spark, sf_dir, YEARS[:-1])), path, 2000)
    composite.add_year(spark, path, cubes.index_cube(spark, sf_dir, [2001]), 2000, 2001)
    return change.trends(composite.state_slopes(composite.read_state(spark, path, 2001))).select("px", *r6("ndvi_slope", "ndbi_slope"), "trend")


@query
def request_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request as it comes: two dates and a box. Only the years that it needs are read, from 1996 to 2000 here."""
    wanted = composite.year_range(1998, 1999, now=2000, first=1996)
    found = [r["yr"] for r in cubes.years(spark, sf_dir, wanted).collect()]  # a row for each year
    made = composite.period_composites(cubes.index_cube(spark, sf_dir, wanted), *composite.select_periods(found, 1998, 1999))
    made = change.trends(change.construction(change.fused(made)))
    made = written(made.select("px", "class", "trend", "falling", "rising"), "classified")
    return change.summary(change.smoothed(made, *cubes.grid_width(spark, sf_dir), above=20), BOX)


@query
def comparable_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitions within small tiles that have one shape in both years."""
    pairs = transitions.paired(cubes.pixel_cube(spark, sf_dir, [1996, 2001]), 1996, 2001, F.col("cls"), tile=3)
    return transitions.transition_pixels(pairs).select("px", "change_type")


@query
def resample_affine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid at one and a half times its resolution, moved by a quarter of a pixel to the south and a third to the west."""
    width, n = cubes.grid_width(spark, sf_dir)
    rows = -(-n // width)
    cells = cubes.pixel_cube(spark, sf_dir, [MASK_YEAR]).select("r", "c", "nir")
    made = tiles.resample(cells, "nir", (rows, width), (rows * 3 // 2, width * 3 // 2), (2 / 3, 2 / 3), (0.25, -1 / 3), tile=64)
    return made.select("r", "c", *r6("nir"))


@query
def stored_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of four years: what is read back of the years asked for, and which of them it doesn't have."""
    path, key = shared_path(spark, "years"), {"aoi_id": F.lit("all"), "size": F.lit(1)}
    cube = cubes.index_cube(spark, sf_dir, [1996, 1997, 1999, 2000]).withColumns(key).withColumnRenamed("yr", "year")
    raster.write_years(cube.select(*raster.YEAR_KEY, "px", "ndvi"), path)
    asked = cubes.years(spark, sf_dir).withColumns(key).withColumnRenamed("yr", "year")
    read = raster.read_years(spark, path, "all", 1, [1995, 1996, 2000]).groupBy("year").agg(F.count("*").alias("pixels"))
    missing = raster.missing_years(asked, spark.read.parquet(path)).select("year", F.lit(-1).cast("long").alias("pixels"))
    return read.union(missing)


@query
def stored_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles written by scene and place, read back: shapes and places in the mosaic."""
    path = shared_path(spark, "tiles")
    cells = tiles.inference_tiles(cubes.pixel_cube(spark, sf_dir, [1996, 2001]), TILE)
    raster.write_tiles(cells.select(F.col("yr").alias("scene"), "tile_row", "tile_col", (F.col("r") % TILE).alias("r"), (F.col("c") % TILE).alias("c")), path)
    back = tiles.mosaic(spark.read.parquet(path), TILE, TILE)
    placed = back.groupBy("scene", "tile_row", "tile_col").agg(F.sum("mosaic_r").alias("sum_r"), F.sum("mosaic_c").alias("sum_c"))
    return raster.tile_index(back).join(placed, ["scene", "tile_row", "tile_col"])


@query
def stored_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change masks and their statistics written, and read back from Parquet and JSON."""
    masks, results, schema = shared_path(spark, "masks"), shared_path(spark, "results"), "change_type string, pixels long, area_hectares double"
    hit = transitions.transition_pixels(_pairs(spark, sf_dir)).select("px", "change_type")
    sinks.write_masks(hit, masks)
    sinks.write_json(transitions.transition_stats(hit, ["change_type"]).select("change_type", "pixels", "area_hectares"), results)
    read = raster.json_results(spark, f"{results}-of-old", results, schema=schema, lines=True)
    mask = spark.read.parquet(masks).groupBy("change_type").agg(F.sum("px").alias("sum_px"))
    return read.join(mask, "change_type")


@query
def cache_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache entries added in two writes, and what is left once the expired ones are gone."""
    _, entries, now = _cache(spark, sf_dir)
    path, left = shared_path(spark, "cache"), shared_path(spark, "left")
    for k in (0, 1):
        sinks.append(entries.where(F.col("id") % 2 == k), path)
    sinks.replace_live(spark.read.parquet(path), now, 3, left)
    return spark.read.parquet(left).select("id", "key")


@query
def region_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the outlines of regions of more than three pixels enclose, how long they are, and the box around them."""
    mask, w, n = _mask(spark, sf_dir)
    made = outlines.outlines(mask, w, n, above=3, tile=64)
    return made.where(F.col("wkt").startswith("MULTILINESTRING")).drop("wkt", "rings")
