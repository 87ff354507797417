"""Fixed dimensions: land-cover classes, change classes, model-class maps. All of them are a few rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values.
LAND_COVER = {0: "background", 1: "urban_built", 2: "vegetation", 3: "water", 4: "bare_soil", 5: "road"}
CHANGES = {
    "deforestation": ([2], [1, 4, 5], [255, 0, 0], "Deforestation"),
    "construction": ([2, 4], [1], [0, 0, 255], "New Construction"),
    "new_roads": ([2, 4], [5], [255, 255, 0], "New Roads"),
    "water_loss": ([3], [1, 2, 4], [128, 0, 128], "Water Bodies Drying"),
    "vegetation_gain": ([4], [2], [0, 255, 0], "Vegetation Increase"),
}
BATCH_CLASSES = {1: [1, 2, 3, 4, 25, 48], 2: [4, 5, 9, 17, 18], 3: [21, 26, 27], 4: [13, 28, 46], 5: [6, 11, 52]}
STREAM_CLASSES = {3: 1, 9: 2, 13: 2, 11: 3, 17: 5, 0: 0}
GREY = [128, 128, 128]
#: name, country, west, south, east, north, latitude and longitude of the centre
CITIES = {
    "bangalore": ("Bangalore", "India", 77.3700, 12.7340, 77.8800, 13.1730, 12.9716, 77.5946),
    "delhi": ("Delhi", "India", 76.8389, 28.4041, 77.3465, 28.8833, 28.7041, 77.1025),
    "mumbai": ("Mumbai", "India", 72.7757, 18.8942, 72.9781, 19.2695, 19.0760, 72.8777),
    "hyderabad": ("Hyderabad", "India", 78.2543, 17.2403, 78.6530, 17.5640, 17.3850, 78.4867),
}


def change_classes(spark: SparkSession) -> DataFrame:
    rows = [(k, f, t, c, n) for k, (f, t, c, n) in CHANGES.items()]
    return spark.createDataFrame(rows, "change_type string, from array<int>, to array<int>, color array<int>, name string")


def change_pairs(spark: SparkSession) -> DataFrame:
    """change_type for each (before, after) class pair: the form that joins by equality."""
    rows = [(k, a, b) for k, (f, t, _, _) in CHANGES.items() for a in f for b in t]
    return spark.createDataFrame(rows, "change_type string, cls_before int, cls_after int")


def cities(spark: SparkSession) -> DataFrame:
    rows = [(k, *v) for k, v in CITIES.items()]
    return spark.createDataFrame(rows, "city string, name string, country string, west double, south double, east double, north double, lat double, lon double")


def land_cover(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LAND_COVER.items()), "cls int, cover string")
