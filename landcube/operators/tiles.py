"""Tiles, grids, mosaics and resampling by arithmetic on the pixel's position."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def assign_tiles(cells: DataFrame, tile: int, rows: int, columns: int, overlap: int = 0) -> DataFrame:
    """Whole tiles only, each pixel once for every tile that holds it: tile_row, tile_col."""
    stride = tile - overlap
    high, wide = (rows - tile) // stride, (columns - tile) // stride

    def homes(x: str, most: int) -> Column:
        low = F.greatest(F.lit(0), F.floor((F.col(x) - tile) / stride) + 1)
        last = F.least(F.lit(most), F.floor(F.col(x) / stride))
        return F.when(low <= last, F.sequence(low.cast("int"), last.cast("int"))).otherwise(F.array().cast("array<int>"))

    if high < 0 or wide < 0:
        return cells.limit(0).withColumns({"tile_row": F.lit(0), "tile_col": F.lit(0)})
    return cells.withColumn("tile_row", F.explode(homes("r", high))).withColumn("tile_col", F.explode(homes("c", wide)))


def inference_tiles(cells: DataFrame, tile: int) -> DataFrame:
    """Every pixel in one tile; partial tiles stay, what lies outside is nothing to compute."""
    return cells.withColumns({"tile_row": F.floor(F.col("r") / tile).cast("int"), "tile_col": F.floor(F.col("c") / tile).cast("int")})


def split_box(boxes: DataFrame, g: int) -> DataFrame:
    """Each box (west, south, east, north) as g x g boxes; row 0 is the southernmost."""
    steps = boxes.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(g - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(g - 1))))
    high, wide = (F.col("north") - F.col("south")) / g, (F.col("east") - F.col("west")) / g
    made = {"tile_west": F.col("west") + F.col("j") * wide, "tile_south": F.col("south") + F.col("i") * high, "tile_east": F.col("west") + (F.col("j") + 1) * wide, "tile_north": F.col("south") + (F.col("i") + 1) * high}
    return steps.withColumns({k: F.round(v, 6) for k, v in made.items()})


def mosaic(cells: DataFrame, height: int, width: int) -> DataFrame:
    """Positions in the whole of tiles' pixels; tile row 0 is drawn at the top."""
    return cells.withColumns({"mosaic_r": F.col("tile_row") * height + F.col("r"), "mosaic_c": F.col("tile_col") * width + F.col("c")})


def shrink(cells: DataFrame, value: str, factor: int) -> DataFrame:
    """Mean over blocks of ``factor`` x ``factor`` pixels."""
    return cells.groupBy(F.floor(F.col("r") / factor).alias("r"), F.floor(F.col("c") / factor).alias("c")).agg(F.avg(value).alias(value))


def bilinear_double(cells: DataFrame, value: str, rows: int, columns: int) -> DataFrame:
    """Twice the resolution, (r, c, value); pixels that are missing leave their weight to the others.

    Each source pixel sends itself, weighted, to the target pixels it touches, edges clamped; so one grouping does it.
    """
    near = []  # a target 2a + k lies between source pixels; k 0 leans on the one before, k 1 on the one after
    for x, most in (("r", rows), ("c", columns)):
        at = F.col(x)
        own = [(2 * at, 0.75), (2 * at + 1, 0.75), (2 * at - 1, 0.25), (2 * at + 2, 0.25)]
        edge = [(F.when(at == 0, 0), 0.25), (F.when(at == most - 1, 2 * at + 1), 0.25)]
        near.append(_targets(own + edge, 2 * most))
    spread = cells.where(F.col(value).isNotNull()).select(F.explode(near[0]).alias("y"), "c", value).select("y", F.explode(near[1]).alias("x"), value)
    w = F.col("y.w") * F.col("x.w")
    summed = spread.groupBy(F.col("y.p").alias("r"), F.col("x.p").alias("c")).agg(F.sum(w * F.col(value)).alias("s"), F.sum(w).alias("w"))
    return summed.select("r", "c", (F.col("s") / F.col("w")).alias(value))


def _targets(places: list, end: int) -> Column:
    made = F.array(*[F.struct(p.cast("int").alias("p"), F.lit(w).alias("w")) for p, w in places])
    return F.filter(made, lambda s: s["p"].isNotNull() & (s["p"] >= 0) & (s["p"] < end))


def _weights(first: int, n: int, scale: float, shift: float, count: int, method: str) -> tuple[int, np.ndarray]:
    """The first source position, and the weight of each source position for ``n`` targets from ``first`` on."""
    at = first + np.arange(n)
    if method == "area":
        low, high = at * scale + shift, (at + 1) * scale + shift
        begin, end = max(0, int(np.floor(low[0]))), min(count, int(np.ceil(high[-1])))
        k = np.arange(begin, max(begin, end))
        return begin, np.clip(np.minimum(high[:, None], k + 1) - np.maximum(low[:, None], k), 0, None)
    y = (at + 0.5) * scale + shift - 0.5
    near = np.floor(y).astype(np.int64)
    pair = np.clip(np.stack([near, near + 1]), 0, count - 1)
    begin = int(pair.min())
    out = np.zeros((n, int(pair.max()) - begin + 1))
    for p, w in zip(pair, (1 - (y - near), y - near), strict=True):
        np.add.at(out, (np.arange(n), p - begin), w)
    return begin, out


def resample(cells: DataFrame, value: str, source: tuple[int, int], target: tuple[int, int], scale: tuple[float, float], shift: tuple[float, float] = (0.0, 0.0), method: str = "bilinear", tile: int = 512) -> DataFrame:
    """(r, c, value) of a target grid, by looking up each target pixel's place in the source: r * scale + shift, in pixels.

    ``bilinear`` weights the four source pixels around the target's centre, edges clamped; ``area`` all that the target
    covers, by the part covered. Missing pixels leave their weight to the others, and a target without any is left out.
    ``source`` and ``target`` are (rows, columns). A source pixel goes to the target tiles that look it up, in one shuffle,
    and a task makes one tile; tiles are smaller where a target pixel covers many source pixels, so that its window isn't
    larger.
    """
    if min(*source, *target) <= 0:
        return cells.limit(0).select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.col(value).cast("double").alias(value))
    sizes = [max(1, int(tile / max(1.0, s))) for s in scale]
    reach = 1.0 if method == "bilinear" else 0.5

    def homes(x: str, k: int) -> Column:
        at, s, o, n, m = F.col(x) + 0.5, scale[k], shift[k], target[k], source[k]
        # targets whose centres lie within ``reach`` and half a target pixel, and one more on each side against rounding
        low, high = F.floor((at - reach - o) / s) - 2, F.ceil((at + reach - o) / s) + 2
        if method == "bilinear":
            low, high = F.when(F.col(x) == 0, F.lit(0)).otherwise(low), F.when(F.col(x) == m - 1, F.lit(n - 1)).otherwise(high)
        low, high = F.greatest(low, F.lit(0)).cast("long"), F.least(high, F.lit(n - 1)).cast("long")
        tiles = F.sequence(F.floor(low / sizes[k]), F.floor(F.greatest(low, high) / sizes[k]))
        return F.when((low <= high) & (low < n), tiles).otherwise(F.array().cast("array<long>"))

    there = F.col(value).isNotNull() & F.col("r").between(0, source[0] - 1) & F.col("c").between(0, source[1] - 1)
    own = cells.where(there).select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.col(value).cast("double").alias("v"))
    sent = own.select("r", "c", "v", F.explode(homes("r", 0)).alias("tr")).select("r", "c", "v", "tr", F.explode(homes("c", 1)).alias("tc"))

    def made(key: tuple, group: pa.Table) -> pa.Table:
        first = [key[k].as_py() * sizes[k] for k in (0, 1)]
        (r0, down), (c0, across) = (_weights(first[k], min(sizes[k], target[k] - first[k]), scale[k], shift[k], source[k], method) for k in (0, 1))
        r, c, v = (group[x].to_numpy() for x in ("r", "c", "v"))
        inside = (r >= r0) & (r < r0 + down.shape[1]) & (c >= c0) & (c < c0 + across.shape[1])
        x, known = np.zeros((2, down.shape[1], across.shape[1]))
        x[r[inside] - r0, c[inside] - c0], known[r[inside] - r0, c[inside] - c0] = v[inside], 1.0
        weight = down @ known @ across.T
        i, j = np.nonzero(weight > 1e-9)
        return pa.table({"r": pa.array(i + first[0], pa.int64()), "c": pa.array(j + first[1], pa.int64()), value: pa.array((down @ x @ across.T)[i, j] / weight[i, j])})

    return sent.groupBy("tr", "tc").applyInArrow(made, f"r long, c long, `{value}` double")
