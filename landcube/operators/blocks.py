"""Dense blocks of tiles: all years and channels of a tile's pixels as one binary row, for models that want whole arrays.

A block is an array (year, channel, row, column) of one size for all tiles; where a tile reaches beyond the image, or a cell is
missing or null, it holds zeros. Cutting back to cells leaves out what lies beyond the image.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landcube.sources.rasterfiles import ENCODERS

BLOCK = "tile_row long, tile_col long, years array<int>, channels array<string>, tile int, data binary"
_KINDS = pa.schema([("tile_row", pa.int64()), ("tile_col", pa.int64()), ("years", pa.list_(pa.int32())), ("channels", pa.list_(pa.string())), ("tile", pa.int32()), ("data", pa.binary())])


def block_row(tile_row: int, tile_col: int, years: list[int], channels: list[str], x: np.ndarray) -> dict:
    return {"tile_row": tile_row, "tile_col": tile_col, "years": years, "channels": channels, "tile": x.shape[-1], "data": np.ascontiguousarray(x, "<f8").tobytes()}


def array_of(row: dict) -> np.ndarray:
    """(year, channel, row, column) of a block's row."""
    return np.frombuffer(row["data"], "<f8").reshape(len(row["years"]), len(row["channels"]), row["tile"], row["tile"])


def to_blocks(cells: DataFrame, years: list[int], channels: list[str], tile: int = 512) -> DataFrame:
    """Cells (yr, r, c and the channels' columns) as blocks, of tiles with at least one cell: one shuffle by tile.

    Of cells that share year and place one is taken, that with the largest values.
    """
    own = cells.where(F.col("yr").isin(*years) & (F.col("r") >= 0) & (F.col("c") >= 0))
    at = {"tile_row": F.floor(F.col("r") / tile).cast("long"), "tile_col": F.floor(F.col("c") / tile).cast("long")}
    named = own.select(*[v.alias(k) for k, v in at.items()], F.col("yr").cast("int").alias("yr"), F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), *[F.coalesce(F.col(x).cast("double"), F.lit(0.0)).alias(f"v{i}") for i, x in enumerate(channels)])
    order = {y: i for i, y in enumerate(years)}

    def made(key: tuple, group: pa.Table) -> pa.Table:
        x = np.zeros((len(years), len(channels), tile, tile))
        group = group.sort_by([(f"v{i}", "ascending") for i in range(len(channels))])
        k = np.array([order[y] for y in group["yr"].to_pylist()])
        r, c = group["r"].to_numpy() % tile, group["c"].to_numpy() % tile
        for i in range(len(channels)):
            x[k, i, r, c] = group[f"v{i}"].to_numpy()
        return pa.Table.from_pylist([block_row(key[0].as_py(), key[1].as_py(), years, channels, x)], _KINDS)

    return named.groupBy("tile_row", "tile_col").applyInArrow(made, BLOCK)


def mapped(blocks: DataFrame, load: Callable[[], Callable[[np.ndarray], np.ndarray]], years: list[int], channels: list[str]) -> DataFrame:
    """Blocks of what a model makes of each block's array; ``load`` runs once for each task and gives the model.

    The model gets a whole tile, (year, channel, row, column), and returns one of ``years`` and ``channels`` of that tile.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for batch in batches:
            for row in batch.to_pylist():
                x = np.asarray(model(array_of(row)), np.float64).reshape(len(years), len(channels), row["tile"], row["tile"])
                yield pa.RecordBatch.from_pylist([block_row(row["tile_row"], row["tile_col"], years, channels, x)], _KINDS)

    return blocks.mapInArrow(run, BLOCK)


def to_cells(blocks: DataFrame, columns: int, pixels: int, channels: list[str]) -> DataFrame:
    """yr, r, c and the channels of every pixel of the image that lies in a block; ``channels`` names the blocks' own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x, r0, c0 = array_of(row), row["tile_row"] * row["tile"], row["tile_col"] * row["tile"]
                x = x[:, :, : max(0, -(-pixels // columns) - r0), : max(0, columns - c0)]
                r, c = (i.ravel() for i in np.indices(x.shape[2:]))
                inside = (r + r0) * columns + c + c0 < pixels
                for year, own in zip(row["years"], x, strict=True):
                    n = int(inside.sum())
                    values = [pa.array(v.ravel()[inside]) for v in own]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, year, np.int32)), pa.array((r + r0)[inside]), pa.array((c + c0)[inside]), *values], names=["yr", "r", "c", *channels])

    return blocks.mapInArrow(run, "yr int, r long, c long, " + ", ".join(f"`{x}` double" for x in channels))


def encoded(blocks: DataFrame, form: str = "npy", dtype: str = "<f8", prefix: str = "tile") -> DataFrame:
    """name and content of a raster file for each block and year: ``{prefix}_{year}_{row}_{column}.{form}`` (npy, tif or png)."""
    encode = ENCODERS[form]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                made = [(f"{prefix}_{y}_{row['tile_row']}_{row['tile_col']}.{form}", encode(x.astype(dtype))) for y, x in zip(row["years"], array_of(row), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in made]), pa.array([d for _, d in made], pa.binary())], names=["name", "content"])

    return blocks.mapInArrow(run, "name string, content binary")
