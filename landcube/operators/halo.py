"""Neighbourhood operators by halo exchange: every tile gets its own pixels and a border as wide as a chain of windows needs.

A :class:`Chain` is a step, or several one after another, on a dense boolean array, with the rows and columns that it looks up,
down, left and right. :func:`through` sends each pixel of a sparse mask to the tiles that its reach meets, which is its own
tile but for pixels near a border, in one shuffle; a task then holds one tile, whatever the size of the windows, runs the
whole chain in numpy, and gives the pixels of its own tile. Tiles that no pixel reaches are never made.

Pixels outside the image are ignored, as by a window that the edge cuts off; an even window of size k reaches from -(k // 2) to
k - k // 2 - 1. The blur mirrors at the edges of the image's rectangle without repeating them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE = 512
# One row of the 5 x 5 blur, in sixteenths.
BLUR = (1, 4, 6, 4, 1)


@dataclass(frozen=True)
class Place:
    """Where an array lies: its first row and column in an image of ``columns`` and ``pixels``, whose last row may be partial."""

    row: int
    column: int
    columns: int
    pixels: int

    @property
    def rows(self) -> int:
        return -(-self.pixels // self.columns)

    def inside(self, shape: tuple[int, int]) -> np.ndarray:
        r, c = self.row + np.arange(shape[0])[:, None], self.column + np.arange(shape[1])[None, :]
        return (r >= 0) & (c >= 0) & (c < self.columns) & (r * self.columns + c < self.pixels)


@dataclass(frozen=True)
class Chain:
    """``run(array, place)`` gives an array of the same shape, right wherever ``reach`` (up, down, left, right) lies within it."""

    reach: tuple[int, int, int, int]
    run: Callable[[np.ndarray, Place], np.ndarray]

    def then(self, other: Chain) -> Chain:
        return Chain(tuple(a + b for a, b in zip(self.reach, other.reach, strict=True)), lambda x, at: other.run(self.run(x, at), at))

    def either(self, other: Chain) -> Chain:
        return Chain(tuple(max(a, b) for a, b in zip(self.reach, other.reach, strict=True)), lambda x, at: self.run(x, at) | other.run(x, at))

    def added(self) -> Chain:
        """Only what is not set before."""
        return Chain(self.reach, lambda x, at: self.run(x, at) & ~x)


def _window_sums(x: np.ndarray, before: int, after: int, axis: int) -> np.ndarray:
    """Sums over x[i - before .. i + after] along an axis, by one running sum, whatever the window; beyond the ends is nothing."""
    n = x.shape[axis]
    sums = np.concatenate([np.zeros_like(x.take([0], axis), dtype=np.int32), np.cumsum(x, axis, dtype=np.int32)], axis)
    high, low = np.minimum(np.arange(n) + after + 1, n), np.maximum(np.arange(n) - before, 0)
    return sums.take(high, axis) - sums.take(low, axis)


def _reach(height: int, width: int) -> tuple[int, int, int, int]:
    return height // 2, height - height // 2 - 1, width // 2, width - width // 2 - 1


def dilate(height: int, width: int | None = None) -> Chain:
    """Pixels of the image whose window has a set pixel."""
    up, down, left, right = reach = _reach(height, width or height)
    return Chain(reach, lambda x, at: (_window_sums(_window_sums(x, up, down, 0), left, right, 1) > 0) & at.inside(x.shape))


def erode(height: int, width: int | None = None) -> Chain:
    """Pixels whose window, as far as it lies in the image, is all set."""
    up, down, left, right = reach = _reach(height, width or height)

    def run(x: np.ndarray, at: Place) -> np.ndarray:
        image = at.inside(x.shape)
        return (_window_sums(_window_sums(~x & image, up, down, 0), left, right, 1) == 0) & image

    return Chain(reach, run)


def close(height: int, width: int | None = None) -> Chain:
    return dilate(height, width).then(erode(height, width))


def opened(height: int, width: int | None = None) -> Chain:
    return erode(height, width).then(dilate(height, width))


def border(size: int = 4) -> Chain:
    """What a dilation adds."""
    return dilate(size).added()


def thin_lines(length: int = 13) -> Chain:
    """Long thin parts: opened along rows or along columns, then closed."""
    return opened(1, length).either(opened(length, 1)).then(close(3))


def blurred(x: np.ndarray, at: Place) -> np.ndarray:
    """The 5 x 5 binomial blur of a boolean array in 256ths."""
    out = x.astype(np.int32)
    for axis, first, n in ((0, at.row, at.rows), (1, at.column, at.columns)):
        sums = np.zeros_like(out)
        place = first + np.arange(out.shape[axis])
        for d, weight in zip(range(-2, 3), BLUR, strict=True):
            source = place + d
            source = np.where(source < 0, -source, np.where(source >= n, 2 * (n - 1) - source, source))
            # what no mirror image reaches, and what lies beyond the array, is nothing
            there = (source >= 0) & (source < n) & (source - first >= 0) & (source - first < out.shape[axis])
            moved = out.take(np.clip(source - first, 0, out.shape[axis] - 1), axis) * weight
            sums += moved * (there[:, None] if axis == 0 else there[None, :])
        out = sums
    return out


BLURRED = Chain((2, 2, 2, 2), blurred)


def softened(threshold: float = 0.4) -> Chain:
    """The blur, cut at a threshold, within the image."""
    return Chain((2, 2, 2, 2), lambda x, at: (blurred(x, at) > threshold * 256) & at.inside(x.shape))


def smooth(threshold: float = 0.4) -> Chain:
    """Close 5 x 5, blur, and keep what is above the threshold."""
    return close(5).then(softened(threshold))


def cells(x: np.ndarray, at: Place) -> pa.Table:
    """r, c and, for numbers, v in 256ths of the pixels that are set."""
    r, c = np.nonzero(x)
    columns = {"r": pa.array(at.row + r, pa.int64()), "c": pa.array(at.column + c, pa.int64())}
    return pa.table(columns if x.dtype == bool else columns | {"v": pa.array(x[r, c] / 256.0, pa.float64())})


def _homes(at: Column, tile: int, before: int, after: int, tiles: int) -> Column:
    """The tiles that see a position: those whose own pixels look ``before`` it and ``after`` it."""
    return F.sequence(F.greatest(F.lit(0).cast("long"), F.floor((at - after) / tile)), F.least(F.lit(tiles - 1).cast("long"), F.floor((at + before) / tile)))


def through(mask: DataFrame, columns: int, pixels: int, chain: Chain, tile: int = TILE, finish: Callable[[np.ndarray, Place], pa.Table] = cells, schema: str = "r long, c long") -> DataFrame:
    """What ``finish`` makes of each tile's own part of the chain's result. Mask pixels outside the image don't count."""
    if columns <= 0 or pixels <= 0:
        return mask.sparkSession.createDataFrame([], schema)
    up, down, left, right = chain.reach
    high, wide = -(-(-(-pixels // columns)) // tile), -(-columns // tile)
    r, c = F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c")
    there = (F.col("r") >= 0) & (F.col("c") >= 0) & (F.col("c") < columns) & (F.col("r") * columns + F.col("c") < pixels)
    own = mask.select(r, c).where(there)
    # a tile sees up to ``down`` rows below it, so a pixel is seen by tiles above it at that distance
    sent = own.select(F.explode(_homes(F.col("r"), tile, up, down, high)).alias("tr"), "r", "c").select("tr", F.explode(_homes(F.col("c"), tile, left, right, wide)).alias("tc"), "r", "c")

    def made(key: tuple, group: pa.Table) -> pa.Table:
        row, column = key[0].as_py() * tile, key[1].as_py() * tile
        shape = min(tile, -(-pixels // columns) - row), min(tile, columns - column)
        x = np.zeros((shape[0] + up + down, shape[1] + left + right), bool)
        x[group["r"].to_numpy() - row + up, group["c"].to_numpy() - column + left] = True
        x = chain.run(x, Place(row - up, column - left, columns, pixels))
        return finish(x[up : up + shape[0], left : left + shape[1]], Place(row, column, columns, pixels))

    return sent.groupBy("tr", "tc").applyInArrow(made, schema)
