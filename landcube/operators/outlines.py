"""Outlines of regions as polygons: edges between set and other pixels, chained to rings and simplified; only the geometry.

Edges are found tile by tile after a halo exchange of one pixel, and only pixels that have one are joined with their regions. A
task then holds the edges of one region, which is what the region's polygon is made of.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from landcube.operators import components, halo
from landcube.operators.halo import Chain, Place

OUTLINES = "region long, rings int, area double, perimeter long, west long, north long, east long, south long, wkt string"


def _sides(x: np.ndarray, at: Place) -> np.ndarray:
    """For set pixels, 16 and a bit for each side (1 top, 2 right, 4 bottom, 8 left) whose neighbour isn't set."""
    wide = np.pad(x, 1)
    beside = [wide[:-2, 1:-1], wide[1:-1, 2:], wide[2:, 1:-1], wide[1:-1, :-2]]
    return np.where(x, 16 + sum((~b).astype(np.int32) << i for i, b in enumerate(beside)), 0)


def _edges(x: np.ndarray, at: Place) -> pa.Table:
    r, c = np.nonzero(x > 16)
    return pa.table({"r": pa.array(r + at.row, pa.int64()), "c": pa.array(c + at.column, pa.int64()), "sides": pa.array(x[r, c] - 16, pa.int32())})


def rings_of(r: np.ndarray, c: np.ndarray, sides: np.ndarray) -> list[np.ndarray]:
    """Closed rings of corners (row, column), without the last point, the region always on the right hand.

    Pixels that touch at a corner belong together: where two edges go on, the one that turns left is taken.
    """
    starts: dict[tuple, list] = {}
    # a side's first corner and the step along it, from the pixel's top left corner
    for bit, (i, j), (di, dj) in ((1, (0, 0), (0, 1)), (2, (0, 1), (1, 0)), (4, (1, 1), (0, -1)), (8, (1, 0), (-1, 0))):
        own = (sides & bit) > 0
        for y, x in zip((r[own] + i).tolist(), (c[own] + j).tolist(), strict=True):
            starts.setdefault((y, x), []).append((di, dj))
    rings = []
    while starts:
        at = first = min(starts)
        step, ring = None, []
        while True:
            ways = starts[at]
            if step is None or len(ways) == 1:
                way = ways[0]
            else:
                way = next(w for w in ways if w == (-step[1], step[0]))
            ways.remove(way)
            if not ways:
                del starts[at]
            if way != step:
                ring.append(at)
            at, step = (at[0] + way[0], at[1] + way[1]), way
            # a ring closes where it began, unless it only passes by a corner there
            if at == first and (at not in starts or (-step[1], step[0]) not in starts[at]):
                break
        rings.append(np.array(ring))
    return rings


def signed_area(ring: np.ndarray) -> float:
    """Above 0 for an outer ring, below 0 for a hole, in pixels."""
    y, x = ring[:, 0].astype(float), ring[:, 1].astype(float)
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def length(ring: np.ndarray) -> int:
    return int(np.abs(ring - np.roll(ring, -1, axis=0)).sum())


def simplified(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """The corners that the farthest-point rule keeps: what lies within ``tolerance`` of the line between two kept ones goes."""
    if len(ring) < 4 or tolerance <= 0:
        return ring
    points = np.vstack([ring, ring[:1]]).astype(float)
    far = int(((points - points[0]) ** 2).sum(1).argmax())
    keep = np.zeros(len(points), bool)
    keep[[0, far, -1]] = True
    todo = [(0, far), (far, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        line, own = points[b] - points[a], points[a + 1 : b] - points[a]
        size = np.hypot(*line)
        away = np.abs(line[0] * own[:, 1] - line[1] * own[:, 0]) / size if size else np.hypot(own[:, 0], own[:, 1])
        k = int(away.argmax())
        if away[k] > tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return ring[keep[:-1]]


def _wkt(rings: list[np.ndarray]) -> str:
    """Each outer ring with the holes in it would need a search; an outline's rings are given as lines, outer ones first."""
    return "MULTILINESTRING(" + ", ".join("(" + ", ".join(f"{x} {y}" for y, x in [*ring.tolist(), ring[0].tolist()]) + ")" for ring in rings) + ")"


def outlines(mask: DataFrame, columns: int, pixels: int, above: int = 50, part: float = 0.008, tile: int = halo.TILE) -> DataFrame:
    """A row for each region of more than ``above`` pixels: its rings as WKT (columns and rows of pixel corners, closed),
    simplified to ``part`` of each ring's length, and what the rings say before that: how many they are, the area that they
    enclose (which is the number of pixels), their length, and the box around them.
    """
    found = components.large_regions(components.regions(mask, columns, tile, pixels=pixels), above)
    edges = halo.through(mask, columns, pixels, Chain((1, 1, 1, 1), _sides), tile, _edges, "r long, c long, sides int")

    def made(group: pd.DataFrame) -> pd.DataFrame:
        rings = sorted(rings_of(*(group[x].to_numpy() for x in ("r", "c", "sides"))), key=lambda x: -signed_area(x))
        every = np.concatenate(rings)
        (north, west), (south, east) = every.min(0).tolist(), every.max(0).tolist()
        lines = [simplified(x, part * length(x)) for x in rings]
        row = (int(group["region"].iloc[0]), len(rings), sum(map(signed_area, rings)), sum(map(length, rings)), west, north, east, south, _wkt(lines))
        return pd.DataFrame([row], columns=[x.split()[0] for x in OUTLINES.split(", ")])

    return edges.join(found, ["r", "c"]).groupBy("region").applyInPandas(made, OUTLINES)

