"""Neighbourhood operators, regions and holes over several tiles, against plain numpy over the whole image."""

from __future__ import annotations

from collections import deque

import numpy as np
import pytest

from landcube.operators import components, halo, morphology


def frame(spark, x):
    return spark.createDataFrame([(int(r), int(c)) for r, c in np.argwhere(x)], "r int, c int")


def cells(df):
    return {(r["r"], r["c"]) for r in df.collect()}


def pairs(x):
    return {(int(r), int(c)) for r, c in np.argwhere(x)}


def windows(x, image, height, width, every):
    """Whether any, or every, pixel of the image within the window of each pixel is set."""
    out = np.zeros_like(x)
    for r, c in np.argwhere(image):
        rows, columns = slice(max(0, r - height // 2), r + height - height // 2), slice(max(0, c - width // 2), c + width - width // 2)
        own, there = x[rows, columns], image[rows, columns]
        out[r, c] = (own | ~there).all() if every else (own & there).any()
    return out


def a_mask(seed, rows, columns, pixels, share):
    image = np.arange(rows * columns).reshape(rows, columns) < pixels
    return (np.random.default_rng(seed).random((rows, columns)) < share) & image, image


@pytest.mark.parametrize("height, width", [(13, 13), (15, 15), (1, 13), (4, 4), (2, 5)])
@pytest.mark.parametrize("tile", [7, 512])
def test_close_and_open(spark, height, width, tile):
    x, image = a_mask(height, 33, 29, 33 * 29 - 11, 0.1)
    m = frame(spark, x)
    closed = windows(windows(x, image, height, width, False), image, height, width, True)
    assert cells(morphology.close(m, 29, image.sum(), height, width, tile)) == pairs(closed)
    full = x | (np.indices(x.shape)[0] % 9 < 6) & image
    opened = windows(windows(full, image, height, width, True), image, height, width, False)
    assert cells(morphology.opened(frame(spark, full), 29, image.sum(), height, width, tile)) == pairs(opened)


@pytest.mark.parametrize("tile", [3, 8, 512])
def test_smooth_chain(spark, tile):
    x, image = a_mask(3, 26, 31, 26 * 31 - 7, 0.25)
    closed = windows(windows(x, image, 5, 5, False), image, 5, 5, True)
    mirrored = np.pad(closed.astype(float), 2, mode="reflect")
    k = np.array([1, 4, 6, 4, 1]) / 16
    soft = sum(k[i] * k[j] * mirrored[i : i + 26, j : j + 31] for i in range(5) for j in range(5))
    assert cells(morphology.smooth(frame(spark, x), 31, image.sum(), 0.4, tile)) == pairs((soft > 0.4) & image)
    assert cells(morphology.border(frame(spark, x), 31, image.sum(), 4, tile)) == pairs(windows(x, image, 4, 4, False) & ~x)


def test_one_exchange_for_the_chain(spark):
    plan = morphology.smooth(spark.range(40).selectExpr("cast(id as int) r", "cast(id * 7 % 50 as int) c"), 50, 2500)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1, plan


def test_masks_of_no_pixels_and_no_image(spark):
    none = spark.createDataFrame([], "r int, c int")
    assert cells(morphology.smooth(none, 9, 81)) == set()
    assert cells(morphology.smooth(none, 0, 0)) == set()
    outside = spark.createDataFrame([(-1, 0), (0, 9), (9, 0), (4, 4), (4, 4)], "r int, c int")
    assert cells(morphology.dilate(outside, 9, 81, 1)) == {(4, 4)}
    assert components.fill_holes(none, 9, 9).count() == 0 and components.regions(none, 9).count() == 0


def flood(x, start, steps):
    """Pixels of x's value that are connected to ``start``."""
    seen, todo = {start}, deque([start])
    while todo:
        r, c = todo.popleft()
        for i, j in ((i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and (steps == 8 or i * j == 0)):
            p = (r + i, c + j)
            if 0 <= p[0] < x.shape[0] and 0 <= p[1] < x.shape[1] and p not in seen and x[p] == x[start]:
                seen.add(p)
                todo.append(p)
    return seen


def filled(x):
    outside = set() if x[0, 0] else flood(x, (0, 0), 4)
    return {p for p in np.ndindex(x.shape) if p not in outside}


def ring(rows, columns, r, c, radius):
    """A diamond: its pixels touch at corners only."""
    y, x = np.indices((rows, columns))
    return np.abs(y - r) + np.abs(x - c) == radius


SHAPES = {
    "diamond around one pixel": ring(9, 9, 4, 4, 1), "diamond over tiles": ring(31, 37, 15, 16, 12), "whole tiles within": ring(64, 64, 30, 31, 27), "bands of empty tiles": np.pad(ring(12, 12, 5, 5, 4), ((30, 41), (21, 0))),
    "open at the edge": ring(12, 12, 0, 6, 4), "corner set": np.pad(np.ones((2, 2), bool), ((0, 22), (0, 17))), "far apart": np.pad(ring(9, 9, 4, 4, 2), ((0, 50), (0, 50))) | np.pad(ring(9, 9, 4, 4, 3), ((50, 0), (50, 0))),
    "nested": ring(50, 50, 24, 24, 22) | ring(50, 50, 24, 24, 9), "an arc": ring(40, 40, 20, 20, 17) & (np.indices((40, 40))[0] < 36), "all": np.ones((7, 9), bool), "frame": np.pad(np.zeros((20, 30), bool), 1, constant_values=True),
}


@pytest.mark.parametrize("name", SHAPES)
def test_holes(spark, name):
    x = SHAPES[name]
    for tile in (4, 64):
        made = components.fill_holes(frame(spark, x), *x.shape, tile=tile)
        rows = [(r["r"], r["c"]) for r in made.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == filled(x), (name, tile)


@pytest.mark.parametrize("seed, share", [(1, 0.35), (2, 0.55), (3, 0.05)])
def test_holes_of_random_masks(spark, seed, share):
    x, _ = a_mask(seed, 37, 41, 37 * 41, share)
    assert cells(components.fill_holes(frame(spark, x), *x.shape, tile=5)) == filled(x)


@pytest.mark.parametrize("steps", [4, 8])
def test_regions(spark, steps):
    x, _ = a_mask(8, 30, 34, 30 * 34, 0.45)
    expected, left = {}, pairs(x)
    while left:
        own = flood(x, min(left), steps)
        expected |= {p: min(r * 34 + c for r, c in own) for p in own}
        left -= own
    for tile in (6, 64):
        assert {(r["r"], r["c"]): r["region"] for r in components.regions(frame(spark, x), 34, tile, steps).collect()} == expected


def test_work_follows_the_mask(spark):
    """A small ring in an image of 10 ** 12 pixels."""
    x = np.pad(ring(9, 9, 4, 4, 3), ((700, 0), (90_000, 0)))
    made = components.fill_holes(spark.createDataFrame([(int(r), int(c)) for r, c in np.argwhere(x)], "r long, c long"), 1_000_000, 1_000_000)
    assert made.count() == 2 * 3 * 4 + 1


def test_label_of_runs_is_the_first_pixel():
    x = np.array([[0, 1, 0, 1], [1, 0, 0, 1], [0, 0, 1, 1]], bool)
    table = components._labelled(8)(x, halo.Place(10, 20, 100, 10_000)).to_pydict()
    assert dict(zip(zip(table["r"], table["c"], strict=True), table["label"], strict=True)) == {(10, 21): 1021, (11, 20): 1021, (10, 23): 1023, (11, 23): 1023, (12, 22): 1023, (12, 23): 1023}
