"""Outlines: rings close, their areas are pixel counts, simplification keeps within its tolerance."""

from __future__ import annotations

import re

import numpy as np
import pytest

from landcube.operators import components, outlines


def frame(spark, x):
    return spark.createDataFrame([(int(r), int(c)) for r, c in np.argwhere(x)], "r int, c int")


def test_rings_of_shapes():
    def rings(x):
        sides = outlines._sides(np.array(x, bool), None)
        r, c = np.nonzero(sides)
        return outlines.rings_of(r, c, sides[r, c] - 16)

    [one] = rings([[1]])
    assert one.tolist() == [[0, 0], [0, 1], [1, 1], [1, 0]] and outlines.signed_area(one) == 1 and outlines.length(one) == 4
    assert sorted(outlines.signed_area(x) for x in rings([[1, 1, 1], [1, 0, 1], [1, 1, 1]])) == [-1, 9]
    [diagonal] = rings([[1, 0], [0, 1]])  # two pixels that touch at a corner are one ring
    assert outlines.signed_area(diagonal) == 2 and outlines.length(diagonal) == 8
    [other] = rings([[0, 1], [1, 0]])
    assert outlines.signed_area(other) == 2
    assert sorted(outlines.signed_area(x) for x in rings([[0, 1, 0], [1, 0, 1], [0, 1, 0]])) == [-1, 5]


@pytest.mark.parametrize("tile", [5, 512])
def test_areas_are_pixel_counts(spark, tile):
    x = np.random.default_rng(3).random((23, 27)) < 0.5
    sizes = {r["region"]: r["pixels"] for r in components.sizes(components.regions(frame(spark, x), 27)).collect()}
    made = outlines.outlines(frame(spark, x), 27, x.size, above=3, part=0.0, tile=tile).collect()
    assert {r["region"]: r["area"] for r in made} == {k: n for k, n in sizes.items() if n > 3}
    for r in made:
        lines = [[tuple(map(int, p.split())) for p in line.split(", ")] for line in re.findall(r"\(([^()]+)\)", r["wkt"])]
        assert len(lines) == r["rings"] and all(line[0] == line[-1] for line in lines)
        assert sum(abs(a[0] - b[0]) + abs(a[1] - b[1]) for line in lines for a, b in zip(line, line[1:], strict=False)) == r["perimeter"]


def test_simplified_rings_stay_near():
    y, x = np.indices((60, 60))
    disc = (y - 30) ** 2 + (x - 30) ** 2 < 24**2
    sides = outlines._sides(disc, None)
    r, c = np.nonzero(sides > 16)
    [ring] = outlines.rings_of(r, c, sides[r, c] - 16)
    few = outlines.simplified(ring, 1.0)
    assert 4 < len(few) < len(ring) / 3 and abs(outlines.signed_area(few) - disc.sum()) < 0.05 * disc.sum()
    for p in ring:  # every corner is near one of the kept lines
        a, b = few.astype(float), np.roll(few, -1, axis=0).astype(float)
        t = np.clip(((p - a) * (b - a)).sum(1) / ((b - a) ** 2).sum(1), 0, 1)
        assert np.hypot(*(a + t[:, None] * (b - a) - p).T).min() <= 1.0 + 1e-9
    assert len(outlines.simplified(ring, 0)) == len(ring)


def test_no_regions(spark):
    assert outlines.outlines(frame(spark, np.zeros((4, 4), bool)), 4, 16).count() == 0
