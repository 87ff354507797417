"""Regions and holes of sparse masks: components tile by tile as runs of columns, with labels merged across tile borders."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landcube.operators import halo
from landcube.operators.halo import Chain, Place
from landcube.sources.shared import written

TILE = halo.TILE
ASIS = Chain((0, 0, 0, 0), lambda x, at: x)
#: More rows than any image has, for masks whose height isn't stated.
NO_END = 1 << 62


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of each stretch of set pixels, in reading order."""
    edges = np.diff(np.pad(x.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edges == 1)
    return row, first, np.nonzero(edges == -1)[1] - 1


def joined_runs(row: np.ndarray, first: np.ndarray, last: np.ndarray, steps: int) -> np.ndarray:
    """For each run the first run of its component, by hooking and pointer jumping over all runs at once.

    Runs of neighbouring rows touch if they share a column or, with 8 ``steps``, if their ends are diagonal neighbours.
    """
    root = np.arange(len(row))
    if not len(row):
        return root
    near, wide = (1 if steps == 8 else 0), int(last.max()) + 4
    low = np.searchsorted(row * wide + last + 1, (row - 1) * wide + first + 1 - near)
    count = np.maximum(np.searchsorted(row * wide + first + 1, (row - 1) * wide + last + 1 + near, "right") - low, 0)
    a = np.repeat(root, count)
    b = np.arange(len(a)) + np.repeat(low - (np.cumsum(count) - count), count)
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return root
        least = np.minimum(x, y)
        np.minimum.at(root, x, least)
        np.minimum.at(root, y, least)
        while (root[root] != root).any():
            root = root[root]


def _labelled(steps: int):
    """r, c, label of a tile's set pixels; the label is the smallest pixel number of the component within the tile."""

    def finish(x: np.ndarray, at: Place) -> pa.Table:
        row, first, last = runs(x)
        label = ((row + at.row) * at.columns + first + at.column)[joined_runs(row, first, last, steps)]
        size = last - first + 1
        c = np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)
        return pa.table({"r": pa.array(np.repeat(row, size) + at.row, pa.int64()), "c": pa.array(c + at.column, pa.int64()), "label": pa.array(np.repeat(label, size), pa.int64())})

    return finish


def merged(links: DataFrame) -> DataFrame:
    """label, root: the smallest label that each is linked to, over any number of ``links`` (a, b), given both ways and written.

    Every label takes the smallest of its neighbours' roots, and that root's root, until nothing changes.
    """
    labels = written(links.select(F.col("a").alias("label"), F.col("a").alias("root")).distinct(), "labels")
    while True:
        near = links.join(labels, F.col("b") == F.col("label")).groupBy("a").agg(F.min("root").alias("m"))
        step = labels.join(near, F.col("label") == F.col("a")).select("label", F.least("root", "m").alias("root"), F.col("root").alias("was"))
        jump = step.select(F.col("label").alias("at"), F.col("root").alias("further"))
        made = written(step.join(jump, F.col("root") == F.col("at"), "left").select("label", F.least("root", F.coalesce("further", "root")).alias("root"), "was"), "labels")
        if made.where("root <> was").isEmpty():
            return labels
        labels = made.select("label", "root")


def regions(mask: DataFrame, columns: int, tile: int = TILE, steps: int = 8, pixels: int = NO_END, chain: Chain = ASIS) -> DataFrame:
    """r, c, region (the smallest r * columns + c of the component) of each pixel of what ``chain`` makes of the mask.

    One shuffle by tile, with the chain's halo; a task holds one tile, runs the chain and labels its own part. Only pixels on
    tile borders are joined with their neighbours in other tiles, and only labels that they link are merged.
    """
    local = written(halo.through(mask, columns, pixels, chain, tile, _labelled(steps), "r long, c long, label long"), "regions")
    if columns <= tile and -(-pixels // max(1, columns)) <= tile:
        return local.withColumnRenamed("label", "region")
    rim = local.where((F.col("r") % tile).isin(0, tile - 1) | (F.col("c") % tile).isin(0, tile - 1))
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and (steps == 8 or i * j == 0)])
    moved = rim.select("label", F.explode(around).alias("o"), "r", "c").select(F.col("label").alias("a"), (F.col("r") + F.col("o.i")).alias("r"), (F.col("c") + F.col("o.j")).alias("c"))
    links = written(moved.join(rim.select("r", "c", F.col("label").alias("b")), ["r", "c"]).where("a <> b").select("a", "b").distinct(), "links")
    if links.isEmpty():
        return local.withColumnRenamed("label", "region")
    return local.join(merged(links), "label", "left").select("r", "c", F.coalesce("root", "label").alias("region"))


def sizes(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("region").agg(F.count("*").alias("pixels"))


def large_regions(labelled: DataFrame, above: int) -> DataFrame:
    """Pixels of regions with more than ``above`` pixels."""
    return labelled.join(sizes(labelled).where(F.col("pixels") > above).select("region"), "region", "left_semi")


def solid_regions(mask: DataFrame, columns: int, pixels: int, size: int = 15, least: int = 500, tile: int = TILE) -> DataFrame:
    """Gaps closed by a window of ``size``, holes filled, and regions of at least ``least`` pixels kept: r, c, region."""
    closed = written(halo.through(mask, columns, pixels, halo.close(size), tile), "closed")
    whole = fill_holes(closed, -(-pixels // columns), columns, tile)
    return large_regions(regions(whole, columns, tile, pixels=pixels), least - 1)


def roads(mask: DataFrame, columns: int, pixels: int, length: int = 13, least: int = 180, tile: int = TILE) -> DataFrame:
    """Long thin parts of at least ``least`` pixels: r, c, region."""
    return large_regions(regions(mask, columns, tile, pixels=pixels, chain=halo.thin_lines(length)), least - 1)


def _background(x: np.ndarray, at: Place) -> pa.Table:
    """Runs of a tile's background with the labels of its 4-connected components, and one row without a label for the tile."""
    row, first, last = runs(~x)
    label = ((row + at.row) * at.columns + first + at.column)[joined_runs(row, first, last, 4)]
    whole = [("label", label), ("r", row + at.row), ("first", first + at.column), ("last", last + at.column), ("tr", np.full(len(row), at.row)), ("tc", np.full(len(row), at.column))]
    return pa.concat_tables([pa.table({k: pa.array(v, pa.int64()) for k, v in whole}), pa.table({k: pa.array([v], pa.int64()) for k, v in zip([k for k, _ in whole], (None, None, None, None, at.row, at.column), strict=True)})])


def _between(taken: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each stretch of 0 .. end - 1 that isn't in ``taken`` (sorted)."""
    first, last = np.r_[0, taken + 1], np.r_[taken - 1, end - 1]
    return first[first <= last], last[first <= last]


NODES = "kind string, a long, b long, tr0 long, tr1 long, tc0 long, tc1 long"


def _empty_nodes(tiles: DataFrame, rows: int, columns: int, tile: int) -> DataFrame:
    """The tiles that no mask pixel is in, as nodes: stretches of them in a row of tiles, and bands of rows without any other.

    A node's number is that of its first pixel. ``kind``: ``node`` (a, its rows and columns of tiles), ``link`` (a, b: nodes
    that touch) and one of u, d, l, r (a node that tile (tr0, tc0) has above it, below, to the left or right). A task holds
    two neighbouring rows of tiles, only those with mask pixels in them; the window over all rows holds a number for each.
    """
    high, wide = -(-rows // tile), -(-columns // tile)
    order = Window.orderBy("tr")
    around = tiles.select("tr").distinct().select("tr", F.coalesce(F.lag("tr").over(order), F.lit(-1)).alias("prev"), F.coalesce(F.lead("tr").over(order), F.lit(high)).alias("next"))
    own = tiles.join(around, "tr").withColumn("g", F.explode(F.when((F.col("tr") > 0) & (F.col("prev") == F.col("tr") - 1), F.array("tr", F.col("tr") - 1)).otherwise(F.array("tr"))))

    def made(group: pd.DataFrame) -> pd.DataFrame:
        g = int(group["g"].iloc[0])
        here = group[group["tr"] == g]
        own = np.sort(here["tc"].to_numpy())
        below, prev, after = np.sort(group.loc[group["tr"] == g + 1, "tc"].to_numpy()), int(here["prev"].iloc[0]), int(here["next"].iloc[0])
        first, last = _between(own, wide)
        number = lambda tr, tc: tr * tile * columns + tc * tile
        out = [("node", number(g, a), None, g, g, a, b) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
        at = dict(zip(first.tolist(), first.tolist(), strict=True)) | dict(zip(last.tolist(), first.tolist(), strict=True))
        for t in own.tolist():
            out += [(side, number(g, at[n]), None, g, None, t, None) for side, n in (("l", t - 1), ("r", t + 1)) if n in at]
        for band, top, side in ((after > g + 1, g + 1, "d"), (prev < g - 1, prev + 1, "u")):
            if band:
                if side == "d" or prev == -1:  # the row above a band gives its node
                    out.append(("node", number(top, 0), None, top, (after if side == "d" else g) - 1, 0, wide - 1))
                out += [(side, number(top, 0), None, g, None, t, None) for t in own.tolist()]
                out += [("link", number(g, a), number(top, 0), None, None, None, None) for a in first.tolist()]
        if len(below):
            first2, last2 = _between(below, wide)
            # a stretch of the other row has a tile, or begins, where the last stretch up to it has not ended
            for x, low, top, other, tr, side in ((own, first2, last2, g + 1, g, "d"), (below, first, last, g, g + 1, "u")):
                k = np.searchsorted(low, x, "right") - 1
                ok = (k >= 0) & (top[np.maximum(k, 0)] >= x) if len(low) else np.zeros(len(x), bool)
                out += [(side, number(other, int(low[i])), None, tr, None, t, None) for t, i in zip(x[ok].tolist(), k[ok].tolist(), strict=True)]
            for (low, y), (other, top, z) in (((first, g), (first2, last2, g + 1)), ((first2, g + 1), (first, last, g))):
                k = np.searchsorted(other, low, "right") - 1
                ok = (k >= 0) & (top[np.maximum(k, 0)] >= low) if len(other) else np.zeros(len(low), bool)
                out += [("link", number(y, a), number(z, int(other[i])), None, None, None, None) for a, i in zip(low[ok].tolist(), k[ok].tolist(), strict=True)]
        return pd.DataFrame(out, columns=[c.split()[0] for c in NODES.split(", ")]).astype({c: "Int64" for c in ("a", "b", "tr0", "tr1", "tc0", "tc1")})

    return written(own.groupBy("g").applyInPandas(made, NODES), "empty")


def _stretch(first: Column, last: Column) -> Column:
    return F.explode(F.sequence(first, last))


def fill_holes(mask: DataFrame, rows: int, columns: int, tile: int = TILE) -> DataFrame:
    """r, c of the mask and of its holes: background that isn't 4-connected to pixel (0, 0). A mask that has (0, 0) fills all.

    Background is labelled as runs within the tiles that have mask pixels. Tiles without any are never made: they are nodes,
    stretches of a row of tiles and bands of such rows. Pixels on tile borders link labels with labels and nodes, and what
    ends up with label 0, that of pixel (0, 0), is outside. Only holes are spelt out, so the work follows the mask.
    """
    there = (F.col("r") >= 0) & (F.col("r") < rows) & (F.col("c") >= 0) & (F.col("c") < columns)
    own = mask.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c")).where(there).distinct()
    local = halo.through(own, columns, rows * columns, ASIS, tile, _background, "label long, r long, first long, last long, tr long, tc long")
    local = written(local.withColumns({"tr": F.floor(F.col("tr") / tile), "tc": F.floor(F.col("tc") / tile)}), "background")
    empty = _empty_nodes(local.where("label is null").select("tr", "tc"), rows, columns, tile)
    inner = local.where("label is not null")
    top, left = F.col("tr") * tile, F.col("tc") * tile
    bottom, right = F.least(top + tile, F.lit(rows)) - 1, F.least(left + tile, F.lit(columns)) - 1
    key = ["label", "tr", "tc"]
    sides = {
        "u": inner.where(F.col("r") == top).select(*key, "r", _stretch(F.col("first"), F.col("last")).alias("c")),
        "d": inner.where(F.col("r") == bottom).select(*key, "r", _stretch(F.col("first"), F.col("last")).alias("c")),
        "l": inner.where(F.col("first") == left).select(*key, "r", F.col("first").alias("c")), "r": inner.where(F.col("last") == right).select(*key, "r", F.col("last").alias("c")),
    }
    links = empty.where("kind = 'link'").select("a", "b")
    for side, other, i, j in (("d", "u", 1, 0), ("r", "l", 0, 1)):
        moved = sides[side].select(F.col("label").alias("a"), (F.col("r") + i).alias("r"), (F.col("c") + j).alias("c"))
        links = links.union(moved.join(sides[other].select("r", "c", F.col("label").alias("b")), ["r", "c"]).select("a", "b"))
    touching = [d.select(F.col("label").alias("b"), F.lit(side).alias("kind"), F.col("tr").alias("tr0"), F.col("tc").alias("tc0")) for side, d in sides.items()]
    for t in touching:
        links = links.union(t.distinct().join(empty.select("kind", "tr0", "tc0", "a"), ["kind", "tr0", "tc0"]).select("a", "b"))
    links = links.distinct()
    links = written(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    roots = merged(links) if not links.isEmpty() else links.select(F.col("a").alias("label"), F.col("a").alias("root"))

    def closed(d: DataFrame, label: str) -> DataFrame:
        found = d.join(roots.withColumnRenamed("label", "_label"), F.col(label) == F.col("_label"), "left")
        return found.where(F.coalesce("root", label) != 0)

    holes = closed(inner, "label").select("r", _stretch(F.col("first"), F.col("last")).alias("c"))
    whole = closed(empty.where("kind = 'node'"), "a").select(_stretch(F.col("tr0"), F.col("tr1")).alias("tr"), "tc0", "tc1").select("tr", _stretch(F.col("tc0"), F.col("tc1")).alias("tc"))
    whole = whole.select(_stretch(top, bottom).alias("r"), "tc").select("r", _stretch(left, right).alias("c"))
    return own.union(holes).union(whole)
