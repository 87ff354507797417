"""Catalogue, cache, history and status as queries over append-only tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(rows: DataFrame, keys: list[str], *order: Column, most: int = 1, rank: str = "rank") -> DataFrame:
    """The first rows of each key; the rank limit is pushed below the shuffle by Spark."""
    ranked = rows.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(rank) <= most)


#: The finest cells: 360 degrees divided by 2 ** LEVELS. The coarsest is 360 degrees wide.
LEVELS = 16


def _position(at: Column, level: Column) -> Column:
    """The number of the cell of a level that a coordinate lies in; coordinates beyond the globe have numbers too."""
    return F.floor((at + 180) * F.pow(F.lit(2.0), level) / 360).cast("long")


def levelled(boxes: DataFrame) -> DataFrame:
    """Boxes that have an inside, with ``level``: that of the smallest cells which are not smaller than the box."""
    size = F.greatest(F.col("east") - F.col("west"), F.col("north") - F.col("south"))
    there = boxes.where((F.col("east") > F.col("west")) & (F.col("north") > F.col("south")))
    return there.withColumn("level", F.greatest(F.lit(0), F.least(F.lit(LEVELS), F.floor(F.log2(360 / size)))).cast("int"))


def covered(boxes: DataFrame, levels: list[int], below: bool) -> DataFrame:
    """Each box (with level) once for every cell that it meets at those of ``levels`` that are not finer than its own, or,
    with ``below``, that are coarser: at each level four cells at most. The cell is lv, cx, cy."""
    some = F.filter(F.array(*[F.lit(x) for x in levels]).cast("array<int>"), lambda x: x < F.col("level") if below else x <= F.col("level"))
    at = boxes.withColumn("lv", F.explode(some))
    for c, low, high in (("cx", "west", "east"), ("cy", "south", "north")):
        at = at.withColumn(c, F.explode(F.sequence(_position(F.col(low), F.col("lv")), _position(F.col(high), F.col("lv")))))
    return at


def candidates(products: DataFrame, areas: DataFrame) -> DataFrame:
    """Pairs of boxes (p, a) that meet a cell of the level of the larger one together, each pair at one cell only.

    A box is dealt to cells of its own size, and to those of the sizes that the other side has boxes of; so a large box is
    in a few cells, and small ones meet only what lies near them or holds them.
    """
    products, areas = levelled(products), levelled(areas)
    # at most LEVELS + 1 numbers of each side
    own = [sorted(r["level"] for r in x.select("level").distinct().collect()) for x in (products, areas)]

    def met(p: DataFrame, a: DataFrame, coarse: str) -> DataFrame:
        pairs = p.alias("p").join(a.alias("a"), [F.col("p.lv") == F.col("a.lv"), F.col("p.cx") == F.col("a.cx"), F.col("p.cy") == F.col("a.cy")]).where(F.col(f"{coarse}.level") == F.col("p.lv"))
        first = [_position(F.greatest(F.col(f"p.{c}"), F.col(f"a.{c}")), F.col("p.lv")) == F.col(f"p.{x}") for c, x in (("west", "cx"), ("south", "cy"))]
        return pairs.where(first[0] & first[1])

    at_own = [covered(x.where(F.lit(True)), levels, False).where(F.col("lv") == F.col("level")) for x, levels in ((products, own[0]), (areas, own[1]))]
    up = met(covered(products, own[1], False), at_own[1], "a"), met(at_own[0], covered(areas, own[0], True), "p")
    return up[0].union(up[1])


def search_products(products: DataFrame, areas: DataFrame, days: int, cloud: float) -> DataFrame:
    """(aoi, id) of products (id, cloud, start, box) that meet an area (aoi, target, box), strictly within ``days`` of its
    date and below ``cloud``. Boxes are joined through cells of several sizes (:func:`candidates`)."""
    kept = products.where(F.col("cloud") < cloud).select("id", "start", "west", "south", "east", "north")
    wanted = areas.select("aoi", "target", "west", "south", "east", "north")
    meets = (F.col("p.west") < F.col("a.east")) & (F.col("p.east") > F.col("a.west")) & (F.col("p.south") < F.col("a.north")) & (F.col("p.north") > F.col("a.south"))
    when = (F.col("p.start") > F.date_sub("a.target", days)) & (F.col("p.start") < F.date_add("a.target", days))
    return candidates(kept, wanted).where(meets & when).select("a.aoi", "p.id")


def mosaic(pixels: DataFrame, keys: list[str], values: list[str], cloudiest: float = 95.0) -> DataFrame:
    """``keys``, valid, id and ``values``: for each pixel the first valid one over its scenes, by (cloud, latest start, id).

    ``pixels`` has a row for each pixel of each scene, with the scene's id, cloud (unknown counts as 100) and start, and
    valid. Scenes with more cloud than ``cloudiest`` take no part. A pixel that no scene has valid has nulls. One grouping.
    """
    cloud = F.coalesce("cloud", F.lit(100.0))
    own = F.struct(cloud.alias("cloud"), (-F.unix_date(F.col("start").cast("date"))).alias("age"), F.col("id"), *values)
    made = pixels.where(cloud <= cloudiest).groupBy(*keys).agg(F.min(F.when(F.col("valid"), own)).alias("s"))
    return made.select(*keys, F.col("s").isNotNull().alias("valid"), F.col("s.id").alias("id"), *[F.col(f"s.{v}").alias(v) for v in values])


def best_product(products: DataFrame, keys: list[str], cloudiest: float = 100.0) -> DataFrame:
    """The clearest product of each key (unknown cloud counts as 100), the latest on ties, then the smaller id; none above
    ``cloudiest``."""
    products = products.where(F.coalesce("cloud", F.lit(100.0)) <= cloudiest)
    return first_by(products, keys, F.coalesce("cloud", F.lit(100.0)), F.desc("start"), F.col("id"))


def newest(history: DataFrame, most: int = 20) -> DataFrame:
    return first_by(history, ["user_id"], F.desc("ts"), F.desc("event_id"), most=most)


def latest_status(events: DataFrame) -> DataFrame:
    """The last status of each task from an append-only log."""
    return events.groupBy("user_id").agg(F.max_by(F.struct("event_type", "ts", "event_id"), F.struct("ts", "event_id")).alias("s")).select("user_id", F.col("s.event_type").alias("status"), F.col("s.event_id").alias("event_id"))


def live(cache: DataFrame, now: Column, days: int) -> DataFrame:
    """Entries that have not expired; of several under one key the newest."""
    kept = cache.where(F.col("created") + F.make_interval(days=F.lit(days)) > now)
    return first_by(kept, ["key"], F.desc("created"), F.desc("id")).drop("rank")


def expired(cache: DataFrame, now: Column, days: int) -> DataFrame:
    return cache.where(F.col("created") + F.make_interval(days=F.lit(days)) <= now)


def hits(requests: DataFrame, cache: DataFrame) -> DataFrame:
    return requests.join(cache.select("key", F.col("id").alias("entry")), "key")


def misses(requests: DataFrame, cache: DataFrame) -> DataFrame:
    return requests.join(cache, "key", "left_anti")


def with_results(areas: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """All areas, and whether there is a result."""
    some = results.select(F.col(key).alias("_k")).distinct()
    return areas.join(some, F.col(key) == F.col("_k"), "left").withColumn("has_results", F.col("_k").isNotNull()).drop("_k")
