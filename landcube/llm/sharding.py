"""Sharding by a consistent-hash ring with virtual nodes and bounded loads (operator 4).

Every shard owns ``replicas`` points of a ring; a document belongs to the arc, and so to the shard, that its id's hash falls
in. No shard holds more than its quota: documents beyond it continue clockwise to the next arc whose shard has room.
With the default quotas (row counts at most one apart) balance is exact, and only what overflows moves.

What decides is how many documents each arc has: a few hundred numbers, whatever the data's size. The sweep over them runs
once on the driver and says, for each arc, which ranks go to which shard. Ranks come from a window over small parts of
hash buckets plus a running count of the parts before. Rows that are alike in all that is returned are one row with a
count until they are ranked, and a bucket that one key fills is dealt by the rows' other values; so no arc, shard, key or
group of equal texts is ever in one task.
"""

from __future__ import annotations

import json
import zlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landcube.llm.common import inline_rows, materialize, need

#: The ring's positions, a power of two; and the rows that a hash bucket should hold at most.
POSITION_BITS, BUCKET_ROWS, CHUNK = 13, 50_000, 10_000


def ring(shards: int, replicas: int) -> tuple[list[int], list[int]]:
    """The arc of every ring position, and the shard of every arc. Arcs run clockwise up to their virtual node."""
    positions = 1 << POSITION_BITS
    nodes: dict[int, int] = {}
    for replica in range(replicas):
        for shard in range(shards):
            nodes.setdefault(zlib.crc32(f"shard {shard} node {replica}".encode()) % positions, shard)
    ends = sorted(nodes)
    arcs, at = [], 0
    for position in range(positions):
        while at < len(ends) and ends[at] < position:
            at += 1
        arcs.append(at % len(ends))
    return arcs, [nodes[e] for e in ends]


def bounded_loads(counts: list[int], owners: list[int], quotas: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot): own documents first, then the overflow clockwise.

    ``quotas`` must hold all documents together. Overflow is taken in the order in which the sweep meets it.
    """
    room, slots, runs = list(quotas), [0] * len(quotas), []

    def take(arc: int, low: int, high: int, shard: int) -> int:
        n = min(high - low, room[shard])
        if n:
            runs.append((arc, low, low + n, shard, slots[shard]))
            room[shard] -= n
            slots[shard] += n
        return low + n

    over = [(arc, take(arc, 0, n, owners[arc]), n) for arc, n in enumerate(counts)]
    carried: list[tuple[int, int, int]] = []
    for lap in range(2):
        for arc, owner in enumerate(owners):
            if lap == 0 and over[arc][1] < over[arc][2]:
                carried.append(over[arc])
            while carried and room[owner]:
                first, low, high = carried[0]
                low = take(first, low, high, owner)
                carried[0] = (first, low, high)
                if low == high:
                    carried.pop(0)
    return runs


def quotas_of(rows: int, shards: int, load_factor: float) -> list[int]:
    """Rows that each shard may hold: within one of each other, or ``load_factor`` times the mean, rounded up."""
    if load_factor <= 1:
        return [rows // shards + (s < rows % shards) for s in range(shards)]
    return [-int(-load_factor * rows // shards)] * shards


def shard(documents: DataFrame, shards: int = 16, replicas: int = 32, load_factor: float = 1.0, key: Column | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every document.

    ``size`` is the text's UTF-8 bytes plus 1 (a null text has none). Rows are placed by the hash of ``key`` (doc_id); rows
    of one key, nulls among them, share an arc, and repeated rows get slots of their own. Slots count from 0 in each shard
    without gaps. An empty table gives no rows.
    """
    arcs, owners = ring(shards, replicas)
    rows = documents.count()
    fine = max(0, (rows // BUCKET_ROWS >> POSITION_BITS).bit_length())
    arc_of = F.from_json(F.lit(json.dumps(arcs)), "array<int>")
    point = F.xxhash64(F.col("doc_id") if key is None else key)
    bucket = F.shiftrightunsigned(point, 64 - POSITION_BITS - fine)
    placed = F.element_at(arc_of, (F.shiftrightunsigned(point, 64 - POSITION_BITS) + 1).cast("int"))
    at = documents.select(placed.alias("arc"), bucket.alias("bucket"))
    tally = at.groupBy("arc", "bucket").agg(F.count("*").alias("n"))
    counts = [0] * len(owners)
    for r in tally.groupBy("arc").agg(F.sum("n").alias("n")).collect():  # as many rows as the ring has arcs
        counts[r["arc"]] = r["n"]
    runs = bounded_loads(counts, owners, quotas_of(rows, shards, load_factor))
    spark = documents.sparkSession
    plan = inline_rows(spark, runs, "arc int, low long, high long, shard int, slot0 long")
    # as many rows as there are buckets: one for each BUCKET_ROWS documents, 2 ** POSITION_BITS at least
    deals = tally.select("bucket", F.ceil(F.col("n") / BUCKET_ROWS).alias("deals"), F.col("arc").alias("own_arc"))
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    keyed = documents.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), point.alias("point"), bucket.alias("bucket"))
    alike = ["point", "doc_id", "size", "text_crc32"]
    groups = keyed.groupBy("bucket", *alike).agg(F.count("*").alias("n")).join(deals, "bucket")
    groups = materialize(groups.withColumn("deal", F.pmod(F.xxhash64(*alike), F.col("deals"))).drop("deals").withColumnRenamed("own_arc", "arc"), "groups")
    before = Window.partitionBy("arc").orderBy("bucket", "deal").rowsBetween(Window.unboundedPreceding, -1)
    bases = groups.groupBy("arc", "bucket", "deal").agg(F.sum("n").alias("m")).select("bucket", "deal", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("bucket", "deal").orderBy(*alike).rowsBetween(Window.unboundedPreceding, -1)
    ranked = groups.withColumn("nth", F.coalesce(F.sum("n").over(order), F.lit(0))).join(materialize(bases, "bases"), ["bucket", "deal"])
    # equal rows apart again, in two steps, so that the numbers of none are one long array
    many = ranked.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK))))
    each = many.withColumn("k", F.explode(F.sequence(F.col("chunk") * CHUNK, F.least(F.col("n") - 1, F.col("chunk") * CHUNK + CHUNK - 1))))
    each = each.withColumn("rank", F.col("base") + F.col("nth") + F.col("k"))
    # the plan has at most two rows for each arc and shard: bounded by the ring, not by the data
    found = each.join(F.broadcast(plan.withColumnRenamed("arc", "plan_arc")), [F.col("arc") == F.col("plan_arc"), F.col("rank") >= F.col("low"), F.col("rank") < F.col("high")])
    return found.select("doc_id", "size", "text_crc32", "shard", (F.col("slot0") + F.col("rank") - F.col("low")).alias("slot"))


def shard_table(documents: DataFrame) -> DataFrame:
    """The contract's columns: 16 shards whose row counts are at most one apart (law ``rows``)."""
    made = shard(need(documents, "doc_id", "text"))
    return made.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
