"""Near-duplicates by SimHash with a generalised pigeonhole index (operator 2).

Fingerprints of 64 bits link at ``limit`` or fewer differing bits. Bits that vary together are grouped into partitions; a
partition with threshold t is probed by the keys that remain when any t of its bits are masked out, so two fingerprints
within t there share a key. If the thresholds plus one sum to ``limit`` plus one, every linked pair meets in some
partition. Number of partitions and thresholds come from a dynamic program over estimated counts: keys to shuffle and
candidates to verify, the latter from a bounded sample of fingerprints; whatever it picks, the result is exact.

Within a key's bucket the links are not listed: a search from fingerprint to fingerprint gives edges that connect what the
bucket's links connect, at most one for each member. Buckets over ``BUCKET`` members are dealt out as pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landcube.llm.common import materialize, need
from landcube.llm.components import connected_components

BITS, SHINGLE, SEED, BUCKET, SAMPLE = 64, 4, 42, 2048, 2048


def fingerprint(text: str | None) -> int:
    """The SimHash of the text's 4-word shingles, as an unsigned number; 0 if it has no words."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return digest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    first, last = (ends - lengths)[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist()
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(first, last, strict=True)), np.uint64, len(first))
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 32_768):
        own = hashes[at : at + 32_768]
        counts += np.unpackbits(own.view(np.uint8).reshape(len(own), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed number) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], names=["doc_id", "fp"])

    return need(documents, "doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def correlations(points: DataFrame) -> np.ndarray:
    """The absolute correlation of each two bits over all fingerprints; tasks send 64 x 64 counts each, summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            own = batch.column(0).to_numpy().view(np.uint64)
            bits = np.unpackbits(own.view(np.uint8).reshape(len(own), 8), axis=1, bitorder="little").astype(np.float32)
            both += (bits.T @ bits).astype(np.int64)
        at = np.arange(BITS * BITS)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(both.ravel())], names=["at", "n"])

    both = np.zeros(BITS * BITS)
    for r in points.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        both[r["at"]] = r["n"]
    both = both.reshape(BITS, BITS) / max(1, points.count())
    ones = both.diagonal()
    spread = np.sqrt(ones * (1 - ones))
    with np.errstate(all="ignore"):
        return np.nan_to_num(np.abs(both - np.outer(ones, ones)) / np.outer(spread, spread))


def partitions(correlation: np.ndarray, m: int) -> list[list[int]]:
    """``m`` groups of bits, as equal in size as can be; each grows by the bit most correlated with those it has."""
    left, groups = set(range(BITS)), []
    for i in range(m):
        size = BITS // m + (i < BITS % m)
        group = [min(left)]
        left.remove(group[0])
        while len(group) < size:
            best = max(sorted(left), key=lambda b: correlation[b, group].sum())
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def mask_of(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds (-1: not probed) whose sum, each plus one, is ``total``, of least cost; costs[i][t + 1]."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for done, (cost, chosen) in best.items():
            for units, extra in enumerate(own):
                if done + units <= total and (done + units not in step or cost + extra < step[done + units][0]):
                    step[done + units] = (cost + extra, [*chosen, units - 1])
        best = step
    return best[total]


def probes(points: DataFrame, limit: int) -> list[int]:
    """The masks to probe with: fingerprints that agree under one of them are candidates."""
    n = points.count()
    correlation = correlations(points)
    sample = np.array([r["fp"] for r in points.orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()], np.int64).view(np.uint64)
    apart = sample[:, None] ^ sample[None, :]
    options = []
    for m in range(2, limit + 2):
        groups, costs = partitions(correlation, m), []
        for group in groups:
            far = np.bincount(np.bitwise_count(apart & np.uint64(mask_of(group))).ravel(), minlength=BITS + 1) / max(1, apart.size)
            own = [0.0]
            for t in range(limit + 1):
                keys = comb(len(group), t)
                by_chance = sum(comb(len(group), j) for j in range(t + 1)) / 2.0 ** len(group)
                # a key costs about a thousand comparisons; a candidate pair is compared under each key that both share
                own.append(n * keys * 1000 + max(far[: t + 1].sum(), by_chance) * n * n * max(1, keys / 4))
            costs.append(own)
        cost, chosen = allocate(costs, limit + 1)
        options.append((cost, groups, chosen))
    _, groups, chosen = min(options, key=lambda o: o[0])
    return [mask_of([b for b in g if b not in out]) for g, t in zip(groups, chosen, strict=True) if t >= 0 for out in combinations(g, t)]


def signed(number: int) -> int:
    return number - (1 << 64) if number >> 63 else number


def spanning(points: np.ndarray, limit: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges between the points that connect what pairs at ``limit`` or fewer differing bits connect."""
    if len(points) <= 256 and np.count_nonzero(np.bitwise_count(points[:, None] ^ points[None, :]) <= limit) == len(points):
        return []
    found, rest = [], points
    while len(rest) > 1:
        stack, rest = [rest[0]], rest[1:]
        while stack and len(rest):
            own = stack.pop()
            near = np.bitwise_count(rest ^ own) <= limit
            if near.any():
                reached = rest[near]
                found.append((np.full(len(reached), own), reached))
                stack.extend(reached)
                rest = rest[~near]
    return found


def links(points: DataFrame, limit: int) -> DataFrame:
    """Pairs (a, b) of fingerprints; their components are those of all links."""
    masks = F.array(*[F.lit(signed(m)) for m in probes(points, limit)])
    keyed = points.select("fp", F.explode(masks).alias("mask")).select("fp", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"))
    sizes = materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    blocks = F.ceil(F.col("n") / BUCKET).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(1)), blocks).cast("int")
    dealt = keyed.join(sizes, "key").select("fp", "key", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    dealt = dealt.select("fp", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("task"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(edges: list) -> pa.RecordBatch:
            a, b = (np.concatenate([e[i] for e in edges]) if edges else np.array([], np.uint64) for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        held = [np.array([], np.int64), np.array([], np.uint64)]
        for batch in batches:
            task = np.concatenate([held[0], batch.column(1).to_numpy()])
            fp = np.concatenate([held[1], batch.column(0).to_numpy().view(np.uint64)])
            cuts = np.flatnonzero(task[1:] != task[:-1]) + 1
            edges = [e for a, b in zip([0, *cuts[:-1]], cuts, strict=True) for e in spanning(fp[a:b], limit)] if len(cuts) else []
            held = [task[cuts[-1] :], fp[cuts[-1] :]] if len(cuts) else [task, fp]
            yield out(edges)
        yield out(spanning(held[1], limit))

    return dealt.repartition("task").sortWithinPartitions("task").mapInArrow(run, "a long, b long")


def near_duplicates(documents: DataFrame, limit: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id reachable by links) of each row.

    Texts that are null, empty or without words have fingerprint zero. Repeated rows are rows of one component. An empty
    table gives no rows; extra columns are ignored.
    """
    made = materialize(fingerprints(documents), "simhash")
    points = materialize(made.select("fp").distinct(), "points")
    roots = connected_components(links(points, limit))
    firsts = made.groupBy("fp").agg(F.min("doc_id").alias("first"))
    rooted = materialize(firsts.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")
    smallest = materialize(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "smallest")
    whole = materialize(rooted.join(smallest, "root").select("fp", "component_id"), "components")
    return made.join(whole, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
