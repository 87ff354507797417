"""Groups of near copies: texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more. No link is lost.

1. Sets are ordered alike, shingles that a sample shows to be common last. Two linked sets share one of the first of both, as
   many as the fifth of a set and one more (prefix filter); sizes, places and the parity of shingles by hash bucket (each shingle
   that only one set has changes one bit at most) rule out other pairs. All of these are bounds, so what is left holds every link.
2. Of what is left SimHash finds the groups. Each shingle's hash is mixed to ``WORDS`` hashes of 64 bits, and a fingerprint bit is 1
   if it is set in over half of the set's. At a similarity of 0.8 a bit differs with probability 0.152; ``BANDS`` bands of ``WIDTH``
   bits bring two such sets together in one band at least with probability 0.998. Within a band's bucket those with at most
   ``LIMIT`` differing of the first 128 bits (19 on average at 0.8, 64 for unrelated sets) are linked, and the components of these
   links are groups of candidates. Within a group the links are those of the exact Jaccard similarity of shingle sets; a search
   from set to set gives edges that connect what the links connect.
3. Pairs of 1 that lie in different groups are compared exactly, which adds the links that SimHash has missed. A shingle of over
   ``FEW`` sets isn't listed as pairs before: it takes part only if its sets are in different groups.

Equal sets are one point from the start, and only sets of 1 are shuffled. Groups and shingles over ``BUCKET`` members, and buckets
over ``HELD``, are dealt out as pairs of blocks, so every two members meet in a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landcube.llm.common import fits, materialize, need
from landcube.llm.components import connected_components

SHINGLE, ALIKE, BUCKET, SEED = 5, (4, 5), 1024, 42
WORDS, WIDTH, BANDS, LIMIT, HELD = 8, 12, 42, 36, 16_384
#: Common shingles are counted in one row of 16, but so many rows at least and at most; how many of them are kept; below which hash.
COMMON, KEPT, LOW = (8192, 131_072), 1 << 18, np.uint64(1 << 62)
#: Sets up to which a shingle's pairs are listed; rows whose numbers are broadcast, at most.
FEW, BROADCAST_ROWS = 64, 1 << 20
#: Buckets of the parity bits, for each size class twice as many.
LEAST_BITS, MOST_BITS = 256, 1 << 16
#: What each next byte of a stretch is multiplied by once more for its hash, and what undoes it.
STEP = 0x9E3779B97F4A7C15
BACK = pow(STEP, -1, 1 << 64)
#: Words hashed at once; bytes above which a word goes by its digest; places that a process keeps powers for at least.
BLOCK, LONG, PLACES = 4096, 1024, 1 << 16
SALT = np.random.default_rng(0).integers(0, 1 << 64, WORDS, np.uint64)
#: Of the min-hash bands that the toxicity model's sample is thinned by.
MIN_BANDS, ROWS = 12, 4
MIX, ODD = (np.random.default_rng(k).integers(0, 1 << 64, MIN_BANDS * ROWS, np.uint64) | np.uint64(k) for k in (0, 1))


@cache
def powers(step: int, size: int) -> np.ndarray:
    """1, ``step``, its square and so on, modulo 2 to the 64; ``size`` is a power of two."""
    made, n = np.ones(size, np.uint64), 1
    while n < size:
        made[n : 2 * n] = made[:n] * np.uint64(pow(step, n, 1 << 64))
        n *= 2
    return made


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    """A hash of each ``SHINGLE`` consecutive words; fewer words have one of all."""
    import xxhash

    joined = np.frombuffer(b" ".join([*words, b""]), np.uint8)
    ends = np.flatnonzero(joined == 32)
    if len(joined) > LONG and np.diff(ends, prepend=-1).max() > LONG + 1:
        return shingle_hashes([w if len(w) <= LONG else b"\0" + xxhash.xxh128_hexdigest(w, SEED).encode() for w in words])
    size, n = max(PLACES, 1 << (len(joined) - 1).bit_length()), min(SHINGLE, len(words))
    sums = np.zeros(len(joined) + 1, np.uint64)  # sums of stretches, of which a place's power is taken out again
    np.cumsum(joined.astype(np.uint64) * powers(STEP, size)[: len(joined)], out=sums[1:])
    starts = np.zeros(len(ends), np.int64)
    starts[1:] = ends[:-1] + 1
    starts, ends = starts[: len(words) - n + 1], ends[n - 1 :]
    x = (sums[ends] - sums[starts]) * powers(BACK, size)[starts]
    for shift, odd in ((32, 0xBF58476D1CE4E5B9), (29, 0x94D049BB133111EB), (32, 1)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(odd)
    return x


def shingles(text: str | None) -> np.ndarray:
    """The sorted hashes of the text's different shingles; a text of fewer words is one shingle, one without words none."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.array([], np.uint64)
    made = [shingle_hashes(words[at : at + BLOCK + SHINGLE - 1]) for at in range(0, max(1, len(words) - SHINGLE + 1), BLOCK)]
    own = np.concatenate(made) if len(made) > 1 else made[0]
    own.sort()
    new = np.ones(len(own), bool)
    np.not_equal(own[1:], own[:-1], out=new[1:])
    return own[new]


def node_of(own: np.ndarray) -> int:
    """The number of a shingle set."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), SEED)).view(np.int64))


def bands(own: np.ndarray) -> list[int]:
    """A hash for each band of min-hashes; none for an empty set."""
    import xxhash

    if not len(own):
        return []
    least = np.array([((own ^ x) * k).min() for x, k in zip(MIX, ODD, strict=True)], np.uint64).reshape(MIN_BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(least)], np.uint64).view(np.int64).tolist()


def simhash(own: np.ndarray) -> np.ndarray:
    """The set's SimHash: ``WORDS`` words of 64 bits, the lowest bit of a word first."""
    counts = np.zeros(WORDS * 64, np.int64)
    for at in range(0, len(own), 255):  # so many ones fit into a byte
        x = own[at : at + 255, None] + SALT
        for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(odd)
        x ^= x >> np.uint64(31)
        counts += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(own), bitorder="little").view(np.uint64)


def band_keys(fingerprint: np.ndarray) -> np.ndarray:
    """A number for each band: which it is, and its bits."""
    bits = np.unpackbits(fingerprint.view(np.uint8), bitorder="little")[: BANDS * WIDTH].reshape(BANDS, WIDTH)
    return (np.arange(BANDS) << WIDTH) + bits @ (1 << np.arange(WIDTH))


def close(points: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges (of positions) between fingerprints (rows of words) that connect what pairs at ``LIMIT`` or fewer bits connect."""

    def hits(some: np.ndarray, others: np.ndarray) -> np.ndarray:
        return sum(np.bitwise_count(some[:, None, k] ^ others[None, :, k]).astype(np.uint16) for k in range(points.shape[1])) <= LIMIT

    found, n = [], 0
    for at in range(0, len(points), 256):
        i, j = np.nonzero(np.triu(hits(points[at : at + 256], points[at:]), 1))
        found.append((i + at, j + at))
        n += len(i)
        if n > 2 * len(points):  # many alike: one edge for each that a search reaches
            break
    else:
        return found
    found, rest = [], np.arange(len(points))
    while len(rest) > 1:
        stack, rest = [rest[0]], rest[1:]
        while stack and len(rest):
            own = stack.pop()
            near = hits(points[[own]], points[rest])[0]
            found.append((np.full(int(near.sum()), own), rest[near]))
            stack.extend(rest[near])
            rest = rest[~near]
    return found


def near(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Which of ``others`` have a Jaccard similarity of ``ALIKE`` or more with ``own``; all are sorted and not empty."""
    sizes, (a, b) = np.array([len(x) for x in others]), ALIKE
    out = np.zeros(len(others), bool)
    may = np.flatnonzero((b * np.minimum(sizes, len(own)) >= a * np.maximum(sizes, len(own))))
    if len(may):
        flat = np.concatenate([others[i] for i in may])
        at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
        both = np.add.reduceat((own[at] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(sizes[may])[:-1]]))
        out[may] = b * both >= a * (sizes[may] + len(own) - both)
    return out


def spanning(nodes: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Edges between the nodes that connect what pairs of near sets connect."""
    found, rest = [], list(range(len(nodes)))
    while len(rest) > 1:
        stack, rest = [rest[0]], rest[1:]
        while stack and rest:
            own = stack.pop()
            hit = near(sets[own], [sets[i] for i in rest])
            reached = [i for i, h in zip(rest, hit, strict=True) if h]
            found += [(nodes[own], nodes[i]) for i in reached]
            stack += reached
            rest = [i for i, h in zip(rest, hit, strict=True) if not h]
    return found


def first_tokens(own: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first of the set's shingles in the order by (common or not, hash): sets alike share one of these of both."""
    low, (a, b) = own[: np.searchsorted(own, LOW)], ALIKE
    n = len(own) - -(-a * len(own) // b) + 1 if len(own) else 0
    if len(common):
        late = np.zeros(len(own), bool)
        late[: len(low)] = common[np.minimum(np.searchsorted(common, low), len(common) - 1)] == low
        own = np.concatenate([own[~late], own[late]]) if late[:n].any() else own
    return own[:n]


def parity(own: np.ndarray) -> np.ndarray:
    """For each hash bucket whether an odd number of the shingles is in it, as bits; sets up to 5/4 as large have as many buckets or
    twice as many."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (2 * len(own)).bit_length()))
    odd = np.bincount((own & np.uint64(bits - 1)).view(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little")


def halved(bits: np.ndarray) -> np.ndarray:
    """The parity bits (rows of bytes) for half as many buckets."""
    return bits[..., : bits.shape[-1] // 2] ^ bits[..., bits.shape[-1] // 2 :]


def may_be_alike(a: np.ndarray, b: np.ndarray, differ: np.ndarray | int = 0) -> np.ndarray:
    """Whether sets of these sizes can be alike, of which at least ``differ`` shingles are in one alone."""
    part, whole = ALIKE
    return (whole * np.minimum(a, b) >= part * np.maximum(a, b)) & ((part + whole) * differ <= (whole - part) * (a + b))


def lists(made: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, made)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.array([], np.int64), *made]), kind))


def common_shingles(rows: DataFrame) -> np.ndarray:
    """Hashes, below ``LOW``, of shingles of more than one of some rows, at most ``KEPT``, sorted. What is compared first depends on
    them; the result doesn't."""
    n = rows.count()
    one_of = max(1, n // min(max(n // 16, COMMON[0]), COMMON[1]))
    some = rows.where(F.pmod(F.xxhash64("rid"), F.lit(one_of)) == 0).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [own[: np.searchsorted(own, LOW)] for own in map(shingles, batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.array([], np.uint64), *made]).view(np.int64))], names=["h"])

    often = materialize(some.mapInArrow(run, "h long").groupBy("h").agg(F.least(F.count("*"), F.lit(64)).alias("n")).where("n > 1"), "common")
    least, total = 65, 0
    for r in sorted(often.groupBy("n").count().collect(), reverse=True):  # 63 rows at most
        total += r["count"]
        if total > KEPT:
            break
        least = r["n"]
    return np.sort(often.where(F.col("n") >= least).select("h").toArrow().column(0).to_numpy().view(np.uint64))


def marks(rows: DataFrame, common: np.ndarray) -> DataFrame:
    """rid, doc_id, node (number of the row's shingle set), size, odd (its parity bits) and tokens (its first shingles) of rows
    (rid, doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, odd, tokens = [], [], [], []
            for text in batch.column(2).to_pylist():
                own = shingles(text)
                nodes.append(node_of(own))
                sizes.append(len(own))
                odd.append(parity(own).tobytes())
                tokens.append(first_tokens(own, common).view(np.int64))
            columns = [batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(odd, pa.binary()), lists(tokens, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["rid", "doc_id", "node", "size", "odd", "tokens"])

    return need(rows, "rid", "doc_id", "text").mapInArrow(run, "rid long, doc_id long, node long, size int, odd binary, tokens array<long>")


def meeting(made: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that share one of their first tokens and may be alike by their sizes and its places; of a token with over
    ``FEW`` nodes each node as a, and the token (null for pairs). made: node, size, tokens."""
    placed = made.select("node", "size", F.posexplode("tokens").alias("at", "token"))
    dealt = placed.select("token", "node", (F.col("size").cast("long") * (1 << 32) + F.col("at")).alias("place"))

    def out(token: np.ndarray, node: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
        again = np.zeros(len(node), bool)
        again[1:] = (token[1:] == token[:-1]) & (node[1:] == node[:-1])  # rows of one set
        token, node, place = token[~again], node[~again], place[~again]
        runs = np.diff(np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]]))) if len(token) else np.array([], np.int64)
        n = np.repeat(runs, runs)
        many, few = n > FEW, (n > 1) & (n <= FEW)
        found = [(node[many], np.zeros(int(many.sum()), np.int64))]
        own, node = token[few], node[few]
        size, at = place[few] >> 32, place[few] & 0xFFFFFFFF
        for d in range(1, FEW):
            i = np.flatnonzero(own[d:] == own[:-d])
            if not len(i):
                break
            j = i + d
            # of sets alike this holds at the first token that they share
            rest = 1 + np.minimum(size[i] - 1 - at[i], size[j] - 1 - at[j])
            i, j = (x[may_be_alike(size[i], size[j]) & (sum(ALIKE) * rest >= ALIKE[0] * (size[i] + size[j]))] for x in (i, j))
            found.append((node[i], node[j]))
        a, b = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        tokens = pa.array(np.concatenate([token[many], np.zeros(len(a) - int(many.sum()), np.int64)]), mask=np.arange(len(a)) >= int(many.sum()))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), tokens], names=["a", "b", "token"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.array([], np.int64)] * 3
        for batch in batches:
            held = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns, strict=True)]
            cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            if cut:
                yield out(*[h[:cut] for h in held])
                held = [h[cut:] for h in held]
        yield out(*held)

    return dealt.repartition("token").sortWithinPartitions("token", "node").mapInArrow(run, "a long, b long, token long")


def not_ruled_out(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """Those of the different pairs (a, b) that sizes and parity bits leave."""
    one, other = (points.select(F.col("node").alias(x), F.col("size").alias(f"{x}_size"), F.col("odd").alias(f"{x}_odd")) for x in ("a", "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for m, n, x, y in zip(*(batch.column(c).to_pylist() for c in ("a_size", "b_size", "a_odd", "b_odd")), strict=True):
                x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                x, y = (halved(v) if len(v) > min(len(x), len(y)) else v for v in (x, y))
                keep.append(bool(may_be_alike(m, n, int(np.bitwise_count(x ^ y).sum()))))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    distinct = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return distinct.join(one, "a").join(other, "b").select("a", "b", "a_size", "b_size", "a_odd", "b_odd").mapInArrow(run, "a long, b long")


def apart(sizes: np.ndarray, odd: list[bytes], groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places of sets in different groups that sizes and parity bits leave."""
    found, width = [(np.array([], np.int64),) * 2], np.array([len(x) for x in odd])
    for w in np.unique(width):
        own, larger = np.flatnonzero(width == w), np.flatnonzero(width == 2 * w)
        bits = [np.frombuffer(b"".join([odd[i] for i in at]), np.uint8).reshape(len(at), n) for at, n in ((own, w), (larger, 2 * w))]
        both = np.ascontiguousarray(np.concatenate([bits[0], halved(bits[1])])).view(np.uint64)
        at = np.concatenate([own, larger])
        for k in range(0, len(own), 128):
            mine = slice(k, min(k + 128, len(own)))
            differ = sum(np.bitwise_count(both[mine, None, x] ^ both[None, k:, x]).astype(np.uint32) for x in range(both.shape[1]))
            m, n = sizes[at[mine], None], sizes[None, at[k:]]
            hit = may_be_alike(m, n, differ.astype(np.int64)) & (groups[at[mine], None] != groups[None, at[k:]])
            i, j = np.nonzero(np.triu(hit, 1))
            found.append((at[i + k], at[j + k]))
    return tuple(np.concatenate([f[x] for f in found]) for x in (0, 1))


def crossing(many: DataFrame, points: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes in different groups that share a token of ``many`` (token, node) and may be alike."""
    rooted = many.join(roots.select("node", "root"), "node", "left").select("token", "node", F.coalesce("root", "node").alias("root"))
    rooted = materialize(rooted, "many")
    sizes = materialize(rooted.groupBy("token").agg(F.count("*").alias("n"), F.min("root").alias("one"), F.max("root").alias("other")).where("one <> other").select("token", "n"), "tokens")
    blocks = F.ceil(F.col("n") / BUCKET).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(3)), blocks).cast("int")
    dealt = rooted.join(sizes, "token").join(points.select("node", "size", "odd"), "node")
    dealt = dealt.select("node", "root", "size", "odd", "token", own.alias("one"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    dealt = dealt.select(F.xxhash64("token", F.least("one", "other"), F.greatest("one", "other")).alias("task"), "node", "root", "size", "odd")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[tuple]) -> pa.RecordBatch:
            nodes, roots, sizes = (np.array([h[k] for h in held], np.int64) for k in range(3))
            i, j = apart(sizes, [h[3] for h in held], roots)
            return pa.RecordBatch.from_arrays([pa.array(nodes[i]), pa.array(nodes[j])], names=["a", "b"])

        task, held = None, []
        for batch in batches:
            for t, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if t != task:
                    yield out(held)
                    task, held = t, []
                held.append(row)
        yield out(held)

    return dealt.repartition("task").sortWithinPartitions("task").mapInArrow(run, "a long, b long").distinct()


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose sets are alike."""
    one, other = (sets.select(F.col("node").alias(x), F.col("own").alias(f"{x}_own")) for x in ("a", "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = ([np.frombuffer(x.as_py(), np.uint64) for x in both] for both in zip(batch.column(2), batch.column(3), strict=True))
            hit = [bool(near(x, [y])[0]) for x, y in own]
            yield batch.select(["a", "b"]).filter(pa.array(hit, pa.bool_()))

    return pairs.join(one, "a").join(other, "b").select("a", "b", "a_own", "b_own").mapInArrow(run, "a long, b long")


def sets_of(documents: DataFrame) -> DataFrame:
    """node, own (its shingle hashes as bytes), the first two words of its SimHash and keys (its bands) of each row; texts without
    words have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [m for m in map(shingles, batch.column(0).to_pylist()) if len(m)]
            prints = [simhash(m) for m in made]
            low, high = np.array([p[:2] for p in prints], np.uint64).view(np.int64).reshape(-1, 2).T
            columns = [pa.array([node_of(m) for m in made], pa.int64()), pa.array([m.tobytes() for m in made], pa.binary()), pa.array(low), pa.array(high), lists([band_keys(p) for p in prints], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "own", "low", "high", "keys"])

    return documents.select("text").mapInArrow(run, "node long, own binary, low long, high long, keys array<int>")


def candidates(points: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes whose components hold all that share a band and differ in ``LIMIT`` bits at most. points: node, low,
    high, keys."""
    keyed = points.select("node", "low", "high", F.explode("keys").alias("key"))
    large = materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HELD), "buckets")
    blocks = F.ceil(F.coalesce("n", F.lit(1)) / HELD).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(1)), blocks).cast("int")
    dealt = keyed.join(F.broadcast(large), "key", "left")  # only buckets to be split come to the driver, BANDS << WIDTH at most
    dealt = dealt.select("node", "low", "high", "key", own.alias("one"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    dealt = dealt.select(F.xxhash64("key", F.least("one", "other"), F.greatest("one", "other")).alias("task"), "node", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(nodes: np.ndarray, ends: list) -> pa.RecordBatch:
            made = [(nodes[i + at], nodes[j + at]) for at, points in ends if len(points) > 1 for i, j in close(points)]
            a, b = (np.concatenate([nodes[:0], *[e[k] for e in made]]) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        held = np.zeros((0, 4), np.int64)
        for batch in batches:
            held = np.concatenate([held, np.stack([c.to_numpy() for c in batch.columns], axis=1)])
            cuts = [0, *(np.flatnonzero(held[1:, 0] != held[:-1, 0]) + 1)]
            words = np.ascontiguousarray(held[:, 2:]).view(np.uint64)
            yield out(held[:, 1], [(a, words[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
            held = held[cuts[-1] :]
        yield out(held[:, 1], [(0, np.ascontiguousarray(held[:, 2:]).view(np.uint64))])

    return dealt.repartition("task").sortWithinPartitions("task").mapInArrow(run, "a long, b long")


def links(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes; their components are those of all verified candidates. sets: node, own, low, high, keys."""
    groups = materialize(connected_components(candidates(sets)).withColumnRenamed("root", "key"), "groups")
    sizes = materialize(groups.groupBy("key").agg(F.count("*").alias("n")), "sizes")
    blocks = F.ceil(F.col("n") / BUCKET).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(2)), blocks).cast("int")
    dealt = groups.join(sizes, "key").select("node", "key", own.alias("one"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    dealt = materialize(dealt.select("node", F.xxhash64("key", F.least("one", "other"), F.greatest("one", "other")).alias("task")), "dealt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(edges: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], names=["a", "b"])

        task, nodes, sets = None, [], []
        for batch in batches:
            for t, node, own in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if t != task:
                    if len(nodes) > 1:
                        yield out(spanning(nodes, sets))
                    task, nodes, sets = t, [], []
                nodes.append(node)
                sets.append(np.frombuffer(own, np.uint64))
        yield out(spanning(nodes, sets))

    both = dealt.join(sets, "node").select("task", "node", "own")
    return both.repartition("task").sortWithinPartitions("task", "node").mapInArrow(run, "a long, b long")


def small(rids: DataFrame) -> DataFrame:
    """Row numbers to join with: broadcast, so that no text is shuffled, if they are few enough."""
    rids = materialize(rids, "rids")
    return F.broadcast(rids) if fits(rids, BROADCAST_ROWS) else rids


def joined(roots: DataFrame, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, root) of the components that ``roots`` (node, root) and those of the pairs (a, b) whose sets are alike make."""
    one, other = (roots.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root")) for x in ("a", "b"))
    both = pairs.join(one, "a", "left").join(other, "b", "left").select("a", "b", F.coalesce("a_root", "a").alias("a_root"), F.coalesce("b_root", "b").alias("b_root"))
    both = materialize(both.where("a_root <> b_root"), "missed")
    new = verified(both.select("a", "b"), sets).join(both, ["a", "b"]).select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))
    above = materialize(connected_components(new).select(F.col("node").alias("below"), F.col("root").alias("top")), "above")
    whole = roots.join(above, F.col("root") == F.col("below"), "left").select("node", F.coalesce("top", "root").alias("root"))
    return whole.union(above.join(roots, F.col("below") == F.col("node"), "left_anti").select("below", "top"))


def numbered(documents: DataFrame) -> DataFrame:
    """All columns and rid, a number of its own for each row; written, so that it stays the same."""
    return materialize(documents.withColumn("rid", F.monotonically_increasing_id()), "rows")


def grouped(rows: DataFrame) -> DataFrame:
    """rid, doc_id, component_id (the smallest doc_id reachable by links) and stays (the first row of its component, by
    doc_id and rid) of each of ``rows`` (rid, doc_id, text).

    Texts without words are copies of each other. A null doc_id comes first; rows that share a doc_id are rows of their
    own. An empty table gives no rows; extra columns are ignored.
    """
    made = materialize(marks(rows, common_shingles(rows)), "marks")
    points = materialize(made.groupBy("node").agg(F.min(F.struct("doc_id", "rid")).alias("first"), *[F.first(x).alias(x) for x in ("size", "odd")]), "points")
    found = materialize(meeting(made), "meeting")
    many = found.where("token is not null").select("token", F.col("a").alias("node"))
    pairs = materialize(not_ruled_out(found.where("token is null"), points), "pairs")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).union(many.select("node")).distinct()
    wanted = points.join(nodes, "node", "left_semi").select(F.col("first.rid").alias("rid"))
    sets = materialize(sets_of(need(rows, "rid", "text").join(small(wanted), "rid", "left_semi")), "sets")
    roots = materialize(connected_components(links(sets)), "roots")
    roots = materialize(joined(roots, pairs.union(crossing(many, points, roots)), sets), "roots").withColumnRenamed("node", "of")
    rooted = points.join(roots, F.col("node") == F.col("of"), "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    rooted = materialize(rooted, "rooted")
    smallest = materialize(rooted.groupBy("root").agg(F.min("first").alias("least")), "smallest")
    whole = materialize(rooted.join(smallest, "root").select("node", "least"), "components")
    return made.join(whole, "node").select("rid", "doc_id", F.col("least.doc_id").alias("component_id"), (F.col("rid") == F.col("least.rid")).alias("stays"))


def first_rows(rows: DataFrame) -> DataFrame:
    """Those of ``rows`` (rid, doc_id, text and more) that stay; see :func:`grouped`."""
    return rows.join(small(grouped(rows).where("not stays").select("rid")), "rid", "left_anti")


def near_copies(documents: DataFrame) -> DataFrame:
    """doc_id and component_id of each row; see :func:`grouped`."""
    return grouped(numbered(need(documents, "doc_id", "text"))).select("doc_id", "component_id")
