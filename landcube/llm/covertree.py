"""Exact top-k inner products by dual-tree search over cover trees (operator 1).

Vectors are packed in as few bytes a component as the table's range needs and dealt into cells by the nearest of sampled
vectors, one for each block of rows but at most ``PIVOTS``. A block has ``BLOCK`` rows, in larger tables as many as make
``BLOCKS`` of them, up to ``PART_BYTES``. A cell with more rows is cut into shells by the distance from its sampled vector,
so every block is a region of space: a centre and a least and largest distance from it. Only rows at one distance, copies
above all, are dealt by hash. A block's rows are one cover tree: the children of a node lie within ``SHRINK`` times its radius
of their centres, the centres are further apart than that, and the first child has its parent's centre. The queries that
meet a block are indexed alike. A pair of nodes is pruned if the largest inner product that centres, covering radii and
norms admit is below the worst kth score of the node's queries. A data node meets all query nodes that remain at once, so
where nothing can be pruned the search costs little more than the products.

First each query searches the block it lies in, which gives a kth score to begin with. Then queries meet the list of all
blocks, ``LISTED`` of them at a time, and go on to those that the same bound doesn't rule out; a block is sent only to
groups of queries that ask for it, and these are sent packed in one value for each block and part. The ``k`` best of all blocks
are merged. Queries are grouped by the block they lie in, ``PART_BYTES`` of them together, so no group holds more than a
block and its queries. Every query row has a number of its own, so rows that share an id are answered each for itself.

Components beyond 64-bit integers saturate, and so do scores: an inner product is formed exactly and then cut off at the
bounds of a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landcube.llm.common import materialize, need

PIVOTS, BLOCK, LEAF, ASKING, SHRINK, LISTED = 1024, 4096, 128, 256, 0.85, 16
#: Data rows that queries meet at a time, bounds or products formed at a time, and rows of a leaf that is worth a bound of its own.
PIECE, CELLS, WORTH = 512, 2**19, 32
#: Blocks grow with the table, so that there are about so many, as far as ``PART_BYTES`` admits.
BLOCKS = 256
#: Bytes, as longs, of the queries that search a block together, and of a large block: a block is sent once for each part.
PART_BYTES = 16_000_000
FOUND = "query long, query_id long, vec_id long, score long"
LONG = 2**63 - 1


class Tree:
    """A cover tree over the rows of ``x``. Node i: rows ``order[low[i]:high[i]]``, centre, radius, largest norm, children.

    ``rows`` and ``squares`` (of the norms) are kept in the tree's order, so a node's vectors lie side by side.
    """

    def __init__(self, x: np.ndarray, leaf: int):
        self.x, self.order, self.leaf = x, np.arange(len(x)), leaf
        self.squares = (x**2).sum(axis=1)
        most = float(self.squares.max(initial=0))
        #: Whether the vectors are integers so small that distances by inner products are exact.
        self.whole = most < 2**50 and bool((x == np.rint(x)).all())
        kind = np.float32 if self.whole and most < 2**21 else np.float64
        self.rows, self.squares = np.array(x, kind), self.squares.astype(kind)
        self.centre, self.radius, self.low, self.high, self.most, self.children = [], [], [], [], [], []
        if len(x):
            centre = int(self._away(0, len(x), x.mean(axis=0)).argmin())
            self._add(centre, 0, len(x), self._away(0, len(x), x[centre]).max())
        at = 0
        while at < len(self.centre):
            self._split(at)
            at += 1
        self.centre, self.radius, self.most = np.array(self.centre, np.int64), np.array(self.radius), np.array(self.most)
        self.low, self.high = np.array(self.low, np.int64), np.array(self.high, np.int64)
        self.parent = np.array([len(c) > 0 for c in self.children], bool)
        self.points = x[self.centre]
        self.norm = np.sqrt((self.points**2).sum(axis=1))

    def _away(self, low: int, high: int, point: np.ndarray) -> np.ndarray:
        """Squares of the distances."""
        point = point.astype(self.rows.dtype)
        if self.whole:
            return np.maximum(self.squares[low:high] + point @ point - 2 * (self.rows[low:high] @ point), 0)
        return ((self.rows[low:high] - point) ** 2).sum(axis=1)

    def _add(self, centre: int, low: int, high: int, furthest: float) -> None:
        self.centre.append(centre)
        self.radius.append(float(furthest) ** 0.5)
        self.low.append(low)
        self.high.append(high)
        self.most.append(float(self.squares[low:high].max()) ** 0.5)
        self.children.append(np.array([], np.int64))

    def _split(self, at: int) -> None:
        low, high, radius = self.low[at], self.high[at], self.radius[at]
        if high - low <= self.leaf or radius == 0:
            return
        centres, nearest, owner, new = [], np.full(high - low, np.inf, self.rows.dtype), np.zeros(high - low, np.int64), self.centre[at]
        far_off = 0
        while float(nearest[far_off]) > (SHRINK * radius) ** 2:
            far = self._away(low, high, self.x[new])
            closer = far < nearest
            nearest[closer], owner[closer] = far[closer], len(centres)
            centres.append(new)
            far_off = int(nearest.argmax())
            new = int(self.order[low + far_off])
        by = np.argsort(owner, kind="stable")
        for kept in (self.order, self.rows, self.squares):
            kept[low:high] = kept[low:high][by]
        ends = np.cumsum(np.bincount(owner, minlength=len(centres)))
        starts = [0, *ends[:-1].tolist()]
        first = len(self.centre)
        for centre, a, b, r in zip(centres, starts, ends.tolist(), np.maximum.reduceat(nearest[by], starts), strict=True):
            self._add(centre, low + a, low + b, r)
        self.children[at] = np.arange(first, len(self.centre))


def highest(ips: np.ndarray, norm: np.ndarray, radius: np.ndarray, most: np.ndarray, own_norm: float, own_radius: float, own_most: float, least: np.ndarray | float = 0.0) -> np.ndarray:
    """No inner product between points of a node and of others is larger, but for rounding, which the slack covers.

    ``ips`` are the centres' inner products, ``radius`` the others' covering radii, ``most`` their largest norms. Two bounds:
    by Cauchy's inequality for the ways from the centres, and by the least distance that two such points can have.
    ``least`` is the least distance of a shell's points from its centre.
    """
    straight = ips + own_radius * norm + radius * own_norm + own_radius * radius
    apart = np.sqrt(np.maximum(norm**2 + own_norm**2 - 2 * ips, 0))
    gap = np.maximum(np.maximum(apart - radius, least - apart) - own_radius, 0)
    spread = (own_norm + own_radius) * (norm + radius)
    by_distance = (own_most**2 + most**2 - (gap * (1 - 1e-9)) ** 2) / 2 + 1e-9 * (own_norm + norm + own_radius + radius) ** 2
    top = np.minimum(straight + 1e-9 * (np.abs(straight) + spread), by_distance) + 1e-3
    return np.maximum(top, -LONG - 1.0)  # scores go no lower


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of integers, cut off at the bounds of a long."""
    whole = a.astype(object) @ b.astype(object).T
    return np.minimum(np.maximum(whole, -LONG - 1), LONG).astype(np.int64)


def spans(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The numbers from each ``low`` up to its ``high``."""
    n = high - low
    return np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())


class Best:
    """For each query the best scores and ids found so far, at most k, and ``worst``, below which none is taken."""

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, worst: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int, most: float):
        # no partial sum of an inner product exceeds the product of the norms, so up to these bounds floats are exact
        self.kind = np.float32 if most < 2**23 else np.float64 if most < 2**51 else None
        self.queries, self.data = (x.astype(self.kind) if self.kind else x for x in (queries, data))
        self.query_ids, self.ids, self.k, self.worst = query_ids, ids, k, worst.astype(np.float64)
        self.scores, self.found, self.n = np.zeros((len(queries), k), np.int64), np.zeros((len(queries), k), np.int64), np.zeros(len(queries), np.int64)
        self.formed = self.batches = 0

    def form(self, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        self.formed, self.batches = self.formed + len(rows) * len(cols), self.batches + 1
        return self.queries[rows] @ self.data[cols].T if self.kind else products(self.queries[rows], self.data[cols])

    def edge(self, made: np.ndarray, of: np.ndarray) -> np.ndarray:
        """The kth of each row's products, those that ``of`` leaves out last."""
        return np.partition(np.where(of, made, -np.inf if self.kind else -LONG - 1), -self.k, axis=1)[:, -self.k]

    def expect(self, rows: np.ndarray, cols: np.ndarray) -> None:
        """Raise the worst scores to the kth among some data rows, which are scored later."""
        if len(cols) > self.k:
            made = self.form(rows, cols)
            self.worst[rows] = np.maximum(self.worst[rows], self.edge(made, self.ids[cols] != self.query_ids[rows, None]).astype(np.float64))

    def score(self, rows: np.ndarray, cols: np.ndarray) -> None:
        """Form the products of some queries and some data rows and keep the best."""
        made = self.form(rows, cols)
        hit = made >= self.worst[rows, None].astype(self.kind or np.float64)
        if np.count_nonzero(hit) > 4 * self.k * len(rows):  # no kth score yet, or a low one
            hit &= self.ids[cols] != self.query_ids[rows, None]
            if len(cols) > self.k:
                hit &= made >= self.edge(made, hit)[:, None]
        r, c = np.divmod(np.flatnonzero(hit), len(cols))
        r, s, v = rows[r], made[r, c].astype(np.int64), self.ids[cols[c]]
        other = v != self.query_ids[r]
        r, s, v = r[other], s[other], v[other]
        if not len(r):
            return
        touched = np.unique(r)
        had = np.repeat(touched, self.n[touched]), spans(np.zeros(len(touched), np.int64), self.n[touched])
        r, s, v = np.concatenate([r, had[0]]), np.concatenate([s, self.scores[had]]), np.concatenate([v, self.found[had]])
        order = np.lexsort((v, ~s, r))
        r, s, v = r[order], s[order], v[order]
        rank = np.arange(len(r)) - np.searchsorted(r, r)
        kept = rank < self.k
        self.scores[r[kept], rank[kept]], self.found[r[kept], rank[kept]] = s[kept], v[kept]
        self.n[touched] = np.bincount(r[kept], minlength=len(self.n))[touched]
        full = touched[self.n[touched] == self.k]
        self.worst[full] = np.maximum(self.worst[full], self.scores[full, self.k - 1].astype(np.float64))


def dual_search(queries: np.ndarray, query_ids: np.ndarray, worst: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int, seen: dict | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query its best (scores, ids) in ``data``, at most k, none below ``worst`` (kth score so far, or -inf).

    A data node is visited once by all query nodes that its parent left, not by each of them; their bounds are formed
    together. Above leaves each query is bounded by itself; leaves of fewer than ``WORTH`` rows are scored with no bound but
    their parent's, which costs less. ``seen`` takes the numbers of pairs visited and pruned, of
    products formed and of the batches that they were formed in.
    """
    seen = {} if seen is None else seen
    if not len(queries) or not len(data):
        return [(np.array([], np.int64), np.array([], np.int64)) for _ in queries]
    left, right = Tree(queries.astype(np.float64), ASKING), Tree(data.astype(np.float64), LEAF)
    best = Best(queries[left.order], query_ids[left.order], worst[left.order], data[right.order], ids[right.order], k, left.most[0] * right.most[0])
    norms = np.sqrt(left.squares.astype(np.float64))
    pairs = pruned = 0

    def kth(nodes: np.ndarray) -> np.ndarray:
        ends = np.stack([left.low[nodes], left.high[nodes]], axis=1).ravel()
        return np.minimum.reduceat(np.append(best.worst, np.inf), ends)[::2]

    def bounds(nodes: np.ndarray, b: int) -> np.ndarray:
        ips = left.points[nodes] @ right.points[b]  # the bound is the same from either side
        return highest(ips, left.norm[nodes], left.radius[nodes], left.most[nodes], right.norm[b], right.radius[b], right.most[b])

    def points(rows: np.ndarray, b: np.ndarray) -> np.ndarray:
        own = norms[rows, None]
        return highest(left.rows[rows].astype(np.float64) @ right.points[b].T, right.norm[b], right.radius[b], right.most[b], own, 0.0, own)

    def leaves(rows: np.ndarray, under: np.ndarray) -> None:
        """Some queries against some leaves, the most promising first, ``PIECE`` data rows at a time."""
        nonlocal pairs, pruned
        tops = points(rows, under)
        by = np.argsort(-tops.max(axis=0), kind="stable")
        size = (right.high - right.low)[under[by]]
        for piece in np.split(by, np.flatnonzero(np.diff((np.cumsum(size) - size) // PIECE)) + 1):
            live = tops[:, piece] >= best.worst[rows, None]
            pairs, pruned = pairs + live.size, pruned + live.size - np.count_nonzero(live)
            some = live.any(axis=1)
            if not some.any():
                continue
            if 2 * np.count_nonzero(live) >= np.count_nonzero(some) * len(piece):  # hardly any to leave out
                best.score(rows[some], spans(right.low[under[piece]], right.high[under[piece]]))
                continue
            for j in np.flatnonzero(live.any(axis=0)):
                best.score(rows[live[:, j]], np.arange(right.low[under[piece[j]]], right.high[under[piece[j]]]))

    # queries without a kth score take it from the child that promises most
    new, kids = np.flatnonzero(np.isneginf(best.worst)), right.children[0][(right.high - right.low)[right.children[0]] >= WORTH]
    at_once = CELLS // max(PIECE, len(kids)) + 1
    for i in range(0, len(new) if len(kids) else 0, at_once):
        rows = new[i : i + at_once]
        first = kids[points(rows, kids).argmax(axis=1)]
        for b in np.unique(first):
            best.expect(rows[first == b], np.arange(right.low[b], min(right.high[b], right.low[b] + PIECE)))
    root = np.array([0])
    stack = [(root, 0, bounds(root, 0))]
    while stack:
        nodes, b, tops = stack.pop()
        while True:
            good = tops >= kth(nodes)
            pairs, pruned = pairs + len(nodes), pruned + np.count_nonzero(~good)
            nodes = nodes[good]
            wide = left.parent[nodes] & (left.radius[nodes] > right.radius[b])
            if not wide.any():
                break
            nodes = np.concatenate([nodes[~wide], *[left.children[a] for a in nodes[wide]]])
            tops = bounds(nodes, b)
        if not len(nodes):
            continue
        under = right.children[b] if right.parent[b] else np.array([b])
        last = under[~right.parent[under]]
        if len(last):
            rows = spans(left.low[nodes], left.high[nodes])
            size = right.high[last] - right.low[last]
            few = last[size < WORTH]
            many, cols = last[size >= WORTH], spans(right.low[few], right.high[few])
            pairs += len(nodes) * len(few)
            at_once = CELLS // max(PIECE, len(many)) + 1
            for i in range(0, len(rows), at_once):
                some = rows[i : i + at_once]
                some = some[points(some, np.array([b]))[:, 0] >= best.worst[some]]
                for j in range(0, len(cols) if len(some) else 0, PIECE):
                    best.score(some, cols[j : j + PIECE])
                if len(many) and len(some):
                    leaves(some, many)
        ahead = [(nodes, int(c), bounds(nodes, c)) for c in under[right.parent[under]]]
        stack += sorted(ahead, key=lambda x: float(x[2].max()))
    for name, n in (("visited", pairs), ("pruned", pruned), ("products", best.formed), ("batches", best.batches)):
        seen[name] = seen.get(name, 0) + int(n)
    back = np.argsort(left.order)
    return [(best.scores[i, : best.n[i]], best.found[i, : best.n[i]]) for i in back]


def quantized(embeddings: DataFrame) -> DataFrame:
    """vec_id and v, floor(1024 x) of every component; rows with a null id, vector or component or a non-finite one drop out."""
    parts = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall(parts, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    rows = need(embeddings, "vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fine)
    return rows.select("vec_id", F.transform(parts, lambda x: F.floor(x * 1024)).alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled up with zeros, which adds nothing to an inner product."""
    out = np.zeros((len(column), width), np.int64)
    n = column.value_lengths().to_numpy(zero_copy_only=False)
    out[np.arange(width) < n[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def unpacked(column: pd.Series, width: int, kind: str) -> np.ndarray:
    """The vectors, in one or more to each value, as rows."""
    return np.frombuffer(b"".join(column), kind).reshape(-1, width)


def nearest_cell(vectors: DataFrame, pivots: np.ndarray, kind: str) -> DataFrame:
    """The vectors packed as ``kind``, the nearest pivot of each and the distance from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = pivots.astype(np.float64)
        norms = (centres**2).sum(axis=1)
        for batch in batches:
            whole = matrix(batch.column(1), pivots.shape[1])
            x = whole.astype(np.float64)
            cell = (norms[None, :] - 2 * (x @ centres.T)).argmin(axis=1)
            away = np.sqrt(((x - centres[cell]) ** 2).sum(axis=1))
            packed = pa.array([row.tobytes() for row in whole.astype(kind)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), packed, pa.array(cell.astype(np.int32)), pa.array(away)], names=["vec_id", "v", "cell", "away"])

    return vectors.mapInArrow(run, "vec_id long, v binary, cell int, away double")


def blocks_of(celled: DataFrame, block: int = BLOCK) -> DataFrame:
    """vec_id, v and block of every vector: its cell's shell by the distance from the pivot.

    A shell with far more than ``block`` rows holds one distance very often; its rows are dealt by hash.
    """
    sizes = celled.groupBy("cell").agg(F.count("*").alias("n"))
    cuts = F.ceil(F.col("n") / block).cast("int")
    # at most PIVOTS cells; their quantiles are at most rows / block numbers together
    ends = celled.join(F.broadcast(sizes), "cell").groupBy("cell").agg(F.first("n").alias("n"), F.percentile_approx("away", F.lit([i / 64 for i in range(1, 64)]), 2000).alias("marks"))
    every = F.when(cuts >= 64, F.col("marks")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(cuts - 1, F.lit(1))), lambda i: F.get("marks", (i * 64 / cuts).cast("int") - 1)))
    ends = materialize(ends.select("cell", F.when(cuts > 1, every).otherwise(F.array().cast("array<double>")).alias("marks")), "shells")
    shell = F.size(F.filter("marks", lambda m: F.col("away") > m))
    shelled = celled.join(F.broadcast(ends), "cell").select("vec_id", "v", "cell", shell.alias("shell"))
    counted = shelled.groupBy("cell", "shell").agg(F.count("*").alias("m"))
    dealt = shelled.join(F.broadcast(counted), ["cell", "shell"])  # at most 64 shells of each of PIVOTS cells
    salt = F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("m") / (2 * block)))
    return dealt.select("vec_id", "v", F.xxhash64("cell", "shell", salt).alias("block"))


def search(queries: DataFrame, blocks: DataFrame, k: int, width: int, kind: str) -> DataFrame:
    """queries (``ASKED``) against the rows of their block (vec_id, v, block)."""

    def own(data: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(data) or not len(asked):
            return pd.DataFrame({"query": [], "query_id": [], "vec_id": [], "score": []}, dtype="int64")
        number, ids, worst = (np.concatenate(asked[c].to_list()) for c in ("query", "vec_id", "worst"))
        found = dual_search(unpacked(asked["v"], width, kind), ids, worst, unpacked(data["v"], width, kind), data["vec_id"].to_numpy(np.int64), k)
        n = [len(s) for s, _ in found]
        return pd.DataFrame({"query": np.repeat(number, n), "query_id": np.repeat(ids, n), "vec_id": np.concatenate([v for _, v in found]), "score": np.concatenate([s for s, _ in found])})

    met = blocks.join(queries.select("block", F.col("part").alias("part")).distinct(), "block")
    return met.groupBy("block", "part").cogroup(queries.groupBy("block", "part")).applyInPandas(own, FOUND)


SUMMARY = "block long, centre array<double>, least double, radius double, most double"


def summaries(blocks: DataFrame, width: int, kind: str) -> DataFrame:
    """Each block's centre, least and largest distance from it, and largest norm."""

    def own(key: tuple, data: pd.DataFrame) -> pd.DataFrame:
        x = unpacked(data["v"], width, kind).astype(np.float64)
        centre = x.mean(axis=0)
        away = np.sqrt(((x - centre) ** 2).sum(axis=1))
        return pd.DataFrame({"block": [key[0]], "centre": [centre.tolist()], "least": [float(away.min())], "radius": [float(away.max())], "most": [float(np.sqrt((x**2).sum(axis=1)).max())]})

    return blocks.groupBy("block").applyInPandas(own, SUMMARY)


#: One or more queries that search a block; v holds their vectors packed.
ASKED = "query array<long>, vec_id array<long>, v binary, worst array<double>, part int, block long"


def going_on(asked: DataFrame, listed: DataFrame, lists: int, width: int, kind: str) -> DataFrame:
    """For each block and part the queries (query, vec_id, v, worst, part, home) that their bound admits there, but for their own block."""

    def fan(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(queries):
            return pd.DataFrame({"query": [], "vec_id": [], "v": [], "worst": [], "part": [], "block": []})
        packed = unpacked(queries["v"], width, kind)
        x, worst = packed.astype(np.float64), queries["worst"].to_numpy(np.float64)
        number, ids, home = (queries[c].to_numpy(np.int64) for c in ("query", "vec_id", "home"))
        sizes = np.sqrt((x**2).sum(axis=1))
        made = []
        for block, centre, least, radius, most in rows[["block", "centre", "least", "radius", "most"]].itertuples(index=False):
            centre = np.array(centre)
            top = highest(x @ centre, np.sqrt((centre**2).sum()), radius, most, sizes, 0.0, sizes, least)
            goes = np.flatnonzero((top >= worst) & (home != block))
            if len(goes):
                made.append((number[goes], ids[goes], packed[goes].tobytes(), worst[goes], queries["part"].iat[0], block))
        return pd.DataFrame(made, columns=["query", "vec_id", "v", "worst", "part", "block"])

    dealt = asked.withColumn("list", F.explode(F.sequence(F.lit(0), F.lit(lists - 1))))
    met = listed.withColumn("list", F.pmod("block", F.lit(lists)).cast("int")).join(dealt.select("list", F.col("part").alias("part")).distinct(), "list")
    return met.groupBy("list", "part").cogroup(dealt.groupBy("list", "part")).applyInPandas(fan, ASKED)


def top_k(embeddings: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest integer inner products, ties to the smaller vec_id.

    A query doesn't find rows of its own id. Repeated rows are candidates each for itself and queries each for itself, so
    two rows with a query's id give two answers of k rows each, of the same or of different vectors. Vectors of unlike length are
    compared as if filled up with zeros. Fewer than k candidates give fewer rows; an empty table gives none. Components
    and scores beyond a long saturate.
    """
    vectors = quantized(embeddings)
    rows, width, low, high = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1)), F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    width, low, high = max(1, width), low or 0, high or 0
    kind = next(t for t in ("<i2", "<i4", "<i8") if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    block = max(BLOCK, min(rows // BLOCKS, PART_BYTES // (8 * width)))
    picked = [list(r["v"]) for r in vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1, min(PIVOTS, rows // block))).collect()]
    pivots = np.zeros((max(1, len(picked)), width), np.int64)
    for i, v in enumerate(picked):
        pivots[i, : len(v)] = v
    celled = materialize(nearest_cell(vectors, pivots, kind), "cells")
    blocks = materialize(blocks_of(celled, block), "blocks")
    queries = blocks.where(is_query)
    parts = max(1, -(-queries.count() * 8 * width // PART_BYTES))
    homes = queries.withColumnRenamed("block", "home").withColumn("part", F.pmod(F.xxhash64("home"), F.lit(parts)).cast("int")).withColumn("query", F.monotonically_increasing_id())
    homes = materialize(homes, "homes")
    none = F.lit(float("-inf"))
    first = homes.select(F.array("query").alias("query"), F.array("vec_id").alias("vec_id"), "v", F.array(none).alias("worst"), "part", F.col("home").alias("block"))
    near = materialize(search(first, blocks, k, width, kind), "near")
    begun = near.groupBy(F.col("query").alias("q")).agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("worst"))
    asked = homes.join(begun, F.col("query") == F.col("q"), "left").select("query", "vec_id", "v", F.coalesce("worst", none).alias("worst"), "part", "home")
    asked = materialize(asked, "asked")
    listed = materialize(summaries(blocks, width, kind), "summaries")
    lists = max(1, -(-listed.count() // LISTED))
    going = materialize(going_on(asked, listed, lists, width, kind), "going")
    found = near.union(search(going, blocks, k, width, kind))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def report(embeddings: DataFrame) -> DataFrame:
    return top_k(embeddings, F.col("vec_id") % 100 == 0)


ORACLE_SQL = """
WITH e AS (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.id, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
