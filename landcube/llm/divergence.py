"""Divergence of sources from each other and from their language (operator 13), over a transducer vocabulary.

The terms that enough documents of a language have are its vocabulary. They are sorted, numbered by their lexicographic
ordinals, and built into minimal acyclic transducers, which give a term's ordinal as the sum of what lies before it along its
path. Texts are streamed through the transducers to be counted again, so that what leaves a task are ordinals and counts, and
no term that isn't kept; ordinals settle all ties.

Transducers are built in shards (by a checksum of the term) of some :data:`SHARD_TERMS` terms each, in parallel. Where all
shards together take at most :data:`SHIPPED_BYTES`, each task gets them all. Beyond that, tasks send the terms that they have
counted to the shard of each term, and are streamed through its transducer there; both ways give the same rows. A term's
first :data:`HEAD` bytes are symbols of their own and the rest, if any, is one, so that very long terms have few states.

Divergences are summed over the whole vocabulary in blocks of ordinals, each a small matrix of sources and terms; the terms
that a source doesn't have count there too. All arithmetic is on whole numbers.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Collection, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landcube.llm.common import materialize, need

SHARD_TERMS, SHIPPED_BYTES, HEAD = 65_536, 32_000_000, 64
#: Terms counted in a task before they are sent on, and their bytes; parts of a shard's terms where they are sent to it.
HELD_TERMS, HELD_BYTES, SALTS = 300_000, 24_000_000, 16
#: Terms of a language that a task knows the ordinals of, and counts by ordinal that it holds before they are sent on.
KNOWN_TERMS, HELD_COUNTS = 250_000, 2_000_000
#: Values in a block's matrix of sources and terms.
MATRIX = 1 << 17
ONE = 1_000_000_000
#: Bytes of terms, A to Z as a to z, and spaces for all others. In UTF-8 all bytes beyond ASCII belong to characters of terms.
LETTERS = bytes(b if b >= 0x80 or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(LETTERS).split()


class Transducer:
    """A minimal acyclic transducer from sorted terms: a term's rank is the sum of the skips along its path.

    ``keys`` holds state * 256 + byte of each transition, sorted, with its ``target`` and ``skip``; ``tails`` the transitions
    by all bytes beyond :data:`HEAD`. ``ordinals`` gives the vocabulary's ordinal of each rank; the last state is the root.
    """

    def __init__(self, keys, target, skip, final, ordinals, tails: Iterable[tuple[int, bytes, int]]):
        self.keys, self.target, self.skip, self.final, self.ordinals = keys, target, skip, final, ordinals
        self.tails = {(s, t): k for s, t, k in tails}

    @classmethod
    def build(cls, terms: list[bytes], ordinals: np.ndarray) -> Transducer:
        """``terms`` are distinct and sorted. States with equal futures are one: a state is settled once no later term can
        pass through it, and looked up among the settled ones by what follows it."""
        settled: dict[tuple, int] = {}
        counts: list[int] = []
        made: list[tuple] = []

        def settle(final: bool, edges: list) -> int:
            key = (final, tuple(edges))
            if (state := settled.get(key)) is None:
                state = settled[key] = len(made)
                made.append(key)
                counts.append(final + sum(counts[s] for _, s in edges))
            return state

        path: list[list] = [[False, []]]  # nodes along the last term: final, settled edges
        last: list = []
        for term in terms:
            symbols = [*term[:HEAD], *([term[HEAD:]] if len(term) > HEAD else [])]
            same = 0
            while same < len(last) and same < len(symbols) and last[same] == symbols[same]:
                same += 1
            while len(path) > same + 1:
                final, edges = path.pop()
                path[-1][1].append((last[len(path) - 1], settle(final, edges)))
            path += [[False, []] for _ in symbols[same:]]
            path[-1][0] = True
            last = symbols
        while len(path) > 1:
            final, edges = path.pop()
            path[-1][1].append((last[len(path) - 1], settle(final, edges)))
        settle(*path[0])  # no older state has all terms before it
        keys, target, skip, tails = [], [], [], []
        for state, (final, edges) in enumerate(made):
            before = int(final)
            for symbol, child in edges:
                if isinstance(symbol, int):
                    keys.append(state * 256 + symbol)
                    target.append(child)
                    skip.append(before)
                else:
                    tails.append((state, symbol, before))
                before += counts[child]
        return cls(np.array(keys, np.int64), np.array(target, np.int32), np.array(skip, np.int32), np.array([f for f, _ in made], bool), np.asarray(ordinals, np.int64), tails)

    def states(self) -> int:
        return len(self.final)

    def __call__(self, terms: list[bytes]) -> np.ndarray:
        """The ordinal of each term, -1 for one that isn't in the vocabulary: all terms take a step at a time."""
        n = len(terms)
        lengths = np.array([len(t) for t in terms], np.int64)
        width = min(HEAD, int(lengths.max(initial=0)))
        heads = np.frombuffer(b"".join([t[:width].ljust(width, b"\0") for t in terms]), np.uint8).reshape(n, width)
        state, rank = np.full(n, len(self.final) - 1), np.zeros(n, np.int64)
        alive = np.arange(n) if len(self.keys) else np.zeros(0, np.int64)
        for k in range(width):
            alive = alive[lengths[alive] > k]
            key = state[alive] * 256 + heads[alive, k]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[at] == key
            state[alive[~found]] = -1
            alive, at = alive[found], at[found]
            state[alive] = self.target[at]
            rank[alive] += self.skip[at]
        ok = (state >= 0) & (lengths <= HEAD) & (lengths > 0)
        ok[ok] = self.final[state[ok]]
        for i in np.flatnonzero((state >= 0) & (lengths > HEAD)):
            more = self.tails.get((int(state[i]), terms[i][HEAD:]))
            if more is not None:
                ok[i] = True
                rank[i] += more
        out = np.full(n, -1)
        out[ok] = self.ordinals[rank[ok]]
        return out


SHARDS = "lang string, shard int, keys binary, target binary, skip binary, final binary, ordinals binary, tails array<struct<state:int,tail:binary,skip:int>>, bytes long"


def _stored(lang: str, shard: int, t: Transducer) -> dict:
    blobs = {k: getattr(t, k).tobytes() for k in ("keys", "target", "skip", "final", "ordinals")}
    tails = [{"state": s, "tail": x, "skip": k} for (s, x), k in t.tails.items()]
    return {"lang": lang, "shard": shard, **blobs, "tails": tails, "bytes": sum(map(len, blobs.values())) + sum(len(x["tail"]) + 100 for x in tails)}


def _loaded(row: dict) -> Transducer:
    kinds = {"keys": np.int64, "target": np.int32, "skip": np.int32, "final": bool, "ordinals": np.int64}
    return Transducer(*[np.frombuffer(row[k], kind) for k, kind in kinds.items()], [(x["state"], x["tail"], x["skip"]) for x in row["tails"]])


class Held:
    """Counts by group and term that a task holds until they are ``most``, long terms counting for more."""

    def __init__(self, most: int):
        self.counts: dict[tuple, Counter] = defaultdict(Counter)
        self.most, self.added = most, 0

    def add(self, group: tuple, terms: Collection[bytes], size: int) -> bool:
        """Whether it is time to send them on. ``size``: the text's bytes."""
        self.counts[group].update(terms)
        self.added += len(terms) + size * HELD_TERMS // HELD_BYTES
        if self.added < self.most:
            return False
        self.added = sum(len(c) + sum(map(len, c)) * HELD_TERMS // HELD_BYTES for c in self.counts.values())
        return self.added >= self.most // 2

    def taken(self) -> dict[tuple, Counter]:
        counts, self.counts, self.added = self.counts, defaultdict(Counter), 0
        return counts


def _rows(documents: DataFrame) -> DataFrame:
    """lang, source and text, nulls as the empty text."""
    return documents.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def _batch(columns: list, names: str, kinds: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names.split())


def _counted(rows: DataFrame, by: list[str], once: bool) -> DataFrame:
    """``by``, term and n: occurrences of each term, or with ``once`` documents that have it, summed over all rows."""
    kinds, most = (*[pa.string() for _ in by], pa.binary(), pa.int64()), HELD_TERMS

    def sent(counts: dict[tuple, Counter]) -> Iterator[pa.RecordBatch]:
        for group, own in counts.items():
            yield _batch([*[[g] * len(own) for g in group], list(own), list(own.values())], " ".join([*by, "term", "n"]), kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held(most)
        for batch in batches:
            groups = zip(*[c.to_pylist() for c in batch.columns[:-1]], strict=True)
            for group, text in zip(groups, batch.columns[-1].cast(pa.binary()).to_pylist(), strict=True):
                terms = terms_of(text)
                if held.add(group, set(terms) if once else terms, len(text)):
                    yield from sent(held.taken())
        yield from sent(held.taken())

    schema = ", ".join([*[f"{b} string" for b in by], "term binary", "n long"])
    return rows.select(*by, "text").mapInArrow(run, schema).groupBy(*by, "term").agg(F.sum("n").alias("n"))


def vocabulary(documents: DataFrame, least: int = 10) -> DataFrame:
    """lang, term (its UTF-8 bytes), docs and ordinal (from 0 by language, in the order of the bytes) of the kept terms; written.

    Terms are sorted by ranges; a term's ordinal is its place in its range and the number of terms in the ranges before.
    """
    kept = _counted(_rows(documents), ["lang"], once=True).where(F.col("n") >= least)
    dealt = materialize(kept.repartitionByRange("lang", "term").withColumn("part", F.spark_partition_id()), "kept")
    before = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each part
    bases = dealt.groupBy("lang", "part").agg(F.count("*").alias("k")).select("lang", "part", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("lang", "part").orderBy("term")) - 1
    made = dealt.withColumn("k", place).join(bases, ["lang", "part"])
    return materialize(made.select("lang", "term", F.col("n").alias("docs"), (F.col("base") + F.col("k")).alias("ordinal")), "vocabulary")


def _sizes(kept: DataFrame) -> DataFrame:
    """lang, terms and shards of the languages that keep a term."""
    return kept.groupBy("lang").agg(F.count("*").alias("terms")).withColumn("shards", F.ceil(F.col("terms") / SHARD_TERMS).cast("int"))


def transducers(kept: DataFrame) -> DataFrame:
    """A row for each language and shard, with its transducer; written."""
    dealt = kept.join(_sizes(kept), "lang").withColumn("shard", (F.crc32("term") % F.col("shards")).cast("int"))

    def built(key: tuple, own: pa.Table) -> pa.Table:
        own = own.sort_by("term")
        made = Transducer.build(own["term"].to_pylist(), own["ordinal"].to_numpy())
        return pa.Table.from_pylist([_stored(key[0].as_py(), key[1].as_py(), made)], kind)

    tail = pa.struct([("state", pa.int32()), ("tail", pa.binary()), ("skip", pa.int32())])
    blobs = [(k, pa.binary()) for k in ("keys", "target", "skip", "final", "ordinals")]
    kind = pa.schema([("lang", pa.string()), ("shard", pa.int32()), *blobs, ("tails", pa.list_(tail)), ("bytes", pa.int64())])
    return materialize(dealt.select("lang", "shard", "term", "ordinal").groupBy("lang", "shard").applyInArrow(built, SHARDS), "transducers")


COUNTED = "lang string, source string, ordinal long, n long"


def _shipped(rows: DataFrame, shards: DataFrame) -> DataFrame:
    """Texts streamed through transducers that every task has whole. Only for shards of a checked size."""
    spark = rows.sparkSession
    most, known_terms, held_counts = HELD_TERMS, KNOWN_TERMS, HELD_COUNTS
    shared = spark.sparkContext.broadcast([r.asDict(recursive=True) for r in shards.collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_lang: dict[str, list[Transducer]] = defaultdict(list)
        for row in sorted(shared.value, key=lambda r: r["shard"]):
            by_lang[row["lang"]].append(_loaded(row))
        known: dict[str, dict[bytes, int]] = {lang: {} for lang in by_lang}
        sums: dict[tuple, list] = defaultdict(list)

        def streamed(counts: dict[tuple, Counter]) -> None:
            """Counted terms through the transducers; ordinals that the task has met before are at hand."""
            for ordinals in known.values():
                if len(ordinals) > known_terms or sum(map(len, ordinals)) > 2 * HELD_BYTES:
                    ordinals.clear()
            for group, own in counts.items():
                if not (through := by_lang.get(group[0])):
                    continue
                ordinals = known[group[0]]
                parts: list[list] = [[] for _ in through]
                for term in own:
                    if term not in ordinals:
                        parts[zlib.crc32(term) % len(through) if len(through) > 1 else 0].append(term)
                for one, terms in zip(through, parts, strict=True):
                    ordinals.update(zip(terms, one(terms).tolist(), strict=True))
                found = np.fromiter(map(ordinals.__getitem__, own), np.int64, len(own))
                n = np.fromiter(own.values(), np.int64, len(own))
                sums[group].append((found[found >= 0], n[found >= 0]))

        def sent(least: int) -> Iterator[pa.RecordBatch]:
            """All counts by ordinal, once there are more than ``least`` of them, each ordinal once."""
            if sum(len(o) for own in sums.values() for o, _ in own) <= least:
                return
            for group, own in sums.items():
                found, at = np.unique(np.concatenate([o for o, _ in own]), return_inverse=True)
                n = np.zeros(len(found), np.int64)
                np.add.at(n, at, np.concatenate([n for _, n in own]))
                sums[group] = [(found, n)]
            if sum(len(o) for own in sums.values() for o, _ in own) <= least // 2:
                return
            for (lang, source), [(found, n)] in sums.items():
                texts = [pa.repeat(pa.scalar(x, pa.string()), len(n)) for x in (lang, source)]
                yield pa.RecordBatch.from_arrays([*texts, pa.array(found), pa.array(n)], names=["lang", "source", "ordinal", "n"])
            sums.clear()

        held = Held(most)
        for batch in batches:
            for lang, source, text in zip(*[c.to_pylist() for c in batch.columns[:2]], batch.columns[2].cast(pa.binary()).to_pylist(), strict=True):
                if held.add((lang, source), terms_of(text), len(text)):
                    streamed(held.taken())
                    yield from sent(held_counts)
        streamed(held.taken())
        yield from sent(-1)

    return rows.mapInArrow(run, COUNTED).groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n"))


def _sent(rows: DataFrame, kept: DataFrame, shards: DataFrame) -> DataFrame:
    """Counted terms sent to their shards and streamed through the transducers there."""
    salt = F.pmod(F.xxhash64("source", "term"), F.lit(SALTS)).cast("int")
    terms = _counted(rows, ["lang", "source"], once=False).join(_sizes(kept), "lang")
    dealt = terms.select("lang", (F.crc32("term") % F.col("shards")).cast("int").alias("shard"), salt.alias("salt"), "source", "term", "n")
    many = shards.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))

    def through(own: pa.Table, shard: pa.Table) -> pa.Table:
        found = _loaded(shard.to_pylist()[0])(own["term"].to_pylist()) if own.num_rows and shard.num_rows else np.zeros(0, np.int64)
        at = np.flatnonzero(found >= 0)
        own = own.take(pa.array(at)) if len(found) else own
        return pa.table([own["lang"], own["source"], pa.array(found[at], pa.int64()), own["n"]], names=["lang", "source", "ordinal", "n"])

    by = ["lang", "shard", "salt"]
    return dealt.groupBy(*by).cogroup(many.groupBy(*by)).applyInArrow(through, COUNTED)


def recount(documents: DataFrame, kept: DataFrame, shipped_bytes: int = SHIPPED_BYTES) -> DataFrame:
    """lang, source, ordinal, n: how often each group has each kept term, where it has it; written."""
    rows, shards = _rows(documents), transducers(kept)
    size = shards.agg(F.sum("bytes")).first()[0] or 0
    return materialize(_shipped(rows, shards) if size <= shipped_bytes else _sent(rows, kept, shards), "recounted")


def _share(n: Column) -> Column:
    """1 + floor(ONE * (n + 2) / (whole + 2 * terms)), exactly."""
    return (F.lit(1) + F.call_function("div", F.lit(ONE).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)"), (F.col("whole") + 2 * F.col("terms")).cast("decimal(20,0)"))).cast("long")


def _gap(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _pairs(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item and value of every two sources of a language: the sum over the whole vocabulary."""
    wide = groups.join(groups.groupBy("lang").agg(F.greatest(F.lit(1), F.floor(F.lit(MATRIX) / F.count("*"))).alias("size")), "lang")
    wide = materialize(wide.withColumn("zero", F.when(F.col("terms") > 0, _share(F.lit(0)))), "wide")
    blocks = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(1), F.ceil(F.col("terms") / F.col("size"))) - 1)
    every = wide.select("lang", F.explode(blocks).alias("block"), "source", "terms", "size", F.coalesce("zero", F.lit(1)).alias("zero"))
    own = counts.join(wide, ["lang", "source"]).select("lang", F.floor(F.col("ordinal") / F.col("size")).alias("block"), "source", "ordinal", _share(F.col("n")).alias("p"))

    def summed(key: tuple, own: pa.Table, every: pa.Table) -> pa.Table:
        names = every["source"].to_pylist()
        size = every["size"][0].as_py()
        first = key[1].as_py() * size
        p = np.repeat(every["zero"].to_numpy()[:, None], max(0, min(size, every["terms"][0].as_py() - first)), 1)
        place = {s: i for i, s in enumerate(names)}
        if own.num_rows:
            p[[place[s] for s in own["source"].to_pylist()], own["ordinal"].to_numpy() - first] = own["p"].to_numpy()
        source, item, value = [], [], []
        for i in range(len(names) - 1):
            gap, both = p[i + 1 :] - p[i], p[i + 1 :] + p[i]
            sums = (gap * gap // both).sum(1).tolist()
            source += [names[i]] * len(sums) + names[i + 1 :]
            item += names[i + 1 :] + [names[i]] * len(sums)
            value += sums * 2
        return pa.table([pa.array([key[0].as_py()] * len(value), pa.string()), pa.array(source, pa.string()), pa.array(item, pa.string()), pa.array(value, pa.int64())], names=["lang", "source", "item", "value"])

    found = own.groupBy("lang", "block").cogroup(every.groupBy("lang", "block")).applyInArrow(summed, "lang string, source string, item string, value long")
    return found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(documents: DataFrame, least: int = 10, top: int = 10, shipped_bytes: int = SHIPPED_BYTES) -> DataFrame:
    """lang, source, part, item, value and rank.

    ``documents`` has lang, source and text, nulls read as empty texts. Part ``pair`` ranks the other sources of a
    language by their summed divergence (0 in a language that keeps no term); part ``term`` the ``top`` terms that a source
    has more of than its language. Ties go to the smaller source, and to the smaller ordinal. Repeated rows count each; a
    source that is alone in its language has no pair, a table without rows gives none.
    """
    kept = vocabulary(documents, least)
    counts = recount(documents, kept, shipped_bytes)
    sizes = _sizes(kept).select("lang", "terms")
    whole = counts.groupBy("lang", "source").agg(F.sum("n").alias("whole"))
    groups = _rows(documents).select("lang", "source").distinct().join(sizes, "lang", "left").join(whole, ["lang", "source"], "left")
    groups = materialize(groups.select("lang", "source", F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("whole", F.lit(0)).alias("whole")), "groups")
    by = Window.partitionBy("lang", "source")
    pairs = _pairs(counts, groups).withColumn("rank", F.row_number().over(by.orderBy(F.desc("value"), "item")))
    langs = groups.groupBy("lang").agg(F.first("terms").alias("terms"), F.sum("whole").alias("whole"))
    in_lang = counts.withColumn("all", F.sum("n").over(Window.partitionBy("lang", "ordinal")))
    in_lang = in_lang.join(langs, "lang").withColumn("q", _share(F.col("all"))).drop("terms", "whole")
    both = in_lang.join(groups, ["lang", "source"]).withColumn("p", _share(F.col("n"))).where("p > q").withColumn("value", _gap("p", "q"))
    best = both.withColumn("rank", F.row_number().over(by.orderBy(F.desc("value"), "ordinal"))).where(F.col("rank") <= top)
    named = best.join(kept.select("lang", "ordinal", F.col("term").cast("string").alias("item")), ["lang", "ordinal"])
    out = ["item", "value", "rank"]
    return pairs.select("lang", "source", F.lit("pair").alias("part"), *out).union(named.select("lang", "source", F.lit("term").alias("part"), *out))


def report(documents: DataFrame) -> DataFrame:
    return audit(need(documents, "lang", "source", "text"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
w AS (SELECT id, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term FROM (SELECT DISTINCT id, lang, term FROM w) GROUP BY 1, 2 HAVING count(*) >= 10),
v AS (SELECT lang, count(*) AS terms FROM kept GROUP BY 1),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT DISTINCT lang, source FROM d),
p AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
  1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 2)) // (sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) + 2 * terms) AS p
  FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
q AS (SELECT lang, term, 1 + (CAST(1000000000 AS HUGEINT) * (sum(n) + 2)) // (sum(sum(n)) OVER (PARTITION BY lang) + 2 * any_value(terms)) AS q FROM p JOIN v USING (lang) GROUP BY 1, 2),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT p.lang, p.source, 'term', p.term, ((p - q) * (p - q)) // (p + q) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM x)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 10"""
