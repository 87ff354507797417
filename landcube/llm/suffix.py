"""Removal of bytes that repeat an earlier stretch of ``LENGTH`` bytes, exactly (operator 3).

Texts are byte strings. A stretch's anchor is its ``GRAM``-byte string with the smallest hash, leftmost on ties; equal
stretches have equal anchors at equal places, so all copies of a stretch meet under their anchor's hash. Neighbouring
stretches with one anchor form a segment (at most ``LENGTH - GRAM + 1`` starts), and only segments are shuffled, as hashes:

1. Every task cuts its texts into segments; of equal ones in a batch it keeps the first and marks the others' starts.
2. Under each anchor, segments without a partner drop out, and of equal ones again all but the first are marked.
   Rows arrive sorted, so a task holds a batch of them and one row more, however many share an anchor.
3. Where different segments share an anchor, their bytes are fetched, and a suffix order cut off at ``LENGTH`` bytes tells
   which of their stretches are equal, and which of those is the earliest. Under an anchor with more than ``CROWD``
   different segments every stretch becomes a segment of its own, under its own hash, and step 2 is taken for them.
4. The marked starts of a document are united to removed runs.

An anchor may be in a third of all documents, in as many surroundings: a licence line, say. Anchors with a share of
``1 / HOT`` of the segments or more, at most ``HOT`` of them, are found from a sample of documents; their stretches are
shuffled one by one, each under two hashes of its own bytes, so that such an anchor is dealt over all tasks. Which anchors
those are changes the way of their stretches and not the result.

What counts as earlier is decided by (doc_id, tie, start) everywhere; ``tie``, a hash of the text, tells rows apart that share
a doc_id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landcube.llm.common import materialize, need

LENGTH, GRAM = 100, 32
#: Bytes of text hashed at once (below 2 ** 24), and bytes of segments ordered at once.
PIECE, CHUNK = 800_000, 1_000_000
LOW = np.uint64((1 << 24) - 1)
BASE, OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Least share of a hot anchor (one in HOT), least count, and the sample (one document in SAMPLE) that shows them.
HOT, HOT_COUNT, SAMPLE = 2000, 30, 32
SEGMENTS = "kind int, key long, same long, doc_id long, tie long, start long, n int"
NAMES = [part.split()[0] for part in SEGMENTS.split(", ")]
PLACE = ["doc_id", "tie", "start"]
#: Different segments under one anchor that are ordered together at most: 3.4 MB of bytes, which take some 80 times that.
CROWD = 20_000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


BYTES = _mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * BASE)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


UP, DOWN, UP2, DOWN2 = (_powers(b, PIECE + 2 * LENGTH) for b in (BASE, INVERSE, OTHER, np.uint64(pow(int(OTHER), -1, 1 << 64))))


def segments(texts: list[tuple[int, int, bytes]], hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text number, start, n, key, same) of the segments of pieces (text number, offset, bytes), together below PIECE.

    Under a hot key each stretch is a segment of its own, keyed by itself.
    """
    sizes = np.array([len(t) for _, _, t in texts])
    at = np.cumsum(sizes) - sizes
    raw = BYTES[np.frombuffer(b"".join(t for _, _, t in texts), np.uint8)]
    total = len(raw)
    grams, step = raw, 1
    while step < GRAM:
        grams = grams[:-step] * UP[step] + grams[step:]
        step *= 2
    grams = _mixed(grams)
    least = (grams & ~LOW) | np.arange(len(grams), dtype=np.uint64)
    width, step = LENGTH - GRAM + 1, 1
    while 2 * step <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    least = np.minimum(least[: len(least) - (width - step)], least[width - step :])
    anchors = (least & LOW).astype(np.int64)
    valid = np.zeros(total + 1, np.int8)
    np.add.at(valid, at, 1)
    np.add.at(valid, at + sizes - LENGTH + 1, -1)
    valid = np.cumsum(valid)[: len(anchors)].astype(bool)
    cut = np.ones(len(anchors) + 1, bool)
    cut[1:-1] = (anchors[1:] != anchors[:-1]) | (valid[1:] != valid[:-1])
    cut[at[at < len(anchors)]] = True
    begins = np.flatnonzero(cut)
    n = np.diff(begins)
    begins = begins[:-1]
    good = valid[begins]
    begins, n = begins[good], n[good]
    sums = np.zeros(total + 1, np.uint64)
    np.cumsum(raw * UP[:total], dtype=np.uint64, out=sums[1:])
    same = _mixed((sums[begins + n + LENGTH - 1] - sums[begins]) * DOWN[begins] + n.astype(np.uint64))
    key = grams[anchors[begins]]
    split = np.isin(key.view(np.int64), hot)
    if split.any():
        each = n[split]
        alone = np.repeat(begins[split], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        other = np.zeros(total + 1, np.uint64)
        np.cumsum(raw * UP2[:total], dtype=np.uint64, out=other[1:])
        key = np.concatenate([key[~split], _mixed((sums[alone + LENGTH] - sums[alone]) * DOWN[alone])])
        same = np.concatenate([same[~split], _mixed((other[alone + LENGTH] - other[alone]) * DOWN2[alone])])
        begins, n = np.concatenate([begins[~split], alone]), np.concatenate([n[~split], np.ones(len(alone), n.dtype)])
    text = np.searchsorted(at, begins, "right") - 1
    own = np.array([i for i, _, _ in texts]), np.array([o for _, o, _ in texts])
    return own[0][text], begins - at[text] + own[1][text], n, key.view(np.int64), same.view(np.int64)


def firsts(key: np.ndarray, same: np.ndarray, doc: np.ndarray, tie: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by equal segments, earliest first; and which rows in that order are later than an equal one.

    Rows at one place, from rows with equal doc_id and text, are not later than each other.
    """
    order = np.lexsort((start, tie, doc, n, same, key))
    k, s, m, d, t, a = (x[order] for x in (key, same, n, doc, tie, start))
    head = heads(k, s, m)
    return order, (d != d[head]) | (t != t[head]) | (a != a[head])


def heads(key: np.ndarray, same: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For rows sorted by segments the first row of each row's segment."""
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (same[1:] != same[:-1]) | (n[1:] != n[:-1])
    return np.flatnonzero(new)[np.cumsum(new) - 1]


def _out(kind: int | np.ndarray, rows: list[np.ndarray], which: np.ndarray) -> pa.RecordBatch:
    """The rows (key, same, doc_id, tie, start, n) at ``which`` (a mask or places) as a batch of segments."""
    *longs, n = (x[which] for x in rows)
    kinds = np.full(len(n), kind, np.int32) if isinstance(kind, int) else kind.astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(kinds), *(pa.array(x.astype(np.int64)) for x in longs), pa.array(n.astype(np.int32))], names=NAMES)


def cut(documents: DataFrame, hot: list[int]) -> DataFrame:
    """Segments (kind 0) and marked starts (kind 1) of documents (doc_id, tie, text as bytes)."""
    keys = np.array(hot, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ties = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            held, size, found = [], 0, []
            for i, text in enumerate(batch.column(2).to_pylist()):
                for o in range(0, len(text) - LENGTH + 1, PIECE // 2):  # a long text in pieces that overlap
                    piece = text[o : o + PIECE // 2 + LENGTH - 1]
                    if size + len(piece) > PIECE:
                        found.append(segments(held, keys))
                        held, size = [], 0
                    held.append((i, o, piece))
                    size += len(piece)
            if held:
                found.append(segments(held, keys))
            if found:
                text, start, n, key, same = (np.concatenate(c) for c in zip(*found, strict=True))
                doc, tie = ids[text], ties[text]
                order, later = firsts(key, same, doc, tie, start, n)
                yield _out(later, [key, same, doc, tie, start, n], order)

    return documents.mapInArrow(run, SEGMENTS)


def hot_anchors(documents: DataFrame) -> list[int]:
    """Keys of at least one in HOT of a sample's segments; so at most HOT keys, whatever the data's size."""
    some = cut(documents.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0), []).where("kind = 0")
    counted = some.groupBy("key").agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n")).first()[0] or 0
    return [r["key"] for r in counted.where((F.col("n") >= HOT_COUNT) & (F.col("n") * HOT >= total)).orderBy(F.desc("n"), "key").limit(HOT).collect()]


def grouped(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by ``column``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(column).to_numpy(zero_copy_only=False)
        change = np.flatnonzero(keys != keys[-1])
        if not len(change) and (not held or held[-1].column(column)[-1].as_py() == keys[-1]):
            held.append(batch)
            continue
        split = int(change[-1]) + 1 if len(change) else 0
        yield pa.Table.from_batches([*held, batch.slice(0, split)])
        held = [batch.slice(split)]
    if held:
        yield pa.Table.from_batches(held)


def matched(cut_out: DataFrame) -> DataFrame:
    """Marked starts (kind 1) and different segments that share an anchor (kind 2).

    Of the rows before a batch one is kept: the first of the last segment, and whether it has been sent on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, sent = None, False
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            rows = [batch.column(c).to_numpy() for c in NAMES[1:]]
            if (kind == 1).any():
                yield _out(1, rows, kind == 1)
            rows = [x[kind != 1] for x in rows]
            if not len(rows[0]):
                continue
            if kept is not None:
                rows = [np.concatenate([a, b]) for a, b in zip(kept, rows, strict=True)]
            key, same, doc, tie, start, n = rows
            head = heads(key, same, n)
            later = (doc != doc[head]) | (tie != tie[head]) | (start != start[head])
            yield _out(1, rows, later)
            own = np.flatnonzero(head == np.arange(len(head)))
            near = key[own][1:] == key[own][:-1]
            shared = np.zeros(len(own), bool)
            shared[1:] |= near
            shared[:-1] |= near
            last = bool(shared[-1]) or (len(own) == 1 and sent)
            if kept is not None and sent:
                shared[0] = False
            yield _out(2, rows, own[shared])
            kept, sent = [x[own[-1] :][:1] for x in rows], last

    deal = F.when(F.col("kind") == 1, F.xxhash64(*PLACE)).otherwise(F.col("key"))
    ordered = cut_out.withColumn("deal", deal).repartition("deal").sortWithinPartitions("deal", "kind", "same", "n", *PLACE)
    return ordered.mapInArrow(run, SEGMENTS)


def later_starts(texts: list[bytes], places: np.ndarray) -> list[tuple[int, int]]:
    """(text number, start) of every stretch that an earlier place has too; ``places`` order the texts (lower is earlier).

    Ranks of 7 bytes are doubled to 14, 28 and 56, and two of 56 make the rank of exactly LENGTH bytes.
    """
    sizes = np.array([len(t) for t in texts])
    at = np.cumsum(sizes + 1) - sizes - 1
    joined = np.concatenate([np.append(np.frombuffer(t, np.uint8).astype(np.int64) + 1, 0) for t in texts])
    n = len(joined)

    def ahead(x: np.ndarray, by: int) -> np.ndarray:
        return np.concatenate([x[by:], np.zeros(min(by, n), x.dtype)])[:n]

    rank = np.zeros(n, np.int64)
    for j in range(7):
        rank = rank * 257 + ahead(joined, j)
    rank = np.unique(rank, return_inverse=True)[1]
    for by in (7, 14, 28, LENGTH - 56):
        rank = np.unique(rank * np.int64(n + 1) + ahead(rank, by), return_inverse=True)[1]
    text = np.repeat(np.arange(len(texts)), sizes + 1)
    offset = np.arange(n) - at[text]
    ok = offset <= sizes[text] - LENGTH
    rows = np.flatnonzero(ok)
    order = rows[np.lexsort((offset[rows], places[text[rows]], rank[rows]))]
    # rows of one class stand together, earliest first
    new = np.ones(len(order), bool)
    new[1:] = rank[order][1:] != rank[order][:-1]
    later = order[~new]
    return list(zip(text[later].tolist(), offset[later].tolist(), strict=True))


def wanted_texts(shared: DataFrame, documents: DataFrame) -> DataFrame:
    """doc_id, tie, text and wanted (key, start, n of its segments) of the documents that segments lie in."""
    wanted = shared.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("key", "start", "n")).alias("wanted"))
    return documents.join(wanted, ["doc_id", "tie"]).select("doc_id", "tie", "text", "wanted")


def fetched(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, int, bytes]]:
    """key, doc_id, tie, start and bytes of the segments wanted."""
    flat = batch.column(3).flatten()
    key, start, n = (pc.struct_field(flat, c).to_pylist() for c in ("key", "start", "n"))
    at = 0
    for doc, tie, text, count in zip(*(batch.column(c).to_pylist() for c in range(3)), pc.list_value_length(batch.column(3)).to_pylist(), strict=True):
        for i in range(at, at + count):
            yield key[i], doc, tie, start[i], text[start[i] : start[i] + n[i] + LENGTH - 1]
        at += count


MARKS = "doc_id long, tie long, start long, n int"


def resolved(shared: DataFrame, documents: DataFrame) -> DataFrame:
    """Marked starts among different segments that share an anchor, from their bytes."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 4 + [pa.binary()]
        for batch in batches:
            columns = list(zip(*fetched(batch), strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["key", "doc_id", "tie", "start", "part"])

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tell(held: list[pa.Table]) -> pa.RecordBatch:
            t = pa.concat_tables(held)
            doc, tie, start = (t.column(c).to_numpy() for c in PLACE)
            place = np.empty(len(doc), np.int64)
            place[np.lexsort((start, tie, doc))] = np.arange(len(doc))
            found = later_starts(t.column("part").to_pylist(), place)
            i, o = (np.array([f[c] for f in found], np.int64) for c in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(doc[i]), pa.array(tie[i]), pa.array(start[i] + o), pa.array(np.ones(len(i), np.int32))], names=[*PLACE, "n"])

        held, size = [], 0
        for t in grouped(batches, "key"):
            held.append(t)
            size += t.nbytes
            if size > CHUNK:
                yield tell(held)
                held, size = [], 0
        if held:
            yield tell(held)

    parts = wanted_texts(shared, documents).mapInArrow(fetch, "key long, doc_id long, tie long, start long, part binary").distinct()
    return parts.repartition("key").sortWithinPartitions("key").mapInArrow(order, MARKS)


def resolved_one_by_one(shared: DataFrame, documents: DataFrame) -> DataFrame:
    """The same for crowded anchors: every stretch is a segment of its own, under 128 bits of its own hash."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            digests, places = [], []
            for _, doc, tie, start, part in fetched(batch):
                for i in range(len(part) - LENGTH + 1):
                    digests.append(xxhash.xxh3_128_digest(part[i : i + LENGTH]))
                    places.append((doc, tie, start + i))
            own = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            place = np.array(places, np.int64).reshape(-1, 3)
            yield _out(0, [own[:, 0], own[:, 1], *place.T, np.ones(len(own))], np.arange(len(own)))

    return matched(wanted_texts(shared, documents).mapInArrow(fetch, SEGMENTS)).where("kind = 1").select(*PLACE, "n")


def removed_runs(documents: DataFrame) -> DataFrame:
    """doc_id, tie and marks (start, n), of the rows (doc_id, tie, text) that have any: stretches that occur earlier."""
    found = materialize(matched(cut(documents, hot_anchors(documents))), "segments")
    shared = found.where("kind = 2")
    crowded = materialize(shared.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > CROWD).select("key"), "crowded")
    calm, dense = shared.join(crowded, "key", "left_anti"), shared.join(crowded, "key", "left_semi")
    marks = found.where("kind = 1").select(*PLACE, "n").union(resolved(calm, documents))
    if not crowded.isEmpty():
        marks = marks.union(resolved_one_by_one(dense, documents))
    return marks.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("start", "n")).alias("marks"))


def union_of(row: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The row, begin and end of the maximal runs that marks cover, in order."""
    order = np.lexsort((start, row))
    begin = (row[order].astype(np.int64) << 40) + start[order]
    reach = np.maximum.accumulate(begin + n[order] + LENGTH - 1)
    new = np.ones(len(order), bool)
    new[1:] = begin[1:] > reach[:-1]
    last = np.append(np.flatnonzero(new)[1:], len(order)) - 1 if len(order) else np.array([], np.int64)
    own = begin[new] >> 40
    return own, begin[new] - (own << 40), reach[last] - (own << 40)


def dedup_bytes(documents: DataFrame) -> DataFrame:
    """doc_id, kept (bytes), n_bytes and spans (removed runs) of each document row.

    A null text is empty. Rows that share a doc_id, or have none, are judged and cut each for itself, in the order of a hash
    of their texts; rows with equal doc_id and text count as one place and do not remove each other. A null doc_id counts
    as the smallest number. An empty table gives no rows; extra columns are ignored.
    """
    null = F.lit(-(2**63)).cast("long")
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    texts = need(documents, "doc_id", "text").select(F.coalesce("doc_id", null).alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    joined = texts.join(removed_runs(texts), ["doc_id", "tie"], "left").select("doc_id", "text", "marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks, flat = batch.column(2), batch.column(2).flatten()
            row = np.repeat(np.arange(len(marks)), pc.fill_null(pc.list_value_length(marks), 0).to_numpy(zero_copy_only=False))
            start, n = (pc.struct_field(flat, c).to_numpy(zero_copy_only=False) for c in ("start", "n"))
            own, begin, end = union_of(row, start, n)
            edges = np.searchsorted(own, np.arange(len(marks) + 1))
            texts, kept = batch.column(1).to_pylist(), []
            for i, text in enumerate(texts):
                a, b = edges[i], edges[i + 1]
                kept.append(text if a == b else b"".join([text[x:y] for x, y in zip([0, *end[a:b].tolist()], [*begin[a:b].tolist(), len(text)], strict=True)]))
            spans = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.StructArray.from_arrays([pa.array(begin), pa.array(end)], ["begin", "end"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), pa.array([len(t) for t in texts], pa.int64()), spans], names=["doc_id", "kept", "n_bytes", "spans"])

    made = joined.mapInArrow(run, "doc_id long, kept binary, n_bytes long, spans array<struct<begin: long, end: long>>")
    return made.withColumn("doc_id", F.nullif("doc_id", null))


def report(documents: DataFrame) -> DataFrame:
    """The contract's columns."""
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["begin"])
    return dedup_bytes(documents).select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: dict[int, bytes]) -> dict[int, tuple[int, int, int, str]]:
    """The same by a table of all stretches; for tests."""
    seen: set[bytes] = set()
    out = {}
    for doc in sorted(texts):
        text, gone = texts[doc], bytearray(len(texts[doc]))
        for i in range(len(text) - LENGTH + 1):
            own = text[i : i + LENGTH]
            if own in seen:
                gone[i : i + LENGTH] = b"\1" * LENGTH
            seen.add(own)
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(b for b, g in zip(text, gone, strict=True) if not g)
        out[doc] = (len(text), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


ORACLE_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT rid, doc_id, st, md5(substr(h, 2 * st + 1, 200)) AS g FROM (SELECT rid, doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS st FROM d)),
later AS (SELECT rid, st FROM s QUALIFY rank() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, st) > 1),
step AS (SELECT *, CASE WHEN st <= lag(st) OVER (PARTITION BY rid ORDER BY st) + 100 THEN 0 ELSE 1 END AS new FROM later),
run AS (SELECT rid, min(st) AS a, max(st) + 100 AS b FROM (SELECT *, sum(new) OVER (PARTITION BY rid ORDER BY st) AS k FROM step) GROUP BY rid, k),
edge AS (SELECT rid, a, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS z FROM (SELECT rid, a, b FROM run UNION ALL SELECT rid, len(h) // 2, NULL FROM d)),
kept AS (SELECT rid, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS k FROM edge JOIN d USING (rid) GROUP BY rid),
cut AS (SELECT rid, sum(b - a) AS n, count(*) AS m FROM run GROUP BY rid)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(m, 0) AS BIGINT) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept USING (rid) LEFT JOIN cut USING (rid)
"""
