"""Alignment of two tokenizers' tokens over a corpus (operator 12), by exact-text deduplication.

Rows are shuffled by their full text, so that each distinct text is tokenized and aligned once, whatever its number of
copies; the corpus-wide counts weight a text by its copies, and the texts' measures are joined to all their rows again.

Both tokenizers encode a space and the text. Where tokens of both end at the same byte, a group ends; every A token and every
B token of one group are linked. Texts are taken in blocks of :data:`BLOCK_BYTES`: what leaves a task are the block's distinct
pairs of ids with the number of rows that have them, and for each text the places of its own pairs among the block's, as
compressed differences. So what is shuffled to sum the counts is a row for each block and distinct pair, not for each link;
each pair's sum goes back to the blocks that asked, and there every text looks up its pairs by their places. No vocabulary,
count table or group is held whole anywhere but the best count of each A id, which the vocabulary bounds.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landcube.llm.common import materialize, need
from landcube.llm.packing import tokenizer_path

#: Bytes of text in a block; links that are expanded at once; characters of a stretch with or without blanks that is long.
BLOCK_BYTES, LINKS, STRETCH = 4_000_000, 1_000_000, 5_000
MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
ALIGNED = "key binary, n long, block long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, at binary, times binary, pairs array<long>, rows array<long>"


class ByteTokens:
    """The byte-level tokenizer: ids of a text, and the number of bytes of every id.

    With the vocabulary's ranks, texts of settled characters take a faster way to the same ids; the tokenizer itself is
    loaded when the first other text comes.
    """

    def __init__(self, json_path: str, ranks_path: str | None):
        self.json_path, self.fast = json_path, None
        if ranks_path:
            import public_tokenizers
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
            self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            # an id beyond the ranks is a special token, which texts never have
            self.lengths = np.zeros(max(ranks.values()) + 2, np.int64)
            self.lengths[list(ranks.values())] = list(map(len, ranks))
        else:
            # the tokenizer writes a byte as one printable character
            vocabulary = self.whole.get_vocab(with_added_tokens=False)
            self.lengths = np.zeros(max(vocabulary.values()) + 2, np.int64)
            self.lengths[list(vocabulary.values())] = list(map(len, vocabulary))
        # stretches that the faster way's patterns are too deep for, and characters whose classes no version of Unicode moves
        self.stretch = re.compile(rf"\S{{{STRETCH}}}|\s{{{STRETCH}}}").search
        self.settled = re.compile("[\t\n\r\x20-\x7e\xa1-ɏ‐-‧]*").fullmatch

    @cached_property
    def whole(self):
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(self.json_path)
        made.encode_special_tokens = True  # their strings in a text are plain text
        return made

    def __call__(self, text: str) -> np.ndarray:
        if self.fast and self.settled(text) and (len(text) < STRETCH or not self.stretch(text)):
            return np.array(self.fast.encode_ordinary(text), np.int64)
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.int64)


class PieceTokens:
    """The piece tokenizer: ids of a text, and the bytes of every id."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)

    def __call__(self, text: str) -> np.ndarray | None:
        """Ids of a text without the space that the tokenizer adds; None if their bytes aren't that space and the text."""
        ids = self.model.encode(text)
        return np.array(ids, np.int64) if b"".join([self.bytes[i] for i in ids]) == b" " + text.encode() else None


def merged(pairs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs, sorted, with their summed times."""
    order = np.argsort(pairs, kind="stable")
    pairs, times = pairs[order], times[order]
    first = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]]) if len(pairs) else np.zeros(0, np.int64)
    return pairs[first], np.add.reduceat(times, first) if len(first) else times[:0]


def linked(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs a * ``width`` + b over all groups, and how often each is linked. ``na``, ``nb``: tokens by group.

    Groups are expanded together up to :data:`LINKS` links; a group with more is the product of its distinct ids' counts.
    """
    links = na * nb
    ends, end_a, end_b = np.cumsum(links), np.cumsum(na), np.cumsum(nb)
    found, g = [], 0
    while g < len(na):
        stop = max(int(np.searchsorted(ends, (ends[g - 1] if g else 0) + LINKS, "right")), g + 1)
        low_a, low_b = end_a[g] - na[g], end_b[g] - nb[g]
        own_a, own_b = a[low_a : end_a[stop - 1]], b[low_b : end_b[stop - 1]]
        if stop == g + 1 and links[g] > LINKS:
            (ua, ca), (ub, cb) = np.unique(own_a, return_counts=True), np.unique(own_b, return_counts=True)
            found.append(((ua[:, None] * width + ub).ravel(), (ca[:, None] * cb).ravel()))
        else:
            some_a, some_b = na[g:stop], nb[g:stop]
            each = np.repeat(some_b, some_a)  # how many links an A token has
            first = np.repeat(np.cumsum(some_b) - some_b, some_a)
            at = np.arange(each.sum()) + np.repeat(first - (np.cumsum(each) - each), each)
            found.append(np.unique(np.repeat(own_a, each) * width + own_b[at], return_counts=True))
        g = stop
    if len(found) == 1:
        return found[0]
    return merged(np.concatenate([p for p, _ in found]), np.concatenate([t for _, t in found]))


class Aligner:
    """Groups, links and their digest of one text under two tokenizers."""

    def __init__(self, a: ByteTokens, b: PieceTokens):
        self.a, self.b, self.width = a, b, len(b.lengths)
        self.shown = [f"{i}{end}" for n, ends in ((len(a.lengths), ",|"), (len(b.lengths), ",;")) for end in ends for i in range(n)]

    def __call__(self, text: str):
        """(n_a, n_b, n_groups, n_links, digest, pairs, times), or None if a tokenizer doesn't give the bytes back."""
        if (b := self.b(text)) is None:
            return None
        ends_b = np.cumsum(self.b.lengths[b])
        n = int(ends_b[-1])
        a = self.a(" " + text)  # a byte-level tokenizer gives back every byte
        ends_a = np.cumsum(self.a.lengths[a])
        if ends_a[-1] != n:
            return None
        mark = np.zeros(n + 1, bool)
        mark[ends_b] = True
        cut_a = mark[ends_a]
        mark[ends_b] = False
        mark[ends_a] = True
        cut_b = mark[ends_b]
        na, nb = np.diff(np.flatnonzero(cut_a), prepend=-1), np.diff(np.flatnonzero(cut_b), prepend=-1)
        pairs, times = linked(a, b, na, nb, self.width)
        # a group's A tokens, then its B tokens
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.repeat(np.cumsum(nb) - nb, na)] = a + len(self.a.lengths) * cut_a
        order[np.arange(len(b)) + np.repeat(np.cumsum(na), nb)] = 2 * len(self.a.lengths) + b + self.width * cut_b
        digest, shown = hashlib.sha256(), self.shown
        for k in range(0, len(order), LINKS):
            part = "".join([shown[i] for i in order[k : k + LINKS].tolist()])
            digest.update((part[:-1] if k + LINKS >= len(order) else part).encode())
        return len(a), len(b), len(na), int((na * nb).sum()), digest.hexdigest(), pairs, times


_OPEN: dict[tuple, Aligner] = {}


def aligner(paths: tuple[str, str | None, str]) -> Aligner:
    """One for each Python worker, which serves many tasks."""
    if paths not in _OPEN:
        _OPEN[paths] = Aligner(ByteTokens(paths[0], paths[1]), PieceTokens(paths[2]))
    return _OPEN[paths]


def packed(values: np.ndarray) -> bytes:
    return zlib.compress(values.astype("<u4").tobytes(), 1)


def unpacked(blob: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob), "<u4").astype(np.int64)


def _block(number: int, texts: list[tuple]) -> pa.RecordBatch:
    """The rows of a block: one for each text, and one with the block's distinct pairs and how many rows have each."""
    every = np.concatenate([pairs for *_, pairs, _ in texts])
    whole, at = np.unique(every, return_inverse=True)
    sizes = np.array([len(pairs) for *_, pairs, _ in texts])
    copies = np.array([n for _, n, *_ in texts], np.int64)
    rows = np.zeros(len(whole), np.int64)
    np.add.at(rows, at, np.repeat(copies, sizes))
    places = [packed(np.diff(p, prepend=0)) for p in np.split(at, np.cumsum(sizes)[:-1])]
    columns: list[list] = [list(c) for c in zip(*[(key, n, number, n_a, n_b, n_groups, n_links, digest) for key, n, n_a, n_b, n_groups, n_links, digest, _, _ in texts], strict=True)]
    columns += [places, [packed(times) for *_, times in texts], [None] * len(texts), [None] * len(texts)]
    for column, value in zip(columns, (None, None, number, None, None, None, None, None, None, None, whole, rows), strict=True):
        column.append(value)
    kinds = [pa.binary(), *[pa.int64()] * 6, pa.string(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in ALIGNED.split(", ")])


def text_key(text: Column) -> Column:
    """What stands for a text once it is tokenized: its SHA-256; null for a null or empty text."""
    return F.when(F.length(text) > 0, F.unhex(F.sha2(text.cast("binary"), 256)))


def tokenizer_paths(byte_level: str = "byte_bpe_50k", pieces: str = "piece_bpe_32k.model") -> tuple[str, str, str]:
    """Of the byte-level tokenizer's two forms, the same vocabulary, and of the piece tokenizer."""
    return tokenizer_path(f"{byte_level}.json"), tokenizer_path(f"{byte_level}.tiktoken"), tokenizer_path(pieces)


def _aligned(documents: DataFrame, paths: tuple[str, str | None, str]) -> DataFrame:
    """Each distinct text once, aligned (key not null), and the blocks' distinct pairs (pairs not null); written."""
    texts = documents.where(F.length("text") > 0).groupBy("text").agg(F.count("*").alias("n")).select("text", "n", text_key(F.col("text")).alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        align, number, held, size = aligner(paths), TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for text, n, key in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (made := align(text)) is None:
                    continue
                held.append((key, n, *made))
                size += len(text)
                if size >= BLOCK_BYTES:
                    yield _block(number, held)
                    number, held, size = number + 1, [], 0
        if held:
            yield _block(number, held)

    return materialize(texts.mapInArrow(run, ALIGNED), "aligned")


def _counted(aligned: DataFrame) -> DataFrame:
    """block, pair, count: every block's distinct pairs with the number of rows of the whole corpus that have each; written."""
    own = aligned.where("pairs is not null").select("block", F.explode(F.arrays_zip("pairs", "rows")).alias("p")).select("block", F.col("p.pairs").alias("pair"), F.col("p.rows").alias("rows"))
    return materialize(own.select("block", "pair", F.sum("rows").over(Window.partitionBy("pair")).alias("count")), "counted")


def _best(counted: DataFrame, width: int) -> DataFrame:
    return counted.groupBy(F.floor(F.col("pair") / width).alias("best_a")).agg(F.max("count").alias("best"))


def pair_counts(documents: DataFrame, paths: tuple[str, str | None, str] | None = None) -> DataFrame:
    """a, b, count, is_best: how many rows have an A id and a B id linked, and whether that is the A id's highest count."""
    paths = paths or tokenizer_paths()
    width = len(PieceTokens(paths[2]).lengths)
    counted = _counted(_aligned(need(documents, "text"), paths))
    once = counted.groupBy("pair").agg(F.first("count").alias("count")).withColumns({"a": F.floor(F.col("pair") / width), "b": F.col("pair") % width})
    best = _best(counted, width)
    joined = once.join(F.broadcast(best), F.col("a") == F.col("best_a"))  # a row for each id of the vocabulary at most
    return joined.select("a", "b", "count", (F.col("count") == F.col("best")).alias("is_best"))


def align(documents: DataFrame, paths: tuple[str, str | None, str] | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row.

    ``paths``: the byte-level tokenizer's json, the same vocabulary as ranks (or None), and the piece tokenizer's model. A
    null or empty text, and one that a tokenizer doesn't give back byte by byte, has no tokens: zeros and ''. Repeated rows
    each count and each get the text's measures. An empty table gives no rows.
    """
    paths = paths or tokenizer_paths()
    width = len(PieceTokens(paths[2]).lengths)
    aligned = _aligned(need(documents, "text"), paths)
    counted = _counted(aligned)
    best = F.broadcast(_best(counted, width))  # a row for each id of the vocabulary at most
    asked = counted.withColumn("a", F.floor(F.col("pair") / width)).join(best, F.col("a") == F.col("best_a"))
    asked = asked.select("block", "pair", "count", (F.col("count") == F.col("best")).alias("is_best"))
    texts = aligned.where("key is not null").drop("n", "pairs", "rows")

    def measured(own: pa.Table, sums: pa.Table) -> pa.Table:
        order = np.argsort(sums["pair"].to_numpy())
        count, is_best = sums["count"].to_numpy()[order], sums["is_best"].to_numpy(zero_copy_only=False)[order]
        n_best, count_sum = [], []
        for at, times in zip(own["at"].to_pylist(), own["times"].to_pylist(), strict=True):
            at, times = np.cumsum(unpacked(at)), unpacked(times)
            n_best.append(int(times[is_best[at]].sum()))
            count_sum.append(int((times * count[at]).sum()))
        kept = own.select(["key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
        return kept.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))

    schema = "key binary, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    found = texts.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(measured, schema).withColumnRenamed("key", "found")
    rows = documents.select("doc_id", text_key(F.col("text")).alias("key"))
    joined = rows.where("key is not null").join(found, F.col("key") == F.col("found"), "left").drop("key", "found")
    # rows without a text don't meet in one task of the join
    zeros = {c: F.coalesce(F.col(c), F.lit(0).cast("long")) for c in MEASURES} | {"groups_sha256": F.coalesce("groups_sha256", F.lit(""))}
    bare = rows.where("key is null").select("doc_id", *[F.lit(0).cast("long").alias(c) for c in MEASURES], F.lit("").alias("groups_sha256"))
    return joined.withColumns(zeros).select("doc_id", *MEASURES, "groups_sha256").unionByName(bare)


def report(documents: DataFrame) -> DataFrame:
    return align(need(documents, "doc_id", "text"))
