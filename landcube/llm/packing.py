"""Best-fit packing of tokenized documents into sequences of bounded length (operator 6).

Bulk-synchronous best fit. Lengths are integers from 1 to ``capacity``, so documents and gaps are range-sorted by counting
them per length, longest first. One superstep takes all pieces of one length, sweeps over the open gaps from the smallest
that fits upwards (the successor sweep), gives each gap as many of the pieces as fit and opens new sequences for the rest;
then the gaps are updated and the next length follows. Which piece goes into which gap of a superstep is settled by the
piece's rank among those of its length. A superstep needs counts only, at most ``capacity`` of them; so the plan is made of
counts, and every executor places its own pieces by rank. No piece passes through the driver and no data row is shuffled
but for its small (length, rank) record.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landcube.llm.common import materialize, need

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, nth long"
#: Words kept with their ids in a Python worker.
CACHED_WORDS = 400_000


class WordIds:
    """Token ids of texts for a tokenizer whose pre-tokens never span white space.

    A text's ids are those of its words one after another, so ids are looked up by word, and for a new word by its
    pre-tokens, which go straight to the tokenizer's merges. Words with characters whose case or composition depends on
    context go to the tokenizer whole, and so do texts that hold a special token.
    """

    #: The tokenizer's own pre-token pattern (fixed value).
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.split = regex.compile(self.PATTERN).findall
        self.plain = regex.compile(r"[\x21-\x7e\xa1-\xac\xae-įı-ňŊ-ž]+").fullmatch
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # the tokenizer writes a byte as a printable character: itself, or the next one from 256 on
        shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
        self.bytes = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in shown)}
        self.words: dict[bytes, bytes] = {}

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def part(self, part: bytes) -> bytes:
        """Ids of one lower-case pre-token."""
        return b"".join([t.id.to_bytes(4, "little") for t in self.merge(part.decode("latin-1").translate(self.bytes))])

    def word(self, word: bytes) -> bytes:
        if word.isalpha():
            ids = self.part(word.lower())
        elif self.plain(text := word.decode()):
            text = text.lower()
            if text.isalpha():
                parts = [text]
            elif text[-1] in ".,;:!?" and text[:-1].isalpha():
                parts = [text[:-1], text[-1]]
            else:
                parts = self.split(text)
            ids = b"".join([self.words.get(p) or self.part(p) for p in map(str.encode, parts)])
        else:
            ids = self.encode(text)
        if len(self.words) >= CACHED_WORDS:  # the words met first stay: frequent ones are among them
            first = list(islice(self.words.items(), CACHED_WORDS // 2))
            self.words.clear()
            self.words.update(first)
        self.words[word] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self.encode(text)
        get, word = self.words.get, self.word
        return b"".join([get(w) or word(w) for w in text.encode("utf-8", "replace").split()])


_OPEN: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One table of words for each Python worker, which serves many tasks; so a word is rarely tokenized twice."""
    if path not in _OPEN:
        _OPEN[path] = WordIds(path)
    return _OPEN[path]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(documents: DataFrame, capacity: int = 2048, end_id: int = 0, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: its place in the document, length, checksum, writing task and rank among the task's equal lengths."""
    path = tokenizer or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        ids_of, seen, end = word_ids(path), [0] * (capacity + 1), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [], [])
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = ids_of(text or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    n = len(own) // 4
                    for column, value in zip(out, (doc, k, at // 4, n, zlib.crc32(own), part, seen[n]), strict=True):
                        column.append(value)
                    seen[n] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return need(documents, "doc_id", "text").mapInArrow(run, PIECES)


def best_fit_plan(counts: dict[int, int], capacity: int) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each length, longest first: (first rank, first sequence, pieces per sequence, offset) of runs of ranks.

    ``counts`` has at most ``capacity`` entries, whatever the data's size. Gaps of one size are kept as runs of sequence
    numbers, oldest first.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}
    plan: dict[int, list[tuple[int, int, int, int]]] = {}
    opened = 0
    for length in sorted(counts, reverse=True):
        left, rank, runs, moved = counts[length], 0, [], []
        for gap in sorted(g for g in gaps if g >= length):
            if not left:
                break
            each, rest = gap // length, []
            for first, n in gaps.pop(gap):
                whole = min(n, left // each)
                if whole:
                    runs.append((rank, first, each, capacity - gap))
                    moved.append((gap - each * length, first, whole))
                    rank, left = rank + whole * each, left - whole * each
                if whole < n and 0 < left < each:
                    runs.append((rank, first + whole, left, capacity - gap))
                    moved.append((gap - left * length, first + whole, 1))
                    rank, left, whole = rank + left, 0, whole + 1
                if whole < n:
                    rest.append((first + whole, n - whole))
            if rest:
                gaps[gap] = rest
        if left:
            each = capacity // length
            whole, over = divmod(left, each)
            if whole:
                runs.append((rank, opened, each, 0))
                moved.append((capacity - each * length, opened, whole))
                rank, opened = rank + whole * each, opened + whole
            if over:
                runs.append((rank, opened, over, 0))
                moved.append((capacity - over * length, opened, 1))
                opened += 1
        for gap, first, n in moved:
            if gap:
                gaps.setdefault(gap, []).append((first, n))
        plan[length] = runs
    return plan


def pack(documents: DataFrame, capacity: int = 2048, end_id: int = 0, tokenizer: str | None = None) -> DataFrame:
    """Pack every document into sequences of at most ``capacity`` tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. Only documents over ``capacity`` are cut. Null and
    empty texts are the end id alone. Repeated rows are packed each for itself; an empty table gives no rows.
    """
    made = materialize(pieces(documents, capacity, end_id, tokenizer), "pieces")
    tally = materialize(made.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tally.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    counts = {r["length"]: r["n"] for r in tally.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = best_fit_plan(counts, capacity)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = {length: [run[0] for run in runs] for length, runs in plan.items()}
        for batch in batches:
            sequence, offset = [], []
            for length, rank in zip(batch.column("length").to_pylist(), batch.column("rank").to_pylist(), strict=True):
                first, start, each, at = plan[length][bisect_right(firsts[length], rank) - 1]
                q, r = divmod(rank - first, each)
                sequence.append(start + q)
                offset.append(at + r * length)
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = made.join(offsets, ["length", "part"]).select("doc_id", "piece", "start", F.col("length").cast("long"), "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
