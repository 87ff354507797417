"""Document scores of a hidden Markov language model (operator 10).

Token counts of the training documents are formed by Spark over the whole corpus. The ``SYMBOLS`` most frequent words and
the end of a text are symbols of their own; every other word, seen or not, has the symbol of its class, which its last
bytes decide, and within the class its share of the base distribution. The number of classes grows with the square root of
the vocabulary, so what the states learn grows with the corpus while the table of parameters stays small. The model is a
distribution over all words. Start values come from a bounded sample of documents; then each Baum-Welch pass takes the
expected counts of all training documents, every task over its own, summed by Spark. Texts are taken whole: long ones are
worked on in stretches side by side, joined by the stretches' transfer matrices, which is exact. A text's likelihood is the
scaled forward recursion over the whole text. Counts of words beyond the ``TOP`` most frequent are joined to the documents
by a shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import isqrt, log10
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landcube.llm.common import materialize, need, remainder

#: Words with symbols of their own, words whose counts every task holds, states, documents to start from, passes over all.
SYMBOLS, TOP, STATES, START_DOCUMENTS, START_PASSES, PASSES = 40_000, 150_000, 6, 400, 8, 2
#: Classes of other words for the square root of their number, and the bytes at a word's end that decide its class.
CLASSES, ENDING = 16, 3
#: Most cells of documents worked on at once, tokens of a stretch in training, words counted before they are sent on.
CELLS, STRETCH, HELD = 300_000, 1024, 200_000


def tokens(text: str | None) -> list[bytes]:
    """A-Z in lower case, split at ASCII white space, as UTF-8."""
    return (text or "").encode("utf-8", "replace").lower().split()


def word_counts(documents: DataFrame) -> DataFrame:
    """word (UTF-8) and c over ``documents`` (text); every task sends partial counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def sent() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "c"])
            held.clear()
            return batch

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(tokens(text))
                if len(held) > HELD:
                    yield sent()
        yield sent()

    return documents.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """Base distribution: counts of the frequent words with their symbols (by rank; of the others, -1), of the end, totals.

    Symbols are the most frequent words, then the classes, then the end. ``classed`` has (sum of counts, words) of all words
    of a class, by class.
    """

    def __init__(self, frequent: list[tuple[bytes, int]], ends: int, n: int, v: int, classes: int, classed: dict[int, tuple[int, int]]):
        frequent = sorted(frequent, key=lambda x: (-x[1], x[0]))
        self.symbols, self.classes = min(SYMBOLS, len(frequent)), classes
        self.ends, self.n, self.v = ends, n, v
        self.total = n + 0.5 * (v + 1)
        self.words = {w: (c, k if k < self.symbols else -1) for k, (w, c) in enumerate(frequent)}
        self.size = self.symbols + classes + 1
        sums, words = np.zeros(classes), np.zeros(classes)
        for k, (c, m) in classed.items():
            sums[k], words[k] = c, m
        for w, c in frequent[: self.symbols]:
            k = self.class_of(w)
            sums[k], words[k] = sums[k] - c, words[k] - 1
        self.mass = np.zeros(self.size)
        self.mass[: self.symbols] = [(c + 0.5) / self.total for _, c in frequent[: self.symbols]]
        self.mass[self.symbols : -1] = (sums + 0.5 * words + 0.5 / classes) / self.total  # unseen words spread over the classes
        self.mass[-1] = (ends + 0.5) / self.total

    def class_of(self, word: bytes) -> int:
        return crc32(word[-ENDING:]) % self.classes

    def base(self, c: int) -> float:
        return log10((c + 0.5) / self.total)


def vocabulary(counts: DataFrame, ends: int) -> Vocabulary:
    """The ``TOP`` most frequent words or somewhat fewer: those above a step of counts, found from a bounded histogram."""
    step = F.floor(F.log2("c") * 8).cast("int")
    found, least = 0, None
    n = v = 0
    for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.sum("c").alias("c")).orderBy(F.desc("step")).collect():
        n, v = n + r["c"], v + r["words"]
        if found is not None and found + r["words"] <= TOP:
            found, least = found + r["words"], r["step"]
        else:
            found = None
    rows = counts.where(step >= least).collect() if least is not None else []
    classes = CLASSES * (isqrt(max(0, v - SYMBOLS)) + 1)
    ending = F.substring("word", -ENDING, ENDING)  # of a shorter word all of it
    own = F.pmod(F.crc32(F.when(F.octet_length("word") > ENDING, ending).otherwise(F.col("word"))), F.lit(classes)).alias("k")
    classed = {r["k"]: (r["c"], r["m"]) for r in counts.groupBy(own).agg(F.sum("c").alias("c"), F.count("*").alias("m")).collect()}
    return Vocabulary([(bytes(r["word"]), r["c"]) for r in rows], ends, n + ends, v + (ends > 0), classes, classed)


ENCODED = "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, pool double, symbols binary, rare array<binary>"


def encode(documents: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """A row per document: sums over tokens whose count is at hand, symbols, and the words to look up."""
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)  # at most TOP words
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.binary())]
    names = [part.split()[0] for part in ENCODED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        vocab, rid = shared.value, TaskContext.get().partitionId() << 33
        get, base, shares = vocab.words.get, {}, np.log10(vocab.mass)
        first, end, classes, none = vocab.symbols, vocab.size - 1, vocab.classes, (None, -1)
        for batch in batches:
            out: list[list] = [[] for _ in kinds]
            for doc, held, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                words = tokens(text)
                found = [get(w, none) for w in words]
                rare = [w for w, f in zip(words, found, strict=True) if f[0] is None]
                known = Counter(f for f in found if f[0] is not None)
                total, pool = vocab.base(vocab.ends), 0.0
                for (c, symbol), k in known.items():
                    b = base.get(c)
                    if b is None:
                        b = base[c] = vocab.base(c)
                    total += k * b
                    if symbol < 0:
                        pool += k * b
                symbols = np.array([*(f[1] if f[1] >= 0 else first + crc32(w[-ENDING:]) % classes for w, f in zip(words, found, strict=True)), end], np.uint32)
                pool -= float(shares[symbols[(symbols >= first) & (symbols < end)]].sum())
                row = (rid, doc, held, len(words) + 1, len(words) - len(rare) + (vocab.ends > 0), total, pool, symbols.tobytes(), rare)
                rid += 1
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    return documents.select("doc_id", "held_out", "text").mapInArrow(run, ENCODED)


class Hmm:
    """start (S), trans (S, S) and emit (symbols, S), each row or column a distribution."""

    def __init__(self, start: np.ndarray, trans: np.ndarray, emit: np.ndarray):
        self.start, self.trans, self.emit = start, trans, emit

    @staticmethod
    def grouped(texts: list[np.ndarray]) -> Iterator[list[int]]:
        """Numbers of texts of like length, longest first, at most ``CELLS`` cells (or one text) at once."""
        order, own = sorted(range(len(texts)), key=lambda i: -len(texts[i])), []
        for i in order:
            if own and len(texts[own[0]]) * (len(own) + 1) > CELLS:
                yield own
                own = []
            own.append(i)
        if own:
            yield own

    def log10_likelihoods(self, texts: list[np.ndarray]) -> np.ndarray:
        """Scaled forward recursion over whole texts, many at once; texts that have ended drop out."""
        out = np.zeros(len(texts))
        for own in self.grouped(texts):
            wide, left = self.laid_out(texts, own)
            scales, alpha = np.ones(wide.shape), None
            for t, n in enumerate(left):
                step = self.start[None, :].repeat(n, 0) if t == 0 else alpha[:n] @ self.trans
                step *= self.emit[wide[t, :n]]
                z = step.sum(axis=1)
                scales[t, :n] = z
                alpha = step / z[:, None]
            out[own] = np.log10(scales).sum(axis=0)
        return out

    def laid_out(self, texts: list[np.ndarray], own: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols by place and text, texts longest first, and how many texts are left at each place."""
        lengths = np.array([len(texts[i]) for i in own])
        wide = np.zeros((lengths[0], len(own)), np.uint32)
        for j, i in enumerate(own):
            wide[: lengths[j], j] = texts[i]
        return wide, np.searchsorted(-lengths, -np.arange(lengths[0]), "left")

    def borders(self, cut: list[np.ndarray], first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For stretches, each text's one after another: the forward vector before each and the backward vector after it.

        A stretch's transfer matrix is the product of its steps, formed for all stretches side by side; a text's vectors
        follow from its stretches' matrices.
        """
        s = len(self.start)
        ahead, behind = np.full((len(cut), s), 1 / s), np.ones((len(cut), s))
        inner = np.flatnonzero(~first | np.append(~first[1:], False))  # of texts with more than one
        moves = np.empty((len(cut), s, s))
        for own in self.grouped([cut[i] for i in inner]):
            at = inner[own]
            wide, left = self.laid_out(cut, at.tolist())
            step = np.where(first[at][:, None, None], self.start[None, None, :], self.trans[None])
            for t, n in enumerate(left):
                step[:n] = (step[:n] if t == 0 else step[:n] @ self.trans) * self.emit[wide[t, :n]][:, None, :]
                step[:n] /= step[:n].sum(axis=(1, 2), keepdims=True)
            moves[at] = step
        for i in inner:
            if not first[i]:
                v = ahead[i - 1] @ moves[i - 1]
                ahead[i] = v / v.sum()
        for i in inner[::-1]:
            if not first[i]:
                v = moves[i] @ behind[i]
                behind[i - 1] = v / v.sum()
        return ahead, behind

    def counts(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected starts, transitions and emissions of whole texts, worked on in stretches of ``STRETCH`` symbols."""
        s = len(self.start)
        starts, moves, shown = np.zeros(s), np.zeros((s, s)), np.zeros(self.emit.shape)
        cut = [t[a : a + STRETCH] for t in texts for a in range(0, len(t), STRETCH)]
        first = np.array([a == 0 for t in texts for a in range(0, len(t), STRETCH)], bool)
        ahead_of, behind_of = self.borders(cut, first)
        for own in self.grouped(cut):
            wide, left = self.laid_out(cut, own)
            begins, before = first[own], ahead_of[own]
            alphas, ahead = [], []
            for t, n in enumerate(left):
                e = self.emit[wide[t, :n]]
                step = (np.where(begins[:, None], self.start[None, :], before @ self.trans) if t == 0 else alphas[-1][:n] @ self.trans) * e
                z = step.sum(axis=1, keepdims=True)
                alphas.append(step / z)
                ahead.append(e / z)
            ends = behind_of[own]
            at = np.array([len(cut[i]) for i in own]) - 1
            last = np.array([alphas[t][j] for j, t in enumerate(at)])
            ends = ends / (last * ends).sum(axis=1, keepdims=True)
            beta, gammas = ends[: left[-1]].copy(), [None] * len(left)
            for t in range(len(left) - 1, -1, -1):
                gammas[t] = alphas[t] * beta
                nxt = ahead[t] * beta
                if t:
                    moves += alphas[t - 1][: left[t]].T @ nxt
                    beta = ends[: left[t - 1]].copy()
                    beta[: left[t]] = nxt @ self.trans.T
                else:
                    moves += before[~begins].T @ nxt[~begins]
            starts += gammas[0][begins].sum(axis=0)
            gamma, flat = np.concatenate(gammas), np.concatenate([wide[t, :n] for t, n in enumerate(left)])
            for k in range(s):
                shown[:, k] += np.bincount(flat, weights=gamma[:, k], minlength=len(shown))
        return starts, moves * self.trans, shown

    @staticmethod
    def fitted(starts: np.ndarray, moves: np.ndarray, shown: np.ndarray, mass: np.ndarray) -> Hmm:
        """Maximisation, with a little of the base distribution mixed into every state."""
        shown = shown + 1e-9 + 50 * mass[:, None]
        return Hmm((starts + 1) / (starts + 1).sum(), (moves + 1) / (moves + 1).sum(axis=1, keepdims=True), shown / shown.sum(axis=0))


def start_model(texts: list[np.ndarray], mass: np.ndarray) -> Hmm:
    """States begin as documents that are unlike one another; then a few passes over the sample."""
    texts_long = [t for t in texts if len(t) > 20]

    def profile(i: int) -> np.ndarray:
        p = np.bincount(texts_long[i], minlength=len(mass)) + 200 * mass if texts_long else mass
        return p / p.sum()

    chosen, nearest = [profile(0)], np.full(max(1, len(texts_long)), np.inf)
    while len(chosen) < STATES:
        nearest = np.minimum(nearest, [np.abs(profile(i) - chosen[-1]).sum() for i in range(len(nearest))])
        chosen.append(profile(int(nearest.argmax())))
    tilt = 1 + 0.01 * np.arange(STATES)  # equal profiles must not stay equal states
    emit = np.stack(chosen, axis=1) ** tilt
    stay = np.full((STATES, STATES), 0.1 / STATES) + 0.9 * np.eye(STATES)
    model = Hmm(np.full(STATES, 1 / STATES), stay, emit / emit.sum(axis=0))
    for _ in range(START_PASSES if texts else 0):
        model = Hmm.fitted(*model.counts(texts), mass)
    return model


def read_symbols(batch: pa.RecordBatch, name: str = "symbols") -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint32) for x in batch.column(name).to_pylist()]


#: Parameters in a block of expected counts, and parts that the tasks' blocks are summed in before the parts are.
BLOCK, PARTS = 4096, 256


def baum_welch(training: DataFrame, model: Hmm, mass: np.ndarray) -> Hmm:
    """One pass over all rows of ``training`` (symbols): expected counts by task, summed by Spark.

    A task sends blocks of its counts, each a binary value, so that neither a shuffle nor the driver has a row for each
    parameter. A block's sums are formed in two steps, so that no group holds the blocks of all tasks.
    """
    s, size = len(model.start), len(mass)
    n = s + s * s + size * s

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(-(-n // BLOCK) * BLOCK)
        for batch in batches:
            total[:n] += np.concatenate([c.ravel() for c in model.counts(read_symbols(batch))])
        blocks = total.reshape(-1, BLOCK)
        at = np.flatnonzero(blocks.any(axis=1))
        part = np.full(len(at), TaskContext.get().partitionId() % PARTS, np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(part), pa.array([b.tobytes() for b in blocks[at]], pa.binary())], names=["block", "part", "counts"])

    def added(key: tuple, own: pa.Table) -> pa.Table:
        whole = np.sum([np.frombuffer(x) for x in own["counts"].to_pylist()], axis=0)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "part": pa.array([0], pa.int32()), "counts": pa.array([whole.tobytes()], pa.binary())})

    kind = "block long, part int, counts binary"
    sums = training.select("symbols").mapInArrow(run, kind).groupBy("block", "part").applyInArrow(added, kind).groupBy("block").applyInArrow(added, kind)
    total = np.zeros(-(-n // BLOCK) * BLOCK)
    for r in sums.select("block", "counts").collect():  # a row for each block of the model's parameters
        total[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["counts"])
    total = total[:n]
    return Hmm.fitted(total[:s], total[s : s + s * s].reshape(s, s), total[s + s * s :].reshape(size, s), mass)


def score(documents: DataFrame) -> DataFrame:
    """The contract's columns: counts, base_score and score (log10, rounded to nine places) of every document row.

    A null or empty text is its end alone. Without training documents all counts are zero and the model has equal states.
    Repeated rows are scored each for itself; extra columns are ignored; an empty table gives no rows.
    """
    split = need(documents, "doc_id", "text").withColumn("held_out", remainder("doc_id", 5) == 1)
    training = split.where(~F.col("held_out"))
    counts = materialize(word_counts(training), "words")
    vocab = vocabulary(counts, training.count())
    coded = materialize(encode(split, vocab), "symbols")
    learn = coded.where(~F.col("held_out"))
    some = learn.orderBy(F.xxhash64("doc_id"), "doc_id").limit(START_DOCUMENTS).select("symbols").collect()
    model = start_model([np.frombuffer(bytes(r["symbols"]), np.uint32) for r in some], vocab.mass)
    for _ in range(PASSES if some else 0):
        model = baum_welch(learn, model, vocab.mass)
    total = vocab.total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hidden = model.log10_likelihoods(read_symbols(batch))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(7)), pa.array(hidden)], names=[*batch.schema.names[:7], "hidden"])

    small = ["rid", "doc_id", "held_out", "n_tokens", "n_known", "base", "pool"]
    kinds = ", ".join(ENCODED.split(", ")[:7])
    scored = coded.select(*small, "symbols").mapInArrow(run, f"{kinds}, hidden double")
    rare = coded.select("rid", F.explode("rare").alias("word")).join(counts, "word", "left")
    # sums of integers first where they can be, so that the order of rows does not show
    own = rare.groupBy("rid", "c").agg(F.count("*").alias("k"))
    logs = F.log10((F.coalesce("c", F.lit(0)) + 0.5) / F.lit(total))
    own = own.groupBy("rid").agg(F.sum(F.col("k") * logs).alias("looked_up"), F.coalesce(F.sum(F.when(F.col("c") > 0, F.col("k"))), F.lit(0)).alias("found"))
    joined = scored.join(own, "rid", "left")
    extra = F.coalesce("looked_up", F.lit(0.0))
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"), F.lit(vocab.n).cast("long").alias("train_tokens"),
        F.round(F.col("base") + extra, 9).alias("base_score"), F.round(F.col("hidden") + F.col("pool") + extra, 9).alias("score"),
    )
