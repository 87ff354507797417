"""Toxic spans by a linear-chain conditional random field (operator 7).

Labels are given for whole documents. From a bounded sample of labelled rows (at most ``SAMPLE`` of each label, by the hash
of the id; near copies count once) a word, or what a family of words begins with, is taken as a toxic token's if it is in
clearly more toxic than clean documents; these tokens, and those between two of them at most ``BRIDGE`` apart, are the labelled tokens. A chain with the
states clean and toxic is trained on windows around them and around such words in clean documents, where all tokens are clean, by gradient ascent on the
exact likelihood. A document's tokens get their marginals by the forward-backward recursion over the whole text; runs of
tokens without weights of their own are powers of one 2 x 2 matrix, so the recursion steps from weighted token to weighted
token and is still exact. The marginals aggregate to a score by a logistic fit on the same sample.

Every task scores its own documents; only the sample comes to the driver, as Arrow, and is read text by text there: its tokens
are kept as four-byte numbers of one vocabulary.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from math import exp, log, log1p

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landcube.llm import nearcopies
from landcube.llm.common import need, remainder

#: Labelled documents of each label to learn from, tokens between two toxic ones, training window on each side.
SAMPLE, BRIDGE, SIDE = 2500, 2, 10
#: Least odds and share of a toxic key, lengths of beginnings and how many words must share one.
ODDS, SHARE, BEGINS, FAMILY = 20.0, 0.03, (4, 5, 6, 7, 8), 5
WORD = re.compile(r"[^\W\d_]+")
#: ASCII letters as lower-case letters, all else as a blank; letters of a word that are looked up first.
#: Up to MANY of these are looked for in a whole text before its words are.
LETTERS, HEAD, MANY = bytes(c | 32 if chr(c).isalpha() else 32 for c in range(128)) + b" " * 128, 4, 64
SCORES = "_score double, _spans array<struct<start: int, end: int, p: double>>"


def tokens(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


def first_of_copies(texts: Iterable[list[str]]) -> list[int]:
    """Places of the texts that are no near copies of one kept before: 5-word shingles at Jaccard 0.8 or more, verified."""
    seen: dict[tuple[int, int], list[int]] = {}
    kept, sets = [], []
    for at, words in enumerate(texts):
        if not words:
            continue
        own = nearcopies.shingles(" ".join(words))
        marks = list(enumerate(nearcopies.bands(own)))
        like = sorted({i for m in marks for i in seen.get(m, [])})
        if like and nearcopies.near(own, [sets[i] for i in like]).any():
            continue
        for m in marks:
            seen.setdefault(m, []).append(len(sets))
        sets.append(own)
        kept.append(at)
    return kept


def distinct_texts(texts: list[list[str]]) -> list[set[str]]:
    """The word sets of texts, without near copies; see :func:`first_of_copies`."""
    return [set(texts[i]) for i in first_of_copies(texts)]


class Numbered:
    """Texts as tokens' numbers: names (the words by number), of (a view on each text's numbers)."""

    def __init__(self, texts: Iterable[str]):
        numbers: dict[str, int] = {}
        flat, ends = array("i"), [0]
        for text in texts:
            flat.extend([numbers.setdefault(w, len(numbers)) for w in tokens(text)])
            ends.append(len(flat))
        whole = np.frombuffer(flat, np.int32) if flat else np.array([], np.int32)
        self.names, self.of = list(numbers), [whole[a:b] for a, b in zip(ends, ends[1:])]  # noqa: B905

    def words(self, text: np.ndarray) -> list[str]:
        return [self.names[i] for i in text.tolist()]

    def distinct(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """The different numbers of each of the texts that is no near copy of one before."""
        return [np.unique(texts[i]) for i in first_of_copies(map(self.words, texts))]


def toxic_keys(sample: Numbered, n_toxic: int) -> tuple[list[str], list[str]]:
    """Words, and beginnings of at least ``FAMILY`` different words, that set the sample's first ``n_toxic`` texts apart.

    Such a key is in a share ``SHARE`` of the toxic documents at least, and in at least ``ODDS`` times the share of the
    clean ones; a beginning is in a document if two of its words have it, as one may be chance. Of beginnings that extend
    each other the shortest counts, and a word counts by itself only without one.
    """
    a, b = sample.distinct(sample.of[:n_toxic]), sample.distinct(sample.of[n_toxic:])

    def apart(toxic: int, clean: int) -> bool:
        return (toxic + 0.5) / (len(a) + 1) >= ODDS * (clean + 0.5) / (len(b) + 1)

    def twice(words: list[str]) -> list[str]:
        return [k for k, v in Counter(w[:n] for w in words for n in BEGINS if len(w) >= n).items() if v > 1]

    # what is in too few toxic documents is not counted in clean ones
    often = {k: v for k, v in Counter(k for d in a for k in twice(sample.words(d))).items() if v >= max(3, SHARE * len(a))}
    clean = Counter(k for d in b for k in twice(sample.words(d)) if k in often)
    begins = {k for k, v in often.items() if apart(v, clean[k])}
    n, m = (np.bincount(np.concatenate([np.array([], np.int32), *docs]), minlength=len(sample.names)).tolist() for docs in (a, b))
    family = Counter(w[:k] for i, w in enumerate(sample.names) if n[i] for k in BEGINS if w[:k] in begins and len(w) >= k)
    begins = {k for k in begins if family[k] >= FAMILY}
    begins = {k for k in begins if not any(k[:n] in begins for n in BEGINS if n < len(k))}
    least = max(4, SHARE * len(a))
    words = {w for i, w in enumerate(sample.names) if n[i] >= least and apart(n[i], m[i]) and not any(w[:k] in begins for k in BEGINS)}
    return sorted(words), sorted(begins)


def span_labels(weighted: list[int]) -> list[int]:
    """1 for tokens with a toxic word and for those bridged by two of them."""
    out, last = [0] * len(weighted), None
    for i, w in enumerate(weighted):
        if w:
            for j in range(i if last is None or i - last - 1 > BRIDGE else last, i + 1):
                out[j] = 1
            last = i
    return out


def chain_counts(x: np.ndarray, emit: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected toxic state of every token and expected transitions, for equally long windows at once."""
    n, length = x.shape
    e = np.stack([np.ones(x.shape), np.exp(emit[x])], axis=2)
    a = np.exp(trans)
    alpha, beta = np.empty((length, n, 2)), np.ones((length, n, 2))
    for t in range(length):
        step = e[:, t] if t == 0 else (alpha[t - 1] @ a) * e[:, t]
        alpha[t] = step / step.sum(axis=1, keepdims=True)
    pairs = np.zeros((2, 2))
    for t in range(length - 2, -1, -1):
        ahead = e[:, t + 1] * beta[t + 1]
        both = alpha[t][:, :, None] * a[None] * ahead[:, None, :]
        pairs += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        step = ahead @ a.T
        beta[t] = step / step.sum(axis=1, keepdims=True)
    p = alpha * beta
    return (p[:, :, 1] / p.sum(axis=2)).T, pairs


class Model:
    """words: the weighted words' numbers (from 1); emit: log-odds of toxic by number (0: other words); trans; fit."""

    def __init__(self, toxic: Iterable[str], clean: Iterable[str]):
        marked: list[float] = []
        given = ((y, t) for y, texts in ((1.0, toxic), (0.0, clean)) for t in texts)
        sample = Numbered(marked.append(y) or t for y, t in given)
        n_toxic = int(sum(marked))
        words, begins = toxic_keys(sample, n_toxic)
        self.words = {w: i for i, w in enumerate(words, 1)}
        self.begins = {w: i for i, w in enumerate(begins, len(words) + 1)}
        self.sizes = sorted({len(w) for w in begins})
        self.heads = {w[:HEAD] for w in (*words, *begins)}  # no beginning is shorter
        self.ascii = {w.encode() for w in self.heads}
        # a sigma's lower case depends on what is around it
        self.anywhere = {w.replace("ς", "σ") for w in self.heads} if len(self.heads) <= MANY else {""}
        self.emit, self.trans = np.zeros(len(words) + len(begins) + 1), np.zeros((2, 2))
        self.fit = np.array([-4.0, 0.0, 0.0])
        weighted = np.array([self.number(w) for w in sample.names], np.int64)
        windows, edge, span = [], [len(self.emit)] * SIDE, np.arange(2 * SIDE + 1)  # edge, beyond the text: a symbol that is always clean
        for k, d in enumerate(sample.of):
            if len(d):
                own = weighted[d]
                at = np.flatnonzero(own) if own.any() else np.array([(k * 7919) % len(d)])
                y = span_labels(own.tolist()) if k < n_toxic else np.zeros(len(d), np.int64)
                windows.append([np.concatenate([e, x, e])[at[:, None] + span].astype(np.int64) for x, e in ((own, edge), (y, [0] * SIDE))])
        if windows:
            self._train(*(np.concatenate(w) for w in zip(*windows, strict=True)))
        self.powers: list[tuple[float, float, float, float]] = []
        self._neutral()
        shown = np.array([self.aggregate([p for _, p in self.marginals(weighted[d].tolist())]) for d in sample.of]).reshape(-1, 2)
        self._calibrate(shown, np.array(marked))

    def number(self, word: str) -> int:
        """The weight's number of a lower-case word, 0 if it has none."""
        found = self.words.get(word, 0)
        for n in self.sizes:
            found = found or self.begins.get(word[:n], 0)
        return found

    def _train(self, x: np.ndarray, y: np.ndarray, steps: int = 120) -> None:
        size = len(self.emit) + 1
        seen, on = np.bincount(x.ravel(), minlength=size).astype(float), np.bincount(x.ravel(), weights=y.ravel(), minlength=size)
        emit = np.append(self.emit, -40.0)
        pairs = np.zeros((2, 2))
        np.add.at(pairs, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        for k in range(steps):
            p, expected = chain_counts(x, emit, self.trans)
            away = on - np.bincount(x.ravel(), weights=p.ravel(), minlength=size) - 0.5 * emit
            rate = 4.0 / (1 + k / 40)
            emit[:-1] = np.clip(emit + rate * away / (seen + 1), -30, 30)[:-1]
            self.trans = np.clip(self.trans + rate * (pairs - expected - 0.5 * self.trans) / (pairs.sum(axis=1, keepdims=True) + 1), -15, 15)
        self.emit = emit[:-1]

    def _neutral(self) -> None:
        step = np.exp(self.trans) * np.array([1.0, np.exp(self.emit[0])])
        power = np.eye(2)
        for _ in range(513):
            self.powers.append(tuple(power.ravel().tolist()))
            power = power @ step
            power /= power.sum()

    def power(self, n: int) -> tuple[float, float, float, float]:
        """The neutral step ``n`` times over, up to a factor; what is beyond the table is put together from its last."""
        most = len(self.powers) - 1
        if n <= most:
            return self.powers[n]
        whole, base = np.array(self.powers[n % most]).reshape(2, 2), np.array(self.powers[most]).reshape(2, 2)
        for _ in range(n // most):
            whole = whole @ base
            whole /= whole.sum()
        return tuple(whole.ravel().tolist())

    def marginals(self, numbers: list[int], hits: list[tuple[int, int]] | None = None) -> list[tuple[int, float]]:
        """(place, P(toxic)) of every token with a weighted word."""
        if hits is None:
            hits = [(i, v) for i, v in enumerate(numbers) if v]
        if not hits:
            return []
        (t00, t01), (t10, t11) = np.exp(self.trans).tolist()
        emit = self.emit
        ahead, a0, a1, before = [], 1.0, 1.0, -1
        for i, v in hits:
            e = exp(float(emit[v]))
            if i == 0:
                a0, a1 = 1.0, e
            else:  # the first token has no transition into it
                if before < 0:
                    before, a0, a1 = 0, 1.0, exp(float(emit[0]))
                p00, p01, p10, p11 = self.power(i - before - 1)
                b0, b1 = a0 * p00 + a1 * p10, a0 * p01 + a1 * p11
                a0, a1 = b0 * t00 + b1 * t10, (b0 * t01 + b1 * t11) * e
            z = a0 + a1
            a0, a1, before = a0 / z, a1 / z, i
            ahead.append((a0, a1, e))
        out, b0, b1, after = [], 1.0, 1.0, len(numbers)
        for k in range(len(hits) - 1, -1, -1):
            i = hits[k][0]
            if after < len(numbers):
                e = ahead[k + 1][2]
                c0, c1 = t00 * b0 + t01 * e * b1, t10 * b0 + t11 * e * b1
            else:
                c0, c1 = 1.0, 1.0
            p00, p01, p10, p11 = self.power(after - i - 1)
            b0, b1 = p00 * c0 + p01 * c1, p10 * c0 + p11 * c1
            z = b0 + b1
            b0, b1, after = b0 / z, b1 / z, i
            x, y = ahead[k][0] * b0, ahead[k][1] * b1
            out.append((i, y / (x + y)))
        return out[::-1]

    @staticmethod
    def aggregate(p: list[float]) -> tuple[float, float]:
        top = min(max(p, default=0.0), 1 - 1e-6)
        return top, log1p(sum(p))

    def _calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        if not len(y) or y.min() == y.max():
            self.fit[0] = 4.0 if len(y) and y.min() == 1 else -4.0
            return
        x, w = np.column_stack([np.ones(len(x)), x]), np.zeros(3)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            ridge = np.diag([1e-3, 0.3, 0.3])
            w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        self.fit = w

    def score(self, p: list[float]) -> float:
        top, much = self.aggregate(p)
        a, b, c = self.fit.tolist()
        return 1 / (1 + exp(-max(-30.0, min(30.0, a + b * top + c * much))))

    def read(self, text: str) -> tuple[float, list[dict]]:
        """Score and toxic spans (code points) of a whole text."""
        low = text.lower().replace("ς", "σ")
        if not any(w in low for w in self.anywhere):
            return self.score([]), []
        if text.isascii():
            words, heads = text.encode().translate(LETTERS).split(), self.ascii
            hits = [(i, v) for i, w in enumerate(words) if w[:HEAD] in heads and (v := self.number(w.decode()))]
        else:
            words, heads = WORD.findall(text), self.heads
            hits = [(i, v) for i, w in enumerate(map(str.lower, words)) if w[:HEAD] in heads and (v := self.number(w))]
        if not hits:
            return self.score([]), []
        found = self.marginals(words, hits)
        places = {i: p for i, p in found if p >= 0.5}
        spans = [{"start": m.start(), "end": m.end(), "p": places[i]} for i, m in enumerate(WORD.finditer(text)) if i in places]
        return self.score([p for _, p in found]), spans


def sample(documents: DataFrame, labels: DataFrame) -> tuple[Iterator[str], Iterator[str]]:
    """Texts of at most ``SAMPLE`` toxic and as many clean labelled rows, none of them held out, by doc_id."""
    own = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder("doc_id", 4) != 2))
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = [own.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for y in (1, 0)]
    # at most 2 x SAMPLE ids, whatever the labels' number
    rows = documents.join(F.broadcast(picked[0].union(picked[1])), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    found = rows.where("text is not null").select("doc_id", "toxic", "text").toArrow()
    ids, marks, texts = (found.column(i) for i in range(3))
    order = pc.sort_indices(ids).to_pylist()

    def marked(y: int) -> Iterator[str]:
        return (texts[i].as_py() for i in order if marks[i].as_py() == y)

    return marked(1), marked(0)


def scored(documents: DataFrame, labels: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every document row, with its _score and _spans (start, end, p).

    Null and empty texts get the score of a text without toxic words and no spans. Without usable labels every score is
    low. Rows are scored each for itself, whether or not they share a doc_id or have one; an empty table gives no rows.
    """
    model = Model(*sample(need(documents, "doc_id", "text"), need(labels, "doc_id", "toxic")))
    own = documents.select(F.col("text").alias("_text"), *[F.col(f"`{c}`") for c in keep])
    schema = T.StructType([*own.schema.fields[1:], *T.StructType.fromDDL(SCORES).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
        for batch in batches:
            made = [model.read(t or "") for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([m[0] for m in made], pa.float64()), pa.array([m[1] for m in made], kind)], names=[*keep, "_score", "_spans"])

    return own.mapInArrow(run, schema)


def score(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score and spans of every document row; see :func:`scored`."""
    return scored(documents, labels, ["doc_id"]).withColumnsRenamed({"_score": "score", "_spans": "spans"})


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns, and the number of toxic spans."""
    return score(documents, labels).select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))
