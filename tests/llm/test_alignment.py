"""The alignment of two tokenizers against a plain version, on odd texts and the given ones."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from landcube.llm import alignment
from landcube.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    back = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in shown)}

    def tokens(text):
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(back[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        return ids_a, bytes_a, ids_b, bytes_b

    return tokens


def brute(rows, tokens):
    """doc_id and measures of every row, link by link."""
    docs, counts = [], Counter()
    for doc, text in rows:
        groups = []
        if text:
            ids_a, bytes_a, ids_b, bytes_b = tokens(text)
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
                ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
                at_a = at_b = 0
                for end in sorted(set(ends_a) & set(ends_b)):
                    to_a, to_b = ends_a.index(end, at_a) + 1, ends_b.index(end, at_b) + 1
                    groups.append((ids_a[at_a:to_a], ids_b[at_b:to_b]))
                    at_a, at_b = to_a, to_b
        links = [(x, y) for own_a, own_b in groups for x in own_a for y in own_b]
        counts.update(set(links))
        docs.append((doc, groups, links))
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(n, best.get(x, 0))
    out = []
    for doc, groups, links in docs:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        out.append((doc, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links), sum(counts[k] == best[k[0]] for k in links), sum(counts[k] for k in links), digest))
    return sorted(out, key=str), counts, best


def found(frame):
    return sorted(map(tuple, frame.select("doc_id", *alignment.MEASURES, "groups_sha256").collect()), key=str)


ODD = [None, "", " ", "   ", "  a  b\r\n\t\tc ", "one two", "a▁b", "<|endoftext|> and <s> </s>", "\x00\x01 x", "é é ÄÖ ñ", "😀😀 ال 中文字符 ก็", "don't won't  we'll", "x" * 5000, " " * 3000 + "y", "\n" * 500, "日" * 400, "b" * 40_000, " " * 20_000, "c1" * 3000 + " x", "12345 67,8.9!?", "aA" * 700, "one two", "    　z", "the cat " * 40, "ends  \n", "ends \n\n", " \n"]


@pytest.mark.parametrize("block", [8_000_000, 50])
def test_measures(spark, plain, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(5, "one two"), (None, "one two"), (None, None)]
    docs = spark.createDataFrame([(i, t, 1, b"x", 2, 3, 4) for i, t in rows], "doc_id long, text string, n int, key binary, block int, pair int, a int")
    expected, counts, best = brute(rows, plain)
    assert found(alignment.align(docs)) == expected
    pairs = alignment.pair_counts(docs).collect()
    assert {(r["a"], r["b"]): r["count"] for r in pairs} == dict(counts)
    assert all(r["is_best"] == (r["count"] == best[r["a"]]) for r in pairs)


def test_links_of_one_large_group():
    a, b = np.array([3, 3, 4] * 5), np.array([1, 2] * 6)
    own = Counter((int(x) * 10 + int(y)) for x in a for y in b)
    whole = alignment.linked(a, b, np.array([len(a)]), np.array([len(b)]), 10)
    old, alignment.LINKS = alignment.LINKS, 20
    try:
        split = alignment.linked(a, b, np.array([len(a)]), np.array([len(b)]), 10)
    finally:
        alignment.LINKS = old
    for pairs, times in (whole, split):
        assert dict(zip(pairs.tolist(), times.tolist(), strict=True)) == own


@pytest.mark.parametrize("links", [1, 7, 60])
def test_links_of_many_groups(monkeypatch, links):
    monkeypatch.setattr(alignment, "LINKS", links)
    rng = np.random.default_rng(links)
    na, nb = rng.integers(1, 6, 40), rng.integers(1, 6, 40)
    a, b = rng.integers(0, 4, na.sum()), rng.integers(0, 4, nb.sum())
    own, at_a, at_b = Counter(), 0, 0
    for x, y in zip(na, nb, strict=True):
        own.update(int(i) * 10 + int(j) for i in a[at_a : at_a + x] for j in b[at_b : at_b + y])
        at_a, at_b = at_a + x, at_b + y
    pairs, times = alignment.linked(a, b, na, nb, 10)
    assert pairs.tolist() == sorted(own) and times.tolist() == [own[p] for p in sorted(own)]


def test_tokenizer_without_ranks(plain):
    paths = alignment.tokenizer_paths()
    alone, both = alignment.ByteTokens(paths[0], None), alignment.ByteTokens(*paths[:2])
    assert alone.lengths.tolist() == both.lengths.tolist()
    for text in filter(None, ODD):
        assert alone(" " + text).tolist() == both(" " + text).tolist() == plain(text)[0]


def test_long_texts_have_the_same_digest(plain, monkeypatch):
    text = "Words, more words; a1 b2 " * 50
    whole = alignment.aligner(alignment.tokenizer_paths())(text)
    monkeypatch.setattr(alignment, "LINKS", 11)
    assert alignment.aligner(alignment.tokenizer_paths())(text)[:5] == whole[:5]


def test_whole_table(spark, plain):
    docs = table(spark, SF, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert found(alignment.report(docs)) == brute(rows, plain)[0]


def test_empty_table(spark):
    assert found(alignment.align(spark.createDataFrame([], "doc_id long, text string"))) == []
