"""The source audit against SQL and a plain version, and its transducers against sorted lists."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from comparing import same
from hypothesis import given, settings
from hypothesis import strategies as st

from landcube.llm import divergence
from landcube.llm.common import table

SF = "/root/testdata/sf0.001"


def brute(rows, least=10, top=10):
    docs = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")) for lang, source, text in rows]
    docs = [(lang, source, ["".join(c.lower() if c.isascii() else c for c in t) for t in terms]) for lang, source, terms in docs]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for _, _, terms in own for t in set(terms))
        kept = sorted((t for t, n in df.items() if n >= least), key=str.encode)
        counts = defaultdict(Counter)
        for _, source, terms in own:
            counts[source].update(t for t in terms if df[t] >= least)

        def share(c):
            whole = sum(c.values()) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // whole for t in kept}

        p, q = {s: share(c) for s, c in counts.items()}, share(sum(counts.values(), Counter()))
        gap = lambda a, b: (a - b) ** 2 // (a + b)
        for s in counts:
            ranked = sorted(((-sum(gap(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in counts if o != s))
            out += [(lang, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(ranked)]
            ranked = sorted((-gap(p[s][t], q[t]), t.encode(), t) for t in kept if counts[s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(ranked)]
    return sorted(out)


def found(frame):
    return sorted(map(tuple, frame.select("lang", "source", "part", "item", "value", "rank").collect()))


def odd_rows():
    rng = random.Random(5)
    words = ["Alpha", "alpha", "BETA", "gamma", "Äther", "äther", "日本", "x", "naïve", "delta-two", "E1F"]
    rows = [("en", f"s{k % 4}", " ".join(rng.choices(words[k % 4 :], k=30))) for k in range(60)]
    rows += [("en", None, None), (None, None, "alpha"), (None, "s1", ""), ("de", "s0", "one two"), ("de", "s1", "...")]
    rows += [("fr", "a", "q" * 5000 + " w" + "z" * 63), ("fr", "b", "q" * 5000 + " " + "q" * 64)] * 12
    rows += [("en", "s0", "alpha " * 40)] * 3
    return rows


@pytest.mark.parametrize("held, shard, matrix, shipped", [(300_000, 65_536, 1 << 21, 32_000_000), (20, 3, 8, 32_000_000), (20, 3, 8, 0)])
def test_audit(spark, monkeypatch, held, shard, matrix, shipped):
    monkeypatch.setattr(divergence, "HELD_TERMS", held)
    monkeypatch.setattr(divergence, "KNOWN_TERMS", held)
    monkeypatch.setattr(divergence, "HELD_COUNTS", held // 4)
    monkeypatch.setattr(divergence, "SHARD_TERMS", shard)
    monkeypatch.setattr(divergence, "MATRIX", matrix)
    docs = spark.createDataFrame([(*r, 1, 2, b"z", 3) for r in odd_rows()], "lang string, source string, text string, n int, part int, term binary, ordinal int")
    assert found(divergence.audit(docs, shipped_bytes=shipped)) == brute(odd_rows())


def test_query_equals_sql(spark):
    same(spark, "/root/testdata/sf0.01", lambda s, d: divergence.report(table(s, d, "documents")), divergence.ORACLE_SQL)


def test_large_counts_are_exact(spark):
    big = spark.createDataFrame([(9_000_000_000_000, 12_345_678_901_234, 77)], "n long, whole long, terms long")
    from pyspark.sql import functions as F

    assert big.select(divergence._share(F.col("n"))).first()[0] == 1 + 10**9 * (9_000_000_000_000 + 2) // (12_345_678_901_234 + 154)


def test_empty_table(spark):
    assert found(divergence.audit(spark.createDataFrame([], "lang string, source string, text string"))) == []


@settings(max_examples=80, deadline=None)
@given(st.sets(st.text("abé\x80z", min_size=1, max_size=7), max_size=30), st.lists(st.text("abé\x80z", max_size=8), min_size=1, max_size=20), st.sampled_from([1, 3, 64]))
def test_transducer(words, others, head):
    old, divergence.HEAD = divergence.HEAD, head
    try:
        terms = sorted(w.encode() for w in words)
        made = divergence.Transducer.build(terms, np.arange(len(terms)) * 3)
        made = divergence._loaded(divergence._stored("x", 0, made))
        asked = terms + [o.encode() for o in others]
        expected = [terms.index(t) * 3 if t in terms else -1 for t in asked]
        assert made(asked).tolist() == expected
    finally:
        divergence.HEAD = old


def test_transducer_is_minimal():
    terms = sorted(f"{a}{b}ing".encode() for a in "abcdef" for b in "xyz")
    made = divergence.Transducer.build(terms, np.arange(18))
    assert made.states() == 6  # root, after the first letter, and one for each of the last four
    assert made([b"axing", b"fzing", b"axin", b"axingg"]).tolist() == [0, 17, -1, -1]
