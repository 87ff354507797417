"""Mixing against sorted rows and exact fractions, on odd sources, repeated rows and sizes of zero."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict
from fractions import Fraction

import pytest
from comparing import same

from landcube.llm import mixing
from landcube.llm.common import table
from landcube.llm.queries import ORACLE_SQL, QUERIES

COLUMNS = "doc_id long, text string, source string, size int, place long, taken int, n long, salt int"


def size_of(text):
    return len(re.findall("[^\x20\x09-\x0d]+", text or ""))


def goals(sizes, weights, share, most):
    """Exact targets: all that would be above their most are held there, until none is."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    whole, held = Fraction(share) * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in held]
        level = (whole - sum(most * sizes[s] for s in held)) / sum(weight[s] for s in free) if free else 0
        above = {s for s in free if weight[s] * level > most * sizes[s]}
        if not above:
            return {s: Fraction(most * sizes[s]) if s in held else weight[s] * level for s in order}
        held |= above


def brute(rows, weights=(3, 1, 2), share=Fraction(3, 2), most=2):
    """(doc_id, size, source_size, target, taken) of every row: whole rounds, then rows by hash whose middle is within."""
    by_source = defaultdict(list)
    for doc, text, source in rows:
        md5 = lambda b: hashlib.md5(b).hexdigest()
        seed = f"{'-' if doc is None else doc}|{'-' if text is None else md5(text.encode())}"
        by_source[source].append((int(md5(seed.encode())[:15], 16), size_of(text), doc))
    sizes = {s: sum(r[1] for r in own) for s, own in by_source.items()}
    target = goals(sizes, weights, share, most) if sizes else {}
    out = []
    for s, own in by_source.items():
        times = target[s] // sizes[s] if sizes[s] else 0
        left2, before = (2 * target[s]) // 1 - 2 * times * sizes[s], 0
        for _, n, doc in sorted(own, key=lambda r: (r[0], r[1], -1 if r[2] is None else r[2])):
            out.append((doc, n, sizes[s], float(target[s]), int(n * (times + (2 * before + n <= left2)))))
            before += n
    return sorted(out, key=str)


def found(df):
    return sorted(((r["doc_id"], r["size"], r["source_size"], pytest.approx(r["target"]), r["taken"]) for r in df.collect()), key=lambda r: str((r[0], r[1], r[2], float(r[3].expected), r[4])))


def odd_rows():
    rng = random.Random(11)
    rows = [(i, " ".join("w" for _ in range(rng.choice([0, 1, 3, 9, 40, 200]))), rng.choice(["b", "a", "Z", "é", "😀", "", None])) for i in range(260)]
    rows += [(None, "x y", "a"), (None, None, None), (7, None, "b"), (8, " \t\n", "only blank"), (9, None, "only null"), (10, "a b c\x1fd", "z"), (11, "long " * 9000, "long")]
    rows += [(500, "one two three", "copies")] * 40  # equal rows: any number of them can be taken
    rows += [(600 + i, "the same text", "equal texts") for i in range(40)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], COLUMNS)


@pytest.mark.parametrize("weights, share, most", [((3, 1, 2), Fraction(3, 2), 2), ((1,), Fraction(1, 2), 1), ((5, 1), Fraction(1, 10), 3), ((1, 100), Fraction(2), 2)])
def test_every_row(spark, weights, share, most):
    rows = odd_rows()
    got = found(mixing.mix(frame(spark, rows), weights, float(share), most))
    want = brute(rows, weights, share, most)
    assert [(*g[:3], g[4]) for g in got] == [(*w[:3], w[4]) for w in want]
    assert all(w[3] == g[3] for g, w in zip(got, want, strict=True))


def test_sources_come_near_their_targets_and_reruns_agree(spark):
    rows = odd_rows()
    first = mixing.mix(frame(spark, rows)).collect()
    again = mixing.mix(frame(spark, rows).repartition(7)).collect()
    assert sorted(map(str, first)) == sorted(map(str, again))
    sums, largest, target = defaultdict(int), defaultdict(int), {}
    for r in first:
        sums[r["source"]] += r["taken"]
        largest[r["source"]], target[r["source"]] = max(largest[r["source"]], r["size"]), r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert all(abs(sums[s] - target[s]) <= largest[s] / 2 + 1 for s in sums)
    assert abs(sums["copies"] - target["copies"]) <= 1.5


def test_thresholds_are_nested(spark):
    """Whoever is in a smaller mix is in a larger one too."""
    rows = [r for r in odd_rows() if r[2] in ("a", "b", None)]
    takes = [{(r["doc_id"], r["source"], r["size"]): r["times"] for r in mixing.mix(frame(spark, rows), (1,), share).collect()} for share in (0.2, 0.5, 0.9, 1.3)]
    for small, large in zip(takes, takes[1:], strict=False):
        assert all(small[k] <= large[k] for k in small)


def test_the_mix_itself(spark):
    rows = odd_rows()
    drawn = mixing.drawn(frame(spark, rows)).collect()
    taken = {}
    for r in mixing.mix(frame(spark, rows), keep=("doc_id", "text")).collect():
        taken[(r["doc_id"], r["text"], r["source"])] = taken.get((r["doc_id"], r["text"], r["source"]), 0) + r["times"]
    got = defaultdict(int)
    for r in drawn:
        got[(r["doc_id"], r["text"], r["source"])] += 1
    assert dict(got) == {k: n for k, n in taken.items() if n}


def test_few_bits_and_one_place(spark, monkeypatch):
    """Rows that share a place though they differ are taken by size and id; many levels give the same as few."""
    monkeypatch.setattr(mixing, "LEVELS", (1,) * 12)
    monkeypatch.setattr(mixing, "BITS", 12)
    rows = [(i, "w " * (1 + i % 5), "ab"[i % 2]) for i in range(400)]
    got = mixing.mix(frame(spark, rows)).collect()
    sums, target = defaultdict(int), {}
    for r in got:
        sums[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert len(got) == 400 and all(abs(sums[s] - target[s]) <= 3 for s in sums)


def test_queries_equal_sql(spark, tmp_path):
    for rows in (odd_rows(), [r for r in odd_rows() if size_of(r[1]) == 0]):
        folder = tmp_path / str(len(rows))
        spark.createDataFrame([(-1 if d is None else d, t, s) for d, t, s in rows], "doc_id long, text string, source string").write.parquet(f"{folder}/documents.parquet")
        same(spark, str(folder), QUERIES["op11_mixing"], ORACLE_SQL["op11_mixing"])


def test_plan_is_native(spark):
    plan = mixing.report(table(spark, "/root/testdata/sf0.001", "documents"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_table(spark):
    assert mixing.mix(frame(spark, odd_rows()).limit(0)).count() == 0
