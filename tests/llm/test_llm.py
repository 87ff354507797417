"""Every corpus operator against a brute-force version or SQL, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import pytest
from comparing import same
from hypothesis import example, given, settings
from hypothesis import strategies as st

from landcube.llm import components, covertree, decontamination, html, linededup, lm, packing, sharding, simhash, suffix, toxicity
from landcube.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
#: Columns that operators make for themselves, as extra columns of their input.
CLASH = "doc_id long, text string, h int, w int, key int, fp int, n int, start int, rid int, shard int, score double, kind int, _gone int, n_lines int, n_removed int"


def odd_texts():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    passage = " ".join(rng.choice(words) for _ in range(40))
    texts = [None, "", "   \n ", "one", "Ünïcode ÄÖ é", passage, passage, passage + " tail", "x " + passage + " y", "ab" * 300, "ab" * 400, "\n\n", "a\nb\nc", "a\nb\nc", "b\nc\nd"]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randrange(3, 90))) for _ in range(25)]
    texts.append(" ".join(rng.choice(words) for _ in range(30_000)))
    return texts


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(i, t, *([1] * 13)) for i, t in enumerate(odd_texts())]
    rows.append(rows[5])  # a repeated row
    return spark.createDataFrame([(a, b, *[float(x) if k == 8 else x for k, x in enumerate(rest)]) for a, b, *rest in rows], CLASH)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], CLASH)


@pytest.fixture(scope="module")
def benchmark(spark):
    texts = odd_texts()
    return spark.createDataFrame([(1, texts[5]), (2, "w1 w2 w3"), (3, None), (4, ""), (5, texts[5]), (6, "one")], "item_id long, text string")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    same(spark, SF, QUERIES[name], ORACLE_SQL[name])


def test_all_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))


def low_words(text, pattern="[^\x20\x09-\x0d]+"):
    return re.findall(pattern, "".join(c.lower() if c.isascii() else c for c in text or ""))


# 1


def brute_top_k(rows, k=10):
    v = {i: np.floor(np.array(e, np.float64) * 1024).astype(np.int64) for i, e in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)}
    out = {}
    for q in v:
        if q % 100 == 0:
            scored = sorted((-int((v[q] * v[c]).sum()), c) for c in v if c != q)[:k]
            out[q] = [(c, -s) for s, c in scored]
    return out


def test_top_k(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=8) + 3 * (i % 3))]) for i in range(400)]
    rows += [(400 + i, rows[7][1]) for i in range(60)]  # ties
    rows += [(900, None), (901, [None] * 8), (902, [float("nan")] * 8), (903, [float("inf")] + [0.0] * 7), (None, rows[0][1])]
    frame = spark.createDataFrame([(a, b, 1) for a, b in rows], "vec_id long, embedding array<float>, score int")
    got = defaultdict(list)
    for r in covertree.report(frame).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert got == brute_top_k(rows)
    assert covertree.report(frame.limit(0)).count() == 0


def test_top_k_of_repeated_rows(spark, tmp_path):
    """Each row with a query's id is answered by itself; rows of its own id are no candidates, other repeated rows are."""
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=4))]) for i in range(14)] + [(100, [1.0, 0.0, 0.0, 0.0])]
    rows += [rows[0], rows[5], rows[5], (100, [0.0, -1.0, 0.0, 0.5])]
    v = [(i, np.floor(np.array(e) * 1024).astype(np.int64)) for i, e in rows]
    want = []
    for q, x in v:
        if q % 100 == 0:
            scored = sorted((-int((x * y).sum()), c) for c, y in v if c != q)[:10]
            want += [(q, k, c, -s) for k, (s, c) in enumerate(scored, 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, covertree.report(frame).select("query_id", "rank", "vec_id", "score").collect()))
    assert got == sorted(want) and len(got) == 40
    frame.write.parquet(f"{tmp_path}/embeddings.parquet")
    same(spark, str(tmp_path), QUERIES["op1_exact_top_k"], ORACLE_SQL["op1_exact_top_k"])


def test_top_k_saturates(spark):
    rows = [(0, [1e30, -1e300]), (1, [1e30, 1e300]), (2, [5e17, 0.0]), (3, [-1e30, 0.0]), (4, [1.0, 1.0]), (100, [3e9, 3e9]), (101, [2.9e9, 3e9])]
    frame = spark.createDataFrame([(a, [float(x) for x in b]) for a, b in rows], "vec_id long, embedding array<double>")
    cut = lambda x: max(-(2**63), min(2**63 - 1, x))
    v = {i: [cut(int(np.floor(x * 1024))) if abs(x) < 1e290 else cut(int(np.sign(x)) * 2**70) for x in e] for i, e in rows}
    want = []
    for q in (0, 100):
        scored = sorted((-cut(sum(a * b for a, b in zip(v[q], v[c], strict=True))), c) for c in v if c != q)
        want += [(q, r, c, -s) for r, (s, c) in enumerate(scored, 1)]
    assert sorted(map(tuple, covertree.report(frame).collect())) == want


def test_cover_tree_is_one():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(500, 16)) + 40 * rng.normal(size=16) for _ in range(4)] + [np.ones((90, 16))])
    tree = covertree.Tree(x, 8)
    depth = [0] * len(tree.low)
    for i, kids in enumerate(tree.children):
        rows = tree.order[tree.low[i] : tree.high[i]]
        assert np.sqrt(((x[rows] - x[tree.centre[i]]) ** 2).sum(axis=1)).max() == pytest.approx(tree.radius[i])
        assert len(kids) or len(rows) <= 8 or tree.radius[i] == 0
        if len(kids):
            assert tree.centre[kids[0]] == tree.centre[i] and tree.radius[kids].max() <= covertree.SHRINK * tree.radius[i] * (1 + 1e-9)
            far = np.sqrt(((tree.points[kids][:, None] - tree.points[kids][None]) ** 2).sum(axis=2))[np.triu_indices(len(kids), 1)]
            assert far.min() > covertree.SHRINK * tree.radius[i] * (1 - 1e-9)
            for c in kids:
                depth[c] = depth[i] + 1
    assert sorted(tree.order.tolist()) == list(range(len(x))) and max(depth) >= 4


def test_visited_and_pruned_pairs(spark):
    """On clustered vectors most pairs are pruned; on the given ones, unit vectors without any structure, hardly any."""
    rng = np.random.default_rng(6)
    made = np.concatenate([rng.integers(-9, 9, (200, 64)) + rng.integers(-500, 500, 64) for _ in range(20)])
    given = np.array([r["v"] for r in covertree.quantized(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")).orderBy("vec_id").select("v").collect()])
    shares = []
    for x in (made, given):
        seen = {}
        covertree.dual_search(x[::100], np.arange(0, len(x), 100), np.full(len(x[::100]), -np.inf), x, np.arange(len(x)), 10, seen)
        shares.append(seen["products"] / (len(x[::100]) * len(x)))
        assert seen["visited"] > 50 and seen["visited"] >= seen.get("pruned", 0)
    assert shares[0] < 0.5 and len(covertree.Tree(given.astype(float), 32).low) > 100
    print("share of products formed", shares)


def test_cover_tree_prunes_exactly():
    rng = np.random.default_rng(4)
    data = np.concatenate([rng.integers(-20, 20, (300, 6)) + c for c in (0, 200, -300)])
    ids = np.arange(len(data))
    found = covertree.dual_search(data[:50], ids[:50], np.full(50, -np.inf), data, ids, 5)
    for i in range(50):
        scores = data @ data[i]
        order = [j for j in np.lexsort((ids, -scores)) if j != i][:5]
        assert found[i][1].tolist() == order and found[i][0].tolist() == scores[order].tolist()


def test_products_are_formed_in_batches():
    """Vectors that admit no pruning cost little more than their products: no step for each query and leaf."""
    rng = np.random.default_rng(8)
    data, seen = rng.integers(-300, 300, (3000, 64)), {}
    found = covertree.dual_search(data[:300], np.arange(300), np.full(300, -np.inf), data, np.arange(3000), 10, seen)
    assert seen["products"] > 500_000 and seen["batches"] <= seen["products"] / 10_000
    for i in (0, 77, 299):
        scores = data @ data[i]
        order = [j for j in np.lexsort((np.arange(3000), -scores)) if j != i][:10]
        assert found[i][1].tolist() == order and found[i][0].tolist() == scores[order].tolist()


@pytest.mark.parametrize("size", [20, 40_000, 10**7, 10**11, 4 * 10**18])
def test_dual_search_at_every_width(size):
    """Products in single floats, doubles and whole numbers, ties at the kth score and at a saturated one among them."""
    rng = np.random.default_rng(2)
    data = rng.integers(-size, size, (400, 3))
    data[200:260] = data[0]
    queries, ids = np.concatenate([data[:40], -data[:40]]), rng.permutation(400)
    asked = np.concatenate([ids[:40], ids[:40]])
    scores = np.clip(queries.astype(object) @ data.astype(object).T, -(2**63), 2**63 - 1).astype(np.int64)
    for worst in (-np.inf, float(-(2**63))):
        found = covertree.dual_search(queries, asked, np.full(80, worst), data, ids, 10)
        for i in range(80):
            others = np.flatnonzero(ids != asked[i])
            order = others[np.lexsort((ids[others], ~scores[i, others]))][:10]
            assert found[i][0].tolist() == scores[i, order].tolist() and found[i][1].tolist() == ids[order].tolist()


def test_top_k_over_many_blocks_lists_and_parts(spark, monkeypatch):
    for name, value in (("BLOCK", 25), ("LISTED", 3), ("PART_BYTES", 200)):
        monkeypatch.setattr(covertree, name, value)
    rng = np.random.default_rng(13)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=4) * (40 if i == 5 else 1) + 2 * (i % 2))]) for i in range(0, 3000, 5)]
    rows += [(3001 + i, rows[3][1]) for i in range(80)]
    got = defaultdict(list)
    for r in covertree.report(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert got == brute_top_k(rows) and len(got) == 30


def test_queries_go_on_packed(spark):
    """One row for each block and part that is asked for, not one for each query."""
    rng = np.random.default_rng(14)
    vectors = spark.createDataFrame([(i, rng.integers(-9, 9, 4).astype("<i2").tobytes(), i % 6) for i in range(120)], "vec_id long, v binary, block long")
    asked = vectors.selectExpr("vec_id AS query", "vec_id", "v", "double('-Infinity') AS worst", "0 AS part", "block AS home")
    going = covertree.going_on(asked, covertree.summaries(vectors, 4, "<i2"), 2, 4, "<i2").collect()
    assert len(going) == 6 and all(sorted(r["query"]) == [i for i in range(120) if i % 6 != r["block"]] and len(r["v"]) == 8 * len(r["query"]) for r in going)


# 2


def brute_fingerprint(text):
    import xxhash

    w = low_words(text)
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    for t in odd_texts()[:-1]:
        assert simhash.fingerprint(t) == brute_fingerprint(t)


def brute_components(fps):
    ids, root = sorted(fps), {}
    parent = {i: i for i in ids}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in ids:
        for j in ids:
            if i < j and bin(fps[i] ^ fps[j]).count("1") <= 4:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    for i in ids:
        root[i] = find(i)
    return root


def test_simhash(documents, none):
    rows = simhash.near_duplicates(documents).collect()
    fps = {i: brute_fingerprint(t) for i, t in enumerate(odd_texts())}
    want = brute_components(fps)
    assert len(rows) == len(fps) + 1
    assert all(int(r["fingerprint"], 16) == fps[r["doc_id"]] and len(r["fingerprint"]) == 16 and r["component_id"] == want[r["doc_id"]] for r in rows)
    assert simhash.near_duplicates(none).count() == 0


def test_links_of_dense_and_chained_points(spark):
    rng = random.Random(1)
    points = {rng.getrandbits(64) for _ in range(300)}
    for _ in range(20):  # chains and balls around a point
        x = rng.getrandbits(64)
        for _ in range(30):
            points.add(x)
            for _ in range(rng.randrange(1, 6)):
                x ^= 1 << rng.randrange(64)
    old, simhash.BUCKET = simhash.BUCKET, 16  # many buckets are dealt out in blocks
    try:
        frame = spark.createDataFrame([(simhash.signed(p),) for p in points], "fp long")
        roots = {r["node"]: r["root"] for r in components.connected_components(simhash.links(frame, 4)).collect()}
    finally:
        simhash.BUCKET = old
    want = brute_components({simhash.signed(p): p for p in points})
    groups = lambda m: {frozenset(k for k in want if m.get(k, k) == r) for r in {m.get(k, k) for k in want}}
    assert groups(roots) == groups(want)


def test_thresholds_cover():
    for total in range(1, 7):
        _, chosen = simhash.allocate([[0.0, 5.0, 9.0, 20.0, 50.0]] * 4, total)
        assert sum(t + 1 for t in chosen) == total


# 3


@pytest.mark.parametrize("hot", [False, True])
def test_suffix(documents, none, monkeypatch, hot):
    if hot:  # every anchor takes the way of the hot ones
        keys = [r["key"] for r in suffix.cut(documents.selectExpr("doc_id", "0L tie", "cast(coalesce(text, '') as binary) text"), []).select("key").distinct().collect()]
        monkeypatch.setattr(suffix, "hot_anchors", lambda _: keys[::2])
    want = suffix.brute_force({i: (t or "").encode() for i, t in enumerate(odd_texts())})
    rows = suffix.report(documents).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in rows} == want and len(rows) == len(want) + 1
    assert suffix.report(none).count() == 0


@pytest.mark.parametrize("crowd", [5000, 0])
def test_suffix_of_rows_that_share_an_id(spark, monkeypatch, crowd):
    monkeypatch.setattr(suffix, "CROWD", crowd)  # 0: every anchor is a crowded one
    rng = random.Random(11)
    p, q = ("".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (300, 400))
    rows = [(1, p), (7, p), (7, q), (None, q), (None, "x" + p + "y" + q), (None, None), (8, q[50:] + p[:200]), (7, q), (9, p[:150] + "-" + q[:120]), (10, "z" * 260)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    ties = {r["text"]: r["t"] for r in frame.selectExpr("text", "xxhash64(coalesce(cast(text as binary), X'')) t").collect()}
    seen, want = set(), []
    ordered = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, ties[r[1]]))
    cut = {}
    for i, text in ordered:
        gone = [False] * len(text or "")
        for o in range(len(gone) - 99):
            if text[o : o + 100] in seen:
                gone[o : o + 100] = [True] * 100
            seen.add(text[o : o + 100])
        cut[i, text] = "".join(c for c, g in zip(text or "", gone, strict=True) if not g).encode()
    want = Counter((i, cut[i, t]) for i, t in rows)
    assert Counter((r["doc_id"], bytes(r["kept"])) for r in suffix.dedup_bytes(frame).collect()) == want


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("ab", min_size=0, max_size=400), min_size=1, max_size=6))
def test_later_starts(texts):
    texts = [t.encode() + b"x" * 100 for t in texts]
    seen, want = set(), set()
    for i, t in enumerate(texts):
        for o in range(len(t) - suffix.LENGTH + 1):
            own = t[o : o + suffix.LENGTH]
            if own in seen:
                want.add((i, o))
            seen.add(own)
    assert set(suffix.later_starts(texts, np.arange(len(texts)))) == want


# 4


def test_sharding(documents, none, spark):
    rows = sharding.shard_table(documents).collect()
    texts = [(t or "").encode() for t in odd_texts()]
    sizes = Counter(r["shard"] for r in rows)
    assert max(sizes.values()) - min(sizes[s] for s in range(16)) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))
    assert all(r["size"] == len(texts[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]]) for r in rows)
    assert sharding.shard_table(none).count() == 0
    lone = spark.createDataFrame([(None, "x")] * 50, "doc_id long, text string")  # one key
    assert sorted(Counter(r["shard"] for r in sharding.shard_table(lone).collect()).values()) == [3] * 14 + [4] * 2


def test_sharding_of_hot_keys(spark, monkeypatch):
    """One key and one text in a third of the rows each, dealt in small parts; held against a ring walked row by row."""
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 7)
    monkeypatch.setattr(sharding, "CHUNK", 5)
    rows = [(None, f"t{i}") for i in range(90)] + [(None, "same")] * 80 + [(i, "same") for i in range(100)] + [(5, "same")] * 3
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard_table(frame).collect()
    assert Counter((r["doc_id"], r["text_crc32"]) for r in got) == Counter((i, zlib.crc32(t.encode())) for i, t in rows)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(own) == list(range(len(own))) for own in by.values())
    arcs, owners = sharding.ring(16, 32)
    points = [r["p"] for r in frame.selectExpr("shiftrightunsigned(xxhash64(doc_id), 51) p").collect()]
    counts = Counter(arcs[p] for p in points)
    where = brute_ring([counts[a] for a in range(len(owners))], owners, sharding.quotas_of(len(rows), 16, 1.0))
    assert Counter(r["shard"] for r in got) == Counter(where.values())
    arc_of = {i: arcs[p] for (i, _), p in zip(rows, points, strict=True)}
    assert Counter((arc_of[r["doc_id"]], r["shard"]) for r in got) == Counter((a, s) for (a, _), s in where.items())


def brute_ring(counts, owners, quotas):
    """Key by key: an own place first, then clockwise to the next arc whose shard has room."""
    room, where = list(quotas), {}
    for arc, n in enumerate(counts):
        for k in range(n):
            if room[owners[arc]]:
                room[owners[arc]] -= 1
                where[arc, k] = owners[arc]
    carried = []
    for lap in range(2):
        for arc, owner in enumerate(owners):
            if not lap:
                carried += [(arc, k) for k in range(counts[arc]) if (arc, k) not in where]
            while carried and room[owner]:
                where[carried.pop(0)] = owner
                room[owner] -= 1
    return where


@given(st.lists(st.integers(0, 9), min_size=6, max_size=6))
def test_bounded_loads(counts):
    owners, quotas = [0, 1, 2, 1, 0, 2], sharding.quotas_of(sum(counts), 3, 1.0)
    got = {(arc, k): shard for arc, low, high, shard, _ in sharding.bounded_loads(counts, owners, quotas) for k in range(low, high)}
    assert got == brute_ring(counts, owners, quotas)


# 5


def brute_contamination(text, items):
    pattern = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"
    w, hit, found = low_words(text, pattern), set(), set()
    for i, t in items:
        v = low_words(t, pattern)
        n = min(13, len(v))
        wins = {tuple(v[s : s + n]) for s in range(len(v) - n + 1)} if v else set()
        for s in range(len(w) - n + 1) if n else ():
            if tuple(w[s : s + n]) in wins:
                hit.update(range(s, s + n))
                found.add(str(i))
    return len(w), len(hit), ",".join(sorted(found))


@pytest.mark.parametrize("small", [True, False])
def test_contamination(spark, documents, none, benchmark, small):
    items = [(r["item_id"], r["text"]) for r in benchmark.collect()]
    old = decontamination.BROADCAST_WINDOWS
    decontamination.BROADCAST_WINDOWS = old if small else 1
    try:
        rows = decontamination.contamination(documents, benchmark).collect()
    finally:
        decontamination.BROADCAST_WINDOWS = old
    texts = odd_texts()
    assert len(rows) == len(texts) + 1
    for r in rows:
        assert (r["n_words"], len(r["hits"]), ",".join(r["items"])) == brute_contamination(texts[r["doc_id"]], items)
    shared = spark.createDataFrame([*SHARED_IDS, (7, texts[5]), (None, "pre " + texts[5]), (None, texts[5]), (7, texts[5])], "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_words"], len(r["hits"]), ",".join(r["items"])) for r in decontamination.contamination(shared, benchmark).collect())
    assert got == Counter((r["doc_id"], *brute_contamination(r["text"], items)) for r in shared.collect())
    assert decontamination.contamination(none, benchmark).count() == 0
    assert all(not r["hits"] for r in decontamination.contamination(documents, benchmark.limit(0)).collect())


@given(st.text("abc", min_size=0, max_size=60), st.integers(2, 6))
@settings(max_examples=10, deadline=None)
def test_winnowed_are_the_minima_of_windows(spark, text, n):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, 1, list(text))], "doc_id long, own long, w array<string>").withColumn("h", F.expr("transform(w, x -> xxhash64(x))"))
    old, decontamination.GRAM = decontamination.GRAM, 2
    try:
        got = {r["p"]: r["fp"] for r in decontamination.winnowed(rows, [n]).collect()}
        grams = rows.select(decontamination.grams_of(F.col("h"), 2)).first()[0]
    finally:
        decontamination.GRAM = old
    want = {s + grams[s : s + n - 1].index(min(grams[s : s + n - 1])) for s in range(len(grams) - n + 2)}
    assert set(got) == want and all(grams[p] == fp for p, fp in got.items())


# 6


def test_packing(documents, none):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(packing.tokenizer_path())
    rows = packing.pack(documents).collect()
    want = Counter()
    for i in [*range(len(odd_texts())), 5]:
        ids = np.array([*tk.encode(odd_texts()[i] or "", add_special_tokens=False).ids, 0], "<u4")
        want.update((i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048))
    assert Counter(tuple(r)[:5] for r in rows) == want
    filled = defaultdict(list)
    for r in rows:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in filled.values():
        ends = 0
        for offset, length in sorted(own):
            assert offset == ends
            ends += length
        assert ends <= 2048
    assert packing.pack(none).count() == 0


def test_word_ids_equal_the_tokenizer():
    ids = packing.word_ids(packing.tokenizer_path())
    for t in ["It's THE end.", "ΑΣ σας İstanbul", "a<|endoftext|>b c", "x y z \x1c w", "é ́e", "日本語 テスト", "Été, ÀÇÉ! Straße; x-y a.b. .. ,a Ÿ. ªº µ? l'été it's. 'S 3,a ½. don't!", "😀".encode("utf-16", "surrogatepass").decode("utf-16"), "don't 12,5 ½ ª"]:
        assert ids(t) == ids.encode(t)


def one_by_one(counts, capacity):
    """Best fit, longest first, piece by piece: how full the sequences are."""
    gaps = []
    for length in sorted(counts.elements(), reverse=True):
        fits = [g for g in gaps if g >= length]
        if fits:
            gaps.remove(min(fits))
        gaps.append((min(fits) if fits else capacity) - length)
    return sorted(capacity - g for g in gaps)


def fewest(lengths, capacity):
    """The optimum, by a table over sets of pieces: (sequences, tokens in the last)."""
    best = [(1, 0)]
    for chosen in range(1, 1 << len(lengths)):
        found = []
        for i, length in enumerate(lengths):
            if chosen >> i & 1:
                n, full = best[chosen ^ 1 << i]
                found.append((n, full + length) if full + length <= capacity else (n + 1, length))
        best.append(min(found))
    return best[-1][0] if lengths else 0


@given(st.lists(st.integers(1, 20), max_size=9))
def test_best_fit_plan_near_the_optimum(lengths):
    plan, used = packing.best_fit_plan(Counter(lengths), 20), set()
    for length, n in Counter(lengths).items():
        for (first, start, each, _), nxt in zip(plan[length], [*plan[length][1:], (n,)], strict=True):
            used |= {start + (rank - first) // each for rank in range(first, nxt[0])}
    assert len(used) <= 11 / 9 * fewest(lengths, 20) + 1


@example({11: 14, 12: 28, 10: 1})
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 30), max_size=12))
def test_best_fit_plan(counts):
    plan, used = packing.best_fit_plan(counts, 20), defaultdict(list)
    for length, n in counts.items():
        for (first, start, each, at), nxt in zip(plan[length], [*plan[length][1:], (n,)], strict=True):
            for rank in range(first, nxt[0]):
                q, r = divmod(rank - first, each)
                used[start + q].append((at + r * length, length))
    assert sum(map(len, used.values())) == sum(counts.values())
    for own in used.values():
        ends = 0
        for offset, length in sorted(own):
            assert offset == ends
            ends += length
        assert ends <= 20
    assert sorted(sum(n for _, n in own) for own in used.values()) == one_by_one(Counter(counts), 20)


# 7


def test_toxicity(spark):
    from landcube.llm.common import table

    documents, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    rows = toxicity.report(documents, labels).join(labels, "doc_id").where("held_out").collect()
    hit = sum(r["predicted"] == r["toxic"] for r in rows)
    caught = [r["predicted"] for r in rows if r["toxic"] == 1]
    assert hit / len(rows) > 0.96 and sum(caught) / len(caught) > 0.85


def test_only_near_copies_count_once():
    rng = random.Random(5)
    texts = [[f"w{rng.randrange(2000)}" for _ in range(200)] for _ in range(300)]  # unrelated, but with common words
    copies = [[*t[:100], "other", *t[101:]] for t in texts[:40]]
    assert toxicity.distinct_texts([*texts, *copies, *texts[:5], []]) == [set(t) for t in texts]


def test_the_sample_takes_few_bytes_a_token():
    import tracemalloc

    rng = random.Random(6)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=4)) for _ in range(600)) for _ in range(200)]
    tracemalloc.start()
    try:
        toxicity.Model((t + " badword" for t in texts[:100]), iter(texts[100:]))
        assert tracemalloc.get_traced_memory()[1] < 40 * 600 * len(texts)  # a word as a string of its own is 60 with its place in a list
    finally:
        tracemalloc.stop()


def test_words_are_looked_up_by_their_head_alone(monkeypatch):
    """Only words that begin as a key does are looked up, and the result is that of looking up every word."""
    rng = random.Random(8)
    keys = ["idiot", "ass", "dummes", "ßcheußlich", "i\u0307diot"]
    filler = ["Ideal", "asset", "as", "ASS", "Dummesel", "x", "ΣΑΣ", "İdiot", "don't_stop", "3rd", "naïve", "ẞcheußlich"]
    word = lambda: "".join(rng.choices("bcdfghklmnp", k=6))
    model = toxicity.Model([f"{word()} {word()} {k} {word()}" for k in keys * 4], [f"fine {word()} {word()} naïve asset" for _ in range(60)])
    assert {"idiot", "ass", "dummes"} < set(model.words)
    texts = [" ".join(rng.choices([*keys, *filler, *(["plain"] * 20)], k=60)) + end for end in (".", "\x00", "", "\x1fidiot") for _ in range(20)]
    texts += ["".join(c for c in t if c.isascii()) for t in texts] + ["", "idiot", "IDIOT\x0bass"]

    def plainly(text):
        words = toxicity.WORD.findall(text)
        return [(i, v) for i, v in enumerate(map(model.number, map(str.lower, words))) if v], len(words)

    looked, number, marginals, seen = [], toxicity.Model.number, toxicity.Model.marginals, {}
    want = {t: plainly(t) for t in texts}
    monkeypatch.setattr(toxicity.Model, "number", lambda self, word: looked.append(word) or number(self, word))
    monkeypatch.setattr(toxicity.Model, "marginals", lambda self, words, hits: seen.update({text: (hits, len(words))}) or marginals(self, words, hits))
    for text in texts:
        model.read(text)
    assert {t: w for t, w in want.items() if w[0]} == seen and len(seen) > 100
    assert looked and not any(w in looked for w in ("plain", "x", "as"))


def test_toxicity_edges(documents, none, spark):
    labels = spark.createDataFrame([(5, 1), (6, 0), (None, 1), (7, None), (6, 1)], "doc_id long, toxic int")
    rows = toxicity.report(documents, labels).collect()
    assert len(rows) == len(odd_texts()) + 1 and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.report(none, labels).count() == 0
    assert all(r["predicted"] == 0 for r in toxicity.report(documents, labels.limit(0)).collect())


def test_forward_backward_equals_enumeration():
    model = toxicity.Model([], [])
    model.emit, model.trans = np.array([-1.0, 2.0, 0.5]), np.array([[0.7, -0.4], [-0.2, 0.3]])
    model.powers = []
    model._neutral()
    x = [1, 0, 0, 2, 0, 1, 1]
    weight, on = 0.0, np.zeros(len(x))
    for code in range(1 << len(x)):
        y = [code >> i & 1 for i in range(len(x))]
        p = np.exp(sum(model.emit[v] * s for v, s in zip(x, y, strict=True)) + sum(model.trans[a, b] for a, b in zip(y, y[1:], strict=False)))
        weight, on = weight + p, on + p * np.array(y)
    for place, p in model.marginals(x):
        assert p == pytest.approx(on[place] / weight)


def test_long_ways_between_words_are_exact():
    model = toxicity.Model([], [])
    model.emit, model.trans, model.powers = np.array([-0.01, 2.0]), np.array([[0.02, -0.01], [0.01, 0.0]]), []
    model._neutral()
    x = [0, 1, *[0] * 1300, 1, 0, 0]
    want, _ = toxicity.chain_counts(np.array([x]), model.emit, model.trans)
    assert [p for _, p in model.marginals(x)] == pytest.approx([want[0, 1], want[0, 1302]])


def test_chain_learns_by_the_gradient():
    """The step's direction is the gradient of the exact log-likelihood, by differences."""
    rng = np.random.default_rng(9)
    x, y = rng.integers(0, 3, (6, 5)), rng.integers(0, 2, (6, 5))
    emit, trans = rng.normal(size=3), rng.normal(size=(2, 2))

    def likelihood(emit, trans):
        total = 0.0
        for row, own in zip(x, y, strict=True):
            score = lambda s: sum(emit[v] * k for v, k in zip(row, s, strict=True)) + sum(trans[a, b] for a, b in zip(s, s[1:], strict=False))
            total += score(own) - np.log(sum(np.exp(score([c >> i & 1 for i in range(5)])) for c in range(32)))
        return total

    p, expected = toxicity.chain_counts(x, emit, trans)
    pairs = np.zeros((2, 2))
    np.add.at(pairs, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
    for j in range(3):
        up = emit + 1e-5 * np.eye(3)[j]
        assert (likelihood(up, trans) - likelihood(emit, trans)) / 1e-5 == pytest.approx((y - p)[x == j].sum(), abs=1e-3)
    for a in (0, 1):
        for b in (0, 1):
            up = trans.copy()
            up[a, b] += 1e-5
            assert (likelihood(emit, up) - likelihood(emit, trans)) / 1e-5 == pytest.approx(pairs[a, b] - expected[a, b], abs=1e-3)


def test_spans_point_at_words():
    model = toxicity.Model(["you IDIOT stop", "idiot one", "an idiot two", "idiot three", "big idiot"] * 2, [f"fine text {i}" for i in range(40)])
    _, spans = model.read("What an Idiot, really")
    assert [("What an Idiot, really")[s["start"] : s["end"]] for s in spans] in (["Idiot"], [])


# 8


def test_lines(documents, none):
    rows = {r["doc_id"]: r for r in linededup.dedup_lines(documents).collect()}
    assert rows[0]["text"] is None and rows[13]["text"] == "" and rows[12]["text"] == "a\nb\nc" and rows[14]["text"] == "d"
    assert linededup.dedup_lines(none).count() == 0
    assert set(documents.columns) <= set(linededup.dedup_lines(documents).columns)


LONG_LINE = " ".join(f"p{i}" for i in range(51))
SHARED_IDS = [
    (1, "a\nb\nc"), (7, "a\nb\nc"), (7, "unique a\nunique b\nunique c"), (7, "a\nb\nc"), (None, "a\nb"), (None, "x\ny\nz"), (None, "q\nx\ny"), (8, LONG_LINE),
    (8, "f\n" + LONG_LINE + "\ng"), (9, LONG_LINE), (9, "other " + LONG_LINE), (None, None), (10, "c\nd\ne\nd\ne\nd\ne"), (3, "e\nd\n\n \n  e \nz\na\nb"), (None, ""), (11, "b\nc"),
]


def test_lines_of_rows_that_share_an_id(spark):
    frame = spark.createDataFrame(SHARED_IDS, "doc_id long, text string")
    got = Counter((r["doc_id"], r["text"]) for r in linededup.dedup_lines(frame).collect())
    assert got == Counter(zip([i for i, _ in SHARED_IDS], brute_lines(SHARED_IDS), strict=True))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.lists(st.sampled_from("abcd "), max_size=9)), max_size=8), st.integers(2, 4))
def test_lines_by_brute_force(spark, rows, span):
    made = [(i, "\n".join(x)) for i, x in rows]
    frame = spark.createDataFrame(made, "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_removed"]) for r in linededup.dedup_lines(frame, span).collect())
    seen, gone = defaultdict(set), defaultdict(set)
    full = [[k for k, x in enumerate(t) if x.strip()] for _, t in rows]
    for n, (i, t) in enumerate(rows):
        for s in range(len(full[n]) - span + 1):
            seen["".join(t[k] for k in full[n][s : s + span])].add((i, s, n, tuple(full[n][s : s + span])))
    for places in seen.values():
        for p in places:
            if p[:2] > min(places)[:2]:
                gone[p[2]].update(p[3])
    assert got == Counter((i, len(gone[n])) for n, (i, _) in enumerate(rows))


# 9

PAGE = """<html><head><title>t</title><script>var a="<p>no</p>";</script></head><body><header>Site</header><nav><ul><li><a href=x>Home</a></ul></nav>
<div class="ad"><p>Buy this long and shining thing right now, today only, for you.</p></div>
<article><h1>A &amp; B</h1><p>First   paragraph<br>with <b>bold text and &eacute;<p>Second one, which is long enough to be content.</article>
<aside><p>Another box with a rather long text that is not the article at all.</p></aside><footer>foot</footer></body></html>"""


def test_extraction(spark):
    rows = [(i, "u", PAGE, 1) for i in range(5)] + [(10, "u", None, 1), (11, "u", "", 1), (12, None, "<p", 1), (13, "u", "no markup here, but a sentence of text", 1), (0, "u", PAGE, 1)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = {r["page_id"]: r for r in html.extract(frame).collect()}
    want = "A & B\n\nFirst paragraph with bold text and é\n\nSecond one, which is long enough to be content."
    assert got[0]["text"] == want and got[0]["n_chars"] == len(want)
    assert got[10]["text"] == got[11]["text"] == "" and got[10]["n_chars"] == 0
    assert html.extract(frame).count() == len(rows) and html.extract(frame.limit(0)).count() == 0


@pytest.mark.parametrize("inner, want", [
    ("Let <math>x = 3</math> be given <object data=a>inside</object> here", "Let x = 3 be given inside here"), ("before <video src=a>after the film", "before after the film"), ("text <svg><text>label</text></svg> more", "text label more"),
    ("one <script>var x = 1; two", "one"), ("one <style>p {} <b>two</b>", "one two"), ("a <select><option>x<option>y</select> b <textarea>t</textarea> c", "a b c"), ("a <select><option>b", "a b"), ("<title>T</title>a<template><p>x</p></template>b", "ab"),
])
def test_elements_within_text(inner, want):
    """Only scripts, styles, titles, templates and form controls go whole; none that is left open takes the page with it."""
    blocks = [b for _, b in html.parse(f"<article><p>First one.<p>{inner}<p>Last one.</article>")[1]]
    assert blocks == ["First one.", want, "Last one."]


def test_equal_rows_do_not_remove_each_other(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (1, text), (2, text + " more"), (3, "short"), (3, "short"), (0, text[:150]), (0, text[:150])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("op3_suffix_dedup", "op8_line_dedup"):
        same(spark, str(tmp_path), QUERIES[name], ORACLE_SQL[name])


def test_lines_match_whatever_their_ends(spark, tmp_path):
    rows = [(1, "first line\nsecond line\nthird"), (2, "first line\r\n\tsecond line \r\nother"), (3, "\x0bfirst line\x0c\n\r\n  second line"), (4, "a\u00a0\nb"), (5, "a\nb")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    same(spark, str(tmp_path), QUERIES["op8_line_dedup"], ORACLE_SQL["op8_line_dedup"])
    got = {r["doc_id"]: r["n_removed"] for r in linededup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 2, 3: 2, 4: 0, 5: 0}


def test_letters_whose_lower_case_is_longer():
    page = "<body>" + "İ" * 6 + "<p>one paragraph<SCRIPT>var x = '<p>no</p>'</ſcript></Script><p>another</body>"
    assert [b for _, b in html.parse(page)[1]] == ["İ" * 6, "one paragraph", "another"]


@pytest.mark.parametrize("piece", ['<i title="x ', "<i title='x \" ", "<a ", "<!", "<p>", "</p>", "<svg/>", "<div", '<b "> ', "&amp", "<script>", "<p a='\">", "<!-- "])
def test_odd_markup_takes_linear_time(piece):
    import time

    for page in (piece * (600_000 // len(piece)), "<p>" + piece * 30_000 + "</p>>\"'", "<div>" * 20_000 + "</p>" * 20_000):
        start = time.process_time()
        html.parse(page)
        assert time.process_time() - start < 8


def test_tags_end_outside_quotes():
    page = """<p title="a > b" x='c > "d'>one</p><p title="never closed>two</p><p>three"""
    assert [b for _, b in html.parse(page)[1]] == ["one", "two", "three"]


def test_extraction_of_the_given_pages(spark):
    from html import unescape

    from landcube.llm.common import table

    pages = table(spark, "/root/testdata/sf0.01", "pages")
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in html.extract(pages).collect():
        article = re.search(r"<article>(.*)</article>", source[r["page_id"]], re.S)[1]
        blocks = [" ".join(unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == "\n\n".join(b for b in blocks if b)


def test_marginals_equal_enumeration():
    nodes, _ = html.parse("<div><p>some text here</p><div class=ad><p>other text</p></div></div>")
    html.features(nodes)
    model = html.Model()
    weight, on = 0.0, np.zeros(len(nodes))
    for code in range(1 << len(nodes)):
        y = [code >> i & 1 for i in range(len(nodes))]
        e = sum(y[i] * sum(model.weights[j] for j in n.features) for i, n in enumerate(nodes)) + sum(model.ties[y[n.parent]][y[i]] for i, n in enumerate(nodes) if i)
        weight, on = weight + np.exp(e), on + np.exp(e) * np.array(y)
    assert np.allclose(model.marginals(nodes)[0], on / weight)


# 10


def test_language_model(documents, none):
    old = lm.TOP, lm.SYMBOLS
    lm.TOP, lm.SYMBOLS = 30, 12  # most words are looked up
    try:
        rows = lm.score(documents).collect()
    finally:
        lm.TOP, lm.SYMBOLS = old
    texts, counts, ends = odd_texts(), Counter(), 0
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))}
    for i in [*range(len(texts)), 5]:
        if not held[i]:
            counts.update(low_words(texts[i]))
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    base = lambda c: log10((c + 0.5) / (n + 0.5 * (v + 1)))
    for r in rows:
        w = low_words(texts[r["doc_id"]])
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(w) + 1, sum(counts[x] > 0 for x in w) + 1, n)
        assert r["base_score"] == pytest.approx(sum(base(counts[x]) for x in w) + base(ends), rel=1e-9)
    assert len(rows) == len(texts) + 1 and lm.score(none).count() == 0


def test_forward_equals_enumeration():
    rng = np.random.default_rng(2)
    start, trans, emit = rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(5), 3).T
    model = lm.Hmm(start, trans, emit)
    texts = [np.array(x, np.uint32) for x in ([0, 3, 4, 1], [2], [1, 1])]
    for t, got in zip(texts, model.log10_likelihoods(texts), strict=True):
        total = 0.0
        for code in range(3 ** len(t)):
            s = [code // 3**i % 3 for i in range(len(t))]
            total += start[s[0]] * emit[t[0], s[0]] * np.prod([trans[a, b] * emit[x, b] for a, b, x in zip(s, s[1:], t[1:], strict=False)])
        assert got == pytest.approx(log10(total))


@pytest.mark.parametrize("stretch", [1, 2, 3, 1024])
def test_counts_equal_enumeration(monkeypatch, stretch):
    monkeypatch.setattr(lm, "STRETCH", stretch)
    monkeypatch.setattr(lm, "CELLS", 12)
    rng = np.random.default_rng(3)
    model = lm.Hmm(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(5), 3).T)
    texts = [np.array(x, np.uint32) for x in ([0, 3, 4, 1, 1, 2, 0], [2], [1, 1], [4, 0, 2, 2, 3], [3, 3, 3, 0])]
    starts, moves, shown = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for t in texts:
        ways = [[code // 3**i % 3 for i in range(len(t))] for code in range(3 ** len(t))]
        p = np.array([model.start[w[0]] * np.prod([model.trans[a, b] for a, b in zip(w, w[1:], strict=False)]) * np.prod([model.emit[x, k] for x, k in zip(t, w, strict=True)]) for w in ways])
        for w, q in zip(ways, p / p.sum(), strict=True):
            starts[w[0]] += q
            for a, b in zip(w, w[1:], strict=False):
                moves[a, b] += q
            for x, k in zip(t, w, strict=True):
                shown[x, k] += q
    for got, want in zip(model.counts(texts), (starts, moves, shown), strict=True):
        assert np.allclose(got, want)


def test_likelihood_rises():
    rng = np.random.default_rng(4)
    model = lm.Hmm(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(7), 3).T)
    texts = [np.array(rng.integers(0, 3 if i % 2 else 7, rng.integers(1, 60)), np.uint32) for i in range(80)]
    seen = []
    for _ in range(6):
        seen.append(model.log10_likelihoods(texts).sum())
        starts, moves, shown = model.counts(texts)
        model = lm.Hmm(starts / starts.sum(), moves / moves.sum(axis=1, keepdims=True), shown / shown.sum(axis=0))
    assert all(b > a for a, b in zip(seen, seen[1:], strict=False))


def test_words_share_out_the_whole_distribution(spark):
    words = [(b"aaa", 9), (b"bb", 4), (b"xing", 3), (b"ying", 2), (b"c", 1), ("ä".encode(), 1)]
    counts = spark.createDataFrame([(bytearray(w), c) for w, c in words], "word binary, c long")
    old, lm.SYMBOLS = lm.SYMBOLS, 2
    try:
        vocab = lm.vocabulary(counts, 5)
    finally:
        lm.SYMBOLS = old
    assert vocab.mass.sum() == pytest.approx(1) and vocab.size == 2 + vocab.classes + 1 and vocab.class_of(b"xing") == vocab.class_of(b"ying")
    for k in range(vocab.classes):
        inside = [c for w, c in words[2:] if vocab.class_of(w) == k]
        assert vocab.mass[2 + k] == pytest.approx((sum(c + 0.5 for c in inside) + 0.5 / vocab.classes) / vocab.total)


# the pipeline


def brute_lines(rows):
    """The texts of rows (doc_id, text), in order: runs of two or more lines, or a line of over 50 words, that occur earlier go."""
    windows = []
    for number, (i, text) in enumerate(rows):
        lines = (text or "").split("\n")
        full = [k for k, x in enumerate(lines) if x.strip(linededup.AROUND)]
        for s in range(len(full)):
            own = [lines[k].strip(linededup.AROUND) for k in full[s : s + 2]]
            place = (i is not None, i or 0, s)
            if len(own) == 2:
                windows.append((tuple(own), place, number, full[s : s + 2]))
            if len(re.findall("[^\x20\x09-\x0d]+", own[0])) > 50:
                windows.append(((own[0],), place, number, full[s : s + 1]))
    first, gone = {}, defaultdict(set)
    for key, place, _, _ in windows:
        first[key] = min(first.get(key, place), place)
    for key, place, number, at in windows:
        if place > first[key]:
            gone[number].update(at)
    return [t if not gone[k] else "\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone[k]) for k, (_, t) in enumerate(rows)]


def texts_of(frame):
    return {r["doc_id"]: r["text"] for r in frame.collect()}


def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline as cp
    from landcube.llm.common import table

    docs = table(spark, SF, "documents")
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    stages, kept = dict(cp.STAGES), {}
    for name, stage in cp.STAGES[:-1]:
        before, docs = texts_of(docs), stage(spark, docs, SF)
        assert docs.columns == cp.COLUMNS
        kept[name] = texts_of(docs)
        if name == "toxicity":
            bad = {r["doc_id"] for r in toxicity.score(table(spark, SF, "documents"), table(spark, SF, "labels")).where("score >= 0.3").collect()}
            want = {i: t for i, t in before.items() if i not in bad}
        elif name == "line_dedup":
            want = dict(zip(sorted(before), brute_lines(sorted(before.items())), strict=True))
        elif name == "simhash_dedup":
            root, _ = brute_near_copies(before)
            want = {i: t for i, t in before.items() if root[i] == i}
        else:
            judged = {i: brute_contamination(t, items) for i, t in before.items()}
            want = {i: t for i, t in before.items() if not (judged[i][1] and 20 * judged[i][1] >= judged[i][0])}
        assert kept[name] == want
    packed = stages["best_fit_packing"](spark, docs, SF).collect()
    assert {r["doc_id"] for r in packed} == set(kept["decontamination"])
    assert sorted(map(tuple, cp.run(spark, SF).select("doc_id", "piece", "start", "length", "ids_crc32").collect())) == sorted(tuple(r)[:5] for r in packed)


def test_pipeline_removes_long_lines_that_repeat_alone(spark):
    import corpus_pipeline as cp

    long, short = " ".join(f"p{i}" for i in range(51)), " ".join(f"q{i}" for i in range(50))
    texts = ["a\n" + long + "\nb", "c\n  " + long + " \nd", long, short, short, "e\n" + short + "\nf", "g\n" + long + "\nh\n\n" + long, "a\n" + long + "\nz", None, ""]
    frame = spark.createDataFrame([(i, t, None, None, -1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    found = {r["doc_id"]: (r["text"], r["n_chars"]) for r in cp.drop_repeated_lines(spark, frame, SF).collect()}
    same = lambda i: (texts[i], -1)
    assert found == {0: same(0), 1: ("c\nd", 3), 2: ("", 0), 3: same(3), 4: same(4), 5: same(5), 6: ("g\nh\n", 4), 7: ("z", 1), 8: same(8), 9: same(9)}


def brute_near_copies(texts):
    """The smallest id reachable by 5-word Jaccard of 0.8 or more, over all pairs; and the links."""
    sets = {i: frozenset(" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := low_words(t)) else frozenset() for i, t in texts.items()}
    root, linked, ids = {i: i for i in sets}, [], sorted(sets)
    for i in ids:
        for j in ids:
            if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                linked.append((i, j))
                a, b = min(root[i], root[j]), max(root[i], root[j])
                root = {k: a if r == b else r for k, r in root.items()}
    return root, linked


def test_near_duplicate_stage_against_jaccard(spark, monkeypatch):
    import corpus_pipeline as cp
    from landcube.llm import nearcopies

    rng, texts = random.Random(3), dict(enumerate(odd_texts()))
    for _ in range(25):  # copies with some words changed: 5-word similarity on both sides of 0.8
        words = [f"v{rng.randrange(5000)}" for _ in range(300)]
        for changes in (0, 1, 2, 4, 6, 8, 14):
            own = list(words)
            for _ in range(changes):
                own[rng.randrange(300)] = f"z{rng.randrange(9999)}"
            texts[len(texts)] = " ".join(own)
    root, linked = brute_near_copies(texts)
    far = sum(bin(simhash.fingerprint(texts[a]) ^ simhash.fingerprint(texts[b])).count("1") > 4 for a, b in linked)
    assert far > 50  # more than 4 SimHash bits do not show them
    frame = spark.createDataFrame([(i, t, None, None, None) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    for bucket in (nearcopies.BUCKET, 2):
        monkeypatch.setattr(nearcopies, "BUCKET", bucket)
        found = {r["doc_id"]: r["component_id"] for r in nearcopies.near_copies(frame).collect()}
        assert sum(found[a] == found[b] for a, b in linked) >= 0.99 * len(linked)
        assert all(root[i] == root[r] for i, r in found.items())
    assert set(texts_of(cp.drop_near_duplicates(spark, frame, SF))) == {i for i, r in found.items() if i == r}


def test_pipeline_judges_rows_that_share_an_id(spark):
    from pyspark.sql import functions as F

    import corpus_pipeline as cp
    from landcube.llm.common import table

    rng = random.Random(13)
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    copy = " ".join(f"n{rng.randrange(999)}" for _ in range(80))
    toxic = next(r["text"] for r in toxicity.scored(table(spark, SF, "documents"), table(spark, SF, "labels"), ["text"]).where("_score > 0.6").collect())
    texts = ["a clean one of its own", toxic, items[0][1], copy, copy + " end", "a\nb\nc", "c\na\nb", None, "", "another clean one"]
    rows = [(i, t) for i in (7, None, 8) for t in texts] + [(7, copy), (7, "a clean one of its own")]
    frame = spark.createDataFrame([(i, t, None, "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(cp.STAGES)
    pairs = lambda f: Counter((r["doc_id"], r["text"]) for r in f.collect())
    whole = table(spark, SF, "documents").unionByName(frame.withColumn("doc_id", frame["doc_id"] + 10**9).withColumn("source", F.lit("test")))
    assert pairs(stages["toxicity"](spark, whole, SF).where("source = 'test'")) == Counter((None if i is None else i + 10**9, t) for i, t in rows if t != toxic)
    assert pairs(stages["line_dedup"](spark, frame, SF)) == Counter(zip([i for i, _ in rows], brute_lines(rows), strict=True))
    assert pairs(stages["decontamination"](spark, frame, SF)) == Counter((i, t) for i, t in rows if not (h := brute_contamination(t, items))[1] or 20 * h[1] < h[0])
    root, _ = brute_near_copies(dict(enumerate(t for _, t in rows)))
    groups = {frozenset(k for k in root if root[k] == r) for r in root.values()}
    kept = pairs(stages["simhash_dedup"](spark, frame, SF))
    assert sum(kept.values()) == len(groups)
    for g in groups:  # one row of each group, with its smallest id, null first
        least = None if any(rows[k][0] is None for k in g) else min(rows[k][0] for k in g)
        assert sum(n for (i, t), n in kept.items() if i == least and any(rows[k] == (i, t) for k in g)) >= 1


def test_pipeline_stages_on_odd_rows(spark):
    import corpus_pipeline as cp

    texts = odd_texts()
    rows = [(i, t, None if i % 3 else "en", "s", None) for i, t in enumerate(texts)] + [(5, texts[5], "en", "s", 1), (None, "lost", None, None, None), (None, None, None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (frame, frame.limit(0)):
        for _, stage in cp.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == cp.COLUMNS
        assert cp.STAGES[-1][1](spark, docs, SF).count() >= docs.count()


def test_near_duplicate_stage_goes_by_simhash():
    """The fingerprint is the majority of the shingles' bits, its bands are its bits, and near sets meet by them."""
    from landcube.llm import nearcopies as nc

    def plain(own):
        bits = []
        for mix in nc.SALT.tolist():
            mixed = []
            for h in own.tolist():
                x = (h + mix) % 2**64
                x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
                x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
                mixed.append(x ^ x >> 31)
            bits += [2 * sum(x >> b & 1 for x in mixed) > len(mixed) for b in range(64)]
        return bits

    rng, met, far = np.random.default_rng(4), 0, []
    for n in (1, 2, 9, 256, 600):
        own = nc.shingles(" ".join(f"w{rng.integers(1 << 40)}" for _ in range(n + 4)))
        made, want = nc.simhash(own), plain(own)
        assert len(own) == n and [int(made[b // 64]) >> (b % 64) & 1 for b in range(64 * nc.WORDS)] == want
        assert nc.band_keys(made).tolist() == [(k << nc.WIDTH) + sum(want[k * nc.WIDTH + b] << b for b in range(nc.WIDTH)) for k in range(nc.BANDS)]
    for _ in range(300):  # just at 0.8
        both = rng.integers(0, 1 << 63, 100).astype(np.uint64)
        a, b = nc.simhash(both[:90]), nc.simhash(np.concatenate([both[:80], both[90:]]))
        met += bool((nc.band_keys(a) == nc.band_keys(b)).any()) and len(nc.close(np.stack([a[:2], b[:2]]))[0][0]) == 1
        far.append(int(np.bitwise_count(a ^ nc.simhash(rng.integers(0, 1 << 63, 90).astype(np.uint64))).sum()))
    assert met >= 298 and abs(np.mean(far) - 32 * nc.WORDS) < 5


def test_decontamination_stage_reads_its_texts_once_for_words(spark):
    """And winnows only documents that hold a fingerprint."""
    import corpus_pipeline as cp
    from landcube.llm.common import table

    docs = table(spark, SF, "documents")
    plan = cp.drop_contaminated(spark, docs, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2  # the rows, and the hits found
    windows = decontamination.benchmark_windows(table(spark, SF, "benchmark"), 13)
    rows = decontamination.words_in(docs).withColumn("h", decontamination.hashes_of(decontamination.F.col("w")))
    n = decontamination.holders(rows, windows, [13]).count()
    assert decontamination.sharing(docs, table(spark, SF, "benchmark")).count() <= n < docs.count() / 4


def test_near_copies_lose_no_link(spark, monkeypatch):
    """Pairs just at 0.8, of few shingles, of which SimHash bands miss one in 250; and the same if every shared shingle is a frequent one."""
    from landcube.llm import nearcopies as nc

    rng, texts = random.Random(21), []
    for _ in range(1500):
        words = [f"w{rng.randrange(1 << 30)}" for _ in range(9)]
        texts += [" ".join(words), " ".join(words[:8])]
    long = "x" * 3000
    texts += [f"{long} a b c d e f g h", f"{long} a b c d e f g", f"{long}x a b c d e f g", "a b c d e f g", "common words of all sets are these"] * 2
    texts += [f"common words of all sets are these {i} {i}" for i in range(200)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: i - i % 2 for i in range(3000)}
    want |= {i: i for i in range(3000, len(texts))} | {3001: 3000, 3005: 3000, 3006: 3000, 3007: 3002, 3008: 3003, 3009: 3004}
    for few in (nc.FEW, 1):
        monkeypatch.setattr(nc, "FEW", few)
        monkeypatch.setattr(nc, "BUCKET", 1024 if few > 1 else 2)
        assert {r["doc_id"]: r["component_id"] for r in nc.near_copies(frame).collect()} == want


def test_bounds_of_near_copies_keep_all_that_are_alike():
    from landcube.llm import nearcopies as nc

    rng = np.random.default_rng(9)
    common = np.unique(rng.integers(0, 1 << 62, 50).astype(np.uint64))
    for n in (1, 4, 5, 9, 60, 127, 128, 900, 40_000):
        for _ in range(20):
            both = np.unique(np.concatenate([rng.integers(0, 1 << 64, n, np.uint64), rng.choice(common, min(n, 20))]))
            less = rng.permutation(both)[: -(-4 * len(both) // 5)]
            a, b = both, np.sort(less)
            assert nc.near(a, [b])[0] and set(nc.first_tokens(a, common).tolist()) & set(nc.first_tokens(b, common).tolist())
            i, j = nc.apart(np.array([len(a), len(b)]), [nc.parity(a).tobytes(), nc.parity(b).tobytes()], np.array([0, 1]))
            assert {*i.tolist(), *j.tolist()} == {0, 1}
    other = [np.unique(rng.integers(0, 1 << 64, n, np.uint64)) for n in (300, 300, 320, 1000, 1100)]
    assert not len(nc.apart(np.array([len(x) for x in other]), [nc.parity(x).tobytes() for x in other], np.arange(5))[0])


def test_only_buckets_to_be_split_come_to_the_driver(spark, monkeypatch):
    from landcube.llm import nearcopies as nc

    texts = [f"a{i // 3} b c d e f g h i{i // 3} j k l m n{i % 3 // 2}" for i in range(60)] + ["", None, "alone"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    kept, write, found = [], nc.materialize, []
    monkeypatch.setattr(nc, "materialize", lambda df, name: [kept.append((name, made := write(df, name))), made][1])
    for held in (nc.HELD, 2):
        monkeypatch.setattr(nc, "HELD", held)
        found.append(sorted(map(tuple, nc.near_copies(frame).collect())))
    few, many = (made.count() for name, made in kept if name == "buckets")
    assert few == 0 < many and found[0] == found[1]
