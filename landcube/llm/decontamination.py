"""Benchmark decontamination by winnowing (operator 5), with DataFrame functions only.

A window is ``span`` consecutive words of a benchmark item, or the whole of a shorter item. Of the k-gram hashes in a
window the smallest is its fingerprint; so overlapping windows share most of them. Documents are winnowed alike, window
by window as they stream by, which keeps about two k-grams in seven. Fingerprints of both sides are joined, each match is
extended to the whole window both ways, word by word, and the windows found are united. Equal windows have equal
fingerprints at equal places, so every shared window is found.

A benchmark counted below ``BROADCAST_WINDOWS`` windows is broadcast; then only documents in which some k-gram is a window's
fingerprint are winnowed, as no other can share a window. Beyond that size the documents' fingerprints are shuffled without
their words; only the documents of matching ones are read again for the extension.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landcube.llm.common import fits, materialize, need

GRAM, BROADCAST_WINDOWS = 8, 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """The words of a text, in order: runs of a-z, 0-9 and characters beyond ASCII; null has none."""
    return F.array_remove(F.split(lowered(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def hashes_of(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def steps(last: Column) -> Column:
    """1 to ``last``; nothing if that is below 1."""
    return F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))


def grams_of(hashes: Column, k: int) -> Column:
    """The hash of each k consecutive words, as an array."""
    return F.transform(steps(F.size(hashes) - (k - 1)), lambda i: F.xxhash64(*[F.element_at(hashes, i + j) for j in range(k)]))


def benchmark_windows(benchmark: DataFrame, span: int) -> DataFrame:
    """Every different window once: its words, length, fingerprint with its place, and the items that hold it."""
    items = need(benchmark, "item_id", "text").select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("w"))
    length = F.least(F.size("w"), F.lit(span))
    cut = items.where(F.size("w") > 0).select("item", "w", length.alias("len"), F.explode(steps(F.size("w") - length + 1)).alias("s"))
    once = cut.select("item", F.slice("w", F.col("s"), F.col("len")).alias("win"), "len").groupBy("win", "len").agg(F.collect_set("item").alias("items"))
    k, hashed = F.least(F.col("len"), F.lit(GRAM)), once.withColumn("h", hashes_of(F.col("win")))
    by_k = F.coalesce(*[F.when(k == n, grams_of(F.col("h"), n)) for n in range(1, min(GRAM, span) + 1)])
    marked = hashed.withColumn("g", by_k)
    return marked.select(k.alias("k"), "len", F.array_min("g").alias("fp"), (F.array_position("g", F.array_min("g")) - 1).cast("int").alias("off"), "win", "items")


def winnowed(words: DataFrame, lengths: list[int]) -> DataFrame:
    """A row for every k-gram that is the smallest of a window: doc_id, own, w, k, p (its place, from 0) and fp.

    Windows of every length are numbered in one sequence. A window brings its smallest gram forth, leftmost on ties, unless
    the window before it has the same smallest hash and did not begin with it: then that window, or one before, did.
    """
    upto = [F.lit(0)]
    for n in lengths:
        upto.append(upto[-1] + F.greatest(F.size(f"g{min(GRAM, n)}") - (n - min(GRAM, n)), F.lit(0)))
    i, spans = F.col("i"), list(zip(lengths, upto, upto[1:], strict=False))
    # the hashes of the grams are made as arrays, so that what is done for a window is small enough to be compiled
    rows = words.withColumns({f"g{k}": grams_of(F.col("h"), k) for k in {min(GRAM, n) for n in lengths}}).drop("h")
    rows = rows.withColumn("i", F.explode(steps(upto[-1])))
    rows = rows.withColumns({"n": F.coalesce(*[F.when(i <= u, F.lit(n)) for n, _, u in spans]), "s": F.coalesce(*[F.when(i <= u, i - before - 1) for _, before, u in spans])})
    made = []
    for n in lengths:
        k, width, mine = min(GRAM, n), n - min(GRAM, n) + 1, F.col("n") == n
        gram = {f"g{n}_{t + 1}": F.get(f"g{k}", F.when(mine, F.col("s") + t)) for t in range(-1, width)}
        rows = rows.withColumns(gram)
        now, before = [F.col(g) for g in gram][1:], [F.col(g) for g in gram][:-1]
        rows = rows.withColumns({f"m{n}": F.least(*now) if width > 1 else now[0], f"b{n}": F.least(*before) if width > 1 else before[0]})
        least = F.col(f"m{n}")
        place = F.coalesce(*[F.when(g == least, F.col("s") + t) for t, g in enumerate(now)])
        new = (F.col("s") == 0) | (least != F.col(f"b{n}")) | (before[0] == least)
        made.append(F.when(mine & new, F.array(F.struct(F.lit(k).alias("k"), place.alias("p"), least.alias("fp")))))
    # an outer explode, as a plain condition would be pushed below all of this, with everything that it names made anew
    rows = rows.select("doc_id", "own", "w", F.explode_outer(F.coalesce(*made) if len(made) > 1 else made[0]).alias("f"))
    return rows.where("f is not null").select("doc_id", "own", "w", "f.*")


def holders(hashed: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """Of the rows (doc_id, own, w, h) those with a k-gram that is a window's fingerprint, equal ones once. windows are broadcast."""
    marks, ks, i = F.broadcast(windows.select("k", "fp").distinct()), sorted({min(GRAM, n) for n in lengths}), F.col("i")
    grams = [F.when(i + k <= F.size("h"), F.struct(F.lit(k).alias("k"), F.xxhash64(*[F.get("h", i + j) for j in range(k)]).alias("fp"))) for k in ks]
    # outer, as in winnowed
    placed = hashed.select("doc_id", "own", "w", "h", F.explode_outer(steps(F.size("h") - ks[0] + 1)).alias("at")).withColumn("i", F.col("at") - 1)
    if len(ks) == 1:
        placed = placed.withColumns({"k": grams[0]["k"], "fp": grams[0]["fp"]})
    else:
        placed = placed.withColumn("g", F.explode_outer(F.array(*grams))).select("doc_id", "own", "w", "h", "g.*")
    kept = placed.join(marks, ["k", "fp"], "left_semi")
    return kept.groupBy("doc_id", "own").agg(F.first("w").alias("w"), F.first("h").alias("h"))


def matches(hashed: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """doc_id, own, n_words, hits and items of the rows (doc_id, own, w, h) that share a window."""
    start = F.col("p") - F.col("off")
    equal = F.slice("w", start + 1, F.col("len")) == F.col("win")
    if fits(windows, BROADCAST_WINDOWS):
        joined = winnowed(holders(hashed, windows, lengths), lengths).join(F.broadcast(windows), ["k", "fp"]).where(start >= 0)
    else:
        found = winnowed(hashed, lengths).drop("w").join(windows, ["k", "fp"]).where(start >= 0)
        texts = hashed.select(F.col("doc_id").alias("id"), F.col("own").alias("key"), "w")
        joined = found.join(texts, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("own") == F.col("key")))
    hit = joined.where(equal).select("doc_id", "own", F.size("w").alias("n"), F.sequence(start, start + F.col("len") - 1).alias("hit"), "items").groupBy("doc_id", "own")
    return hit.agg(F.max("n").cast("long").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("hit")))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))


def words_in(documents: DataFrame) -> DataFrame:
    """doc_id, own (the text's hash) and w (its words) of each row."""
    return need(documents, "doc_id", "text").select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("own"), words_of(F.col("text")).alias("w"))


def sharing(documents: DataFrame, benchmark: DataFrame, span: int = 13) -> DataFrame:
    """The columns of :func:`contamination` for the documents that share a window, by doc_id and own; rows equal in both are one."""
    windows = materialize(benchmark_windows(benchmark, span), "windows")
    lengths = sorted(r["len"] for r in windows.select("len").distinct().collect())  # at most ``span`` numbers
    rows = words_in(documents)
    if not lengths:
        return rows.where("false").select("doc_id", "own", F.lit(0).cast("long").alias("n_words"), F.array().cast("array<int>").alias("hits"), F.array().cast("array<string>").alias("items"))
    return materialize(matches(rows.withColumn("h", hashes_of(F.col("w"))), windows, lengths), "hits")


def contamination(documents: DataFrame, benchmark: DataFrame, span: int = 13) -> DataFrame:
    """Per document row: doc_id, own (the text's hash), n_words, hits (the word positions inside any shared window, from 0),
    items (ids, sorted).

    Null, empty and wordless texts have no words and no hits; so have all if the benchmark is empty. Rows that share a
    doc_id, or have none, are judged each for itself. An item without an id marks words like any other, but is not among
    the items. Extra columns are ignored.
    """
    every = words_in(documents).select("doc_id", "own", F.size("w").cast("long").alias("n_words"))
    found = sharing(documents, benchmark, span).drop("n_words").withColumnsRenamed({"doc_id": "id", "own": "key"})
    joined = every.join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("own") == F.col("key")), "left")
    empty = [F.coalesce(c, F.array().cast(kind)).alias(c) for c, kind in (("hits", "array<int>"), ("items", "array<string>"))]
    return joined.select("doc_id", "own", "n_words", *empty)


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's columns."""
    n_hit = F.size("hits").cast("long")
    return contamination(documents, benchmark).select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), is_contaminated(n_hit, F.col("n_words")).alias("contaminated"))


_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

ORACLE_SQL = rf"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[s : s + least(len(w), 13) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS s FROM item WHERE len(w) > 0)),
doc AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
spot AS (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM doc, (SELECT DISTINCT n FROM wins)),
hit AS (SELECT rid, s, n, array_to_string(w[s : s + n - 1], ' ') AS win FROM spot),
found AS (SELECT rid, s, n, item FROM hit JOIN wins USING (n, win)),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM found) GROUP BY rid),
its AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM found GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
"""
