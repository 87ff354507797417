"""Removal of repeated runs of lines by winnowing (operator 8), with DataFrame functions only.

Lines are compared without the white space around them, so line ends of either kind match; blank lines take no part and stay. A run counts from ``span``
consecutive lines on, and a line of more than ``long`` words is a run by itself. Of the line hashes in each window of
``span`` lines the smallest, leftmost on ties, is selected as the window's fingerprint, and so is every long line; a line
selected by several windows is one fingerprint. Two documents that share a run share a fingerprint at the same place in it.

1. Fingerprints that occur once drop out, and with them most lines.
2. Each of the others is extended both ways, to the windows that it was selected for. Windows are joined on all their
   lines' hashes; the earliest of equal ones (smaller doc_id, or same doc_id and earlier line) stays.
3. Later windows that overlap or touch make up the maximal repeated runs; their lines are removed.

Fingerprints are written once, without the texts. A fingerprint's count and a window's first occurrence are aggregates that every task forms before the shuffle, so a line
that a third of the corpus shares is one row per task there. Both are written and read again too, so both sides of the joins
that bring them back come from plain shuffles, and the adaptive skew join splits such a line's rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landcube.llm.common import materialize, need

#: Lines of a run at least; words of a line above which it is a run by itself.
SPAN, LONG = 2, 50
#: White space around a line, which doesn't count: space, tab, carriage return, and the vertical ones.
AROUND = " \t\r\x0b\x0c"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def row_key(text: Column) -> Column:
    """Tells rows of one doc_id apart; rows with equal doc_id and text need not be."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def upto(last: Column) -> Column:
    """0 to ``last``; nothing if that is below 0."""
    return F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def place_of_least(window: Column) -> Column:
    return F.array_position(window, F.array_min(window)).cast("int") - 1


def fingerprints(documents: DataFrame, span: int, long: int) -> DataFrame:
    """doc_id, own (the row's key), p (the line's place among those not blank), fp (its hash), wide, and what is around it:
    low (the first place that a window with p can have), near (hashes from there on) and lines (their places among all)."""
    full = F.filter(F.transform(lines_of(F.col("text")), lambda x, i: F.struct(F.trim(x, F.lit(AROUND)).alias("x"), i.alias("i"))), lambda e: e["x"] != "")
    spaces = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" ")))
    # single spaces alone are counted without splitting the line
    single = lambda x: ~reduce(lambda a, b: a | b, [F.contains(x, F.lit(y)) for y in ("  ", *AROUND[1:])])
    words = lambda x: F.when(single(x), spaces(x) + 1).otherwise(F.size(F.split(x, r"[\x20\x09-\x0d]+")))
    wide = lambda x: (F.length(x) > 2 * long) & (words(x) > long)
    lines = F.transform(full, lambda e: F.struct(F.xxhash64(e["x"]).alias("h"), e["i"].alias("at"), wide(e["x"]).alias("wide")))
    rows = need(documents, "doc_id", "text").select("doc_id", row_key(F.col("text")).alias("own"), lines.alias("e"))
    minima = F.transform(upto(F.size("e") - span), lambda s: s + place_of_least(F.slice("e", s + 1, span)["h"]))
    alone = F.filter(F.transform("e", lambda e, i: F.when(e["wide"], i)), lambda i: i.isNotNull())

    def around(p: Column) -> Column:
        low, own = F.greatest(p - (span - 1), F.lit(0)), F.get("e", p)
        near = F.slice("e", low + 1, F.least(F.size("e"), p + span) - low)
        return F.struct(p.alias("p"), own["h"].alias("fp"), own["wide"].alias("wide"), low.alias("low"), near["h"].alias("near"), near["at"].alias("lines"))

    return rows.select("doc_id", "own", F.explode(F.transform(F.array_distinct(F.concat(minima, alone)), around)).alias("f")).select("doc_id", "own", "f.*")


def windows_of(marked: DataFrame, span: int) -> DataFrame:
    """doc_id, own, fp, around (a hash of all lines of the window), s (its first line) and at (its lines among all)."""

    def window(k: Column) -> Column:
        win = F.slice("near", k + 1, span)
        return F.struct(F.xxhash64(win).alias("around"), (F.col("low") + k).alias("s"), F.slice("lines", k + 1, span).alias("at"), (place_of_least(win) == F.col("p") - F.col("low") - k).alias("selected"))

    at = F.col("p") - F.col("low")
    single = F.struct(F.xxhash64(F.array("fp")).alias("around"), F.col("p").alias("s"), F.slice("lines", at + 1, 1).alias("at"), F.lit(True).alias("selected"))
    runs = F.filter(F.transform(upto(F.size("near") - span), window), lambda w: w["selected"])
    all_windows = F.concat(runs, F.filter(F.array(single), lambda w: F.col("wide")))
    return marked.select("doc_id", "own", "fp", F.explode(all_windows).alias("w")).select("doc_id", "own", "fp", "w.around", "w.s", "w.at")


def repeated_lines(documents: DataFrame, span: int, long: int) -> DataFrame:
    """doc_id, own and gone: the lines (from 0) of the windows that occur earlier, per row."""
    marked = materialize(fingerprints(documents, span, long), "marked")
    repeated = materialize(marked.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp"), "fingerprints")
    place = F.struct("doc_id", "s")
    windows = materialize(windows_of(marked.join(repeated, "fp"), span), "windows")
    firsts = materialize(windows.groupBy("fp", "around").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "firsts")
    later = windows.join(firsts, ["fp", "around"]).where(place > F.col("first"))
    return later.groupBy("doc_id", "own").agg(F.array_distinct(F.flatten(F.collect_set("at"))).alias("gone"))


def dedup_lines(documents: DataFrame, span: int = SPAN, long: int = LONG) -> DataFrame:
    """All columns of ``documents`` with ``text`` less its repeated runs of lines, and n_lines, n_removed.

    A null text stays null; a text of which nothing is left is empty. Rows that share a doc_id, or have none, are judged
    and cut each for itself; lines at one place in them don't remove each other, so equal rows don't. A null doc_id comes
    before all others. n_lines counts all lines, blank ones too. Other columns stay as they are; an empty table gives no
    rows.
    """
    hits = repeated_lines(documents, span, long).withColumnsRenamed({"doc_id": "hit_id", "own": "hit"})
    names = documents.columns
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("doc_id").alias("id"), row_key(F.col("text")).alias("own"))
    joined = rows.join(hits, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("own") == F.col("hit")), "left")
    joined = joined.select("row", "gone", lines_of(F.col("row")["text"]).alias("lines"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.transform(left, lambda i: F.get("lines", i))
    text = F.when(F.col("gone").isNull(), F.col("row")["text"]).otherwise(F.array_join(kept, "\n"))
    made = [(text if c == "text" else F.col("row")[c]).alias(c) for c in names if c not in ("n_lines", "n_removed")]
    return joined.select(*made, F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))


def report(documents: DataFrame) -> DataFrame:
    made = dedup_lines(need(documents, "doc_id", "text"))
    return made.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT rid, doc_id, unnest(l) AS x, unnest(range(len(l))) AS i FROM d),
num AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY i) - 1 AS s FROM (SELECT rid, doc_id, x, i, trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS a FROM lines) WHERE a <> ''),
win AS (SELECT rid, doc_id, i, s, a, lead(a) OVER (PARTITION BY rid ORDER BY i) AS b FROM num),
pair AS (SELECT *, rank() OVER (PARTITION BY a, b ORDER BY doc_id NULLS FIRST, s) AS k FROM win WHERE b IS NOT NULL),
long AS (SELECT *, rank() OVER (PARTITION BY a ORDER BY doc_id NULLS FIRST, s) AS k FROM win WHERE len(regexp_extract_all(a, '[^\x20\x09-\x0d]+')) > 50),
gone AS (SELECT rid, s + o AS s FROM pair, (VALUES (0), (1)) v(o) WHERE k > 1 UNION SELECT rid, s FROM long WHERE k > 1),
kept AS (SELECT l.rid, string_agg(l.x, chr(10) ORDER BY l.i) AS t FROM lines l LEFT JOIN num n USING (rid, i) LEFT JOIN gone g ON g.rid = l.rid AND g.s = n.s WHERE g.rid IS NULL GROUP BY l.rid),
cut AS (SELECT rid, count(*) AS n FROM gone GROUP BY rid)
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid) LEFT JOIN cut USING (rid)
"""
