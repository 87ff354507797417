"""Mixing sources to target weights by hash thresholds (operator 11).

Each source gets a target in words: a share of all words by its weight, but never more than ``most`` times what it has; what
it can't take is shared again among the others by weight until none is above. A source's documents are taken whole: all of
them ``times`` times, and once more those whose hash lies below the source's threshold. Thresholds are nested: a smaller
target takes a subset of what a larger one takes.

A threshold is found by histograms. Words are summed by source and hash bucket (:data:`LEVELS` has the bits of each level);
a running sum over the buckets gives the one that the target ends in; only rows of these boundary buckets are summed again,
by their next bits, until each boundary bucket holds one hash. Nothing is sorted but a source's buckets. A histogram has at
most 4,096 rows for each source, whatever the data, and the rows themselves are read narrow: hash, source and size.

Of rows that share the boundary hash (repeated rows), as many are taken as bring the source nearest to its target; they are
one row with a count until then. Sources are ranked by ranges and counts of ranges, so their number may grow too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landcube.llm.common import materialize, need

#: Bits of the hash by level: 60 in all.
LEVELS = (12, 12, 12, 12, 12)
BITS = sum(LEVELS)
#: Copies of each source's plan, so that rows of one source, which may hold a third of all, are joined in as many parts.
SALTS = 64
#: Numbers of one row that a count is dealt by, when equal rows are told apart again.
CHUNK = 10_000
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """How many words a text has; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place(doc_id: Column, text: Column) -> Column:
    """A row's 60-bit place in the order of its source: from the MD5 of its id and of its text, nulls apart from texts."""
    seed = F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit("|"), F.coalesce(F.md5(text.cast("binary")), F.lit("-")))
    return F.conv(F.substring(F.md5(seed.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def ranked_sources(rows: DataFrame) -> DataFrame:
    """source, source_size and nth (from 0): sources by code point, null last; one row each."""
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    dealt = sums.repartitionByRange(F.col("source").isNull(), F.col("source")).withColumn("part", F.spark_partition_id())
    dealt = materialize(dealt, "sources")  # a part holds a range of sources, and keeps it
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each part
    parts = dealt.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("part").orderBy(F.col("source").isNull(), "source")
    return dealt.withColumn("k", F.row_number().over(own) - 1).join(parts, "part").select("source", "source_size", (F.col("base") + F.col("k")).alias("nth"))


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """``sources`` with weight, and each one's target as the fraction top / bottom of whole numbers.

    Sources that would be above ``most`` times their size are held there and the rest shared anew, until none is above;
    a round settles all that its level reaches, and only three sums come to the driver.
    """
    hundredths = round(share * 100)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    found = materialize(sources.withColumns({"weight": weight.cast("decimal(20,0)"), "most": (F.col("source_size") * most).cast("decimal(20,0)")}), "weighed")
    whole = (found.agg(F.sum("source_size").cast("decimal(38,0)")).first()[0] or 0) * hundredths  # in hundredths of words
    held, rest, total = F.lit(False), 0, 1
    level: tuple[int, int] | None = None
    while True:
        state = found.where(~held).agg(F.sum("weight"), F.count("*")).first()
        fixed = found.where(held).agg(F.sum(F.col("most") * 100)).first()[0] or 0
        rest, total = int(whole - fixed), int(state[0] or 1)
        if level == (rest, total):
            break
        level = (rest, total)
        held = F.col("weight") * F.lit(rest).cast("decimal(38,0)") > F.col("most") * F.lit(100 * total).cast("decimal(38,0)")
    top = F.when(held, F.col("most") * 100 * F.lit(total)).otherwise(F.col("weight") * F.lit(rest))
    return found.withColumns({"top": top.cast("decimal(38,0)"), "bottom": F.lit(100 * total).cast("decimal(38,0)")})


def _by_source(rows: DataFrame, plan: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` (with ``place``) joined with their source's row of ``plan``, a written table.

    Spark broadcasts the plan where it finds it small. Beyond that, each source's rows are dealt in :data:`SALTS` parts.
    """
    many = plan.withColumn("p_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("source", "p_source")
    dealt = rows.withColumn("salt", (F.col("place") % SALTS).cast("int"))
    return dealt.join(many, (F.col("salt") == F.col("p_salt")) & F.col("source").eqNullSafe(F.col("p_source")), how).drop("salt", "p_salt", "p_source")


def thresholds(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``plan`` (source, left2) with ``edge``, the place that half of ``left2`` ends at, and ``before``, the words below it.

    A row is within the target if its middle is: twice the words before it and its size are at most ``left2``. The edge is
    the place that has the first row beyond; it is past all places where none is.
    """
    state = plan.select("source", "left2", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"))
    ended, below = [], BITS
    for bits in LEVELS:
        state, above, below = materialize(state, "edges"), below, below - bits
        own = _by_source(rows, state).where(F.shiftright("place", above) == F.col("prefix"))
        hist = own.groupBy("source", "left2", "before", F.shiftright("place", below).alias("bucket")).agg(F.sum("size").alias("n"), F.min("place").alias("low"), F.max("place").alias("high"))
        upto = F.sum("n").over(Window.partitionBy("source").orderBy("bucket"))
        hist = hist.withColumn("upto", F.col("before") + upto).where(F.col("upto") * 2 > F.col("left2"))
        first = F.min_by(F.struct("bucket", "n", "upto", "low", "high"), "bucket").alias("b")
        edge = materialize(hist.groupBy("source", "left2").agg(first).select("source", "left2", F.col("b.bucket").alias("prefix"), (F.col("b.upto") - F.col("b.n")).alias("before"), F.col("b.low").alias("low"), F.col("b.high").alias("high")), "edges")
        # a bucket with one place needs no more bits
        done = F.lit(below == 0) | (F.col("low") == F.col("high"))
        ended.append(edge.where(done).select("source", F.col("low").alias("edge"), "before"))
        state = edge.where(~done).select("source", "left2", "prefix", "before")
        if below == 0 or state.isEmpty():
            break
    found = ended[0]
    for e in ended[1:]:
        found = found.union(e)
    found = found.select(F.col("source").alias("e_source"), "edge", "before")
    joined = plan.join(found, F.col("source").eqNullSafe(F.col("e_source")), "left").drop("e_source")
    return joined.withColumns({"edge": F.coalesce("edge", F.lit(1 << BITS)), "before": F.coalesce("before", F.lit(0).cast("long"))})


def mix(documents: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, source, size, source_size, target, times (how often the mix takes the row) and taken (its words).

    ``documents`` has doc_id, text and source; ``weights`` go round the sources in code-point order, null last. A text's
    size is its number of words; a null, empty or blank one has none and is taken with nothing. Repeated rows are rows of
    their own, of which as many are taken as the target needs. A table without words has targets of 0, an empty one no rows.
    Each source's words are within half a document of its target, that document being the one which the target ends in.
    """
    kept = [F.col(f"`{n}`").alias(f"k{i}") for i, n in enumerate(keep)]
    names = [f"k{i}" for i in range(len(keep))]
    rows = documents.select(*kept, F.col("source").alias("source"), words(F.col("text")).alias("size"), place(F.col("doc_id"), F.col("text")).alias("place"))
    rows = materialize(rows, "sized")
    goal = targets(ranked_sources(rows), weights, share, most)
    # whole rounds over the source, and twice what is left after them, rounded down
    size = F.col("source_size").cast("decimal(20,0)")
    goal = goal.withColumn("times", F.when(size > 0, F.expr("top div (bottom * source_size)")).otherwise(0).cast("int"))
    goal = goal.withColumn("left2", F.expr("(2 * top) div bottom") - F.col("source_size") * 2 * F.col("times"))
    goal = materialize(goal.select("source", "source_size", (F.col("top").cast("double") / F.col("bottom").cast("double")).alias("target"), "times", "left2"), "targets")
    plan = materialize(thresholds(rows.select("source", "size", "place"), goal), "thresholds")
    placed = _by_source(rows, plan)
    out = ["source", "size", "source_size", "target"]
    clear = placed.where("place <> edge or size = 0").withColumn("times", F.col("times") + F.when(F.col("place") < F.col("edge"), 1).otherwise(0))
    # rows at the edge: equal ones as one row with a count, of which the first few are taken once more
    alike = [*names, "source", "size", "place"]
    edge = placed.where("place = edge and size > 0").groupBy(*alike, "source_size", "target", "times", "left2", "before").agg(F.count("*").alias("n"))
    done = F.coalesce(F.sum(F.col("n") * F.col("size")).over(Window.partitionBy("source").orderBy("size", *names).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = edge.withColumn("fit", F.greatest(F.lit(0), F.floor((F.col("left2") - 2 * (F.col("before") + done) - F.col("size")) / (2 * F.col("size"))) + 1))
    many = edge.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK))))
    each = many.withColumn("k", F.explode(F.sequence(F.col("chunk") * CHUNK, F.least(F.col("n") - 1, F.col("chunk") * CHUNK + CHUNK - 1))))
    each = each.withColumn("times", F.col("times") + F.when(F.col("k") < F.col("fit"), 1).otherwise(0))
    both = clear.select(*names, *out, "times").union(each.select(*names, *out, "times"))
    return both.select(*[F.col(f"k{i}").alias(n) for i, n in enumerate(keep)], *[F.col(c) for c in out if c not in keep], F.col("times").cast("int").alias("times"), (F.col("size") * F.col("times")).cast("long").alias("taken"))


def drawn(documents: DataFrame, **how) -> DataFrame:
    """The mix itself: doc_id, source and text of each row as often as it is taken, with ``copy`` from 0."""
    made = mix(need(documents, "doc_id", "source", "text"), keep=("doc_id", "source", "text"), **how).where("times > 0")
    return made.select("doc_id", "source", "text", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("copy"))


def report(documents: DataFrame) -> DataFrame:
    """The contract's columns."""
    return mix(need(documents, "doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


#: The same mix by running sums over sorted rows. Sources held at their most come in order of size by weight.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '-') || '|' || coalesce(md5(text), '-')), 1, 15) AS BIGINT) AS place FROM documents),
s AS (SELECT source, CAST(sum(size) AS HUGEINT) AS source_size, CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS HUGEINT) AS w FROM d GROUP BY 1),
o AS (SELECT *, CAST((SELECT sum(source_size) FROM s) AS HUGEINT) * 3 - 4 * coalesce(sum(source_size) OVER before, 0) AS rest, sum(w) OVER after AS total FROM s
  WINDOW before AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  after AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
v AS (SELECT rest, total FROM o WHERE w * rest <= 4 * source_size * total ORDER BY source_size / w, source NULLS LAST LIMIT 1),
t AS (SELECT s.*, CASE WHEN w * rest > 4 * source_size * total THEN 2 * CAST(source_size AS DOUBLE) ELSE CAST(w * rest AS DOUBLE) / CAST(2 * total AS DOUBLE) END AS target,
  CASE WHEN w * rest > 4 * source_size * total THEN 4 * source_size ELSE (w * rest) // total END AS goal2 FROM s, v),
x AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN goal2 // (2 * t.source_size) ELSE 0 END AS times, goal2,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place, d.size, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
  CAST(size * (times + CASE WHEN 2 * done + size <= goal2 - 2 * source_size * times THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM x"""
