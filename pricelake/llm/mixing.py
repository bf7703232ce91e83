"""Mixing sources to target weights with exact budgets; DataFrame functions only.

The size of a document is its number of words. Sources in code-point order (null last) take the
weights 5, 2, 1 in turn and share ``SHARE`` times all words; no source is asked for more than
``REPEATS`` times its own words, and what it cannot take is shared by weight among the rest until
none is above (water-filling: each target is the smaller of its cap and a common level times its
weight). Within a source, documents stand in the order of a hash of their id and text. Hash keys are
uniform, so equal key ranges hold about equal numbers of rows: sums per (source, range) give each
range its offset, and a running sum inside a range its documents' places. A source takes whole
epochs of all its documents as often as the target allows and then the documents before the cut;
the document at the cut is taken in part, so that the taken words meet the rounded-down target.

Defined cases: null or blank texts have size 0 and take 0; repeated rows are separate documents;
an empty table gives no rows; a source of blank texts only has target 0; a very long text is one size;
extra columns are ignored, whatever their names. Targets are found over a row per source in one
task, which suits sources named in thousands, not a source per host.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD

WEIGHTS, SHARE, REPEATS = (5, 2, 1), 1.5, 2
#: Hexadecimal digits of the key that name its range; 16 ** RANGE_DIGITS ranges in a source.
RANGE_DIGITS = 3


def size_of(text="text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target from one row per source; a row per source, so windows over all of them are small."""
    in_order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    cycle = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(in_order) - 1) % len(WEIGHTS) + 1).cast("int"))
    weighed = sizes.withColumn("weight", cycle.cast("double")).withColumn("cap", (F.lit(REPEATS) * F.col("source_size")).cast("double"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    everything = by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before, after = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) * SHARE - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    # The level of the first source whose cap lies above it; those before stand at their caps.
    levelled = weighed.withColumn("level", level).withColumn("first", F.min(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(everything))
    return levelled.select("source", "source_size", F.least("cap", F.col("first.level") * F.col("weight")).alias("target"))


def mixed(documents: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (and carried columns) for every document."""
    carry = carry or []
    # The text's own digest parts rows that share an id or have none.
    text = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text).cast("binary"))
    sized = documents.select("doc_id", "source", *carry, size_of().alias("size"), key.alias("__key")).withColumn("__range", F.substring("__key", 1, RANGE_DIGITS))
    # A key without nulls: windows and join then need the same partitioning, and rows are shuffled once.
    sized = sized.withColumn("__source", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")))
    ranges = sized.groupBy("source", "__source", "__range").agg(F.sum("size").alias("__range_size"))
    goals = targets(ranges.groupBy("source").agg(F.sum("__range_size").alias("source_size")))
    before = Window.partitionBy("__source").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select(F.col("source").alias("__s"), "__source", "__range", F.coalesce(F.sum("__range_size").over(before), F.lit(0)).alias("__offset"))
    goals = goals.select(F.col("source").alias("__g"), "source_size", "target")
    facts = offsets.join(goals, F.col("__s").eqNullSafe(F.col("__g"))).select("__source", "__range", "__offset", "source_size", "target")
    inside = Window.partitionBy("__source", "__range").orderBy("__key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sized.withColumn("__within", F.sum("size").over(inside) - F.col("size"))
    joined = placed.join(facts, ["__source", "__range"])
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size") - F.col("__offset") - F.col("__within")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(rest, F.col("size")))
    return joined.select("doc_id", "source", *carry, "size", "source_size", "target", taken.cast("long").alias("taken"))


MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                  md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight, CAST(2 * source_size AS DOUBLE) AS cap FROM s),
v AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS n FROM w),
l AS (SELECT a.source, a.source_size, a.weight, a.cap, a.n,
             ((SELECT sum(source_size) FROM v) * CAST(1.5 AS DOUBLE) - coalesce((SELECT sum(b.cap) FROM v AS b WHERE b.n < a.n), 0)) / (SELECT sum(b.weight) FROM v AS b WHERE b.n >= a.n) AS level FROM v AS a),
f AS (SELECT level FROM l WHERE cap >= level * weight ORDER BY n LIMIT 1),
t AS (SELECT source, source_size, least(cap, (SELECT level FROM f) * weight) AS target FROM l),
p AS (SELECT d.*, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
             CAST(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size > 0 THEN (budget // source_size) * size + greatest(0, least(budget - (budget // source_size) * source_size - before, size)) ELSE 0 END AS BIGINT) AS taken
FROM p
"""
