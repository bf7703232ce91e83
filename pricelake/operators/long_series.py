"""WIN-6 for series too long for one task: exact flags from slices of time and ranges of values.

A slice holds a fixed number of a series' values in time order, a bin as many in order of value.

1. While a slice goes by, the median moves by at most as many ranks as the slice has values. So a task that
   holds a slice and the earlier values of about twice as many ranks around their median knows every median of it;
   counts by bin and slice tell which bins these are.
2. Whether a value is an outlier depends on the median deviation only by a limit that follows from the median and
   the value: it is one if at least half of the earlier values lie within the limit. Counting those before the
   slice is a question for each end of the interval. The slices before a slice are a union of few blocks of
   2^k slices; in each block, values and questions are put in order over many tasks and summed up.

Counts by bin and slice are as many as the square of the number of slices, so slices hold at least the square root of
the longest series' length, and more than asked for where a series would fill more than ``SLICES`` of them. A value is written once for about half of the binary digits of the number of slices.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricelake.sources.scratch import numbered, written

#: Values of a slice and of a bin; a task holds some five times as many.
SLICE = 100_000
#: Slices of a series beyond which they grow with it, up to SLICE values each.
SLICES = 256
NODE = ["h", "level", "node"]


def rows_of_slice(longest: int, least: int) -> int:
    """Values of a slice, at least as many as asked for: neither slices nor the square of their number outgrow the longest series."""
    return max(least, min(-(-longest // SLICES), SLICE), math.isqrt(longest))


def first_true(holds: Callable[[float], bool], no: float, yes: float) -> float:
    """The smallest double for which holds, which fails at no and holds at yes, is true."""
    while True:
        middle = no + (yes - no) / 2
        if middle in (no, yes):
            return yes
        if holds(middle):
            yes = middle
        else:
            no = middle


def limits(value: float, middle: float, z: float) -> tuple[float, float] | None:
    """The ends of the values whose distance from middle is at most the largest deviation at which value is an outlier; None if there is no such deviation."""
    gap = abs(value - middle)
    far = lambda s: gap / (s * 1.4826) > z
    if z < 0 or (z == 0 and gap > 0):
        return -math.inf, math.inf
    if gap == 0:
        return None
    about = gap / (1.4826 * z)
    most = -_near(lambda s: far(-s), -about, about)
    scale = abs(middle) + most
    low = _near(lambda a: middle - a <= most, middle - most, scale)
    high = -_near(lambda a: -a - middle <= most, -(middle + most), scale)
    return low, high


def _near(holds: Callable[[float], bool], about: float, scale: float) -> float:
    """first_true around about, known but for a few roundings of numbers of the scale."""
    width = scale * 1e-14
    if holds(about - width) or not holds(about + width):
        width = scale * 1e-9
    return first_true(holds, about - width, about + width)


ASKED = "i long, h long, slice long, n long, value double, z double, middle double, low double, high double, own long, own_in_low double, own_out_low double, own_in_high double, own_out_high double, own_equal long"


def _asked(slice_rows: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The median before each value of a slice, and what to ask of the slices before it."""

    def run(own: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
        held = sorted(around["value"])
        before = int(around["below"].min()) if len(around) else 0
        mine: list[float] = []
        found = []
        own = own.sort_values("n")
        for i, h, s, n, value, z, least in zip(*(own[c].tolist() for c in ("i", "h", "slice", "n", "value", "z", "least")), strict=True):
            past = n - 1
            if past >= max(least, 1):
                at = past // 2 - before
                middle = (held[(past - 1) // 2 - before] + held[at]) / 2
                ends = limits(value, middle, z)
                if ends is not None:
                    low, high = ends
                    a, b = bisect_left(mine, low), bisect_right(mine, high)
                    # More than half of the past can equal the median only if it does a quarter of it, or as far as is known, to either side.
                    reach = min(slice_rows // 2, past // 4)
                    equal = bisect_right(mine, middle) - bisect_left(mine, middle) if middle in (held[max(0, at - reach)], held[min(len(held) - 1, at + reach)]) else None
                    get = lambda k: mine[k] if 0 <= k < len(mine) else None
                    found.append((i, h, s, n, value, z, middle, low, high, b - a, get(a), get(a - 1), get(b - 1), get(b), equal))
            insort(held, value)
            insort(mine, value)
        # Objects, so that what is not there stays null.
        return pd.DataFrame(found, columns=[c.split()[0] for c in ASKED.split(", ")], dtype="object")

    return run


def _around_medians(values: DataFrame, slice_rows: int) -> DataFrame:
    """h, slice, value, below: for each slice the earlier values around their median, and how many lie below all of them."""
    counts = values.groupBy("h", "bin", "slice").agg(F.count("*").alias("c"))
    last = values.groupBy("h").agg(F.max("slice").alias("last"))
    grid = last.select("h", "last", F.explode(F.sequence(F.lit(0), "last")).alias("bin")).select("h", "bin", F.explode(F.sequence(F.lit(0), "last")).alias("slice"))
    all_before = Window.partitionBy("h", "bin").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    upwards = Window.partitionBy("h", "slice").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    known = grid.join(counts, ["h", "bin", "slice"], "left").withColumn("c", F.coalesce(F.sum("c").over(all_before), F.lit(0))).withColumn("upto", F.sum("c").over(upwards))
    half = F.col("slice") * slice_rows / 2
    known = known.withColumn("below", F.col("upto") - F.col("c")).where((F.col("c") > 0) & (F.col("upto") >= half - slice_rows - 2) & (F.col("below") <= half + slice_rows + 2))
    needed = written(known.select("h", "bin", F.col("slice").alias("t"), F.min("below").over(Window.partitionBy("h", "slice")).alias("below")), "needed")
    around = values.select("h", "bin", "slice", "value").join(needed, ["h", "bin"]).where("slice < t").select("h", F.col("t").alias("slice"), "value", "below")
    return written(around, "around")


def _answers(values: DataFrame, asked: DataFrame, levels: int) -> DataFrame:
    """i, kind, count, under, over: of the values of slices before the asked one, how many come before x, the last of them, and the first other one.

    Values equal to x come after it for kind low and equal_low, and before it for high and equal_high.
    """
    level = F.explode(F.sequence(F.lit(0), F.lit(levels)))
    # The blocks below a slice number are those of its binary digits, all of them at even places.
    rows = values.select("h", "i", "value", "slice", level.alias("level")).withColumn("node", F.expr("shiftright(slice, level)")).where("node % 2 = 0")
    rows = rows.select(*NODE, F.col("value").alias("x"), F.lit(1).alias("side"), "i", F.lit(None).cast("string").alias("kind"))
    ends = F.explode(F.map_from_arrays(F.array(*(F.lit(k) for k in ("low", "high", "equal_low", "equal_high"))), F.array("low", "high", *(F.when(F.col("own_equal").isNotNull(), F.col("middle")),) * 2))).alias("kind", "x")
    questions = asked.select("h", "i", "slice", ends).where("x IS NOT NULL").select("h", "i", "kind", "x", "slice", level.alias("level")).withColumn("node", F.expr("shiftright(slice, level)") - 1).where("node >= 0 AND node % 2 = 0")
    questions = questions.select(*NODE, "x", F.when(F.col("kind").endswith("low"), 0).otherwise(2).alias("side"), "i", "kind")
    order = [*NODE, "x", "side", "i", "kind"]
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = written(rows.unionByName(questions).repartitionByRange(parts, *order).withColumn("range", F.spark_partition_id()), "ordered")
    value = F.when(F.col("kind").isNull(), F.col("x"))
    ranges = both.groupBy(*NODE, "range").agg(F.count(value).alias("c"), F.max(value).alias("u"), F.min(value).alias("o"))
    earlier = Window.partitionBy(*NODE).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*NODE).orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(*NODE, "range", F.sum("c").over(earlier).alias("c0"), F.max("u").over(earlier).alias("u0"), F.min("o").over(later).alias("o0"))
    inside = Window.partitionBy(*NODE, "range").rowsBetween(Window.unboundedPreceding, 0)
    up, down = inside.orderBy("x", "side", "i", "kind"), inside.orderBy(F.desc("x"), F.desc("side"), F.desc("i"), F.desc("kind"))
    told = both.select(*NODE, "range", "i", "kind", F.count(value).over(up).alias("c"), F.max(value).over(up).alias("u"), F.min(value).over(down).alias("o")).where("kind IS NOT NULL").join(ranges, [*NODE, "range"])
    return told.groupBy("i", "kind").agg(F.sum(F.col("c") + F.coalesce("c0", F.lit(0))).alias("count"), F.max(F.greatest("u", "u0")).alias("under"), F.min(F.least("o", "o0")).alias("over"))


def flagged(known: DataFrame, order: list[str], slice_rows: int = SLICE) -> DataFrame:
    """i and outlier of the values that have enough earlier ones to be judged.

    known: h (series, long), i (unique, long), the columns of order, value (double, not null), z, least. A slice holds
    slice_rows values or more (rows_of_slice).
    """
    names = ["h", "i", "value", "z", "least"]
    longest = known.groupBy("h").agg(F.count("*").alias("c")).agg(F.max("c")).first()[0] or 0
    slice_rows = rows_of_slice(longest, slice_rows)
    timed = numbered(known.select(*dict.fromkeys([*names, *order])), ["h"], [*order, "i"], "n").select(*names, "n")
    placed = numbered(timed, ["h"], ["value", "i"], "p")
    part = lambda c: F.floor((F.col(c) - 1) / slice_rows).cast("long")
    values = written(placed.select(*names, "n", part("n").alias("slice"), part("p").alias("bin")), "values")
    keys = ["h", "slice"]
    asked = written(values.groupBy(*keys).cogroup(_around_medians(values, slice_rows).groupBy(*keys)).applyInPandas(_asked(slice_rows), ASKED), "asked")
    levels = int(values.agg(F.max("slice")).first()[0] or 0).bit_length()
    a = _answers(values, asked, levels)
    of = lambda f, kind, c: f(F.when(F.col("kind") == kind, F.col(c)))
    told = a.groupBy("i").agg(
        *(of(F.max, k, "count").alias(k) for k in ("low", "high", "equal_low", "equal_high")),
        of(F.max, "low", "under").alias("out_low"), of(F.max, "low", "over").alias("in_low"), of(F.max, "high", "under").alias("in_high"), of(F.max, "high", "over").alias("out_high"),
    ).withColumnsRenamed({k: f"n_{k}" for k in ("low", "high", "equal_low", "equal_high")})
    j = asked.join(told, "i", "left")
    nothing = F.lit(0)
    within = F.col("own") + F.coalesce(F.col("n_high") - F.col("n_low"), nothing)
    equal = F.col("own_equal") + F.coalesce(F.col("n_equal_high") - F.col("n_equal_low"), nothing)
    past, middle = F.col("n") - 1, F.col("middle")
    gap = F.abs(F.col("value") - middle)
    lower, upper = F.floor((past - 1) / 2) + 1, F.floor(past / 2) + 1
    # Of the two middle distances one lies within the limits and one beyond: both are next to the ends.
    inner = F.greatest(middle - F.least("in_low", "own_in_low"), F.greatest("in_high", "own_in_high") - middle)
    outer = F.least(middle - F.greatest("out_low", "own_out_low"), F.least("out_high", "own_out_high") - middle)
    flat = gap > F.greatest(F.lit(1e-9), F.abs(middle) * 0.5)
    flag = F.when(equal >= upper, flat).when(within >= upper, True).when(within < lower, False).otherwise(gap / ((inner + outer) / 2 * 1.4826) > F.col("z"))
    return j.select("i", flag.alias("outlier"))
