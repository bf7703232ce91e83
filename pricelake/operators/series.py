"""Price series: filters, statistics and window operators over time-stamped prices.

Series are keyed by columns of the caller's choice; ``order`` names the columns that put a series
in time order, ties included. Each operator shuffles once on its key.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricelake.functions.columns import in_stock, quality_label, rounded, watch_status
from pricelake.functions.running import Past
from pricelake.operators import long_series
from pricelake.sources.scratch import numbered, written

#: Rows of one key whose distinct values an aggregation may hold at once.
HELD = 1_000_000


def by(keys, order=None):
    w = Window.partitionBy(*([keys] if isinstance(keys, str) else keys))
    return w.orderBy(*order) if order else w


def latest(df: DataFrame, key, order: list[str], n: int = 1) -> DataFrame:
    """WIN-1: the row at place n from the end of each series."""
    newest = by(key, [F.col(c).desc() for c in order])
    return df.withColumn("__n", F.row_number().over(newest)).where(F.col("__n") == n).drop("__n")


def records_of_run(records: DataFrame, runs: DataFrame, n: int = 1) -> DataFrame:
    """WIN-2, WIN-3: records of the newest (or n-th newest) run of each site."""
    return records.join(latest(runs, "site_id", ["fetched_at", "run_id"], n).select("run_id"), "run_id", "left_semi")


def stale(runs: DataFrame, content: str, key="site_id", order=("fetched_at", "run_id")) -> DataFrame:
    """WIN-4: whether a run's content equals that of the run before."""
    before = F.lag(content).over(by(key, list(order)))
    return runs.withColumn("stale", F.coalesce(F.col(content) == before, F.lit(False)))


def movement(df: DataFrame, value: str, key, order: list[str]) -> DataFrame:
    """WIN-5: percent change against the value before, null where that is 0 or missing."""
    before = F.lag(value).over(by(key, order))
    return df.withColumn("movement", F.when(before != 0, rounded((F.col(value) - before) / before * 100, 1)))


def outliers(df: DataFrame, value: str, key, order: list[str], z: Column | float = 6.0, least: Column | int = 6, history: int | None = None, held: int = HELD, slice_rows: int = long_series.SLICE) -> DataFrame:
    """WIN-6: flags values far from the median of strictly earlier ones, in units of 1.4826 times their median deviation.

    A flat history allows half of its level. Fewer than ``least`` earlier values flag nothing; null
    values are neither flagged nor counted. Rows stream through in the order of their series, sorted
    by Spark, so a task holds the values of one series once. ``history`` bounds how many earlier
    values count, and with them what a task holds; without it, all do, and series of more than ``held``
    values are spread over tasks by slices (long_series.py).
    """
    keys = [key] if isinstance(key, str) else list(key)
    z, least = (x if isinstance(x, Column) else F.lit(x) for x in (z, least))
    rows = df.select(*df.columns, F.struct(*keys).alias("__key"), F.col(value).cast("double").alias("__value"), z.cast("double").alias("__z"), least.cast("int").alias("__least"))
    sizes = None if history is not None else large_keys(rows, "__value", keys, held)
    if sizes is None:
        return _streamed(rows, df, keys, order, history)
    names = [f"__k{i}" for i in range(len(keys))]
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)))
    facts = written(sizes.toDF(*names, "__size").withColumn("__h", F.monotonically_increasing_id()), "series")
    marked = written(rows.join(facts, same, "left").drop(*names, "__size").withColumn("__i", F.monotonically_increasing_id()), "long")
    known = marked.where("__h IS NOT NULL AND __value IS NOT NULL")
    times = [f"__t{n}" for n in range(len(order))]
    flags = long_series.flagged(known.select(F.col("__h").alias("h"), F.col("__i").alias("i"), F.col("__value").alias("value"), F.col("__z").alias("z"), F.col("__least").alias("least"), *(F.col(c).alias(t) for c, t in zip(order, times, strict=True))), times, slice_rows)
    spread = marked.where("__h IS NOT NULL").join(flags.withColumnsRenamed({"i": "__i", "outlier": "__flag"}), "__i", "left").select(*df.columns, F.coalesce("__flag", F.lit(False)).alias("outlier"))
    return _streamed(marked.where("__h IS NULL").drop("__h", "__i"), df, keys, order, None).unionByName(spread)


def _streamed(rows: DataFrame, df: DataFrame, keys: list[str], order: list[str], history: int | None) -> DataFrame:
    """Flags of rows (the columns of df, then key, value, z and least), each series in one task."""

    def run(batches: Iterator[pa.RecordBatch]):
        last, past = None, Past(history)
        for batch in batches:
            flags = []
            for k, v, far, n in zip(*(batch.column(c).to_pylist() for c in ("__key", "__value", "__z", "__least")), strict=True):
                if k != last:
                    last, past = k, Past(history)
                flags.append(v is not None and past.outlier(v, far, n))
                if v is not None:
                    past.add(v)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-4], pa.array(flags, pa.bool_())], [*batch.schema.names[:-4], "outlier"])

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("outlier", T.BooleanType())]))


def scaled(df: DataFrame, value: str, key, order: list[str]) -> DataFrame:
    """WIN-7: x and y of a chart line between 0 and 1, and its trend."""
    whole = by(key)
    low, high, n = F.min(value).over(whole), F.max(value).over(whole), F.count(value).over(whole)
    ordered = by(key, order)
    everything = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = F.when(n > 1, (F.row_number().over(ordered) - 1) / (n - 1)).otherwise(F.lit(0.0))
    trend = F.when(F.last(value).over(everything) >= F.first(value).over(everything), "up").otherwise("down")
    return df.withColumn("x", x).withColumn("y", (F.col(value) - low) / F.when(high > low, high - low).otherwise(1.0)).withColumn("trend", trend)


def large_keys(df: DataFrame, value: str, keys: list[str], held: int) -> DataFrame | None:
    """Keys with more than held known values and how many they have (__size); None if there are none."""
    known = df.where(F.col(value).isNotNull()).select(*keys)
    if known.limit(held + 1).count() <= held:
        return None
    sizes = written(known.groupBy(*keys).agg(F.count("*").alias("__size")).where(F.col("__size") > held), "large")
    return sizes if sizes.limit(1).count() else None


def large_medians(df: DataFrame, value: str, keys: list[str], held: int = HELD) -> DataFrame | None:
    """Keys with more than held known values, and their exact medians (__median); None if there are none.

    median() holds a counter for every distinct value of a key. Of large keys, values are put in order over
    many tasks instead, and the ones at the two middle places are read.
    """
    sizes = large_keys(df, value, keys, held)
    if sizes is None:
        return None
    known = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    names = [f"__k{i}" for i in range(len(keys))]
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)))
    facts = sizes.toDF(*names, "__size")
    # Equal values are told apart by a number of their own, so that a key's many equal values lie in several tasks.
    rows = known.join(facts, same).select(*keys, "__v", "__size", F.monotonically_increasing_id().alias("__i"))
    place = numbered(written(rows, "values"), keys, ["__v", "__i"], "__n")
    middle = place.where((F.col("__n") == F.floor((F.col("__size") + 1) / 2)) | (F.col("__n") == F.floor(F.col("__size") / 2) + 1))
    return middle.groupBy(*keys).agg(F.avg("__v").alias("__median"))


def with_medians(df: DataFrame, value: str, keys: list[str], held: int = HELD) -> tuple[DataFrame, Column]:
    """df with what it needs so that the column returned is, over its keys, the median of value."""
    large = large_medians(df, value, keys, held)
    if large is None:
        return df, F.col(value)
    names = [f"__k{i}" for i in range(len(keys))]
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)))
    marked = df.join(large.toDF(*names, "__median"), same, "left").drop(*names)
    # A large key has one value to hold, its median.
    return marked, F.coalesce("__median", value)


def deal_percent(df: DataFrame, value: str, key, held: int = HELD) -> DataFrame:
    """WIN-8: percent below the median of the group."""
    keys = [key] if isinstance(key, str) else list(key)
    rows, middle_of = with_medians(df, value, keys, held)
    medians = rows.groupBy(*keys).agg(F.median(middle_of).alias("__middle"))
    names = [f"__k{i}" for i in range(len(keys))]
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)))
    j = df.join(medians.toDF(*names, "__middle"), same, "left")
    off = F.when(F.col("__middle") > 0, rounded((F.col("__middle") - F.col(value)) / F.col("__middle") * 100, 1))
    return j.withColumn("deal_pct", off).drop("__middle", *names)


def numeric_series(df: DataFrame, value: str, key, order: list[str]) -> DataFrame:
    """FLT-3: the numeric values of each series, oldest first."""
    entries = F.sort_array(F.collect_list(F.struct(*order, F.col(value).alias("__value"))))
    keys = [key] if isinstance(key, str) else list(key)
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.transform(entries, lambda e: e["__value"]).alias("values"))


def one_series(df: DataFrame, value: str, key: str, wanted, order: list[str]) -> DataFrame:
    """FLT-2: one item's values in time order; a null wanted means rows without a key."""
    return df.where(F.col(key).eqNullSafe(F.lit(wanted)) & F.col(value).isNotNull()).orderBy(*order)


def due(sites: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """FLT-4: active sites whose last run is at least their interval ago, or that never ran."""
    last = runs.groupBy("site_id").agg(F.max("fetched_at").alias("last_run"))
    waited = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_run").cast("timestamp"))) / 60e6
    return sites.where("active = 1").join(last, sites["id"] == last["site_id"], "left").where(F.col("last_run").isNull() | (waited >= F.col("interval_minutes"))).select(*sites.columns, "last_run")


def price_insights(df: DataFrame, value: str, key, order: list[str]) -> DataFrame:
    """AGG-2: count, low, high, avg, current, percent against the rounded average, and whether it is the lowest ever."""
    keys = [key] if isinstance(key, str) else list(key)
    base = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("count"), F.min(value).alias("low"), F.max(value).alias("high"), rounded(F.sum(F.floor(F.col(value) * 100 + 0.5)) / F.count("*") / 100, 2).alias("avg"), F.max_by(value, F.struct(*order)).alias("current")
    )
    vs = F.when(F.col("avg") != 0, rounded((F.col("current") - F.col("avg")) / F.col("avg") * 100, 1))
    return base.withColumn("pct_vs_avg", vs).withColumn("is_all_time_low", F.col("current") <= F.col("low"))


def deal_scores(df: DataFrame, value: str, key, order: list[str]) -> DataFrame:
    """AGG-3: 0 to 100 from the place between high and low and the share of values at or above the current one.

    Two aggregations with partial sums; the first one's row per key meets the values again.
    """
    keys = [key] if isinstance(key, str) else list(key)
    known = df.where(F.col(value).isNotNull()).select(*keys, *(c for c in order if c not in keys), F.col(value).alias("__value"))
    facts = known.groupBy(*keys).agg(F.max_by("__value", F.struct(*order)).alias("current"), F.min("__value").alias("low"), F.max("__value").alias("high"))
    counted = known.select(*keys, "__value").join(facts, keys).groupBy(*keys, "current", "low", "high").agg(F.count("*").alias("n"), F.count_if(F.col("__value") >= F.col("current")).alias("at_least"))
    place = (F.col("high") - F.col("current")) / (F.col("high") - F.col("low"))
    score = F.floor(100 * (0.6 * place + 0.4 * (F.col("at_least") / F.col("n"))) + 0.5).cast("int")
    return counted.select(*keys, F.when((F.col("n") < 2) | (F.col("high") <= F.col("low")), 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), score))).alias("deal_score"))


def availability_stats(df: DataFrame, text: str, key, order: list[str]) -> DataFrame:
    """AGG-4: samples with a known state, percent in stock, restocks, and the last state."""
    keys = [key] if isinstance(key, str) else list(key)
    known = df.withColumn("__in", in_stock(text)).where("__in IS NOT NULL")
    steps = known.withColumn("__was", F.lag("__in").over(by(keys, order)))
    restock = F.sum(F.when(F.col("__in") & ~F.col("__was"), 1).otherwise(0))
    share = rounded(F.sum(F.col("__in").cast("int")) * 100 / F.count("*"), 1)
    return steps.groupBy(*keys).agg(F.count("*").alias("samples"), share.alias("in_stock_pct"), restock.alias("restocks"), F.max_by("__in", F.struct(*order)).alias("in_stock"))


def history_stats(df: DataFrame, value: str, key, since: Column | None = None, at: str = "seen_at", held: int = HELD) -> DataFrame:
    """AGG-5: count, low, high, avg, median of a product's prices in all stores since a time."""
    keys = [key] if isinstance(key, str) else list(key)
    rows, middle = with_medians(df if since is None else df.where(F.col(at) >= since), value, keys, held)
    cents = F.sum(F.floor(F.col(value) * 100 + 0.5))
    return rows.groupBy(*keys).agg(F.count("*").alias("count"), rounded(F.min(value), 2).alias("low"), rounded(F.max(value), 2).alias("high"), rounded(cents / F.count("*") / 100, 2).alias("avg"), rounded(F.median(middle), 2).alias("median"))


def price_summary(df: DataFrame, value: str, key, held: int = HELD) -> DataFrame:
    """AGG-6: min, max, avg, median, savings and count over known prices."""
    keys = [key] if isinstance(key, str) else list(key)
    g = history_stats(df.where(F.col(value).isNotNull()), value, keys, held=held)
    return g.select(*keys, F.col("low").alias("min"), F.col("high").alias("max"), "avg", "median", rounded(F.col("high") - F.col("low"), 2).alias("savings"), "count")


def site_health(sites: DataFrame, runs: DataFrame) -> DataFrame:
    """AGG-1: runs, mean confidence, heals and model runs of every site; idle sites show 0 and null."""
    g = runs.groupBy("site_id").agg(F.count("*").alias("runs"), F.avg("confidence").alias("confidence"), F.sum("healed").alias("heals"), F.sum("used_llm").alias("llm_runs"))
    j = sites.join(g, sites["id"] == g["site_id"], "left")
    return j.select("id", "url", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("runs", "heals", "llm_runs")), "confidence")


def recent_history(hits: DataFrame, points: DataFrame, key: str, day: str, value: str, days: int) -> DataFrame:
    """JOIN-3: hits (key, day) with hist_count, hist_low, hist_avg of the points (key, day) in the days before their own.

    Points become a row for each key and day first, so a key has as many rows as the calendar has days,
    however many points it has; the frame then runs over days.
    """
    cents = F.floor(F.col(value) * 100 + 0.5).cast("long")
    daily = points.where(F.col(value).isNotNull()).groupBy(key, day).agg(F.count("*").alias("__n"), F.min(value).alias("__low"), F.sum(cents).alias("__cents"))
    asked = hits.select(key, day).distinct().where(f"{key} IS NOT NULL AND {day} IS NOT NULL")
    both = daily.unionByName(asked, allowMissingColumns=True).withColumn("__day", F.unix_date(F.to_date(day)))
    before = Window.partitionBy(key).orderBy("__day").rangeBetween(-days, -1)
    n, total = F.sum("__n").over(before), F.sum("__cents").over(before)
    ahead = both.select(key, day, "__n", n.alias("hist_count"), rounded(F.min("__low").over(before), 2).alias("hist_low"), rounded(total / n / 100, 2).alias("hist_avg")).where("__n IS NULL").drop("__n")
    return hits.join(ahead, [key, day], "left")


def watchlist(sites: DataFrame, runs: DataFrame, records: DataFrame, points: DataFrame, order: list[str]) -> DataFrame:
    """WIN-9: a row for each site with the first record of its newest run, what changed since the run before, the
    statistics of that record's item, and how far the run can be trusted.

    sites: id, url, target_price; runs: site_id, run_id, fetched_at, confidence, field_sources (JSON);
    records: site_id, run_id, place, item_key, title, price, currency, availability; points: site_id, item_key, price and order.
    """
    newest = runs.select("site_id", "run_id", "fetched_at", "confidence", "field_sources").withColumn("__n", F.row_number().over(by("site_id", [F.desc("fetched_at"), F.desc("run_id")]))).where("__n <= 2")
    fields = ["item_key", "title", "price", "currency", "availability"]
    # The first record of each run is found before runs meet, by partial sums.
    heads = records.groupBy("site_id", "run_id").agg(F.min_by(F.struct(*fields), "place").alias("r"))
    last = newest.join(heads, ["site_id", "run_id"], "left")
    at = lambda n, c: F.max(F.when(F.col("__n") == n, F.col(c)))
    current = last.groupBy("site_id").agg(*(at(1, f"r.{f}").alias(f) for f in fields), at(2, "r.price").alias("prev_price"), at(1, "confidence").alias("confidence"), at(1, "field_sources").alias("__sources"), at(1, "fetched_at").alias("last_checked"))
    current = written(current, "current")
    own = points.join(current.select("site_id", "item_key"), ["site_id", "item_key"], "left_semi")
    insights = price_insights(own, "price", "site_id", order).select("site_id", "low", "high", "avg", "pct_vs_avg", "is_all_time_low")
    scores = deal_scores(own, "price", "site_id", order)
    j = sites.join(current, sites["id"] == current["site_id"], "left").drop("site_id")
    for facts in (insights, scores):
        j = j.join(facts, j["id"] == facts["site_id"], "left").drop("site_id")
    move = F.when(F.col("prev_price") != 0, rounded((F.col("price") - F.col("prev_price")) / F.col("prev_price") * 100, 1))
    j = j.withColumn("field_sources", F.coalesce(F.from_json("__sources", "map<string,string>"), F.create_map().cast("map<string,string>"))).drop("__sources")
    j = j.withColumn("title", F.coalesce(F.nullif("title", F.lit("")), F.col("item_key").cast("string"))).withColumn("in_stock", in_stock("availability")).withColumn("change_pct", move)
    j = j.withColumn("quality", F.when(F.col("last_checked").isNotNull(), quality_label(F.col("confidence"), F.col("field_sources"))))
    return j.withColumn("deal_score", F.coalesce("deal_score", F.lit(0))).withColumn("status", watch_status(F.col("price"), F.col("in_stock"), F.col("prev_price"), F.col("target_price")))


def best_deal_note(hits: DataFrame, key) -> DataFrame:
    """WIN-10: a note on the cheapest priced hit of each query from its history and the store median."""
    first = by(key, [F.col("converted").asc_nulls_last(), F.col("tie1"), F.col("tie2")])
    best = hits.where("converted IS NOT NULL").withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    below = F.when(F.col("hist_avg") > 0, rounded((F.col("hist_avg") - F.col("converted")) / F.col("hist_avg") * 100, 1))
    note = (
        F.when((F.col("hist_count") >= 3) & (F.col("converted") <= F.col("hist_low") + 0.005), "all-time low")
        .when((F.col("hist_count") >= 3) & (below > 0), F.concat(F.floor(below + 0.5).cast("string"), F.lit("% below usual")))
        .when(F.col("deal_pct") > 0, F.concat(F.floor(F.col("deal_pct") + 0.5).cast("string"), F.lit("% below median")))
    )
    return best.withColumn("note", note)


def confidence_by_fill(records: DataFrame, required: list[str], fields: list[str], key) -> DataFrame:
    """AGG-7: share of required cells filled, of all cells where nothing is required."""
    cells = required or fields
    filled = sum(((F.col(c).isNotNull()) & (F.col(c).cast("string") != "")).cast("int") for c in cells)
    return records.groupBy(key).agg(rounded(F.sum(filled) / (F.count("*") * len(cells)), 3).alias("confidence"))


def validation(records: DataFrame, kinds: dict[str, str], required: list[str], key) -> DataFrame:
    """AGG-8: messages on missing and mistyped fields, a row each; text fields take anything."""
    value = lambda c: F.col(c).cast("string")
    checks = [F.when(F.col(c).isNull() | (value(c) == ""), F.lit(f"missing {c}")) for c in required]
    checks += [F.when(F.col(c).isNotNull() & (value(c) != "") & F.col(c).try_cast("double").isNull(), F.lit(f"{c} is not a number")) for c, k in kinds.items() if k in ("number", "price")]
    found = F.filter(F.array(*checks), lambda m: m.isNotNull())
    return records.select(key, F.explode_outer(found).alias("message")).withColumn("valid", F.col("message").isNull())


def usage_rollup(calls: DataFrame, run: str, price_per_1k: float, budget: int) -> DataFrame:
    """AGG-10: calls, tokens, cost and what is left of the budget, per run; negative counts are 0."""
    p, c = (F.sum(F.greatest(F.lit(0), F.col(n))) for n in ("prompt_tokens", "completion_tokens"))
    g = calls.groupBy(run).agg(F.count("*").alias("calls"), p.alias("prompt_tokens"), c.alias("completion_tokens"))
    total = F.col("prompt_tokens") + F.col("completion_tokens")
    return g.withColumn("total_tokens", total).withColumn("cost", rounded(F.col("total_tokens") / 1000 * price_per_1k, 6)).withColumn("budget_left", F.greatest(F.lit(0), F.lit(budget) - F.col("calls")))
