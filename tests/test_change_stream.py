"""The change stream against a plain loop, and how often it calls Python."""

import datetime
import random

from pyspark.sql import functions as F

from pricelake.sources.scratch import scratch_path
from pricelake.streaming import streams as R

SCHEMA = "site_id long, item_id long, seen_at timestamp, tie1 long, tie2 int, price double"
DAY = datetime.datetime(2024, 1, 1)


def test_changes_over_batches(spark):
    """Late rows, equal prices, ties, null sites and items, and ids beyond what a double holds, in three micro-batches."""
    rng, big = random.Random(3), 2**53
    rows = [(rng.choice([1, 2, None]), rng.choice([*range(40), big + 1, big + 2, None]), DAY + datetime.timedelta(days=rng.randint(0, 9)), rng.randint(0, 3), n, float(rng.randint(1, 3))) for n in range(1200)]
    path, last, want = scratch_path(spark, "points"), {}, []
    for k in range(3):
        batch = rows[400 * k : 400 * (k + 1)]
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        for site, item, seen, a, b, price in sorted(batch, key=lambda r: r[2:5]):
            old = last.get((site, item))
            if old and (seen, a, b) <= old[1]:
                continue
            if old and old[0] != price:
                want.append((site, item, seen, old[0], price))
            last[site, item] = (price, (seen, a, b))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", R.STATE_STORE)
    got = R.run_to_table(R.change_stream(stream), scratch_path(spark, "out"), scratch_path(spark, "progress")).collect()
    order = lambda r: tuple((x is None, x or 0) if not isinstance(x, datetime.datetime) else x for x in r)
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)


def test_a_call_takes_many_items(spark):
    """A site of a thousand items is a few groups, not a thousand."""
    path, progress = scratch_path(spark, "points"), scratch_path(spark, "progress")
    spark.range(1000).select(F.lit(1).cast("long").alias("site_id"), F.col("id").alias("item_id"), F.lit(DAY).alias("seen_at"), F.col("id").alias("tie1"), F.lit(1).alias("tie2"), F.lit(1.0).alias("price")).write.parquet(path)
    q = R.change_stream(spark.readStream.schema(SCHEMA).parquet(path)).writeStream.format("noop").option("checkpointLocation", progress).trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2 * R.ITEM_GROUPS
