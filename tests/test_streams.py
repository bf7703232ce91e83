"""Streams over several micro-batches against batch rows; state that empties; restarts that repeat nothing."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from pricelake.operators import changes as G
from pricelake.sources.scratch import scratch_path
from pricelake.streaming import streams as R

START = datetime.datetime(2024, 1, 1)


def at(minutes):
    return START + datetime.timedelta(minutes=minutes)


@pytest.fixture(scope="module")
def alerts():
    rng = random.Random(6)
    return sorted((rng.randint(0, 20000), n, rng.choice(["a", "b", "c", None])) for n in range(400))


def plain_throttle(alerts, minutes):
    last, sent = {}, set()
    for t, n, key in alerts:
        if key not in last or t >= last[key] + minutes:
            last[key] = t
            sent.add(n)
    return sent


@pytest.mark.parametrize(("minutes", "slice_minutes"), [(60, 7 * 24 * 60), (60, 30), (1000, 60), (0, 500)])
def test_throttle_by_pointer_jumping(spark, alerts, minutes, slice_minutes):
    df = spark.createDataFrame([(k, n, at(t)) for t, n, k in alerts], "dedup_key string, alert_id long, created_at timestamp").repartition(3)
    got = {r["alert_id"] for r in G.throttled_alerts(df, "dedup_key", "created_at", "alert_id", max(minutes, 0), slice_minutes).collect()} if minutes else set()
    assert got == (plain_throttle(alerts, minutes) if minutes else set())


def run(spark, stream, path, progress):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", R.STATE_STORE)
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", progress).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def source(spark, name, schema):
    path = scratch_path(spark, name)
    spark.createDataFrame([], schema).write.parquet(path)
    return path, spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_throttle_stream_equals_batch_and_forgets(spark, alerts):
    """Files in order of time, one a batch; after a last alert far ahead only that one's silence is held."""
    schema = "dedup_key string, alert_id long, created_at timestamp"
    path, stream = source(spark, "alerts", schema)
    out, progress = scratch_path(spark, "sent"), scratch_path(spark, "progress")
    rows = [(k or "none", n, at(t)) for t, n, k in alerts]
    throttled = R.throttle_stream(stream, 600, "1 minute")
    for part in (rows[:150], rows[150:300], rows[300:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        run(spark, throttled, out, progress)
    spark.createDataFrame([("far", 9999, at(100_000))], schema).coalesce(1).write.mode("append").parquet(path)
    q = run(spark, throttled, out, progress)
    got = {r["alert_id"] for r in spark.read.parquet(out).collect()}
    assert got == plain_throttle([(t, n, k or "none") for t, n, k in alerts], 600) | {9999}
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert held[-1] == 1


SNAPSHOTS = [
    {"a": (1.0, "in"), "b": (2.0, None)}, {"a": (1.5, "in"), "b": (2.0, "out"), "c": (None, "in")}, {"c": (3.0, "in")}, {"c": (3.0, "in"), "a": (9.0, None)},
]


def plain_changes(snapshots):
    out = set()
    for k in range(1, len(snapshots)):
        old, new = snapshots[k - 1], snapshots[k]
        out |= {(k, i, "_new_item", None, i) for i in new.keys() - old.keys()} | {(k, i, "_removed_item", i, None) for i in old.keys() - new.keys()}
        out |= {(k, i, f, x and str(x), y and str(y)) for i in new.keys() & old.keys() for f, x, y in zip(("price", "availability"), old[i], new[i], strict=True) if x != y}
    return out


@pytest.mark.parametrize("with_initial", [False, True])
def test_snapshot_stream(spark, with_initial):
    """A snapshot's rows come in two batches, some twice; the batch table gives the first; another run adds nothing."""
    schema = "site_id long, at timestamp, item_key string, price double, availability string, arrival long"
    path, stream = source(spark, "records", schema)
    out, progress = scratch_path(spark, "changes"), scratch_path(spark, "progress")
    initial = None
    if with_initial:
        initial = spark.createDataFrame([(7, i, at(0), *v) for i, v in SNAPSHOTS[0].items()], "site_id long, item_key string, at timestamp, price double, availability string")
    changes = R.snapshot_changes(stream, "1 minute", initial)
    for k, snapshot in enumerate(SNAPSHOTS):
        if with_initial and k == 0:
            continue
        rows = [(7, at(60 * k), i, *v, 2) for i, v in snapshot.items()]
        early = [(7, at(60 * k), i, 77.0, "early", 1) for i in snapshot]
        for part in (rows[:1] + early[1:], rows[1:] + early[:1]):
            if part:
                spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
                run(spark, changes, out, progress)
    spark.createDataFrame([(8, at(1000), "z", 1.0, "in", 1)], schema).coalesce(1).write.mode("append").parquet(path)
    run(spark, changes, out, progress)
    run(spark, changes, out, progress)
    got = [(round((r["at"] - START).total_seconds() / 3600), r["item_key"], r["field"], r["old_value"], r["new_value"]) for r in spark.read.parquet(out).where(F.col("site_id") == 7).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_changes(SNAPSHOTS)
