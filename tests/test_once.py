"""Work that is done once: the score of a pair of texts, a row of an appended day, a text of a snapshot's rows in state."""

import datetime

from pyspark.sql import functions as F

from pricelake.operators import changes as G
from pricelake.operators import search as P
from pricelake.sources.scratch import scratch_path
from pricelake.streaming import streams as R
from tests.test_streams import at, run, source


def test_scores_of_equal_pairs(spark):
    pairs = [("acme m7", "ACME lamp m7"), ("acme", None), (None, "ACME"), ("lamp", "ACME lamp m7"), ("", "x")]
    rows = spark.createDataFrame([(i, *pairs[i % 5]) for i in range(200)], "i int, q string, t string").repartition(4)
    got = P.with_query_score(rows, F.col("q"), F.col("t"))
    assert got.columns == ["i", "q", "t", "score"]
    want = {r["i"]: r["score"] for r in rows.select("i", P.query_score(F.col("q"), F.col("t")).alias("score")).collect()}
    assert {r["i"]: r["score"] for r in got.collect()} == want and len(want) == 200
    # A condition on the score measures nothing anew.
    assert "ArrowEvalPython" not in got.where("score > 0.4")._jdf.queryExecution().executedPlan().toString()


def test_a_day_lies_in_one_file(spark):
    rows = spark.range(400).repartition(8).select("id", F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(cast(id % 5 AS INT))").alias("at"))
    path = scratch_path(spark, "days")
    G.appended(rows, path, "at")
    G.appended(rows.where("false"), path, "at")
    table = spark.read.parquet(path)
    assert table.count() == 400 and table.select(F.input_file_name()).distinct().count() == 5


def test_snapshot_state_holds_a_row_a_batch(spark):
    schema = "site_id long, at timestamp, item_key string, price double, availability string, arrival long"
    path, stream = source(spark, "records", schema)
    out, progress = scratch_path(spark, "changes"), scratch_path(spark, "progress")
    rows = [(1, at(60 * k), f"i{n}", float(n), None if n % 2 else "in", n) for k in range(2) for n in range(300)]
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    q = run(spark, R.snapshot_changes(stream, "1 minute"), out, progress)
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(held) < 20
    far = datetime.datetime(2024, 3, 1)
    spark.createDataFrame([(2, far, "z", 1.0, "in", 1)], schema).coalesce(1).write.mode("append").parquet(path)
    run(spark, R.snapshot_changes(stream, "1 minute"), out, progress)
    assert spark.read.parquet(out).count() == 0
