"""Streams over the tables' own files, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelake.operators import changes as G
from pricelake.sources.inputs import table, with_views
from pricelake.sources.scratch import scratch_path
from pricelake.streaming import streams as R

from .registry import query
from .series_queries import OUTLIER_SQL


def _stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The rows of a table as a stream of its files; the pattern fits a single file as well as a folder."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{table}.parque[t]")


def _run(stream: DataFrame, name: str) -> DataFrame:
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", R.STATE_STORE)
    return R.run_to_table(stream, scratch_path(spark, name), scratch_path(spark, f"{name}-progress"))


@query("str_1_change_stream", with_views("p AS (SELECT *, lag(price) OVER (PARTITION BY site_id, item_id ORDER BY seen_at, tie1, tie2) AS was FROM obs) SELECT site_id, item_id, CAST(seen_at AS TIMESTAMP) AS seen_at, was AS old_price, price AS new_price FROM p WHERE was <> price", "obs"))
def str_1(spark, d):
    s = _stream(spark, d, "lineitem").select(F.col("l_suppkey").cast("long").alias("site_id"), F.col("l_partkey").cast("long").alias("item_id"), F.col("l_shipdate").cast("timestamp").alias("seen_at"), F.col("l_orderkey").alias("tie1"), F.col("l_linenumber").alias("tie2"), F.col("l_extendedprice").alias("price"))
    return _run(R.change_stream(s), "changes")


@query(
    "str_1_snapshot_stream",
    with_views(
        """r AS (SELECT site_id, CAST(item_id AS VARCHAR) AS item_key, date_trunc('year', CAST(seen_at AS TIMESTAMP)) AS at_, arg_max({'p': price, 'a': availability}, tie1 * 10 + tie2) AS v FROM obs GROUP BY ALL),
        t AS (SELECT DISTINCT site_id, at_ FROM r), n AS (SELECT site_id, at_, lead(at_) OVER (PARTITION BY site_id ORDER BY at_) AS next FROM t),
        o AS (SELECT r.site_id, n.next AS at_, item_key, v FROM r JOIN n USING (site_id, at_) WHERE n.next IS NOT NULL), k AS (SELECT r.* FROM r JOIN (SELECT site_id, min(at_) AS first FROM t GROUP BY site_id) AS f USING (site_id) WHERE at_ > first),
        j AS (SELECT coalesce(o.site_id, k.site_id) AS site_id, coalesce(o.at_, k.at_) AS at_, coalesce(o.item_key, k.item_key) AS item_key, o.v AS a, k.v AS b FROM o FULL JOIN k ON o.site_id = k.site_id AND o.at_ = k.at_ AND o.item_key = k.item_key),
        c AS (SELECT site_id, at_, item_key, CASE WHEN a IS NULL THEN '_new_item' ELSE '_removed_item' END AS field, NULL AS old_price, NULL AS new_price FROM j WHERE a IS NULL OR b IS NULL
          UNION ALL SELECT site_id, at_, item_key, 'price', a.p, b.p FROM j WHERE a.p <> b.p UNION ALL SELECT site_id, at_, item_key, 'availability', NULL, NULL FROM j WHERE a.a <> b.a)
        SELECT site_id, at_ AS snapshot, item_key, field, CAST(old_price AS DOUBLE) AS old_price, CAST(new_price AS DOUBLE) AS new_price FROM c WHERE at_ + INTERVAL 1 HOUR <= (SELECT max(at_) FROM r)""",
        "obs",
    ),
)
def str_1_snapshots(spark, d):
    """A snapshot of each site for each year; the last year stays open."""
    stock = F.when(F.col("l_returnflag") == "R", "Out of stock").when(F.col("l_returnflag") == "A", "In stock").otherwise("see store")
    s = _stream(spark, d, "lineitem").select(F.col("l_suppkey").cast("long").alias("site_id"), F.date_trunc("year", F.col("l_shipdate").cast("timestamp")).alias("at"), F.col("l_partkey").cast("string").alias("item_key"), F.col("l_extendedprice").alias("price"), stock.alias("availability"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("arrival"))
    out = _run(R.snapshot_changes(s, "1 hour"), "snapshots")
    price = lambda c: F.when(F.col("field") == "price", F.col(c).cast("double"))
    return out.select("site_id", F.col("at").alias("snapshot"), "item_key", "field", price("old_value").alias("old_price"), price("new_value").alias("new_price"))


@query("str_2_guard_stream", with_views(OUTLIER_SQL + " SELECT runs.site_id, run_id, outlier FROM o JOIN runs USING (run_id)", "runs"))
def str_2(spark, d):
    s = _stream(spark, d, "events").select(F.col("user_id").cast("long").alias("site_id"), F.col("event_id").cast("long").alias("run_id"), F.col("ts").alias("fetched_at"), F.col("value").alias("price"))
    return _run(R.guard_stream(s, 100_000), "guard")


SENT = """WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS dedup_key, CAST(event_id AS BIGINT) AS alert_id, CAST(ts AS TIMESTAMP) AS created_at FROM events),
    s AS (SELECT dedup_key, min({'t': created_at, 'n': alert_id}) AS x FROM e GROUP BY dedup_key
        UNION ALL SELECT s.dedup_key, (SELECT min({'t': e.created_at, 'n': e.alert_id}) FROM e WHERE e.dedup_key = s.dedup_key AND e.created_at >= s.x.t + INTERVAL 1440 MINUTE) FROM s WHERE s.x IS NOT NULL)
    SELECT dedup_key, x.n AS alert_id, x.t AS created_at FROM s WHERE x IS NOT NULL"""


@query("join_7_throttle_of_all_time", SENT)
def join_7_all(spark, d):
    """In batch, the rows of the stream: every alert that no sent one of its key silences."""
    alerts = table(spark, d, "events").select(F.col("user_id").cast("string").alias("dedup_key"), F.col("event_id").cast("long").alias("alert_id"), F.col("ts").cast("timestamp").alias("created_at"))
    return G.throttled_alerts(alerts, "dedup_key", "created_at", "alert_id", 1440)


@query("str_3_throttle_stream", SENT)
def str_3(spark, d):
    s = _stream(spark, d, "events").select(F.col("user_id").cast("string").alias("dedup_key"), F.col("event_id").cast("long").alias("alert_id"), F.col("ts").cast("timestamp").alias("created_at"))
    return _run(R.throttle_stream(s, 1440), "throttle")


@query(
    "str_4_digest_stream",
    """WITH e AS (SELECT user_id AS site_id, time_bucket(INTERVAL 1 DAY, CAST(ts AS TIMESTAMP)) AS start FROM events)
    SELECT site_id, start, count(*) AS changes FROM e WHERE start + INTERVAL 1 DAY <= (SELECT max(CAST(ts AS TIMESTAMP)) - INTERVAL 1 HOUR FROM events) GROUP BY site_id, start""",
)
def str_4(spark, d):
    """Windows that the watermark has closed; the last ones stay open."""
    s = _stream(spark, d, "events").select(F.col("user_id").alias("site_id"), F.col("ts").cast("timestamp").alias("changed_at"))
    return _run(R.digest_stream(s, 24), "digest")


@query("str_5_history_append", "SELECT l_partkey AS item_id, l_extendedprice AS price FROM lineitem WHERE l_suppkey % 2 = 0")
def str_5(spark, d):
    s = _stream(spark, d, "lineitem").select(F.col("l_partkey").alias("item_id"), F.col("l_extendedprice").alias("price"), "l_suppkey")
    path, progress = scratch_path(spark, "history"), scratch_path(spark, "history-progress")
    R.history_append(s, path, progress, F.when(F.col("l_suppkey") % 2 == 0, F.col("item_id").cast("string"))).awaitTermination()
    return spark.read.parquet(path).select("item_id", "price")
