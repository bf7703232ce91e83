"""Queries over changes between the states of every item before and since a day, at every site."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricelake.functions import columns as C
from pricelake.operators import changes as G
from pricelake.operators import series as S
from pricelake.operators import tables as M
from pricelake.sources.inputs import obs, runs, sites, with_views
from pricelake.sources.scratch import scratch_path

from .registry import query
from .series_queries import OUTLIER_SQL

FIELDS = ["price", "availability"]
TIME = ["seen_at", "tie1", "tie2"]
KEY = ["site_id", "item_key"]
#: The day that parts the older from the newer snapshot.
CUT = "1995-06-17"


def snapshots(spark, d):
    """(old, new): all price points before and since the day, each with its site and item."""
    rows = obs(spark, d).withColumn("item_key", F.col("item_id")).select(*KEY, *FIELDS, *TIME)
    return rows.where(F.col("seen_at") < F.lit(CUT).cast("date")), rows.where(F.col("seen_at") >= F.lit(CUT).cast("date"))


def all_changes(spark, d):
    """Changes of every item at every site."""
    found = G.diff(*snapshots(spark, d), KEY, FIELDS, TIME, "item_key")
    return found.withColumn("changed_at", F.timestamp_seconds(F.lit(900000000) + F.col("item_key") * 60 + F.col("site_id")))


_STATE = "arg_max({'p': price, 'a': availability}, {'a': seen_at, 'b': tie1, 'c': tie2}) AS v FROM obs WHERE seen_at"
SNAP = f"""o AS (SELECT site_id, item_id, {_STATE} < DATE '{CUT}' GROUP BY site_id, item_id),
n AS (SELECT site_id, item_id, {_STATE} >= DATE '{CUT}' GROUP BY site_id, item_id),
j AS (SELECT site_id, item_id, o.v.p AS op, n.v.p AS np, o.v.a AS oa, n.v.a AS na, o.v IS NULL AS fresh, n.v IS NULL AS gone FROM o FULL JOIN n USING (site_id, item_id)),
d AS (SELECT site_id, item_id, 'price' AS field, op, np, oa, na FROM j WHERE NOT fresh AND NOT gone AND op IS DISTINCT FROM np
  UNION ALL SELECT site_id, item_id, 'availability', op, np, oa, na FROM j WHERE NOT fresh AND NOT gone AND oa IS DISTINCT FROM na
  UNION ALL SELECT site_id, item_id, '_new_item', NULL, NULL, NULL, NULL FROM j WHERE fresh
  UNION ALL SELECT site_id, item_id, '_removed_item', NULL, NULL, NULL, NULL FROM j WHERE gone),
c AS (SELECT site_id, item_id AS item_key, field, op, np, oa, na, make_timestamp((900000000 + item_id * 60 + site_id) * 1000000) AS changed_at FROM d)"""


def sql(select: str, *views: str) -> str:
    """select after the changes; with further common tables, it begins with a comma."""
    return with_views(f"{SNAP}{'' if select.startswith(',') else ' '}{select}", "obs", *views)


def numeric(df):
    """Prices as numbers, other values as text, for comparison."""
    price = lambda c: F.when(F.col("field") == "price", F.col(c).try_cast("double"))
    return df.select("site_id", "item_key", "field", price("old_value").alias("old_price"), price("new_value").alias("new_price"))


PRICES = "CASE WHEN field = 'price' THEN op END AS old_price, CASE WHEN field = 'price' THEN np END AS new_price"


@query("chg_1_snapshot_diff", sql(f"SELECT site_id, item_key, field, {PRICES} FROM c"))
def chg_1(spark, d):
    return numeric(all_changes(spark, d))


@query("set_4_new_and_removed", sql("SELECT site_id, item_key, field FROM c WHERE field LIKE '\\_%' ESCAPE '\\'"))
def set_4(spark, d):
    return all_changes(spark, d).where(F.col("field").startswith("_")).select("site_id", "item_key", "field")


@query("chg_2_plausible", sql(f"SELECT site_id, item_key, field, {PRICES} FROM c WHERE field <> 'price' OR (np > 0 AND np / op BETWEEN 1 / 20.0 AND 20)"))
def chg_2(spark, d):
    return numeric(G.plausible(all_changes(spark, d)))


@query("chg_3_confident", sql("SELECT site_id, item_key, field FROM c WHERE field <> 'price' OR item_key % 2 = 0"))
def chg_3(spark, d):
    conf = F.create_map(F.lit("price"), F.when(F.col("item_key") % 2 == 0, 0.9).otherwise(0.4))
    return G.confident(all_changes(spark, d), conf, 0.6).select("site_id", "item_key", "field")


@query("chg_4_quarantine", with_views(OUTLIER_SQL + ", l AS (SELECT runs.site_id, runs.run_id, row_number() OVER (PARTITION BY site_id ORDER BY fetched_at DESC, run_id DESC) AS n, price, outlier FROM runs JOIN o USING (run_id)) SELECT site_id, outlier AS dropped FROM l WHERE n = 1", "runs"))
def chg_4(spark, d):
    flags = S.latest(S.outliers(runs(spark, d), "price", "site_id", ["fetched_at", "run_id"]), "site_id", ["fetched_at", "run_id"])
    price = flags.select("site_id", F.lit("price").alias("field"), F.lit(None).cast("string").alias("old_value"), F.col("price").cast("string").alias("new_value"))
    passed, dropped = G.quarantined(price, flags, ["site_id"])
    return passed.select("site_id", F.lit(False).alias("dropped")).unionByName(dropped.select("site_id", F.lit(True).alias("dropped")))


TRIGGER = """CASE alert_trigger WHEN 'any_change' THEN true WHEN 'price_drop' THEN field = 'price' AND np < op WHEN 'price_below' THEN field = 'price' AND np <= target_price * 1000
    WHEN 'price_above' THEN field = 'price' AND np >= target_price * 1000 WHEN 'back_in_stock' THEN field = 'availability' AND na = 'In stock' ELSE field = 'availability' AND na = 'Out of stock' END"""


@query("chg_5_triggers", sql(f"SELECT site_id, item_key, field, coalesce({TRIGGER}, false) AS alert FROM c JOIN sites ON id = site_id", "sites"))
def chg_5(spark, d):
    j = all_changes(spark, d).join(sites(spark, d).withColumnRenamed("id", "site_id"), "site_id")
    return j.select("site_id", "item_key", "field", G.triggered(F.col("alert_trigger"), F.col("target_price") * 1000).alias("alert"))


RULES = [{"when": "new_item", "action": "ignore"}, {"when": "price_below", "amount": 20000, "action": "alert"}, {"when": "price_increases", "action": "log"}, {"when": "out_of_stock", "action": "alert"}, {"when": "removed_item", "action": "alert"}]


@query("chg_6_rules", sql("SELECT site_id, item_key, field, CASE WHEN field = '_new_item' THEN 'ignore' WHEN field = 'price' AND np <= 20000 THEN 'alert' WHEN field = 'price' AND np > op THEN 'log' WHEN field = 'availability' AND na = 'Out of stock' THEN 'alert' WHEN field = '_removed_item' THEN 'alert' ELSE 'ignore' END AS action FROM c"))
def chg_6(spark, d):
    return all_changes(spark, d).select("site_id", "item_key", "field", G.rule_action(RULES).alias("action"))


@query("chg_7_minimum_drop", sql("SELECT site_id, item_key, field FROM c WHERE field <> 'price' OR (op - np) / op >= 0.25"))
def chg_7(spark, d):
    return G.large_drops(all_changes(spark, d), 0.25).select("site_id", "item_key", "field")


NOW = "TIMESTAMP '1998-07-10 00:00:00'"


def _now():
    return F.lit("1998-07-10 00:00:00").cast("timestamp")


def _alerts(spark, d):
    """An alert for every change that sets off its site's trigger, at the time of the change."""
    c = all_changes(spark, d).join(sites(spark, d).select(F.col("id").alias("site_id"), "alert_trigger", "target_price"), "site_id")
    c = c.where(G.triggered(F.col("alert_trigger"), F.col("target_price") * 1000))
    return G.alert_log(c, C.change_text(F.col("item_key").cast("string"), F.col("field"), F.col("old_value"), F.col("new_value")), F.array(F.lit("mail"), F.lit("hook")), F.col("changed_at"))


ALERTS = f"a AS (SELECT c.* FROM c JOIN sites ON id = site_id WHERE coalesce({TRIGGER}, false))"


@query("join_7_throttle", sql(f", {ALERTS} SELECT site_id, item_key, field FROM c WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.site_id = c.site_id AND a.field = c.field AND a.item_key = c.item_key AND a.changed_at >= {NOW} - INTERVAL 30000 MINUTE)", "sites"))
def join_7(spark, d):
    return G.throttled(all_changes(spark, d), _alerts(spark, d), _now(), 30000).select("site_id", "item_key", "field")


@query("src_4_alert_log", sql(f", {ALERTS} SELECT site_id, item_key, field, 'mail,hook' AS sinks, concat_ws('|', site_id, field, item_key) AS dedup_key FROM a", "sites"))
def src_4(spark, d):
    """Appended to a partitioned table twice, the second time empty, and read again."""
    path = scratch_path(spark, "alerts")
    log = _alerts(spark, d)
    G.appended(log, path, "created_at")
    G.appended(log.where("false"), path, "created_at")
    return spark.read.parquet(path).select("site_id", "item_key", "field", "sinks", "dedup_key")


def _flags(spark, d):
    """Whether the newest price of each item at each site is an outlier among those before."""
    o = obs(spark, d).withColumnRenamed("item_id", "item_key")
    return S.latest(S.outliers(o, "price", KEY, TIME, z=3.0), KEY, TIME).select(*KEY, "outlier")


# The newest price is the last of its series, so that the earlier ones are all others.
FLAGS = """r AS (SELECT *, row_number() OVER (PARTITION BY site_id, item_id ORDER BY seen_at DESC, tie1 DESC, tie2 DESC) AS k FROM obs),
m AS (SELECT site_id, item_id, median(price) AS m, count(*) AS n FROM r WHERE k > 1 GROUP BY site_id, item_id),
s AS (SELECT site_id, item_id, median(abs(price - m)) AS s FROM r JOIN m USING (site_id, item_id) WHERE k > 1 GROUP BY site_id, item_id),
f AS (SELECT site_id, item_id FROM r JOIN m USING (site_id, item_id) JOIN s USING (site_id, item_id) WHERE k = 1 AND n >= 6
    AND CASE WHEN s > 0 THEN abs(price - m) / (s * CAST(1.4826 AS DOUBLE)) > 3 ELSE abs(price - m) > greatest(1e-9, abs(m) * 0.5) END)"""
#: What the batch logs, and what it alerts on: fields are certain enough except the availability of every seventh item.
LOGGED = """l AS (SELECT c.* FROM c WHERE (field <> 'price' OR (np > 0 AND np / op BETWEEN 1 / 20.0 AND 20)) AND NOT (field = 'availability' AND item_key % 7 = 0)
    AND NOT (field = 'price' AND (site_id, item_key) IN (SELECT (site_id, item_id) FROM f)))"""
SENT = f"""e AS (SELECT l.* FROM l JOIN sites ON id = site_id WHERE coalesce({TRIGGER.replace(' * 1000', '')}, false)
    AND NOT EXISTS (SELECT 1 FROM a WHERE a.site_id = l.site_id AND a.field = l.field AND a.item_key = l.item_key AND a.changed_at >= {NOW} - INTERVAL 30000 MINUTE) AND (field <> 'price' OR (op - np) / op >= 0.1))"""


def _batch(spark, d):
    old, new = (x.select(*KEY, *FIELDS, F.struct(*TIME).alias("arrival")) for x in snapshots(spark, d))
    certain = F.create_map(F.lit("availability"), F.when(F.col("item_key") % 7 == 0, 0.3).otherwise(0.9))
    return G.monitoring_batch(old, new, sites(spark, d), _flags(spark, d), _alerts(spark, d), _now(), 30000, 0.1, confidence=certain, least_confidence=0.6)


@query("chg_8_monitoring_batch", sql(f", {ALERTS}, {FLAGS}, {LOGGED}, {SENT} SELECT site_id, item_key, field FROM e", "sites"))
def chg_8(spark, d):
    return _batch(spark, d)[1].select("site_id", "item_key", "field")


@query("chg_8_batch_tables", sql(f", {ALERTS}, {FLAGS}, {LOGGED}, {SENT}, k AS (SELECT run_id, row_number() OVER (PARTITION BY site_id ORDER BY fetched_at DESC, run_id DESC) AS n FROM runs) SELECT 'changes' AS name, count(*) AS rows FROM l UNION ALL SELECT 'alert_events', count(*) FROM e UNION ALL SELECT 'runs', count(*) FROM k WHERE n <= 10", "sites", "runs"))
def chg_8_tables(spark, d):
    """The batch with its writes: changes and alerts appended to partitioned logs, old runs pruned; the rows of each table."""
    logged, sent = _batch(spark, d)
    paths = {name: scratch_path(spark, name) for name in ("changes", "alert_events", "runs")}
    text = C.change_text(F.col("item_key").cast("string"), F.col("field"), F.col("old_value"), F.col("new_value"))
    G.appended(logged.withColumn("changed_at", _now()), paths["changes"], "changed_at")
    G.appended(G.alert_log(sent, text, F.array(F.lit("mail")), _now()), paths["alert_events"], "created_at")
    r = runs(spark, d)
    kept, _ = M.pruned(r, r.select("run_id"), sites(spark, d).select("id", F.lit(None).cast("int").alias("retention_runs")), 10)
    kept.write.parquet(paths["runs"])
    counts = [spark.read.parquet(path).agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows") for name, path in paths.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("join_2_recent_changes", sql("SELECT site_id, item_key, field, url FROM c JOIN sites ON id = site_id ORDER BY changed_at DESC, item_key DESC, site_id DESC, field DESC LIMIT 50", "sites"))
def join_2(spark, d):
    return G.recent_changes(all_changes(spark, d), sites(spark, d), 50, order=("changed_at", "item_key", "site_id", "field")).select("site_id", "item_key", "field", "url")


@query("src_3_change_log", sql("SELECT site_id, item_key, field, changed_at FROM c"))
def src_3(spark, d):
    """Appended to a partitioned table twice, the second time empty, and read again."""
    path = scratch_path(spark, "changes")
    changes = all_changes(spark, d)
    G.appended(changes, path, "changed_at")
    G.appended(changes.where("false"), path, "changed_at")
    return spark.read.parquet(path).select("site_id", "item_key", "field", "changed_at")


@query("top_4_recent_alerts", sql(f", {ALERTS} SELECT site_id, item_key, field FROM a ORDER BY changed_at DESC, item_key DESC, site_id DESC, field DESC LIMIT 100", "sites"))
def top_4(spark, d):
    return G.recent_alerts(_alerts(spark, d), 100, ("created_at", "item_key", "site_id", "field")).select("site_id", "item_key", "field")


@query("agg_11_digest", sql(f"SELECT site_id, count(*) AS changes, CAST(sum(count(*)) OVER () AS BIGINT) AS total, count(*) OVER () AS sites FROM c WHERE changed_at >= {NOW} - INTERVAL 200 HOUR GROUP BY site_id"))
def agg_11(spark, d):
    return G.digest(all_changes(spark, d), _now(), 200)


@query("top_5_digest_lines", sql("""SELECT site_id, CAST(count(*) AS BIGINT) AS changes, CAST(least(count(*), 15) + CASE WHEN count(*) > 15 THEN 1 ELSE 0 END AS BIGINT) AS lines, CASE WHEN count(*) > 15 THEN concat('and ', count(*) - 15, ' more') END AS last FROM c GROUP BY site_id"""))
def top_5(spark, d):
    c = all_changes(spark, d)
    lines = G.digest_lines(c, ["item_key", "field"])
    g = lines.groupBy("site_id").agg(F.count("*").alias("lines"), F.max(F.when(F.col("line") == 16, F.col("text"))).alias("last"))
    return c.groupBy("site_id").agg(F.count("*").alias("changes")).join(g, "site_id")


@query("agg_12_dashboard", sql(f"SELECT (SELECT CAST(sum(active) AS BIGINT) FROM sites) AS active, (SELECT count(*) FROM sites) AS total, (SELECT count(*) FROM c WHERE changed_at >= {NOW} - INTERVAL 24 HOUR) AS changes_24h, (SELECT CAST(floor(avg(confidence) * 100 + 0.5) AS INT) FROM runs) AS confidence_pct", "sites", "runs"))
def agg_12(spark, d):
    return G.dashboard(sites(spark, d), all_changes(spark, d), runs(spark, d), _now())


_T = "CAST(floor(abs((op - np) / op) * 1000 + 0.5) AS BIGINT)"
_PCT = f"concat(CAST({_T} // 10 AS VARCHAR), '.', CAST({_T} % 10 AS VARCHAR), '%')"


def _words(df, f):
    """The part of a line that does not print raw prices."""
    text = f(F.col("item_key").cast("string"), F.col("field"), F.col("old_value"), F.col("new_value"))
    return df.select("site_id", "item_key", "field", F.regexp_replace(text, r"(: | \()[-0-9.E]+ -> [-0-9.E]+\)?$", "").alias("text"))


@query("col_25_drop_fraction", sql("SELECT site_id, item_key, CASE WHEN op > 0 THEN floor((op - np) / op * 1000000 + 0.5) / 1000000 END AS fraction FROM c WHERE field = 'price'"))
def col_25(spark, d):
    return all_changes(spark, d).where("field = 'price'").select("site_id", "item_key", C.rounded(C.drop_fraction(F.col("old_value"), F.col("new_value")), 6).alias("fraction"))


@query("col_26_change_text", sql(f"SELECT site_id, item_key, field, CASE field WHEN '_new_item' THEN concat('NEW item: ', item_key) WHEN '_removed_item' THEN concat('REMOVED item: ', item_key) WHEN 'price' THEN concat('price ', CASE WHEN op > np THEN 'dropped' ELSE 'rose' END, ' ', {_PCT}, ' — ', item_key, ' price') ELSE concat(item_key, ' availability: ', oa, ' -> ', na) END AS text FROM c"))
def col_26(spark, d):
    return _words(all_changes(spark, d), C.change_text)


@query("col_27_highlight", sql(f"SELECT site_id, item_key, field, CASE field WHEN '_new_item' THEN concat('new item: ', item_key) WHEN '_removed_item' THEN concat('removed item: ', item_key) WHEN 'price' THEN concat(item_key, ' price ', CASE WHEN np < op THEN 'down' ELSE 'up' END, ' ', {_PCT}) ELSE CASE na WHEN 'In stock' THEN concat(item_key, ' back in stock') WHEN 'Out of stock' THEN concat(item_key, ' out of stock') ELSE concat(item_key, ' availability: ', oa, ' -> ', na) END END AS text FROM c"))
def col_27(spark, d):
    return _words(all_changes(spark, d), C.highlight)


@query("col_28_dedup_key", sql("SELECT site_id, item_key, field, concat(site_id, '|', field, '|', item_key) AS k FROM c"))
def col_28(spark, d):
    return all_changes(spark, d).select("site_id", "item_key", "field", C.dedup_key(F.col("site_id"), F.col("field"), F.col("item_key")).alias("k"))
