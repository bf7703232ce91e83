"""Queries over table maintenance and store payloads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelake.operators import tables as M
from pricelake.operators.changes import appended
from pricelake.sources.buckets import Buckets
from pricelake.sources.inputs import obs, runs, sites, table, with_views
from pricelake.sources.scratch import scratch_path

from .registry import query

PRICE = "floor(p_retailprice * 100 + 0.5) / 100"


def _batches(spark, d):
    """A batch of two records for each run, the second without a key on every third run."""
    record = lambda key, v: F.create_map(F.lit("url"), key, F.lit("price"), v.cast("string"))
    first = record(F.concat(F.lit("u"), F.col("run_id").cast("string")), F.col("price"))
    second = record(F.when(F.col("run_id") % 3 == 0, "").otherwise(F.concat(F.lit("v"), F.col("run_id").cast("string"))), F.col("price") * 2)
    return runs(spark, d).withColumn("records", F.array(first, second))


def _appended(spark, d, part: int):
    """Runs (0) or records (1), appended in two batches to a table with a folder for each day, and read again."""
    path = scratch_path(spark, "runs")
    for half in (0, 1):
        appended(M.appended_runs(_batches(spark, d).where(F.col("run_id") % 2 == half), "url")[part], path, "fetched_at")
    return spark.read.parquet(path)


@query("src_1_appended_runs", with_views("SELECT site_id, fetched_at, 2 AS record_count, healed, used_llm FROM runs", "runs"))
def src_1(spark, d):
    return _appended(spark, d, 0).select("site_id", "fetched_at", "record_count", "healed", "used_llm")


@query("src_1_appended_records", with_views("SELECT site_id, fetched_at, concat('u', run_id) AS item_key FROM runs UNION ALL SELECT site_id, fetched_at, CASE WHEN run_id % 3 > 0 THEN concat('v', run_id) END FROM runs", "runs"))
def src_1_records(spark, d):
    return _appended(spark, d, 1).select("site_id", "fetched_at", "item_key")


UPSERTED = with_views("SELECT CASE WHEN id % 2 = 0 OR id % 3 > 0 THEN id ELSE id + 1000000 END AS id, url, CASE WHEN id % 3 = 0 THEN 5 ELSE interval_minutes END AS interval_minutes, CASE WHEN id % 2 = 0 OR id % 3 > 0 THEN 'old' ELSE 'new' END AS created_at FROM sites WHERE id % 2 = 0 OR id % 3 = 0 OR id % 3 > 0", "sites")


def _old_and_new_sites(spark, d):
    s = sites(spark, d).select("id", "url", F.lit("product").alias("schema_name"), "interval_minutes")
    old = s.where("id % 2 = 0 OR id % 3 > 0").withColumn("created_at", F.lit("old"))
    new = s.where("id % 3 = 0").withColumn("id", F.col("id") + 1000000).withColumn("interval_minutes", F.lit(5).cast(s.schema["interval_minutes"].dataType)).withColumn("created_at", F.lit("new"))
    return old, new


@query("src_2_upserted_sites", UPSERTED)
def src_2(spark, d):
    return M.upserted_sites(*_old_and_new_sites(spark, d), ["interval_minutes"]).select("id", "url", "interval_minutes", "created_at")


#: Buckets of the tables made here; 1 TB would take some ten thousand.
COUNT = 16


def _in_buckets(spark, rows, *key: str) -> Buckets:
    held = Buckets(spark, scratch_path(spark, "table"), key, COUNT)
    held.create(rows)
    return held


@query("src_2_upserted_in_buckets", UPSERTED)
def src_2_buckets(spark, d):
    """The upsert applied to a table in buckets, twice under one batch number, and read again."""
    old, new = _old_and_new_sites(spark, d)
    held = _in_buckets(spark, old, "url", "schema_name")
    for _ in range(2):
        M.upsert_sites(held, new, ["interval_minutes"], 1)
    return held.rows().select("id", "url", "interval_minutes", "created_at")


@query("src_5_price_points", with_views("SELECT item_id, tie1, tie2, price FROM obs WHERE tie1 % 4 > 0 AND tie2 % 3 > 0", "obs"))
def src_5(spark, d):
    o = obs(spark, d).withColumn("product_key", F.when(F.col("tie1") % 4 > 0, F.concat(F.lit("k"), F.col("item_id").cast("string"))).otherwise("")).withColumn("price", F.when(F.col("tie2") % 3 > 0, F.col("price")).otherwise(0.0))
    return M.price_points(o, F.lit("2024-01-01").cast("timestamp")).select("item_id", "tie1", "tie2", "price")


@query("src_6_exported_watchlist", with_views("SELECT id, url, alert_trigger FROM sites", "sites"))
def src_6(spark, d):
    """Written as CSV and read again."""
    path = scratch_path(spark, "watchlist")
    M.exported(sites(spark, d).select("id", "url", "alert_trigger"), path, "csv")
    return spark.read.csv(path, header=True, schema="id bigint, url string, alert_trigger string")


@query("src_7_latest_pages", "SELECT substr(sha1(concat(url, '::page')), 1, 16) AS archive_key, url, arg_max(html, page_id) AS html FROM pages WHERE html <> '' GROUP BY url")
def src_7(spark, d):
    p = table(spark, d, "pages").select("url", F.lit("page").alias("schema"), "html", F.col("page_id").alias("fetched_at"))
    return M.latest_pages(M.archived(p)).select("archive_key", "url", "html")


LEFT = with_views(
    """SELECT 'sites' AS name, count(*) AS rows FROM sites WHERE id % 3 > 0 UNION ALL SELECT 'runs', count(*) FROM runs WHERE site_id % 3 > 0 UNION ALL SELECT 'records', 2 * count(*) FROM runs WHERE site_id % 3 > 0
    UNION ALL SELECT 'changes', count(*) FROM obs WHERE site_id % 3 > 0 UNION ALL SELECT 'alert_events', count(*) FROM obs WHERE site_id % 3 > 0 AND availability = 'Out of stock'""",
    "sites",
    "runs",
    "obs",
)


def _five_tables(spark, d):
    """The tables with the column of their site, and the sites to delete."""
    s, r, o = sites(spark, d), runs(spark, d), obs(spark, d)
    tables = {"sites": (s, "id"), "runs": (r, "site_id"), "records": (r.select("site_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("item_key")), "site_id"), "changes": (o, "site_id"), "alert_events": (o.where("availability = 'Out of stock'"), "site_id")}
    gone = reduce(DataFrame.unionByName, (df.where(f"{key} % 3 = 0").select(F.col(key).cast("long").alias("id")) for df, key in tables.values())).distinct()
    return tables, gone


def _sizes(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, (df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows") for name, df in tables.items()))


@query("src_9_cascade_delete", LEFT)
def src_9(spark, d):
    """The rows that are left in each of the five tables."""
    return _sizes(M.without_sites(*_five_tables(spark, d)))


@query("src_9_deleted_in_buckets", LEFT)
def src_9_buckets(spark, d):
    """The same, deleted from tables in buckets."""
    tables, gone = _five_tables(spark, d)
    held = {name: _in_buckets(spark, df, key) for name, (df, key) in tables.items()}
    M.delete_sites(held["sites"], {n: t for n, t in held.items() if n != "sites"}, gone, 1)
    return _sizes({name: t.rows() for name, t in held.items()})


@query("src_10_paused_sites", with_views("SELECT id, CASE WHEN id % 5 = 0 THEN 0 ELSE active END AS active FROM sites", "sites"))
def src_10(spark, d):
    return M.with_active(sites(spark, d), F.col("id") % 5 == 0, False).select("id", "active")


KEEP = "x AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY fetched_at DESC, run_id DESC) AS n, CASE WHEN site_id % 3 = 0 THEN 5 WHEN site_id % 3 = 1 THEN 0 ELSE 10 END AS k FROM runs)"


def _runs_records_limits(spark, d):
    r = runs(spark, d)
    s = sites(spark, d).select("id", F.when(F.col("id") % 3 == 0, 5).when(F.col("id") % 3 == 1, 0).alias("retention_runs"))
    return r, r.select("run_id", "site_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("item_key")), s


def _pruned(spark, d):
    return M.pruned(*_runs_records_limits(spark, d), 10)


@query("src_11_pruned_runs", with_views(f"{KEEP} SELECT run_id FROM x WHERE k <= 0 OR n <= k", "runs"))
def src_11(spark, d):
    return _pruned(spark, d)[0].select("run_id")


@query("src_11_pruned_records", with_views(f"{KEEP} SELECT run_id, item_key FROM x, (VALUES (1), (2)) AS t(item_key) WHERE k <= 0 OR n <= k", "runs"))
def src_11_records(spark, d):
    return _pruned(spark, d)[1].select("run_id", "item_key")


@query("src_11_pruned_in_buckets", with_views(f"{KEEP} SELECT run_id, item_key FROM x, (VALUES (0), (1), (2)) AS t(item_key) WHERE k <= 0 OR n <= k", "runs"))
def src_11_buckets(spark, d):
    """What is left of runs (as item 0) and records, pruned in buckets."""
    r, records, limits = _runs_records_limits(spark, d)
    held, of_records = _in_buckets(spark, r, "site_id"), _in_buckets(spark, records, "site_id")
    M.prune_runs(held, of_records, limits, 10, 1)
    return held.rows().select("run_id", F.lit(0).alias("item_key")).unionByName(of_records.rows().select("run_id", "item_key"))


@query("src_12_evolved_schema", with_views("SELECT id, url, CASE WHEN id % 2 = 0 THEN 'any_change' ELSE alert_trigger END AS alert_trigger FROM sites", "sites"))
def src_12(spark, d):
    s = sites(spark, d).select("id", "url", "alert_trigger")
    return M.evolved(s.where("id % 2 = 0").drop("alert_trigger"), s.where("id % 2 = 1"), {"alert_trigger": "any_change"})


def _payloads(spark, d, shape: str):
    """A payload for each brand with its parts in one of the store shapes."""
    cents = F.floor(F.col("p_retailprice") * 100 + 0.5).cast("long")
    price = (cents / 100).cast("decimal(18,2)").cast("string")
    k = F.col("p_partkey").cast("string")
    shapes = {
        "list": (F.struct(F.col("p_name").alias("name"), F.concat(F.lit("//s.test/"), k).alias("itemUrl"), F.concat(F.lit("$"), price).alias("priceShow"), F.when(F.col("p_size") % 2 == 0, "mall").alias("mallType"), F.lit("1.2k sold").alias("itemSoldCntShow")), lambda x: F.struct(F.struct(x.alias("listItems")).alias("mods"))),
        "micro": (F.struct(F.struct(F.col("p_name").alias("name"), (cents * 1000).alias("price"), k.alias("itemid"), F.lit("7").alias("shopid"), (F.col("p_size") % 2).alias("stock")).alias("item_basic")), lambda x: F.struct(x.alias("items"))),
        "suggest": (F.struct(F.col("p_name").alias("title"), F.concat(F.lit("/p/"), k).alias("url"), F.when(F.col("p_size") % 2 == 0, price).otherwise(cents.cast("string")).alias("price"), F.col("p_brand").alias("vendor")), lambda x: F.struct(F.struct(F.struct(x.alias("products")).alias("results")).alias("resources"))),
        "minor": (F.struct(F.col("p_name").alias("name"), F.concat(F.lit("https://w.test/"), k).alias("permalink"), F.struct(cents.cast("string").alias("price"), F.when(F.col("p_size") % 2 == 0, "EUR").alias("currency_code"), F.lit(2).alias("currency_minor_unit")).alias("prices"), F.array(F.struct(F.concat(k, F.lit(".jpg")).alias("src"))).alias("images")), lambda x: x),
    }
    item, wrap = shapes[shape]
    g = table(spark, d, "part").groupBy(F.trim("p_brand").alias("store")).agg(F.collect_list(item).alias("x"))
    return g.select("store", F.to_json(wrap(F.col("x"))).alias("payload"))


S = ["store"]


def _sql(columns: str, where: str = "true") -> str:
    return f"SELECT trim(p_brand) AS store, p_name AS title, {columns} FROM part WHERE {where}"


@query("src_13_list_items", _sql(f"concat('https://s.test/', p_partkey) AS url, {PRICE} AS price, p_size % 2 = 0 AS official, CAST(1200 AS BIGINT) AS sold"))
def src_13(spark, d):
    return M.list_items(_payloads(spark, d, "list"), S).select("store", "title", "url", "price", "official", "sold")


@query("src_14_micro_units", _sql(f"concat('https://store.test/product/7/', p_partkey) AS url, {PRICE} AS price, p_size % 2 = 1 AS in_stock"))
def src_14(spark, d):
    return M.micro_units(_payloads(spark, d, "micro"), S).select("store", "title", "url", "price", "in_stock")


@query("src_15_suggestions", _sql(f"concat('https://d.test/p/', p_partkey) AS url, CASE WHEN p_size % 2 = 0 THEN {PRICE} END AS price, p_brand AS seller"))
def src_15(spark, d):
    return M.suggestions(_payloads(spark, d, "suggest"), S, F.lit("d.test")).select("store", "title", "url", "price", "seller")


@query("src_16_minor_units", _sql(f"concat('https://w.test/', p_partkey) AS url, {PRICE} AS price, CASE WHEN p_size % 2 = 0 THEN 'EUR' ELSE 'USD' END AS currency, concat(p_partkey, '.jpg') AS image"))
def src_16(spark, d):
    return M.minor_units(_payloads(spark, d, "minor"), S, F.lit("USD")).select("store", "title", "url", "price", "currency", "image")


@query("src_17_first_platform", _sql("CASE WHEN length(trim(p_brand)) % 2 = 1 OR trim(p_brand) LIKE '%1' THEN concat('https://d.test/p/', p_partkey) ELSE concat('https://w.test/', p_partkey) END AS url"))
def src_17(spark, d):
    one = M.suggestions(_payloads(spark, d, "suggest").where("length(store) % 2 = 1 OR store LIKE '%1'"), S, F.lit("d.test"))
    two = M.minor_units(_payloads(spark, d, "minor"), S, F.lit("USD"))
    return M.first_platform([one, two], S).select("store", "title", "url")
