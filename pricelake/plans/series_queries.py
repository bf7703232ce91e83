"""Queries over price series and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricelake.operators import series as S
from pricelake.sources.inputs import obs, runs, sites, table, with_views

from .registry import query

TIME = ["seen_at", "tie1", "tie2"]
ORDER = "ORDER BY seen_at, tie1, tie2"
CENTS = "sum(CAST(floor(price * 100 + 0.5) AS BIGINT))"


def r(x: str, k: int) -> str:
    return f"floor(({x}) * {10**k} + 0.5) / {10**k}"


LAST = "arg_max(price, {'a': seen_at, 'b': tie1, 'c': tie2})"


@query("flt_1_active_sites", with_views("SELECT id, url, alert_trigger FROM sites WHERE active = 1", "sites"))
def flt_1(spark, d):
    return sites(spark, d).where("active = 1").select("id", "url", "alert_trigger")


@query("flt_2_one_series", with_views("SELECT seen_at, tie1, tie2, price FROM obs WHERE item_id = (SELECT min(item_id) FROM obs)", "obs"))
def flt_2(spark, d):
    o = obs(spark, d)
    return S.one_series(o, "price", "item_id", o.agg(F.min("item_id")).first()[0], TIME).select(*TIME, "price")


@query("flt_3_numeric_series", with_views(f"SELECT site_id, item_id, array_to_string(list(CAST(CAST(floor(price * 100 + 0.5) AS BIGINT) AS VARCHAR) {ORDER}), ',') AS cents FROM obs GROUP BY site_id, item_id", "obs"))
def flt_3(spark, d):
    s = S.numeric_series(obs(spark, d), "price", ["site_id", "item_id"], TIME)
    return s.select("site_id", "item_id", F.array_join(F.transform("values", lambda v: F.floor(v * 100 + 0.5).cast("string")), ",").alias("cents"))


NOW = "TIMESTAMP '2030-01-01 00:00:00'"


@query("flt_4_due_sites", with_views(f"SELECT id, last_run FROM sites LEFT JOIN (SELECT site_id, max(fetched_at) AS last_run FROM runs GROUP BY site_id) AS r ON site_id = id WHERE active = 1 AND (last_run IS NULL OR epoch({NOW}) - epoch(last_run) >= interval_minutes * 60)", "sites", "runs"))
def flt_4(spark, d):
    return S.due(sites(spark, d), runs(spark, d), F.lit("2030-01-01 00:00:00").cast("timestamp")).select("id", "last_run")


@query("agg_1_site_health", with_views("SELECT id, url, count(run_id) AS runs, CAST(coalesce(sum(healed), 0) AS BIGINT) AS heals, CAST(coalesce(sum(used_llm), 0) AS BIGINT) AS llm_runs, floor(avg(confidence) * 1000000 + 0.5) / 1000000 AS confidence FROM sites LEFT JOIN runs ON site_id = id GROUP BY id, url", "sites", "runs"))
def agg_1(spark, d):
    return S.site_health(sites(spark, d), runs(spark, d)).withColumn("confidence", S.rounded(F.col("confidence"), 6))


AVG = r(f"{CENTS} / count(*) / 100", 2)
INSIGHTS = f"SELECT item_id, count(*) AS count, min(price) AS low, max(price) AS high, {AVG} AS avg, {LAST} AS current FROM obs GROUP BY item_id"


@query("agg_2_price_insights", with_views(f"i AS ({INSIGHTS}) SELECT *, CASE WHEN avg <> 0 THEN {r('(current - avg) / avg * 100', 1)} END AS pct_vs_avg, current <= low AS is_all_time_low FROM i", "obs"))
def agg_2(spark, d):
    return S.price_insights(obs(spark, d), "price", "item_id", TIME)


@query(
    "agg_3_deal_score",
    with_views(
        f"""c AS (SELECT item_id, {LAST} AS current, min(price) AS low, max(price) AS high, count(*) AS n FROM obs GROUP BY item_id)
        SELECT item_id, CAST(CASE WHEN max(n) < 2 OR max(high) <= max(low) THEN 0 ELSE greatest(0, least(100, floor(100 * (0.6::DOUBLE * ((max(high) - max(current)) / (max(high) - max(low))) + 0.4::DOUBLE * (count(*) FILTER (WHERE price >= current) / count(*))) + 0.5))) END AS INT) AS deal_score
        FROM obs JOIN c USING (item_id) GROUP BY item_id""",
        "obs",
    ),
)
def agg_3(spark, d):
    return S.deal_scores(obs(spark, d), "price", "item_id", TIME)


@query(
    "agg_4_availability",
    with_views(
        f"""k AS (SELECT *, availability = 'In stock' AS s, lag(availability = 'In stock') OVER (PARTITION BY item_id {ORDER}) AS was FROM obs WHERE availability <> 'see store')
        SELECT item_id, count(*) AS samples, {r('count(*) FILTER (WHERE s) * 100 / count(*)', 1)} AS in_stock_pct, count(*) FILTER (WHERE s AND NOT was) AS restocks, {LAST.replace('price', 's')} AS in_stock FROM k GROUP BY item_id""",
        "obs",
    ),
)
def agg_4(spark, d):
    return S.availability_stats(obs(spark, d), "availability", "item_id", TIME)


STATS = f"count(*) AS count, {r('min(price)', 2)} AS low, {r('max(price)', 2)} AS high, {AVG} AS avg, {r('median(price)', 2)} AS median"


@query("agg_5_history_stats", with_views(f"SELECT item_id, currency, {STATS} FROM obs WHERE seen_at >= DATE '1995-01-01' GROUP BY item_id, currency", "obs"))
def agg_5(spark, d):
    return S.history_stats(obs(spark, d), "price", ["item_id", "currency"], F.lit("1995-01-01").cast("date"))


@query("agg_6_price_summary", with_views(f"s AS (SELECT item_id, {STATS} FROM obs GROUP BY item_id) SELECT item_id, low AS min, high AS max, avg, median, {r('high - low', 2)} AS savings, count FROM s", "obs"))
def agg_6(spark, d):
    return S.price_summary(obs(spark, d), "price", "item_id")


@query("agg_7_fill_confidence", f"SELECT event_type, {r('(count(*) + count(*) FILTER (WHERE event_id % 3 > 0)) / (count(*) * 2)', 3)} AS confidence FROM events GROUP BY event_type")
def agg_7(spark, d):
    e = table(spark, d, "events").select("event_type", F.col("event_id").alias("title"), F.when(F.col("event_id") % 3 == 1, "7").when(F.col("event_id") % 3 == 2, "8").otherwise("").alias("price"))
    return S.confidence_by_fill(e, ["title", "price"], ["title", "price"], "event_type")


@query(
    "agg_8_validation",
    "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'missing price' WHEN 1 THEN 'price is not a number' END AS message, event_id % 3 = 2 AS valid FROM events",
)
def agg_8(spark, d):
    price = F.when(F.col("event_id") % 3 == 1, "soon").when(F.col("event_id") % 3 == 2, "8.5")
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("title"), price.alias("price"))
    return S.validation(e, {"title": "text", "price": "price"}, ["title", "price"], "event_id")


@query(
    "agg_10_usage",
    f"""WITH u AS (SELECT user_id AS run_id, count(*) AS calls, CAST(sum(greatest(0, event_id % 900 - 50)) AS BIGINT) AS prompt_tokens, CAST(sum(event_id % 300) AS BIGINT) AS completion_tokens FROM events GROUP BY user_id)
    SELECT *, prompt_tokens + completion_tokens AS total_tokens, {r('(prompt_tokens + completion_tokens) / 1000 * CAST(0.002 AS DOUBLE)', 6)} AS cost, greatest(0, 70 - calls) AS budget_left FROM u""",
)
def agg_10(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("run_id"), (F.col("event_id") % 900 - 50).alias("prompt_tokens"), (F.col("event_id") % 300).alias("completion_tokens"))
    return S.usage_rollup(e, "run_id", 0.002, 70)


RUN_NO = "row_number() OVER (PARTITION BY site_id ORDER BY fetched_at DESC, run_id DESC) AS n"


@query("win_1_latest_run", with_views(f"SELECT run_id, site_id, fetched_at, price FROM (SELECT *, {RUN_NO} FROM runs) AS t WHERE n = 1", "runs"))
def win_1(spark, d):
    return S.latest(runs(spark, d), "site_id", ["fetched_at", "run_id"]).select("run_id", "site_id", "fetched_at", "price")


def _records(spark, d):
    return runs(spark, d).select("run_id", "site_id", F.posexplode(F.array(F.col("price"), F.col("price") * 2)).alias("item_key", "value"))


def _records_sql(n: int) -> str:
    return with_views(f"SELECT run_id, site_id, CAST(k AS INT) AS item_key, price * (k + 1) AS value FROM (SELECT *, {RUN_NO} FROM runs) AS t, (VALUES (0), (1)) AS x(k) WHERE n = {n}", "runs")


@query("win_2_latest_records", _records_sql(1))
def win_2(spark, d):
    return S.records_of_run(_records(spark, d), runs(spark, d))


@query("win_3_previous_records", _records_sql(2))
def win_3(spark, d):
    return S.records_of_run(_records(spark, d), runs(spark, d), 2)


@query("win_4_stale_pages", with_views("SELECT run_id, coalesce(content_token = lag(content_token) OVER (PARTITION BY site_id ORDER BY fetched_at, run_id), false) AS stale FROM runs", "runs"))
def win_4(spark, d):
    return S.stale(runs(spark, d), "content_token").select("run_id", "stale")


@query("win_5_movement", with_views(f"p AS (SELECT *, lag(price) OVER (PARTITION BY item_id {ORDER}) AS was FROM obs) SELECT item_id, tie1, tie2, CASE WHEN was <> 0 THEN {r('(price - was) / was * 100', 1)} END AS movement FROM p", "obs"))
def win_5(spark, d):
    return S.movement(obs(spark, d), "price", "item_id", TIME).select("item_id", "tie1", "tie2", "movement")


OUTLIER_SQL = """q AS (SELECT a.run_id, a.price, median(b.price) AS m, count(b.price) AS n FROM runs AS a LEFT JOIN runs AS b ON b.site_id = a.site_id AND (b.fetched_at, b.run_id) < (a.fetched_at, a.run_id) GROUP BY a.run_id, a.price),
    w AS (SELECT q.run_id, q.price, q.m, q.n, median(abs(b.price - q.m)) AS s FROM q JOIN runs AS a ON a.run_id = q.run_id LEFT JOIN runs AS b ON b.site_id = a.site_id AND (b.fetched_at, b.run_id) < (a.fetched_at, a.run_id) GROUP BY q.run_id, q.price, q.m, q.n),
    o AS (SELECT run_id, coalesce(n >= 6 AND CASE WHEN s > 0 THEN abs(price - m) / (s * CAST(1.4826 AS DOUBLE)) > 6 ELSE abs(price - m) > greatest(1e-9, abs(m) * 0.5) END, false) AS outlier FROM w)"""


@query("win_6_outliers", with_views(OUTLIER_SQL + " SELECT run_id, outlier FROM o", "runs"))
def win_6(spark, d):
    return S.outliers(runs(spark, d), "price", "site_id", ["fetched_at", "run_id"]).select("run_id", "outlier")


@query("win_6_outliers_of_long_series", with_views(OUTLIER_SQL.replace("b.site_id = a.site_id", "b.content_token = a.content_token") + " SELECT run_id, outlier FROM o", "runs"))
def win_6_long(spark, d):
    """Few series of very many runs each, spread over slices; slices are small, so that these tables fill many."""
    return S.outliers(runs(spark, d), "price", "content_token", ["fetched_at", "run_id"], held=100, slice_rows=200).select("run_id", "outlier")


@query(
    "win_7_scaled_series",
    with_views(
        f"""SELECT item_id, tie1, tie2, CASE WHEN count(*) OVER w > 1 THEN (row_number() OVER (PARTITION BY item_id {ORDER}) - 1) / (count(*) OVER w - 1) ELSE 0.0 END AS x,
        (price - min(price) OVER w) / CASE WHEN max(price) OVER w > min(price) OVER w THEN max(price) OVER w - min(price) OVER w ELSE 1 END AS y,
        CASE WHEN last_value(price) OVER (PARTITION BY item_id {ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) >= first_value(price) OVER (PARTITION BY item_id {ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) THEN 'up' ELSE 'down' END AS trend
        FROM obs WINDOW w AS (PARTITION BY item_id)""",
        "obs",
    ),
)
def win_7(spark, d):
    return S.scaled(obs(spark, d), "price", "item_id", TIME).select("item_id", "tie1", "tie2", "x", "y", "trend")


@query("win_8_below_median", with_views(f"m AS (SELECT item_id, median(price) AS m FROM obs GROUP BY item_id) SELECT item_id, tie1, tie2, CASE WHEN m > 0 THEN {r('(m - price) / m * 100', 1)} END AS deal_pct FROM obs JOIN m USING (item_id)", "obs"))
def win_8(spark, d):
    return S.deal_percent(obs(spark, d), "price", "item_id").select("item_id", "tie1", "tie2", "deal_pct")


@query(
    "win_9_watchlist",
    with_views(
        f"""d AS (SELECT site_id, seen_at, floor(count(*) FILTER (WHERE availability <> 'see store') / count(*) * 1000 + 0.5) / 1000 AS confidence, count(*) FILTER (WHERE currency = 'XXX') = 0 AS known,
          min({{'a': tie1, 'b': tie2, 'i': item_id, 'p': price, 's': availability}}) AS f FROM obs GROUP BY site_id, seen_at),
        n AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY seen_at DESC) AS k FROM d),
        c AS (SELECT site_id, max(f.i) FILTER (WHERE k = 1) AS item_key, max(f.p) FILTER (WHERE k = 1) AS price, max(f.s) FILTER (WHERE k = 1) AS a, max(f.p) FILTER (WHERE k = 2) AS prev_price,
          max(confidence) FILTER (WHERE k = 1) AS confidence, bool_or(known) FILTER (WHERE k = 1) AS known, max(seen_at) FILTER (WHERE k = 1) AS last_checked FROM n GROUP BY site_id),
        o AS (SELECT obs.* FROM obs JOIN c ON c.site_id = obs.site_id AND c.item_key = obs.item_id),
        s AS (SELECT site_id, count(*) AS count, min(price) AS low, max(price) AS high, {AVG} AS avg, {LAST} AS current FROM o GROUP BY site_id),
        x AS (SELECT o.site_id, CAST(CASE WHEN max(s.count) < 2 OR max(high) <= max(low) THEN 0 ELSE greatest(0, least(100, floor(100 * (0.6::DOUBLE * ((max(high) - max(current)) / (max(high) - max(low))) + 0.4::DOUBLE * (count(*) FILTER (WHERE price >= current) / count(*))) + 0.5))) END AS INT) AS deal_score FROM o JOIN s USING (site_id) GROUP BY o.site_id)
        SELECT id, item_key, price, prev_price, CASE WHEN prev_price <> 0 THEN {r('(price - prev_price) / prev_price * 100', 1)} END AS change_pct, low, high, avg, CASE WHEN avg <> 0 THEN {r('(current - avg) / avg * 100', 1)} END AS pct_vs_avg, current <= low AS is_all_time_low, coalesce(deal_score, 0) AS deal_score, confidence,
        CASE WHEN last_checked IS NULL THEN NULL WHEN confidence >= 0.85 THEN CASE WHEN known THEN 'verified' ELSE 'high' END WHEN confidence >= 0.5 THEN 'inferred' ELSE 'low' END AS quality, CASE WHEN last_checked IS NOT NULL THEN CASE WHEN known THEN 'both' ELSE 'selector' END END AS price_source,
        CASE WHEN a = 'Out of stock' THEN 'out of stock' WHEN price <= target_price THEN 'target hit' WHEN price < prev_price THEN 'price dropped' WHEN price > prev_price THEN 'price rose' WHEN a = 'In stock' THEN 'in stock' ELSE 'watching' END AS status
        FROM sites LEFT JOIN c ON c.site_id = id LEFT JOIN s ON s.site_id = id LEFT JOIN x ON x.site_id = id""",
        "obs",
        "sites",
    ),
)
def win_9(spark, d):
    """A site's price points of one day are the records of a run; stock texts and currencies that are known make it certain."""
    o = obs(spark, d).withColumn("item_key", F.col("item_id")).withColumn("run_id", F.col("seen_at")).withColumn("title", F.lit(None).cast("string")).withColumn("place", F.struct("tie1", "tie2"))
    share = S.rounded(F.count_if(F.col("availability") != "see store") / F.count("*"), 3)
    known = F.when(F.count_if(F.col("currency") == "XXX") == 0, "both").otherwise("selector")
    run = o.groupBy("site_id", "run_id").agg(share.alias("confidence"), F.to_json(F.create_map(F.lit("price"), known)).alias("field_sources")).withColumn("fetched_at", F.col("run_id"))
    out = S.watchlist(sites(spark, d), run, o, o, TIME)
    return out.select("id", "item_key", "price", "prev_price", "change_pct", "low", "high", "avg", "pct_vs_avg", "is_all_time_low", "deal_score", "confidence", "quality", F.col("field_sources")["price"].alias("price_source"), "status")
