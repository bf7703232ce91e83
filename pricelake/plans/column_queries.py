"""Queries that apply the column expressions to whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pricelake.functions import columns as C
from pricelake.sources.inputs import listings, obs, price_text, sites, table, with_views

from .registry import query

_CENTS = "CAST(floor(p_retailprice * 100 + 0.5) AS BIGINT)"
_AMOUNT = f"CASE WHEN p_partkey % 6 < 5 THEN {_CENTS} / 100.0 END"
_CODE = "CASE p_partkey % 6 WHEN 1 THEN 'USD' WHEN 2 THEN 'EUR' WHEN 3 THEN 'USD' WHEN 4 THEN 'GBP' END"


@query("col_1_number", f"SELECT p_partkey AS part_id, CAST({_AMOUNT} AS DOUBLE) AS amount FROM part")
def col_1(spark, d):
    return price_text(spark, d).select("part_id", C.number("text").alias("amount"))


@query("col_2_currency", f"SELECT p_partkey AS part_id, {_CODE} AS code FROM part")
def col_2(spark, d):
    return price_text(spark, d).select("part_id", C.currency("text").alias("code"))


@query("col_3_price", f"SELECT p_partkey AS part_id, CAST({_AMOUNT} AS DOUBLE) AS amount, {_CODE} AS code FROM part")
def col_3(spark, d):
    return price_text(spark, d).select("part_id", C.price("text").alias("p")).select("part_id", "p.amount", F.col("p.currency").alias("code"))


@query("col_4_discount", "SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice > 0 AND l_extendedprice * (1 - l_discount) < l_extendedprice THEN floor((l_extendedprice - l_extendedprice * (1 - l_discount)) / l_extendedprice * 100 * 10 + 0.5) / 10 END AS pct FROM lineitem")
def col_4(spark, d):
    now = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", C.discount_percent(F.col("l_extendedprice"), now).alias("pct"))


@query("col_5_in_stock", with_views("SELECT item_id, site_id, tie1, tie2, CASE availability WHEN 'Out of stock' THEN false WHEN 'In stock' THEN true END AS stock FROM obs", "obs"))
def col_5(spark, d):
    return obs(spark, d).select("item_id", "site_id", "tie1", "tie2", C.in_stock("availability").alias("stock"))


_VOCABULARY = ("https://schema.org/InStock", "OutOfStock", "PreOrder", "BackOrder", "LimitedAvailability", "Discontinued", "ask us")


@query("col_6_availability_label", "SELECT l_orderkey, l_linenumber, CASE l_quantity::INT % 7 WHEN 0 THEN 'In stock' WHEN 1 THEN 'Out of stock' WHEN 2 THEN 'Pre-order' WHEN 3 THEN 'Backorder' WHEN 4 THEN 'Limited availability' WHEN 5 THEN 'Discontinued' ELSE 'ask us' END AS label FROM lineitem")
def col_6(spark, d):
    text = F.get(F.array(*map(F.lit, _VOCABULARY)), F.col("l_quantity").cast("int") % 7)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", C.availability_label(text).alias("label"))


@query("col_7_content_hash", "SELECT page_id, CASE WHEN html <> '' THEN sha256(html) END AS hash FROM pages")
def col_7(spark, d):
    return table(spark, d, "pages").select("page_id", C.content_hash("html").alias("hash"))


@query("col_8_canonical_url", "WITH p AS (SELECT page_id, regexp_replace(concat(url, '/?utm=', page_id, '#top'), '[?#].*$', '') AS u FROM pages) SELECT page_id, rtrim(u, '/') AS url FROM p")
def col_8(spark, d):
    return table(spark, d, "pages").select("page_id", C.canonical_url(F.concat("url", F.lit("/?utm="), F.col("page_id").cast("string"), F.lit("#top"))).alias("url"))


@query(
    "col_9_resolved_url",
    """WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS u, regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1) AS root FROM pages)
    SELECT page_id, CASE page_id % 4 WHEN 0 THEN concat(root, '/a/', page_id) WHEN 1 THEN concat(regexp_extract(u, '^([a-zA-Z]+):', 1), '://cdn.test/', page_id)
    WHEN 2 THEN concat(CASE WHEN u = root THEN concat(u, '/') ELSE regexp_replace(u, '[^/]*$', '') END, 'b/', page_id) ELSE concat('https://x.test/', page_id) END AS url FROM p""",
)
def col_9(spark, d):
    n = F.col("page_id").cast("string")
    ref = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("/a/"), n)).when(F.col("page_id") % 4 == 1, F.concat(F.lit("//cdn.test/"), n)).when(F.col("page_id") % 4 == 2, F.concat(F.lit("b/"), n)).otherwise(F.concat(F.lit("https://x.test/"), n))
    return table(spark, d, "pages").select("page_id", C.resolved_url(F.col("url"), ref).alias("url"))


@query("col_10_host_key", "SELECT page_id, concat(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1), '::product') AS host_key FROM pages")
def col_10(spark, d):
    return table(spark, d, "pages").select("page_id", C.host_key(F.col("url"), F.lit("product")).alias("host_key"))


@query("col_11_override", with_views("SELECT id, coalesce(target_price, 75.0) AS target FROM sites", "sites"))
def col_11(spark, d):
    return sites(spark, d).select("id", C.override(F.col("target_price"), 75.0).alias("target"))


@query("col_12_clean_title", "SELECT p_partkey, trim(p_name) AS title FROM part")
def col_12(spark, d):
    return table(spark, d, "part").select("p_partkey", C.clean_title(F.concat(F.lit(' "'), "p_name", F.lit("” "))).alias("title"))


@query("col_13_normal_title", with_views(r"""SELECT item_id, tie1, tie2, regexp_replace(regexp_replace(regexp_replace(lower(trim(title)), '([a-z])([0-9])', '\1 \2', 'g'), '([0-9])([a-z])', '\1 \2', 'g'), '\s+', ' ', 'g') AS title FROM listings""", "obs", "listings"))
def col_13(spark, d):
    return listings(spark, d).select("item_id", "tie1", "tie2", C.normal_title("title").alias("title"))


@query("col_14_loose_float", f"SELECT p_partkey, CAST(floor(p_retailprice) AS DOUBLE) AS v FROM part")
def col_14(spark, d):
    return table(spark, d, "part").select("p_partkey", C.loose_float(F.concat(F.lit("about "), F.format_number(F.floor("p_retailprice"), 0), F.lit(" each"))).alias("v"))


@query("col_15_human_count", "SELECT p_partkey, CAST(p_size * 100 AS BIGINT) AS sold FROM part")
def col_15(spark, d):
    tenths = F.col("p_size")
    text = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("k sold"))
    return table(spark, d, "part").select("p_partkey", C.human_count(text).alias("sold"))


@query("col_16_discount_text", "SELECT l_orderkey, l_linenumber, CAST(floor(l_discount * 100 + 0.5) AS INT) AS pct FROM lineitem")
def col_16(spark, d):
    text = F.concat(F.lit("-"), F.floor(F.col("l_discount") * 100 + 0.5).cast("string"), F.lit("%"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", C.discount_text(text).alias("pct"))


@query("col_17_gtin", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN lpad(CAST(p_partkey AS VARCHAR), 13, '0') WHEN 1 THEN lpad(CAST(p_partkey AS VARCHAR), 8, '0') END AS gtin FROM part")
def col_17(spark, d):
    n = F.col("p_partkey").cast("string")
    code = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("EAN "), F.lpad(n, 13, "0"))).when(F.col("p_partkey") % 3 == 1, F.lpad(n, 8, "0")).otherwise(F.lpad(n, 9, "0"))
    return table(spark, d, "part").select("p_partkey", C.gtin(code).alias("gtin"))


@query("col_18_brand", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN lower(trim(p_brand)) WHEN 1 THEN 'sony' END AS brand FROM part")
def col_18(spark, d):
    title = F.concat("p_name", F.when(F.col("p_partkey") % 3 == 1, " by Sony").otherwise(""))
    return table(spark, d, "part").select("p_partkey", C.brand(title, F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand"))).alias("brand"))


@query("col_19_model_tokens", "SELECT p_partkey, concat('m', CAST(p_size AS VARCHAR)) AS models FROM part")
def col_19(spark, d):
    title = F.concat(F.regexp_replace("p_name", r"\d", ""), F.lit(" Pro M"), F.col("p_size").cast("string"), F.lit(" m"), F.col("p_size").cast("string"))
    return table(spark, d, "part").select("p_partkey", F.array_join(C.model_tokens(title), "|").alias("models"))


_PART_KEYS = lambda: dict(
    title=F.concat(F.regexp_replace("p_name", r"\d", ""), F.lit(" m"), F.col("p_size").cast("string")),
    code=F.when(F.col("p_partkey") % 4 == 0, F.lpad(F.col("p_partkey").cast("string"), 13, "0")),
    sku=F.when(F.col("p_partkey") % 4 == 1, F.concat(F.lit(" K"), F.col("p_partkey").cast("string"))),
    explicit=F.when(F.col("p_partkey") % 4 <= 2, F.col("p_brand")),
)
_STRONG = "CASE p_partkey % 4 WHEN 0 THEN concat('gtin:', lpad(CAST(p_partkey AS VARCHAR), 13, '0')) WHEN 1 THEN concat('sku:', lower(trim(p_brand)), ':k', CAST(p_partkey AS VARCHAR)) END"


@query("col_20_strong_key", f"SELECT p_partkey, {_STRONG} AS k FROM part")
def col_20(spark, d):
    return table(spark, d, "part").select("p_partkey", C.strong_key(**_PART_KEYS()).alias("k"))


@query("col_21_product_key", f"SELECT p_partkey, coalesce({_STRONG}, CASE WHEN p_partkey % 4 = 2 THEN concat('bm:', lower(trim(p_brand)), ':m', CAST(p_size AS VARCHAR)) END, concat('t:', regexp_replace(lower(trim(regexp_replace(p_name, '[0-9]', '', 'g'))), '\\s+', ' ', 'g'), ' m ', CAST(p_size AS VARCHAR))) AS k FROM part")
def col_21(spark, d):
    return table(spark, d, "part").select("p_partkey", C.product_key(**_PART_KEYS()).alias("k"))


@query("col_22_query_variants", """
SELECT p_partkey, CAST(u.i - 1 AS INT) AS n, u.v AS variant FROM (SELECT p_partkey, unnest([
  {'i': 1, 'v': concat('Card rtx', p_size)}, {'i': 2, 'v': concat('card rtx ', p_size)}, {'i': 3, 'v': concat('Cardrtx', p_size)},
  {'i': 4, 'v': concat('Card rtx', p_size, 's')}, {'i': 5, 'v': 'Card'}, {'i': 6, 'v': concat('rtx', p_size)}]) AS u FROM part)""")
def col_22(spark, d):
    q = F.concat(F.lit(" Card rtx"), F.col("p_size").cast("string"))
    return table(spark, d, "part").select("p_partkey", F.posexplode(C.query_variants(q)).alias("n", "variant"))


@query(
    "col_23_watch_status",
    with_views(
        """p AS (SELECT *, lag(price) OVER (PARTITION BY item_id ORDER BY seen_at, tie1, tie2) AS prev FROM obs)
        SELECT item_id, tie1, tie2, CASE WHEN availability = 'Out of stock' THEN 'out of stock' WHEN price <= 20000 THEN 'target hit' WHEN price < prev THEN 'price dropped' WHEN price > prev THEN 'price rose' WHEN availability = 'In stock' THEN 'in stock' ELSE 'watching' END AS status FROM p""",
        "obs",
    ),
)
def col_23(spark, d):
    prev = F.lag("price").over(Window.partitionBy("item_id").orderBy("seen_at", "tie1", "tie2"))
    o = obs(spark, d).withColumn("prev", prev)
    return o.select("item_id", "tie1", "tie2", C.watch_status(F.col("price"), C.in_stock("availability"), F.col("prev"), F.lit(20000.0)).alias("status"))


@query("col_24_quality_label", "SELECT event_id, CASE WHEN value / 100 >= 0.85 THEN CASE WHEN event_type = 'error' THEN 'verified' ELSE 'high' END WHEN value / 100 >= 0.5 THEN 'inferred' ELSE 'low' END AS label FROM events")
def col_24(spark, d):
    source = F.create_map(F.lit("price"), F.when(F.col("event_type") == "error", "both").otherwise("selector"))
    return table(spark, d, "events").select("event_id", C.quality_label(F.col("value") / 100, source).alias("label"))


@query("col_29_document_title", "SELECT p_partkey, p_name AS title FROM part")
def col_29(spark, d):
    sep = F.get(F.array(*map(F.lit, C.TITLE_SEPARATORS)), (F.col("p_partkey") % 6).cast("int"))
    return table(spark, d, "part").select("p_partkey", C.document_title(F.concat("p_name", sep, F.lit("Shop"))).alias("title"))


@query("flt_5_blocked_pages", "SELECT page_id, CASE WHEN page_id % 10 = 0 THEN 'http 403' WHEN regexp_matches(lower(substr(coalesce(html, ''), 1, 5000)), 'captcha|cloudflare|attention required|access denied|verify you are human|cf-browser-verification|just a moment') THEN 'anti-bot challenge' END AS reason FROM pages")
def flt_5(spark, d):
    return table(spark, d, "pages").select("page_id", C.blocked(F.when(F.col("page_id") % 10 == 0, 403).otherwise(200), F.col("html")).alias("reason"))


@query("flt_7_junk_titles", with_views("SELECT item_id, tie1, tie2, tie2 % 3 = 0 AS junk FROM listings", "obs", "listings"))
def flt_7(spark, d):
    t = F.when(F.col("tie2") % 3 == 0, F.concat(F.lit("Search results for "), "title")).otherwise(F.col("title"))
    return listings(spark, d).select("item_id", "tie1", "tie2", C.junk_title(t).alias("junk"))


@query("flt_8_self_links", with_views("SELECT item_id, tie1, tie2, tie2 % 2 = 0 AS keep FROM listings", "obs", "listings"))
def flt_8(spark, d):
    search = F.concat(F.lit("https://"), "retailer", F.lit(".test/search?q=1"))
    url = F.when(F.col("tie2") % 2 == 0, F.col("url")).otherwise(F.lit("#p1"))
    return listings(spark, d).select("item_id", "tie1", "tie2", C.links_to_product(url, search).alias("keep"))
