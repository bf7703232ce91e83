"""Views over the base tables: price points, runs, sites, listings, price texts and store payloads.

``SQL`` holds each view's definition as a common table expression for comparison queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import numbered

STYLES = 6

SQL = {
    "obs": """obs AS (SELECT l_partkey AS item_id, l_suppkey AS site_id, l_shipdate AS seen_at, l_orderkey AS tie1, l_linenumber AS tie2, l_extendedprice AS price,
        CASE l_suppkey % 5 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' WHEN 3 THEN 'JPY' ELSE 'XXX' END AS currency,
        CASE l_returnflag WHEN 'R' THEN 'Out of stock' WHEN 'A' THEN 'In stock' ELSE 'see store' END AS availability FROM lineitem)""",
    "runs": """runs AS (SELECT event_id AS run_id, user_id AS site_id, ts AS fetched_at, value AS price, event_type AS content_token,
        CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS healed, CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS used_llm, least(value / 100, 1.0) AS confidence FROM events)""",
    "sites": """sites AS (SELECT c_custkey AS id, concat('https://shop', CAST(c_custkey AS VARCHAR), '.test/p') AS url, 60 * (1 + c_nationkey % 24) AS interval_minutes,
        CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS active,
        CASE c_custkey % 6 WHEN 0 THEN 'any_change' WHEN 1 THEN 'price_drop' WHEN 2 THEN 'price_below' WHEN 3 THEN 'price_above' WHEN 4 THEN 'back_in_stock' ELSE 'out_of_stock' END AS alert_trigger,
        CASE WHEN c_custkey % 6 IN (2, 3) THEN 50.0 END AS target_price FROM customer)""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt by key over four tasks a core: a small file is read by one task, whatever is made of its rows afterwards.

    Nor does the file's size tell that of what is made of them, so joins do not broadcast it.
    """
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, key).hint("merge")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts, spread: pages and titles made from them are far larger than their file."""
    return spread(table(spark, sf_dir, "part"), "p_partkey")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price points: item_id, site_id, seen_at, tie1, tie2, price, currency, availability."""
    store = F.col("l_suppkey") % 5
    currency = F.when(store == 0, "USD").when(store == 1, "EUR").when(store == 2, "GBP").when(store == 3, "JPY").otherwise("XXX")
    stock = F.when(F.col("l_returnflag") == "R", "Out of stock").when(F.col("l_returnflag") == "A", "In stock").otherwise("see store")
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("item_id"), F.col("l_suppkey").alias("site_id"), F.col("l_shipdate").alias("seen_at"), F.col("l_orderkey").alias("tie1"), F.col("l_linenumber").alias("tie2"), F.col("l_extendedprice").alias("price"), currency.alias("currency"), stock.alias("availability"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for each event: run_id, site_id, fetched_at, price, content_token, healed, used_llm, confidence."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("run_id"), F.col("user_id").alias("site_id"), F.col("ts").alias("fetched_at"), F.col("value").alias("price"), kind.alias("content_token"), F.when(kind == "error", 1).otherwise(0).alias("healed"), F.when(kind == "signup", 1).otherwise(0).alias("used_llm"), F.least(F.col("value") / 100, F.lit(1.0)).alias("confidence"))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Watched sites: id, url, interval_minutes, active, alert_trigger, target_price."""
    kind = F.col("c_custkey") % 6
    trigger = F.when(kind == 0, "any_change").when(kind == 1, "price_drop").when(kind == 2, "price_below").when(kind == 3, "price_above").when(kind == 4, "back_in_stock").otherwise("out_of_stock")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("https://shop"), F.col("c_custkey").cast("string"), F.lit(".test/p")).alias("url"), (60 * (1 + F.col("c_nationkey") % 24)).alias("interval_minutes"), F.when(F.col("c_acctbal") > 0, 1).otherwise(0).alias("active"), trigger.alias("alert_trigger"), F.when(kind.isin(2, 3), 50.0).alias("target_price"))


def price_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part_id and its price printed in six styles, the last without a number."""
    cents = F.floor(F.col("p_retailprice") * 100 + 0.5)
    plain = F.concat((cents / 100).cast("decimal(18,2)").cast("string"))
    grouped = F.format_number((cents / 100).cast("decimal(18,2)"), 2)
    style = F.col("p_partkey") % STYLES
    text = (
        F.when(style == 0, plain)
        .when(style == 1, F.concat(F.lit("$"), grouped))
        .when(style == 2, F.concat(F.translate(grouped, ",.", ".,"), F.lit(" €")))
        .when(style == 3, F.concat(F.lit("US$ "), plain))
        .when(style == 4, F.concat(plain, F.lit(" GBP")))
        .otherwise(F.lit("price on request"))
    )
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_id"), text.alias("text"))


def listings(spark: SparkSession, sf_dir: str, points: DataFrame | None = None) -> DataFrame:
    """A search hit for each price point, or each of those given: the part's name and model token, store, price, currency, url and stock."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    o = obs(spark, sf_dir) if points is None else points
    title = F.concat_ws(" ", "p_brand", "p_name", F.concat(F.lit("m"), F.col("p_size").cast("string")))
    url = F.concat(F.lit("https://store"), F.col("site_id").cast("string"), F.lit(".test/item/"), F.col("item_id").cast("string"), F.lit("?ref="), F.col("tie1").cast("string"))
    return o.join(part, o["item_id"] == part["p_partkey"]).select("item_id", "site_id", "seen_at", "tie1", "tie2", title.alias("title"), F.col("p_brand").alias("brand"), F.col("item_id").cast("string").alias("sku"), F.concat(F.lit("store"), F.col("site_id").cast("string")).alias("retailer"), url.alias("url"), "price", "currency", "availability", F.col("p_size").alias("size"))


SQL["listings"] = """listings AS (SELECT item_id, site_id, seen_at, tie1, tie2, concat_ws(' ', p_brand, p_name, concat('m', CAST(p_size AS VARCHAR))) AS title, p_brand AS brand, CAST(item_id AS VARCHAR) AS sku,
        concat('store', CAST(site_id AS VARCHAR)) AS retailer, concat('https://store', CAST(site_id AS VARCHAR), '.test/item/', CAST(item_id AS VARCHAR), '?ref=', CAST(tie1 AS VARCHAR)) AS url,
        price, currency, availability, p_size AS size FROM obs JOIN part ON p_partkey = item_id)"""


def with_views(query: str, *names: str) -> str:
    """A comparison query that starts with the named views."""
    return "WITH " + ",\n".join(SQL[n] for n in names) + ("\n" + query if query.lstrip().upper().startswith("SELECT") else ",\n" + query)


def product_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A product page for each part: JSON-LD, microdata or OpenGraph by part key modulo 3."""
    cents = F.floor(F.col("p_retailprice") * 100 + 0.5).cast("long")
    price = F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    stock = F.when(F.col("p_size") % 2 == 0, "https://schema.org/InStock").otherwise("https://schema.org/OutOfStock")
    fields = {"{n}": F.col("p_name"), "{b}": F.trim("p_brand"), "{p}": price, "{a}": stock, "{k}": F.col("p_partkey").cast("string")}

    def fill(template: str):
        out = F.lit(template)
        for name, value in fields.items():
            out = F.replace(out, F.lit(name), value)
        return out

    shop = "<html><head><title>{n} | Shop</title><style>p {}</style>"
    jsonld = shop + '<script type="application/ld+json">{"@context": "https://schema.org", "@graph": [{"@type": "Product", "name": "{n}", "sku": "{k}", "brand": {"@type": "Brand", "name": "{b}"}, "offers": {"@type": "Offer", "price": "{p}", "priceCurrency": "USD", "availability": "{a}"}}]}</script></head><body><h1>{n}</h1><p class="price">${p}</p></body></html>'
    micro = shop + '</head><body itemscope itemtype="https://schema.org/Product"><h1 itemprop="name">{n}</h1><span itemprop="brand">{b}</span><meta itemprop="priceCurrency" content="USD"><span itemprop="price" content="{p}">{p} dollars</span><link itemprop="availability" href="{a}"></body></html>'
    graph = shop + '<meta property="og:title" content="{n}"><meta property="og:type" content="product"><meta property="product:price:amount" content="{p}"><meta property="product:price:currency" content="USD"><meta property="product:brand" content="{b}"><meta property="og:image" content="/i/{k}.jpg"></head><body><h1> {n} </h1><div class="cost">USD {p}</div><p>Add to cart</p></body></html>'
    k = F.col("p_partkey") % 3
    html = F.when(k == 0, fill(jsonld)).when(k == 1, fill(micro)).otherwise(fill(graph))
    return parts(spark, sf_dir).select(F.col("p_partkey").alias("page_id"), F.concat(F.lit("https://shop.test/product/"), fields["{k}"]).alias("url"), html.alias("html"))


def list_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing page for each brand: its parts as a JSON-LD item list, in hydration state and as inline JSON."""
    cents = F.floor(F.col("p_retailprice") * 100 + 0.5).cast("long")
    item = F.struct(F.col("p_partkey").cast("string").alias("sku"), F.col("p_name").alias("name"), (cents / 100).cast("decimal(18,2)").alias("price"), F.concat(F.lit("/item/"), F.col("p_partkey").cast("string")).alias("url"))
    g = table(spark, sf_dir, "part").groupBy(F.trim("p_brand").alias("brand")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    ld = F.to_json(F.struct(F.lit("ItemList").alias("@type"), F.transform("items", lambda x: F.struct(F.lit("ListItem").alias("@type"), F.struct(F.lit("Product").alias("@type"), x["name"].alias("name"), x["sku"].alias("sku"), x["url"].alias("url"), F.struct(x["price"].alias("price"), F.lit("USD").alias("priceCurrency")).alias("offers")).alias("item"))).alias("itemListElement")))
    state = F.to_json(F.struct(F.struct(F.struct(F.col("items").alias("products")).alias("pageProps")).alias("props")))
    inline = F.to_json(F.struct(F.lit(1).alias("version"), F.col("items").alias("products")))
    cards = F.array_join(F.transform("items", lambda x: F.concat(F.lit('<li class="product-card"><a class="name" href="'), x["url"], F.lit('">'), x["name"], F.lit('</a><span class="amount">$'), x["price"].cast("string"), F.lit("</span></li>"))), "")
    html = F.concat(F.lit('<html><head><script type="application/ld+json">'), ld, F.lit('</script></head><body><ul>'), cards, F.lit('</ul><script id="__NEXT_DATA__" type="application/json">'), state, F.lit("</script><script>var shop = "), inline, F.lit("; init(shop);</script></body></html>"))
    return g.select("brand", F.concat(F.lit("https://shop.test/brand/"), "brand").alias("url"), html.alias("html"))


#: Items of a listing page in one part of it.
PART_ITEMS = 500


def list_page_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of list_pages (brand), each as the html of many parts, in the order of part: no row or task holds all items of a brand."""
    cents = F.floor(F.col("p_retailprice") * 100 + 0.5).cast("long")
    sku, name, price = F.col("p_partkey").cast("string"), F.col("p_name"), (cents / 100).cast("decimal(18,2)")
    url = F.concat(F.lit("/item/"), sku)
    product = F.struct(F.lit("Product").alias("@type"), name.alias("name"), sku.alias("sku"), url.alias("url"), F.struct(price.alias("price"), F.lit("USD").alias("priceCurrency")).alias("offers"))
    ld = F.to_json(F.struct(F.lit("ListItem").alias("@type"), product.alias("item")))
    card = F.concat(F.lit('<li class="product-card"><a class="name" href="'), url, F.lit('">'), name, F.lit('</a><span class="amount">$'), price.cast("string"), F.lit("</span></li>"))
    item = F.to_json(F.struct(sku.alias("sku"), name.alias("name"), price.alias("price"), url.alias("url")))
    items = parts(spark, sf_dir).select(F.trim("p_brand").alias("brand"), sku.alias("sku"), ld.alias("ld"), card.alias("card"), item.alias("item"))
    chunk = F.floor((F.col("n") - 1) / PART_ITEMS).cast("int")
    chunks = numbered(items, ["brand"], ["sku"], "n").withColumn("chunk", chunk).groupBy("brand", "chunk").agg(F.sort_array(F.collect_list(F.struct("n", "ld", "card", "item"))).alias("items"))
    listed = lambda column, mark: F.concat(F.when(F.col("chunk") > 0, mark).otherwise(""), F.array_join(F.col("items")[column], mark))
    texts = [listed("ld", ","), listed("card", ""), listed("item", ","), listed("item", ",")]
    # What stands before each list, and at the end.
    between = [
        '<html><head><script type="application/ld+json">{"@type":"ItemList","itemListElement":[', ']}</script></head><body><ul>', '</ul><script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"products":[',
        ']}}}</script><script>var shop = {"version":1,"products":[', ']}; init(shop);</script></body></html>',
    ]
    fixed = F.array(*(F.struct(F.struct(F.lit(i).alias("list"), F.lit(-1).alias("chunk")).alias("part"), F.lit(text).alias("html")) for i, text in enumerate(between)))
    filled = F.array(*(F.struct(F.struct(F.lit(i).alias("list"), F.col("chunk").alias("chunk")).alias("part"), text.alias("html")) for i, text in enumerate(texts)))
    return items.select("brand").distinct().select("brand", F.inline(fixed)).unionByName(chunks.select("brand", F.inline(filled)))
