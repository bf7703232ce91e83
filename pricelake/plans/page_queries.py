"""Queries over pages made from parts, checked against the parts, and over the raw pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricelake.functions.columns import number, rounded
from pricelake.operators import elements as E
from pricelake.operators import pages as X
from pricelake.operators.tables import archived, latest_pages
from pricelake.sources.inputs import list_page_parts, list_pages, parts, product_pages, table

from .registry import query

K = ["page_id"]
PRICE = "floor(p_retailprice * 100 + 0.5) / 100"
STOCK = "CASE WHEN p_size % 2 = 0 THEN 'In stock' ELSE 'Out of stock' END"


def part_sql(columns: str, where: str = "true") -> str:
    return f"SELECT p_partkey AS page_id, {columns} FROM part WHERE {where}"


@query("ext_1_jsonld_nodes", "SELECT p_partkey AS page_id, unnest(['Brand', 'Offer', 'Product']) AS kind FROM part WHERE p_partkey % 3 = 0")
def ext_1(spark, d):
    return X.jsonld_nodes(product_pages(spark, d), K).select("page_id", F.try_variant_get("node", "$['@type']", "string").alias("kind")).where("kind IS NOT NULL")


@query("ext_2_jsonld_record", part_sql(f"p_name AS title, {PRICE} AS price, 'USD' AS currency, {STOCK} AS availability, trim(p_brand) AS brand, CAST(p_partkey AS VARCHAR) AS sku", "p_partkey % 3 = 0"))
def ext_2(spark, d):
    return X.jsonld_record(product_pages(spark, d), K).select("page_id", "title", "price", "currency", "availability", "brand", "sku")


@query("ext_3_microdata_record", part_sql(f"p_name AS title, {PRICE} AS price, 'USD' AS currency, {STOCK} AS availability, trim(p_brand) AS brand", "p_partkey % 3 = 1"))
def ext_3(spark, d):
    return E.microdata_record(product_pages(spark, d), K).select("page_id", "title", "price", "currency", "availability", "brand")


@query("ext_4_opengraph_record", part_sql(f"p_name AS title, {PRICE} AS price, 'USD' AS currency, trim(p_brand) AS brand, concat('/i/', p_partkey, '.jpg') AS image", "p_partkey % 3 = 2"))
def ext_4(spark, d):
    return X.opengraph_record(product_pages(spark, d), K).select("page_id", "title", "price", "currency", "brand", "image")


LISTED = f"SELECT trim(p_brand) AS page, CAST(p_partkey AS VARCHAR) AS sku, p_name AS title, {PRICE} AS price, concat('/item/', p_partkey) AS url FROM part"



def _listed(df):
    return df.select(F.col("page"), "sku", "title", "price", "url")


def _lists(spark, d):
    return list_pages(spark, d).withColumnRenamed("brand", "page")


@query("ext_5_jsonld_products", LISTED)
def ext_5(spark, d):
    return _listed(X.jsonld_products(_lists(spark, d), ["page"]))


@query("set_5_first_of_equal", LISTED)
def set_5(spark, d):
    p = X.jsonld_products(_lists(spark, d), ["page"])
    return _listed(X.first_of_equal(p.unionByName(p.withColumn("title", F.upper("title")).withColumn("place", F.concat("place", F.lit("~")))), ["page"]))


@query("ext_6_state_products", LISTED)
def ext_6(spark, d):
    return _listed(X.walked_products(X.state_nodes(_lists(spark, d), ["page"], X.KEYS["title"]), ["page"]))


@query("ext_7_inline_products", LISTED)
def ext_7(spark, d):
    return _listed(X.walked_products(X.inline_nodes(_lists(spark, d), ["page"], X.KEYS["title"]), ["page"]))


@query("ext_8_node_records", LISTED.replace("concat('/item/', p_partkey) AS url", "concat('/item/', p_partkey) AS url, 'ACME' AS brand, 4.5 AS rating, CAST(9 AS DOUBLE) AS review_count"))
def ext_8(spark, d):
    """Objects with other key names: cents, nested brand and rating."""
    part = parts(spark, d)
    cents = F.floor(F.col("p_retailprice") * 100 + 0.5).cast("long")
    node = F.to_json(F.struct(F.col("p_partkey").cast("string").alias("skuId"), F.col("p_name").alias("displayName"), F.struct(cents.alias("centAmount")).alias("price"), F.concat(F.lit("/item/"), F.col("p_partkey").cast("string")).alias("link"), F.array(F.struct(F.lit("ACME").alias("name"))).alias("brand"), F.struct(F.lit("4.5").alias("ratingValue"), F.lit(9).alias("reviewCount")).alias("aggregateRating")))
    nodes = part.select(F.trim("p_brand").alias("page"), F.try_parse_json(node).alias("node"))
    return nodes.select("page", *X.node_record(F.col("node"))).select("page", "sku", "title", "price", "url", "brand", "rating", "review_count")


@query("flt_9_product_shape", "SELECT p_partkey, p_partkey % 4 IN (0, 3) AS product FROM part")
def flt_9(spark, d):
    k = F.col("p_partkey") % 4
    node = F.to_json(F.struct(F.when(k != 1, F.col("p_name")).alias("name"), F.when(k == 0, "7.5").alias("price"), F.when(k == 3, F.struct(F.lit("7.5").alias("price"))).alias("offers"), F.col("p_partkey").cast("string").alias("sku")))
    return parts(spark, d).select("p_partkey", F.coalesce(X.is_product(F.try_parse_json(node)), F.lit(False)).alias("product"))


SPEC = [{"name": "title", "selector": "h1"}, {"name": "price", "selector": ".price"}]


@query("ext_9_by_selectors", part_sql("'title' AS field, p_name AS value") + " UNION ALL " + f"SELECT p_partkey, 'price', CASE WHEN p_partkey % 3 = 0 THEN concat('$', CAST(CAST(floor(p_retailprice * 100 + 0.5) AS BIGINT) // 100 AS VARCHAR), '.', lpad(CAST(CAST(floor(p_retailprice * 100 + 0.5) AS BIGINT) % 100 AS VARCHAR), 2, '0')) END FROM part")
def ext_9(spark, d):
    return E.by_selectors(product_pages(spark, d), "page_id", SPEC).select("page_id", "field", "value")


@query("ext_9_items_by_selectors", "SELECT trim(p_brand) AS page, 'name' AS field, p_name AS value FROM part UNION ALL SELECT trim(p_brand), 'link', concat('/item/', p_partkey) FROM part")
def ext_9_items(spark, d):
    spec = [{"name": "name", "selector": ".name"}, {"name": "link", "selector": "a", "attribute": "href"}]
    pages = list_page_parts(spark, d).withColumnRenamed("brand", "page")
    return E.by_selectors(pages, "page", spec, ".product-card", "part").select("page", "field", "value")


_PLAIN = "concat(CAST(CAST(floor(p_retailprice * 100 + 0.5) AS BIGINT) // 100 AS VARCHAR), '.', lpad(CAST(CAST(floor(p_retailprice * 100 + 0.5) AS BIGINT) % 100 AS VARCHAR), 2, '0'))"


def _money():
    cents = F.floor(F.col("p_retailprice") * 100 + 0.5).cast("long")
    return F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def _estates(spark, d):
    """A page for each brand that lists its parts as places for sale, in four kinds of elements; links without an address, nested names."""
    key, k = F.col("p_partkey").cast("string"), F.col("p_partkey") % 4
    link = F.when(k < 2, F.concat(F.lit('<a href="/p/'), key, F.lit('">'))).otherwise(F.lit("<a>"))
    body = F.concat(F.when(k == 3, F.lit("<h3>")).otherwise(F.lit("<h2 class='x head'>")), link, F.lit(" <b>"), F.col("p_name"), F.lit("</b> </a></h2></h3><span data-price='"), _money(), F.lit("'>no number</span><i class=stock>"), F.when(F.col("p_size") % 2 == 0, "In stock").otherwise("yes"), F.lit("</i>"))
    opened = F.when(k == 0, '<div class="big listing">').when(k == 1, "<div class='property-card'>").when(k == 2, "<article>").otherwise("<section id=s><div class=result>")
    closed = F.when(k == 2, "</article>").when(k == 3, "</div></section>").otherwise("</div>")
    card = F.struct(F.col("p_partkey").alias("key"), F.concat(opened, body, closed).alias("html"))
    g = table(spark, d, "part").groupBy(F.trim("p_brand").alias("page")).agg(F.sort_array(F.collect_list(card)).alias("cards"))
    return g.select("page", F.concat(F.lit("https://homes.test/"), "page").alias("url"), F.concat(F.lit("<html><head><title>x</title></head><body><h2><a>not in an item</a></h2><hr>"), F.array_join(F.col("cards.html"), "<br>"), F.lit("</body></html>")).alias("html"))


ESTATE = [
    {"name": "title", "selector": "h2.head a, h3 > a"}, {"name": "price", "selector": "[data-price]", "attribute": "data-price", "kind": "price"}, {"name": "url", "selector": "a", "attribute": "href", "kind": "url"},
    {"name": "stock", "selector": "i.stock", "kind": "bool"}, {"name": "deep", "selector": "section#s div[class^=res] h3 b, .listing[class$=listing] b"}, {"name": "none", "selector": "div > b"},
]


@query(
    "ext_9_preset_items",
    f"""WITH p AS (SELECT *, trim(p_brand) AS page, row_number() OVER (PARTITION BY trim(p_brand) ORDER BY p_partkey) - 1 AS item FROM part)
    SELECT page, CAST(item AS INTEGER) AS item, field, CASE field WHEN 'title' THEN p_name WHEN 'price' THEN {_PLAIN} WHEN 'url' THEN CASE WHEN p_partkey % 4 < 2 THEN concat('/p/', p_partkey) ELSE p_name END
      WHEN 'stock' THEN CASE WHEN p_size % 2 = 0 THEN 'In stock' ELSE 'yes' END WHEN 'deep' THEN CASE WHEN p_partkey % 4 IN (0, 3) THEN p_name END END AS value,
      CASE field WHEN 'price' THEN {PRICE} END AS number, CASE field WHEN 'stock' THEN true END AS flag FROM p, (VALUES ('title'), ('price'), ('url'), ('stock'), ('deep'), ('none')) AS t(field)""",
)
def ext_9_preset(spark, d):
    """The ready-made item selector of places for sale; lists, descendants, children, parts of attributes, text for absent attributes, typed values."""
    return E.by_selectors(_estates(spark, d), "page", ESTATE, E.PRESET_ITEMS["real_estate"]).select("page", "item", "field", "value", "number", "flag")


CANDIDATES = [{"name": "price", "selector": ".price", "rank": 0}, {"name": "price", "selector": "[itemprop=price]", "attribute": "content", "rank": 1}, {"name": "price", "selector": ".cost", "rank": 2}, {"name": "title", "selector": "h2", "rank": 0}, {"name": "title", "selector": "h1", "rank": 1}]


def _host():
    return F.concat(F.lit("h"), (F.col("page_id") % 3).cast("string"))


ELECTED = "SELECT * FROM (VALUES ('h0', 'price', '.price'), ('h1', 'price', '[itemprop=price]'), ('h2', 'price', '.cost'), ('h0', 'title', 'h1'), ('h1', 'title', 'h1'), ('h2', 'title', 'h1')) AS t(host, field, selector) WHERE host IN (SELECT concat('h', p_partkey % 3) FROM part)"


@query("ext_10_elected_selectors", ELECTED)
def ext_10(spark, d):
    return E.elected_selectors(product_pages(spark, d), "page_id", _host(), CANDIDATES)


@query("ext_11_healed_selectors", "SELECT host, field, selector, host <> 'h0' AS healed FROM (" + ELECTED + ") AS e")
def ext_11(spark, d):
    p = product_pages(spark, d)
    hosts = p.select(_host().alias("host")).distinct()
    cached = hosts.select("host", F.lit("price").alias("field"), F.lit(".price").alias("selector")).unionByName(hosts.select("host", F.lit("title").alias("field"), F.lit("h1").alias("selector")))
    return E.healed(p, "page_id", _host(), cached, CANDIDATES, ["title", "price"])


WANTED = [{"name": "title", "description": "the name", "kind": "text"}, {"name": "cost", "kind": "price"}, {"name": "link", "kind": "url"}, {"name": "code", "selector": ".none"}]


def _shops(spark, d):
    """Pages of a hundred parts at most, of five hosts with different markup: two kinds of cards, one card a page, items with types, and none."""
    h = (F.col("p_partkey") % 5).cast("int")
    name, price = F.col("p_name"), F.concat(F.lit("$"), _money())
    cards = F.array(
        F.concat(F.lit('<div class="product-card"><h3><a href="/a">'), name, F.lit('</a></h3><p class="cost">'), price, F.lit("</p></div>")),
        F.concat(F.lit('<li class="product"><h2>'), name, F.lit('</h2><b data-price="'), _money(), F.lit('"></b><a class="product-link" href="/a">x</a></li>')),
        F.concat(F.lit('<h1 class="title">'), name, F.lit('</h1><p class="price">'), price, F.lit("</p>")),
        F.concat(F.lit('<div itemtype="https://schema.org/Product"><i itemprop="name">'), name, F.lit('</i><i itemprop="price" content="'), _money(), F.lit('"></i></div>')),
        F.concat(F.lit("<p>"), name, F.lit("</p>")),
    )
    rows = table(spark, d, "part").select("p_partkey", h.alias("h"), F.when(h == 2, F.col("p_partkey")).otherwise(F.floor(F.col("p_partkey") / 500)).cast("long").alias("n"), F.element_at(cards, h + 1).alias("card"))
    pages = rows.groupBy("h", "n").agg(F.sort_array(F.collect_list(F.struct("p_partkey", "card"))).alias("cards"))
    return pages.select(F.concat_ws("-", "h", "n").alias("page"), F.concat(F.lit("h"), F.col("h").cast("string")).alias("host"), F.concat(F.lit("<body><h1>Shop</h1><div>"), F.array_join(F.col("cards.card"), ""), F.lit("</div></body>")).alias("html"))


@query("ext_10_elected_containers", "SELECT * FROM (VALUES ('h0', '.product-card'), ('h1', 'li.product'), ('h3', '[itemtype*=''Product'']')) AS t(host, item_selector) WHERE host IN (SELECT concat('h', p_partkey % 5) FROM part GROUP BY p_partkey % 5, p_partkey // 500 HAVING count(*) > 1)")
def ext_10_containers(spark, d):
    return E.Election(_shops(spark, d), ["page"], F.col("host"), E.candidates(WANTED)).containers


HINTED = """VALUES ('h0', 'title', 'h3', NULL), ('h0', 'cost', '.cost', NULL), ('h0', 'link', 'h3 a', 'href'), ('h1', 'title', 'h2', NULL), ('h1', 'cost', '[data-price]', 'data-price'), ('h1', 'link', 'a.product-link', 'href'),
    ('h2', 'title', 'h1.title', NULL), ('h2', 'cost', '.price', NULL), ('h3', 'title', '[itemprop="name"]', NULL), ('h3', 'cost', '[itemprop="price"]', 'content'), ('h4', 'title', 'h1', NULL)"""


@query("ext_10_hinted_selectors", f"SELECT * FROM ({HINTED}) AS t(host, field, selector, attribute) WHERE host IN (SELECT concat('h', p_partkey % 5) FROM part)")
def ext_10_hinted(spark, d):
    """Fields without selectors, tried by what they are about, inside the elected items."""
    return E.Election(_shops(spark, d), ["page"], F.col("host"), E.candidates(WANTED)).selectors().select("host", "field", "selector", "attribute")


@query(
    "ext_11_extracted_by_election",
    f"""SELECT concat_ws('-', p_partkey % 5, CASE WHEN p_partkey % 5 = 2 THEN p_partkey ELSE p_partkey // 500 END) AS page, p_name AS title, {PRICE} AS cost FROM part WHERE p_partkey % 5 < 4""",
)
def ext_11_extracted(spark, d):
    """A record for each item of the elected containers, by the elected selectors."""
    e = E.Election(_shops(spark, d), ["page"], F.col("host"), E.candidates(WANTED))
    rows = e.extracted(e.selectors()).groupBy("page", "item")
    records = rows.agg(F.max(F.when(F.col("field") == "title", F.col("value"))).alias("title"), F.max(F.when(F.col("field") == "cost", F.col("number"))).alias("cost"))
    return records.where("cost IS NOT NULL").select("page", "title", "cost")


@query("ext_3_ended_scope", part_sql("p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN concat('s', p_partkey) END AS sku, 'Shop' AS brand"))
def ext_3_ended(spark, d):
    """A scope nested in the product's, and one after it whose properties are not the product's; without a product scope on every third page."""
    k, key = F.col("p_partkey"), F.col("p_partkey").cast("string")
    inner = F.concat(F.lit("<b itemprop=name> "), "p_name", F.lit(" </b><div itemscope itemprop='brand' content='Shop'></div>"), F.when(k % 2 == 0, F.concat(F.lit("<i itemprop='sku'>s"), key, F.lit("</i>"))).otherwise(F.lit("")))
    after = F.lit('<div itemscope itemtype="https://schema.org/Organization"><i itemprop="sku">other</i><i itemprop="rating">1</i></div>')
    html = F.when(k % 3 == 0, F.concat(F.lit("<p>"), inner, F.lit("</p>"))).otherwise(F.concat(F.lit("<i itemprop=sku>before</i><div itemscope itemtype='https://schema.org/Product'>"), inner, F.lit("</div>"), after))
    pages = parts(spark, d).select(k.alias("page_id"), html.alias("html"))
    return E.microdata_record(pages, K).select("page_id", "title", "sku", "brand")


@query(
    "ext_12_consensus_records",
    f"""SELECT p_partkey AS page_id, p_name AS title, {PRICE} AS price, CASE WHEN p_partkey % 4 < 3 THEN 'ACME' END AS brand, CASE WHEN p_partkey % 4 < 3 THEN 50.0 END AS discount_pct,
    CASE p_partkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.75 WHEN 2 THEN 0.85 ELSE 1.0 END AS confidence, CASE p_partkey % 4 WHEN 0 THEN 'verified' WHEN 1 THEN 'inferred' WHEN 2 THEN 'verified' ELSE 'high' END AS quality,
    CASE p_partkey % 4 WHEN 0 THEN 'both' WHEN 1 THEN 'both' WHEN 2 THEN 'structured' END AS price_source, CASE WHEN p_partkey % 4 < 3 THEN 'structured' END AS brand_source FROM part""",
)
def ext_12_records(spark, d):
    """Selectors that agree, differ or find no price, and pages without structured data."""
    p, k = parts(spark, d), F.col("p_partkey") % 4
    price = F.floor(F.col("p_retailprice") * 100 + 0.5) / 100
    seen = p.select(F.col("p_partkey").alias("page_id"), F.col("p_name").alias("title"), F.when(k == 1, F.lit(1.0)).when(k != 2, price).alias("price"))
    known = p.where(k < 3).select(F.col("p_partkey").alias("page_id"), F.col("p_name").alias("title"), price.alias("price"), F.lit("ACME").alias("brand"), (price * 2).alias("original_price"))
    out = X.consensus_records(seen, known, K, {"title": "text", "price": "price"})
    return out.select("page_id", "title", "price", "brand", "discount_pct", "confidence", "quality", F.col("sources")["price"].alias("price_source"), F.col("sources")["brand"].alias("brand_source"))


@query(
    "ext_12_consensus",
    f"SELECT p_partkey AS page_id, CASE p_partkey % 4 WHEN 3 THEN NULL ELSE CAST(floor(p_retailprice * 100 + 0.5) / 100 AS DOUBLE) END AS price, CASE p_partkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 WHEN 2 THEN 0.7 ELSE 0.0 END AS confidence, CASE p_partkey % 4 WHEN 0 THEN 'both' WHEN 1 THEN 'both' WHEN 2 THEN 'structured' ELSE 'none' END AS source FROM part",
)
def ext_12(spark, d):
    k, price = F.col("p_partkey") % 4, F.floor(F.col("p_retailprice") * 100 + 0.5) / 100
    seen = F.when(k == 0, F.concat(F.lit("$"), price.cast("decimal(18,2)").cast("string"))).when(k == 1, "$1.00")
    known = F.when(k < 3, price.cast("decimal(18,2)").cast("string"))
    c = parts(spark, d).select(F.col("p_partkey").alias("page_id"), X.consensus(seen, known, "price", "price").alias("c"))

    return c.select("page_id", number("c.value").alias("price"), "c.confidence", "c.source")


@query("ext_13_fallback_title", part_sql("p_name AS title"))
def ext_13(spark, d):
    return product_pages(spark, d).select("page_id", X.fallback_title(F.col("html")).alias("title"))


@query("ext_13_titles_of_raw_pages", r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1\b[^>]*>(.*?)</h1>', 1), '(?s)<[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS title FROM pages")
def ext_13_raw(spark, d):
    return table(spark, d, "pages").select("page_id", X.fallback_title(F.col("html")).alias("title"))


@query("ext_14_fallback_price", part_sql(f"{PRICE} AS amount, CASE p_partkey % 3 WHEN 1 THEN NULL ELSE 'USD' END AS currency"))
def ext_14(spark, d):
    p = product_pages(spark, d).select("page_id", X.fallback_price(F.col("html")).alias("p"))
    return p.select("page_id", "p.amount", "p.currency")


@query("ext_15_fallback_stock_and_image", part_sql("CASE WHEN p_partkey % 3 = 2 THEN 'In stock' END AS stock, CASE WHEN p_partkey % 3 = 2 THEN concat('/i/', p_partkey, '.jpg') END AS image"))
def ext_15(spark, d):
    return product_pages(spark, d).select("page_id", X.fallback_stock(F.col("html")).alias("stock"), X.fallback_image(F.col("html")).alias("image"))


@query("ext_16_filled_gaps", part_sql(f"p_name AS title, {PRICE} AS price, CASE p_partkey % 3 WHEN 0 THEN {STOCK} WHEN 2 THEN 'In stock' END AS availability, CASE WHEN p_partkey % 3 = 0 THEN 'record' ELSE 'fallback' END AS title_source"))
def ext_16(spark, d):
    p = product_pages(spark, d)
    out = X.filled_gaps(X.jsonld_record(p, K), p, K)
    return out.select("page_id", "title", "price", "availability", F.element_at("sources", "title").alias("title_source"))


@query("ext_16_requested_fields", part_sql(f"{PRICE} AS price, CASE p_partkey % 3 WHEN 1 THEN NULL ELSE 'USD' END AS currency, CASE WHEN p_partkey % 3 = 2 THEN concat('/i/', p_partkey, '.jpg') END AS image, CASE WHEN p_partkey % 3 = 2 THEN 'fallback' ELSE 'none' END AS image_source"))
def ext_16_requested(spark, d):
    """Price with its currency, and image, for records without anything."""
    p = product_pages(spark, d)
    out = X.filled_gaps(p.select("page_id", F.lit(None).cast("string").alias("brand")), p, K, ("price", "image"))
    return out.select("page_id", "price", "currency", "image", F.element_at("sources", "image").alias("image_source"))


def _kinds(spark, d):
    """A page for each part in one of eleven forms, each of which another rule of schema detection decides."""
    k = (F.col("p_partkey") % 11).cast("int")
    ld = lambda t: F.lit(f'<script type="application/ld+json">{{"@type": "{t}"}}</script>')
    card = F.lit('<div class="big product-card">x</div>')
    bodies = F.array(
        ld("JobPosting"), ld("Product"), F.concat(ld("Product"), card, card, card), F.lit('<div itemscope itemtype="https://schema.org/House">'), F.lit('<meta property="og:type" content="article">'), F.lit("<meta property='og:type' content='product.item'>"),
        F.concat(card, card, card), F.concat(card, card), F.lit("<p>x</p>"), F.lit("<p>x</p>"), F.lit("<p>x</p>"),
    )
    paths = F.array(*map(F.lit, ("/a", "/a", "/a", "/a", "/a", "/a", "/a", "/search", "/careers/7", "/blog/7", "/a")))
    key = F.col("p_partkey").cast("string")
    return parts(spark, d).select(F.col("p_partkey").alias("page_id"), F.concat(F.lit("https://shop.test"), F.element_at(paths, k + 1), F.lit("?id="), key).alias("url"), F.concat(F.element_at(bodies, k + 1), key).alias("html"))


@query("ext_17_detected_schema", part_sql("['jobs', 'product', 'product_list', 'real_estate', 'news', 'product', 'product_list', 'product_list', 'jobs', 'news', 'product'][p_partkey % 11 + 1] AS schema"))
def ext_17(spark, d):
    return _kinds(spark, d).select("page_id", X.detected_schema(F.col("url"), F.col("html")).alias("schema"))


_LINK = r"regexp_replace(url, '^[a-zA-Z][A-Za-z0-9_+.-]*://[^/?#]*', '')"


@query(
    "ext_17_schema_of_raw_pages",
    rf"""WITH p AS (SELECT page_id, html, lower(regexp_replace({_LINK}, '#.*$', '')) AS path FROM pages), t AS (SELECT *, regexp_replace(path, '\?.*$', '') AS bare, CASE WHEN contains(path, '?') THEN path ELSE concat(path, '?') END AS hay,
    greatest(len(regexp_extract_all(html, 'itemtype="[^"]*Product"')), len(regexp_extract_all(html, 'class="(?:[^"]*\s)?product(?:\s[^"]*)?"')), len(regexp_extract_all(html, 'class="(?:[^"]*\s)?product-card(?:\s[^"]*)?"'))) >= 3 AS cards FROM p)
    SELECT page_id, CASE WHEN cards OR hay SIMILAR TO '.*(/search|/category|/collections|/shop|/c/|/s\?|\?q=|&q=).*' THEN 'product_list' WHEN bare SIMILAR TO '.*(job|career|vacanc).*' THEN 'jobs'
    WHEN bare SIMILAR TO '.*(real-estate|realestate|property|properties|listing|homes|rent).*' THEN 'real_estate' WHEN bare SIMILAR TO '.*(news|article|blog|story).*' THEN 'news' ELSE 'product' END AS schema FROM t""",
)
def ext_17_raw(spark, d):
    return table(spark, d, "pages").select("page_id", X.detected_schema(F.col("url"), F.col("html")).alias("schema"))


@query("ext_17_schema_of_lists", "SELECT DISTINCT trim(p_brand) AS page, 'product_list' AS schema FROM part")
def ext_17_lists(spark, d):
    return _lists(spark, d).select("page", X.detected_schema(F.col("url"), F.col("html")).alias("schema"))


@query("ext_18_without_noise", r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>', '', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', '', 'g'), '(?is)<noscript\b[^>]*>.*?</noscript\s*>', '', 'g'), '(?is)<svg\b[^>]*>.*?</svg\s*>', '', 'g'), '(?is)<path\b[^>]*>.*?</path\s*>', '', 'g'), '(?is)<iframe\b[^>]*>.*?</iframe\s*>', '', 'g'), '(?is)<head\b[^>]*>.*?</head\s*>', '', 'g'), '(?is)<template\b[^>]*>.*?</template\s*>', '', 'g'), '(?is)<(?:link|meta)\b[^>]*>', '', 'g') AS html FROM pages")
def ext_18(spark, d):
    return table(spark, d, "pages").select("page_id", X.without_noise(F.col("html")).alias("html"))


@query("flt_6_empty_pages", part_sql("CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'shell' ELSE 'thin' END AS kind"))
def flt_6(spark, d):
    """Pages with much text, with little of it and three scripts, with little of it and two, without any, and none at all."""
    k, name = F.col("p_partkey") % 5, F.concat(F.lit("<p>"), "p_name", F.lit("</p>"))
    script = F.lit("<script>var long = 'text that does not show';</script>")
    html = F.when(k == 0, F.concat(script, script, script, F.repeat(name, 40))).when(k == 1, F.concat(script, name, script, script)).when(k == 2, F.concat(script, name, script)).when(k == 3, "")
    return parts(spark, d).select(F.col("p_partkey").alias("page_id"), X.emptiness(html).alias("kind"))


@query("ext_3_scoped_microdata", part_sql(f"p_name AS title, {PRICE} AS price, 4.5 AS rating, CAST(12 AS DOUBLE) AS review_count"))
def ext_3_scoped(spark, d):
    """Another scope with a name of its own stands before the product's; single quotes on every second page."""
    p = parts(spark, d)
    html = F.concat(F.lit('<div itemscope itemtype="https://schema.org/Organization"><b itemprop="name">Shop Inc</b></div><div itemscope itemtype="https://schema.org/Product"><b itemprop="name">'), "p_name", F.lit('</b><i itemprop="price" content="'), F.round("p_retailprice", 2).cast("string"), F.lit('"></i><i itemprop="ratingValue">4.5</i><i itemprop="reviewCount">12</i></div>'))
    pages = p.select(F.col("p_partkey").alias("page_id"), F.when(F.col("p_partkey") % 2 == 0, html).otherwise(F.translate(html, '"', "'")).alias("html"))
    return E.microdata_record(pages, K).select("page_id", "title", "price", "rating", "review_count")


@query("ext_5_deep_and_subtyped", part_sql("p_name AS title, concat('m', p_partkey) AS mpn, CASE p_partkey % 2 WHEN 0 THEN 'http://schema.org/Product' ELSE 'IndividualProduct' END AS kind"))
def ext_5_deep(spark, d):
    """Products whose types are full addresses or subtypes, twelve levels down."""
    kind = F.when(F.col("p_partkey") % 2 == 0, "http://schema.org/Product").otherwise("IndividualProduct")
    node = F.to_json(F.struct(kind.alias("@type"), F.col("p_name").alias("name"), F.concat(F.lit("/p/"), F.col("p_partkey").cast("string")).alias("url"), F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("mpn")))
    html = F.concat(F.lit('<script type="application/ld+json">' + '{"x": [' * 6), node, F.lit("]}" * 6 + "</script>"))
    pages = parts(spark, d).select(F.col("p_partkey").alias("page_id"), html.alias("html"))
    kinds = X.jsonld_nodes(pages, K, ("@type",)).select("page_id", F.try_variant_get("node", "$['@type']", "string").alias("kind"))
    return X.jsonld_products(pages, K).select("page_id", "title", "mpn").join(kinds, "page_id")


@query("set_1_strategy_union", LISTED.replace("concat('/item/', p_partkey)", "concat('https://shop.test/item/', p_partkey)"))
def set_1(spark, d):
    p = _lists(spark, d)
    keys = ["page"]
    strategies = [X.jsonld_products(p, keys), X.walked_products(X.state_nodes(p, keys, X.KEYS["title"]), keys), X.walked_products(X.inline_nodes(p, keys, X.KEYS["title"]), keys)]
    return _listed(X.strategy_union(strategies, keys, F.lit("https://shop.test/brand/x")))


@query("set_2_first_source", part_sql(f"p_name AS title, {PRICE} AS price, 'USD' AS currency, CASE WHEN p_partkey % 3 < 2 THEN {STOCK} END AS availability, trim(p_brand) AS brand"))
def set_2(spark, d):
    p = product_pages(spark, d)
    return X.first_source([X.jsonld_record(p, K), E.microdata_record(p, K), X.opengraph_record(p, K)], K)


def _checks(spark, d):
    p = product_pages(spark, d)
    got = X.first_source([X.jsonld_record(p, K), E.microdata_record(p, K), X.opengraph_record(p, K)], K)
    pairs = lambda df, t, c, a, name: df.select("page_id", F.explode(F.create_map(F.lit("title"), t, F.lit("price"), c, F.lit("availability"), a)).alias("field", name))
    part = table(spark, d, "part").withColumn("page_id", F.col("p_partkey"))
    want = pairs(part, F.col("p_name"), rounded(F.col("p_retailprice"), 2).cast("string"), F.when(F.col("p_size") % 2 == 0, "in stock").otherwise("sold out"), "want")
    have = pairs(got, F.col("title"), F.col("price").cast("string"), F.col("availability"), "got")
    return X.golden_checks(want, have, K)


@query("join_9_golden_checks", "SELECT p_partkey AS page_id, f AS field, f <> 'availability' OR p_partkey % 3 < 2 AS ok FROM part, (VALUES ('title'), ('price'), ('availability')) AS t(f)")
def join_9(spark, d):
    return _checks(spark, d).select("page_id", "field", "ok")


@query("agg_9_accuracy", "SELECT count(*) AS checks, CAST(sum(CASE WHEN f <> 'availability' OR p_partkey % 3 < 2 THEN 1 ELSE 0 END) AS BIGINT) AS passed, floor(sum(CASE WHEN f <> 'availability' OR p_partkey % 3 < 2 THEN 1 ELSE 0 END) / count(*) * 1000 + 0.5) / 1000 AS accuracy FROM part, (VALUES ('title'), ('price'), ('availability')) AS t(f)")
def agg_9(spark, d):
    return X.accuracy(_checks(spark, d))


@query("udf_2_schema_table", "SELECT concat('s', p_size) AS name, CASE min(CASE p_partkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END) WHEN 0 THEN 'user' WHEN 1 THEN 'preset' ELSE 'built-in' END AS source FROM part GROUP BY p_size")
def udf_2(spark, d):
    k = F.col("p_partkey") % 3
    specs = table(spark, d, "part").select(F.concat(F.lit("s"), F.col("p_size").cast("string")).alias("name"), F.when(k == 0, "user").when(k == 1, "preset").otherwise("built-in").alias("source"))
    return X.schema_table(specs)


@query("src_8_replay", part_sql(f"p_name AS title, {PRICE} AS price", "p_partkey % 3 = 0"))
def src_8(spark, d):

    p = product_pages(spark, d)
    old = p.select("url", F.lit("product").alias("schema"), F.lit("<html></html>").alias("html"), F.lit("2024-01-01").alias("fetched_at"))
    new = p.select("url", F.lit("product").alias("schema"), "html", F.lit("2024-02-01").alias("fetched_at"))
    stored = latest_pages(archived(old.unionByName(new))).withColumn("page_id", F.regexp_extract("url", r"(\d+)$", 1).cast(p.schema["page_id"].dataType))
    return X.jsonld_record(stored, K).select("page_id", "title", "price")
