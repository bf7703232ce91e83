"""Extraction of typed product records from tables of pages (any key columns, url, html)."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricelake.functions import columns as C
from pricelake.functions.columns import missing, rounded

# Key names under which page data holds each field.
KEYS = {
    "title": ("name", "title", "productName", "product_name", "displayName", "label"),
    "price": ("price", "currentPrice", "current_price", "sellingPrice", "selling_price", "finalPrice", "final_price", "salePrice", "sale_price", "offerPrice", "priceAmount", "price_min", "min_price", "minPrice", "lowPrice", "amount"),
    "original_price": ("originalPrice", "original_price", "listPrice", "list_price", "wasPrice", "regularPrice", "regular_price", "strikePrice", "price_before_discount", "highPrice", "msrp", "oldPrice"),
    "url": ("url", "productUrl", "product_url", "itemUrl", "link", "href", "canonicalUrl", "seoUrl", "permalink", "slug", "detailUrl"),
    "image": ("image", "imageUrl", "image_url", "img", "thumbnail", "thumb", "featured_image", "mainImage", "coverImage"),
    "sku": ("sku", "skuId", "sku_id", "productId", "product_id", "itemId", "item_id"),
    "gtin": ("gtin", "gtin13", "gtin12", "gtin8", "ean", "upc", "barcode"),
    "brand": ("brand", "brandName", "brand_name", "manufacturer", "vendor"),
    "rating": ("rating", "ratingValue", "averageRating", "rating_star", "stars", "avgRating"),
    "review_count": ("reviewCount", "ratingCount", "review_count", "reviews", "numReviews", "cmt_count", "totalReviews"),
}
# Names of page globals that hold hydration state.
STATE_NAMES = ("__APOLLO_STATE__", "__INITIAL_STATE__", "__PRELOADED_STATE__", "__REDUX_STATE__", "__NUXT__", "__wovn_initial_data__", "__data__")
# Tags whose content never shows.
NOISE_TAGS = ("script", "style", "noscript", "svg", "path", "iframe", "head", "template")
#: Characters of objects that are handed on together.
NODES_SIZE = 1_000_000
LD_SCRIPT = r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"


def without_noise(html: Column) -> Column:
    """EXT-18: a page without tags that never show, and their content."""
    cut = F.regexp_replace(html, rf"(?is)<({'|'.join(NOISE_TAGS)})\b[^>]*>.*?</\1\s*>", "")
    return F.regexp_replace(cut, r"(?is)<(?:link|meta)\b[^>]*>", "")


def body_text(html: Column) -> Column:
    """The visible text of a page, blanks collapsed."""
    inner = F.regexp_replace(without_noise(html), r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(inner, r"\s+", " "))


def emptiness(html: Column) -> Column:
    """FLT-6: shell (little text and three scripts or more), thin (little text), or null."""
    short = F.length(body_text(html)) < 200
    scripts = F.regexp_count(html, F.lit(r"(?i)<script\b"))
    return F.when(html.isNull(), "thin").when(short & (scripts >= 3), "shell").when(short, "thin")


def _not_json(name: str):
    raise ValueError(name)


def _objects(text: str, wanted: frozenset | None) -> Iterator[tuple[str, str]]:
    """(place, JSON) of every object in a JSON text, in document order and at any depth; nothing for invalid JSON."""
    try:
        open_nodes = [("", json.loads(text, parse_constant=_not_json))]
    except (ValueError, RecursionError):
        return
    while open_nodes:
        place, node = open_nodes.pop()
        if isinstance(node, dict) and (wanted is None or not wanted.isdisjoint(node)):
            yield place, json.dumps(node, ensure_ascii=False)
        children = node.values() if isinstance(node, dict) else node
        open_nodes += [(f"{place}/{i:06d}", x) for i, x in enumerate(children) if isinstance(x, (dict, list))][::-1]


def node_batches(batches: Iterator[pa.RecordBatch], names: list[str], wanted: frozenset | None) -> Iterator[pa.RecordBatch]:
    """The objects of batches of texts (keys, seq, text) under their keys. A batch holds those of many small texts, or a part of those of a large one."""

    def together(batch, at, found):
        of = pa.array(at, pa.int32())
        return pa.RecordBatch.from_arrays([*(column.take(of) for column in batch.columns[:-2]), *(pa.array(c, pa.string()) for c in zip(*found, strict=True))], names)

    for batch in batches:
        found, at, size = [], [], 0
        for i, (seq, text) in enumerate(zip(*batch.columns[-2:], strict=True)):
            seq = seq.as_py()
            for place, node in _objects(text.as_py(), wanted):
                found.append((seq + place, node))
                at.append(i)
                size += len(node)
                if size >= NODES_SIZE:
                    yield together(batch, at, found)
                    found, at, size = [], [], 0
        if found:
            yield together(batch, at, found)


def json_nodes(scripts: DataFrame, keys: list[str], text: str, names=None) -> DataFrame:
    """Every object of JSON texts, however deep: keys, place (in document order) and node.

    Built-in functions open a fixed number of levels only, so a text is parsed and walked once in
    Python. With names, only objects that have one of these keys are returned.
    """
    wanted = None if names is None else frozenset(names)
    rows = scripts.select(*keys, F.lpad(F.col("seq").cast("string"), 4, "0").alias("__seq"), F.col(text).alias("__text")).where("__text IS NOT NULL")
    schema = T.StructType([scripts.schema[k] for k in keys]).add("place", "string").add("__json", "string")

    return rows.mapInArrow(lambda batches: node_batches(batches, schema.names, wanted), schema).select(*keys, "place", F.try_parse_json("__json").alias("node")).where("node IS NOT NULL")


def jsonld_nodes(pages: DataFrame, keys: list[str], names=None) -> DataFrame:
    """EXT-1: every object in the JSON-LD scripts of a page; invalid JSON is skipped."""
    return json_nodes(pages.select(*keys, F.posexplode(F.regexp_extract_all("html", F.lit(LD_SCRIPT), 1)).alias("seq", "script")), keys, "script", names)


def state_nodes(pages: DataFrame, keys: list[str], names=None) -> DataFrame:
    """EXT-6: objects of hydration state, in a script of its own or assigned to a known global."""
    next_data = F.regexp_extract_all("html", F.lit(r'(?is)<script[^>]*id="__NEXT_DATA__"[^>]*>(.*?)</script>'), 1)
    assigned = F.regexp_extract_all("html", F.lit(rf"(?is)window\.(?:{'|'.join(STATE_NAMES)})\s*=\s*(\{{.*?\}})\s*;?\s*</script>"), 1)
    return json_nodes(pages.select(*keys, F.posexplode(F.concat(next_data, assigned)).alias("seq", "script")), keys, "script", names)


def inline_nodes(pages: DataFrame, keys: list[str], names=None) -> DataFrame:
    """EXT-7: objects in other scripts that mention a price: the whole script, or the first object assigned in it."""
    scripts = pages.select(*keys, F.posexplode(F.regexp_extract_all("html", F.lit(r'(?is)<script(?![^>]*(?:ld\+json|__NEXT_DATA__))[^>]*>(.*?)</script>'), 1)).alias("seq", "script")).where(F.lower("script").contains("price"))
    first = F.regexp_extract("script", r"(?s)=\s*(\{.*\})", 1)
    text = F.when(F.try_parse_json("script").isNotNull(), F.col("script")).when(F.length(first) >= 40, first)
    return json_nodes(scripts.withColumn("script", text), keys, "script", names)


def _get(node: Column, path: str) -> Column:
    return F.nullif(F.try_variant_get(node, path, "string"), F.lit(""))


def _values(node: Column, path: str = "$") -> Column:
    """The values of an object as texts by their keys: it is walked once, however many names are then looked up."""
    return F.try_variant_get(node, path, "map<string,string>")


def _first(held: Column, names) -> Column:
    return F.coalesce(*(F.nullif(F.try_element_at(held, F.lit(n)), F.lit("")) for n in names))


def is_product(node: Column) -> Column:
    """FLT-9: has a name of 3 to 300 characters, a price or offers, and a page, stock number or image."""
    offers = F.try_variant_get(node, "$.offers", "variant").isNotNull() | F.try_variant_get(node, "$.offer", "variant").isNotNull() | F.try_variant_get(node, "$.prices", "variant").isNotNull()

    def fits(held: Column) -> Column:
        known = _first(held, (*KEYS["url"], *KEYS["sku"], *KEYS["image"])).isNotNull()
        return F.length(_first(held, KEYS["title"])).between(3, 300) & (_first(held, KEYS["price"]).isNotNull() | offers) & known

    return C.bound(_values(node), fits)


def node_record(node: Column) -> list[Column]:
    """EXT-8: the fields of a product object, whatever its key names; offers and nested brands are looked into.

    The fields are made together, as one generated row, so that no condition on them makes them anew.
    """
    seen = F.struct(
        *(_values(node, path).alias(name) for name, path in {"own": "$", "offers": "$.offers", "first": "$.offers[0]", "offer": "$.offer", "rated": "$.aggregateRating"}.items()),
        (F.try_variant_get(node, "$.price.centAmount", "double") / 100).alias("cents"), _get(node, "$.offers.priceSpecification.price").alias("specified"),
        F.coalesce(_get(node, "$.brand.name"), _get(node, "$.brand[0].name")).alias("brand"), F.coalesce(_get(node, "$.image.url"), _get(node, "$.image[0].url"), _get(node, "$.image[0]")).alias("image"),
    )

    def fields(v: Column) -> Column:
        own = lambda names: _first(v["own"], names)
        offer = lambda names: F.coalesce(*(_first(v[held], names) for held in ("own", "offers", "first", "offer")))
        rated = lambda names: F.coalesce(own(names), _first(v["rated"], names))
        found = {
            "title": own(KEYS["title"]), "price": F.coalesce(v["cents"], C.number(offer(KEYS["price"])), C.number(v["specified"])), "original_price": C.number(offer(KEYS["original_price"])),
            "currency": offer(("priceCurrency", "currency")), "availability": C.bound(offer(("availability",)), C.availability_label), "url": own(KEYS["url"]), "image": F.coalesce(v["image"], own(KEYS["image"])),
            "brand": F.coalesce(v["brand"], own(KEYS["brand"])), "sku": own(KEYS["sku"]), "gtin": own(KEYS["gtin"]), "mpn": own(("mpn",)), "rating": C.number(rated(KEYS["rating"])), "review_count": C.number(rated(KEYS["review_count"])),
        }
        return F.struct(*(c.alias(n) for n, c in found.items()))

    return [F.inline(F.transform(F.array(seen), fields))]


FIELDS = ("title", "price", "original_price", "currency", "availability", "url", "image", "brand", "sku", "gtin", "mpn", "rating", "review_count")


def has_type(node: Column, name: str) -> Column:
    """Whether one of the node's types contains the name, as full addresses and subtypes do."""
    types = F.coalesce(F.try_variant_get(node, "$['@type']", "array<string>"), F.array(F.try_variant_get(node, "$['@type']", "string")))
    return F.exists(types, lambda t: F.contains(F.lower(t), F.lit(name)))


def jsonld_record(pages: DataFrame, keys: list[str]) -> DataFrame:
    """EXT-2: one record for each page with a product node or a node with offers; each field from the first node that has it."""
    nodes = jsonld_nodes(pages, keys, ("@type", "offers")).where(has_type(F.col("node"), "product") | F.try_variant_get("node", "$.offers", "variant").isNotNull())
    records = nodes.select(*keys, "place", *node_record(F.col("node")))
    return records.groupBy(*keys).agg(*(F.min_by(f, F.when(~missing(F.col(f)), F.col("place"))).alias(f) for f in FIELDS))


def jsonld_products(pages: DataFrame, keys: list[str]) -> DataFrame:
    """EXT-5, SET-5: a record for each product node with a title and a price or page; equal titles and pages once, the first."""
    nodes = jsonld_nodes(pages, keys, ("@type",)).where(has_type(F.col("node"), "product"))
    records = nodes.select(*keys, "place", *node_record(F.col("node"))).where("title IS NOT NULL AND (price IS NOT NULL OR url IS NOT NULL)")
    return first_of_equal(records, keys)


def first_of_equal(records: DataFrame, keys: list[str]) -> DataFrame:
    """SET-5: of records with one title (any case) and url on a page, the first."""
    w = Window.partitionBy(*keys, F.lower("title"), F.coalesce("url", F.lit(""))).orderBy("place")
    return records.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def walked_products(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """EXT-6, EXT-7 to records: objects that look like products; nodes may be limited to those with a key of KEYS["title"]."""
    return nodes.where(is_product(F.col("node"))).select(*keys, "place", *node_record(F.col("node")))


def metas(html: Column, names) -> Column:
    """The content of the first meta of one of the names that has any."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)(<meta\b[^>]*>)"), 1)
    # Either kind of quotes: the text between them is the second group.
    named = lambda t: F.regexp_extract(t, r"""(?i)(?:property|name)=(["'])(.*?)\1""", 2)
    value = lambda t: F.trim(F.regexp_extract(t, r"""(?is)content=(["'])(.*?)\1""", 2))
    content = lambda n: F.get(F.filter(F.transform(F.filter(tags, lambda t: named(t) == n), value), lambda x: x != ""), 0)
    return F.coalesce(*map(content, names))


def opengraph_record(pages: DataFrame, keys: list[str]) -> DataFrame:
    """EXT-4: the OpenGraph record of a page."""
    h = F.col("html")
    price = C.number(metas(h, ("product:price:amount", "og:price:amount")))
    return pages.where(h.contains("og:")).select(*keys, metas(h, ("og:title",)).alias("title"), price.alias("price"), metas(h, ("product:price:currency", "og:price:currency")).alias("currency"), C.availability_label(metas(h, ("product:availability", "og:availability"))).alias("availability"), metas(h, ("product:brand", "og:brand")).alias("brand"), metas(h, ("og:image",)).alias("image"), metas(h, ("og:url",)).alias("url"))


def first_source(sources: list[DataFrame], keys: list[str], fields=("title", "price", "currency", "availability", "brand")) -> DataFrame:
    """SET-2: each field from the first source that has it, in the order of the list."""
    ranked = reduce(DataFrame.unionByName, (s.select(*keys, *fields, F.lit(i).alias("rank")) for i, s in enumerate(sources)))
    return ranked.groupBy(*keys).agg(*(F.min_by(f, F.when(~missing(F.col(f)), F.col("rank"))).alias(f) for f in fields))


def strategy_union(strategies: list[DataFrame], keys: list[str], base: Column) -> DataFrame:
    """SET-1: products of several strategies, one for each barcode, page or title; each field from the first strategy that has it."""
    ranked = reduce(DataFrame.unionByName, (s.select(*keys, "place", *FIELDS, F.lit(i).alias("rank")) for i, s in enumerate(strategies)))
    url = F.when(~missing(F.col("url")), C.resolved_url(base, F.col("url")))
    keyed = ranked.withColumn("url", url).where("title IS NOT NULL AND price IS NOT NULL").withColumn("product", F.coalesce(C.gtin("gtin"), F.nullif(F.regexp_replace("url", r"\?.*$", ""), F.lit("")), F.lower("title")))
    order = lambda f: F.when(~missing(F.col(f)), F.struct("rank", "place"))
    return keyed.groupBy(*keys, "product").agg(*(F.min_by(f, order(f)).alias(f) for f in FIELDS))


def fallback_title(html: Column) -> Column:
    """EXT-13: OpenGraph title, Twitter title, first heading, cleaned document title."""
    inner = lambda tag: F.nullif(F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1), r"(?s)<[^>]*>", ""), r"\s+", " ")), F.lit(""))
    return F.coalesce(metas(html, ("og:title", "twitter:title")), inner("h1"), C.document_title(inner("title")))


# Marks of elements that hold a price, in the order tried, and tagged numbers in running text.
PRICE_MARKS = (r'itemprop="price"', r"data-price=", r"data-price-amount=", r'class="[^"]*price', r'class="[^"]*Price', r'class="[^"]*cost', r'class="[^"]*amount', r'class="[^"]*money', r'id="[^"]*price', r'id="[^"]*Price')
_SYMBOL = r"(?:US\$|R\$|A\$|C\$|NZ\$|\$|€|£|¥|₹|₱|₩|₽)"
_NUMBER = r"(?:\d{1,3}(?:[.,]\d{3})+(?:[.,]\d{1,2})?|\d+(?:[.,]\d{1,2})?)"


def fallback_price(html: Column) -> Column:
    """EXT-14: amount and currency from an element that looks like a price, else the first tagged number in the text."""
    codes = "|".join(C.CURRENCY_CODES)
    # One after the other: a page is searched for a mark only if it holds the mark's words and none before gave a number,
    # and its text only at the end.
    value = lambda tag: F.coalesce(*(F.nullif(F.regexp_extract(tag, rf'\s{a}="([^"]*)"', 1), F.lit("")) for a in ("content", "data-price", "data-price-amount", "value")), F.regexp_extract(tag, r"(?s)>([^<]*)$", 1))
    fit = lambda c: F.when(C.number(c) > 0, c)
    marked = lambda mark: F.when(reduce(lambda a, b: a & b, (html.contains(w) for w in mark.split('[^"]*'))), C.bound(F.regexp_extract(html, rf"(?s)(<[^>]*{mark}[^>]*>[^<]*)", 1), lambda tag: C.bound(value(tag), fit)))
    token = F.regexp_extract(body_text(html), rf"({_SYMBOL}\s?{_NUMBER}|(?:{codes})\s?{_NUMBER}|{_NUMBER}\s?(?:{codes}))", 1)
    chosen = F.coalesce(*map(marked, PRICE_MARKS), C.bound(token, fit))
    return C.bound(chosen, lambda c: F.when(c.isNotNull(), C.price(c)))


def fallback_stock(html: Column) -> Column:
    """EXT-15: availability from phrases in the visible text."""
    # Phrases looked for in page text; the first list is tried first.
    out = ("out of stock", "sold out", "unavailable", "currently unavailable", "out-of-stock")
    into = ("in stock", "in-stock", "add to cart", "add to basket", "add to bag", "buy now", "available")
    text = F.lower(body_text(html))
    return F.when(C.contains_any(text, out), "Out of stock").when(C.contains_any(text, into), "In stock")


def fallback_image(html: Column) -> Column:
    """EXT-15: OpenGraph image, Twitter image, first image with a source."""
    return F.coalesce(metas(html, ("og:image", "twitter:image")), F.nullif(F.regexp_extract(html, r'(?is)<img\b[^>]*\ssrc="([^"]*)"', 1), F.lit("")))


def filled_gaps(records: DataFrame, pages: DataFrame, keys: list[str], fields=("title", "price", "availability", "image")) -> DataFrame:
    """EXT-16: requested fields from fallbacks where the record has none, and which source each came from.

    The fallback's currency comes along with its price, where the record names none.
    """
    h = F.col("html")
    price = F.col("__price")
    spare = {"title": fallback_title(h), "price": price["amount"], "availability": fallback_stock(h), "image": fallback_image(h)}
    if "price" in fields:
        pages = pages.withColumn("__price", fallback_price(h))
    else:
        pages = pages.withColumn("__price", F.lit(None).cast("struct<amount:double,currency:string>"))
    found = pages.select(*keys, *(spare[f].alias(f"f_{f}") for f in fields), price["currency"].alias("f_currency"))
    j = found.join(records, keys, "left")
    missed = lambda f: missing(F.col(f)) if f in records.columns else F.lit(True)
    held = lambda f: F.col(f) if f in records.columns else F.lit(None)
    fill = lambda f: F.when(~missed(f), held(f)).otherwise(F.col(f"f_{f}")).alias(f)
    source = lambda f: F.when(~missed(f), "record").when(~missing(F.col(f"f_{f}")), "fallback").otherwise("none")
    out = [fill(f) for f in fields]
    if "price" in fields:
        out.append(F.when(~missed("currency"), held("currency")).when(missed("price") & F.col("f_price").isNotNull(), F.col("f_currency")).alias("currency"))
    return j.select(*keys, *out, F.create_map(*(x for f in fields for x in (F.lit(f), source(f)))).alias("sources"))


# Fields that structured data adds to a record without being asked.
EXTRAS = ("original_price", "currency", "brand", "sku", "gtin", "mpn", "review_count")


def consensus_records(selected: DataFrame, structured: DataFrame, keys: list[str], fields: dict[str, str], required: tuple[str, ...] = ()) -> DataFrame:
    """EXT-12 for whole records, AGG-7: requested fields (name to kind) of selectors and structured data merged.

    Returns keys, the fields, extras that only structured data has, discount_pct, confidences and
    sources by field, confidence (of required fields, or all; the share of filled ones on pages without structured data) and quality.
    """
    known = structured.select(*keys, *(F.col(c).alias(f"t_{c}") for c in structured.columns if c not in keys), F.lit(True).alias("__known"))
    j = selected.join(known, keys, "left")
    blank = F.lit(None).cast("string")
    own = lambda f: F.col(f) if f in selected.columns else blank
    theirs = lambda f: F.col(f"t_{f}") if f in structured.columns else blank
    for f, kind in fields.items():
        j = j.withColumn(f"__{f}", consensus(own(f), theirs(f), kind, f))
    number = lambda f, kind, c: C.number(c) if kind in ("price", "number") else c
    merged = {f: number(f, kind, F.col(f"__{f}.value")) for f, kind in fields.items()}
    extras = {f: F.coalesce(F.nullif(own(f).cast("string"), F.lit("")), F.nullif(theirs(f).cast("string"), F.lit(""))) for f in EXTRAS if f not in fields}
    original = merged["original_price"] if "original_price" in merged else C.number(extras["original_price"])
    off = C.discount_percent(original, merged["price"]) if "price" in merged else F.lit(None).cast("double")
    names = list(required or fields)
    mean = rounded(sum(F.col(f"__{f}.confidence") for f in names) / len(names), 3)
    share = rounded(sum((~missing(own(f))).cast("int") for f in names) / len(names), 3)
    is_known = F.col("__known").isNotNull()
    told = {f: F.when(is_known, F.col(f"__{f}.source")) for f in fields}
    told |= {f: F.when(is_known & missing(own(f)) & ~missing(theirs(f)), "structured") for f in extras}
    sources = F.map_filter(F.create_map(*(x for f, s in told.items() for x in (F.lit(f), s))), lambda _, s: s.isNotNull())
    confidences = F.create_map(*(x for f in fields for x in (F.lit(f), F.col(f"__{f}.confidence"))))
    out = j.select(*keys, *(c.alias(f) for f, c in {**merged, **extras}.items()), off.alias("discount_pct"), F.when(is_known, confidences).alias("confidences"), sources.alias("sources"), F.when(is_known, mean).otherwise(share).alias("confidence"))
    return out.withColumn("quality", C.quality_label(F.col("confidence"), F.col("sources")))


def consensus(value: Column, structured: Column, kind: str, field: str) -> Column:
    """EXT-12: value, confidence and source of a field seen by selectors and in structured data."""
    s, t = value.cast("string"), structured.cast("string")
    has_s, has_t = ~missing(s), ~missing(t)
    numeric = kind in ("price", "number")
    stock_s, stock_t = C.in_stock(s), C.in_stock(t)
    low_s, low_t = F.lower(F.trim(s)), F.lower(F.trim(t))
    words = F.when(stock_s.isNotNull() & stock_t.isNotNull(), stock_s == stock_t).otherwise((low_s == low_t) | F.contains(low_t, low_s) | F.contains(low_s, low_t))
    agree = F.coalesce(F.abs(C.number(s) - C.number(t)) < 0.01, F.lit(False)) if numeric else words
    typed = (lambda x: C.number(x).cast("string")) if numeric else (lambda x: x)
    trusted = typed(t) if numeric or field == "availability" else s
    return F.struct(
        F.when(~has_t, s).when(~has_s, typed(t)).when(agree, s).otherwise(trusted).alias("value"),
        F.when(has_s & has_t, F.when(agree, 1.0).otherwise(0.5)).when(has_s | has_t, 0.7).otherwise(0.0).alias("confidence"),
        F.when(has_s & has_t, "both").when(has_t, "structured").when(has_s, "selector").otherwise("none").alias("source"),
    )


# Page types and url words that name a schema; the first that fits counts.
TYPE_SCHEMAS = {"product": "product", "individualproduct": "product", "productmodel": "product", "offer": "product", "aggregateoffer": "product", "jobposting": "jobs", "realestatelisting": "real_estate", "apartment": "real_estate", "house": "real_estate", "singlefamilyresidence": "real_estate", "residence": "real_estate", "accommodation": "real_estate", "newsarticle": "news", "article": "news", "blogposting": "news", "reportagenewsarticle": "news", "liveblogposting": "news"}
URL_SCHEMAS = (("job", "jobs"), ("career", "jobs"), ("vacanc", "jobs"), ("real-estate", "real_estate"), ("realestate", "real_estate"), ("property", "real_estate"), ("properties", "real_estate"), ("listing", "real_estate"), ("homes", "real_estate"), ("rent", "real_estate"), ("news", "news"), ("article", "news"), ("blog", "news"), ("story", "news"), ("product", "product"))
LIST_HINTS = ("/search", "/category", "/collections", "/shop", "/c/", "/s?", "?q=", "&q=")


def detected_schema(url: Column, html: Column) -> Column:
    """EXT-17: the schema that fits a page: typed data, page type, repeated cards, url words, else product."""
    ld = F.array_join(F.regexp_extract_all(html, F.lit(LD_SCRIPT), 1), " ")
    typed = F.concat(F.transform(F.regexp_extract_all(ld, F.lit(r'"@type"\s*:\s*"([^"]+)"'), 1), lambda t: F.lower(t)), F.transform(F.regexp_extract_all(html, F.lit(r"""itemtype=["'][^"']*[/#]([^"'/#]+)/?["']"""), 1), lambda t: F.lower(t)))
    schema = F.get(F.filter(F.transform(typed, lambda t: reduce(lambda acc, x: acc.when(t == x[0], x[1]), list(TYPE_SCHEMAS.items())[1:], F.when(t == "product", "product"))), lambda s: s.isNotNull()), 0)
    cards = F.greatest(*(F.regexp_count(html, F.lit(p)) for p in (r'itemtype="[^"]*Product"', r'class="(?:[^"]*\s)?product(?:\s[^"]*)?"', r'class="(?:[^"]*\s)?product-item(?:\s[^"]*)?"', r'class="(?:[^"]*\s)?product-card(?:\s[^"]*)?"', r'class="(?:[^"]*\s)?s-result-item(?:\s[^"]*)?"'))) >= 3
    kind = F.lower(metas(html, ("og:type", "product:type")))
    by_kind = F.when(kind.isin("product", "product.item"), "product").when(kind == "article", "news")
    path = F.lower(F.regexp_replace(F.regexp_replace(url, r"^[a-zA-Z][\w+.-]*://[^/?#]*", ""), r"#.*$", ""))
    bare = F.regexp_replace(path, r"\?.*$", "")
    hay = F.when(F.contains(path, F.lit("?")), path).otherwise(F.concat(path, F.lit("?")))
    by_url = F.when(C.contains_any(hay, LIST_HINTS), "product_list")
    for word, name in URL_SCHEMAS:
        by_url = by_url.when(F.contains(bare, F.lit(word)), name)
    return F.coalesce(F.when((schema == "product") & cards, "product_list").otherwise(schema), by_kind, F.when(cards, "product_list"), by_url, F.lit("product"))


def golden_checks(expected: DataFrame, extracted: DataFrame, keys: list[str]) -> DataFrame:
    """JOIN-9: for each expected (keys, field, want), whether the extracted value (got) fits: numbers within 0.01, stock by meaning, text contained."""
    j = expected.join(extracted, [*keys, "field"], "left")
    a, b = C.number("want"), C.number("got")
    stock = C.in_stock("want") == C.in_stock("got")
    text = F.contains(F.lower("got"), F.lower("want")) | F.contains(F.lower("want"), F.lower("got"))
    ok = F.when(F.col("field").isin("price", "original_price", "rating"), F.abs(a - b) < 0.01).when(F.col("field") == "availability", F.coalesce(stock, text)).otherwise(text)
    return j.withColumn("ok", F.coalesce(ok, F.lit(False)))


def accuracy(checks: DataFrame) -> DataFrame:
    """AGG-9: checks, passed and accuracy of golden checks."""
    passed = F.sum(F.col("ok").cast("int"))
    return checks.agg(F.count("*").alias("checks"), passed.alias("passed"), rounded(passed / F.count("*"), 3).alias("accuracy"))


def schema_table(specs: DataFrame) -> DataFrame:
    """UDF-2: one specification for each name: the user's, else the preset, else the built-in one."""
    rank = F.when(F.col("source") == "user", 0).when(F.col("source") == "preset", 1).otherwise(2)
    return specs.withColumn("__n", F.row_number().over(Window.partitionBy("name").orderBy(rank))).where("__n = 1").drop("__n")
