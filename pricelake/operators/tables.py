"""Tables of the monitor: appends, upserts, retention and deletes, and store payloads to rows.

Upserts, retention and deletes come twice: as expressions that give the new table, and applied to tables in
hash buckets (sources/buckets.py), of which a batch rewrites the touched buckets only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelake.functions import columns as C
from pricelake.functions.columns import missing, rounded
from pricelake.sources.buckets import Buckets
from pricelake.sources.scratch import written


def appended_runs(batches: DataFrame, key_field: str) -> tuple[DataFrame, DataFrame]:
    """SRC-1: (runs, records) of batches (site_id, fetched_at, healed, used_llm, confidence, records: array of map), to append (changes.appended).

    A record's key is the text of its key field, null when that is missing.
    """
    runs = batches.select(F.xxhash64("site_id", "fetched_at").alias("run_id"), "site_id", "fetched_at", F.size("records").alias("record_count"), "healed", "used_llm", "confidence", F.to_date("fetched_at").alias("run_date"))
    each = batches.select(F.xxhash64("site_id", "fetched_at").alias("run_id"), "site_id", "fetched_at", F.explode("records").alias("record"))
    return runs, each.select("run_id", "site_id", F.nullif(F.try_element_at("record", F.lit(key_field)), F.lit("")).alias("item_key"), F.to_json("record").alias("data_json"), "fetched_at")


def upserted_sites(old: DataFrame, new: DataFrame, settings: list[str]) -> DataFrame:
    """SRC-2: sites unique by url and schema; settings from the latest arrival, id and creation from the first."""
    both = old.withColumn("__at", F.lit(0)).unionByName(new.withColumn("__at", F.lit(1)))
    return both.groupBy("url", "schema_name").agg(F.min_by("id", "__at").alias("id"), F.min_by("created_at", "__at").alias("created_at"), *(F.max_by(c, "__at").alias(c) for c in settings))


def upsert_sites(sites: Buckets, new: DataFrame, settings: list[str], batch: int) -> list[int]:
    """SRC-2 on a table in buckets of (url, schema_name): returns the buckets rewritten."""
    return sites.rewrite(batch, new, lambda old: upserted_sites(old, new, settings))


def price_points(entries: DataFrame, at: Column) -> DataFrame:
    """SRC-5: entries with a positive price and a product key, all at one time."""
    return entries.where((F.col("price") > 0) & ~missing(F.col("product_key"))).withColumn("seen_at", at)


def exported(watchlist: DataFrame, path: str, kind: str = "json", site=None) -> None:
    """SRC-6: the watchlist, or one site of it, as JSON lines or as CSV with a header."""
    rows = watchlist if site is None else watchlist.where(F.col("id") == site)
    rows.write.csv(path, header=True) if kind == "csv" else rows.write.json(path)


def archived(pages: DataFrame) -> DataFrame:
    """SRC-7: pages (url, schema, html, fetched_at) under their archive key; empty pages are not kept."""
    return pages.where(~missing(F.col("html"))).withColumn("archive_key", F.substring(F.sha1(F.concat_ws("::", "url", "schema").cast("binary")), 1, 16))


def latest_pages(archive: DataFrame) -> DataFrame:
    """SRC-7: the newest page under each key."""
    return archive.groupBy("archive_key", "url", "schema").agg(F.max_by("html", "fetched_at").alias("html"))


def without_sites(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame) -> dict[str, DataFrame]:
    """SRC-9: every table (with its site column) without the rows of deleted sites (id)."""
    return {name: df.join(gone.select(F.col("id").alias(key)), key, "left_anti") for name, (df, key) in tables.items()}


def delete_sites(sites: Buckets, others: dict[str, Buckets], gone: DataFrame, batch: int) -> dict[str, list[int]]:
    """SRC-9 on tables in buckets, the others (of site_id) first: returns the buckets rewritten in each.

    Only buckets that hold rows of a deleted site are rewritten.
    """
    ids = written(gone.select("id").where("id IS NOT NULL").distinct(), "gone")
    done = {}
    for name, held, column in [*((n, t, "site_id") for n, t in others.items()), ("sites", sites, "id")]:
        held.recover()
        named = ids.select(F.col("id").alias(column))
        done[name] = held.rewrite(batch, held.rows().join(named, column, "left_semi").select(*held.key), lambda old, named=named, column=column: old.join(named, column, "left_anti"))
    return done


def with_active(sites: DataFrame, chosen: Column, flag: bool) -> DataFrame:
    """SRC-10: sites paused or resumed."""
    return sites.withColumn("active", F.when(chosen, int(flag)).otherwise(F.col("active")))


def pruned(runs: DataFrame, records: DataFrame, sites: DataFrame, keep: int) -> tuple[DataFrame, DataFrame]:
    """SRC-11: (runs, records) with the newest runs of each site; its retention_runs or keep, all if 0 or less."""
    ranked = _by_age(runs, sites, keep)
    kept = ranked.where("__keep <= 0 OR __n <= __keep").drop("__n", "__keep").select(*runs.columns)
    expired = ranked.where("__keep > 0 AND __n > __keep").select("run_id")
    return kept, records.join(expired, "run_id", "left_anti")


def _by_age(runs: DataFrame, sites: DataFrame, keep: int) -> DataFrame:
    """runs with their place from the newest of their site (__n) and how many of it are kept (__keep)."""
    newest = Window.partitionBy("site_id").orderBy(F.desc("fetched_at"), F.desc("run_id"))
    limits = sites.select(F.col("id").alias("site_id"), C.override(F.col("retention_runs"), keep).alias("__keep"))
    return runs.withColumn("__n", F.row_number().over(newest)).join(limits, "site_id", "left").withColumn("__keep", F.coalesce("__keep", F.lit(keep)))


def prune_runs(runs: Buckets, records: Buckets, sites: DataFrame, keep: int, batch: int) -> tuple[list[int], list[int]]:
    """SRC-11 on tables in buckets of site_id: returns the buckets rewritten in runs and in records.

    Only buckets with an expired run are rewritten. Records go first: a batch that is repeated after a loss
    still finds in the runs which ones expired.
    """
    runs.recover()
    aged = _by_age(runs.rows().select("site_id", "run_id", "fetched_at"), sites, keep)
    expired = written(aged.where("__keep > 0 AND __n > __keep").select("site_id", "run_id"), "expired")
    gone = lambda old: old.join(expired.select("run_id"), "run_id", "left_anti")
    of_records = records.rewrite(batch, expired, gone)
    return runs.rewrite(batch, expired, gone), of_records


def evolved(old: DataFrame, new: DataFrame, defaults: dict) -> DataFrame:
    """SRC-12: rows of an older and a newer layout together, later columns filled with their defaults."""
    both = old.unionByName(new, allowMissingColumns=True)
    return both.select(*(F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in both.columns))


ROW = ("title", "url", "price", "original_price", "currency", "image", "brand", "seller", "in_stock", "rating", "reviews", "sold", "official")


def _row(**found: Column) -> list[Column]:
    kinds = {"price": "double", "original_price": "double", "in_stock": "boolean", "rating": "double", "reviews": "bigint", "sold": "bigint", "official": "boolean"}
    return [found.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in ROW]


def _absolute(url: Column) -> Column:
    return F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).otherwise(url)


def _each(payloads: DataFrame, keys: list[str], schema: str, items: str) -> DataFrame:
    return payloads.select(*keys, F.from_json("payload", schema).alias("p")).select(*keys, F.posexplode(items).alias("place", "x"))


def list_items(payloads: DataFrame, keys: list[str]) -> DataFrame:
    """SRC-13: mods.listItems[]."""
    item = "STRUCT<name: STRING, itemUrl: STRING, productUrl: STRING, itemId: STRING, price: STRING, priceShow: STRING, originalPrice: STRING, image: STRING, brandName: STRING, sellerName: STRING, ratingScore: STRING, review: STRING, itemSoldCntShow: STRING, inStock: BOOLEAN, mallType: STRING, isLazMall: BOOLEAN>"
    x = _each(payloads, keys, f"STRUCT<mods: STRUCT<listItems: ARRAY<{item}>>>", "p.mods.listItems")
    g = lambda n: F.nullif(F.col(f"x.{n}"), F.lit(""))
    url = _absolute(F.coalesce(g("itemUrl"), g("productUrl"), F.concat(F.lit("https://store.test/products/i"), g("itemId"), F.lit(".html"))))
    official = ~missing(F.col("x.mallType")) | F.coalesce(F.col("x.isLazMall"), F.lit(False))
    return x.select(*keys, "place", *_row(title=g("name"), url=url, price=C.loose_float(F.coalesce(g("price"), g("priceShow"))), original_price=C.loose_float("x.originalPrice"), image=g("image"), brand=g("brandName"), seller=g("sellerName"), in_stock=F.col("x.inStock"), rating=rounded(C.loose_float("x.ratingScore"), 1), reviews=C.human_count("x.review"), sold=C.human_count("x.itemSoldCntShow"), official=official)).where("title IS NOT NULL")


def micro_units(payloads: DataFrame, keys: list[str]) -> DataFrame:
    """SRC-14: items[].item_basic (or the item itself) with prices in hundred thousandths."""
    basic = "name: STRING, price: BIGINT, price_before_discount: BIGINT, itemid: STRING, shopid: STRING, image: STRING, brand: STRING, stock: BIGINT, historical_sold: BIGINT, cmt_count: BIGINT, item_rating: STRUCT<rating_star: DOUBLE>, is_official_shop: BOOLEAN"
    x = _each(payloads, keys, f"STRUCT<items: ARRAY<STRUCT<item_basic: STRUCT<{basic}>, {basic}>>>", "p.items")
    g = lambda n: F.coalesce(F.col(f"x.item_basic.{n}"), F.col(f"x.{n}"))
    url = F.concat(F.lit("https://store.test/product/"), g("shopid"), F.lit("/"), g("itemid"))
    rows = x.select(*keys, "place", *_row(title=F.nullif(g("name"), F.lit("")), url=url, price=g("price") / 100000, original_price=F.when(g("price_before_discount") > 0, g("price_before_discount") / 100000), image=g("image"), brand=g("brand"), in_stock=g("stock") > 0, rating=rounded(g("item_rating.rating_star"), 1), reviews=g("cmt_count"), sold=g("historical_sold"), official=g("is_official_shop")))
    return rows.where("title IS NOT NULL AND price IS NOT NULL")


def suggestions(payloads: DataFrame, keys: list[str], domain: Column) -> DataFrame:
    """SRC-15: resources.results.products[]; a price counts only if its text has a decimal mark."""
    x = _each(payloads, keys, "STRUCT<resources: STRUCT<results: STRUCT<products: ARRAY<STRUCT<title: STRING, url: STRING, price: STRING, vendor: STRING, image: STRING, available: BOOLEAN>>>>>", "p.resources.results.products")
    url = F.when(F.col("x.url").startswith("/"), F.concat(F.lit("https://"), domain, F.col("x.url"))).otherwise(_absolute(F.col("x.url")))
    return x.select(*keys, "place", *_row(title=F.nullif(F.col("x.title"), F.lit("")), url=url, price=F.when(F.col("x.price").rlike("[.,]"), C.number("x.price")), image=F.col("x.image"), seller=F.col("x.vendor"), in_stock=F.col("x.available"))).where("title IS NOT NULL")


def minor_units(payloads: DataFrame, keys: list[str], currency: Column) -> DataFrame:
    """SRC-16: [] with prices.price in units of 10 ^ -currency_minor_unit."""
    x = _each(payloads, keys, "ARRAY<STRUCT<name: STRING, permalink: STRING, prices: STRUCT<price: STRING, regular_price: STRING, currency_code: STRING, currency_minor_unit: INT>, images: ARRAY<STRUCT<src: STRING>>, is_in_stock: BOOLEAN, average_rating: STRING, review_count: BIGINT>>", "p")
    unit = F.pow(F.lit(10.0), F.coalesce(F.nullif(F.col("x.prices.currency_minor_unit"), F.lit(0)), F.lit(2)))
    amount = lambda n: F.col(f"x.prices.{n}").try_cast("double") / unit
    return x.select(*keys, "place", *_row(title=F.nullif(F.col("x.name"), F.lit("")), url=F.col("x.permalink"), price=amount("price"), original_price=amount("regular_price"), currency=F.coalesce(F.nullif(F.col("x.prices.currency_code"), F.lit("")), currency), image=F.try_element_at("x.images", F.lit(1))["src"], in_stock=F.col("x.is_in_stock"), rating=C.loose_float("x.average_rating"), reviews=F.col("x.review_count"))).where("title IS NOT NULL")


def first_platform(platforms: list[DataFrame], keys: list[str]) -> DataFrame:
    """SRC-17: for each key, the rows of the first platform that has any."""
    ranked = reduce(DataFrame.unionByName, (p.withColumn("__rank", F.lit(i)) for i, p in enumerate(platforms)))
    return ranked.withColumn("__first", F.min("__rank").over(Window.partitionBy(*keys))).where("__rank = __first").drop("__rank", "__first")
