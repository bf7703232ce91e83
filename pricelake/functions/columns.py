"""Column expressions for messy product data. Every function takes and returns columns.

A value counts as missing when it is null or the empty string. Decimal places are cut by
``floor(x * 10^k + 0.5) / 10^k``, which every engine computes alike.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Currency symbols in the order in which they are tried, and the codes known by name.
CURRENCY_SYMBOLS = (("US$", "USD"), ("R$", "BRL"), ("A$", "AUD"), ("C$", "CAD"), ("NZ$", "NZD"), ("$", "USD"), ("€", "EUR"), ("£", "GBP"), ("¥", "JPY"), ("₹", "INR"), ("₱", "PHP"), ("₩", "KRW"), ("₽", "RUB"))
CURRENCY_CODES = ("USD", "EUR", "GBP", "JPY", "INR", "PHP", "BRL", "AUD", "CAD", "CNY", "KRW", "RUB", "NZD", "CHF", "SEK", "MXN", "SGD", "HKD")
# Units of each currency for one US dollar.
RATES = {"USD": 1.0, "EUR": 0.92, "GBP": 0.79, "JPY": 156.0, "INR": 83.3, "PHP": 58.5, "BRL": 5.4, "AUD": 1.51, "CAD": 1.36, "CNY": 7.24, "KRW": 1370.0, "RUB": 90.0, "NZD": 1.65, "CHF": 0.89, "SEK": 10.6, "MXN": 18.5, "SGD": 1.35, "HKD": 7.81, "MYR": 4.7, "IDR": 16000.0, "THB": 36.5, "VND": 25400.0, "TWD": 32.3, "AED": 3.67}
# Phrases that tell whether something is in stock; the first list is tried first.
OUT_OF_STOCK = ("out of stock", "out-of-stock", "sold out", "unavailable", "backorder")
IN_STOCK = ("in stock", "in-stock", "in_stock", "instock", "available", "add to cart")
# Brands recognised in titles, and words that are never model names.
BRANDS = ("logitech", "razer", "steelseries", "asus", "acer", "lenovo", "hp", "dell", "msi", "gigabyte", "corsair", "hyperx", "cooler", "nzxt", "intel", "amd", "nvidia", "samsung", "apple", "sony", "lg", "xiaomi", "redragon", "keychron", "akko", "royal", "glorious", "pulsar", "nike", "adidas", "canon", "nikon", "bosch", "makita", "anker", "baseus", "ugreen", "seagate", "wd", "kingston", "adata", "crucial", "tplink", "dlink", "epson", "brother", "lexar", "sandisk")
STOPWORDS = ("the", "and", "for", "with", "pro", "plus", "max", "mini", "new", "set", "wireless", "wired", "gaming", "mouse", "keyboard", "headset", "black", "white", "rgb", "edition", "version", "official", "brand", "original")
# Separators between a product's name and its shop in page titles, in the order tried.
TITLE_SEPARATORS = (" | ", " – ", " — ", " - ", " :: ", " • ")
# Fixed value: titles that belong to a search page rather than to a product.
JUNK_TITLE = r"(?i)^(results?|search results?|showing|no results|did you mean|sponsored|related searches|filters?|sort by|categories?|see all|view all|best sellers?|recommended|you may also|price|shop by)\b|results? for\b|search results?\b|view all\b|\bads? in\b|\ball listings\b|\bbrowse\b|for sale in\b|doesn't (?:seem to )?exist|page not found|\bnot found\b|\b404\b"


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rounded(x: Column, places: int) -> Column:
    return F.floor(x * 10**places + 0.5) / 10**places


def missing(c: Column) -> Column:
    return c.isNull() | (c.cast("string") == "")


def contains_any(text: Column, phrases) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(p)) for p in phrases))


def bound(value: Column, f) -> Column:
    """f(value) with the value computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), 0)


def number(text: Column | str) -> Column:
    """COL-1: the first number of a text, whatever its separators."""
    raw = F.regexp_replace(F.regexp_extract(as_column(text).cast("string"), r"[-+]?\d[\d.,]*", 0), r"[.,]+$", "")

    def clean(raw: Column) -> Column:
        no_dots, no_commas = F.replace(raw, F.lit("."), F.lit("")), F.replace(raw, F.lit(","), F.lit(""))
        comma, dot = F.contains(raw, F.lit(",")), F.contains(raw, F.lit("."))
        decimal_comma = F.replace(no_dots, F.lit(","), F.lit("."))
        plain = (
            F.when(comma & dot, F.when(raw.rlike(r",[^.]*$"), decimal_comma).otherwise(no_commas))
            .when(comma, F.when(raw.rlike(r"^[^,]*,\d{1,2}$"), decimal_comma).otherwise(no_commas))
            .when(raw.rlike(r"\..*\."), no_dots)
            .otherwise(raw)
        )
        return plain.try_cast("double")

    return bound(raw, clean)


def currency(text: Column | str) -> Column:
    """COL-2: the first symbol of the list that stands in the text, else the first known code."""

    def find(t: Column) -> Column:
        tests = [(F.contains(t, F.lit(s)), code) for s, code in CURRENCY_SYMBOLS] + [(F.upper(t).rlike(rf"\b{c}\b"), c) for c in CURRENCY_CODES]
        return reduce(lambda out, x: out.when(*x), tests[1:], F.when(*tests[0]))

    return bound(as_column(text).cast("string"), find)


def price(text: Column | str) -> Column:
    """COL-3: struct of amount and currency."""
    return F.struct(number(text).alias("amount"), currency(text).alias("currency"))


def discount_percent(original: Column, current: Column) -> Column:
    """COL-4: percent off, null unless the original is positive and above the current price."""
    o, c = as_column(original), as_column(current)
    return F.when((o > 0) & (c < o), rounded((o - c) / o * 100, 1))


def in_stock(text: Column | str) -> Column:
    """COL-5: true, false, or null where the text does not tell."""
    t = F.lower(F.trim(as_column(text).cast("string")))
    return F.when(contains_any(t, OUT_OF_STOCK), False).when(contains_any(t, IN_STOCK), True)


def availability_label(text: Column | str) -> Column:
    """COL-6: one of six labels, otherwise the text itself; null when missing."""
    t = as_column(text)
    low = F.lower(t)
    has = lambda *p: contains_any(low, p)
    label = (
        F.when(has("outofstock", "out of stock", "soldout"), "Out of stock")
        .when(has("discontinued"), "Discontinued")
        .when(has("preorder", "pre-order"), "Pre-order")
        .when(has("backorder", "back order"), "Backorder")
        .when(has("limitedavailability"), "Limited availability")
        .when(has("instock", "in stock", "onlineonly"), "In stock")
        .otherwise(t)
    )
    return F.when(~missing(t), label)


def content_hash(html: Column | str) -> Column:
    """COL-7: SHA-256 of a page, null when empty."""
    h = as_column(html)
    return F.when(h != "", F.sha2(h, 256))


def canonical_url(url: Column | str) -> Column:
    """COL-8: without query and fragment, and without slashes at the end of the path."""
    bare = F.regexp_replace(as_column(url), r"[?#].*$", "")
    parts = lambda i: F.regexp_extract(bare, r"^([a-zA-Z][\w+.-]*://[^/]*)?(.*)$", i)
    return F.coalesce(F.concat(parts(1), F.regexp_replace(parts(2), "/+$", "")), F.lit(""))


def resolved_url(base: Column, ref: Column) -> Column:
    """COL-9: ref made absolute against base; dot segments are not resolved."""
    b, r = as_column(base), as_column(ref)
    scheme = F.regexp_extract(b, r"^([a-zA-Z][\w+.-]*):", 1)
    root = F.regexp_extract(b, r"^([a-zA-Z][\w+.-]*://[^/?#]*)", 1)
    page = F.regexp_replace(b, r"[?#].*$", "")
    folder = F.when(page.rlike(r"^[a-zA-Z][\w+.-]*://[^/]*$"), F.concat(page, F.lit("/"))).otherwise(F.regexp_replace(page, r"[^/]*$", ""))
    return (
        F.when(missing(r), b)
        .when(r.rlike(r"^[a-zA-Z][\w+.-]*:"), r)
        .when(r.startswith("//"), F.concat(scheme, F.lit(":"), r))
        .when(r.startswith("/"), F.concat(root, r))
        .when(r.startswith("?"), F.concat(page, r))
        .when(r.startswith("#"), F.concat(F.regexp_replace(b, r"#.*$", ""), r))
        .otherwise(F.concat(folder, r))
    )


def host_key(url: Column, schema: Column) -> Column:
    """COL-10: network location and schema."""
    return F.concat_ws("::", F.regexp_extract(as_column(url), r"^[a-zA-Z][\w+.-]*://([^/?#]*)", 1), as_column(schema))


def override(value: Column, default) -> Column:
    """COL-11: a site's own setting, else the global one."""
    return F.coalesce(as_column(value), F.lit(default))


def clean_title(title: Column | str) -> Column:
    """COL-12: without blanks and quotes around it."""
    return F.trim(F.regexp_replace(F.trim(as_column(title)), "^[\"'“”]+|[\"'“”]+$", ""))


def normal_title(title: Column | str) -> Column:
    """COL-13: lower case, letters and digits parted, blanks collapsed."""
    parted = F.regexp_replace(F.lower(F.trim(as_column(title))), r"(?<=[a-z])(?=\d)|(?<=\d)(?=[a-z])", " ")
    return F.regexp_replace(parted, r"\s+", " ")


def loose_float(text: Column | str) -> Column:
    """COL-14: the first run of digits, commas dropped."""
    return F.replace(F.regexp_extract(as_column(text).cast("string"), r"\d[\d,]*(?:\.\d+)?", 0), F.lit(","), F.lit("")).try_cast("double")


def human_count(text: Column | str) -> Column:
    """COL-15: 1.2k is 1200, 3,455 is 3455."""
    t = F.lower(as_column(text).cast("string"))
    value = F.replace(F.regexp_extract(t, r"(\d[\d,]*(?:\.\d+)?)\s*([km]?)", 1), F.lit(","), F.lit("")).try_cast("double")
    unit = F.regexp_extract(t, r"(\d[\d,]*(?:\.\d+)?)\s*([km]?)", 2)
    return (value * F.when(unit == "k", 1000).when(unit == "m", 1000000).otherwise(1) + 1e-6).cast("long")


def discount_text(text: Column | str) -> Column:
    """COL-16: -13% is 13."""
    return F.abs(F.regexp_extract(as_column(text).cast("string"), r"-?\d+", 0).try_cast("int"))


def gtin(code: Column | str) -> Column:
    """COL-17: digits of a barcode of a usual length."""
    digits = F.regexp_replace(as_column(code).cast("string"), r"\D", "")
    return F.when(F.length(digits).isin(8, 12, 13, 14), digits)


def brand(title: Column | str, explicit: Column | None = None) -> Column:
    """COL-18: the explicit brand, else the first known brand in the title."""
    known = F.get(F.filter(F.split(F.lower(F.coalesce(as_column(title), F.lit(""))), r"\W+"), lambda w: w.isin(*BRANDS)), 0)
    return known if explicit is None else F.coalesce(F.nullif(F.lower(F.trim(as_column(explicit))), F.lit("")), known)


def model_tokens(title: Column | str) -> Column:
    """COL-19: distinct tokens of letters and digits that hold a digit."""
    tokens = F.split(F.lower(F.coalesce(as_column(title), F.lit(""))), r"[^a-z0-9]+")
    return F.array_distinct(F.filter(tokens, lambda w: w.rlike(r"\d") & ~w.isin(*STOPWORDS)))


def strong_key(title: Column, code: Column, sku: Column, explicit: Column) -> Column:
    """COL-20: barcode, else brand and stock number, else null."""
    b = brand(title, explicit)
    return F.coalesce(F.concat(F.lit("gtin:"), gtin(code)), F.when(~missing(as_column(sku)), F.concat(F.lit("sku:"), b, F.lit(":"), F.lower(F.trim(as_column(sku))))))


def product_key(title: Column, code: Column, sku: Column, explicit: Column) -> Column:
    """COL-21: strong key, else brand and model tokens, else the normal title."""
    models = F.sort_array(model_tokens(title))
    by_model = F.when(F.size(models) > 0, F.concat(F.lit("bm:"), brand(title, explicit), F.lit(":"), F.array_join(models, "-")))
    return F.coalesce(strong_key(title, code, sku, explicit), by_model, F.concat(F.lit("t:"), normal_title(title)))


def query_variants(query: Column | str) -> Column:
    """COL-22: variants of a query in the order in which they are tried, each once whatever its case."""
    q = F.trim(as_column(query))
    words = F.split(q, r"\s+")
    plural = F.when(F.lower(q).endswith("s"), F.substr(q, F.lit(1), F.length(q) - 1)).otherwise(F.concat(q, F.lit("s")))
    several = F.size(words) > 1
    last = F.when(several, F.array_join(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), " "))
    first = F.when(several, F.array_join(F.slice(words, F.lit(2), F.size(words)), " "))
    every = F.filter(F.array(q, normal_title(q), F.regexp_replace(q, r"\s+", ""), plural, last, first), lambda v: v.isNotNull() & (F.trim(v) != ""))
    keep = lambda acc, v: F.when(F.exists(acc, lambda x: F.lower(x) == F.lower(v)), acc).otherwise(F.array_append(acc, v))
    return F.aggregate(F.transform(every, lambda v: F.trim(v)), F.array().cast("array<string>"), keep)


def watch_status(current: Column, stock: Column, previous: Column, target: Column) -> Column:
    """COL-23: one line on a watched price."""
    return (
        F.when(~stock, "out of stock")
        .when(current <= target, "target hit")
        .when(current < previous, "price dropped")
        .when(current > previous, "price rose")
        .when(stock, "in stock")
        .otherwise("watching")
    )


def quality_label(confidence: Column, sources: Column) -> Column:
    """COL-24: how far a run's values can be trusted; sources maps fields to where their values came from."""
    backed = F.exists(F.map_values(sources), lambda s: s.isin("structured", "both"))
    return F.when(confidence >= 0.85, F.when(backed, "verified").otherwise("high")).when(confidence >= 0.5, "inferred").otherwise("low")


def drop_fraction(old: Column, new: Column) -> Column:
    """COL-25: 0.1 is ten percent cheaper; null unless both are numbers and the old one is positive."""
    o, n = old.try_cast("double"), new.try_cast("double")
    return F.when(o > 0, (o - n) / o)


def _percent(x: Column) -> Column:
    tenths = F.floor(F.abs(x) * 1000 + 0.5).cast("long")
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("%"))


def change_text(item: Column, field: Column, old: Column, new: Column) -> Column:
    """COL-26: the line of an alert."""
    drop = drop_fraction(old, new)
    prefix = F.when((field == "price") & drop.isNotNull(), F.concat(F.lit("price "), F.when(drop > 0, "dropped").otherwise("rose"), F.lit(" "), _percent(drop), F.lit(" — "))).otherwise(F.lit(""))
    show = lambda v: F.coalesce(v, F.lit("None"))
    return (
        F.when(field == "_new_item", F.concat(F.lit("NEW item: "), show(new)))
        .when(field == "_removed_item", F.concat(F.lit("REMOVED item: "), show(old)))
        .otherwise(F.concat(prefix, F.substring(item, 1, 48), F.lit(" "), field, F.lit(": "), show(old), F.lit(" -> "), show(new)))
    )


def highlight(item: Column, field: Column, old: Column, new: Column) -> Column:
    """COL-27: the line of a digest."""
    name = F.substring(F.coalesce(item, F.lit("")), 1, 44)
    o, n = old.try_cast("double"), new.try_cast("double")
    share = F.when(o != 0, (o - n) / o).otherwise(F.lit(0.0))
    line = lambda *p: F.concat(name, *(F.lit(x) if isinstance(x, str) else x for x in p))
    return (
        F.when((field == "price") & o.isNotNull() & n.isNotNull(), line(" price ", F.when(n < o, "down").otherwise("up"), " ", _percent(share), " (", old, " -> ", new, ")"))
        .when((field == "availability") & in_stock(new), line(" back in stock"))
        .when((field == "availability") & ~in_stock(new), line(" out of stock"))
        .when(field == "_new_item", F.concat(F.lit("new item: "), new))
        .when(field == "_removed_item", F.concat(F.lit("removed item: "), old))
        .otherwise(line(" ", field, ": ", F.coalesce(old, F.lit("None")), " -> ", F.coalesce(new, F.lit("None"))))
    )


def dedup_key(site: Column, field: Column, item: Column) -> Column:
    """COL-28: what makes two alerts the same."""
    return F.concat_ws("|", site.cast("string"), field, F.coalesce(item.cast("string"), F.lit("")))


def document_title(title: Column | str) -> Column:
    """COL-29: the longest part of a page title around the first separator that stands in it."""
    t = as_column(title)
    out = F.trim(t)
    for sep in reversed(TITLE_SEPARATORS):
        pieces = F.filter(F.transform(F.split(t, "\\Q" + sep + "\\E"), lambda v: F.trim(v)), lambda p: p != "")
        longest = F.array_max(F.transform(pieces, lambda p, i: F.struct(F.length(p).alias("n"), (-i).alias("at"), p.alias("p"))))["p"]
        out = F.when(F.contains(t, F.lit(sep)) & (F.size(pieces) > 0), longest).otherwise(out)
    return out


def junk_title(title: Column | str) -> Column:
    """FLT-7: missing, too short, or a heading of a search page."""
    t = clean_title(title)
    return F.coalesce(missing(as_column(title)) | (F.length(t) < 3) | t.rlike(JUNK_TITLE), F.lit(True))


def links_to_product(url: Column, search_url: Column) -> Column:
    """FLT-8: the listing leads to a page other than the search page."""
    bare = lambda u: F.regexp_replace(u, r"#.*$", "")
    return ~missing(as_column(url)) & (missing(as_column(search_url)) | (bare(resolved_url(search_url, url)) != bare(as_column(search_url))))


def blocked(status: Column, html: Column) -> Column:
    """FLT-5: why a page counts as blocked, null if it does not."""
    # Statuses and marks of pages that keep robots out.
    marks = ("captcha", "cloudflare", "attention required", "access denied", "verify you are human", "cf-browser-verification", "just a moment")
    return F.when(status.isin(401, 403, 429, 503), F.concat(F.lit("http "), status.cast("string"))).when(contains_any(F.lower(F.substring(F.coalesce(html, F.lit("")), 1, 5000)), marks), "anti-bot challenge")


def converted(amount: Column, rate_from: Column, rate_to: Column, same: Column) -> Column:
    """JOIN-1: an amount in another currency, null without rates."""
    return F.when(same & amount.isNotNull(), amount).otherwise(rounded(amount / rate_from * rate_to, 4))
