"""Small cases with known answers."""

import difflib

import pytest
from pyspark.sql import functions as F

from pricelake.functions import columns as C
from pricelake.operators import changes as G
from pricelake.operators import identity as N
from pricelake.operators import pages as X
from pricelake.operators import series as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "value"), [("$1,299.00", 1299.0), ("1.299,00 €", 1299.0), ("19,99", 19.99), ("1.299.000", 1299000.0), ("1.299", 1.299), ("out of stock", None), ("-5.", -5.0), (None, None)])
def test_number(spark, text, value):
    assert one(spark, C.number(F.lit(text).cast("string"))) == value


@pytest.mark.parametrize(("text", "code"), [("US$ 5", "USD"), ("R$ 5", "BRL"), ("5 €", "EUR"), ("5 gbp", "GBP"), ("5 xgbp", None)])
def test_currency(spark, text, code):
    assert one(spark, C.currency(F.lit(text))) == code


@pytest.mark.parametrize(("text", "stock"), [("In Stock", True), ("currently unavailable", False), ("see store", None), ("", None), (None, None)])
def test_in_stock(spark, text, stock):
    assert one(spark, C.in_stock(F.lit(text).cast("string"))) is stock


@pytest.mark.parametrize(("text", "n"), [("1.2k sold", 1200), ("3,455", 3455), ("2m", 2000000), ("none", None)])
def test_human_count(spark, text, n):
    assert one(spark, C.human_count(F.lit(text))) == n


def test_identity_keys(spark):
    assert one(spark, C.product_key(F.lit("Logitech G502 Hero"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"))) == "bm:logitech:g502"
    assert one(spark, C.product_key(F.lit("Desk lamp 60HE"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"))) == "t:desk lamp 60 he"
    assert one(spark, C.gtin(F.lit("590-1234123457"))) == "5901234123457"


def test_query_variants(spark):
    assert one(spark, C.query_variants(F.lit("Wooting 60HE"))) == ["Wooting 60HE", "wooting 60 he", "Wooting60HE", "Wooting 60HEs", "Wooting", "60HE"]


def test_document_title(spark):
    assert one(spark, C.document_title(F.lit("Shop | A very long product | Sale"))) == "A very long product"


def series(spark, values):
    return spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(values)], "k int, t int, v double")


def test_insights_and_scores(spark):
    r = S.price_insights(series(spark, [30, 20, 25]), "v", "k", ["t"]).first()
    assert (r["count"], r["low"], r["high"], r["current"], r["is_all_time_low"]) == (3, 20, 30, 25, False)
    assert S.deal_scores(series(spark, [100, 100, 80]), "v", "k", ["t"]).first()["deal_score"] == 100


@pytest.mark.parametrize(("values", "flag"), [([100, 101, 99, 100, 102, 98, 500], True), ([100, 101, 99, 100, 102, 98, 103], False), ([100] * 6 + [160], True), ([100] * 6 + [101], False), ([1, 2], False)])
def test_outliers(spark, values, flag):
    rows = S.outliers(series(spark, values), "v", "k", ["t"]).orderBy("t").collect()
    assert rows[-1]["outlier"] is flag


def test_availability(spark):
    df = spark.createDataFrame([(1, 0, "In stock"), (1, 1, "sold out"), (1, 2, "see store"), (1, 3, "in stock")], "k int, t int, a string")
    r = S.availability_stats(df, "a", "k", ["t"]).first()
    assert (r["samples"], r["restocks"], r["in_stock"]) == (3, 1, True)


@pytest.mark.parametrize(("old", "new", "kept"), [("100", "5000", False), ("100", "2", False), ("100", "95", True), ("0", "5", True), ("100", "-1", False)])
def test_plausible(spark, old, new, kept):
    df = spark.createDataFrame([("price", old, new)], "field string, old_value string, new_value string")
    assert (G.plausible(df).count() == 1) is kept


def test_diff_duplicates_and_missing_keys(spark):
    schema = "k string, price double, t int"
    old = spark.createDataFrame([("a", 1.0, 0), ("a", 2.0, 1), ("b", 1.0, 0), (None, 9.0, 0)], schema)
    new = spark.createDataFrame([("a", 2.0, 0), ("c", 1.0, 0), (None, 8.0, 0)], schema)
    found = {(r["k"], r["field"]) for r in G.diff(old, new, ["k"], ["price"], ["t"], "k").collect()}
    assert found == {("b", "_removed_item"), ("c", "_new_item")}


def test_sequence_ratio(spark):
    pairs = [("abcd", "bcde"), ("", "x"), ("same", "same")]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", N.sequence_ratio("a", "b").alias("r")).collect()
    assert all(r["r"] == difflib.SequenceMatcher(None, r["a"], r["b"]).ratio() for r in rows)


def same(spark, a, b):
    rows = spark.createDataFrame([(i, *(x.get(c) for c in ("title", "sku", "gtin", "brand"))) for i, x in enumerate((a, b))], "id int, title string, sku string, gtin string, brand string")
    left, right = (rows.where(f"id = {i}").select(*N.identity_columns(p)) for i, p in enumerate("ab"))
    return left.crossJoin(right).select(N.same_product("a", "b").alias("x")).first()["x"]


def test_same_product(spark):
    assert same(spark, {"title": "Logitech G502"}, {"title": "logitech g502 hero"})
    assert not same(spark, {"title": "Logitech G502"}, {"title": "Razer G502"})
    assert not same(spark, {"title": "mouse G502"}, {"title": "mouse M502"})
    assert same(spark, {"title": "x", "gtin": "12345678"}, {"title": "y", "gtin": "1234-5678"})


def test_consensus_trusts_structured_numbers(spark):
    r = one(spark, X.consensus(F.lit("$219"), F.lit("199"), "price", "price"))
    assert (float(r["value"]), r["confidence"], r["source"]) == (199.0, 0.5, "both")


def test_blocked_and_detected(spark):
    assert one(spark, C.blocked(F.lit(403), F.lit(""))) == "http 403"
    assert one(spark, C.blocked(F.lit(200), F.lit("<p>Just a moment</p>"))) == "anti-bot challenge"
    assert one(spark, X.detected_schema(F.lit("https://x.test/jobs/1"), F.lit("<p></p>"))) == "jobs"
    assert one(spark, X.detected_schema(F.lit("https://x.test/a"), F.lit('<meta property="og:type" content="article">'))) == "news"


def test_running_medians():
    import random
    import statistics

    from pricelake.functions.running import Past

    for seed in range(60):
        rng = random.Random(seed)
        keep = rng.choice([None, 1, 2, 5, 9])
        past, values = Past(keep), []
        for _ in range(40):
            values.append(rng.choice([rng.random(), float(rng.randint(0, 4))]))
            past.add(values[-1])
            last = values[-keep:] if keep else values
            middle = statistics.median(last)
            assert past.sorted == sorted(last) and abs(past.median() - middle) < 1e-12
            assert abs(past.deviation(past.median()) - statistics.median(abs(v - past.median()) for v in last)) < 1e-12
