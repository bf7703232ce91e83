"""Medians of large keys, history before a day, watchlists and throttles against plain loops."""

import datetime
import random
import statistics

import pytest
from pyspark.sql import functions as F

from pricelake.operators import series as S
from pricelake.sources.scratch import numbered


def cents(x):
    return None if x is None else int(x * 100 + 0.5) / 100


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else rng.choice(["a", "b", None]), i, rng.choice([rng.randint(1, 9) * 1.0, round(rng.random() * 50, 2), None])) for i in range(600)]
    return spark.createDataFrame(rows, "k string, t int, v double").repartition(5), rows


@pytest.mark.parametrize("held", [0, 5, 150, 10**6])
def test_medians_whatever_a_key_holds(points, held):
    df, rows = points
    keys = {r[0] for r in rows}
    values = {k: [v for x, _, v in rows if x == k and v is not None] for k in keys}
    got = {r["k"]: (r["count"], r["median"]) for r in S.history_stats(df.where("v IS NOT NULL"), "v", "k", held=held).collect()}
    assert got == {k: (len(v), cents(statistics.median(v))) for k, v in values.items()}
    summary = {r["k"]: r["median"] for r in S.price_summary(df, "v", "k", held=held).collect()}
    assert summary == {k: m for k, (_, m) in got.items()}
    below = {(r["k"], r["t"]): r["deal_pct"] for r in S.deal_percent(df, "v", "k", held=held).collect()}
    assert len(below) == len(rows)
    for k, t, v in rows:
        m = statistics.median(values[k])
        assert below[k, t] is None if v is None else abs(below[k, t] - (m - v) / m * 100) < 0.0501


def test_large_keys_only(points):
    df, _ = points
    assert [r["k"] for r in S.large_medians(df, "v", ["k"], 150).collect()] == ["hot"]
    assert S.large_medians(df, "v", ["k"], 10**6) is None


def test_numbers_of_rows_over_many_tasks(points):
    df, rows = points
    got = {r["t"]: r["n"] for r in numbered(df, ["k"], [F.col("v").desc_nulls_last(), "t"], "n").collect()}
    order = sorted(rows, key=lambda r: (str(r[0]), -(r[2] if r[2] is not None else -1.0), r[1]))
    seen: dict = {}
    assert got == {r[1]: seen.setdefault(r[0], []).append(1) or len(seen[r[0]]) for r in order}


def test_history_before_each_day(spark):
    rng = random.Random(4)
    day = lambda n: datetime.date(2024, 1, 1) + datetime.timedelta(days=n)
    rows = [(rng.choice(["a", "b"]), rng.randint(0, 40), rng.choice([None, rng.randint(100, 900) / 100])) for _ in range(150)]
    points = spark.createDataFrame([(k, day(n), v) for k, n, v in rows], "k string, d date, v double")
    hits = [(k, n) for k in ("a", "b", "c") for n in (0, 5, 5, 20, 41, 60)]
    got = S.recent_history(spark.createDataFrame([(i, k, day(n)) for i, (k, n) in enumerate(hits)], "i int, k string, d date"), points, "k", "d", "v", 7)
    for r in got.collect():
        k, n = hits[r["i"]]
        past = [v for x, m, v in rows if x == k and v is not None and n - 7 <= m < n]
        assert (r["hist_count"] or 0) == len(past)
        assert r["hist_low"] == (min(past) if past else None)
        assert r["hist_avg"] == (cents(round(sum(past) / len(past), 6)) if past else None)


def test_watchlist_follows_the_current_item(spark):
    """The site's other item does not enter the statistics; sites without runs and runs without records stay."""
    sites = spark.createDataFrame([(1, "u1", 15.0), (2, "u2", None), (3, "u3", None)], "id int, url string, target_price double")
    runs = spark.createDataFrame([(1, 10, 1, 0.9, '{"price": "both"}'), (1, 11, 2, 0.6, '{"price": "selector"}'), (2, 12, 5, 0.2, "not json")], "site_id int, run_id int, fetched_at int, confidence double, field_sources string")
    records = spark.createDataFrame([(1, 10, 0, "other", "Other", 100.0, "USD", "In stock"), (1, 11, 1, "other", "Other", 90.0, "USD", "In stock"), (1, 11, 0, "mine", None, 20.0, "EUR", "In stock")], "site_id int, run_id int, place int, item_key string, title string, price double, currency string, availability string")
    points = spark.createDataFrame([(1, "other", 100.0, 1), (1, "mine", 30.0, 1), (1, "mine", 20.0, 2), (1, "other", 5.0, 3)], "site_id int, item_key string, price double, t int")
    got = {r["id"]: r for r in S.watchlist(sites, runs, records, points, ["t"]).collect()}
    one = got[1]
    assert (one["item_key"], one["title"], one["price"], one["prev_price"], one["currency"], one["low"], one["high"], one["avg"]) == ("mine", "mine", 20.0, 100.0, "EUR", 20.0, 30.0, 25.0)
    assert (one["change_pct"], one["pct_vs_avg"], one["is_all_time_low"], one["deal_score"], one["status"]) == (-80.0, -20.0, True, 100, "price dropped")
    assert (one["confidence"], one["quality"], one["field_sources"], one["last_checked"]) == (0.6, "inferred", {"price": "selector"}, 2)
    assert (got[2]["price"], got[2]["quality"], got[2]["deal_score"], got[2]["status"]) == (None, "low", 0, "watching")
    assert (got[3]["confidence"], got[3]["quality"], got[3]["last_checked"]) == (None, None, None)
