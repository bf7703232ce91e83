"""Outliers of series spread over many tasks against the running median of one task."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from pricelake.functions.running import Past
from pricelake.operators import long_series
from pricelake.operators import series as S
from pricelake.operators.long_series import limits


def series_of(kind, n, rng):
    if kind == "cents":
        return [rng.choice([round(rng.gauss(50, 5), 2), None, round(rng.random() * 200, 2)]) for _ in range(n)]
    if kind == "two levels":
        return [rng.choice([10.0, 90.0, 90.0 + rng.randint(0, 3)]) for _ in range(n)]
    if kind == "flat":
        return [7.0 if rng.random() < 0.8 else rng.choice([7.5, 3.0, 20.0]) for _ in range(n)]
    return [math.exp(i / 40) * (1 + rng.random() / 50) * (10 if rng.random() < 0.1 else 1) for i in range(n)]


@pytest.mark.parametrize("slice_rows", [7, 32])
@pytest.mark.parametrize("z", [0.0, 1.5, 6.0])
def test_spread_equals_one_task(spark, slice_rows, z):
    rng = random.Random(slice_rows)
    rows, want = [], {}
    for key, kind, n in [("cents", "cents", 250), ("levels", "two levels", 160), ("flat", "flat", 200), (None, "growing", 150), ("short", "cents", 30)]:
        past = Past()
        for t, v in enumerate(series_of(kind, n, rng)):
            rows.append((key, t // 2, t, v, "x"))
            want[key, t] = v is not None and past.outlier(v, z, 6)
            if v is not None:
                past.add(v)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "key string, day int, t int, v double, outlier_note string").repartition(3)
    got = S.outliers(df, "v", "key", ["day", "t"], z=z, held=50, slice_rows=slice_rows)
    assert got.columns == [*df.columns, "outlier"]
    found = {(r["key"], r["t"]): r["outlier"] for r in got.collect()}
    assert len(found) == len(rows) == got.count()
    assert {k for k in want if found[k] != want[k]} == set()
    assert z == 6.0 or 50 < sum(want.values()) < len(want)


def test_all_equal_values_and_none(spark):
    df = spark.range(300).select(F.lit(1).alias("k"), F.col("id").alias("t"), F.when(F.col("id") == 299, 9.0).otherwise(5.0).alias("v"))
    assert [r["t"] for r in S.outliers(df, "v", "k", ["t"], held=10, slice_rows=16).where("outlier").collect()] == [299]
    assert S.outliers(df.where("false"), "v", "k", ["t"], held=10, slice_rows=16).count() == 0
    assert S.outliers(df.withColumn("v", F.lit(None).cast("double")), "v", "k", ["t"], held=10).where("outlier").count() == 0


def test_limits_are_exact():
    rng = random.Random(1)
    for _ in range(3000):
        middle, value, z = rng.choice([0.0, 100.0, rng.random()]), rng.choice([200.0, rng.gauss(0, 9)]), rng.choice([0.5, 6.0, 1 / 1.4826])
        ends = limits(value, middle, z)
        if value == middle:
            assert ends is None
            continue
        far = lambda s: abs(value - middle) / (s * 1.4826) > z if s > 0 else True  # noqa: B023, E731
        for a in (ends[0], ends[1]):
            assert far(abs(a - middle))
        assert not far(middle - math.nextafter(ends[0], -math.inf)) and not far(math.nextafter(ends[1], math.inf) - middle)


def test_running_median_is_the_plain_one():
    rng = random.Random(2)
    values = [rng.randint(0, 9) * 1.0 for _ in range(80)]
    past = Past(values=values)
    m = statistics.median(values)
    assert past.median() == m and past.deviation(m) == statistics.median(abs(v - m) for v in values)


def test_slices_grow_with_a_series(spark, monkeypatch):
    """Their number stays, so counts by bin and slice, its square, do not outgrow the series; flags are the same."""
    for n in (10**5, 10**7, 10**9, 10**11):
        size = long_series.rows_of_slice(n, 200)
        assert (n / size) ** 2 <= max(1.01 * n, (long_series.SLICES + 1) ** 2)
    assert long_series.rows_of_slice(20_000, 200) == 200
    monkeypatch.setattr(long_series, "SLICES", 6)
    tables = {}
    keep = long_series.written
    monkeypatch.setattr(long_series, "written", lambda df, name: tables.setdefault(name, keep(df, name)))
    values = series_of("cents", 240, random.Random(5))
    past, want = Past(), []
    for v in values:
        want.append(v is not None and past.outlier(v, 1.5, 6))
        if v is not None:
            past.add(v)
    df = spark.createDataFrame([(1, t, v) for t, v in enumerate(values)], "k int, t int, v double")
    got = S.outliers(df, "v", "k", ["t"], z=1.5, held=50, slice_rows=7)
    assert [r["outlier"] for r in sorted(got.collect(), key=lambda r: r["t"])] == want
    assert tables["values"].agg(F.max("slice")).first()[0] < 6 and any(want)
