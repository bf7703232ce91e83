"""Batches on tables in buckets: untouched files stay, repeated batches change nothing, lost writers are made up for."""

import os

import pytest
from pyspark.sql import functions as F

from pricelake.operators import tables as M
from pricelake.sources.buckets import Buckets
from pricelake.sources.scratch import scratch_path


def files(held):
    return {os.path.join(os.path.basename(f), n) for f, _, names in os.walk(held.path) for n in names if n.endswith(".parquet")}


def in_buckets(files, buckets):
    return {f for f in files if int(f.split("/")[0].split("=")[1]) in buckets}


@pytest.fixture
def held(spark):
    t = Buckets(spark, scratch_path(spark, "sites"), ("url", "schema_name"), 8)
    t.create(spark.createDataFrame([(i, f"u{i % 20}", "a" if i < 20 else "b", 60, "old") for i in range(40)], "id long, url string, schema_name string, interval_minutes int, created_at string"))
    return t


def batch_of(spark, *rows):
    return spark.createDataFrame(rows, "id long, url string, schema_name string, interval_minutes int, created_at string")


def test_upsert_touches_its_buckets_only(spark, held):
    before = files(held)
    new = batch_of(spark, (100, "u3", "a", 5, "new"), (101, "u99", "a", 7, "new"))
    done = M.upsert_sites(held, new, ["interval_minutes"], 1)
    after = files(held)
    assert done and len(done) <= 2
    assert before - in_buckets(before, done) == after - in_buckets(after, done)
    assert not in_buckets(before, done) & after
    rows = {(r["url"], r["schema_name"]): (r["id"], r["interval_minutes"], r["created_at"]) for r in held.rows().collect()}
    assert len(rows) == 41 and held.rows().count() == 41
    assert rows["u3", "a"] == (3, 5, "old") and rows["u3", "b"] == (23, 60, "old") and rows["u99", "a"] == (101, 7, "new")
    # The same batch again, and an earlier one, change nothing; a later one does.
    assert M.upsert_sites(held, new, ["interval_minutes"], 1) == M.upsert_sites(held, batch_of(spark, (100, "u3", "a", 9, "new")), ["interval_minutes"], 0) == []
    assert files(held) == after
    assert M.upsert_sites(held, batch_of(spark, (100, "u3", "a", 9, "new")), ["interval_minutes"], 2)
    assert held.rows().where("url = 'u3' AND schema_name = 'a'").collect()[0]["interval_minutes"] == 9


def test_emptied_buckets_and_empty_batches(spark, held):
    assert M.upsert_sites(held, batch_of(spark).where("false"), ["interval_minutes"], 1) == []
    gone = spark.range(40)
    filled = {r[0] for r in held.rows().select(F.pmod(F.xxhash64("url", "schema_name"), F.lit(8))).collect()}
    assert set(M.delete_sites(held, {}, gone, 1)["sites"]) == filled
    assert len({f.split("/")[0] for f in files(held)}) == 8
    assert held.rows().count() == 0
    assert M.delete_sites(held, {}, gone, 2)["sites"] == []
    assert M.upsert_sites(held, batch_of(spark, (1, "u1", None, 5, "new")), ["interval_minutes"], 3)
    assert [tuple(r) for r in held.rows().collect()] == [(1, "u1", None, 5, "new")]


def test_lost_writers(spark, held, monkeypatch):
    new = batch_of(spark, (100, "u3", "a", 5, "new"))
    before = files(held)

    def lost(self):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(Buckets, "_put", lost)
        with pytest.raises(RuntimeError):
            M.upsert_sites(held, new, ["interval_minutes"], 1)
    assert files(held) == before and os.path.exists(f"{held.staged}/_SUCCESS")
    # The writer was lost after it had removed a touched bucket; the repeated batch finds its rows staged.
    bucket = spark.read.parquet(held.staged).first()["__bucket"]
    for name in os.listdir(f"{held.path}/__bucket={bucket}"):
        os.remove(f"{held.path}/__bucket={bucket}/{name}")
    assert M.upsert_sites(held, new, ["interval_minutes"], 1) == []
    assert held.rows().count() == 40 and not os.path.exists(held.staged)
    assert held.rows().where("url = 'u3' AND schema_name = 'a'").collect()[0]["interval_minutes"] == 5
    # Rows that were not staged to the end are written anew.
    os.makedirs(held.staged)
    assert M.upsert_sites(held, new.withColumn("interval_minutes", F.lit(6)), ["interval_minutes"], 2)
    assert held.rows().where("interval_minutes = 6").count() == 1 and held.rows().count() == 40


def test_pruned_buckets(spark):
    runs = spark.createDataFrame([(s, 100 * s + i, i) for s in range(6) for i in range(4)], "site_id int, run_id int, fetched_at int")
    records = runs.select("site_id", "run_id", F.explode(F.array(F.lit("x"), F.lit("y"))).alias("item_key"))
    sites = spark.createDataFrame([(0, 2), (1, 0), (2, None)], "id long, retention_runs int")
    held = [Buckets(spark, scratch_path(spark, "runs"), ("site_id",), 16) for _ in range(2)]
    for t, rows in zip(held, (runs, records), strict=True):
        t.create(rows)
    before = [files(t) for t in held]
    done = M.prune_runs(*held, sites, 0, 1)
    # Only site 0 has a limit; its key is an int in the tables and a long among the sites.
    assert len(done[0]) == len(done[1]) == 1
    assert [sorted(r["run_id"] for r in t.rows().where("site_id = 0").collect()) for t in held] == [[2, 3], [2, 2, 3, 3]]
    assert [t.rows().count() for t in held] == [22, 44]
    for t, old, buckets in zip(held, before, done, strict=True):
        assert old - in_buckets(old, buckets) <= files(t)
    assert M.prune_runs(*held, sites, 0, 1) == ([], [])
    assert M.prune_runs(*held, sites, 1, 2)[0]
    assert {s: held[0].rows().where(f"site_id = {s}").count() for s in range(6)} == {0: 2, 1: 4, 2: 1, 3: 1, 4: 1, 5: 1}


def test_deleted_everywhere_it_occurs(spark, held):
    runs = Buckets(spark, scratch_path(spark, "runs"), ("site_id",), 4)
    runs.create(spark.createDataFrame([(3, 1), (4, 2), (None, 3), (77, 4)], "site_id int, run_id int"))
    done = M.delete_sites(held, {"runs": runs}, spark.createDataFrame([(3,), (77,), (None,), (3,)], "id long"), 1)
    assert done["runs"] and len(done["sites"]) == 1
    assert sorted(r["run_id"] for r in runs.rows().collect()) == [2, 3]
    assert held.rows().count() == 39 and held.rows().where("id = 3").count() == 0
