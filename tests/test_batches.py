"""Rows made of many small pages or texts leave Python together, those of a large one in parts; records are made once."""

import json

import pyarrow as pa
from pyspark.sql import functions as F

from pricelake.operators import elements as E
from pricelake.operators import pages as X


def test_elements_of_small_pages_leave_together():
    pages = pa.RecordBatch.from_pydict({"page": list(range(500)), "html": [None if i == 7 else f"<p id=a{i}>x</p>" for i in range(500)]})
    names = ["page", *E.COLUMNS.names]
    out = list(E.element_batches(iter([pages]), names))
    assert [b.num_rows for b in out] == [3 * 499 + 1]
    assert {r["page"]: r["id"] for r in out[0].to_pylist() if r["pos"] == 0} == {i: f"a{i}" for i in range(500) if i != 7}


def test_elements_of_a_large_page_leave_in_parts():
    pages = pa.RecordBatch.from_pydict({"page": [1, 2], "html": ["<br>" * 50_000, "<br>"]})
    out = list(E.element_batches(iter([pages]), ["page", *E.COLUMNS.names]))
    assert max(b.num_rows for b in out) <= E.ELEMENTS and sum(b.num_rows for b in out) == 50_001 + 2


def test_objects_leave_together_or_in_parts():
    texts = pa.RecordBatch.from_pydict({"page": list(range(300)), "__seq": ["0000"] * 300, "__text": [json.dumps({"a": i, "b": [{"a": 1}]}) for i in range(300)]})
    out = list(X.node_batches(iter([texts]), ["page", "place", "__json"], frozenset(["a"])))
    assert len(out) == 1
    assert [(r["page"], r["place"]) for r in out[0].to_pylist()] == [x for i in range(300) for x in ((i, "0000"), (i, "0000/000001/000000"))]
    large = pa.RecordBatch.from_pydict({"page": [1], "__seq": ["0000"], "__text": [json.dumps([{"a": "x" * 1000}] * 5000)]})
    parts = list(X.node_batches(iter([large]), ["page", "place", "__json"], None))
    assert sum(b.num_rows for b in parts) == 5000 and max(b.num_rows for b in parts) < 1100


def test_a_record_is_generated_once(spark):
    nodes = [{"name": "", "title": "T", "offers": [{"price": "1.250,50", "currency": "EUR"}], "brand": [{"name": "B"}], "image": ["i"], "aggregateRating": {"ratingValue": 4.5, "reviewCount": "9"}}, [1], {"name": "n", "price": {"centAmount": 125}, "sku": 7}]
    df = spark.createDataFrame([(i, json.dumps(n)) for i, n in enumerate(nodes)], "i long, j string").select("i", F.try_parse_json("j").alias("node"))
    assert len(X.node_record(F.col("node"))) == 1
    records = df.select("i", *X.node_record(F.col("node"))).where("i <> 1 AND title IS NOT NULL AND price IS NOT NULL")
    got = {r["i"]: r.asDict() for r in records.collect()}
    assert {k: got[0][k] for k in ("title", "price", "currency", "brand", "image", "rating", "review_count", "sku")} == {"title": "T", "price": 1250.5, "currency": "EUR", "brand": "B", "image": "i", "rating": 4.5, "review_count": 9.0, "sku": None}
    assert (got[2]["title"], got[2]["price"], got[2]["sku"]) == ("n", 1.25, "7") and set(got) == {0, 2}
