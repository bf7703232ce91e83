"""Pages of many parts and much text: what an element holds is never copied once for each element."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from pricelake.operators import elements as E
from pricelake.sources import inputs
from pricelake.sources.inputs import list_page_parts, list_pages, parts
from pricelake.sources.scratch import written


def test_text_over_block_ends(spark):
    """Texts that lie in one block, end with one, run over several, and are empty; characters of several bytes."""
    size = E.TEXT_BLOCK
    bodies = ["é" * 10, "é" * size, "ab" * (2 * size) + "€", "", "x" * (size - 1)]
    html = "".join(f"<p>{b}</p>" for b in bodies)
    rows = E.by_selectors(spark.createDataFrame([(1, html)], "page int, html string"), "page", [{"name": "t", "selector": "p"}], "p").collect()
    assert [r["value"] for r in sorted(rows, key=lambda r: r["item"])] == [b or None for b in bodies]


def test_no_row_holds_a_large_text(spark):
    page = "<p>" + "word " * (3 * E.TEXT_BLOCK) + "</p>"
    table = E.elements(spark.createDataFrame([(1, page)], "page int, html string"), ["page"])
    assert table.selectExpr("max(length(text))").first()[0] <= E.TEXT_BLOCK


def test_parts_are_spread(spark, sf_dir):
    """A single small file is dealt over the cores before pages are made from its rows."""
    assert parts(spark, sf_dir).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_written_rows_are_not_broadcast_by_the_size_of_their_file(spark):
    """300,000 equal rows take a few kilobytes as Parquet."""
    many = written(spark.range(300_000).select(F.lit(1).alias("k"), F.lit("same text").alias("t")), "many")
    few = written(spark.range(10).select(F.col("id").cast("int").alias("k")), "few")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan(many.join(many.select("k").distinct(), "k"))
    assert "strategy" not in plan(few.join(few.select("k").distinct(), "k"))


def test_parts_of_a_listing_page_are_the_page(spark, sf_dir, monkeypatch):
    """Joined in their order they are list_pages; none holds more than a few items."""
    monkeypatch.setattr(inputs, "PART_ITEMS", 3)
    rows = list_page_parts(spark, sf_dir).collect()
    joined = {b: "".join(r["html"] for r in sorted((r for r in rows if r["brand"] == b), key=lambda r: tuple(r["part"]))) for b in {r["brand"] for r in rows}}
    assert joined == {r["brand"]: r["html"] for r in list_pages(spark, sf_dir).collect()}
    assert max(len(r["html"]) for r in rows) < 1000


def test_pages_in_parts_are_read_as_whole_ones(monkeypatch):
    """Odd markup cut anywhere, also inside tags, quotes, scripts and character references, over batches and pages."""
    bits = ["<a", "<b ", "</a>", ">", "<", "/>", "=", " = ", "'", '"', " t", "&amp;", "&am", "&#3", "8;", "<!--", "-->", "<!", "<?", "<script>", "</script>", "</ script >", "<style>", "</style>", "<br>", "<p class='q r'>", "é", "🙂", "it's"]
    rng = random.Random(3)
    pages = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    cut = [(i, part) for i, page in enumerate(pages) for part in (page[k : k + 4] for k in range(0, max(len(page), 1), 4))]
    names = ["page", *E.COLUMNS.names]
    batch = lambda rows: pa.RecordBatch.from_pydict({"page": [i for i, _ in rows], "html": [h for _, h in rows]})
    plain = lambda out: sorted(map(repr, (r for b in out for r in b.to_pylist())))
    whole = plain(E.element_batches(iter([batch(list(enumerate(pages)))]), names))
    monkeypatch.setattr(E, "ELEMENTS", 50)
    assert plain(E.element_batches((batch(cut[k : k + 70]) for k in range(0, len(cut), 70)), names, True)) == whole


def test_no_more_of_a_page_is_held_than_is_open():
    """A page of 60,000 cards in parts: rows leave as elements are complete, not at the end."""
    card, names = "<li class=c><a href=/x>y</a></li>", ["page", *E.COLUMNS.names]
    given = []

    def parts():
        for k in range(60):
            given.append(k)
            yield pa.RecordBatch.from_pydict({"page": [1], "html": ["<ul>" * (k == 0) + card * 1000]})

    out = E.element_batches(parts(), names, True)
    first = next(out)
    assert len(given) < 20 and first.num_rows == E.ELEMENTS
    assert sum(b.num_rows for b in out) + first.num_rows == 120_001 + 1 + -(-60_000 // E.TEXT_BLOCK)
