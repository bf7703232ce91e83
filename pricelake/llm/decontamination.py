"""Benchmark passages in documents by Wu-Manber search over words.

Texts are lower-cased (A-Z) and cut into words of digits, a-z and characters from U+0080 on. A window
is ``WINDOW`` consecutive words of a benchmark item; an item of fewer words is one window. Windows of
one length are searched together. The block is the last ``BLOCK`` words before the place that is
looked at (one for windows of one word): a shift table tells for every block in a window how
far it stands from the window's end, any other block lets the search skip as many words as no window
could start in, and only blocks at the end of a window open a bucket. A bucket deals its windows by their first
words, and what is left is compared word by word. Every window keeps the items that it stands in.

Documents are read in one pass without a shuffle. The windows are shipped to every task, so at most
``MOST_PATTERNS`` rows of window and item go at once: a larger benchmark is dealt by a hash into
slices that each stay below, and the documents pass slice after slice, with the places and items
found so far written between them.

Defined cases: a null or blank text has no words and no hits; a null or blank item has no windows;
items that share an id count once, an item without an id marks words and is not listed; windows that
several items hold are found for all of them; repeated rows are separate documents; very long texts
are searched whole; carried columns may have any name but those of the results; an empty table gives
no rows, an empty benchmark no hits.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lower_ascii, small_batches, written

WINDOW, BLOCK = 10, 2
#: Rows of window and item that a task holds at once (about 200 MB of Python objects).
MOST_PATTERNS = 200_000
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(lower_ascii(text)) if text else []


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """words (space-joined), item of every distinct window of every item."""
    small_batches(benchmark.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            found = set()
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = words_of(text)
                found.update((" ".join(w[i : i + window]), item) for i in range(max(1, len(w) - window + 1)) if w)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string())], ["words", "item"])

    return benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).mapInArrow(run, "words string, item string").distinct()


class Patterns:
    """Windows of one length: shift table, buckets of the last block, and the items of each window."""

    def __init__(self, length: int):
        self.length, self.block = length, min(BLOCK, length)
        self.skip = length - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, dict[tuple, list[tuple]]] = {}
        self.items: dict[tuple, set] = {}

    def add(self, window: tuple[str, ...], item: str | None) -> None:
        if window not in self.items:
            for end in range(self.block, self.length + 1):
                block = window[end - self.block : end]
                self.shift[block] = min(self.shift.get(block, self.skip), self.length - end)
            self.buckets.setdefault(window[-self.block :], {}).setdefault(window[: self.block], []).append(window)
        self.items.setdefault(window, set()).add(item)

    def ends(self, words: list[str]) -> Iterator[tuple[int, tuple]]:
        """(end, window) of every occurrence."""
        shift, skip, length, block = self.shift.get, self.skip, self.length, self.block
        at, n = length, len(words)
        while at <= n:
            last = tuple(words[at - block : at])
            far = shift(last, skip)
            if far:
                at += far
                continue
            start = at - length
            for window in self.buckets[last].get(tuple(words[start : start + block]), ()):
                if all(words[start + i] == w for i, w in enumerate(window)):
                    yield at, window
            at += 1


def prepared(rows: list[tuple[str, str | None]]) -> list[Patterns]:
    by_length: dict[int, Patterns] = {}
    for text, item in rows:
        window = tuple(text.split(" "))
        by_length.setdefault(len(window), Patterns(len(window))).add(window, item)
    return list(by_length.values())


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges that overlap or touch, as one."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(x) for x in out]


def search(words: list[str], patterns: list[Patterns]) -> tuple[list[tuple[int, int]], set]:
    """The ranges of words inside occurrences, and the items that occur."""
    spans, items = [], set()
    for group in patterns:
        for end, window in group.ends(words):
            spans.append((end - group.length, end))
            items |= group.items[window]
    return joined(spans), items


FOUND = T.ArrayType(T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType()))
#: The windows that a worker prepared last, by the slice they belong to.
_ready: dict[str, list[Patterns]] = {}


def prepared_once(mark: str, shared) -> list[Patterns]:
    if mark not in _ready:
        _ready.clear()
        _ready[mark] = prepared(shared.value)
    return _ready[mark]


def _pass(documents: DataFrame, rows: list[tuple[str, str | None]]) -> DataFrame:
    """Adds what these windows find to n_words, spans and items of each document."""
    schema = T.StructType([f for f in documents.schema if f.name not in ("n_words", "spans", "items")]).add("n_words", T.LongType()).add("spans", FOUND).add("items", T.ArrayType(T.StringType()))
    again = "spans" in documents.columns
    names, at = schema.names[:-3], documents.columns.index
    shared, mark = documents.sparkSession.sparkContext.broadcast(rows), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]):
        patterns = prepared_once(mark, shared)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            counts, spans, items = [], [], []
            old = zip(batch.column(at("spans")).to_pylist(), batch.column(at("items")).to_pylist(), strict=True) if again else None
            for text in batch.column(at("text")).to_pylist():
                words = words_of(text)
                where, what = search(words, patterns)
                if old:
                    s, i = next(old)
                    where, what = joined(where + [(x["start"], x["end"]) for x in s]), what | set(i)
                counts.append(len(words))
                spans.append([{"start": a, "end": b} for a, b in where])
                items.append(sorted(x for x in what if x is not None))
            columns = [batch.column(at(c)) for c in names] + [pa.array(counts, pa.int64()), pa.array(spans, kind), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, [*names, "n_words", "spans", "items"])

    return documents.mapInArrow(run, schema)


def scanned(documents: DataFrame, benchmark: DataFrame, carry: tuple[str, ...] | list[str] = (), window: int = WINDOW, most: int = MOST_PATTERNS) -> DataFrame:
    """doc_id, carried columns, text, n_words, spans (ranges of words inside occurrences) and items of every document."""
    found = written(windows(benchmark, window), "windows")
    slices = max(1, -(-found.count() // most))
    dealt = found.withColumn("slice", F.pmod(F.xxhash64("words", "item"), F.lit(slices)))
    sizes = {r["slice"]: r["count"] for r in dealt.groupBy("slice").count().collect()} if slices > 1 else {0: 0}
    if max(sizes.values()) > 2 * most:
        raise ValueError("windows are dealt unevenly")
    small_batches(documents.sparkSession)
    out = documents.select("doc_id", *carry, F.col("text").cast("string").alias("text"))
    for k, one in enumerate(sorted(sizes)):
        if k:
            out = written(out, "scanned")
        out = _pass(out, [(r["words"], r["item"]) for r in dealt.where(F.col("slice") == one).collect()])
    return out


def contaminated(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the spans and items behind them."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    # Ids are sorted as Python strings, by code point, which is the order of UTF-8.
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return scanned(documents, benchmark, **options).select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (hit > 0).alias("contaminated"), "spans", "items")


HIT_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i : array_to_string(w[i:i + 9], ' '))) AS g FROM b WHERE len(w) > 0),
k AS (SELECT DISTINCT k FROM p),
s AS (SELECT r, k, unnest(range(1, len(w) - k + 2)) AS i, w FROM d, k WHERE len(w) >= k),
o AS (SELECT s.r, s.i, s.k, p.item_id FROM (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM s) AS s JOIN p ON p.g = s.g AND p.k = s.k),
h AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS place FROM o) AS x GROUP BY r),
m AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM o WHERE item_id IS NOT NULL) AS y GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(m.n_items, 0) AS n_items, sha256(coalesce(m.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.r = d.r LEFT JOIN m ON m.r = d.r
"""
