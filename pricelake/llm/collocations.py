"""Phrases whose words occur together, mined by extending occurrence relations (SETM).

Texts are lower-cased (A-Z), cut into pieces at sentence marks and line ends, and pieces into words at
blanks. R1 holds a row for every document: the places of its frequent words in order, and their
ids. Pieces follow each other with one unused place between them, so two occurrences are neighbours in
a piece exactly if their places follow each other. R(k+1) is the merge-join of R(k) with itself on
piece and adjacent place: both are sorted, so a join is one pass that compares neighbours. The phrases of
k+1 words are counted over all documents; those below ``LEAST`` are left out by a semi-join before R(k+1)
is written and joined again. A phrase of k+1 words is named by the ids of its two parts of k words.

Ids are dense, from the row numbers of a written table. The semi-join runs inside the pass while
the frequent words (``MOST_WORDS``) or phrases (``MOST_PHRASES``) fit into a task's memory; beyond, the
relation is exploded, joined by a shuffle and gathered by document again.

Defined cases: a null text is empty, a null lang is `und`; texts without words give nothing; repeated
rows count as often as they occur; very long texts are read whole; ties are ranked by count and then phrase
in UTF-8 order; extra columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, spent, written

LEAST, WORDS, TOP, CONTAINED_PERCENT = 10, 3, 2000, 50
#: Frequent words (about 100 MB as a dictionary) and phrases (16 bytes each) that a task may hold.
MOST_WORDS, MOST_PHRASES = 500_000, 2_000_000
#: Distinct words that a task gathers, and occurrences of phrases that it counts at once.
GATHERED, COUNTED = 200_000, 1_000_000
RELATION = "document long, places array<int>, ids array<long>"
_UPPER, CUT = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"\xff"
#: A-Z in lower case, every cut as a byte that UTF-8 never has, a tab as a blank; other bytes stay.
_PLAIN = bytes.maketrans(_UPPER + b".,;:!?\n\x0b\x0c\r\t", _UPPER.lower() + CUT * 10 + b" ")


def tokens(text: bytes | None) -> list[bytes]:
    """Words in order (as UTF-8), and CUT between pieces."""
    return text.translate(_PLAIN).replace(CUT, b" " + CUT + b" ").split() if text else []


def texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.monotonically_increasing_id().alias("document"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").cast("binary").alias("text"))


def word_counts(documents: DataFrame) -> DataFrame:
    """lang, word, n of every word."""
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]):
        counts: dict[str, Counter] = defaultdict(Counter)

        def table():
            rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], ["lang", "word", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                counts[lang].update(tokens(text))
            for c in counts.values():
                c.pop(CUT, None)
            if sum(map(len, counts.values())) >= GATHERED:
                yield table()
        if counts:
            yield table()

    return texts(documents).mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def numbered(groups: DataFrame, name: str) -> tuple[DataFrame, int]:
    """The groups with dense ids from 0, and their number."""
    table = written(groups, name)
    # The upper bits name the task, the lower ones the row in it, in a fixed order of a fixed table.
    placed = written(table.withColumn("__at", F.monotonically_increasing_id()), name)
    task = F.shiftright("__at", 33)
    sizes = sorted((r["task"], r["count"]) for r in placed.groupBy(task.alias("task")).count().collect())
    starts, total = [], 0
    for part, size in sizes:
        starts.append((part, total))
        total += size
    offsets = placed.sparkSession.createDataFrame(starts, "task long, start long")  # a row a task
    ids = F.col("start") + F.col("__at") - F.shiftleft(F.col("task"), 33)
    out = placed.withColumn("task", task).join(F.broadcast(offsets), "task").withColumn("id", ids).drop("task", "start", "__at")
    return out, total


def gathered(rows: DataFrame) -> DataFrame:
    """document, places, ids in order, from a row (document, place, id) for each occurrence."""
    pairs = rows.groupBy("document").agg(F.sort_array(F.collect_list(F.struct("place", "id"))).alias("o"))
    return pairs.select("document", F.col("o.place").alias("places"), F.col("o.id").alias("ids"))


def occurrences(documents: DataFrame, words: DataFrame, few: bool) -> DataFrame:
    """R1: the places and ids of frequent words (lang, word, id), a row a document."""
    rows = texts(documents)
    if not few:

        def each(batches: Iterator[pa.RecordBatch]):
            for batch in batches:
                for document, lang, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    t = tokens(text)
                    keep = [i for i, w in enumerate(t) if w != CUT]
                    yield pa.RecordBatch.from_arrays([pa.array([document] * len(keep), pa.int64()), pa.array([lang] * len(keep), pa.string()), pa.array([t[i] for i in keep], pa.string()), pa.array(keep, pa.int32())], ["document", "lang", "word", "place"])

        exploded = rows.mapInArrow(each, "document long, lang string, word string, place int")
        return gathered(exploded.join(words.select("lang", "word", "id"), ["lang", "word"]))
    known: dict[str, dict[bytes, int]] = defaultdict(dict)
    table = words.select("lang", F.col("word").cast("binary"), "id").toArrow()
    for lang, word, n in zip(*(table.column(i).to_pylist() for i in range(3)), strict=True):
        known[lang][word] = n
    shared = documents.sparkSession.sparkContext.broadcast(dict(known))

    def run(batches: Iterator[pa.RecordBatch]):
        known = shared.value
        for batch in batches:
            out = []
            for lang, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                t, find = tokens(text), known.get(lang, {}).get
                ids = np.fromiter((find(w, -1) for w in t), np.int64, len(t))
                kept = np.flatnonzero(ids >= 0)
                out.append((kept.astype(np.int32), ids[kept]))
            yield relation(batch.column(0), out)

    return rows.mapInArrow(run, RELATION)


def relation(documents, rows: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    ends = np.cumsum([0, *(len(p) for p, _ in rows)]).astype(np.int32)
    flat = [np.concatenate([r[k] for r in rows]) if rows else np.zeros(0) for k in (0, 1)]
    lists = [pa.ListArray.from_arrays(ends, pa.array(x, kind)) for x, kind in zip(flat, (pa.int32(), pa.int64()), strict=True)]
    return pa.RecordBatch.from_arrays([documents, *lists], ["document", "places", "ids"])


def extended(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The merge-join of a batch's relation with itself: row, place and both ids (in one number) of neighbours."""
    places, ids = batch.column(1), batch.column(2)
    at, word = places.flatten().to_numpy(), ids.flatten().to_numpy()
    row = np.repeat(np.arange(batch.num_rows), np.diff(places.offsets.to_numpy()))
    if not len(at):
        return row, at, word
    next_to = np.flatnonzero((at[1:] == at[:-1] + 1) & (row[1:] == row[:-1]))
    return row[next_to], at[next_to], word[next_to] << 32 | word[next_to + 1]


def phrase_counts(relations: DataFrame) -> DataFrame:
    """code (the ids of both parts), n of the phrases one word longer."""

    def run(batches: Iterator[pa.RecordBatch]):
        held, size = [], 0

        def table():
            codes, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(n, pa.int64())], ["code", "n"])

        for batch in batches:
            held.append(extended(batch)[2])
            size += len(held[-1])
            if size >= COUNTED:
                size = 0
                yield table()
        if held:
            yield table()

    return relations.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def longer(relations: DataFrame, phrases: DataFrame, few: bool) -> DataFrame:
    """R(k+1): the merge-join of R(k) with itself, and its semi-join with the frequent phrases (code, id)."""
    if not few:

        def each(batches: Iterator[pa.RecordBatch]):
            for batch in batches:
                row, at, code = extended(batch)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(at, pa.int32()), pa.array(code, pa.int64())], ["document", "place", "code"])

        return gathered(relations.mapInArrow(each, "document long, place int, code long").join(phrases.select("code", "id"), "code"))
    table = phrases.select("code", "id").toArrow()
    code, n = (table.column(i).to_numpy() for i in range(2))
    order = np.argsort(code)
    shared = relations.sparkSession.sparkContext.broadcast((code[order], n[order]))

    def run(batches: Iterator[pa.RecordBatch]):
        known, number = shared.value
        for batch in batches:
            row, at, codes = extended(batch)
            where = np.searchsorted(known, codes)
            kept = np.flatnonzero(known[np.minimum(where, len(known) - 1)] == codes) if len(known) else np.zeros(0, np.int64)
            row, at, ids = row[kept], at[kept], number[where[kept]] if len(known) else codes[kept]
            cuts = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(cuts, pa.array(x, kind)) for x, kind in ((at, pa.int32()), (ids, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["document", "places", "ids"])

    return relations.mapInArrow(run, RELATION)


def mined(documents: DataFrame, least: int = LEAST, longest: int = WORDS, most_words: int = MOST_WORDS, most_phrases: int = MOST_PHRASES) -> tuple[list[DataFrame], DataFrame]:
    """Frequent phrases of 1 to longest words (id, first, rest, lang, phrase, n; first and rest are the ids of
    the parts one word shorter), and n of all words for each lang."""
    small_batches(documents.sparkSession)
    counts = written(word_counts(documents), "words")
    totals = written(counts.groupBy("lang").agg(F.sum("n").alias("total")), "totals")
    words, size = numbered(counts.where(F.col("n") >= least), "frequent")
    spent(counts)
    found = [words.select("id", F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("rest"), "lang", F.col("word").alias("phrase"), "n")]
    relations = written(occurrences(documents, words, size <= most_words), "occurrences")
    for length in range(2, longest + 1):
        phrases, size = numbered(phrase_counts(relations).where(F.col("n") >= least), "phrases")
        named = phrases.withColumn("first", F.shiftright("code", 32)).withColumn("rest", F.col("code").bitwiseAND(F.lit((1 << 32) - 1)))
        before = found[-1]
        head = before.select(F.col("id").alias("first"), "lang", F.col("phrase").alias("head"))
        last = before.select(F.col("id").alias("rest"), F.substring_index("phrase", " ", -1).alias("tail"))
        named = named.join(head, "first").join(last, "rest").select("id", "first", "rest", "lang", F.concat_ws(" ", "head", "tail").alias("phrase"), "n")
        found.append(written(named, "named"))
        if length < longest:
            shorter, relations = relations, written(longer(relations, phrases, size <= most_phrases), "occurrences")
            spent(shorter)
    spent(relations)
    return found, totals


def collocations(documents: DataFrame, least: int = LEAST, top: int = TOP, **options) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases of two and three words."""
    (words, pairs, triples), totals = mined(documents, least, WORDS, **options)
    counts = lambda df, key, name: df.select(F.col("id").alias(key), F.col("n").alias(name))
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    score = lambda a, l, r: F.call_function("div", F.lit(1_000_000).cast("decimal(38,0)") * wide(a) * wide(a), wide(l) * wide(r)).cast("long")  # noqa: E731, E741
    two = pairs.join(counts(words, "first", "l"), "first").join(counts(words, "rest", "r"), "rest").withColumn("score", score("n", "l", "r"))
    # A pair goes if it lies in a phrase of three words that is at least half as frequent.
    over = triples.select(F.col("first").alias("id"), F.col("n").alias("m")).unionByName(triples.select(F.col("rest").alias("id"), F.col("n").alias("m"))).groupBy("id").agg(F.max("m").alias("m"))
    two = two.join(over, "id", "left").where(F.col("m").isNull() | (100 * F.col("m") < CONTAINED_PERCENT * F.col("n")))
    facts = pairs.select(F.col("id"), F.col("n"), F.col("first").alias("w1"), F.col("rest").alias("w2"))
    three = triples.join(facts.select(F.col("id").alias("first"), F.col("n").alias("l2"), "w1"), "first").join(facts.select(F.col("id").alias("rest"), F.col("n").alias("r1"), F.col("w2").alias("w3")), "rest")
    three = three.join(counts(words, "w1", "l1"), "w1").join(counts(words, "w3", "r2"), "w3")
    cuts = three.withColumn("s1", score("n", "l1", "r1")).withColumn("s2", score("n", "l2", "r2"))
    early = F.col("s1") <= F.col("s2")
    three = cuts.select("lang", "phrase", "n", F.when(early, F.col("l1")).otherwise(F.col("l2")).alias("l"), F.when(early, F.col("r1")).otherwise(F.col("r2")).alias("r"), F.least("s1", "s2").alias("score"))
    both = two.select("lang", "phrase", "n", "l", "r", "score").unionByName(three).withColumnRenamed("n", "a")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(totals), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")  # a row a language


PHRASE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d) AS x),
o AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest([1, 2, 3]) AS k) AS ks WHERE len(w) >= k) AS x),
f AS (SELECT lang, k, phrase, count(*) AS a FROM o GROUP BY lang, k, phrase),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 10),
s AS (SELECT c.*, cut, array_to_string(w[1:cut], ' ') AS head, array_to_string(w[cut + 1:k], ' ') AS tail FROM c, (SELECT unnest([1, 2]) AS cut) AS cuts WHERE cut < k),
t AS (SELECT s.*, x.a AS l, y.a AS r, CAST(CAST(1000000 AS HUGEINT) * s.a * s.a // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score FROM s JOIN f AS x ON x.lang = s.lang AND x.phrase = s.head JOIN f AS y ON y.lang = s.lang AND y.phrase = s.tail),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS z FROM t) AS q WHERE z = 1),
g AS (SELECT lang, part, max(a) AS m FROM (SELECT lang, a, array_to_string(w[1:2], ' ') AS part FROM c WHERE k = 3 UNION ALL SELECT lang, a, array_to_string(w[2:3], ' ') FROM c WHERE k = 3) AS q GROUP BY lang, part),
h AS (SELECT u.* FROM u LEFT JOIN g ON u.k = 2 AND g.lang = u.lang AND g.part = u.phrase WHERE g.m IS NULL OR 100 * g.m < 50 * u.a),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM h)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, n.n, r.score FROM r JOIN n ON n.lang = r.lang WHERE rank <= 2000
"""
