"""Divergence of sources within a language, from chunks that are tokenized once.

Documents are lower-cased (A-Z) and split at blanks into chunks, which never cut a term; a pass over the
documents counts, for each language and source, how often a chunk occurs and in how many documents. Every
distinct chunk becomes one row that holds these counts and is tokenized once; its terms take them along.
Occurrences of a term add up over its chunks. The documents of a term do not, as a document may hold several of its chunks: a
term is kept for certain if one chunk alone lies in ``LEAST_DOCUMENTS`` documents of the language and
dropped for certain if all its chunks together do not; the documents of the few terms between are
counted exactly in a second pass that returns only their rare chunks. That pass knows these chunks by
a bitmap of ``BITS`` bits, whatever their number, and the join that follows removes what only collided.

Probabilities are p = 1 + floor(10^9 (count + 2) / (N + 2 V)), in decimals of 38 digits. For a pair of
sources, f(p, q) = floor((p - q)^2 / (p + q)) is summed over all kept terms without listing those that
a source lacks: terms with the same count in a source are one row of its histogram, which meets the
other source's p of an absent term; terms that both hold are corrected through a join on the term; terms that
neither holds add a multiple of one value.

Defined cases: null text, lang and source count as ''; a text without terms still makes its group
occur; repeated rows are separate documents; a language without kept terms gives its pairs value 0;
ties are ranked by item in UTF-8 order; a very long text or chunk is read whole; extra columns are
ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, spent, written

LEAST_DOCUMENTS, TERM_RANKS = 10, 10
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Bits of the map of undecided chunks (16 MB), and of one of its rows.
BITS, ROW_BITS = 1 << 27, 1 << 16
#: Groups of language and source, or terms of a language, that may be broadcast.
BROADCAST_GROUPS = 300_000
#: Distinct chunks that a task gathers before it hands their counts on.
GATHERED = 700_000


def few(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_GROUPS else df


def chunk_counts(documents: DataFrame) -> DataFrame:
    """chunk, langs (lang, d, sources (source, n, d)), found: occurrences n, documents d and sorted terms of every distinct chunk.

    Tasks hand on sums, so a frequent chunk meets a row for each task and group. The chunk '' lists all groups.
    """
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]):
        inside: dict[tuple[str, str], Counter] = defaultdict(Counter)
        # How often a chunk stands in documents besides the first time in each.
        again: dict[tuple[str, str], dict] = defaultdict(dict)

        def table():
            columns: list[list] = [[], [], [], [], []]
            for (lang, source), d in inside.items():
                d[b""] = 0
                n = dict(d)
                for c, times in again[lang, source].items():
                    n[c] += times
                found = (pa.repeat(pa.scalar(lang, pa.string()), len(d)), pa.repeat(pa.scalar(source, pa.string()), len(d)), pa.array(list(d), pa.string()), pa.array(list(n.values()), pa.int64()), pa.array(list(d.values()), pa.int64()))
                for column, values in zip(columns, found, strict=True):
                    column.append(values)
            inside.clear(), again.clear()
            return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], ["lang", "source", "chunk", "n", "d"])

        for batch in batches:
            for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                chunks = chunks_of(text)
                counts = Counter(chunks)
                inside[lang, source].update(counts.keys())
                if len(counts) < len(chunks):
                    extra = again[lang, source]
                    for c, n in counts.items():
                        if n > 1:
                            extra[c] = extra.get(c, 0) + n - 1
            if sum(map(len, inside.values())) >= GATHERED:
                yield table()
        if inside:
            yield table()

    rows = documents.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), text_bytes())
    counts = rows.mapInArrow(run, "lang string, source string, chunk string, n long, d long").repartition("chunk")
    groups = counts.groupBy("chunk", "lang", "source").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    langs = groups.groupBy("chunk", "lang").agg(F.sum("d").alias("d"), F.collect_list(F.struct("source", "n", "d")).alias("sources"))
    whole = langs.groupBy("chunk").agg(F.collect_list(F.struct("lang", "d", "sources")).alias("langs"))
    return whole.withColumn("found", F.sort_array(F.regexp_extract_all("chunk", F.lit(f"({TERM})"), 1)))


def text_bytes():
    return F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")


def chunks_of(text: bytes) -> list[bytes]:
    """Chunks of a UTF-8 text, A-Z in lower case; bytes are split at the six ASCII blanks only."""
    return text.lower().split()


def terms_of_chunks(chunks: DataFrame) -> DataFrame:
    """chunk, langs, term, first for every term of a chunk as often as it stands there; first marks one of the equal ones."""
    marked = F.transform("found", lambda t, i: F.struct(t.alias("term"), ((i == 0) | (F.get(F.col("found"), i - 1) != t)).alias("first")))
    return chunks.select("chunk", "langs", F.explode(marked).alias("t")).select("chunk", "langs", "t.term", "t.first")


def term_counts(chunks: DataFrame, least: int) -> DataFrame:
    """lang, term, low and high (bounds of its documents), sources (source, count) of terms that may be kept."""
    each = terms_of_chunks(chunks).select("term", "first", F.explode("langs").alias("l")).select("term", "first", "l.lang", F.col("l.d").alias("low"), F.explode("l.sources").alias("s"))
    rows = each.select("lang", "term", "s.source", "s.n", F.when(F.col("first"), F.col("s.d")).otherwise(0).alias("d"), "low").repartition("lang", "term")
    sums = rows.groupBy("lang", "term", "source").agg(F.sum("n").alias("count"), F.sum("d").alias("d"), F.max("low").alias("low"))
    return sums.groupBy("lang", "term").agg(F.max("low").alias("low"), F.sum("d").alias("high"), F.collect_list(F.struct("source", "count")).alias("sources")).where(F.col("high") >= least)


def bitmap(chunks: DataFrame) -> bytes:
    """BITS bits, set at the crc32 of every chunk; built in rows of ROW_BITS, so what the driver gathers has a fixed size."""
    place = F.crc32(F.col("chunk").cast("binary")) % BITS
    places = chunks.select((place / ROW_BITS).cast("int").alias("row"), (place % ROW_BITS).cast("int").alias("bit")).distinct()

    def run(key, rows):
        bits = np.zeros(ROW_BITS, np.bool_)
        bits[rows["bit"].to_numpy()] = True
        return rows.head(1)[["row"]].assign(bits=[np.packbits(bits).tobytes()])

    out = np.zeros((BITS // ROW_BITS, ROW_BITS // 8), np.uint8)
    for r in places.groupBy("row").applyInPandas(run, "row int, bits binary").toLocalIterator():
        out[r["row"]] = np.frombuffer(r["bits"], np.uint8)
    return out.tobytes()


def rare_chunks(documents: DataFrame, marked: bytes) -> DataFrame:
    """document, lang, chunk for the distinct chunks of each document whose bit is set."""
    small_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(marked)

    def run(batches: Iterator[pa.RecordBatch]):
        bits = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            sets = [set(chunks_of(t)) for t in batch.column(2).to_pylist()]
            flat = list(chain.from_iterable(sets))
            code = np.fromiter(map(zlib.crc32, flat), np.int64, len(flat)) & (BITS - 1)
            hit = np.flatnonzero(bits[code >> 3] >> (7 - (code & 7)).astype(np.uint8) & 1)
            owner = pa.array(np.repeat(np.arange(len(sets)), [len(s) for s in sets])[hit])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), batch.column(1).take(owner), pa.array([flat[i] for i in hit.tolist()], pa.string())], ["document", "lang", "chunk"])

    rows = documents.select(F.monotonically_increasing_id().alias("document"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), text_bytes())
    return rows.mapInArrow(run, "document long, lang string, chunk string")


def kept_terms(documents: DataFrame, chunks: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """lang, term, sources (source, count) of every term in at least so many documents of the language."""
    bounds = written(term_counts(chunks, least), "bounds")
    sure = bounds.where(F.col("low") >= least)
    open_terms = bounds.where(F.col("low") < least)
    undecided = few(open_terms.select("lang", "term"), open_terms.count())
    # Of these terms, every chunk of the language, as each lies in fewer documents.
    rare = terms_of_chunks(chunks.where(F.exists("langs", lambda x: x["d"] < least))).where("first").select("chunk", "term", F.explode("langs").alias("l")).where(F.col("l.d") < least)
    rare = written(rare.select("l.lang", "chunk", "term").join(undecided, ["lang", "term"]), "rare")
    if not rare.limit(1).count():
        return sure.select("lang", "term", "sources")
    found = rare_chunks(documents, bitmap(rare.select("chunk"))).join(rare, ["lang", "chunk"])
    exact = found.groupBy("lang", "term", "document").agg(F.lit(1).alias("one")).groupBy("lang", "term").agg(F.count("*").alias("documents"))
    proven = open_terms.join(exact.where(F.col("documents") >= least), ["lang", "term"])
    return sure.select("lang", "term", "sources").unionByName(proven.select("lang", "term", "sources"))


def _p(count, total, terms):
    """1 + floor(10^9 (count + 2) / (total + 2 terms)), exactly."""
    wide = lambda x: F.col(x).cast("decimal(38,0)") if isinstance(x, str) else x.cast("decimal(38,0)")
    return F.lit(1).cast("long") + F.call_function("div", wide(F.lit(1_000_000_000)) * (wide(count) + F.lit(2)), wide(total) + F.lit(2) * wide(terms)).cast("long")


def _f(p, q):
    p, q = F.col(p), F.col(q)
    return F.call_function("div", (p - q) * (p - q), p + q)


def measured(documents: DataFrame, least: int = LEAST_DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """groups: lang, source, n_terms (of the lang), total, p_absent; counts: lang, source, term, count, p of the kept terms that a group holds."""
    chunks = written(chunk_counts(documents), "chunks")
    kept = written(kept_terms(documents, chunks, least), "kept")
    counts = kept.select("lang", "term", F.explode("sources").alias("s")).select("lang", "s.source", "term", "s.count")
    totals = counts.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    occurring = chunks.where("chunk = ''").select(F.explode("langs").alias("l")).select("l.lang", F.explode("l.sources").alias("s")).select("lang", "s.source")
    groups = occurring.join(totals, ["lang", "source"], "left").join(kept.groupBy("lang").agg(F.count("*").alias("n_terms")), "lang", "left")
    groups = groups.fillna(0, ["total", "n_terms"]).withColumn("p_absent", F.when(F.col("n_terms") > 0, _p(F.lit(0), "total", "n_terms")))
    groups = written(groups, "groups")
    spent(chunks)
    facts = groups.select("lang", "source", "total", "n_terms")
    return groups, counts.join(few(facts, groups.count()), ["lang", "source"]).withColumn("p", _p("count", "total", "n_terms"))


def pair_values(groups: DataFrame, counts: DataFrame) -> DataFrame:
    """lang, source, item (another source), value: f summed over all kept terms."""
    n = groups.count()
    other = few(groups.select("lang", F.col("source").alias("item"), F.col("p_absent").alias("q")), n)
    pairs = groups.select("lang", "source", "n_terms", F.col("p_absent").alias("p")).join(other, "lang").where("source <> item")
    # What a source holds, against the absent term of each other source: one row for each distinct count.
    steps = counts.groupBy("lang", "source", "p").agg(F.count("*").alias("terms"))
    alone = steps.join(other, "lang").where("source <> item").groupBy("lang", "source", "item").agg(F.sum(_f("p", "q") * F.col("terms")).alias("alone"), F.sum("terms").alias("held"))
    both_ways = alone.unionByName(alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "alone", "held"))
    absent = few(groups.select("lang", "source", "p_absent"), n)
    held = counts.select("lang", "source", "term", "p").join(absent, ["lang", "source"])
    left, right = held, held.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p_absent").alias("q_absent"))
    shared = left.join(right, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item").agg(F.sum(_f("p", "q") - _f("p", "q_absent") - _f("p_absent", "q")).alias("change"), F.count("*").alias("common"))
    shared = shared.unionByName(shared.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "change", "common"))
    zero = F.lit(0).cast("long")
    parts = both_ways.select("lang", "source", "item", F.col("alone").alias("v"), F.col("held"), zero.alias("common"))
    parts = parts.unionByName(shared.select("lang", "source", "item", F.col("change").alias("v"), zero.alias("held"), "common"))
    sums = parts.groupBy("lang", "source", "item").agg(F.sum("v").alias("v"), F.sum("held").alias("held"), F.sum("common").alias("common"))
    full = pairs.join(sums, ["lang", "source", "item"], "left").fillna(0, ["v", "held", "common"])
    neither = F.col("n_terms") - F.col("held") + F.col("common")
    return full.select("lang", "source", "item", F.when(F.col("n_terms") > 0, F.col("v") + neither * _f("p", "q")).otherwise(0).cast("long").alias("value"))


def term_values(counts: DataFrame) -> DataFrame:
    """lang, source, item (a kept term that the group uses more than its language), value."""
    whole = counts.groupBy("lang", "term").agg(F.sum("count").alias("count"), F.any_value("n_terms").alias("n_terms"))
    totals = whole.groupBy("lang").agg(F.sum("count").alias("total"))
    whole = whole.join(F.broadcast(totals), "lang").select("lang", "term", _p("count", "total", "n_terms").alias("q"))
    return counts.join(whole, ["lang", "term"]).where("p > q").select("lang", "source", F.col("term").alias("item"), _f("p", "q").alias("value"))


def audited(documents: DataFrame, least: int = LEAST_DOCUMENTS, ranks: int = TERM_RANKS) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    groups, counts = measured(documents, least)
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pair_values(groups, counts).withColumn("rank", place).withColumn("part", F.lit("pair"))
    terms = term_values(counts).withColumn("rank", place).where(F.col("rank") <= ranks).withColumn("part", F.lit("term"))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")


DIVERGENCE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
o AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT o.lang, o.source, o.term, count(*) AS c FROM o JOIN k ON k.lang = o.lang AND k.term = o.term GROUP BY o.lang, o.source, o.term),
n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
             1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.c, 0) + 2) // (coalesce(n.n, 0) + 2 * v.v) AS p
      FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (SELECT a.lang, a.term, 1 + CAST(1000000000 AS HUGEINT) * (a.c + 2) // (b.n + 2 * v.v) AS q
      FROM (SELECT lang, term, sum(c) AS c FROM c GROUP BY lang, term) AS a JOIN (SELECT lang, sum(c) AS n FROM c GROUP BY lang) AS b ON b.lang = a.lang JOIN v ON v.lang = a.lang),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN (SELECT y.lang, y.source, z.source AS item, sum((y.p - z.p) * (y.p - z.p) // (y.p + z.p)) AS value FROM p AS y JOIN p AS z ON y.lang = z.lang AND y.term = z.term AND y.source <> z.source GROUP BY y.lang, y.source, z.source) AS x
      ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT p.lang, p.source, p.term AS item, (p.p - q.q) * (p.p - q.q) // (p.p + q.q) AS value FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.c > 0 AND p.p > q.q)
SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
UNION ALL
SELECT * FROM (SELECT lang, source, 'term' AS part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM terms) AS t WHERE rank <= 10
"""
