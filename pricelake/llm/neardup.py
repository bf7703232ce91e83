"""Near-duplicate groups from SetSketch registers, verified on full shingle sets.

A document's set holds its distinct 5-word shingles (A-Z lower-cased; all words as one shingle if
there are fewer than five). Its sketch has ``REGISTERS`` registers: the minimum of an exponential
variable over the set, truncated to a power of ``BASE``; the register-wise maximum of two sketches
is the sketch of the union. ``BANDS`` bands of five registers name the buckets in which documents
meet; a pair at the threshold shares no bucket with a probability of about two in a million. For a
pair that meets, similarity is first estimated by maximum likelihood over the counts of larger,
smaller and equal registers given both set sizes; pairs estimated ``MARGIN`` (over six standard
errors) below the threshold go no further. The others are confirmed on the full sets.

Large groups stay linear. Documents with equal sets become one class first, and only the smallest
id of a class is compared. In a bucket, every class is compared with the smallest and then with
the largest id only; connected components of the confirmed links follow. Members of a bucket that
still lie in different components are reduced to those that can reach the threshold at all with the
shingles that other components hold too. Each is then compared with the most central member of its
buckets, which gathers edited copies whose smallest and largest ids are edited most; such rounds go
on while they halve what is left. The few that remain meet by prefix filtering on whole sets, so that no link is lost.

Defined cases: null or blank texts have empty sets and stay alone; rows that share an id are one
document (the union of their sets), which each of them returns; a null id stays alone; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, lower_ascii, small_batches, spent, words_of, written

SHINGLE, PERCENT = 5, 75
BAND_ROWS, BANDS, BASE = 5, 48, 1.1
REGISTERS = BAND_ROWS * BANDS
#: How far below the threshold an estimate must lie for a pair to be dropped unverified.
MARGIN = 0.2
#: Ids that may be broadcast to filter texts, and facts of classes (about 30 MB each); more are joined by a shuffle.
BROADCAST_IDS, BROADCAST_FACTS = 500_000, 200_000
#: Words whose hashes a task remembers (about 25 MB).
CACHE = 150_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_ODD = (np.random.default_rng(20).integers(1, 1 << 31, (2, REGISTERS), dtype=np.uint32) * np.uint32(2) + np.uint32(1)).astype(np.uint32)


class Shingler:
    """64-bit hashes of word shingles; remembers hashes of words."""

    def __init__(self, size: int = SHINGLE):
        self.size, self.known = size, {}

    def hashes(self, words: list[str]) -> np.ndarray:
        """Sorted distinct shingle hashes."""
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        new = set(words).difference(known)
        if new:
            if len(known) > CACHE:
                known.clear()
                new = set(words)
            known.update((w, xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))) for w in new)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        width = min(self.size, len(h))
        out = np.full(len(h) - width + 1, len(h) if len(h) < self.size else self.size, np.uint64)
        for i in range(width):
            out = (out ^ h[i : len(h) - width + 1 + i]) * _MIX
            out ^= out >> np.uint64(29)
        return np.unique(out)

    def of(self, text: str | None) -> np.ndarray:
        return self.hashes(words_of(lower_ascii(text)) if text else [])


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch registers, one row a set: 255 steps of BASE below the largest value; empty sets have zeros."""
    out = np.zeros((len(sets), REGISTERS), np.uint8)
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return out
    flat = np.concatenate([sets[i] for i in full])
    short = (flat ^ (flat >> np.uint64(32))).astype(np.uint32)
    sizes = np.array([len(sets[i]) for i in full])
    starts = np.cumsum(sizes) - sizes
    low = np.empty((REGISTERS, len(full)), np.uint32)
    for k in range(REGISTERS):
        h = short * _ODD[0, k]
        h ^= h >> np.uint32(16)
        h *= _ODD[1, k]
        low[k] = np.minimum.reduceat(h, starts)
    exponential = -np.log1p(-(low.T.astype(np.float64) + 0.5) / 2.0**32)
    out[full] = np.clip(np.floor(20 - np.log(exponential) / np.log(BASE)), 1, 255).astype(np.uint8)
    return out


def merged(sketches: np.ndarray) -> np.ndarray:
    """The sketch of a union."""
    return sketches.max(0)


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Similarities of pairs of sketches with known set sizes, by maximum likelihood on a grid of hundredths."""
    above, below = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    equal = REGISTERS - above - below
    u = (size_a / (size_a + size_b))[:, None]
    v = 1 - u
    j = np.arange(0, 101)[None] / 100 * np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 1e-9, 1) * (BASE - 1) / BASE) / np.log(BASE)
    more, less = p(u - v * j), p(v - u * j)
    likelihood = above * np.log(more) + below * np.log(less) + equal * np.log(np.clip(1 - more - less, 1e-9, 1))
    return np.take_along_axis(j, likelihood.argmax(1)[:, None], 1)[:, 0]


def sketched(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest of the set, sketch."""
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]):
        shingler = Shingler()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for i, j in chunks(texts, [len(t or "") for t in texts], 600_000):
                sets = [shingler.of(t) for t in texts[i:j]]
                sketch = registers(sets)
                yield pa.RecordBatch.from_arrays([ids[i:j], pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([r.tobytes() for r in sketch], pa.binary())], ["doc_id", "n_shingles", "digest", "sketch"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, digest binary, sketch binary")


def bands(sketches: DataFrame) -> DataFrame:
    """doc_id and the bucket of every band."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            n = batch.num_rows
            if n:
                r = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(n, BANDS, BAND_ROWS).astype(np.uint64)
                key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64)[None], (n, BANDS)) * _MIX
                for k in range(BAND_ROWS):
                    key = (key ^ r[:, :, k]) * _MIX
                    key ^= key >> np.uint64(31)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), BANDS)), pa.array(key.view(np.int64).ravel())], ["doc_id", "bucket"])

    return sketches.select("doc_id", "sketch").mapInArrow(run, "doc_id long, bucket long")


def likely(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs (a, b) whose estimate leaves the threshold within reach."""
    s = sketches.select("doc_id", "n_shingles", "sketch")
    both = pairs.join(s.toDF("a", "n_a", "s_a"), "a").join(s.toDF("b", "n_b", "s_b"), "b").where("100 * least(n_a, n_b) >= 75 * greatest(n_a, n_b)")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("s_a", "s_b"))
                near = estimate(x, y, *(batch.column(c).to_numpy().astype(float) for c in ("n_a", "n_b"))) >= PERCENT / 100 - MARGIN
                yield batch.select(["a", "b"]).filter(pa.array(near))

    return both.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, documents: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold; texts are read for the ids in pairs only."""
    texts = texts_of(documents, written(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "ids"))
    both = pairs.join(texts.toDF("a", "t_a"), "a").join(texts.toDF("b", "t_b"), "b").select("a", "b", "t_a", "t_b")

    def run(batches: Iterator[pa.RecordBatch]):
        shingler, last, right = Shingler(), None, np.zeros(0, np.uint64)
        for batch in batches:
            near = []
            for b, x, y in zip(*(batch.column(c).to_pylist() for c in ("b", "t_a", "t_b")), strict=True):
                if b != last:
                    last, right = b, shingler_union(shingler, y)
                left = shingler_union(shingler, x)
                shared = len(np.intersect1d(left, right, assume_unique=True))
                near.append(100 * shared >= PERCENT * (len(left) + len(right) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """doc_id, shingles from doc_id, texts."""

    def run(batches: Iterator[pa.RecordBatch]):
        shingler = Shingler()
        for batch in batches:
            sets = [shingler_union(shingler, t).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "shingles"])

    return texts.select("doc_id", "texts").mapInArrow(run, "doc_id long, shingles array<long>")


def shareable(sets: DataFrame, placed: DataFrame) -> DataFrame:
    """From sets (doc_id, shingles) and placed (doc_id, component): doc_id, component, n, common (shingles that another component holds too), and first (those of which a link to another component needs one).

    Prefix filtering over whole sets: in any common order, a set of n shingles and one that shares
    three quarters of them meet in their first n - ceil(0.75 n) + 1. Shingles that only one component
    holds stand first in the order and cannot meet, the others follow by frequency, so edited copies
    with many shingles of their own need no comparison at all.
    """
    each = sets.join(placed, "doc_id").select("doc_id", "component", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    across = each.groupBy("shingle").agg(F.min("component").alias("c_low"), F.max("component").alias("c_high"), F.count("*").alias("times")).where("c_low < c_high").select("shingle", "times")
    common = each.join(across, "shingle").groupBy("doc_id", "component", "n").agg(F.sort_array(F.collect_list(F.struct("times", "shingle"))).alias("common"))
    # All n shingles less those that must be shared, plus one, less those of this component alone.
    n, common_n = F.col("n"), F.size("common")
    left = n - F.ceil(n * PERCENT / 100) + 1 - (n - common_n)
    shingles = F.transform("common", lambda x: x["shingle"])
    enough = (left > 0) & (100 * common_n >= PERCENT * n)
    return common.where(enough).select("doc_id", "component", "n", shingles.alias("common"), F.slice(shingles, F.lit(1), left.cast("int")).alias("first"))


def shingler_union(shingler: Shingler, texts: list[str | None]) -> np.ndarray:
    sets = [shingler.of(t) for t in texts]
    return sets[0] if len(sets) == 1 else np.unique(np.concatenate(sets))


def components(edges: DataFrame) -> DataFrame:
    """doc_id, component (smallest id) of all ids in edges (a, b), by alternating large and small stars."""
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        e = written(small.where("u <> v").distinct(), "stars")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return e.select(F.col("u").alias("doc_id"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
        state = now


def texts_of(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and the array of its texts, for ids only."""
    few = ids.count() <= BROADCAST_IDS
    chosen = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    return chosen.groupBy("doc_id").agg(F.collect_list("text").alias("texts"))


def untested(members: DataFrame, whole: DataFrame, ends: list[str]) -> DataFrame:
    """Members (doc_id, bucket, high) with their component, other than the ends that all were compared with, of buckets where they lie in several components."""
    rest = members.where(" AND ".join(f"doc_id <> {end}" for end in ends))
    placed = rest.join(whole, "doc_id", "left").select("doc_id", "bucket", "high", F.coalesce("component", "doc_id").alias("component"))
    if len(ends) > 1:
        mixed = placed.groupBy("bucket").agg(F.min("component").alias("c_low"), F.max("component").alias("c_high")).where("c_low < c_high").select("bucket")
        placed = placed.join(mixed, "bucket", "left_semi")
    return written(placed, "untested")


def central_pairs(placed: DataFrame, facts: DataFrame, tested: DataFrame | None) -> DataFrame:
    """Each member with the most central one (by its share of common shingles) that stands first in a bucket of its own, lies in another component and was not tested yet: a pair a member at most."""
    share = F.size("common") / F.col("n")
    members = placed.select("doc_id", "bucket").join(facts.select("doc_id", "component", share.alias("share")), "doc_id")
    pivots = members.groupBy("bucket").agg(F.max(F.struct("share", F.col("doc_id").alias("y"), F.col("component").alias("c_y"))).alias("pivot"))
    met = members.join(pivots, "bucket").where("component <> pivot.c_y").select(F.col("doc_id").alias("x"), F.col("pivot.y").alias("y"), "pivot.share")
    if tested is not None:
        met = met.join(tested, ["x", "y"], "left_anti")
    return met.groupBy("x").agg(F.max_by("y", F.struct("share", "y")).alias("y"))


def prefix_pairs(facts: DataFrame) -> DataFrame:
    """Pairs (x, y) of different components that share one of their first shingles, where sizes and places allow a link.

    All that two sets share stands at or after the first shingle they share, in both of them, so
    its places bound the intersection.
    """
    keys = written(facts.select("doc_id", "component", F.col("n").cast("int").alias("n"), F.size("common").alias("c"), F.posexplode("first").alias("place", "shingle")), "keys")
    other = keys.toDF(*(c if c == "shingle" else f"{c}_b" for c in keys.columns))
    most = F.least(F.col("c") - F.col("place"), F.col("c_b") - F.col("place_b"))
    met = keys.join(other, "shingle").where("component < component_b").where(100 * most >= PERCENT * (F.col("n") + F.col("n_b") - most))
    return met.select(F.col("doc_id").alias("x"), F.col("doc_id_b").alias("y")).distinct()


def linked(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """Pairs (x, y) of different components whose full sets reach the threshold, as (a, b): they share nothing but what is called common."""
    sets = facts.select("doc_id", "n", "common")
    both = pairs.join(sets.toDF("x", "n_x", "c_x"), "x").join(sets.toDF("y", "n_y", "c_y"), "y")
    shared = F.size(F.array_intersect("c_x", "c_y"))
    return both.where(100 * shared >= PERCENT * (F.col("n_x") + F.col("n_y") - shared)).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, class_id (smallest id with the same set), n_links for every document."""
    sketches = written(sketched(documents), "sketches")
    repeated = sketches.groupBy("doc_id").agg(F.count("*").cast("int").alias("times")).where("times > 1 AND doc_id IS NOT NULL")
    some_repeat = repeated.limit(1).count() > 0
    if some_repeat:
        repeated = written(repeated, "repeated")
        again = texts_of(documents, repeated.select("doc_id"))
        single = sketches
        sketches = written(single.join(repeated, "doc_id", "left_anti").unionByName(sketched_unions(again)), "sketches")
        spent(single)
    # Equal sets have equal sketches, so any one stands for the class.
    classes = sketches.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("digest", "n_shingles").agg(F.min("doc_id").alias("doc_id"), F.any_value("sketch").alias("sketch"), F.count("*").alias("copies"))
    first = written(classes, "classes")

    buckets = bands(first)
    shared = buckets.groupBy("bucket").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    members = written(buckets.join(shared, "bucket"), "buckets")
    tested = written(likely(members.where("doc_id > low").select(F.col("doc_id").alias("a"), F.col("low").alias("b")).distinct(), first), "pairs")
    links = written(verified(tested, documents), "links")
    whole = components(links)

    def extended(more: DataFrame) -> None:
        nonlocal links, whole
        if more.limit(1).count():
            links = links.unionByName(more)
            whole = components(links)

    placed = untested(members, whole, ["low"])
    ends = placed.where("doc_id = high").select("bucket", F.col("component").alias("c_high"))
    pairs = placed.where("doc_id < high").join(ends, "bucket").where("component <> c_high").select(F.col("doc_id").alias("a"), F.col("high").alias("b")).distinct()
    done = tested.select(F.col("b").alias("a"), F.col("a").alias("b"))
    second = written(likely(pairs, first).join(done, ["a", "b"], "left_anti"), "pairs")
    if second.limit(1).count():
        extended(written(verified(second, documents), "links"))
    spent(placed, tested, second)
    placed = untested(members, whole, ["low", "high"])
    sets = before = compared = None
    while placed.limit(1).count():
        if sets is None:
            sets = written(shingle_sets(texts_of(documents, written(placed.select("doc_id").distinct(), "ids"))), "shingles")
        facts = written(shareable(sets, placed.select("doc_id", "component").distinct()), "shareable")
        now = facts.count()
        # Rounds with central members go on while they halve what is left.
        last = before is not None and 2 * now > before
        pairs = written(prefix_pairs(facts) if last else central_pairs(placed, facts, compared), "pairs")
        extended(written(linked(pairs, facts), "links"))
        if last or not now:
            break
        before, compared = now, pairs if compared is None else compared.unionByName(pairs)
        placed = untested(members.join(facts.select("doc_id"), "doc_id", "left_semi"), whole, ["low", "high"])
    spent(members, *([sets] if sets is not None else []))

    n_links = links.select(F.col("a").alias("doc_id")).union(links.select("b")).groupBy("doc_id").agg(F.count("*").alias("n_links"))
    # Texts without copies and links need no facts: they are components of their own.
    facts = first.select("digest", "n_shingles", "doc_id", "copies").join(whole, "doc_id", "left").join(n_links, "doc_id", "left").where("copies > 1 OR component IS NOT NULL")
    facts = written(facts.select("digest", F.col("n_shingles").alias("__n"), F.col("doc_id").alias("class_id"), F.coalesce("component", "doc_id").alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "facts")
    spent(first)
    facts = F.broadcast(facts) if facts.count() <= BROADCAST_FACTS else facts
    out = sketches.select("doc_id", "n_shingles", "digest").join(facts, (sketches["digest"] == facts["digest"]) & (F.col("n_shingles") == F.col("__n")) & F.col("doc_id").isNotNull(), "left")
    if some_repeat:
        out = out.join(repeated, "doc_id", "left").withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.coalesce("times", F.lit(1)))))
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def sketched_unions(texts: DataFrame) -> DataFrame:
    """sketched() of ids with several texts."""

    def run(batches: Iterator[pa.RecordBatch]):
        shingler = Shingler()
        for batch in batches:
            sets = [shingler_union(shingler, t) if t else np.zeros(0, np.uint64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([r.tobytes() for r in registers(sets)], pa.binary())], ["doc_id", "n_shingles", "digest", "sketch"])

    return texts.mapInArrow(run, "doc_id long, n_shingles long, digest binary, sketch binary")


NEAR_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i : array_to_string(w[i:i + 4], ' ')) END) AS g FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT p.a, p.b FROM p JOIN n AS x ON x.doc_id = p.a JOIN n AS y ON y.doc_id = p.b WHERE 100 * p.k >= 75 * (x.n + y.n - p.k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, c.doc_id = c.component_id AS kept FROM c LEFT JOIN n ON n.doc_id = c.doc_id
"""
