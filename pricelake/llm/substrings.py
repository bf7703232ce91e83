"""Substring deduplication with prefix-partitioned suffix trees.

A word is removed if it lies in a window of ``WINDOW`` words whose sequence also starts earlier
(smaller document id, or same document and earlier start). Every window is a suffix of its text, cut
at ``WINDOW`` words: what a deeper node of the whole tree would remove, the windows inside that
repeat remove one by one.

Only suffixes that can repeat enter the tree: the smallest hash of the 6-word grams of a window (its
anchor) is the same wherever the window stands, so a window whose anchor occurs once in the corpus
is unique and stays out. Documents with the same words as an earlier one are settled beforehand.

Partitioning: suffixes are dealt into groups by the hash of their first ``PREFIXES[0]`` words. The
suffixes of every group are counted over the whole table; a group of more than ``GROUP_ROWS`` is
split by the next longer prefix and counted again, until all fit. Equal windows cannot be split by
any prefix, so what is still too large at the full length is merged in salted parts first. The table
of split groups is broadcast; it holds at most one entry of 24 bytes for 32 MB of suffixes.

In a group, suffixes are sorted by their words (16-bit codes, and a 64-bit hash of the whole window
that tells apart what codes do not). Common-prefix lengths of neighbours give the internal nodes of
the subtree; those at the depth of a window are the repeats, and every leaf but the earliest marks a
window to remove. A task first merges the equal suffixes of its own texts, so that a passage in a
third of all documents reaches a group once a batch.

Defined cases: a null or blank text has no words and keeps the hash of the empty string; rows that
share an id compare by their start alone, so neither of two equal rows removes the other; a null id
counts as the largest; very long texts are cut into words in one task, batches close at 4 million
characters; extra columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import GROUP_BYTES, chunks, parts, small_batches, spent, words_of, written

WINDOW, GRAM = 20, 6
#: Lengths of the prefixes, in words, by which suffixes are split in turn; the last is the window.
PREFIXES = (5, 10, 15, 20)
#: Ids or groups of copies that may be broadcast (about 30 MB); more are joined by a shuffle.
BROADCAST_IDS, BROADCAST_COPIES = 500_000, 150_000
#: Words whose hashes a task remembers (about 25 MB).
CACHE = 150_000
LAST = (1 << 63) - 1
SUFFIX = np.dtype([("words", ">u2", (WINDOW,)), ("full", "<u8"), ("doc", "<i8"), ("row", "<i4"), ("start", "<i4")])
#: A run of windows to remove, at consecutive starts.
FLAG = np.dtype([("doc", "<i8"), ("row", "<i4"), ("start", "<i4"), ("windows", "<i4")])
#: Suffixes that one group should hold.
GROUP_ROWS = GROUP_BYTES // SUFFIX.itemsize
_MIX = np.uint64(0x9E3779B97F4A7C15)
EMPTY = hashlib.sha256(b"").digest()


class WordHashes:
    """64-bit hashes of words, remembered."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, words: list[str]) -> np.ndarray:
        new = set(words).difference(self.known)
        if new:
            if len(self.known) > CACHE:
                self.known.clear()
                new = set(words)
            self.known.update((w, xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))) for w in new)
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))


def _with(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = (a ^ (b * _MIX + np.uint64(1))) * _MIX
    return out ^ (out >> np.uint64(29))


def grams(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of size words."""
    out = np.full(max(0, len(h) - size + 1), size, np.uint64)
    for i in range(size if len(out) else 0):
        out = (out ^ h[i : i + len(out)]) * _MIX
        out ^= out >> np.uint64(29)
    return out


def prefixes(h: np.ndarray) -> list[np.ndarray]:
    """Hashes of the first 5, 10, 15 and 20 words of every window."""
    n = len(h) - WINDOW + 1
    step = grams(h, PREFIXES[0])
    out = [step]
    for length in PREFIXES[1:]:
        at = length - PREFIXES[0]
        out.append(_with(out[-1][: len(step) - at], step[at:]))
    return [x[:n] for x in out]


def anchors(h: np.ndarray) -> np.ndarray:
    """The smallest gram hash of every window."""
    g, n, span = grams(h, GRAM), len(h) - WINDOW + 1, WINDOW - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    width = 1
    while width * 2 <= span:
        g = np.minimum(g[:-width], g[width:])
        width *= 2
    return np.minimum(g[:n], g[span - width : span - width + n])


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    sizes = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate([*arrays, np.zeros(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat))


def profiled(documents: DataFrame) -> DataFrame:
    """doc (null ids last), row, n_words, sha of the joined words; open: anchors met once so far; held: anchors met again in the batch; told: those of them that this row makes known.

    Of texts with the same words in a batch, only the one with the smallest id has anchors.
    """
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]):
        hashes = WordHashes()
        for batch in batches:
            ids, every = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for i, j in chunks(every, [len(t or "") for t in every], 4_000_000):
                counts, shas, own, twice = [], [], [], []
                least: dict[bytes, int] = {}
                split = [words_of(t) for t in every[i:j]]
                for k, words in enumerate(split):
                    counts.append(len(words))
                    shas.append(sha := hashlib.sha256(" ".join(words).encode("utf-8", "surrogatepass")).digest())
                    if sha not in least or ids[i + k] < ids[i + least[sha]]:
                        least[sha] = k
                for k, words in enumerate(split):
                    h = hashes(words) if len(words) >= WINDOW and ids[i + least[shas[k]]] == ids[i + k] else np.zeros(0, np.uint64)
                    mine = np.unique(anchors(h))
                    own.append(mine)
                    g = grams(h, GRAM) if len(mine) else mine
                    at = np.minimum(np.searchsorted(mine, g), max(len(mine) - 1, 0))
                    times = np.bincount(at[mine[at] == g], minlength=len(mine)) if len(mine) else np.zeros(0)
                    twice.append(times > 1)
                flat, again = np.concatenate(own), np.concatenate(twice)
                values, inverse, times = np.unique(flat, return_inverse=True, return_counts=True)
                many = times > 1
                many[inverse[again]] = True
                first = np.zeros(len(flat), bool)
                first[np.unique(inverse, return_index=True)[1]] = True
                met = many[inverse]
                cut = np.cumsum([len(x) for x in own])[:-1]
                columns = [[x[m] for x, m in zip(np.split(flat, cut), np.split(mask, cut), strict=True)] for mask in (~met, met, met & first)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i:j], batch.column(1)[i:j], pa.array(counts, pa.int64()), pa.array(shas, pa.binary()), *map(_lists, columns)],
                    ["doc", "row", "n_words", "sha", "open", "held", "told"],
                )

    return _keyed(documents).mapInArrow(run, "doc long, row int, n_words long, sha binary, open array<long>, held array<long>, told array<long>")


def _keyed(documents: DataFrame) -> DataFrame:
    """doc, row (a hash of the text that tells rows with one id apart), text."""
    return documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.hash("text").alias("row"), "text")


def common_lengths(s: np.ndarray) -> np.ndarray:
    """Words that each suffix but the first shares with the one before it."""
    same = s["words"][1:] == s["words"][:-1]
    out = np.where(same.all(1), WINDOW, same.argmin(1))
    # Windows whose codes agree but not the hash of the whole differ in some word; the last will do.
    out[(out == WINDOW) & (s["full"][1:] != s["full"][:-1])] = WINDOW - 1
    return out


def nodes(lengths: np.ndarray, least: int = 1) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Internal nodes of the tree over sorted suffixes, by depth from least on: depth, first leaf and last leaf of each.

    Neighbours that share at least so many words lie under one node; it has this very depth if some
    of them share no more.
    """
    for depth in range(least, WINDOW + 1):
        inside = np.concatenate([[False], lengths >= depth, [False]]).astype(np.int8)
        edge = np.diff(inside)
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(first):
            exact = np.add.reduceat(np.append(lengths == depth, False), np.column_stack([first, last]).ravel())[::2] > 0
            yield depth, first[exact], last[exact]


def by_words(s: np.ndarray) -> np.ndarray:
    """Suffixes in the order of their words, equal ones by document and start."""
    words = np.ascontiguousarray(s["words"]).view(f"S{2 * WINDOW}").ravel()
    return s[np.lexsort((s["start"], s["doc"], s["full"], words))]


def later(s: np.ndarray) -> np.ndarray:
    """Which of sorted suffixes are leaves of a node as deep as the window, other than its earliest."""
    out = np.zeros(len(s), bool)
    if len(s) > 1:
        for _, first, last in nodes(common_lengths(s), WINDOW):
            size = last - first + 1
            head = np.repeat(first, size)
            leaf = head + np.arange(len(head)) - np.repeat(np.cumsum(size) - size, size)
            out[leaf] = (s["doc"][leaf] != s["doc"][head]) | (s["start"][leaf] != s["start"][head])
    return out


def _packed(s: np.ndarray) -> bytes:
    """The records of a pack column by column, in the order of documents and starts, so that the shuffle's compression finds equal bytes."""
    return b"".join(np.ascontiguousarray(s[c]).tobytes() for c in SUFFIX.names)


def _unpacked(pack: bytes) -> np.ndarray:
    s, at = np.zeros(len(pack) // SUFFIX.itemsize, SUFFIX), 0
    for c in SUFFIX.names:
        kind = SUFFIX[c]
        s[c] = np.frombuffer(pack, kind.base, len(s) * (kind.itemsize // kind.base.itemsize), at).reshape(len(s), *kind.shape)
        at += len(s) * kind.itemsize
    return s


def _split(s: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The groups that occur, and the records of each by document and start."""
    order = np.lexsort((s["start"], s["doc"], group))
    group, s = group[order], s[order]
    cut = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(s) else np.zeros(0, int)
    return group[cut], np.split(s, cut[1:]) if len(s) else []


def flags(s: np.ndarray, buckets: int) -> tuple[np.ndarray, list[bytes]]:
    """Runs of flagged windows, packed by bucket of documents."""
    s = s[np.lexsort((s["start"], s["row"], s["doc"]))]
    new = np.append(True, (s["doc"][1:] != s["doc"][:-1]) | (s["row"][1:] != s["row"][:-1]) | (s["start"][1:] - s["start"][:-1] > 1))[: len(s)]
    first = np.flatnonzero(new)
    f = np.zeros(len(first), FLAG)
    for c in ("doc", "row", "start"):
        f[c] = s[c][first]
    f["windows"] = s["start"][np.append(first[1:], len(s)) - 1] - f["start"] + 1 if len(s) else 0
    mixed = (f["doc"].astype(np.uint64) * _MIX) >> np.uint64(20)
    group, runs = _split(f, (mixed % np.uint64(buckets)).astype(np.int64))
    return group, [x.tobytes() for x in runs]


def runs_of_texts(group: pa.Table) -> pa.Table:
    """doc, row, runs (start, windows) from the flags of one bucket of documents, a row for each text."""
    s = np.unique(np.frombuffer(b"".join(group.column("flags").to_pylist()), FLAG))
    cut = np.flatnonzero(np.append(True, (s["doc"][1:] != s["doc"][:-1]) | (s["row"][1:] != s["row"][:-1]))) if len(s) else np.zeros(0, int)
    runs = [np.column_stack([x["start"], x["windows"]]).astype("<i4").tobytes() for x in np.split(s, cut[1:])] if len(s) else []
    return pa.table({"doc": pa.array(s["doc"][cut]), "row": pa.array(s["row"][cut]), "runs": pa.array(runs, pa.binary())})


class Groups:
    """Deals suffixes to groups by prefixes: first buckets of the shortest, then splits of the groups named in each level."""

    def __init__(self, buckets: int):
        self.buckets, self.levels = buckets, []

    def split(self, groups: dict[int, int]) -> None:
        """Splits groups (with the number of parts of each) by the next longer prefix."""
        ids = np.array(sorted(groups), np.int64)
        self.levels.append((ids, np.array([groups[g] for g in ids.tolist()], np.uint64)))

    def of(self, hashes: list[np.ndarray]) -> np.ndarray:
        """Groups (0 or more) of suffixes from the hashes of their prefixes."""
        group = ((hashes[0] >> np.uint64(11)) % np.uint64(self.buckets)).astype(np.int64)
        for (ids, parts_of), h in zip(self.levels, hashes[1:], strict=False):
            at = np.minimum(np.searchsorted(ids, group), len(ids) - 1)
            hit = ids[at] == group
            part = (h[hit] >> np.uint64(11)) % parts_of[at[hit]]
            group[hit] = (_with(group[hit].astype(np.uint64), part) >> np.uint64(1)).astype(np.int64)
        return group


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray]]:
    """From doc, row, text, held: suffixes, hashes of their prefixes, and which of them are not the earliest of their window in the batch."""
    hashes = WordHashes()
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("doc", "row", "text")]
        held = batch.column("held")
        for i, j in chunks(columns[2], [len(t or "") for t in columns[2]], 4_000_000):
            found, levels = [], []
            for k in range(i, j):
                h = hashes(words_of(columns[2][k]))
                mine = np.sort(held[k].values.to_numpy(zero_copy_only=False).view(np.uint64))
                own = anchors(h)
                at = np.flatnonzero(mine[np.minimum(np.searchsorted(mine, own), len(mine) - 1)] == own) if len(mine) else np.zeros(0, int)
                if not len(at):
                    continue
                s = np.zeros(len(at), SUFFIX)
                s["words"] = np.lib.stride_tricks.sliding_window_view((h >> np.uint64(48)).astype(np.uint16), WINDOW)[at]
                every = prefixes(h)
                s["full"], s["doc"], s["row"], s["start"] = every[-1][at], columns[0][k], columns[1][k], at
                found.append(s)
                levels.append([x[at] for x in every])
            if found:
                s = np.concatenate(found)
                order = np.lexsort((s["start"], s["doc"], s["full"]))
                s = s[order]
                new = np.append(True, (s["full"][1:] != s["full"][:-1]) | (s["words"][1:] != s["words"][:-1]).any(1))
                head = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
                again = (s["doc"] != s["doc"][head]) | (s["start"] != s["start"][head])
                yield s, [np.concatenate(x)[order] for x in zip(*levels, strict=True)], again


def counted(texts: DataFrame, groups: Groups) -> dict[int, int]:
    """Groups of more than GROUP_ROWS suffixes, and how many they hold."""

    def run(batches: Iterator[pa.RecordBatch]):
        for _, hashes, again in _suffixes(batches):
            group, n = np.unique(groups.of(hashes)[~again], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(n.astype(np.int64))], ["group", "n"])

    found = texts.mapInArrow(run, "group long, n long").groupBy("group").agg(F.sum("n").alias("n")).where(F.col("n") > GROUP_ROWS)
    return {r["group"]: r["n"] for r in found.collect()}


def grouped(texts: DataFrame, buckets: int) -> tuple[Groups, dict[int, int]]:
    """The groups, lengthened prefix by prefix, and the salts of those that no prefix splits."""
    groups = Groups(buckets)
    for _ in PREFIXES[1:]:
        over = counted(texts, groups)
        if not over:
            return groups, {}
        groups.split({g: 2 * n // GROUP_ROWS + 1 for g, n in over.items()})
    return groups, {g: n // GROUP_ROWS + 1 for g, n in counted(texts, groups).items()}


SHIPPED = "group long, salt long, suffixes binary, bucket long, flags binary"


def dealt(texts: DataFrame, groups: Groups, salts: dict[int, int], buckets: int) -> DataFrame:
    """From doc, row, text, held: suffixes packed by group and salt (-1: the group has none), and the flags settled in the batch packed by bucket of documents."""

    def run(batches: Iterator[pa.RecordBatch]):
        for turn, (s, hashes, again) in enumerate(_suffixes(batches)):
            bucket, done = flags(s[again], buckets)
            group, held = _split(s[~again], groups.of(hashes)[~again])
            suffixes = list(map(_packed, held))
            n, m = len(group), len(bucket)
            salt = [(xxhash.xxh64_intdigest(x[:64]) + turn) % salts[g] if g in salts else -1 for g, x in zip(group.tolist(), suffixes, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([group, -1 - bucket])), pa.array([*salt, *[-1] * m], pa.int64()), pa.array([*suffixes, *[None] * m], pa.binary()), pa.array([*[None] * n, *bucket.tolist()], pa.int64()), pa.array([*[None] * n, *done], pa.binary())],
                ["group", "salt", "suffixes", "bucket", "flags"],
            )

    return texts.mapInArrow(run, SHIPPED)


def subtrees(buckets: int, merge: bool = False):
    """What finds the windows to remove in one group; merge also returns the suffixes that stay."""

    def run(group: pa.Table) -> pa.Table:
        settled = group.filter(group.column("suffixes").is_null())
        s = by_words(np.concatenate([np.zeros(0, SUFFIX), *(_unpacked(x) for x in group.column("suffixes").to_pylist() if x)]))
        gone = later(s)
        bucket, done = flags(s[gone], buckets)
        out = {"bucket": [*settled.column("bucket").to_pylist(), *bucket.tolist()], "flags": [*settled.column("flags").to_pylist(), *done]}
        if merge:
            g, rest = group.column("group")[0].as_py(), s[~gone]
            n = len(out["bucket"])
            out = {"group": [*(-1 - b for b in out["bucket"]), g], "salt": [-1] * (n + 1), "suffixes": [*[None] * n, _packed(rest)], "bucket": [*out["bucket"], None], "flags": [*out["flags"], None]}
        types = {"flags": pa.binary(), "suffixes": pa.binary()}
        return pa.table({c: pa.array(x, types.get(c, pa.int64())) for c, x in out.items()})

    return run


def marked(texts: DataFrame, size: int) -> DataFrame:
    """doc, row, runs (packed) of the windows to remove, from doc, row, text, held (anchors that repeat, size in all)."""
    spark = texts.sparkSession
    # About one anchor in eight words, so about eight suffixes for an anchor; groups start at a quarter of what they may hold at most, and several share a partition.
    partitions, buckets = (max(parts(spark), size * 8 * kind.itemsize // GROUP_BYTES + 1) for kind in (SUFFIX, FLAG))
    groups, salts = grouped(texts, 4 * partitions)
    rows = dealt(texts, groups, salts, buckets)
    if salts:
        rows = written(rows, "suffixes")
        hot = F.col("salt") >= 0
        rows = rows.where(~hot).unionByName(rows.where(hot).groupBy("group", "salt").applyInArrow(subtrees(buckets, merge=True), SHIPPED))
    found = rows.repartition(partitions, "group").groupBy("group").applyInArrow(subtrees(buckets), "bucket long, flags binary")
    return found.groupBy("bucket").applyInArrow(runs_of_texts, "doc long, row int, runs binary")


def removed(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, spans (of removed words: start, end), kept_sha256 of every document."""
    profile = written(profiled(documents), "profiles")
    texts = written(profile.select("doc", "row", "n_words", "sha"), "texts")
    first = written(texts.where(f"n_words >= {WINDOW}").groupBy("sha").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("sha", "first"), "first")
    first = F.broadcast(first) if first.count() <= BROADCAST_COPIES else first
    own = profile.join(first, "sha", "left").where("first IS NULL OR doc = first")
    asked = own.select("doc", "row", F.explode("open").alias("anchor"), F.lit(1).alias("n"))
    told = profile.select(F.lit(None).cast("long").alias("doc"), F.lit(None).cast("int").alias("row"), F.explode("told").alias("anchor"), F.lit(2).alias("n"))
    known = asked.unionByName(told)
    # A batch names an anchor once, so a common one has a row for each batch.
    total = F.sum("n").over(Window.partitionBy("anchor"))
    again = known.withColumn("total", total).where("total > 1 AND doc IS NOT NULL").select("doc", "row", "anchor").unionByName(own.select("doc", "row", F.explode("held").alias("anchor")))
    repeated = written(again.groupBy("doc", "row").agg(F.collect_list("anchor").alias("held")), "anchors")
    spent(profile)
    facts = repeated.agg(F.count("*").alias("rows"), F.sum(F.size("held")).alias("anchors")).first()

    chosen = _keyed(documents)
    if facts["rows"] <= BROADCAST_IDS:
        chosen = chosen.join(F.broadcast(repeated.select("doc").distinct()), "doc", "left_semi")
    candidates = written(chosen.join(repeated, ["doc", "row"]), "candidates")
    marks = written(marked(candidates, facts["anchors"] or 0), "marks")

    def cut(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            out = []
            for doc, row, text, runs in zip(*(batch.column(c).to_pylist() for c in ("doc", "row", "text", "runs")), strict=True):
                words = words_of(text)
                edge = np.zeros(len(words) + 1, np.int64)
                at, windows = np.frombuffer(runs, "<i4").reshape(-1, 2).T
                np.add.at(edge, at, 1)
                np.add.at(edge, at + windows + (WINDOW - 1), -1)
                gone = np.cumsum(edge)[:-1] > 0
                ends = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                left = " ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
                spans = [{"start": a, "end": b} for a, b in ends.reshape(-1, 2).tolist()]
                out.append((doc, row, int(gone.sum()), spans, hashlib.sha256(left.encode("utf-8", "surrogatepass")).digest()))
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()), strict=True)], ["doc", "row", "gone", "spans", "kept"])

    cutting = candidates.select("doc", "row", "text").join(marks, ["doc", "row"])
    changed = cutting.mapInArrow(cut, "doc long, row int, gone long, spans array<struct<start:long,end:long>>, kept binary").dropDuplicates(["doc", "row"])
    changed = written(changed, "changed")
    spent(candidates)
    copy = F.coalesce(F.col("first") < F.col("doc"), F.lit(False))
    out = texts.join(first, "sha", "left").join(changed, ["doc", "row"], "left")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))
    return out.select(
        F.nullif("doc", F.lit(LAST)).alias("doc_id"),
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, whole).otherwise(F.coalesce("spans", F.array().cast("array<struct<start:long,end:long>>"))).alias("spans"),
        F.lower(F.hex(F.when(copy, F.lit(EMPTY)).otherwise(F.coalesce("kept", "sha")))).alias("kept_sha256"),
    )


CUT_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(0, len(w) - 19)) AS s, w FROM t WHERE len(w) >= 20),
g AS (SELECT doc_id, s, array_to_string(w[s + 1:s + 20], ' ') AS k FROM p),
l AS (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS n FROM g),
c AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM l WHERE n > 1),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM t WHERE len(w) > 0),
k AS (SELECT x.doc_id, count(c.i) AS gone, string_agg(x.word, ' ' ORDER BY x.i) FILTER (WHERE c.i IS NULL) AS kept
      FROM x LEFT JOIN c ON c.doc_id = x.doc_id AND c.i = x.i GROUP BY x.doc_id)
SELECT t.doc_id, CAST(len(t.w) AS BIGINT) AS n_words, CAST(coalesce(k.gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM t LEFT JOIN k ON k.doc_id = t.doc_id
"""
