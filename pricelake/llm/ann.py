"""Approximate nearest neighbours: a forest of random-projection trees and exact reranking.

Trees are grown on a bounded sample: a node splits its sample at a random place near the median of
the projections on the widest of a few random directions, until ``LEAF`` rows of the whole table are
expected in a leaf (two rows of the sample at least). Every vector is filed in one leaf of each tree.

A query walks all trees through one shared priority queue, always opening the branch whose splitting
planes it lies nearest to (the sum of squared distances to the planes crossed). It stops at a bound,
not at a count: no neighbour lies further than the radius r within which the sample alone holds
enough, and along a random direction such a neighbour lies r / sqrt(dimensions) away, as a standard
deviation. Branches beyond ``REACH`` of these stay shut. So effort follows the data at every size of
table: a few leaves where vectors cluster, most of them where they have no structure at all, for
then a near vector can lie beyond any plane.

Leaves that lie side by side in a tree form buckets sized for memory. Vectors are shipped once a tree
to their bucket, in packed rows of single precision if they came so; a query is shipped once to each
bucket with its leaves in it. There, matrix products find the rows of each leaf that may be among the
nearest, and their distances are taken exactly, in double precision. Buckets that more than ``SLICE``
queries reach are repeated for slices of the queries.

Equal vectors are one class, filed once with its smallest ids, so copies multiply nothing: of a
class, only the k + 1 smallest ids can be among k neighbours.

Defined cases: vectors that are null, zero, hold null or non-finite components, or differ in length
from the most common one take no part; null ids take no part; rows repeated whole count once; with
fewer than k candidates all are returned; extra columns are ignored, whatever their names; an empty
table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import GROUP_BYTES, parts, small_batches, written

TREES, LEAF, REACH, DIRECTIONS = 3, 256, 1.5, 8
#: Bounds of the sample that trees grow on: rows, and bytes in double precision.
SAMPLE, SAMPLE_BYTES = 20_000, 32 << 20
#: Queries that one task compares with a bucket, and at once.
SLICE, STRIP = 16_384, 128
#: Repeated vectors that may be broadcast (16 bytes each); more are joined by a shuffle.
BROADCAST_KEYS = 200_000
#: Share by which bounds are widened, far above rounding errors of double precision.
SLACK = 1e-9


class Tree:
    """Directions, offsets and children of inner nodes; a child below zero is the leaf -(child + 1)."""

    def __init__(self, rows: np.ndarray, leaf: int, seed: int):
        rng = np.random.default_rng(seed)
        normals, offsets, children, sizes = [], [], [], []

        def grow(part: np.ndarray) -> int:
            if len(part) <= leaf:
                sizes.append(len(part))
                return -len(sizes)
            # Of a few random directions, the one along which the rows differ most; half of them join two rows.
            tries = rng.normal(size=(DIRECTIONS, rows.shape[1]))
            ends = rng.choice(part, (DIRECTIONS // 2, 2))
            tries[: len(ends)] = rows[ends[:, 0]] - rows[ends[:, 1]]
            tries /= np.maximum(np.linalg.norm(tries, axis=1), 1e-12)[:, None]
            some = rows[part[:: max(1, len(part) // 512)]]
            normal = tries[(some @ tries.T).var(0).argmax()]
            side = rows[part] @ normal
            cut = np.quantile(side, rng.uniform(0.4, 0.6))
            left = side < cut
            if not left.any() or left.all():
                sizes.append(len(part))
                return -len(sizes)
            at = len(normals)
            normals.append(normal)
            offsets.append(cut)
            children.append([0, 0])
            children[at] = [grow(part[left]), grow(part[~left])]
            return at

        self.root = grow(np.arange(len(rows)))
        self.normals, self.offsets = np.array(normals).reshape(-1, rows.shape[1]), np.array(offsets)
        self.children, self.sizes = np.array(children, dtype=np.int64).reshape(-1, 2), np.array(sizes)

    def leaves(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of every row."""
        at = np.full(len(rows), self.root)
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            right = np.einsum("ij,ij->i", rows[inner], self.normals[node]) >= self.offsets[node]
            at[inner] = self.children[node, right.astype(int)]
        return -at - 1



def search(forest: list[Tree], query: np.ndarray, bound: float) -> list[tuple[int, int]]:
    """(tree, leaf) in the order of one queue over all trees, until what is left lies beyond bound."""
    sides = [t.normals @ query - t.offsets for t in forest]
    queue = [(0.0, k, t.root) for k, t in enumerate(forest)]
    heapq.heapify(queue)
    out = []
    while queue and queue[0][0] <= bound:
        margin, k, node = heapq.heappop(queue)
        while node >= 0:
            side = sides[k][node]
            near, far = forest[k].children[node][::-1] if side >= 0 else forest[k].children[node]
            heapq.heappush(queue, (margin + side * side, k, far))
            node = near
        out.append((k, -node - 1))
    return out


def grown(sample: np.ndarray, total: int, trees: int = TREES, leaf: int = LEAF) -> list[Tree]:
    share = len(sample) / max(total, 1)
    return [Tree(sample, max(2, round(leaf * share)), 100 + k) for k in range(trees)]


def radii(queries: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
    """A distance within which the sample holds k rows besides the query; infinite if it holds fewer."""
    if len(sample) <= k:
        return np.full(len(queries), np.inf)
    squares = (queries * queries).sum(1)[:, None] + (sample * sample).sum(1) - 2 * queries @ sample.T
    return np.sqrt(np.maximum(np.partition(squares, k, axis=1)[:, k], 0)) * (1 + SLACK)


def buckets_of(forest: list[Tree], total: int, rows: int) -> list[np.ndarray]:
    """The bucket of every leaf of every tree: neighbouring leaves of about rows rows in all."""
    out, first = [], 0
    for tree in forest:
        share = tree.sizes / tree.sizes.sum()
        bucket = first + ((np.cumsum(share) - share) * total / rows).astype(np.int64)
        out.append(bucket)
        first = int(bucket[-1]) + 1
    return out


def closest(queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of the k rows nearest to each query, by distance and id."""
    squares, out = (rows * rows).sum(1), []
    for start in range(0, len(queries), STRIP):
        q = queries[start : start + STRIP]
        both = (q * q).sum(1)[:, None] + squares
        # Products find the rows that may be among the k; their distances are then taken as everywhere else.
        near = both - 2 * (q @ rows.T)
        bound = np.partition(near, k - 1, axis=1)[:, k - 1, None] if len(rows) > k else np.inf
        at, row = np.nonzero(near <= bound + SLACK * both)
        score = np.zeros(len(at))
        for a, b in zip(q.T, rows.T, strict=True):
            score += (a[at] - b[row]) * (a[at] - b[row])
        score = np.sqrt(score)
        order = np.lexsort((ids[row], score, at))
        at, row, score = at[order], row[order], score[order]
        keep = np.arange(len(at)) - np.searchsorted(at, at) < k
        out.append((at[keep] + start, row[keep], score[keep]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def nearest(queries: np.ndarray, opened: list[np.ndarray], rows: np.ndarray, ids: np.ndarray, leaves: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of the k nearest rows of the leaves that each query opened."""
    order = np.argsort(leaves, kind="stable")
    sorted_leaves = leaves[order]
    query, leaf = np.repeat(np.arange(len(opened)), [len(x) for x in opened]), np.concatenate(opened)
    by_leaf = np.argsort(leaf, kind="stable")
    query, leaf = query[by_leaf], leaf[by_leaf]
    found = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
    for one in np.unique(leaf):
        held = order[slice(*np.searchsorted(sorted_leaves, [one, one + 1]))]
        asked = query[slice(*np.searchsorted(leaf, [one, one + 1]))]
        if len(held):
            at, row, score = closest(queries[asked], rows[held], ids[held], k)
            found.append((asked[at], held[row], score))
    at, row, score = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((ids[row], score, at))
    at, row, score = at[order], row[order], score[order]
    keep = np.arange(len(at)) - np.searchsorted(at, at) < k
    return at[keep], row[keep], score[keep]


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, vector, h (a hash of 96 bits) of the rows that take part."""
    v = F.col("vector")
    good = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    valid = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector")).where(F.col("vec_id").isNotNull() & v.isNotNull() & good)
    length = valid.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return valid.where(F.size("vector") == (length["n"] if length else 0)).withColumn("h", F.struct(F.xxhash64("vector").alias("a"), F.hash("vector").alias("b")))


def classes_of(valid: DataFrame, ids: int) -> tuple[DataFrame, DataFrame | None]:
    """class_id, vector and the smallest ids of each distinct vector; and of the repeated ones, vec_id, h and class_id of every row.

    Vectors that occur once, as a rule nearly all, are not shuffled.
    """
    repeated = written(valid.groupBy("h").count().where("count > 1").select("h"), "repeated")
    n = repeated.count()
    if not n:
        return valid.select(F.col("vec_id").alias("class_id"), "vector", F.array("vec_id").alias("ids")), None
    repeated = F.broadcast(repeated) if n <= BROADCAST_KEYS else repeated
    single = valid.join(repeated, "h", "left_anti").select(F.col("vec_id").alias("class_id"), "vector", F.array("vec_id").alias("ids"))
    several = valid.join(repeated, "h", "left_semi").dropDuplicates(["vec_id", "vector"])
    # The limit on ranks is applied before the shuffle too, so a common vector sends a few rows a task.
    first = several.withColumn("n", F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))).where(F.col("n") <= ids)
    classes = written(first.groupBy("vector").agg(F.min("vec_id").alias("class_id"), F.sort_array(F.collect_list("vec_id")).alias("ids"), F.any_value("h").alias("h")), "classes")
    member = several.select("vec_id", "h").join(F.broadcast(classes.select("h", "class_id")) if n <= BROADCAST_KEYS else classes.select("h", "class_id"), "h").select("vec_id", "h", "class_id")
    return single.unionByName(classes.select("class_id", "vector", "ids")), member


def _matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return np.array(pc.list_flatten(batch.column(column)).to_numpy(zero_copy_only=False)).reshape(batch.num_rows, -1)


def neighbours(vectors: DataFrame, is_query: Column, k: int = 10, trees: int = TREES, leaf: int = LEAF, reach: float = REACH) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest of every row that is_query holds for."""
    spark = vectors.sparkSession
    small_batches(spark)
    valid = valid_vectors(vectors)
    classes, member = classes_of(valid, k + 1)
    total = classes.count()
    width = len(head["vector"]) if (head := classes.select("vector").first()) else 1
    some = min(SAMPLE, SAMPLE_BYTES // (8 * width))
    sample = classes.select("class_id", "vector").orderBy(F.xxhash64("class_id", F.lit(5)), "class_id").limit(some).collect()
    points = np.array([r["vector"] for r in sorted(sample, key=lambda r: r["class_id"])], float).reshape(len(sample), width)
    forest = grown(points, total, trees, leaf) if total else []
    kind = np.dtype("<f4" if "array<float>" in dict(valid.dtypes)["vector"] else "<f8")
    bucket_rows = max(leaf, min(GROUP_BYTES // (width * kind.itemsize), total // parts(spark) + 1))
    shared = spark.sparkContext.broadcast((forest, points, buckets_of(forest, total, bucket_rows)))

    def seek(batches: Iterator[pa.RecordBatch]):
        forest, points, buckets = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            q = _matrix(batch, "vector").astype(float)
            radius = radii(q, points, k + 1)
            out = []
            for i, x in enumerate(q):
                opened: dict[int, list[int]] = {}
                for tree, n in search(forest, x, (reach * radius[i]) ** 2 / width):
                    opened.setdefault(int(buckets[tree][n]), []).append(n)
                out += [(i, b, leaves) for b, leaves in opened.items()]
            at = np.array([i for i, _, _ in out])
            raw = [x.tobytes() for x in q]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), pa.array([raw[i] for i in at], pa.binary()), pa.array([b for _, b, _ in out], pa.int64()), pa.array([x for _, _, x in out], pa.list_(pa.int32()))],
                ["query_class", "q", "bucket", "leaves"],
            )

    if member is None:
        asking = valid.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("vec_id").alias("query_class")).distinct()
    else:
        asking = valid.where(is_query).select("vec_id", "h").distinct().join(member.where(is_query).withColumnRenamed("class_id", "c"), ["vec_id", "h"], "left").select(F.col("vec_id").alias("query_id"), F.coalesce("c", "vec_id").alias("query_class")).distinct()
    asking = written(asking, "queries")
    query_classes = classes.join(asking.select(F.col("query_class").alias("class_id")).distinct(), "class_id", "left_semi").select("class_id", "vector")
    reached = written(query_classes.mapInArrow(seek, "query_class long, q binary, bucket long, leaves array<int>"), "reached")
    # A number for each bucket that many queries reach; there are as many buckets as tables of GROUP_BYTES in all trees.
    slices = {r["bucket"]: -(-r["count"] // SLICE) for r in reached.groupBy("bucket").count().where(F.col("count") > SLICE).collect()}
    of_bucket = F.coalesce(F.create_map(*(F.lit(x) for pair in slices.items() for x in pair))[F.col("bucket")], F.lit(1)) if slices else F.lit(1)
    reached = reached.withColumn("slice", F.pmod(F.xxhash64("query_class"), of_bucket).cast("int"))

    def file(batches: Iterator[pa.RecordBatch]):
        forest, _, buckets = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = _matrix(batch, "vector").astype(kind)
            ids, x, out = batch.column("class_id").to_numpy(), raw.astype(float), []
            for tree, bucket_of in zip(forest, buckets, strict=True):
                leaves = tree.leaves(x)
                bucket = bucket_of[leaves]
                order = np.argsort(bucket, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                    b = int(bucket[part[0]])
                    out += [(b, s, ids[part].tobytes(), leaves[part].astype("<i4").tobytes(), raw[part].tobytes()) for s in range(slices.get(b, 1))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["bucket", "slice", "ids", "leaves", "vectors"])

    def compare(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows or not held.num_rows:
            return pa.table({"query_class": pa.array([], pa.int64()), "class_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids, leaves, rows = (np.frombuffer(b"".join(held.column(c).to_pylist()), t) for c, t in (("ids", "<i8"), ("leaves", "<i4"), ("vectors", kind)))
        q = np.frombuffer(b"".join(asked.column("q").to_pylist())).reshape(-1, width)
        opened = [np.array(x, np.int32) for x in asked.column("leaves").to_pylist()]
        at, row, score = nearest(q, opened, rows.reshape(-1, width).astype(float), ids, leaves, k + 1)
        return pa.table({"query_class": asked.column("query_class").to_numpy()[at], "class_id": ids[row], "score": score})

    filed = classes.select("class_id", "vector").mapInArrow(file, "bucket long, slice int, ids binary, leaves binary, vectors binary")
    met = reached.groupBy("bucket", "slice").cogroup(filed.groupBy("bucket", "slice")).applyInArrow(compare, "query_class long, class_id long, score double").distinct()
    best = Window.partitionBy("query_class").orderBy("score", "class_id")
    near = met.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n")
    each = asking.join(near, "query_class")
    if member is None:
        each = each.select("query_id", "score", F.col("class_id").alias("vec_id"))
    else:
        each = each.join(classes.where(F.size("ids") > 1).select("class_id", "ids"), "class_id", "left").select("query_id", "score", F.explode(F.coalesce("ids", F.array("class_id"))).alias("vec_id"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return each.where("vec_id <> query_id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
