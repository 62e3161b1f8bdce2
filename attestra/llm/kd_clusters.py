"""K-means by filtering centroids through kd-trees, in exact integers.

Vectors are cut into blocks, and each block into a kd-tree whose nodes hold the
count, the sums and the box of their vectors; the trees are written once. A
round sends all centroids down each tree: at a node, those that another one
beats everywhere in the box are dropped; where one is left, the node is its own
as a whole, by its count and sums; what reaches a leaf is compared with the
centroids left there. Spark adds up what the blocks give, and the centroids of
the next round are a few numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import stage
from .words import tidy

COMPONENTS, SCALE, CENTROIDS, ROUNDS, SALT = 64, 256, 40, 5, "2"
#: Vectors of a block and of a leaf.
BLOCK, LEAF = 2048, 32
#: Integers below this have products and sums that doubles hold exactly; from the second bound on, distances may leave 64 bits.
DOUBLES, LARGEST = 1 << 20, 1 << 27
_TREE = "ids array<bigint>, points binary, start binary, child binary, box binary, sums binary"


class Tree:
    """A kd-tree in arrays: rows in tree order; of each node its stretch of rows, its left child (0: a leaf; the right one follows), its box and its sums."""

    def __init__(self, points: np.ndarray, start: np.ndarray, child: np.ndarray, box: np.ndarray, sums: np.ndarray):
        self.points, self.start, self.child, self.box, self.sums = points, start, child, box, sums

    @staticmethod
    def grown(points: np.ndarray) -> tuple[Tree, np.ndarray]:
        """The tree of ``points``, split at the middle of the widest side, and the order in which it holds them."""
        order, start, child, box, sums = np.arange(len(points)), [(0, len(points))], [], [], []
        for node in range(2 * len(points) + 1):
            if node == len(start):
                break
            a, b = start[node]
            own = points[order[a:b]]
            lo, hi = own.min(0), own.max(0)
            box.append((lo, hi))
            sums.append(own.sum(0, dtype=np.int64))
            side = int((hi - lo).argmax())
            if b - a <= LEAF or lo[side] == hi[side]:
                child.append(0)
                continue
            half = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own[:, side], half)]
            child.append(len(start))
            start += [(a, a + half), (a + half, b)]
        return Tree(points[order], np.array(start, np.int64), np.array(child, np.int64), np.array(box, np.int64), np.array(sums, np.int64)), order

    def walk(self, centroids: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
        """Whole nodes and their centroids, level by level; and the rows of the leaves that were left, and theirs. Of equally near centroids the first."""
        kind = np.float64 if max(np.abs(self.box).max(), np.abs(centroids).max()) < DOUBLES else np.int64
        far = np.array(np.inf if kind is np.float64 else np.iinfo(np.int64).max, kind)
        z = centroids.astype(kind)
        square, number = (z * z).sum(1), np.arange(len(z))
        node, alive, whole, rows, left = np.zeros(1, np.int64), np.ones((1, len(z)), bool), [], [], []
        while len(node):
            lo, hi = self.box[node, 0].astype(kind), self.box[node, 1].astype(kind)
            best = np.where(alive, square - (lo + hi) @ z.T, far).argmin(1)
            for b in np.unique(best):
                own = best == b
                toward = z - z[b]
                # The point of the box that suits a centroid best, against the best one there.
                gain = hi[own] @ np.maximum(toward, 0).T - lo[own] @ np.maximum(-toward, 0).T
                gap = square - square[b] - 2 * gain
                alive[own] &= (gap < 0) | ((gap == 0) & (number <= b))
            one, leaf = alive.sum(1) == 1, self.child[node] == 0
            whole.append((node[one], best[one]))
            for n, a in zip(node[leaf & ~one], alive[leaf & ~one], strict=True):
                s, e = self.start[n]
                rows.append(np.arange(s, e))
                left.append(np.broadcast_to(a, (e - s, len(z))))
            more = ~one & ~leaf
            node, alive = np.stack([self.child[node[more]], self.child[node[more]] + 1], 1).ravel(), np.repeat(alive[more], 2, axis=0)
        if not rows:
            return whole, np.zeros(0, np.int64), np.zeros(0, np.int64)
        rows = np.concatenate(rows)
        return whole, rows, np.where(np.concatenate(left), square - 2 * (self.points[rows].astype(kind) @ z.T), far).argmin(1)

    def totals(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and sums of each centroid's vectors."""
        whole, rows, own = self.walk(centroids)
        count, sums = np.bincount(own, minlength=len(centroids)), np.zeros(centroids.shape, np.int64)
        np.add.at(sums, own, self.points[rows].astype(np.int64))
        for node, c in whole:
            np.add.at(count, c, self.start[node, 1] - self.start[node, 0])
            np.add.at(sums, c, self.sums[node])
        return count, sums

    def nearest(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Centroid and squared distance of each row, in tree order."""
        whole, rows, own = self.walk(centroids)
        out = np.zeros(len(self.points), np.int64)
        out[rows] = own
        for node, c in whole:
            for n, k in zip(node, c, strict=True):
                out[self.start[n, 0] : self.start[n, 1]] = k
        apart = self.points.astype(np.int64) - centroids[out]
        return out, (apart * apart).sum(1)


def kept(vectors: DataFrame) -> DataFrame:
    """``vec_id`` and ``point`` of the vectors of 64 finite components. Components that would take distances out of 64 bits are an error."""
    x = F.col("embedding")
    good = (F.size(x) == COMPONENTS) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    scaled = lambda v: F.when(F.abs(v.cast("double") * SCALE) < LARGEST, F.floor(v.cast("double") * SCALE)).otherwise(F.raise_error(F.lit("a component is too large for distances of 64 bits")).cast("long"))
    return vectors.where(F.coalesce(good, F.lit(False))).select(F.col("vec_id").cast("long"), F.transform(x, scaled).alias("point"))


def first_centroids(points: DataFrame, most: int = CENTROIDS) -> np.ndarray:
    """The vectors of the smallest hashes of ``vec_id``: a fixed number of rows. Rows of one vec_id go by their components, null ids last."""
    draw = F.coalesce(F.sha2(F.concat(F.lit(f"{SALT}:"), F.col("vec_id").cast("string")), 256), F.lit("~"))
    rows = points.orderBy(draw, "point").limit(most).collect()
    return np.array([r["point"] for r in rows], np.int64).reshape(-1, COMPONENTS)


def _plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def block(ids: pa.Array, points: np.ndarray) -> pa.RecordBatch:
        tree, order = Tree.grown(points)
        held = [pa.array([x.tobytes()], pa.binary()) for x in (tree.points, tree.start, tree.child, tree.box.astype(np.int32), tree.sums)]
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.take(pa.array(order))), *held], names=[c.split()[0] for c in _TREE.split(", ")])

    held, n = [], 0
    for b in batches:
        while len(b):
            held.append(b.slice(0, BLOCK - n))
            b, n = b.slice(BLOCK - n), n + len(held[-1])
            if n == BLOCK:
                yield block(*_taken(held))
                held, n = [], 0
    if n:
        yield block(*_taken(held))


def _taken(held: list[pa.RecordBatch]) -> tuple[pa.Array, np.ndarray]:
    points = np.concatenate([np.asarray(b.column(1).flatten()) for b in held]).astype(np.int32).reshape(-1, COMPONENTS)
    return pa.concat_arrays([b.column(0) for b in held]), points


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, Tree]]:
    read = lambda b, i, k, kind, *shape: np.frombuffer(b.column(i)[k].as_buffer(), kind).reshape(-1, *shape)
    for b in batches:
        for k in range(len(b)):
            yield b.column(0)[k].values, Tree(read(b, 1, k, np.int32, COMPONENTS), read(b, 2, k, np.int64, 2), read(b, 3, k, np.int64).ravel(), read(b, 4, k, np.int32, 2, COMPONENTS).astype(np.int64), read(b, 5, k, np.int64, COMPONENTS))


def _totals(centroids: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for _, tree in _trees(batches):
            n, s = tree.totals(centroids)
            count, sums = count + n, sums + s
        some = np.flatnonzero(count)
        rows = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * COMPONENTS, pa.int32()), pa.array(sums[some].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some]), rows], names=["cluster", "n", "sums"])

    return tidy(run)


def _nearest(centroids: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tree in _trees(batches):
            cluster, distance = tree.nearest(centroids)
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return tidy(run)


def moved(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid that has vectors becomes the floor of their mean, the others stay. A row for each centroid reaches the driver."""
    parts = blocks.mapInArrow(_totals(centroids), "cluster int, n long, sums array<long>")
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(COMPONENTS)]).alias("sums")).collect()
    out = centroids.copy()
    for r in rows:
        out[r["cluster"]] = [s // r["n"] for s in r["sums"]]
    return out


def clusters(vectors: DataFrame, most: int = CENTROIDS, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id``, ``cluster``, squared ``distance``, ``cluster_inertia``, ``inertia`` and ``centroid_sha256`` for each vector of 64 finite components.

    Other vectors, null ones among them, have no row. Fewer vectors than
    ``most`` are as many centroids; equal centroids leave all to the first, and
    the others stay where they are. Repeated rows have a row each and count
    each; an empty table gives an empty result; other columns play no part.
    """
    spark = vectors.sparkSession
    points = stage(kept(vectors), "points")
    centroids = first_centroids(points, most)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    blocks = stage(points.mapInArrow(_plant, _TREE), "trees")
    for _ in range(rounds):
        centroids = moved(blocks, centroids)
    found = stage(blocks.mapInArrow(_nearest(centroids), "vec_id long, cluster int, distance long"), "nearest")
    inertia = {r["cluster"]: r["d"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    told = [(k, inertia[k], sum(inertia.values()), digest(centroids[k])) for k in sorted(inertia)]
    return found.join(F.broadcast(spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
