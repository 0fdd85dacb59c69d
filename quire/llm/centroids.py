"""Exact k-means by ball-tree filtering.

Each partition cuts its vectors into blocks and builds a metric tree over each once: a node holds its
vectors' count, integer sum and radius. The trees are written as a table, and each round walks them
from the root with the round's centroids. By the triangle inequality a ball lies whole with one
centroid when its farthest point is nearer to it than its nearest point could be to any other; then
its count and sum go there unread. Other balls descend, and a leaf's vectors are compared exactly.
A block sends one partial sum a centroid and component; only those sums of all blocks meet.

Vectors are integers: each component becomes floor(scale * x). Distances are squared and exact, ties
go to the smaller number, and new centroids are exact floors of the means.

Defined results: vectors that are null, of another length, or hold null or non-finite components take
no part; repeated rows, repeated ids and null ids (an empty text when the first centroids are drawn)
are rows of their own; with fewer vectors than centroids there are as many centroids as vectors;
an empty table gives an empty result. Components beyond 2^62 stay there, and distances and inertias
beyond a long are given as its end; neither limits the assignment.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Vectors of a tree, and the number up to which a ball isn't split.
BLOCK, LEAF = 16_384, 16
#: Up to here the squared distances of vectors of 2^10 components are whole numbers of a double.
_PLAIN = 1 << 20
_END, _LONG = 1 << 62, (1 << 63) - 1
#: What rounding may add to a distance, relative to the numbers that it comes from.
_SLACK = 1e-9
_TREE = "ids array<bigint>, points binary, width int, first array<int>, last array<int>, child array<int>, radius array<double>, sums binary"


def quantised(vectors: DataFrame, dim: int, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id long, v array<long>): floor(scale * x) of each usable vector of dim components."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vec_col), lambda e: e.cast("double")).alias("x")).where(F.size("x") == dim)
    good = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    end = F.lit(float(_END))
    return rows.where(good).select("id", F.transform("x", lambda e: F.floor(F.greatest(-end, F.least(end, e * scale))).cast("long")).alias("v"))


def _exact(x: np.ndarray) -> np.ndarray:
    """x in a type whose sums of squares are exact: doubles where components are small, else Python's integers."""
    return x.astype(np.float64) if np.abs(x).max(initial=0) <= _PLAIN and x.shape[1] <= 1 << 10 else x.astype(object)


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of x to each centroid."""
    if _exact(x).dtype == object or _exact(centroids).dtype == object:
        x, c = x.astype(object), centroids.astype(object)
        return np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1)
    x, c = x.astype(np.float64), centroids.astype(np.float64)
    return ((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)).astype(np.int64)


def build(ids: list, x: np.ndarray) -> dict:
    """A ball tree over the rows of x: nodes cover ranges of the rows as reordered; a node's second child follows its first."""
    order = np.arange(len(x))
    near = x.astype(np.float64)
    first, last, child, radius, sums = [0], [len(x)], [-1], [], []
    k = 0
    while k < len(first):
        own = order[first[k] : last[k]]
        points = near[own]
        total = _exact(x[own]).sum(axis=0)
        centre = total.astype(np.float64) / len(own)
        far = np.sqrt(((points - centre) ** 2).sum(axis=1))
        radius.append(0.0 if (points == points[0]).all() else float(far.max()))
        sums.append([int(t) for t in total])
        if len(own) > LEAF and radius[k] > 0:
            a = points[far.argmax()]
            away = ((points - a) ** 2).sum(axis=1)
            along = points @ (points[away.argmax()] - a)
            # Between two far points, where the widest gap may lie; at the median where that leaves one side nearly empty.
            half = int((along < (along.min() + along.max()) / 2).sum())
            half = half if len(own) // 8 < half < len(own) - len(own) // 8 else len(own) // 2
            order[first[k] : last[k]] = own[np.argpartition(along, half)]
            child[k] = len(first)
            first += [first[k], first[k] + half]
            last += [first[k] + half, last[k]]
            child += [-1, -1]
        k += 1
    return {"ids": [ids[i] for i in order], "points": x[order].astype("<i8").tobytes(), "width": x.shape[1], "first": first, "last": last, "child": child, "radius": radius, "sums": ("\n".join(",".join(map(str, s)) for s in sums)).encode()}


class Tree:
    """A tree as read back: arrays by node."""

    def __init__(self, row: dict):
        self.ids, self.x = row["ids"], np.frombuffer(row["points"], "<i8").reshape(-1, row["width"])
        self.first, self.last, self.child, self.radius = (np.array(row[n]) for n in ("first", "last", "child", "radius"))
        self.sums = np.array([[int(v) for v in line.split(",")] for line in row["sums"].decode().split("\n")], object)

    def walk(self, centroids: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """(nodes that lie whole with a centroid, their centroids) by level, and the leaves that don't."""
        c = centroids.astype(np.float64)
        count = (self.last - self.first).astype(np.float64)
        centre = self.sums.astype(np.float64) / count[:, None]
        whole, leaves, level = [], [], np.zeros(1, np.int64)
        while len(level):
            d = np.sqrt(((centre[level][:, None, :] - c) ** 2).sum(axis=2))
            best = d.argmin(axis=1)
            r, rows = self.radius[level], np.arange(len(level))
            slack = _SLACK * (d.max(axis=1) + r + np.abs(centre[level]).max(axis=1) + np.abs(c).max()) + _SLACK
            nearest = d[rows, best]
            d[rows, best] = np.inf
            owned = nearest + r + slack < d.min(axis=1) - r - slack
            whole.append((level[owned], best[owned]))
            level = level[~owned]
            down = self.child[level]
            leaves.append(level[down < 0])
            level = np.concatenate([down[down >= 0], down[down >= 0] + 1])
        return whole, np.concatenate(leaves)

    def rows_of(self, nodes: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *(np.arange(a, b) for a, b in zip(self.first[nodes], self.last[nodes], strict=True))])


def _sums(tree: Tree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Each centroid's sums of components and count in the tree, and how many vectors lay in whole balls."""
    total, count = np.zeros(centroids.shape, object), np.zeros(len(centroids), np.int64)
    whole, leaves = tree.walk(centroids)
    for nodes, own in whole:
        np.add.at(total, own, tree.sums[nodes])
        np.add.at(count, own, tree.last[nodes] - tree.first[nodes])
    unread = int(count.sum())
    rows = tree.rows_of(leaves)
    own = squared(tree.x[rows], centroids).argmin(axis=1) if len(rows) else rows
    for k in np.unique(own):
        mine = _exact(tree.x[rows[own == k]])
        total[k] += np.array([int(v) for v in mine.sum(axis=0)], object)
        count[k] += len(mine)
    return total, count, unread


def trees(points: DataFrame) -> DataFrame:
    """points as quantised() gives them, as a written table of ball trees, one row a block of a partition."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        parts: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            row = build(ids, np.concatenate(parts))
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                some = batch.slice(a, BLOCK)
                if not some.num_rows:
                    continue
                if len(ids) + some.num_rows > BLOCK and ids:
                    yield flush()
                    ids, parts = [], []
                ids += some.column(0).to_pylist()
                parts.append(some.column(1).flatten().to_numpy(zero_copy_only=False).reshape(some.num_rows, -1))
        if ids:
            yield flush()

    schema = pa.schema([("ids", pa.list_(pa.int64())), ("points", pa.binary()), ("width", pa.int32()), *((n, pa.list_(pa.int32())) for n in ("first", "last", "child")), ("radius", pa.list_(pa.float64())), ("sums", pa.binary())])
    return written(points.mapInArrow(work, _TREE), "ball-trees")


def first_centroids(points: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors whose ids have the smallest sha256 after the seed, ties by the vector."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    return np.array([r["v"] for r in points.select(drawn.alias("h"), "v").orderBy("h", "v").limit(k).collect()], np.int64)


def moved(forest: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, int]:
    """The centroids after a round, and how many vectors no leaf had to look at."""
    k, dim = centroids.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                total, count, unread = _sums(Tree(row), centroids)
                # A place for each component, one for the count and, of the first centroid, one for the vectors unread.
                values = [[*total[c], int(count[c])] for c in range(k)]
                values[0].append(unread)
                flat = [(c, p, Decimal(int(v))) for c, vs in enumerate(values) for p, v in enumerate(vs) if v]
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in flat], pa.int32()), pa.array([f[1] for f in flat], pa.int32()), pa.array([f[2] for f in flat], pa.decimal128(38, 0))], names=["c", "p", "v"])

    sums = np.zeros((k, dim + 2), object)
    # k * (dim + 2) rows at most.
    for r in forest.mapInArrow(work, "c int, p int, v decimal(38,0)").groupBy("c", "p").agg(F.sum("v").alias("v")).collect():
        sums[r["c"], r["p"]] = int(r["v"])
    out = centroids.copy()
    for c in range(k):
        if sums[c, dim]:
            out[c] = [s // sums[c, dim] for s in sums[c, :dim]]
    return out, int(sums[0, dim + 1])


def assigned(forest: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, distance) of each vector of the trees."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tree = Tree(row)
                own, distance = np.zeros(len(tree.x), np.int32), np.zeros(len(tree.x), object)
                whole, leaves = tree.walk(centroids)
                rows = tree.rows_of(leaves)
                if len(rows):
                    d = squared(tree.x[rows], centroids)
                    own[rows] = d.argmin(axis=1)
                    distance[rows] = d.min(axis=1)
                of = [np.zeros(0, np.int64), *(np.repeat(c, tree.last[n] - tree.first[n]) for n, c in whole)]
                rows = np.concatenate([np.zeros(0, np.int64), *(tree.rows_of(n) for n, _ in whole)])
                own[rows] = np.concatenate(of)
                for c in np.unique(own[rows]):
                    mine = rows[own[rows] == c]
                    distance[mine] = squared(tree.x[mine], centroids[c : c + 1])[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(tree.ids, pa.int64()), pa.array(own), pa.array([min(int(v), _LONG) for v in distance], pa.int64())], names=["id", "cluster", "distance"])

    return forest.mapInArrow(work, "id long, cluster int, distance long")


def cluster(points: DataFrame, k: int, rounds: int, seed: int = 1) -> DataFrame:
    """points as quantised() gives them: id, cluster, distance, cluster_inertia, inertia, centroid (array<bigint>) and centroid_sha256 (of its decimal components, joined by commas)."""
    spark = points.sparkSession
    forest, centroids = trees(points), first_centroids(points, k, seed)
    if not len(centroids):
        centroids = np.zeros((1, 1), np.int64)
    for _ in range(rounds):
        centroids, _unread = moved(forest, centroids)
    out = written(assigned(forest, centroids), "clusters")
    inertia = {r["cluster"]: int(r["s"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    every = min(sum(inertia.values()), _LONG)
    # One row a centroid: k at most.
    rows = [(c, min(inertia.get(c, 0), _LONG), every, [int(v) for v in x], hashlib.sha256(",".join(str(int(v)) for v in x).encode()).hexdigest()) for c, x in enumerate(centroids)]
    facts = spark.createDataFrame(pd.DataFrame(rows, columns=["cluster", "cluster_inertia", "inertia", "centroid", "centroid_sha256"]), "cluster int, cluster_inertia long, inertia long, centroid array<bigint>, centroid_sha256 string")
    return out.join(F.broadcast(facts), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256")
