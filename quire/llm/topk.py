"""Exact top-k inner products by a dual-tree search over cover trees.

The trees' upper level is one for all: pivots from a bounded sample, to the nearest of which every
candidate and every query goes. A pivot's candidates lie in shards and its queries in blocks, both of
bounded size. A block first searches one shard of its own pivot; what its queries have then is a
floor. It meets the shards of another pivot only if the largest score that the covering radii of both
allow reaches its worst floor. Within a block and a shard one call builds a cover tree over each side
and descends both together: a pair of nodes is dropped when its largest possible score is below the
worst k-th score, or floor, in the query node. The k best of all calls meet in the end.

Scores are integers: each component becomes floor(scale * x). Ties go to the smaller id.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part,
nor do rows without an id; vectors of different lengths are never compared; of rows that repeat an
id each takes part, as query too (equal query rows once), except that no row with the query's id is
its candidate; with fewer than k candidates all are returned; empty tables give an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import frees, written

#: Rows of a shard of candidates, and of a block of queries.
SHARD, BLOCK = 4096, 512
#: Vectors that pivots are drawn from, and pivots at most for each length of vectors.
SAMPLE, PIVOTS = 4096, 256
#: Nodes of up to so many points are split only where that halves their radius, and smaller ones never: where nothing can be pruned, large leaves are compared at once.
LEAF, QUERY_LEAF, SMALL = 256, 128, 8


def quantised(vectors: DataFrame, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id long, v array<long>): floor(scale * x) of each usable vector."""
    x = F.transform(F.col(vec_col), lambda e: e.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), x.alias("x")).where("id is not null and x is not null and size(x) > 0")
    good = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    return rows.where(good).select("id", F.transform("x", lambda e: F.floor(e * scale).cast("long")).alias("v"))


class CoverTree:
    """A cover tree over the rows of x, as arrays by node: centre, radius, children, and a range of ``order``.

    At each level centres are chosen greedily so that each point lies within half its parent's radius
    of one of them; the radius kept with a node is that of its own points.
    """

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.x, self.order = x, np.arange(len(x))
        self.centre: list[np.ndarray] = []
        self.radius: list[float] = []
        self.span: list[tuple[int, int]] = []
        self.children: list[list[int]] = []
        stack = [(-1, 0, len(x))]
        while stack:
            parent, a, b = stack.pop()
            own = self.order[a:b]
            c = x[own].mean(axis=0)
            d = np.sqrt(((x[own] - c) ** 2).sum(axis=1))
            me, r = len(self.radius), float(d.max()) if b > a else 0.0
            self.centre.append(c)
            self.radius.append(r * (1 + 1e-9))
            self.span.append((a, b))
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(me)
            if b - a <= SMALL or r == 0:
                continue
            near, to, label, k = np.full(b - a, np.inf), r / 2, np.zeros(b - a, np.int64), 0
            nxt = int(d.argmax())
            while near[nxt] > to and k < 16:  # the farthest point so far becomes the next centre
                e = np.sqrt(((x[own] - x[own[nxt]]) ** 2).sum(axis=1))
                closer = e < near
                near[closer], label[closer] = e[closer], k
                k, nxt = k + 1, int(near.argmax())
            if b - a <= leaf and near[nxt] > to:
                continue
            by = np.argsort(label, kind="stable")
            self.order[a:b] = own[by]
            ends = np.cumsum(np.bincount(label, minlength=k))
            if k < 2 or (np.diff(ends, prepend=0) == b - a).any():
                continue
            stack += [(me, a + s, a + e) for s, e in zip([0, *ends[:-1]], ends, strict=True) if e > s]


def search(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int, met: Callable[[int], None] | None = None, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's index, candidate's index, score) of each query's k best candidates with another id. met hears how many pairs are scored; below its floor a query needs no candidate."""
    tq, tc = CoverTree(q.astype(np.float64), QUERY_LEAF), CoverTree(c.astype(np.float64))
    # One number orders by score, then by smaller id: scores are whole, and places among the ids are below len(c).
    # Floating point where that number is exact in it, else whole numbers of any size.
    peak = [max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0 for x in (q, c)]
    exact = (peak[0] * peak[1] * q.shape[1] + 1) * (len(c) + 1) >= 1 << 53
    kind = object if exact else np.float64
    q, c = q.astype(kind), c.astype(kind)
    place = np.empty(len(c), kind)
    place[np.argsort(cid, kind="stable")[::-1]] = np.arange(len(c)).astype(kind)
    norm_q = [float(np.linalg.norm(x)) for x in tq.centre]
    centres_c = np.array(tc.centre)
    norm_c, radius_c = np.sqrt((centres_c**2).sum(axis=1)), np.array(tc.radius)
    lowest = -((peak[0] * peak[1] * q.shape[1] + 2) * (len(c) + 1)) if exact else -np.inf
    best = np.full((len(q), k), lowest, kind)
    at = np.full((len(q), k), -1, np.int64)

    def bound(n: int, m: np.ndarray) -> np.ndarray:
        """No query under n scores more with any candidate under m."""
        sizes = (norm_q[n] + tq.radius[n]) * (norm_c[m] + radius_c[m])
        return centres_c[m] @ tq.centre[n] + norm_q[n] * radius_c[m] + tq.radius[n] * norm_c[m] + tq.radius[n] * radius_c[m] + 1e-3 + 1e-9 * sizes

    def worst(rows: np.ndarray) -> float:
        """The worst k-th score of the rows."""
        least = best[rows].min()
        found = math.floor(least / len(c)) if least > lowest and not exact else float(least // len(c)) if least > lowest else -math.inf
        return max(found, floor[rows].min()) if floor is not None else found

    def leaf(rows: np.ndarray, cols: np.ndarray) -> None:
        if met:
            met(len(rows) * len(cols))
        key = (q[rows] @ c[cols].T) * len(c) + place[cols]
        key[qid[rows][:, None] == cid[cols][None, :]] = lowest
        better = (key > best[rows].min(axis=1)[:, None]).any(axis=1)
        if not better.any():
            return
        rows, key = rows[better], key[better]
        keys = np.concatenate([best[rows], key], axis=1)
        who = np.concatenate([at[rows], np.broadcast_to(cols, key.shape)], axis=1)
        by = np.argsort(keys, axis=1)[:, -k:] if exact else np.argpartition(keys, -k, axis=1)[:, -k:]
        best[rows], at[rows] = np.take_along_axis(keys, by, 1), np.take_along_axis(who, by, 1)

    def descend(n: int, nodes: np.ndarray) -> None:
        """Searches the queries under n among the candidates under nodes, the most promising node first."""
        a, b = tq.span[n]
        rows = tq.order[a:b]
        top = bound(n, nodes)
        nodes = nodes[top >= worst(rows)]
        if not len(nodes):
            return
        if tq.children[n]:
            opened = np.array([y for m in nodes for y in (tc.children[m] or [m])])
            for child in tq.children[n]:
                descend(child, opened)
            return
        heap = list(zip((-bound(n, nodes)).tolist(), nodes.tolist(), strict=True))
        heapq.heapify(heap)
        least = worst(rows)
        while heap:
            t, m = heapq.heappop(heap)
            if -t < least:
                return
            if tc.children[m]:
                sub = np.array(tc.children[m])
                for x in zip((-bound(n, sub)).tolist(), sub.tolist(), strict=True):
                    if -x[0] >= least:
                        heapq.heappush(heap, x)
                continue
            s, e = tc.span[m]
            leaf(rows, tc.order[s:e])
            least = worst(rows)

    if len(q) and len(c):
        descend(0, np.array([0]))
    r, j = np.nonzero(best > lowest)
    score = best[r, j] // len(c) if exact else np.floor(best[r, j] / len(c))
    return r, at[r, j], np.clip(score, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def pivots(vectors: DataFrame) -> dict[int, np.ndarray]:
    """By length of vectors some that lie far from each other, two a shard's worth of rows and PIVOTS at most, drawn from a sample of SAMPLE rows by the hash of their ids."""
    most = min(PIVOTS, 2 * math.ceil(vectors.count() / SHARD))
    by: dict[int, list] = {}
    for r in vectors.select("v", F.xxhash64("id", F.lit(7)).alias("h")).orderBy("h", "v").limit(SAMPLE).collect():
        by.setdefault(len(r["v"]), []).append(r["v"])
    out = {}
    for dim, rows in by.items():
        x = np.array(rows, np.float64)
        chosen, near = [0], ((x - x[0]) ** 2).sum(axis=1)
        while len(chosen) < most and near.max() > 0:
            chosen.append(int(near.argmax()))
            near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
        out[dim] = x[chosen]
    return out


def _first(at: dict[int, np.ndarray], n: int) -> dict[int, np.ndarray]:
    """The first n pivots of each length, which lie as far from each other as so many can nearly."""
    return {dim: c[: max(1, n)] for dim, c in at.items()}


def _routed(rows: DataFrame, at: dict[int, np.ndarray], size: int, name: str) -> DataFrame:
    """rows (id, v), written with row (a number of their own), dim, the nearest pivot, the distance to it, and sub: which of the pivot's parts of about ``size`` rows they are in."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v")
            dims = np.array([len(x) for x in v.to_pylist()], np.int32) if b.num_rows else np.zeros(0, np.int32)
            pivot, dist = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows)
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                x = np.array(v.take(pa.array(own)).flatten(), np.float64).reshape(len(own), -1)
                c = at.get(int(dim), np.zeros((1, int(dim))))
                d = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)
                pivot[own] = d.argmin(axis=1)
                dist[own] = np.sqrt(((x - c[pivot[own]]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(dims), pa.array(pivot), pa.array(dist)], names=["row", "id", "v", "dim", "pivot", "dist"])

    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "id", "v")
    out = written(numbered.mapInArrow(frees(work), "row long, id long, v array<long>, dim int, pivot int, dist double"), name)
    parts = out.groupBy("dim", "pivot").agg(F.count("*").alias("n")).select("dim", "pivot", F.ceil(F.col("n") / size).cast("int").alias("subs"))
    return out.join(parts, ["dim", "pivot"]).withColumn("sub", F.pmod(F.xxhash64("row"), F.col("subs")).cast("int"))


def _searched(pairs: DataFrame, q: DataFrame, c: DataFrame, k: int) -> DataFrame:
    """(row, query_id, vec_id, score) of the k best of each query in each pair of a block (dim, pivot, sub) and a shard (dim, to, part)."""
    key = ["dim", "pivot", "sub", "to", "part"]
    asked = q.join(pairs, ["dim", "pivot", "sub"]).select(*key, "row", "id", "v", "floor")
    met = c.select("dim", F.col("pivot").alias("to"), F.col("sub").alias("part"), F.lit(-1).cast("long").alias("row"), "id", "v", F.lit(0.0).alias("floor")).join(pairs, ["dim", "to", "part"]).select(*key, "row", "id", "v", "floor")

    def work(table: pa.Table) -> pa.Table:
        rows, ids, low = np.array(table["row"]), np.array(table["id"]), np.array(table["floor"], np.float64)
        x = np.array(table["v"].combine_chunks().flatten()).reshape(len(ids), -1)
        is_q = rows >= 0
        if not is_q.any() or is_q.all():
            return pa.table({n: pa.array([], pa.int64()) for n in ("row", "query_id", "vec_id", "score")})
        i, j, s = search(ids[is_q], x[is_q], ids[~is_q], x[~is_q], k, floor=low[is_q])
        i, j, s = (t[s >= low[is_q][i]] for t in (i, j, s))  # what is below the floor can't be among the k best
        return pa.table({"row": rows[is_q][i], "query_id": ids[is_q][i], "vec_id": ids[~is_q][j], "score": s})

    return asked.unionByName(met).groupBy(*key).applyInArrow(work, "row long, query_id long, vec_id long, score long")


def _reachable(at: dict[int, np.ndarray], radius: dict[tuple[int, int], float]):
    """Blocks (dim, pivot, sub, reach, worst) -> the pivots whose candidates may score worst or more with a query that near to the block's pivot."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for dim, pivot, sub, reach, worst in zip(*(c.to_pylist() for c in b.columns), strict=True):
                c = at.get(dim, np.zeros((1, dim)))
                far = np.array([radius.get((dim, p), math.inf if dim not in at else -1.0) for p in range(len(c))])
                norm = np.sqrt((c * c).sum(axis=1))
                top = c @ c[pivot] + norm[pivot] * far + reach * norm + reach * far
                top += 1e-3 + 1e-9 * (norm[pivot] + reach) * (norm + far)
                out += [(dim, pivot, sub, int(p)) for p in np.flatnonzero((far >= 0) & (top >= worst))]
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32()) for x in columns], names=["dim", "pivot", "sub", "to"])

    return frees(work)


def pruned_pairs(queries: DataFrame, vectors: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(queries with floors, candidates, first results, the first pairs of blocks and shards, the pairs that are left to search)."""
    at, queries = pivots(vectors), queries.distinct()
    # As many groups of queries as blocks: each candidate is written once for each block that it still meets.
    c, q = _routed(vectors, at, SHARD, "topk-candidates"), _routed(queries, _first(at, math.ceil(queries.count() / BLOCK)), BLOCK, "topk-queries")
    shards = written(c.groupBy("dim", "pivot", "sub").agg(F.count("*").alias("n"), F.max("dist").alias("far")), "topk-shards")
    # At most PIVOTS a length of vectors that the sample holds; other lengths have one pivot, whose radius stays unknown.
    held = [r for r in shards.groupBy("dim", "pivot").agg(F.max("far").alias("far")).where(F.col("dim").isin(list(at)) if at else F.lit(False)).collect()]
    radius = {(r["dim"], r["pivot"]): r["far"] * (1 + 1e-9) for r in held}
    blocks = q.select("dim", "pivot", "sub").distinct()
    # A block begins with the largest shard of its own pivot.
    own = shards.groupBy("dim", "pivot").agg(F.max_by("sub", "n").alias("part"))
    first = written(blocks.join(own, ["dim", "pivot"]).select("dim", "pivot", "sub", F.col("pivot").alias("to"), "part"), "topk-first")
    low = F.lit(float("-inf"))
    found = written(_searched(first, q.withColumn("floor", low), c, k), "topk-found")
    floors = found.groupBy("row").agg(F.count("*").alias("n"), F.min("score").alias("s")).where(F.col("n") >= k).select("row", F.col("s").cast("double").alias("floor"))
    q = written(q.join(floors, "row", "left").withColumn("floor", F.coalesce("floor", low)), "topk-floors")
    reach = q.groupBy("dim", "pivot", "sub").agg(F.max("dist").alias("reach"), F.min("floor").alias("worst")).select("dim", "pivot", "sub", "reach", "worst")
    pairs = reach.mapInArrow(_reachable(at, radius), "dim int, pivot int, sub int, to int").join(shards.select("dim", F.col("pivot").alias("to"), F.col("sub").alias("part")), ["dim", "to"])
    left = written(pairs.join(first, ["dim", "pivot", "sub", "to", "part"], "left_anti").select("dim", "pivot", "sub", "to", "part"), "topk-pairs")
    return q, c, found, first, left


def top_k(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """query_id, rank from 1, vec_id, score. Both sides as quantised() gives them."""
    q, c, found, _first, left = pruned_pairs(queries, vectors, k)
    every = found.unionByName(_searched(left, q, c, k))
    w = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")
    return every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
