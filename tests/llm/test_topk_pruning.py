"""Top-k search: what the trees spare, and rows that share an id."""

from __future__ import annotations

import numpy as np
import pytest

from quire.llm import topk


def by_hand(points, k):
    out = {}
    for n, (i, v) in enumerate(points):
        if i % 20 == 0:
            best = sorted((-int(np.dot(v, w)), j) for j, w in points if j != i and len(w) == len(v))[:k]
            out.setdefault(i, []).append([(j, -s) for s, j in best])
    return out


def clustered(n, groups, dim, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 60, (groups, dim))[rng.integers(0, groups, n)] + rng.normal(0, 2, (n, dim))
    return [(i, [int(t) for t in row]) for i, row in enumerate(np.floor(x))]


def test_clustered_vectors_are_mostly_pruned():
    points = clustered(4000, 40, 16, 1)
    ids, x = np.array([i for i, _ in points]), np.array([v for _, v in points])
    scored = [0]
    q = ids % 20 == 0
    topk.search(ids[q], x[q], ids, x, 20, met=lambda n: scored.__setitem__(0, scored[0] + n))
    assert scored[0] < 0.5 * q.sum() * len(ids)


@pytest.mark.parametrize("seed", [2, 3])
def test_blocks_and_shards_are_pruned_and_exact(spark, monkeypatch, seed):
    monkeypatch.setattr(topk, "SHARD", 100)
    monkeypatch.setattr(topk, "BLOCK", 3)  # about as many groups of queries as there are groups of vectors
    points = clustered(1500, 30, 8, seed) + [(20, [1, 2, 3]), (7, [4, 5, 6]), (40, [9] * 8), (40, [-9] * 8), (3, [5] * 8)]
    frame = spark.createDataFrame(points, "id long, v array<long>").repartition(3)
    queries = frame.where("id % 20 = 0")
    got: dict = {}
    for r in topk.top_k(queries, frame, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = by_hand(points, 5)
    assert {i: sorted(x for run in w for x in run) for i, w in want.items()} == {i: sorted(x) for i, x in got.items()}
    q, c, _, first, left = topk.pruned_pairs(queries, frame, 5)
    size = lambda t, **names: t.groupBy("dim", "pivot", "sub").count().selectExpr("dim", *(f"{a} as {b}" for a, b in names.items()))
    pairs = first.unionAll(left).join(size(q, pivot="pivot", sub="sub", count="n"), ["dim", "pivot", "sub"]).join(size(c, pivot="to", sub="part", count="m"), ["dim", "to", "part"])
    assert pairs.selectExpr("sum(n * m)").first()[0] < 0.7 * queries.count() * frame.count()
