"""Jump hashing, ball-tree k-means and periodic runs against plain Python."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from oracles import same_rows
from pyspark.sql import functions as F

from quire.llm import centroids, queries, runs, shards

SF = "/root/testdata/sf0.001"
END = (1 << 63) - 1
EDGE = [(1, "a b a b a b a b a b x"), (2, None), (3, ""), (4, " \n\t "), (5, " ".join(["w"] * 30_000)), (5, " ".join(["w"] * 30_000)), (None, "no id"), (6, "a"), (7, "é x é x é x é x\x1cy é x")]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(i, t, "en", i) for i, t in EDGE], "doc_id long, text string, slot string, part long")


# ---- 11: sharding


def jumped(key: int, n: int) -> int:
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def key_of(i):
    return int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:16], 16)


def test_op11_sql(spark):
    same_rows(spark, queries.QUERIES["op11_jump_hash"], queries.ORACLES["op11_jump_hash"], SF)


def test_op11_jump_is_the_published_sequence_and_moves_few():
    keys = [key_of(i) for i in range(20_000)]
    at = {n: shards.jump(np.array(keys, np.uint64), n) for n in (1, 7, 24, 25)}
    for n, got in at.items():
        assert [jumped(k, n) for k in keys[:3000]] == got[:3000].tolist()
    moved = at[24] != at[25]
    assert (at[25][moved] == 24).all() and abs(moved.mean() - 1 / 25) < 0.01
    assert max(Counter(at[24].tolist()).values()) < 1.2 * 20_000 / 24


@pytest.mark.parametrize("rows", [shards.ROWS, 3])
def test_op11_edges_keep_rows_columns_and_gapless_slots(spark, edge, rows, monkeypatch):
    monkeypatch.setattr(shards, "ROWS", rows)
    out = shards.assign(shards.sized(edge), 5, shard="to", slot="at", grown="next").collect()
    assert len(out) == len(EDGE)
    by = defaultdict(list)
    for r in out:
        raw = (r["text"] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw))
        assert r["to"] == jumped(key_of(r["doc_id"]), 5) and r["next"] == jumped(key_of(r["doc_id"]), 6)
        assert r["slot"] == "en" and r["part"] == r["doc_id"]
        by[r["to"]].append((r["at"], r["doc_id"]))
    for places in by.values():
        places.sort()
        assert [p for p, _ in places] == list(range(len(places)))
        ids = [-1 if i is None else i for _, i in places]
        assert ids == sorted(ids)


def test_op11_one_key_spreads_over_partitions_and_empty_stays_empty(spark, monkeypatch):
    monkeypatch.setattr(shards, "ROWS", 50)
    rows = spark.range(600).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.col("id").alias("other"))
    out = [tuple(r) for r in shards.assign(rows, 3).select("shard", "slot").collect()]
    assert len(set(out)) == 600 and all(sorted(t for s, t in out if s == k) == list(range(sum(s == k for s, _ in out))) for k in range(3))
    assert shards.assign(rows.where("other < 0"), 3).collect() == []


# ---- 12: centroid clustering


def plain_clusters(points: list[tuple], k: int, n_rounds: int):
    drawn = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in points)
    cs = [list(v) for _, v in drawn[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(cs))

    for _ in range(n_rounds):
        groups = defaultdict(list)
        for _i, v in points:
            groups[near(v)[1]].append(v)
        for n, vs in groups.items():
            cs[n] = [sum(col) // len(vs) for col in zip(*vs, strict=True)]
    return sorted((-1 if i is None else i, near(v)[1], near(v)[0]) for i, v in points), cs


def test_op12_sql(spark):
    same_rows(spark, queries.QUERIES["op12_ball_tree"], queries.ORACLES["op12_ball_tree"], SF)


@pytest.mark.parametrize("scale", [1, 1 << 17, 1 << 25])
def test_op12_equals_plain_rounds_and_balls_spare_leaves(spark, scale, monkeypatch):
    """Tight groups: most vectors lie in balls that one centroid owns, and no result changes; large components stay exact."""
    monkeypatch.setattr(centroids, "BLOCK", 300)
    rng = np.random.default_rng(3)
    x = rng.integers(-4000, 4000, (12, 5))[rng.integers(0, 12, 1000)] + rng.integers(-9, 9, (1000, 5))
    points = [(int(i) if i % 50 else None, [int(v) * scale for v in row]) for i, row in enumerate(x)]
    frame = spark.createDataFrame(points, "id long, v array<long>").repartition(3)
    out = centroids.cluster(frame, 6, 3).collect()
    want, cs = plain_clusters(points, 6, 3)
    assert sorted((-1 if r["id"] is None else r["id"], r["cluster"], r["distance"]) for r in out) == [(i, c, min(d, END)) for i, c, d in want]
    totals = Counter()
    for _, c, d in want:
        totals[c] += min(d, END)
    for r in out:
        assert r["centroid"] == cs[r["cluster"]] and r["cluster_inertia"] == min(totals[r["cluster"]], END) and r["inertia"] == min(sum(totals.values()), END)
    _, unread = centroids.moved(centroids.trees(frame), np.array(cs))
    assert unread > 700


def test_op12_ties_copies_and_edges(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0]), (8, []), (9, [0.0, 0.0]), (None, [3.0, 4.0]), (10, [1e300, -1e300])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("x"))
    points = centroids.quantised(frame, 2, scale=2)
    got = [(r["id"], r["v"]) for r in points.collect()]
    assert [i for i, _ in got] == [1, 1, 2, 9, None, 10] and got[-1][1] == [1 << 62, -(1 << 62)]
    out = centroids.cluster(points.where("id is null or id < 10"), 3, 2).collect()
    want, _ = plain_clusters(got[:-1], 3, 2)
    assert sorted((-1 if r["id"] is None else r["id"], r["cluster"], r["distance"]) for r in out) == want
    assert centroids.cluster(points, 2, 1).count() == 6
    assert {r["distance"] for r in centroids.cluster(points.where("id = 1"), 9, 2).collect()} == {0}
    assert centroids.cluster(points.where("id = 77"), 3, 2).collect() == []


# ---- 13: periodic runs


def plain_runs(w: list) -> list[tuple[int, int, int]]:
    best: dict[tuple[int, int], int] = {}
    codes = np.unique(np.array(w, object).astype(str), return_inverse=True)[1] if w else np.zeros(0, int)
    for q in range(1, len(w) // 4 + 1):
        same = np.flatnonzero(np.diff(np.concatenate([[0], codes[:-q] == codes[q:], [0]]).astype(int)))
        for s, e in same.reshape(-1, 2).tolist():
            if e + q - s >= max(6, 4 * q):
                best.setdefault((s, e + q), q)
    return sorted((s, e - s, q) for (s, e), q in best.items())


def plain_collapse(w: list, found: list) -> list:
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return [x for i, x in enumerate(w) if i not in gone]


def test_op13_equals_plain_search_on_random_words(spark):
    rng = np.random.default_rng(5)
    texts = ["", "a", None]
    for n in [*range(2, 60), 200, 400, 900]:
        for letters in (1, 2, 3):
            w = rng.integers(0, letters, n)
            if n % 2:
                a, p = int(rng.integers(0, n)), int(rng.integers(1, n))
                w = np.array([w[i] if i < a else w[a + (i - a) % min(p, n - a)] for i in range(n)])
            texts.append(" ".join("abc"[x] for x in w))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in runs.find(frame).collect():
        w = (r["text"] or "").split()
        want = plain_runs(w)
        assert [(x["start"], x["length"], x["period"]) for x in r["runs"]] == want, r["text"]
        assert r["collapsed"] == " ".join(plain_collapse(w, want))


def test_op13_query_equals_plain_search_on_whole_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in queries.op13_periodic_runs(spark, SF).collect()}
    assert len(got) == len(docs)
    some = 0
    for doc_id, text in docs:
        w = [x.decode() for x in (text or "").encode().split()]
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        want = plain_runs(w)
        some += bool(want)
        r = got[doc_id]
        best = min(((-Fraction(n, q), s, q, n) for s, n, q in want), default=None)
        assert r["n_runs"] == len(want)
        assert (r["start"], r["length"], r["period"]) == ((best[1], best[3], best[2]) if best else (None, None, None))
        assert r["exponent_milli"] == (1000 * best[3] // best[2] if best else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in want).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(plain_collapse(w, want)).encode()).hexdigest()
    assert some > 5


def test_op13_edges(spark, edge):
    out = {(r["doc_id"], r["text"]): r for r in runs.find(edge).collect()}
    assert out[1, EDGE[0][1]]["runs"][0].asDict() == {"start": 0, "length": 10, "period": 2} and out[1, EDGE[0][1]]["collapsed"] == "a b x"
    assert [tuple(x) for x in out[5, EDGE[4][1]]["runs"]] == [(0, 30_000, 1)] and out[5, EDGE[4][1]]["collapsed"] == "w"
    for key in ((2, None), (3, ""), (4, " \n\t ")):
        assert out[key]["runs"] == [] and out[key]["collapsed"] == ""
    assert [tuple(x) for x in out[7, EDGE[8][1]]["runs"]] == plain_runs([b.decode() for b in EDGE[8][1].encode().split()])
    assert runs.find(edge).count() == len(EDGE) and runs.find(edge.where("doc_id < 0")).collect() == []
