"""N-gram Jaccard join by T-occurrence search, and the groups that its links form.

Documents with the same set of shingles become one node. A node's shingles stand in one order that
all nodes share, the corpus's most frequent ones last. Two nodes that overlap enough share, within
the prefixes of n - T + 1 + L shingles, more than the L longest inverted lists that a node leaves
out: so the short lists alone name every candidate.

Lists aren't expanded into pairs. In a few turns each node meets the leader of one of its lists,
first the one most of whose shingles are shared, which in a group of near copies is the text they
were made from. Links are merged into components, and most lists then hold one component only. Of
those that still hold several, the ones of up to SHORT nodes are expanded, since pairs of ids weigh
less than sets. The nodes of every longer one are searched together, whatever their number (in
blocks): DivideSkip merges the short lists of a node, keeps those with T - L hits or more,
and probes the L longest lists by binary search for them. The sums are exact overlaps. Only what
joins two components leaves a task. A pair within one component needs no link of its own.

Before sets move, pairs of ids meet by parities: bit i of a node tells whether an odd number of its
shingles falls there. Where two differ, so do the sets, so the bits bound the overlap from above, at
a 64th of a set's size. No pair that links is lost by them.

Defined results: null and empty texts and texts without words have no shingles and link with
nothing; up to k - 1 words are one shingle; repeated rows share a node; the component of rows whose
ids are all null is null; shingles are told by 64-bit hashes; other columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, frees, written

#: The share of a node's shingles whose lists it may leave out, in hundredths.
SKIP_PERCENT = 4
#: Frequent shingles put last: at most so many, seen in so many documents of one batch of BATCH_DOCS, in the same share of a smaller one and in two at least.
FREQUENT, BATCH_DOCS, BATCH_LEAST = 1_000_000, 2000, 2
#: Turns in which each node meets one leader; then the pairs of lists up to SHORT nodes are tested, and the search finds all that is left.
TURNS, SHORT = 2, 32
#: Shingles of a block of a list, about; and what a probe costs against a step of merging, for DivideSkip's choice of L.
BLOCK_SHINGLES, PROBE_COST = 1 << 21, 0.1
#: Ids and pairs of ids up to this number are sent to every task (at most 16 MB of longs); more are joined by shuffles.
BROADCAST_ROWS = 1_000_000
#: Rows, and bytes of text, that are cut into shingles at once; pairs of sets that a task is handed at once.
ROWS_AT_ONCE, CHARS_AT_ONCE, PAIRS_AT_ONCE = 1000, 1_500_000, 300

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


class Shingler:
    """texts -> of each the sorted 64-bit hashes of its distinct k-word shingles."""

    def __init__(self, k: int):
        self.k = k

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
        words = lists.values.dictionary_encode()
        which, names = words.indices.to_numpy(), words.dictionary.to_numpy(zero_copy_only=False)
        real = names[which] != "" if "" in names else np.ones(len(which), bool)  # white space at an end gives an empty word
        h = hash_array(names, categorize=False)[which[real]] if len(names) else np.zeros(0, np.uint64)
        end = np.append(0, np.cumsum(real))[lists.offsets.to_numpy()].tolist()
        mixed = np.full(max(len(h) - self.k + 1, 0), np.uint64(0x27220A95FE8D4B0F))
        for i in range(self.k):
            mixed = (mixed ^ h[i : len(h) - self.k + 1 + i]) * _ODD[i % 4]
            mixed ^= mixed >> np.uint64(29)
        out = []
        for x, y in zip(end, end[1:], strict=False):
            if y - x >= self.k:
                s = np.sort(mixed[x : y - self.k + 1])
                out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
            elif y > x:
                out.append(np.frombuffer(hashlib.blake2b(h[x:y].tobytes(), digest_size=8, key=b"short").digest(), np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
        return out


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows with up to ROWS_AT_ONCE rows and about CHARS_AT_ONCE bytes of text."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy()
    a = total = 0
    for b, n in enumerate(size.tolist(), 1):
        total += n
        if b - a == ROWS_AT_ONCE or total >= CHARS_AT_ONCE or b == len(size):
            yield a, b
            a, total = b, 0


def needed(n: int, percent: int) -> int:
    """The least overlap with any partner of a set of n."""
    return -(-percent * n // 100)


def skipped(n: int, percent: int) -> int:
    return max(0, min(SKIP_PERCENT * n // 100 + 1, needed(n, percent) - 1))


def _signature(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def parities(s: np.ndarray) -> np.ndarray:
    """Bit i of as many as s has shingles, rounded up to a power of two and 64 at least: whether an odd number of them is i modulo the bits."""
    bits = max(64, 1 << (len(s) - 1).bit_length()) if len(s) else 64
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1)


def may_link(n: int, p: np.ndarray, m: int, q: np.ndarray, percent: int) -> bool:
    """Whether sets of n and m shingles with parities p and q may overlap enough. The longer parities are folded to the shorter's length."""
    while len(p) != len(q):
        p, q = (p, q) if len(p) > len(q) else (q, p)
        p = p[: len(p) // 2] ^ p[len(p) // 2 :]
    both = (n + m - int(np.bitwise_count(p ^ q).sum())) // 2
    return 100 * both >= percent * (n + m - both)


def frequent_shingles(docs: DataFrame, k: int) -> np.ndarray:
    """Sorted hashes of shingles that many documents of some batch hold; copies count once a batch. They only set the order."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(k)
        for b in batches:
            texts = b.column("text")
            for i in range(0, b.num_rows, BATCH_DOCS):
                part = texts.slice(i, BATCH_DOCS)
                sets = {_signature(s): s for x, y in _slices(part) for s in shingle(part.slice(x, y - x))}
                h, c = np.unique(np.concatenate(list(sets.values())), return_counts=True)
                often = c >= max(2, BATCH_LEAST * min(b.num_rows - i, BATCH_DOCS) // BATCH_DOCS)
                yield pa.record_batch({"h": pa.array(h[often].view(np.int64)), "c": pa.array(c[often].astype(np.int64))})

    counts = written(docs.select("text").mapInArrow(frees(rows), "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "frequent")
    level = F.floor(F.log2(F.col("c").cast("double")) * 8)
    left, low = FREQUENT, None
    for r in sorted(counts.groupBy(level.alias("b")).count().collect(), key=lambda r: -r["b"]):
        if r["count"] > left:
            break
        left, low = left - r["count"], r["b"]
    got = [] if low is None else counts.where(level >= low).select("h").toArrow()["h"].to_numpy()
    return np.sort(np.array(got, np.int64).view(np.uint64))


def prefixes(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The written table of row (its own number), doc_id, n (shingles), sig (of the set), bits (its parities), prefix (hashes)."""
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, k))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, last = Shingler(k), frequent.value
        for b in batches:
            ids, at, texts = b.column("doc_id"), b.column("row"), b.column("text")
            for i, j in _slices(texts):
                out: list[tuple] = []
                for s in shingle(texts.slice(i, j - i)):
                    n = len(s)
                    p = s
                    if n and len(last):
                        often = last[np.minimum(np.searchsorted(last, s), len(last) - 1)] == s
                        p = np.concatenate([s[~often], s[often]])
                    p = p[: min(n, n - needed(n, percent) + 1 + skipped(n, percent))] if n else p
                    out.append((n, _signature(s), parities(s).tobytes(), p.view(np.int64)))
                n, sig, bits, p = zip(*out, strict=True)
                yield pa.record_batch({"row": at.slice(i, j - i), "doc_id": ids.slice(i, j - i), "n": pa.array(n, pa.int64()), "sig": pa.array(sig, pa.binary()), "bits": pa.array(bits, pa.binary()), "prefix": pa.array(p, pa.list_(pa.int64()))})

    text = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return written(text.mapInArrow(frees(rows), "row long, doc_id long, n long, sig binary, bits binary, prefix array<long>"), "prefixes")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): comp is the smallest node reachable by edges (a, b). Large-star and small-star rounds until nothing changes."""

    def mark(e: DataFrame) -> tuple:
        r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        return r["n"], r["s"]

    e = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    seen = mark(e)
    while True:
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.where("a <> b").distinct()
        m = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(m, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(m.select("a", F.col("m").alias("b")))
        last, e = e, written(small.where("a <> b").distinct(), "edges")
        dropped(last)
        now = mark(e)
        if now == seen:
            break
        seen = now
    return e.groupBy("a").agg(F.min("b").alias("comp")).select(F.col("a").alias("node"), "comp").unionAll(e.select("b", "b").toDF("node", "comp").distinct())


def _some(rows: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """rows, marked for broadcast if a count finds them few."""
    return F.broadcast(rows) if rows.count() <= most else rows


def _lists(s: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The written inverted lists that name candidates: h, node, n, share, kept (false where the node leaves the list out)."""
    own = s.where("n > 0").join(_some(nodes.select("node")), s["row"] == F.col("node"), "left_semi")
    post = own.select(F.explode("prefix").alias("h"), F.col("row").alias("node"), F.col("n").cast("int").alias("n"), F.size("prefix").alias("p"))
    # One shuffle: hashes hardly shrink, so that counting them apart from their rows would move them twice.
    held = post.withColumn("df", F.count("*").over(_window("h"))).where("df > 1")
    longest = F.row_number().over(_window("node", F.col("df").desc(), "h"))
    a = F.ceil(F.lit(percent) * F.col("n") / 100.0)
    out_of = F.greatest(F.lit(0), F.least(F.floor(F.lit(SKIP_PERCENT) * F.col("n") / 100.0) + 1, a - 1))
    # The share of a node's shingles that others hold too.
    share = F.floor(100 * F.count("*").over(_window("node")) / F.col("p")).cast("int")
    held = written(held.select("h", "node", "n", (longest > out_of).alias("kept"), share.alias("share")), "held")
    live = held.where("kept").select("h").distinct()
    out = written(held.join(live, "h", "left_semi"), "lists")
    dropped(held)
    return out


def _window(part: str, *order):
    from pyspark.sql.window import Window

    return Window.partitionBy(part).orderBy(*order) if order else Window.partitionBy(part)


def _candidates(s: DataFrame, nodes: DataFrame) -> DataFrame:
    """The written table of node, sig, _id, n, bits of nodes (node)."""
    return written(s.join(_some(nodes), s["row"] == nodes["node"]).select("node", "sig", F.col("doc_id").alias("_id"), "n", "bits"), "candidates")


def _sets(docs: DataFrame, one: DataFrame, k: int) -> DataFrame:
    """The written table of node, shingles of the candidates. Their documents are found by id and told by the set's signature."""
    ids = _some(one.select("_id").distinct())
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    text = text.join(ids, text["doc_id"].eqNullSafe(ids["_id"]), "left_semi")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(k)
        for b in batches:
            texts = b.column("text")
            for i, j in _slices(texts):
                sets = shingle(texts.slice(i, j - i))
                yield pa.record_batch({"sig": pa.array([_signature(x) for x in sets], pa.binary()), "shingles": pa.array([x.tobytes() for x in sets], pa.binary())})

    made = text.select("text").mapInArrow(frees(rows), "sig binary, shingles binary")
    # Rows that repeat an id may bring a set twice; a pair is then verified twice, to the same end.
    return written(made.join(_some(one.select("sig", "node")), "sig").select("node", "shingles"), "sets")


def _near(pairs: DataFrame, candidates: DataFrame, percent: int) -> DataFrame:
    """The written pairs (a, b) whose parities let them link."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("n", "p", "m", "q")]
            ok = [may_link(n, np.frombuffer(p, np.uint8), m, np.frombuffer(q, np.uint8), percent) for n, p, m, q in zip(*cols, strict=True)]
            yield pa.record_batch({"a": b.column("a"), "b": b.column("b")}).filter(pa.array(ok, pa.bool_()))

    x = candidates.select(F.col("node").alias("a"), "n", F.col("bits").alias("p"))
    y = candidates.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("bits").alias("q"))
    return written(pairs.join(x, "a").join(y, "b").select("a", "b", "n", "p", "m", "q").mapInArrow(frees(rows), "a long, b long"), "near")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The written pairs (a, b) with ``link``. Sets meet their pairs in place where the pairs are few, and then their partners' sets in one shuffle."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column("x"), b.column("y"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.record_batch({"a": b.column("a"), "b": b.column("b"), "link": pa.array(ok, pa.bool_())})

    few = _some(pairs)
    x = sets.join(few, sets["node"] == few["a"]).select("a", "b", F.col("shingles").alias("x"))
    partners = _some(pairs.select(F.col("b").alias("node")).distinct())
    y = sets.join(partners, "node", "left_semi").select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    met = x.join(y, "b").select("a", "b", "x", "y").mapInArrow(frees(rows), "a long, b long, link boolean")
    return _short_batches(met, "verified")


def _short_batches(df: DataFrame, name: str) -> DataFrame:
    """df written with short Arrow batches, because sets of long texts are large."""
    conf = df.sparkSession.conf
    usual = conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", PAIRS_AT_ONCE)
    try:
        return written(df, name)
    finally:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", usual)


def _fit(percent: int, n: str, m: str):
    return (F.col(n) * 100 >= F.col(m) * percent) & (F.col(m) * 100 >= F.col(n) * percent)


def _nominated(rows: DataFrame, turn: int, percent: int) -> DataFrame:
    """At most one pair of each node: with the first of its lists' leaders. Leaders share most with others in turn 0; then the order changes with the turn."""
    key = -F.col("share") if turn == 0 else F.xxhash64("node", F.lit(turn))
    lead = rows.groupBy("h").agg(F.min(F.struct(key.alias("key"), "node", "n", "comp")).alias("l"))
    met = rows.join(lead, "h").where(F.col("comp") != F.col("l.comp")).where(_fit(percent, "n", "l.n"))
    best = met.groupBy("node", "n").agg(F.min("l").alias("l"))
    return best.select("node", "n", F.col("l.node").alias("b"), F.col("l.n").alias("m"))


def _every(rows: DataFrame, percent: int) -> DataFrame:
    """All pairs of different components that a kept list names; each of rows brings up to SHORT - 1."""
    other = rows.select("h", F.col("node").alias("b"), F.col("n").alias("m2"), F.col("comp").alias("comp2"))
    return rows.where("kept").join(other, "h").where("comp <> comp2").where(_fit(percent, "n", "m2")).select("node", "b")


def t_occurrences(sets: list[np.ndarray], comp: np.ndarray, percent: int, apart: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links between sets of different components, one where several would join the same two.

    apart: if given, only sets with different values are compared.
    """
    size = np.array([len(x) for x in sets])
    who = np.repeat(np.arange(len(sets)), size)
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    every, member = every[order], who[order]
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    count = np.diff(np.append(first, len(every)))
    number = np.repeat(np.arange(len(first)), count)
    lists = np.empty(len(every), np.int64)
    lists[order] = number  # of each shingle of each set, its list
    key = number * len(sets) + member  # ascending, so that a list's members can be probed
    begin = np.cumsum(size) - size
    root, links = np.unique(comp, return_inverse=True)[1], []
    most = np.bincount(root).argmax()
    for x in np.flatnonzero(root != most):
        own = lists[begin[x] : begin[x] + size[x]]
        own = own[count[own] > 1]
        t = needed(int(size[x]), percent)
        if len(own) < t:
            continue
        own = own[np.argsort(count[own], kind="stable")]
        skip = min(t - 1, int(t / (PROBE_COST * np.log2(count[own[-1]] + 1) + 1)))
        short, long = own[: len(own) - skip], own[len(own) - skip :]
        # The sorted short lists, merged; equal neighbours are occurrences.
        n = count[short]
        met = np.sort(member[np.repeat(first[short] - (np.cumsum(n) - n), n) + np.arange(n.sum())], kind="stable")
        edge = np.flatnonzero(np.concatenate([[True], met[1:] != met[:-1]]))
        hits = np.diff(np.append(edge, len(met)))
        y = met[edge]
        ok = (hits >= t - skip) & (root[y] != root[x]) & (100 * size[y] >= percent * size[x]) & (100 * size[x] >= percent * size[y])
        if apart is not None:
            ok &= apart[y] != apart[x]
        y, hits = y[ok], hits[ok]
        if len(y) and len(long):
            probe = long[:, None] * len(sets) + y
            hits = hits + (key[np.minimum(np.searchsorted(key, probe), len(key) - 1)] == probe).sum(axis=0)
        for z in y[100 * hits >= percent * (size[x] + size[y] - hits)]:
            if root[z] != root[x]:
                links.append((int(x), int(z)))
                root[root == root[z]] = root[x]
    return links


def _searched(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The written links (a, b) that the lists of rows (h, node, n, comp) hold. A list of many shingles is cut into blocks, and every two blocks meet."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def close() -> pa.RecordBatch:
            node, block, comp, shingles = zip(*held, strict=True)
            apart = np.array(block) if now[1] != now[2] else None
            got = t_occurrences(list(shingles), np.array(comp), percent, apart)
            return pa.record_batch({"a": pa.array([node[x] for x, _ in got], pa.int64()), "b": pa.array([node[y] for _, y in got], pa.int64())})

        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("h", "p", "q", "node", "block", "comp")]
            for h, p, q, node, block, comp, x in zip(*cols, b.column("shingles"), strict=True):
                if (h, p, q) != now:
                    if len(held) > 1:
                        yield close()
                    now, held = (h, p, q), []
                held.append((node, block, comp, np.frombuffer(x.as_py(), np.uint64)))
        if len(held) > 1:
            yield close()

    # Lists with the same members need one search. Their sums of hashes tell.
    one = F.sum(F.xxhash64("node").cast("decimal(38,0)"))
    same = rows.groupBy("h").agg(one.alias("members"), F.sum("n").alias("total")).groupBy("members").agg(F.min("h").alias("h"), F.max("total").alias("total"))
    blocks = F.ceil(F.col("total") / BLOCK_SHINGLES).cast("int")
    met = rows.join(same.select("h", blocks.alias("blocks")), "h")
    met = met.select("h", "node", "comp", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"), "blocks")
    met = met.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    met = met.select("h", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "node", "block", "comp")
    order = ["h", "p", "q"]
    # Most sets are in no such list, and needn't move to find that out.
    own = sets.join(_some(rows.select("node").distinct()), "node", "left_semi")
    full = met.join(own, "node").select(*order, "node", "block", "comp", "shingles").repartition(*order).sortWithinPartitions(*order)
    return _short_batches(full.mapInArrow(frees(links), "a long, b long"), "searched")


def groups(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest id reachable by links)."""
    s = prefixes(docs, k, percent)
    nodes = written(s.where("n > 0").groupBy("sig").agg(F.min("row").alias("node"), F.min("doc_id").alias("least")), "nodes")
    lists = _lists(s, nodes, percent)
    candidates = sets = tested = comps = None
    for turn in range(TURNS + 2):
        rows = lists.withColumn("comp", F.col("node")) if comps is None else lists.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        mixed = rows.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m")).where("lo <> hi").select("h", "m")
        rows = written(rows.join(mixed, "h"), "mixed")
        if sets is None:
            candidates = _candidates(s, rows.select("node").distinct())
            sets = _sets(docs, candidates, k)
        if turn <= TURNS:
            met = _nominated(rows, turn, percent) if turn < TURNS else _every(rows.where(F.col("m") <= SHORT), percent)
            pairs = written(met.select(F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b")).distinct(), "pairs")
            near = _near(pairs, candidates, percent)
            dropped(pairs)
            new = _verify(near, sets, percent).where("link").select("a", "b")
            dropped(near)
        else:
            new = _searched(rows.where(F.col("m") > SHORT), sets, percent)
        dropped(rows)
        if not new.isEmpty():
            tested = new if tested is None else tested.unionAll(new)
            comps = written(components(tested), "components")
    for used in (lists, candidates, sets):
        if used is not None:
            dropped(used)
    groups_of = nodes.select("sig", "least")
    if comps is not None:
        first = nodes.join(comps, "node").select("sig", "least", "comp")
        whole = first.groupBy("comp").agg(F.min("least").alias("whole"))
        joined = first.join(whole, "comp").select("sig", "whole")
        groups_of = groups_of.join(joined, "sig", "left").select("sig", F.coalesce("whole", "least").alias("least"))
    linked = s.where("n > 0").select("doc_id", "n", "sig").join(groups_of, "sig").select("doc_id", F.col("n").alias("n_shingles"), F.col("least").alias("component_id"))
    return linked.unionAll(s.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
