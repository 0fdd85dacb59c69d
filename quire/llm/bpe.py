"""Byte-level BPE encoding and decoding with Spark higher-order functions.

Texts are cut into chunks where the pattern always cuts, and each distinct chunk of a bounded run of
documents is cut into words once. The runs' distinct words meet in buckets by hash, so that each word
of the corpus is encoded once: one fold over its bytes merges the adjacent pair of the lowest rank
until none is left. Ranks are a literal in the plan (a scalar subquery over the pairs that the rank
file merges, an array of small maps, because Spark looks maps up linearly). Decoding concatenates the
binary pieces of the ids. The words' codes go back to their runs, whose documents are then put together.

Only distinct words and places are shuffled; a run and a bucket are bounded at every size of the corpus.
The fold takes quadratic time in a word, so words over LONG bytes are merged by a small helper with a heap.

Defined results: a null text is empty and has no ids; repeated rows and null ids are encoded each;
very long texts are never cut; other columns are dropped; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frees, shuffle_partitions, written_by
from .encoding import chunked, marked, texts_of

#: A run of documents ends when it holds so many characters.
RUN_CHARS = 10_000_000
#: Buckets of words a run's worth of characters makes.
SPREAD = 4
LONG = 256
#: Spark writes a table in at most so many buckets; beyond, a bucket holds several runs.
MOST_BUCKETS = 100_000
#: Small maps in the rank literal.
MAPS = 1 << 15
#: A part of a word in the fold: rank of the pair it begins, its offset and its id, in one long, so that the least one is merged next.
ID_BITS, OFFSET_BITS = 18, 24
RANK_AT = ID_BITS + OFFSET_BITS
ID_MASK = (1 << ID_BITS) - 1
NONE = 1 << 20

CODES = "run long, bucket int, ids_of binary, ids binary, length binary, text binary"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _map_of(left, right):
    """The small map that holds a pair of ids."""
    return (left * 40503 + right) % MAPS


def rank_literal(spark: SparkSession, ranks: dict[bytes, int]) -> Column:
    """array<map<long, int>>, by _map_of: the rank of each pair of ids whose pieces joined are a piece."""
    maps: list[dict[int, int]] = [{} for _ in range(MAPS)]
    for piece, rank in ranks.items():
        for i in range(1, len(piece)):
            left, right = ranks.get(piece[:i]), ranks.get(piece[i:])
            if left is not None and right is not None:
                maps[_map_of(left, right)][left << ID_BITS | right] = rank
    kind = pa.list_(pa.map_(pa.int64(), pa.int32()))
    return spark.createDataFrame(pa.table({"ranks": pa.array([[list(m.items()) for m in maps]], kind)})).scalar()


def piece_literal(spark: SparkSession, ranks: dict[bytes, int]) -> Column:
    """array<binary>: the piece of each id."""
    pieces: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    return spark.createDataFrame(pa.table({"pieces": pa.array([pieces], pa.list_(pa.binary()))})).scalar()


class Starts:
    """The fold's start for words: a part per byte, or one part for a word that is a piece itself."""

    def __init__(self, ranks: dict[bytes, int]):
        if max(ranks.values()) > min(ID_MASK, NONE - 1):
            raise ValueError("more ids than the fold has bits for")
        self.ranks = ranks
        self.one, self.two = np.zeros(256, np.int64), np.full((256, 256), NONE, np.int64)
        for piece, rank in ranks.items():
            if len(piece) == 1:
                self.one[piece[0]] = rank
            elif len(piece) == 2:
                self.two[piece[0], piece[1]] = rank

    def __call__(self, words: list[bytes]) -> pa.ListArray:
        """A long word has no parts: the fold leaves it out."""
        whole = [self.ranks.get(w) for w in words]
        parts = [b"\0" if r is not None else w if len(w) <= LONG else b"" for w, r in zip(words, whole, strict=True)]
        flat = np.frombuffer(b"".join(parts), np.uint8)
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        end = np.cumsum(size)
        rank = np.full(len(flat), NONE, np.int64)
        rank[:-1] = self.two[flat[:-1], flat[1:]]
        rank[end[size > 0] - 1] = NONE
        offset = np.arange(len(flat)) - np.repeat(end - size, size)
        part = rank << RANK_AT | offset << ID_BITS | self.one[flat]
        known = np.array([r is not None for r in whole], bool)
        part[end[known] - 1] = NONE << RANK_AT | np.array([r for r in whole if r is not None], np.int64)
        return pa.ListArray.from_arrays(pa.array(np.append(0, end).astype(np.int32)), pa.array(part))


def encode_word(start: Column, ranks: Column) -> Column:
    """The ids of one word as array<int>, from its start."""
    end = F.lit(1 << 20)

    def ident(e: Column) -> Column:
        return e.bitwiseAND(F.lit(ID_MASK))

    def ranked(left: Column, right: Column) -> Column:
        rank = F.try_element_at(F.get(ranks, _map_of(left, right).cast("int")), F.shiftleft(left, ID_BITS).bitwiseOR(right))
        return F.shiftleft(F.coalesce(rank, F.lit(NONE)).cast("long"), RANK_AT)

    def merged(s: Column, i: Column) -> Column:
        """Part i (from 1) takes in its right neighbour; its left neighbour's pair is another one now."""
        left, own = F.get(s, i - 2), F.get(s, i - 1)
        new = F.shiftright(own, RANK_AT)
        before = ranked(ident(left), new).bitwiseOR(left.bitwiseAND(F.lit((1 << RANK_AT) - 1)))
        here = ranked(new, ident(F.get(s, i + 1))).bitwiseOR(own.bitwiseAND(F.lit((1 << RANK_AT) - 1 - ID_MASK))).bitwiseOR(new)
        rest = F.slice(s, i + 2, end)
        return F.when(i > 1, F.concat(F.slice(s, F.lit(1), i - 2), F.array(before, here), rest)).otherwise(F.concat(F.array(here), rest))

    def step(s: Column, _: Column) -> Column:
        least = F.array_min(s)
        return F.when(least >= F.lit(NONE << RANK_AT), s).otherwise(F.get(F.transform(F.array(F.array_position(s, least).cast("int")), lambda i: merged(s, i)), F.lit(0)))

    folded = F.when(F.size(start) > 1, F.aggregate(F.sequence(F.lit(2), F.size(start)), start, step)).otherwise(start)
    return F.transform(folded, lambda e: ident(e).cast("int"))


def decode_ids(ids: Column, pieces: Column) -> Column:
    return F.aggregate(ids, F.lit(b""), lambda a, i: F.concat(a, F.get(pieces, i)))


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a long word: a heap of pairs by (rank, place) over a linked list of parts."""
    nxt = list(range(1, len(word) + 1))
    prev = list(range(-1, len(word) - 1))
    part: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
    heap: list[tuple[int, int, bytes]] = []

    def offer(i: int) -> None:
        j = nxt[i]
        if j < len(word):
            both = part[i] + part[j]
            if (r := ranks.get(both)) is not None:
                heapq.heappush(heap, (r, i, both))

    for i in range(len(word) - 1):
        offer(i)
    while heap:
        _, i, both = heapq.heappop(heap)
        j = nxt[i]
        if part[i] is None or j >= len(word) or part[i] + part[j] != both:
            continue
        part[i], part[j] = both, None
        nxt[i] = nxt[j]
        if nxt[i] < len(word):
            prev[nxt[i]] = i
        offer(i)
        if prev[i] >= 0:
            offer(prev[i])
    return [ranks[p] for p in part if p is not None]


def _packed(x: np.ndarray) -> bytes:
    """Numbers byte by byte, all lowest bytes first, compressed."""
    raw = np.ascontiguousarray(x).view("u1").reshape(len(x), -1).T.tobytes() if len(x) else b""
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def _unpacked(x: bytes, kind: str = "<i4") -> np.ndarray:
    n, kind = int.from_bytes(x[:8], "little"), np.dtype(kind)
    raw = np.frombuffer(pa.decompress(x[8:], n, codec="zstd", asbytes=True) if n else b"", "u1")
    return np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T).view(kind).ravel()


def _packed_words(words: list[bytes]) -> tuple[bytes, bytes]:
    return _packed(np.fromiter(map(len, words), "<i4", len(words))), _packed(np.frombuffer(b"".join(words), "u1"))


def _words_of(lengths: bytes, text: bytes) -> pa.Array:
    ends = np.append(0, np.cumsum(_unpacked(lengths))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(_unpacked(text, "u1"))])


def _renumbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 0 on, renamed so that frequent ones are small, and the old name of each."""
    old = np.argsort(-np.bincount(x), kind="stable") if len(x) else np.zeros(0, np.int64)
    new = np.empty(len(old), np.int32)
    new[old] = np.arange(len(old))
    return new[x], old


def _firsts(x: np.ndarray) -> np.ndarray:
    """Numbers given in order of first use: 0 for a first use, else the number plus one."""
    first = np.zeros(len(x), bool)
    first[np.unique(x, return_index=True)[1]] = True
    return np.where(first, 0, x + 1).astype("<i4")


def _numbers(x: np.ndarray) -> np.ndarray:
    """What _firsts was given."""
    return np.where(x == 0, np.cumsum(x == 0) - 1, x - 1)


class Run:
    """A run of documents: the places of their chunks among its distinct chunks, and of those chunks' words among its distinct words."""

    def __init__(self, find, buckets: int):
        self.find, self.buckets = find, buckets
        self.docs: list[int | None] = []
        self.sizes: list[int] = []
        self.places: list[np.ndarray] = []
        self.chunks: dict[tuple[bool, str], int] = {}
        self.chars = 0

    def add(self, docs: list[int | None], texts: list[str | None]) -> None:
        self.docs += docs
        self.chars += sum(len(t or "") for t in texts)
        known, cut = self.chunks, [marked(t) for t in texts]
        distinct, which, ends = chunked([t for t in cut if t is not None])
        at = np.array([known.setdefault((True, x), len(known)) for x in distinct], np.int32)
        which, k = at[which], 0
        for t, c in zip(texts, cut, strict=True):
            if c is not None:
                own = which[ends[k] : ends[k + 1]]
                k += 1
            else:  # its words are its chunks
                own = np.array([known.setdefault((False, w), len(known)) for w in self.find(t or "")], np.int32)
            self.sizes.append(len(own))
            self.places.append(own)

    def row(self, run: int) -> pa.RecordBatch:
        """run, docs, the packed places, and the packed words by bucket."""
        places, old = _renumbered(np.concatenate(self.places) if self.places else np.zeros(0, np.int32))
        chunks, words = list(self.chunks), {}
        found = [self.find(texts_of(x)) if cut else [x] for cut, x in map(chunks.__getitem__, old.tolist())]
        chunk_words = np.array([words.setdefault(w, len(words)) for f in found for w in f], np.int32)
        bucket = (pd.util.hash_array(np.array(list(words), object)) % np.uint64(self.buckets)).astype(np.int32) if words else np.zeros(0, np.int32)
        order = np.argsort(bucket, kind="stable")
        ordered = list(map([w.encode() for w in words].__getitem__, order.tolist()))
        own, first = np.unique(bucket[order], return_index=True)
        ends = [*first.tolist(), len(order)]
        parts = [{"bucket": b, "lengths": x, "text": t} for b, (x, t) in zip(own.tolist(), (_packed_words(ordered[i:j]) for i, j in zip(ends, ends[1:], strict=False)), strict=True)]
        packed = (np.array(self.sizes, "<i4"), places.astype("<i4"), np.array([len(f) for f in found], "<i4"), _firsts(chunk_words), bucket)
        return pa.record_batch([
            pa.array([run], pa.int64()), pa.array([self.docs], pa.list_(pa.int64())), *(pa.array([_packed(x)], pa.binary()) for x in packed),
            pa.array([parts], pa.list_(pa.struct([("bucket", pa.int32()), ("lengths", pa.binary()), ("text", pa.binary())]))),
        ], names=["run", "docs", *"abcde", "parts"])


def _runs(pattern: str, buckets: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(pattern).findall
        number, run = TaskContext.get().partitionId() << 32, Run(find, buckets)
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                run.add(part.column("doc_id").to_pylist(), part.column("text").to_pylist())
                if run.chars >= RUN_CHARS:
                    yield run.row(number)
                    number, run = number + 1, Run(find, buckets)
        if run.docs:
            yield run.row(number)

    return frees(rows)


def _gather(ranks: dict[bytes, int]):
    """Rows (run, bucket, packed words) sorted by bucket -> a row per bucket with its distinct words and whose they are."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = Starts(ranks)
        bucket, runs, lists = None, [], []

        def close() -> pa.RecordBatch:
            found = pa.concat_arrays(lists).dictionary_encode()
            return pa.record_batch({
                "bucket": pa.array([bucket], pa.int32()), "runs": pa.array([runs], pa.list_(pa.int64())), "counts": pa.array([[len(x) for x in lists]], pa.list_(pa.int32())),
                "which": pa.array([_packed(found.indices.to_numpy().astype("<i4"))], pa.binary()),
                "words": pa.ListArray.from_arrays(pa.array([0, len(found.dictionary)], pa.int32()), found.dictionary),
                "starts": pa.ListArray.from_arrays(pa.array([0, len(found.dictionary)], pa.int32()), starts(found.dictionary.to_pylist())),
            })

        for batch in batches:
            for r, b, x, t in zip(*(batch.column(c).to_pylist() for c in ("run", "bucket", "lengths", "text")), strict=True):
                if b != bucket and lists:
                    yield close()
                    runs, lists = [], []
                bucket = b
                runs.append(r)
                lists.append(_words_of(x, t))
        if lists:
            yield close()

    return frees(rows)


def _spread(ranks: dict[bytes, int]):
    """A bucket's codes and decoded words -> a row per run that holds words of the bucket."""
    pieces = {r: p for p, r in ranks.items()}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                codes, decoded = batch.column("codes")[k].values, batch.column("decoded")[k].values
                if long := {i: merge_long(w, ranks) for i, w in enumerate(batch.column("words")[k].as_py()) if len(w) > LONG and w not in ranks}:
                    codes = pa.array([long.get(i, c) for i, c in enumerate(codes.to_pylist())], codes.type)
                    decoded = pa.array([b"".join(map(pieces.__getitem__, long[i])) if i in long else d for i, d in enumerate(decoded.to_pylist())], decoded.type)
                which, at = _unpacked(batch.column("which")[k].as_py()), 0
                for run, n in zip(batch.column("runs")[k].as_py(), batch.column("counts")[k].as_py(), strict=True):
                    own = pa.array(which[at : at + n])
                    at += n
                    c, d = codes.take(own), decoded.take(own)
                    text = np.frombuffer(b"".join(d.to_pylist()), np.uint8)
                    packed = (c.value_lengths().to_numpy(), c.flatten().to_numpy(), pc.binary_length(d).to_numpy(), text)
                    yield pa.record_batch(
                        [pa.array([run], pa.int64()), batch.column("bucket").slice(k, 1), *(pa.array([_packed(x)], pa.binary()) for x in packed)], names=["run", "bucket", "ids_of", "ids", "length", "text"]
                    )

    return frees(rows)


def encode(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """Runs of documents, each a row.

    run; docs: its documents' ids; packed: a, the number of chunks of each; b, the places of these
    chunks; c, the number of words of each distinct chunk; d, the numbers of these words by first use;
    e, the bucket of each word; and codes, by bucket for its words and packed: the number of ids of
    each, these ids, the length of what they decode to, and these bytes.
    """
    spark, ranks = docs.sparkSession, read_ranks(rank_path)
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(shuffle_partitions(spark), -(-chars // RUN_CHARS))
    runs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _runs(pattern, SPREAD * parts), "run long, docs array<long>, a binary, b binary, c binary, d binary, e binary, parts array<struct<bucket:int,lengths:binary,text:binary>>"
    )
    held = min(parts, MOST_BUCKETS)
    runs = written_by(runs, "bpe", "run", held)
    words = runs.select("run", F.explode("parts").alias("p")).select("run", "p.bucket", "p.lengths", "p.text")
    buckets = words.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_gather(ranks), "bucket int, runs array<long>, counts array<int>, which binary, words array<binary>, starts array<array<long>>")
    # A subquery can't stand inside a lambda, so the literals are columns of the few wide rows that buckets are.
    lit = buckets.withColumns({"_ranks": rank_literal(spark, ranks), "_pieces": piece_literal(spark, ranks)})
    codes = lit.withColumn("codes", F.transform("starts", lambda s: encode_word(s, F.col("_ranks"))))
    decoded = codes.withColumn("decoded", F.transform("codes", lambda c: decode_ids(c, F.col("_pieces"))))
    back = decoded.select("bucket", "runs", "counts", "which", "words", "codes", "decoded").mapInArrow(_spread(ranks), CODES)
    # A run's codes are bounded as the run is. The runs lie in buckets, so only codes are shuffled.
    by_run = back.repartition(held, "run").groupBy("run").agg(F.sort_array(F.collect_list(F.struct("bucket", "ids_of", "ids", "length", "text"))).alias("codes"))
    return runs.select("run", "docs", *"abcde").hint("merge").join(by_run, "run", "left")


def digests(encoded: DataFrame) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]

    def cut(flat: bytes, size: np.ndarray) -> list[bytes]:
        ends = np.append(0, np.cumsum(size)).tolist()
        return [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def joined(words: list[bytes], chunks: list[list[int]]) -> list[bytes]:
        return [words[c[0]] if len(c) == 1 else b"".join([words[w] for w in c]) for c in chunks]

    def finish(docs: list[int | None], packed: list[bytes], codes: list[dict]) -> pa.RecordBatch:
        sizes, places, chunk_sizes, chunk_words, bucket = map(_unpacked, packed)
        rank = np.empty(len(bucket), np.int64)
        rank[np.argsort(bucket, kind="stable")] = np.arange(len(bucket))
        chunk_words = rank[_numbers(chunk_words)]
        n_ids, ids, lengths = (np.concatenate([np.zeros(0, "<i4"), *(_unpacked(p[k]) for p in codes)]) for k in ("ids_of", "ids", "length"))
        text = b"".join(_unpacked(p["text"], "u1").tobytes() for p in codes)
        ends = np.append(0, np.cumsum(chunk_sizes)).tolist()
        flat = chunk_words.tolist()
        chunks = [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        decimal = [b"%d," % i for i in range(int(ids.max(initial=0)) + 1)]
        width = np.fromiter(map(len, decimal), np.int64, len(decimal))[ids]
        width_to = np.append(0, np.cumsum(width))
        id_end = np.cumsum(n_ids)
        written_ids = joined(cut(b"".join(map(decimal.__getitem__, ids.tolist())), width_to[id_end] - width_to[id_end - n_ids]), chunks)
        decoded = joined(cut(text, lengths), chunks)
        of_words = np.append(0, np.cumsum(n_ids[chunk_words].astype(np.int64)))
        chunk_end = np.cumsum(chunk_sizes)
        of_chunk = of_words[chunk_end] - of_words[chunk_end - chunk_sizes]
        of_places = np.append(0, np.cumsum(of_chunk[places]))
        out, at = [], 0
        for d, n in zip(docs, sizes.tolist(), strict=True):
            p = places[at : at + n].tolist()
            i, t = b"".join([written_ids[x] for x in p]), b"".join([decoded[x] for x in p])
            out.append((d, int(of_places[at + n] - of_places[at]), sha256(i[:-1]).hexdigest(), sha256(t).hexdigest()))
            at += n
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                yield finish(b.column("docs")[k].as_py(), [b.column(c)[k].as_py() for c in "abcde"], b.column("codes")[k].as_py() or [])

    return encoded.mapInArrow(frees(rows), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
