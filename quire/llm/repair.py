"""Token ids on disk under Re-Pair grammar compression.

Documents are range-partitioned by id, encoded, and cut into blocks of bounded size. In each block
the frequent pairs of adjacent ids become nonterminals, until none is left or the symbols are used up; a block stores its rules,
the expansion length of every rule, the compressed symbols, and where each document begins. Any
document can be decoded alone: running sums of expansion lengths tell which symbols cover it.

The file format is one binary payload per block in a Parquet dataset (columns shard, block, n_ids,
payload); a payload is, little-endian: b"RPG1", then uint32 base, rules, symbols, documents; rules
as pairs of uint16, expansion lengths as uint32, symbols as uint16; per document int64 id, uint8
"has an id", uint32 first id within the block.

Defined results: null text is empty, so a document of the end id alone; a null id sorts first;
repeated rows and ids are kept as documents of their own, ties in text order; other columns are dropped.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .encoding import encoder

#: A block is closed when it holds so many ids; one document is never cut.
BLOCK_IDS = 1 << 20
#: Pairs replaced per round (more wait for the next one); occurrences that a pair needs to pay for its rule.
PAIRS, LEAST = 8000, 8
END_ID = 1
MAGIC = b"RPG1"


def _frequent(code: np.ndarray, most: int) -> np.ndarray:
    """Sorted pairs that occur LEAST times; the most frequent ones where they are more than ``most``."""
    own = np.sort(code)
    far = own[LEAST - 1 :]  # equal to what lies LEAST - 1 places before
    far = far[far == own[: len(far)]]
    edge = np.flatnonzero(np.concatenate([[True], far[1:] != far[:-1]])) if len(far) else np.zeros(0, np.int64)
    often = far[edge]
    if len(often) > most:
        often = often[np.argsort(-np.diff(np.append(edge, len(far))), kind="stable")[:most]]
    return np.sort(often)


def _hashed(code: np.ndarray) -> np.ndarray:
    return (code * 0x9E3779B1 >> 14) & 0x3FFFF


def _occurrences(code: np.ndarray, places: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the places (sorted; code is the pair at each) hold a chosen pair, and which one; of occurrences that overlap every other one."""
    lefts, rights = np.unique(chosen >> 16), np.unique(chosen & 0xFFFF)
    left, right = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    left[lefts], right[rights] = (1 + np.arange(len(lefts))) * (len(rights) + 1), 1 + np.arange(len(rights))
    table = np.zeros((len(lefts) + 1) * (len(rights) + 1), np.int16)
    table[left[chosen >> 16] + right[chosen & 0xFFFF]] = 1 + np.arange(len(chosen))
    # A small table of hashed pairs, which stays in the cache, passes few places on to the exact one.
    maybe = np.zeros(1 << 18, bool)
    maybe[_hashed(chosen)] = True
    near = np.flatnonzero(maybe.take(_hashed(code)))
    code, places = code[near], places[near]
    which = table.take(left.take(code >> 16) + right.take(code & 0xFFFF))
    hit = np.flatnonzero(which)
    at, which = places[hit], which[hit] - 1
    begin = np.flatnonzero(np.concatenate([[True], np.diff(at) != 1]))
    take = (np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))) % 2 == 0
    return at[take], which[take]


def compress(ids: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rules as pairs, expansion lengths, symbols) of ids below base, until no pair occurs LEAST times or 16 bits are full.

    Nonterminal base + i stands for rules[i]. Each round replaces up to PAIRS pairs and shortens the
    sequence. No occurrence of a replaced pair stays, so that only pairs with a new symbol can have
    become frequent: if the last round took all frequent pairs, the next one counts only beside its symbols.
    """
    seq, room = ids.astype(np.uint16), (1 << 16) - base
    rules: list[np.ndarray] = []
    lengths = np.ones(1 << 16, np.uint32)
    n = 0
    places = np.arange(max(len(seq) - 1, 0))
    while n < room:
        code = seq[places].astype(np.int64) << 16 | seq[places + 1]
        most = min(PAIRS, room - n)
        chosen = _frequent(code.astype(np.uint32), most).astype(np.int64)
        if not len(chosen):
            break
        at, which = _occurrences(code, places, chosen)
        used = np.zeros(len(chosen), bool)
        used[which] = True
        seq[at] = (base + n - 1 + np.cumsum(used)[which]).astype(np.uint16)
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq = seq[keep]
        new = np.stack([chosen[used] >> 16, chosen[used] & 0xFFFF], axis=1).astype(np.uint16)
        lengths[base + n : base + n + len(new)] = lengths[new[:, 0]] + lengths[new[:, 1]]
        rules.append(new)
        n += len(new)
        places = np.arange(len(seq) - 1)
        if len(chosen) < most:
            moved = at - np.arange(len(at))
            beside = np.zeros(len(seq) + 1, bool)
            beside[moved], beside[moved - 1] = True, True  # the last place stands for "before the first"
            places = places[beside[: len(seq) - 1]]
    pairs = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint16)
    return pairs, lengths[base : base + n], seq


def expand(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The ids that symbols stand for, level by level: for a few symbols of one document."""
    seq = symbols
    while len(at := np.flatnonzero(seq >= base)):
        size = np.ones(len(seq), np.int64)
        size[at] = 2
        out = np.repeat(seq, size)
        place = np.cumsum(size)[at] - 2
        out[place], out[place + 1] = rules[seq[at].astype(np.int64) - base].T
        seq = out
    return seq


def expand_all(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The same for a whole block: each rule is expanded once."""
    names = sorted({*symbols[symbols < base].tolist(), *rules[rules < base].tolist()})
    parts = {i: struct.pack("<H", i) for i in names}
    for i, (a, b) in enumerate(rules.tolist(), base):
        parts[i] = parts[a] + parts[b]
    flat = np.frombuffer(b"".join(parts.values()), "<u2")
    start, size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    known = np.fromiter(parts, np.int64, len(parts))
    size[known] = np.fromiter(map(len, parts.values()), np.int64, len(parts)) // 2
    start[known] = np.cumsum(size[known]) - size[known]
    n = size[symbols]
    end = np.cumsum(n)
    return flat[np.repeat(start[symbols] - (end - n), n) + np.arange(end[-1] if len(end) else 0)]


def pack_block(doc_ids: list[int | None], ids: list[bytes], base: int) -> bytes:
    sizes = np.array([len(x) // 2 for x in ids], np.int64)
    rules, lengths, symbols = compress(np.frombuffer(b"".join(ids), "<u2"), base)
    head = MAGIC + struct.pack("<4I", base, len(rules), len(symbols), len(ids))
    known = np.array([i is not None for i in doc_ids], np.uint8)
    docs = np.array([i or 0 for i in doc_ids], "<i8")
    return b"".join([head, rules.astype("<u2").tobytes(), lengths.astype("<u4").tobytes(), symbols.astype("<u2").tobytes(), docs.tobytes(), known.tobytes(), (np.cumsum(sizes) - sizes).astype("<u4").tobytes()])


class Block:
    """A payload, read."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a block of this format")
        self.base, n_rules, n_symbols, n_docs = struct.unpack_from("<4I", payload, 4)
        at = 20

        def part(kind: str, n: int) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(payload, kind, n, at)
            at += x.nbytes
            return x

        self.rules = part("<u2", 2 * n_rules).reshape(-1, 2)
        self.lengths, self.symbols = part("<u4", n_rules), part("<u2", n_symbols)
        docs, known, self.starts = part("<i8", n_docs), part("u1", n_docs), part("<u4", n_docs)
        self.doc_ids = [int(d) if k else None for d, k in zip(docs, known, strict=True)]
        size = np.ones(1 << 16, np.int64)
        size[self.base : self.base + n_rules] = self.lengths
        self.ends = np.cumsum(size[self.symbols])
        self.n_ids = int(self.ends[-1]) if n_symbols else 0

    def all_ids(self) -> np.ndarray:
        return expand_all(self.symbols, self.rules, self.base)

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document, expanding only the symbols that cover it."""
        a = int(self.starts[k])
        b = int(self.starts[k + 1]) if k + 1 < len(self.starts) else self.n_ids
        s, e = np.searchsorted(self.ends, a, "right"), np.searchsorted(self.ends, b, "left") + 1
        skip = a - (int(self.ends[s - 1]) if s else 0)
        return expand(self.symbols[s:e], self.rules, self.base)[skip : skip + b - a]


def write(docs: DataFrame, tokenizer: str, vocabulary: int) -> DataFrame:
    """The written dataset of blocks: shard, block, n_ids, payload. Ascending shard, block and place are ascending doc_id."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer, byte_level=False), struct.pack("<H", END_ID)
        names: list[int | None] = []
        held: list[bytes] = []
        size, block, shard = 0, 0, 0

        def close():
            nonlocal size, block
            out = pa.record_batch({"shard": pa.array([shard], pa.int32()), "block": pa.array([block], pa.int32()), "n_ids": pa.array([size // 2], pa.int64()), "payload": pa.array([pack_block(names, held, vocabulary)], pa.binary())})
            names.clear()
            held.clear()
            size, block = 0, block + 1
            return out

        for b in batches:
            ids, texts, parts = b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("shard").to_pylist()
            for i in range(0, len(ids), 2000):
                for d, x, p in zip(ids[i : i + 2000], enc.encode(texts[i : i + 2000]), parts[i : i + 2000], strict=True):
                    shard = p
                    names.append(d)
                    held.append(x + end)
                    size += len(x) + 2
                    if size >= 2 * BLOCK_IDS:
                        yield close()
        if names:
            yield close()

    by_id = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    blocks = by_id.withColumn("shard", F.spark_partition_id()).mapInArrow(rows, "shard int, block int, n_ids long, payload binary")
    return written(blocks, "repair")


def read(blocks: DataFrame) -> DataFrame:
    """Per document, from the blocks alone: doc_id, start (ids of all documents before), n_tokens, ids_crc32.

    The ids before each shard are running sums of one number per shard, made on the driver.
    """
    before, total = {}, 0
    for r in sorted(blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect(), key=lambda r: r["shard"]):
        before[r["shard"]], total = total, total + r["n"]
    # Within a shard, the ids before each block: a shard is one task's output.
    sizes = blocks.select("shard", "block", "n_ids").groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("block", "n_ids"))).alias("sizes"))
    rows_of = blocks.join(sizes, "shard")
    skipped = F.aggregate(F.filter("sizes", lambda x: x["block"] < F.col("block")), F.lit(0).cast("long"), lambda a, x: a + x["n_ids"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, skip, payload in zip(b.column("shard").to_pylist(), b.column("skip").to_pylist(), b.column("payload"), strict=True):
                k = Block(payload.as_py())
                ids = k.all_ids().astype("<u4")
                ends = np.append(k.starts[1:], len(ids)).astype(np.int64)
                raw, start = ids.tobytes(), before[shard] + skip
                crc = [zlib.crc32(raw[4 * a : 4 * e]) for a, e in zip(k.starts.tolist(), ends.tolist(), strict=True)]
                yield pa.record_batch({"doc_id": pa.array(k.doc_ids, pa.int64()), "start": pa.array(k.starts.astype(np.int64) + start), "n_tokens": pa.array(ends - k.starts), "ids_crc32": pa.array(crc, pa.int64())})

    return rows_of.select("shard", skipped.alias("skip"), "payload").mapInArrow(rows, "doc_id long, start long, n_tokens long, ids_crc32 long")
