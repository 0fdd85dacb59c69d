"""Packing documents into training windows by lexical retrieval.

Texts are encoded once and written. Documents are sorted by their weightiest terms: first the
weightiest of those that a shard's worth of documents hold, then of rarer and rarer ones. Shards of
up to SHARD documents are cut from that order, so that documents that share terms meet at any size
of the corpus, and a term of very many documents is split by the next ones. Each shard holds a BM25
inverted index over token ids, with document frequencies of the whole corpus. A document longer than a window fills windows of its own; what remains of it is a seed or a neighbour.
A seed's best unused neighbours fill its window greedily, the last one being cut where the window
ends; what is left of that one stays unused. The last, partly filled window of a shard is cut into
sequences of powers of two, so nothing is padded.

Defined results: a null text is a document of the end id alone; each row is a document of its own,
also where ids repeat or are null; equal scores go to the smaller place in the shard; other columns
are dropped; an empty table gives no pieces.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frees, shuffle_partitions, written
from .encoding import encoder

WINDOW, END_ID = 1024, 0
#: A shard is closed at so many documents or ids.
SHARD, SHARD_IDS = 512, 1 << 22
#: Sort keys: the weightiest term among those that so many documents hold.
LEVELS = (SHARD // 2, SHARD // 16, 2)
#: Bytes of ids a partition holds, about.
PARTITION_BYTES = 8 << 20
#: BM25's constants.
K1, B = 1.2, 0.75

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The written table of doc_id, row (its own number), n_ids, ids (16 bits each, with the end id)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer, byte_level=True), struct.pack("<H", END_ID)
        for b in batches:
            for i in range(0, b.num_rows, 2000):
                part = b.slice(i, 2000)
                ids = [x + end for x in enc.encode(part.column("text").to_pylist())]
                yield pa.record_batch({"doc_id": part.column("doc_id"), "row": part.column("row"), "n_ids": pa.array([len(x) // 2 for x in ids], pa.int64()), "ids": pa.array(ids, pa.binary())})

    rows_of = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), "text")
    return written(rows_of.mapInArrow(frees(rows), "doc_id long, row long, n_ids long, ids binary"), "packing")


def document_frequencies(encoded: DataFrame) -> np.ndarray:
    """Documents that hold each id, over the whole corpus: at most one row per id of the vocabulary reaches the driver."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(1 << 16, np.int64)
        for b in batches:
            for x in b.column("ids"):
                mark = np.zeros(1 << 16, bool)
                mark[np.frombuffer(x.as_py(), "<u2")] = True
                df += mark
        at = np.flatnonzero(df)
        yield pa.record_batch({"id": pa.array(at.astype(np.int32)), "n": pa.array(df[at])})

    out = np.zeros(1 << 16, np.int64)
    for r in encoded.select("ids").mapInArrow(frees(rows), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


class Index:
    """BM25 over the documents of one shard."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean_length: float):
        self.n = len(docs)
        held = [np.unique(x, return_counts=True) for x in docs]
        term = np.concatenate([t for t, _ in held])
        tf = np.concatenate([c for _, c in held]).astype(float)
        doc = np.repeat(np.arange(self.n), [len(t) for t, _ in held])
        norm = K1 * (1 - B + B * np.array([len(x) for x in docs]) / mean_length)
        weight = idf[term] * tf * (K1 + 1) / (tf + norm[doc])
        by = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[by], weight[by]
        own, first, count = np.unique(term[by], return_index=True, return_counts=True)
        # A seed looks up all its terms that another document of the shard holds.
        self.start, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.start[own], self.size[own] = first, np.where(count > 1, count, 0)
        self.terms = [t[self.size[t] > 0] for t, _ in held]

    def scores(self, seed: int) -> np.ndarray:
        start, size = self.start[self.terms[seed]], self.size[self.terms[seed]]
        # The places of all lists, one after the other.
        at = np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)
        return np.bincount(self.doc[at], self.weight[at], self.n)


def fill(sizes: list[int], index: Index) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (document, start, length). Documents' whole windows stand alone; the rest are packed."""
    out = [[(d, k * WINDOW, WINDOW)] for d, n in enumerate(sizes) for k in range(n // WINDOW)]
    start = np.array([n // WINDOW * WINDOW for n in sizes], np.int64)
    left = np.array(sizes, np.int64) - start
    seed, last = 0, []
    while True:
        while seed < len(sizes) and left[seed] == 0:
            seed += 1
        if seed == len(sizes):
            break
        score = index.scores(seed)
        row, room = [(seed, int(start[seed]), int(left[seed]))], WINDOW - int(left[seed])
        left[seed] = 0
        if room:
            score[left == 0] = -1.0
            for d in np.argsort(-score, kind="stable"):
                if score[d] < 0 or not room:
                    break
                take = min(room, int(left[d]))
                row.append((int(d), int(start[d]), take))
                start[d] += take
                left[d] -= take
                room -= take
        if room:
            last = row  # nothing unused is left
        else:
            out.append(row)
    power = WINDOW
    while last:
        power = min(power, 1 << (sum(x[2] for x in last).bit_length() - 1))
        row, rest, room = [], [], power
        for d, s, n in last:
            if take := min(n, room):
                row.append((d, s, take))
            if n > take:
                rest.append((d, s + take, n - take))
            room -= take
        out.append(row)
        last = rest
    return out


def content_keys(encoded: DataFrame, df: np.ndarray, idf: np.ndarray, mean_length: float) -> DataFrame:
    """encoded with k0, k1, ...: by level the weightiest of a document's terms, ties to the smaller id, -1 without one."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = [np.where(df >= least, idf, 0).astype(np.float32) for least in LEVELS]
        for b in batches:
            keys: list[list[int]] = [[] for _ in LEVELS]
            for x in b.column("ids"):
                ids = np.frombuffer(x.as_buffer(), "<u2")
                t, tf = np.unique(ids, return_counts=True)
                share = tf / (tf + K1 * (1 - B + B * len(ids) / mean_length))
                for k, w in zip(keys, weights, strict=True):
                    own = w[t] * share
                    best = int(own.argmax())
                    k.append(int(t[best]) if own[best] > 0 else -1)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(k, pa.int32()) for k in keys)], names=[*b.schema.names, *(f"k{i}" for i in range(len(keys)))])

    kept = encoded.select("row", "doc_id", "ids")
    return kept.mapInArrow(frees(rows), "row long, doc_id long, ids binary, " + ", ".join(f"k{i} int" for i in range(len(LEVELS))))


def pack(encoded: DataFrame) -> DataFrame:
    """The pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    total = encoded.agg(F.count("*").alias("n"), F.sum("n_ids").alias("ids")).first()
    n = total["n"]
    df = document_frequencies(encoded)
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5)).astype(np.float32)
    mean_length = (total["ids"] or 1) / max(n, 1)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[int | None] = []
        docs: list[np.ndarray] = []
        held, part, sequence = 0, 0, 0

        def close() -> pa.RecordBatch:
            nonlocal sequence
            out: list[tuple] = []
            for row in fill([len(x) for x in docs], Index(docs, idf, mean_length)):
                at = 0
                for d, s, length in row:
                    out.append((names[d], s, length, zlib.crc32(docs[d][s : s + length].astype("<u4").tobytes()), len(docs[d]), part << 40 | sequence, at))
                    at += length
                sequence += 1
            names.clear()
            docs.clear()
            return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

        for b in batches:
            for p, d, x in zip(b.column("part").to_pylist(), b.column("doc_id").to_pylist(), b.column("ids"), strict=True):
                part = p
                names.append(d)
                docs.append(np.frombuffer(x.as_py(), "<u2"))
                held += len(docs[-1])
                if len(docs) == SHARD or held >= SHARD_IDS:
                    yield close()
                    held = 0
        if docs:
            yield close()

    order = [*(f"k{i}" for i in range(len(LEVELS))), "row"]
    parts = max(shuffle_partitions(encoded.sparkSession), -(-2 * (total["ids"] or 0) // PARTITION_BYTES))
    dealt = content_keys(encoded, df, idf, mean_length).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return dealt.select(F.spark_partition_id().alias("part"), "doc_id", "ids").mapInArrow(frees(rows), PIECES)
