"""Periodic runs of words: Karp-Miller-Rosenberg names of all factors whose length is a power of two.

A run is a stretch of words with smallest period q, at least FACTOR * q and LEAST words long, that no
neighbouring word extends. A level names equal factors of 2^k words with equal numbers, from pairs of
names of the level below; a factor that occurs once has no name, so levels thin out and end by
themselves. How far two places agree is read off the levels in descending order. Every run of period
q holds two neighbours of the grid of step 2q that agree for more than q words, so the grid's places
with equal names are the only candidates; each is extended both ways. Documents are numbered with
their words' names and share one numpy pass; no document is cut.

Defined results: a null or empty text, or one without words, has no runs and an empty collapsed text;
repeated rows, null ids and columns of any name stay; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import unused

FACTOR, LEAST = 4, 6
#: Texts share a numpy pass up to so many bytes; a longer one has a pass of its own.
AT_ONCE = 4_000_000
#: A level with fewer names than this share of the words is kept as a sorted list of places.
SPARSE = 1 / 8
RUN = T.ArrayType(T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")]), False)
_RUN = pa.list_(pa.struct([pa.field(n, pa.int64(), False) for n in ("start", "length", "period")]))


class Level:
    """The names of factors of 2^k words by place; -1 where the factor occurs once or would pass the end."""

    def __init__(self, dense: np.ndarray, named: np.ndarray):
        self.n = len(dense) - 1
        self.sparse = len(named) < SPARSE * self.n
        self.places, self.names = (named, dense[named]) if self.sparse else (None, dense)

    def at(self, i: np.ndarray) -> np.ndarray:
        i = np.where(i < 0, self.n, i)
        if not self.sparse:
            return self.names[i]
        if not len(self.places):
            return np.full(len(i), -1, np.int32)
        k = np.minimum(np.searchsorted(self.places, i), len(self.places) - 1)
        return np.where(self.places[k] == i, self.names[k], -1)


def _named(keys: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers equal keys that occur twice or more: the names by place, and the places that have one."""
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    dense = np.full(n + 1, -1, np.int32)
    dense[at[again]] = inverse[again]
    return dense, at[again]


def _candidates(dense: np.ndarray, k: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the grids of periods 2^k to 2^(k+1) - 1 whose factor of 2^k words is the one a period further."""
    n = len(dense) - 1
    q = np.arange(1 << k, min(2 << k, longest // FACTOR + 1, n), dtype=np.int64)
    if not len(q):
        return q, q
    many = (n - q - 1) // (2 * q) + 1
    period = np.repeat(q, many)
    place = (np.arange(len(period)) - np.repeat(np.cumsum(many) - many, many)) * 2 * period
    same = (dense[place] >= 0) & (dense[place] == dense[place + period])
    return place[same], period[same]


def _agree(levels: list[Level], i: np.ndarray, j: np.ndarray, back: bool) -> np.ndarray:
    """How many words from i and j on (back: before i and j) are equal."""
    length = np.zeros(len(i), np.int64)
    for k in reversed(range(len(levels))):
        a, b = (i - length - (1 << k), j - length - (1 << k)) if back else (i + length, j + length)
        x = levels[k].at(a)
        length += ((x >= 0) & (x == levels[k].at(b))).astype(np.int64) << k
    return length


def periodic(codes: np.ndarray, document: np.ndarray, longest: int) -> np.ndarray:
    """Runs of a sequence of word codes as rows (start, end, period), sorted by start, then period.

    document numbers each word's document, ascending; no run crosses documents. longest: words of the longest one.
    """
    n = len(codes)
    found = [np.zeros((0, 2), np.int64)]
    levels: list[Level] = []
    keys, at = document * (int(codes.max(initial=0)) + 1) + codes, np.arange(n)
    while len(at):
        dense, named = _named(keys, at, n)
        k = len(levels)
        found.append(np.stack(_candidates(dense, k, longest), 1))
        levels.append(Level(dense, named))
        at = named[named + (1 << k) < n]
        right = dense[at + (1 << k)]
        at, right = at[right >= 0], right[right >= 0]
        keys = (dense[at].astype(np.int64) << 32) | right
    i, q = np.concatenate(found).T
    runs = []
    for part in range(0, len(i), 1_000_000):
        x, p = i[part : part + 1_000_000], q[part : part + 1_000_000]
        start, end = x - _agree(levels, x, x + p, back=True), x + p + _agree(levels, x, x + p, back=False)
        long = end - start >= np.maximum(LEAST, FACTOR * p)
        runs.append(np.unique(np.stack([start, end, p], 1)[long], axis=0))
    rows = np.unique(np.concatenate([np.zeros((0, 3), np.int64), *runs]), axis=0)
    first = np.ones(len(rows), bool)  # a stretch that has a smaller period too is found with that one
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    rows = rows[first]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _group(texts: list[list[bytes]]) -> tuple[list[list[tuple[int, int, int]]], list[str]]:
    """The runs of each list of words, and its words without what repeats a run's first period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    every = list(chain.from_iterable(texts))
    codes = pa.array(every, pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    rows = periodic(codes, np.repeat(np.arange(len(texts)), sizes), int(sizes.max(initial=0)))
    owner = np.searchsorted(starts, rows[:, 0], side="right") - 1
    # Of documents that start at the same place, the last one has words.
    change = np.zeros(len(every) + 1, np.int64)
    np.add.at(change, rows[:, 0] + rows[:, 2], 1)
    np.add.at(change, rows[:, 1], -1)
    dropped = np.cumsum(change[:-1]) > 0
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    local = np.stack([rows[:, 0] - starts[owner], rows[:, 1] - rows[:, 0], rows[:, 2]], 1)
    runs, kept = [], []
    for d, words in enumerate(texts):
        own = local[bounds[d] : bounds[d + 1]]
        runs.append([{"start": s, "length": n, "period": p} for s, n, p in own.tolist()])
        if len(own):
            gone = dropped[starts[d] : starts[d] + sizes[d]].tolist()
            words = [w for w, g in zip(words, gone, strict=True) if not g]
        kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
    return runs, kept


def find(docs: DataFrame, keep: list[str] | None = None, runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """The columns ``keep`` (default: all) of docs, the runs of each text, and the text's words, joined by single spaces, without a run's words after its first period."""
    keep = docs.columns if keep is None else keep
    (own,) = unused(docs, "quire_text")
    rows = docs.select(*(docs[f"`{c}`"] for c in keep), docs["text"].alias(own))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            found, left, group, size = [], [], [], 0
            for k, text in enumerate(texts):
                raw = (text or "").encode("utf-8", "surrogatepass")
                group.append(raw.split())  # bytes split at the six ASCII white-space characters only
                size += len(raw)
                if size >= AT_ONCE or k == len(texts) - 1:
                    a, b = _group(group)
                    found, left, group, size = found + a, left + b, [], 0
            columns = [*batch.columns[:-1], pa.array(found, _RUN), pa.array(left, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], runs, collapsed])

    schema = T.StructType([*rows.schema.fields[:-1], T.StructField(runs, RUN, False), T.StructField(collapsed, T.StringType(), False)])
    return rows.mapInArrow(work, schema)
