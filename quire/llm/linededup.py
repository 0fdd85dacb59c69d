"""Line dedup: later copies of repeated runs of lines are deleted.

Lines that occur once can't be part of a repeated run, so only the others take part. They get ranks
in one order, and prefix doubling gives ranks to all windows of 2, 4, 8 ... lines that occur more
than once: a window's rank is the place of its pair of half-window ranks in a range-partitioned
sort of the distinct pairs. The windows in rank order are the suffix array to that depth; equal
ranks are its longest-common-prefix intervals, and two overlapping windows of a power of two name
the interval of any length between.

A run counts if it has MIN_WORDS words or more. Every such run is covered by the shortest runs with
that many words that begin, or end, at one of its lines; these lengths follow from the lines
themselves, so that all copies of a run agree on them. In each interval the first copy stays
(smallest doc_id, then row), the lines of the others go. The depth needed is MIN_WORDS lines,
because lines without a word are skipped; so the number of doublings doesn't grow with the input.

Defined results: null text stays null; lines without words are deleted only inside a deleted run;
a document may end empty and stays; of repeated rows the first in storage order keeps its lines; a
null doc_id sorts first; all other columns are kept, whatever their names; an empty table stays empty. Lines are told by
two 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import frees, unused, words, written

MIN_WORDS = 50


def _ranked(keys: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct keys with ``r``, a number that rises with them. The written numbers are what later steps read."""
    order = keys.repartitionByRange(*cols).sortWithinPartitions(*cols)
    return written(order.select(*cols, F.monotonically_increasing_id().alias("r")), "ranks")


def lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """The written lines with words: _row, doc_id, j (its place among them), i (among all), h1, h2, w (words)."""
    each = F.transform(F.split(F.col(text), "\n"), lambda x, i: F.struct(i.alias("i"), F.xxhash64(x).alias("h1"), F.xxhash64(x, F.lit(1)).alias("h2"), F.size(words(x)).alias("w")))
    rows = docs.where(F.col(text).isNotNull()).select("_row", F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.filter(each, lambda x: x["w"] > 0)).alias("j", "x"))
    return written(rows.select("_row", "doc_id", "j", "x.i", "x.h1", "x.h2", "x.w"), "lines")


def _window_ends(min_words: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each document's repeated lines: the shortest windows with enough words from each line on, and up to each line, within unbroken runs."""
        for b in batches:
            out: list[list[np.ndarray]] = [[] for _ in range(5)]
            docs: list[pa.Array] = []
            for row, doc, x in zip(b.column("_row").to_pylist(), b.column("doc_id"), b.column("x"), strict=True):
                j, i, w = (np.array(x.values.field(k)) for k in ("j", "i", "w"))
                run = np.cumsum(np.concatenate([[0], np.diff(j) != 1]))
                before = np.cumsum(w) - w
                n = np.arange(len(j))
                last = np.searchsorted(before + w, before + min_words, "left")  # first place where the sum is reached
                first = np.searchsorted(before, before + w - min_words, "right") - 1
                s, e = np.concatenate([n, first]), np.concatenate([last, n])
                ok = (s >= 0) & (e < len(j))
                s, e = s[ok], e[ok]
                ok = run[s] == run[e]
                s, e = np.unique(np.stack([s[ok], e[ok]]), axis=1) if ok.any() else (s[:0], e[:0])
                if len(s):
                    for k, v in enumerate((np.full(len(s), row), j[s], j[e] - j[s] + 1, i[s], i[e])):
                        out[k].append(v.astype(np.int64))
                    docs.append(pa.array([doc.as_py()] * len(s), pa.int64()))
            if docs:
                cols = [pa.array(np.concatenate(v)) for v in out]
                yield pa.RecordBatch.from_arrays([cols[0], pa.concat_arrays(docs), *cols[1:]], names=["_row", "doc_id", "s", "n", "a", "b"])

    return rows


def deletions(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """_row, cut: the ranges (a, b) of line numbers that go, apart from one another and in order. docs has a column _row."""
    own = lines(docs, text)
    repeated = own.groupBy("h1", "h2").count().where("count > 1").select("h1", "h2")
    names = _ranked(repeated, ["h1", "h2"])
    active = written(own.join(names, ["h1", "h2"]).select("_row", "doc_id", "j", "i", "w", "r"), "active")
    level = active.select("_row", "j", "r")
    levels = [level.withColumn("k", F.lit(0))]
    k = 0
    while 2 << k <= min_words:
        half = 1 << k
        pairs = written(level.join(level.select("_row", (F.col("j") - half).alias("j"), F.col("r").alias("r2")), ["_row", "j"]), "pairs")
        again = pairs.groupBy("r", "r2").count().where("count > 1").select("r", "r2")
        names = _ranked(again.select(F.col("r").alias("p"), F.col("r2").alias("q")), ["p", "q"])
        level = written(pairs.join(names, (pairs["r"] == names["p"]) & (pairs["r2"] == names["q"])).select("_row", "j", names["r"].alias("r")), "level")
        k += 1
        if level.isEmpty():
            break
        levels.append(level.withColumn("k", F.lit(k)))
    ranks = levels[0]
    for x in levels[1:]:
        ranks = ranks.unionByName(x)
    by_doc = active.groupBy("_row").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("j", "i", "w"))).alias("x"))
    spans = by_doc.mapInArrow(frees(_window_ends(min_words)), "_row long, doc_id long, s long, n long, a long, b long")
    spans = spans.withColumn("k", F.floor(F.log2(F.col("n") + 0.5)).cast("int")).withColumn("t", F.expr("s + n - shiftleft(1L, k)"))
    left = ranks.select("_row", F.col("j").cast("long").alias("s"), "k", F.col("r").alias("r1"))
    right = ranks.select("_row", F.col("j").cast("long").alias("t"), "k", F.col("r").alias("r2"))
    spans = written(spans.join(left, ["_row", "s", "k"]).join(right, ["_row", "t", "k"]).select("_row", "doc_id", "s", "n", "a", "b", "r1", "r2"), "spans")
    at = F.struct("doc_id", "_row", "s")
    first = spans.groupBy("n", "r1", "r2").agg(F.min(at).alias("first"), F.count("*").alias("c")).where("c > 1")
    later = spans.join(first, ["n", "r1", "r2"]).where(~at.eqNullSafe(F.col("first"))).select("_row", "a", "b").distinct()
    # Ranges that touch or overlap become one.
    order = Window.partitionBy("_row").orderBy("a", "b")
    later = later.withColumn("new", F.when(F.col("a") <= F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1)) + 1, 0).otherwise(1))
    later = later.withColumn("island", F.sum("new").over(order))
    islands = later.groupBy("_row", "island").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return islands.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("cut"))


def dedup(docs: DataFrame, text: str = "text", deleted: str | None = None, min_words: int = MIN_WORDS) -> DataFrame:
    """docs without the lines that are later copies; deleted names a column for the number of lines that went."""
    row, cut = unused(docs, "row", "cut")
    base = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    ranges = deletions(base.select(F.col(row).alias("_row"), "doc_id", text), text, min_words).toDF(row, cut)
    rows = base.join(ranges, row, "left")
    kept = F.filter(F.split(F.col(text), "\n"), lambda x, i: ~F.exists(cut, lambda c: (c["a"] <= i) & (i <= c["b"])))
    if deleted:
        rows = rows.withColumn(deleted, F.coalesce(F.aggregate(cut, F.lit(0).cast("long"), lambda n, c: n + c["b"] - c["a"] + 1), F.lit(0).cast("long")))
    return rows.withColumn(text, F.when(F.col(cut).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))).drop(row, cut)
