"""Jump consistent hashing: a row's shard follows from its key and the number of shards alone.

The key's 64 bits are the first half of the md5 of its decimal text. With one more shard, a row stays
or moves to the new one; no table of the ring is kept. Places within a shard count up by key: rows
are dealt by range of (shard, key, place read), so equal keys, however many, spread over partitions,
and each partition's rows of a shard begin where the rows before it end.

Defined results: a null key counts as an empty text; null and empty texts have the size of the
addition; repeated rows and equal keys are rows of their own, in one shard; columns of any name
stay; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import unused, written

#: Rows of a partition that is sorted at once.
ROWS = 1_000_000
#: Bytes that a row takes besides its text.
ROW_BYTES = 8
_LOW, _STEP = np.uint64(33), np.uint64(2862933555777941757)  # fixed values of the published method


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key: the last place that the key's own sequence of jumps reaches below shards."""
    keys, at, ahead = keys.astype(np.uint64), np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
    going = np.arange(len(keys))
    while len(going):
        at[going] = ahead[going]
        keys[going] = keys[going] * _STEP + np.uint64(1)
        far = (at[going] + 1) * (2147483648.0 / ((keys[going] >> _LOW).astype(np.float64) + 1))
        ahead[going] = np.minimum(far, shards).astype(np.int64)
        going = going[ahead[going] < shards]
    return at


def _shard_of(key: Column, shards: int) -> Column:
    @F.pandas_udf("int")
    def shard(half: pd.Series) -> pd.Series:
        return pd.Series(jump(np.frombuffer(b"".join(half), ">u8"), shards).astype(np.int32))

    return shard(F.unhex(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 16)))


def assign(rows: DataFrame, shards: int, key: str = "doc_id", shard: str = "shard", slot: str = "slot", grown: str | None = "grown_shard") -> DataFrame:
    """rows with their shard, their place in it (gapless from 0, ascending by key), and the shard that they would have with one more."""
    order, place, part, first, before = unused(rows, "order", "place", "part", "first", "before")
    out = rows.withColumn(shard, _shard_of(F.col(key), shards))
    if grown:
        out = out.withColumn(grown, _shard_of(F.col(key), shards + 1))
    out = out.withColumn(order, F.monotonically_increasing_id())
    parts = rows.count() // ROWS + 1
    # The place counts the rows of a sorted partition; its upper bits number the partition.
    out = out.repartitionByRange(parts, shard, key, order).sortWithinPartitions(shard, key, order).drop(order)
    out = written(out.withColumn(place, F.monotonically_increasing_id()), "shards").withColumn(part, F.shiftright(place, 33))
    # One row for each shard and partition that it touches: partitions + shards rows at most.
    begins = out.groupBy(shard, part).agg(F.min(place).alias(first), F.count("*").alias("n"))
    begins = begins.withColumn(before, F.coalesce(F.sum("n").over(Window.partitionBy(shard).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return out.join(F.broadcast(begins), [shard, part]).withColumn(slot, F.col(place) - F.col(first) + F.col(before)).select(*rows.columns, shard, slot, *([grown] if grown else []))


def sized(docs: DataFrame, size: str = "size", crc: str = "text_crc32") -> DataFrame:
    """docs with the bytes of each row and the checksum of its text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({size: F.octet_length(text).cast("long") + ROW_BYTES, crc: F.crc32(text.cast("binary"))})
