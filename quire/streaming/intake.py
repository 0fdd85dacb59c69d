"""A folder of papers as a stream: each micro-batch goes through the same functions as a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources import documents


def intake(spark: SparkSession, folder: str, table: str, checkpoint: str, step: Callable[[DataFrame], DataFrame] = lambda x: x) -> StreamingQuery:
    """Upserts papers as their JSON files arrive. Replayed batches write the same rows again, so each paper counts once."""
    stream = spark.readStream.schema(documents.PAPER).json(folder)
    put = lambda batch, _: documents.upsert(step(batch.where("paper_id is not null")), table)
    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
