"""The corpus pipeline: five stages, each over all that the one before kept.

A stage is a function of (spark, docs, sf_dir) that returns a DataFrame; it is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.

Defined results, of every stage: null and empty texts stay as they are (packing: a document of the
end id alone); rows without an id and repeated rows are rows of their own; columns beyond those
of documents stay, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import jaccard, linededup, packing, pii, toxicity
from quire.llm.common import table, unused, written
from quire.llm.queries import pii_key

#: Two texts are near copies from this share of common five-word shingles on.
WORDS, PERCENT = 5, 80


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars again follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labelled ones among docs."""
    return toxicity.reject(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of lines go; a document of which no word remains goes with them, one that had none stays."""
    (n,) = unused(docs, "deleted")
    out = linededup.dedup(docs, deleted=n)
    return _counted(out.where((F.col(n) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).drop(n))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays, of rows that share it the first; documents without words all stay."""
    row, group = unused(docs, "row", "group")
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "near")
    groups = jaccard.groups(rows.select(F.col(row).alias("doc_id"), "text"), WORDS, PERCENT)
    found = rows.select(row, "doc_id").join(groups.select(F.col("doc_id").alias(row), F.col("component_id").alias(group)), row)
    # The rows of a group meet in partial sums; nothing gathers a group.
    stay = found.groupBy(group).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row)).alias("m")).select(F.col("m")[row].alias(row))
    return rows.join(stay, row, "left_semi").drop(row)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to surrogates."""
    return _counted(pii.replace(docs, pii_key(spark)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training windows."""
    return packing.pack(packing.encode(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("pii", replace_personal_data),
    ("packing", pack),
]

#: The classifier and the surrogates have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
