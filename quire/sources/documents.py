"""Reading and writing document relations.

A paper is one row of a table partitioned by ``bucket``, a hash of its id: reads by key touch one
partition, and an upsert rewrites only the partitions of the papers that it brings.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .kept import kept

BUCKETS = 64
PAPER = "paper_id string, title string, uploaded_at double, version int, csl_style string, body string"


def bucket(paper_id):
    return F.pmod(F.xxhash64(paper_id), F.lit(BUCKETS)).cast("int")


def read_json(spark: SparkSession, path: str, schema: str = PAPER) -> DataFrame:
    """Papers as JSON lines; rows that can't be read are dropped."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED").where("paper_id is not null")


def catalogue(papers: DataFrame) -> DataFrame:
    """All papers without their bodies, the latest upload first."""
    return papers.select("paper_id", "title", "uploaded_at", "version").orderBy(F.col("uploaded_at").desc(), "paper_id")


def load(spark: SparkSession, path: str, paper_id: str) -> DataFrame:
    """One paper, read from its partition only."""
    n = spark.range(1).select(bucket(F.lit(paper_id)).alias("b")).first()["b"]
    return spark.read.parquet(path).where((F.col("bucket") == n) & (F.col("paper_id") == paper_id)).drop("bucket")


def upsert(papers: DataFrame, path: str) -> None:
    """Writes papers over those of the same id; of several versions the highest stays.

    Only the partitions that the new papers fall into are rewritten; the new files replace the old
    when the job commits. One writer at a time, as plain files have no transactions.
    """
    spark = papers.sparkSession
    new = papers.withColumn("bucket", bucket(F.col("paper_id")))
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(place) and len(fs.listStatus(place)):
        touched = new.select("bucket").distinct()
        merged = new.unionByName(spark.read.parquet(path).join(touched, "bucket", "left_semi"))
    else:
        merged = new
    last = F.row_number().over(Window.partitionBy("bucket", "paper_id").orderBy(F.col("version").desc()))
    # The old files are inputs of this very job, so the result is written elsewhere before they go.
    merged = kept(merged.withColumn("_k", last).where("_k = 1").drop("_k"), "papers")
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def read_spans(spark: SparkSession, path: str) -> DataFrame:
    """Styled spans from a directory of PDF files, one task per file: paper_id, page, line_seq, span_no, text, size, font, flags, x0, y0, x1, y1.

    Needs the optional PDF library; a span table in Parquet serves without it.
    """
    schema = "paper_id string, page int, line_seq long, span_no int, text string, size double, font string, flags int, x0 double, y0 double, x1 double, y1 double"

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pymupdf

        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                out, seq = [], 0
                with pymupdf.open(stream=content, filetype="pdf") as doc:
                    for number, page in enumerate(doc):
                        for block in page.get_text("dict")["blocks"]:
                            for line in block.get("lines", []):
                                for k, s in enumerate(line["spans"]):
                                    out.append((name, number, seq, k, s["text"], s["size"], s["font"], s["flags"], *s["bbox"]))
                                seq += 1
                yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).mapInPandas(rows, schema)


def lines_of(spans: DataFrame) -> DataFrame:
    """Lines from spans: text, greatest size, mostly bold (over .6 of the characters), box."""
    t = F.col("text")
    bold = (F.col("flags").bitwiseAND(16) != 0) | F.lower("font").contains("bold")
    solid = F.trim(t) != ""
    n = F.when(solid, F.length(t)).otherwise(0)
    text = F.trim(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("span_no", "text"))), lambda x: x["text"]), ""))
    return spans.groupBy("paper_id", "page", "line_seq").agg(
        text.alias("text"),
        F.coalesce(F.max(F.when(solid, F.col("size"))), F.lit(0.0)).alias("size"),
        (F.sum(F.when(bold, n).otherwise(0)) > 0.6 * F.sum(n)).alias("mostly_bold"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
    )


def zip_of(files: DataFrame) -> bytes:
    """A zip archive of one paper's exports (path, content)."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for r in files.orderBy("path").toLocalIterator():
            z.writestr(r["path"], r["content"])
    return out.getvalue()
