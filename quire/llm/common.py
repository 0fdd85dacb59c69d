"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a local session, as in tests, gets a temporary one where it is unset."""
    where = spark.conf.get("spark.checkpoint.dir", "") or spark.conf.get("quire.shared.dir", "")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = f"file://{tempfile.mkdtemp(prefix='quire-')}"
        spark.conf.set("quire.shared.dir", where)
    return where


def _own_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that goes when the session ends."""
    path = f"{shared_dir(spark)}/quire-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once as a table in the shared folder and read back.

    That cuts the lineage, and a lost executor costs a re-read rather than a recomputation.
    The table goes when the session ends.
    """
    path = _own_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_by(df: DataFrame, name: str, key: str, parts: int) -> DataFrame:
    """written(), in buckets by key: a join on it with ``parts`` partitions needn't shuffle the table again.

    Such a table has a name in the catalog; names that earlier sessions left, whose files are gone, are dropped first.
    """
    spark = df.sparkSession
    path = _own_path(spark, name)
    own = f"quire_{name}_{uuid.uuid4().hex}"
    for left in spark.catalog.listTables(pattern=f"quire_{name}_*"):
        facts = {r["col_name"]: r["data_type"] for r in spark.sql(f"describe table extended {left.name}").collect()}
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(facts["Location"])
        if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            spark.sql(f"drop table if exists {left.name}")
    df.write.option("compression", "zstd").option("path", path).bucketBy(parts, key).format("parquet").saveAsTable(own)
    return df.sparkSession.table(own)


def dropped(table: DataFrame) -> None:
    """Deletes the files of a table that written() made and that nothing will read again."""
    spark = table.sparkSession
    for f in table.inputFiles()[:1]:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f).getParent()
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a text as an array; null counts as an empty text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id written in decimal, modulo n. A null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where df has such a column (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def frees(rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """rows, whose Python worker gives freed memory back to the system at the end of each task: workers stay for later tasks, and an executor holds several."""

    @functools.wraps(rows)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from rows(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return run
