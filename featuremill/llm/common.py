"""Shared helpers: table access, the shared work folder, written intermediate tables."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Narrow rows (a few numbers each, some MB in all) that may be broadcast.
BROADCAST_ROWS = 200_000
#: Spark's setting that shuffle files go when the query that made them ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of a batch that a Python task gets; Spark's own 10,000 whole texts are held several times over, in the JVM and in Python.
BATCH_SETTING, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 4096
#: Separators between words, as the operators on whole texts see them.
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where a session on one machine (tests) names none, a folder under the warehouse is set; on a cluster that is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: driver and executors need a shared folder")
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def work_dir(spark: SparkSession, label: str) -> str:
    """A new, unused folder name inside the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: lineage ends here, executors may go."""
    spark = df.sparkSession
    path = work_dir(spark, label)
    tidy(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` with the row's place, from 0, in ``order`` over everything (none: any); written once. Rows that tie get different places.

    The rows are cut into ranges, numbered within each as they are written, and the sizes of the ranges before are added.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = df.repartitionByRange(n, *order).sortWithinPartitions(*order) if order else df
    # the upper bits of _at are the range, the lower 33 the row
    laid = written(cut.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    upto = F.sum("_rows").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
    sizes = laid.groupBy(F.shiftright("_at", 33).alias("_range")).agg(F.count("*").alias("_rows"))
    before = sizes.select("_range", F.coalesce(upto, F.lit(0)).alias("_before"))
    placed = laid.join(F.broadcast(before), F.shiftright("_at", 33) == F.col("_range"))
    return placed.select(*df.columns, (F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).alias(name))


def parts(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in parts of ``rows`` rows at most, so that a task holds few texts at a time as Python's own.

    After each batch, what it took goes back to the system: workers live on from task to task and from stage to stage."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
        give_back()


def give_back() -> None:
    """Free memory that the C library and Arrow hold for later goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's own
    if trim:
        trim(0)


def sized(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` of ``rows`` narrow rows: broadcast up to ``most`` of them, else left to a join that shuffles."""
    return F.broadcast(df) if rows <= most else df


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` but for those whose doc_id is in ``ids`` (a written table of distinct doc_id); null ids stay."""
    gone = ids.select(F.col("doc_id").alias("_gone"))
    return docs.join(sized(gone, gone.count()), F.col("doc_id").cast("long") == F.col("_gone"), "left_anti")


def tidy(spark: SparkSession) -> None:
    """From here on the session's shuffle files go when their query ends and Python tasks get smaller batches, unless its
    own settings say otherwise."""
    for name, value in ((CLEANUP, "true"), (BATCH_SETTING, str(BATCH_ROWS))):
        if not spark.sparkContext.getConf().contains(name):
            spark.conf.set(name, value)


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of Hadoop's API for ``path``."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def drop(df: DataFrame) -> None:
    """Remove a table that ``written`` gave and that no frame needs any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove(spark, folder)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = hadoop_path(spark, path)
    fs.delete(p, True)


def words_of(text):
    """Native: array of the words of ``text`` (null: no words)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), lambda w: w != "")
