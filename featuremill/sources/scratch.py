"""Folders for tables that a query writes and reads again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder in ``spark.checkpoint.dir``, which driver and executors share; on one machine without it, in the warehouse."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: driver and executors need a shared folder")
        top = spark.conf.get("spark.sql.warehouse.dir")
    return f"{top.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once and read again, so that all that follows sees the same rows and nothing is computed twice.

    The folder goes when the session's JVM ends."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    sc = df.sparkSession.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return df.sparkSession.read.schema(df.schema).parquet(path)
