"""Registered queries: each names an operator, runs it on the given tables, and has the equal DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            SQL[name] = sql
        return f

    return add


def half_up(c: Column, n: int) -> Column:
    """The double ``c`` to ``n`` decimals as the SQL rounds: scaled first, then to the nearest whole number, halves away from 0.
    Spark's own ``round`` goes by the decimal digits that the double prints, which lie on the other side of some halves."""
    return F.round(c * F.lit(10.0**n)) / F.lit(10.0**n)


def r4(c: Column | str) -> Column:
    return half_up(F.col(c) if isinstance(c, str) else c, 4)


def rounded(df: DataFrame, *keep: str) -> DataFrame:
    """Every double column to four decimals."""
    return df.select(*[r4(f"`{c}`").alias(c) if kind == "double" and c not in keep else F.col(f"`{c}`") for c, kind in df.dtypes])
