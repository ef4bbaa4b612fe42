"""Fold numbers by a hash of the key: the same on every cluster and for every partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = 1208


def shuffled(key: str, seed: int = SEED) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))


def folds(df: DataFrame, key: str, k: int = 5, strata: Sequence[str] = (), seed: int = SEED, name: str = "valid_no") -> DataFrame:
    """1 to k, balanced within each stratum.

    Rows are numbered within 256 buckets of the hash per stratum; a bucket's offset is the count of the buckets before
    it, so that a stratum with most of the rows is numbered by many tasks."""
    keyed = df.withColumn("_h", shuffled(key, seed)).withColumn("_b", F.substring("_h", 1, 2))
    sizes = keyed.groupBy(*strata, "_b").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*strata).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    s = sizes.select(*[F.col(c).alias(f"_s{i}") for i, c in enumerate(strata)], F.col("_b").alias("_sb"), before.alias("_before"))
    on = F.col("_b") == F.col("_sb")
    for i, c in enumerate(strata):
        on = on & F.col(c).eqNullSafe(F.col(f"_s{i}"))
    place = F.row_number().over(Window.partitionBy(*strata, "_b").orderBy("_h", key))
    return keyed.join(s, on).select(*df.columns, ((F.col("_before") + place - 1) % k + 1).cast("int").alias(name))


def group_folds(df: DataFrame, group: str, k: int = 5, seed: int = SEED, name: str = "valid_no") -> DataFrame:
    """Rows of a group share a fold, from the group's hash: no shuffle."""
    return df.withColumn(name, (F.conv(F.substring(shuffled(group, seed), 1, 8), 16, 10).cast("long") % k + 1).cast("int"))


def holdout(df: DataFrame, key: str, strata: Sequence[str] = (), seed: int = SEED) -> DataFrame:
    """``is_valid``: a fifth of each stratum."""
    out = folds(df, key, 5, strata, seed, "_f")
    return out.withColumn("is_valid", (F.col("_f") == 1).cast("int")).drop("_f")


def sample_rows(df: DataFrame, key: str, n: int, seed: int = SEED) -> DataFrame:
    return df.orderBy(shuffled(key, seed), key).limit(n)
