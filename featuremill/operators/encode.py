"""Categorical encodings. Codes are small tables, joined; numbers of codes come from sorted distinct values."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import safe_name
from .aggregate import by_name
from .ranges import numbered, quantiles


def code_table(df: DataFrame, column: str, start: int = 0) -> DataFrame:
    """(value, code): sorted distinct non-null values, numbered by ranges."""
    values = df.select(F.col(column).alias("value")).filter("value IS NOT NULL").distinct()
    return numbered(values, ["value"], "code").withColumn("code", F.col("code") - 1 + start)


def apply_codes(df: DataFrame, column: str, codes: DataFrame, name: str, unseen: int = -1) -> DataFrame:
    c = codes.select(F.col("value").alias("_v"), F.col("code").alias("_c"))
    return df.join(c, F.col(column) == F.col("_v"), "left").select(*df.columns, F.coalesce("_c", F.lit(unseen)).alias(name))


def label_encode(df: DataFrame, column: str) -> DataFrame:
    """``{column}_code``: 0 to k-1 in sorted order; null becomes -1."""
    return apply_codes(df, column, code_table(df, column), f"{column}_code")


def ordinal_codes(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """(value, code): 1 to k by first appearance in ``order``."""
    first = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.min(F.struct(*order)).alias("_o"))
    return numbered(first, ["_o"], "code").select("value", "code")


def one_hot(df: DataFrame, column: str, values: Sequence[str] | None = None, most: int = 1000, prefix: str = "dummie_") -> DataFrame:
    """``{prefix}{column}_{value}`` of 0 and 1; a null row is all 0. Without ``values`` they are read, ``most`` at most."""
    if values is None:
        rows = df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column).limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"{column} has more than {most} values")
        values = [r[0] for r in rows]
    made = [F.coalesce(F.col(column) == v, F.lit(False)).cast("int").alias(f"{prefix}{column}_{safe_name(str(v))}") for v in values]
    return df.select(*[c for c in df.columns if c != column], *made)


def count_encode(df: DataFrame, column: str) -> DataFrame:
    """``cnt_{column}`` replaces the column; null stays null."""
    n = df.groupBy(column).agg(F.count("*").alias(f"cnt_{column}")).filter(F.col(column).isNotNull())
    return df.join(n, column, "left").drop(column)


def target_encode(df: DataFrame, level: Sequence[str], target: str, fold: str, method: str = "mean") -> DataFrame:
    """Out-of-fold ``TE_{target}@{level}``: each row gets the statistic of the other folds' rows; rows without a fold
    get that of all. Means are sums and counts less the fold's own: one pass whatever the number of folds."""
    name, keys = f"TE_{target}@{'_'.join(level)}", list(level)
    train = df.filter(F.col(fold).isNotNull() & F.col(target).isNotNull())
    if method == "mean":
        part = train.groupBy(*keys, fold).agg(F.sum(target).alias("_s"), F.count(target).alias("_n"))
        every = part.groupBy(*keys).agg(F.sum("_s").alias("_ts"), F.sum("_n").alias("_tn"))
        joined = df.join(every, keys, "left").join(part, [*keys, fold], "left")
        value = F.try_divide(F.col("_ts") - F.coalesce("_s", F.lit(0.0)), F.col("_tn") - F.coalesce("_n", F.lit(0)))
        return joined.select(*df.columns, value.alias(name))
    folds = [r[0] for r in train.select(fold).distinct().orderBy(fold).collect()]
    c = F.col(target)
    made = [by_name(method, F.when(F.col(fold) != k, c)).alias(f"_f{i}") for i, k in enumerate(folds)]
    stats = train.groupBy(*keys).agg(by_name(method, c).alias("_all"), *made)
    value = F.col("_all")
    for i, k in enumerate(folds):
        value = F.when(F.col(fold) == k, F.col(f"_f{i}")).otherwise(value)
    return df.join(stats, keys, "left").select(*df.columns, value.alias(name))


def quantile_bin(c: Column, edges: Sequence[float]) -> Column:
    """1 + the number of inner edges below the value: right-closed bins; null stays null."""
    e = sorted(set(edges))
    inner = [F.when(c > x, 1).otherwise(0) for x in e[1:-1]]
    return F.when(c.isNotNull(), sum(inner, F.lit(1)))


def edges(df: DataFrame, column: str, bins: int) -> list[float]:
    """The column's exact quantiles at 0, 1 / bins, …, 1."""
    return quantiles(df, [column], [k / bins for k in range(bins + 1)]).get(column, (0, []))[1]


def target_bins(df: DataFrame, category: str, target: str, bins: int) -> DataFrame:
    """``bin{bins}_{category}``: quantile bin, from 1 up, of the value's mean target."""
    means = df.groupBy(category).agg(F.avg(target).alias("_m"))
    coded = means.select(category, quantile_bin(F.col("_m"), edges(means, "_m", bins)).alias(f"bin{bins}_{category}"))
    return df.join(coded, category, "left")


def numeric_bins(df: DataFrame, columns: Sequence[str], bins: int) -> DataFrame:
    """``bin{bins}_{column}`` beside each column that has ``bins`` distinct values or more; the edges of all in one go."""
    found = quantiles(df, columns, [k / bins for k in range(bins + 1)])
    made = [quantile_bin(F.col(c), found[c][1]).alias(f"bin{bins}_{c}") for c in columns if c in found and found[c][0] >= bins]
    return df.select("*", *made)


def crosses(df: DataFrame, columns: Sequence[str], size: int = 2) -> DataFrame:
    """``{a}_{b}``: joined values of each combination of ``size`` columns."""
    return df.select("*", *[F.concat_ws("_", *group).alias("_".join(group)) for group in combinations(columns, size)])
