"""Keyed aggregates: all columns and methods of a table in one ``groupBy``, joined to the base by its key."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import safe_name


def skew(c: str | Column) -> Column:
    """Bias-corrected skewness; null for fewer than three values or no spread."""
    n = F.count(c)
    return F.when((n > 2) & (F.stddev_pop(c) > 0), F.try_divide(F.skewness(c) * F.sqrt(n * (n - 1)), n - 2))


#: Aggregates by name.
METHODS: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum,
    "mean": F.avg,
    "var": F.var_samp,
    "std": F.stddev_samp,
    "max": F.max,
    "min": F.min,
    "count": F.count,
    "median": F.median,
    "nunique": F.count_distinct,
    "skew": skew,
    "mode": lambda c: F.mode(c, True),
}


def by_name(method: str, c: Column) -> Column:
    if method not in METHODS:
        raise ValueError(f"no aggregate named {method}")
    return METHODS[method](c)


def aggregate(df: DataFrame, key: str, columns: Sequence[str], methods: Sequence[str], prefix: str = "") -> DataFrame:
    """``{prefix}{column}_{method}@{key}`` for every column and method; null keys are left out. One scan, one shuffle."""
    made = [by_name(m, F.col(c)).alias(f"{prefix}{safe_name(c)}_{m}@{key}") for c in columns for m in methods]
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(*made)


def features(df: DataFrame) -> list[str]:
    return [c for c in df.columns if "@" in c]


def drop_constant(df: DataFrame, target: str) -> DataFrame:
    """Without the features that are constant (and free of nulls) over all rows or over the test rows."""
    names = features(df)
    test = F.col(target).isNull()

    def still(c: Column, where: Column) -> Column:
        return F.coalesce((F.var_pop(F.when(where, c)) == 0) & (F.count_if(where & c.isNull()) == 0), F.lit(False))

    one = df.agg(*[(still(F.col(f"`{c}`"), F.lit(True)) | still(F.col(f"`{c}`"), test)).alias(str(i)) for i, c in enumerate(names)]).first()
    return df.drop(*[c for i, c in enumerate(names) if one[i]])


def base_aggregation(base: DataFrame, df: DataFrame, key: str, columns: Sequence[str], methods: Sequence[str], target: str | None = None, prefix: str = "") -> DataFrame:
    """``base`` with the aggregates of ``df``; with ``target``, constant features go."""
    joined = base.join(aggregate(df, key, columns, methods, prefix), key, "left")
    return drop_constant(joined, target) if target else joined


def category_aggregation(df: DataFrame, key: str, category: str, values: Sequence[str], column: str, methods: Sequence[str], null: str = "XNA") -> DataFrame:
    """``{column}_{value}_{method}``: the aggregate over the rows of each category value, nulls as ``null``."""
    v = F.coalesce(category, F.lit(null))
    return df.groupBy(key).agg(*[by_name(m, F.when(v == x, F.col(column))).alias(f"{column}_{safe_name(x)}_{m}") for x in values for m in methods])


def category_shares(df: DataFrame, key: str, category: str, values: Sequence[str]) -> DataFrame:
    """The share of a key's rows with each category value; dummies are never stored."""
    return df.groupBy(key).agg(*[F.avg(F.when(F.col(category) == x, 1.0).otherwise(0.0)).alias(f"{category}_{safe_name(x)}_mean") for x in values])


def exact_mean(c: Column, decimals: int) -> Column:
    """The mean of values of so many decimals: an exact sum over the count, the same in every order of summation."""
    return F.try_divide(F.sum(c.cast(f"decimal(18,{decimals})")).cast("double"), F.count(c).cast("double"))


def trailing(df: DataFrame, entity: Sequence[str], date: str, value: str, start: str, end: str, inclusive: bool = True, decimals: int | None = None) -> DataFrame:
    """Seven statistics of ``value`` per entity in a window of dates, both ends in or both out; with ``decimals`` the mean is exact."""
    d = F.col(date)
    inside = d.between(start, end) if inclusive else (d > start) & (d < end)
    made = {m: by_name(m, F.col(value)) for m in ("min", "mean", "median", "max", "count", "std", "skew")}
    if decimals is not None:
        made["mean"] = exact_mean(F.col(value), decimals)
    return df.filter(inside).groupBy(*entity).agg(*[c.alias(f"{value}_{m}") for m, c in made.items()])


def decayed_means(df: DataFrame, entity: Sequence[str], date: str, value: str, end: str, rates: Sequence[float], compound: bool = False) -> DataFrame:
    """Σ value·r^days / Σ r^days for each rate, days back from ``end``; ``compound``: also with the weight r1·…·ri in the numerator."""
    days, made, weight = F.datediff(F.lit(end), date), [], 1.0
    for i, r in enumerate(rates):
        weight *= r
        total = F.sum(F.pow(F.lit(r), days))
        made.append((F.sum(F.col(value) * F.pow(F.lit(r), days)) / total).alias(f"exp_{i}"))
        if compound:
            made.append((F.sum(F.col(value) * F.pow(F.lit(weight), days)) / total).alias(f"exp2_{i}"))
    return df.groupBy(*entity).agg(*made)


def difference_stats(df: DataFrame, entity: str, date: str, value: str) -> DataFrame:
    """Statistics of the differences of successive days; a missing day makes both of its differences null."""
    w = Window.partitionBy(entity).orderBy(date)
    step = F.when(F.datediff(date, F.lag(date).over(w)) == 1, F.col(value) - F.lag(value).over(w))
    rows = df.select(entity, step.alias("_d"))
    return rows.groupBy(entity).agg(F.avg(F.abs("_d")).alias("diff_mean"), F.stddev_samp("_d").alias("diff_std"), F.max("_d").alias("diff_max"), F.min("_d").alias("diff_min"))


def pivot(df: DataFrame, rows: str, columns: str, values: Sequence, made: Sequence[Column], fill: float | None = None) -> DataFrame:
    out = df.groupBy(rows).pivot(columns, list(values)).agg(*made)
    return out if fill is None else out.fillna(fill)


def label_frequencies(df: DataFrame, name: str, listed: str, separator: str) -> DataFrame:
    """Per name the distinct parts of its delimited list, and the sum of their frequencies over all names."""
    parts = df.select(name, F.explode(F.split(listed, separator)).alias("part")).distinct()
    counts = parts.groupBy("part").agg(F.count("*").alias("n"))
    return parts.join(counts, "part").groupBy(name).agg(F.count("*").alias("n_parts"), F.sum("n").alias("frequency"))


def error_metrics(df: DataFrame, target: str, prediction: str, n_features: int) -> DataFrame:
    e = F.col(target) - F.col(prediction)
    one = df.agg(F.count("*").alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.sum(e * e).alias("rss"), (F.var_pop(target) * F.count(target)).alias("tss"))
    n = F.col("n")
    return one.select("mse", "mae", (1 - F.try_divide(F.col("rss") / (n - 1 - n_features), F.col("tss") / (n - 1))).alias("adjusted_r2"))
