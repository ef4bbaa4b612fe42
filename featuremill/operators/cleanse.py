"""Filters, replacements, imputation, scaling and outliers. Statistics are one row, broadcast, or a few numbers a column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType, StringType

from ..functions.columns import finite
from .ranges import quantiles


def strings(df: DataFrame, ignore: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, StringType) and f.name not in ignore]


def numerics(df: DataFrame, ignore: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in ignore]


def keep_where(df: DataFrame, rules: dict[str, tuple[str, float]]) -> DataFrame:
    """{column: (comparison, bound)}: values that don't compare become null."""
    return df.select(*[F.expr(f"CASE WHEN `{c}` {rules[c][0]} {rules[c][1]} THEN `{c}` END").alias(c) if c in rules else F.col(c) for c in df.columns])


def cap(df: DataFrame, limits: dict[str, float]) -> DataFrame:
    return df.select(*[F.when(F.col(c) <= limits[c], F.col(c)).otherwise(F.lit(limits[c])).alias(c) if c in limits else F.col(c) for c in df.columns])


def drop_named(df: DataFrame, part: str) -> DataFrame:
    return df.drop(*[c for c in df.columns if part in c])


def not_equal(c: Column, value) -> Column:
    """Unequal or null."""
    return ~c.eqNullSafe(F.lit(value))


def conditional_copies(df: DataFrame, where: Column, prefix: str, ignore: Sequence[str] = ()) -> DataFrame:
    return df.select("*", *[F.when(where, F.col(c)).alias(prefix + c) for c in df.columns if c not in ignore])


def last_per_key(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key by ``order``."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")


def infinite_to_null(df: DataFrame, ignore: Sequence[str] = ()) -> DataFrame:
    real = {f.name for f in df.schema if isinstance(f.dataType, DoubleType | FloatType)} - set(ignore)
    return df.select(*[finite(F.col(c)).alias(c) if c in real else F.col(c) for c in df.columns])


def infinite_to_range(df: DataFrame, column: str) -> DataFrame:
    """Infinities become the column's finite maximum or minimum."""
    c = F.col(column)
    ends = df.agg(F.max(finite(c)).alias("_max"), F.min(finite(c)).alias("_min"))
    new = F.when(c == float("inf"), F.col("_max")).when(c == float("-inf"), F.col("_min")).otherwise(c)
    return df.crossJoin(F.broadcast(ends)).select(*[new.alias(x) if x == column else F.col(x) for x in df.columns])


def _with_stats(df: DataFrame, stats: list[Column]) -> DataFrame:
    """One row of statistics beside every row; the row is broadcast."""
    return df.crossJoin(F.broadcast(df.agg(*stats)))


def impute(df: DataFrame, columns: Sequence[str], how: str = "mean") -> DataFrame:
    """Nulls become the column's mean, median, or mode (the least of equals); a column of nulls stays."""
    if how == "median":
        found = quantiles(df, columns, [0.5])
        return df.select(*[F.coalesce(c, F.lit(found[c][1][0])).alias(c) if c in columns and c in found else F.col(c) for c in df.columns])
    if how == "mode":
        counts = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("s"), F.col(c).cast("double").alias("d")) for i, c in enumerate(columns)])).alias("x"))
        counts = counts.select("x.*").filter("s IS NOT NULL").groupBy("i", "s", "d").agg(F.count("*").alias("n"))
        best = counts.groupBy("i").agg(F.min_by("s", F.struct((-F.col("n")).alias("n"), "d", "s")).alias("s")).collect()
        kinds = dict(df.dtypes)
        of_column = {columns[r.i]: F.lit(r.s).cast(kinds[columns[r.i]]) for r in best}
        return df.select(*[F.coalesce(c, of_column[c]).alias(c) if c in of_column else F.col(c) for c in df.columns])
    wide = _with_stats(df, [F.avg(F.col(c)).alias(f"_s{i}") for i, c in enumerate(columns)])
    at = {c: f"_s{i}" for i, c in enumerate(columns)}
    return wide.select(*[F.coalesce(c, at[c]).alias(c) if c in at else F.col(c) for c in df.columns])


def impute_by_group(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    mean = F.avg(value).over(Window.partitionBy(*keys))
    return df.select(*[F.coalesce(c, mean).alias(c) if c == value else F.col(c) for c in df.columns])


def standardise(df: DataFrame, columns: Sequence[str], population: bool = False) -> DataFrame:
    """(value - mean) / deviation; null where the deviation is zero."""
    sd = F.stddev_pop if population else F.stddev_samp
    wide = _with_stats(df, [x for i, c in enumerate(columns) for x in (F.avg(c).alias(f"_m{i}"), sd(c).alias(f"_d{i}"))])
    at = {c: i for i, c in enumerate(columns)}
    return wide.select(*[F.try_divide(F.col(c) - F.col(f"_m{at[c]}"), F.col(f"_d{at[c]}")).alias(c) if c in at else F.col(c) for c in df.columns])


def max_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A column with negative values is moved up by its least value's size; then all are divided by the maximum."""
    wide = _with_stats(df, [x for i, c in enumerate(columns) for x in (F.min(c).alias(f"_l{i}"), F.max(c).alias(f"_h{i}"))])
    at = {c: i for i, c in enumerate(columns)}

    def scaled(c: str) -> Column:
        shift = F.when(F.col(f"_l{at[c]}") < 0, F.abs(f"_l{at[c]}")).otherwise(F.lit(0.0))
        return F.try_divide(F.col(c) + shift, F.col(f"_h{at[c]}") + shift)

    return wide.select(*[scaled(c).alias(c) if c in at else F.col(c) for c in df.columns])


def regularise(df: DataFrame, columns: Sequence[str], scale: str = "z") -> DataFrame:
    """Infinities to null, mean imputation, scaling by ``z`` or ``max``, float."""
    other = [c for c in df.columns if c not in columns]
    filled = impute(infinite_to_null(df, other), columns)
    scaled = standardise(filled, columns) if scale == "z" else max_scale(filled, columns)
    return scaled.select(*[F.col(c).cast("float").alias(c) if c in columns else F.col(c) for c in df.columns])


def outliers(df: DataFrame, column: str, z_range: float = 1.64, mode: str = "inner", value: float | None = None, plus: float | None = None, minus: float | None = None, two_sided: bool = True) -> DataFrame:
    """Adds ``z``, the distance from the mean in deviations, and handles the rows far from it.

    * ``value``: beyond ``z_range`` on either side rows get ``value``, or, where ``plus`` or ``minus`` is given, only above
      that z or below minus that one; a null z counts as beyond, as for a condition that does not hold;
    * ``drop``: rows beyond ``z_range`` or without a z go; not ``two_sided``: only low ones;
    * ``inner``: they move to the inner range's ends; not ``two_sided``: only high ones.
    """
    c, z = F.col(column), F.col("z")
    wide = _with_stats(df, [F.avg(column).alias("_m"), F.stddev_samp(column).alias("_d")]).withColumn("z", F.try_divide(c - F.col("_m"), F.col("_d")))
    if mode == "drop":
        stays = F.abs(z) <= z_range if two_sided else z >= -z_range
        return wide.filter(stays).select(*df.columns, "z")
    if mode == "value":
        limits = (z_range, z_range) if plus is None and minus is None else (plus, minus)
        stays = (F.lit(True) if limits[0] is None else z <= limits[0]) & (F.lit(True) if limits[1] is None else z >= -limits[1])
        new = F.when(stays, c).otherwise(F.lit(value))
    else:
        inside = F.abs(z) <= z_range
        wide = wide.crossJoin(F.broadcast(wide.agg(F.max(F.when(inside, c)).alias("_hi"), F.min(F.when(inside, c)).alias("_lo"))))
        new = F.when(z > z_range, F.col("_hi")).when((z < -z_range) & F.lit(two_sided), F.col("_lo")).otherwise(c)
    return wide.select(*[new.alias(x) if x == column else F.col(x) for x in df.columns], "z")


def frequent_groups(df: DataFrame, column: str, least: int) -> DataFrame:
    """Rows whose value occurs ``least`` times or more; nulls go. A grouped count and a semi-join, so no task holds a group."""
    often = df.groupBy(column).count().filter((F.col("count") >= least) & F.col(column).isNotNull())
    return df.join(often, column, "left_semi")


def train_test(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    return df.filter(F.col(target).isNotNull()), df.filter(F.col(target).isNull())


def fold_split(df: DataFrame, column: str, fold: int) -> tuple[DataFrame, DataFrame]:
    """(training, validation) rows; a null fold trains."""
    rest = [c for c in df.columns if not c.startswith("valid_no")]
    return df.filter(not_equal(F.col(column), fold)).select(*rest), df.filter(F.col(column) == fold).select(*rest)


def rename_level(df: DataFrame, level: str, ignore: Sequence[str] = (), prefix: str = "", suffix: str = "") -> DataFrame:
    return df.select(*[F.col(c) if c in ignore else F.col(c).alias(f"{prefix}{c}{suffix}@{level}") for c in df.columns])
