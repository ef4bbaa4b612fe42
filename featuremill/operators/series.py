"""Windows over ordered groups. Every function takes the order explicitly; ties are the caller's to break."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_number(df: DataFrame, level: Sequence[str], order: Sequence[str], name: str = "row_no") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*level).orderBy(*order)))


def lag_feature(df: DataFrame, column: str, n: int, level: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The value ``n`` rows back, or ahead if negative."""
    name = f"shift{n}_{column}@{'_'.join(level)}"
    return df.withColumn(name, F.lag(column, n).over(Window.partitionBy(*level).orderBy(*order)))


def moving(df: DataFrame, method: str, level: Sequence[str], order: Sequence[str], value: str, window: int, periods: int) -> DataFrame:
    """Mean or sum of the last ``window`` rows; null unless ``periods`` of them have a value."""
    w = Window.partitionBy(*level).orderBy(*order).rowsBetween(-(window - 1), 0)
    of = {"avg": F.avg, "sum": F.sum}[method]
    return df.withColumn(f"{value}_mv_{method}_w{window}_p{periods}@{'_'.join(level)}", F.when(F.count(value).over(w) >= periods, of(value).over(w)))


def weighted_average(df: DataFrame, level: Sequence[str], value: str, rate: float, date: str) -> DataFrame:
    """Average per group with weight ``rate`` to the days before the latest date of all; nulls weigh nothing.

    The days are counted from the group's own latest value, which leaves the quotient as it is and its weights above
    zero, however long ago that was."""
    days = df.groupBy(*level, F.to_date(date).alias("_day")).agg(F.sum(value).alias("_sum"), F.count(value).alias("_n"))
    last = F.max(F.when(F.col("_n") > 0, F.col("_day"))).over(Window.partitionBy(*level))
    weight = F.pow(F.lit(rate), F.datediff("_last", "_day"))
    found = days.withColumn("_last", last).groupBy(*level).agg(F.try_divide(F.sum(F.col("_sum") * weight), F.sum(F.when(F.col("_n") > 0, F.col("_n") * weight))).alias("_avg"))
    return found.withColumnRenamed("_avg", f"{value}_wg{rate}_avg@{'_'.join(level)}")


#: Natural logarithm of the largest weight within a block of days.
MOST_WEIGHT = 300


def lagged_weighted_average(df: DataFrame, level: Sequence[str], value: str, rate: float, date: str, lag: int, name: str | None = None) -> DataFrame:
    """At each row, the weighted average of the group's rows that end ``lag`` rows before it; groups of any length.

    The days are cut into blocks of ``MOST_WEIGHT / -ln(rate)``. Within a block, two running sums with weights relative to its
    first day, which cancel in the quotient; of the blocks before, their average and weight as of that day, carried from block
    to block (one row each)."""
    if not 0 < rate <= 1:
        raise ValueError("the rate is above 0 and at most 1")
    group, out = Window.partitionBy(*level), name or f"{value}_wg{rate}_lag{lag}"
    size = max(1, int(MOST_WEIGHT / -math.log(rate))) if rate < 1 else 1 << 30
    day = F.datediff(date, F.min(date).over(group))
    rows = df.withColumn("_day", day).withColumn("_block", F.floor(F.col("_day") / size).cast("int"))
    weight = F.pow(F.lit(rate), F.lit(0) - (F.col("_day") - F.col("_block") * size))
    tops, lows = F.col(value) * weight, F.when(F.col(value).isNotNull(), weight)
    upto = Window.partitionBy(*level, "_block").orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_top": F.sum(tops).over(upto), "_low": F.coalesce(F.sum(lows).over(upto), F.lit(0.0))})

    # the average of all before a block, and its weight on the block's first day
    ends = df.withColumn("_day", day).withColumn("_block", F.floor(F.col("_day") / size).cast("int")).groupBy(*level, "_block")
    ends = ends.agg(F.sum(tops).alias("_top"), F.coalesce(F.sum(lows), F.lit(0.0)).alias("_low"))
    earlier = F.collect_list(F.struct("_block", "_top", "_low")).over(group.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    start = F.struct(F.lit(0).alias("block"), F.lit(None).cast("double").alias("mean"), F.lit(0.0).alias("weight"))

    def aged(state: Column, block: Column) -> Column:
        return state["weight"] * F.pow(F.lit(rate), (block - state["block"]) * size)

    def carried(state: Column, b: Column) -> Column:
        old = aged(state, b["_block"])
        mean = (b["_top"] + F.coalesce(state["mean"], F.lit(0.0)) * old) / (b["_low"] + old)
        return F.struct(b["_block"].alias("block"), F.when(b["_low"] > 0, mean).otherwise(state["mean"]).alias("mean"), (b["_low"] + old).alias("weight"))

    carry = ends.withColumn("_state", F.aggregate(earlier, start, carried))
    same = F.col("_block") == F.col("_c_block")
    for i, k in enumerate(level):
        same = same & F.col(k).eqNullSafe(F.col(f"_c{i}"))
    carry = carry.select(*[F.col(k).alias(f"_c{i}") for i, k in enumerate(level)], F.col("_block").alias("_c_block"), F.col("_state.mean").alias("_mean"), aged(F.col("_state"), F.col("_block")).alias("_old"))
    both = (F.col("_top") + F.coalesce("_mean", F.lit(0.0)) * F.col("_old")) / (F.col("_low") + F.col("_old"))
    joined = rows.join(carry, same).withColumn("_now", F.when(F.col("_low") > 0, both).otherwise(F.col("_mean")))
    return joined.withColumn(out, F.lag("_now", lag).over(group.orderBy(date))).select(*[F.col(f"`{c}`") for c in df.columns if c != out], F.col(f"`{out}`"))


def segment_averages(df: DataFrame, calendar: DataFrame, entity: str, date: str, value: str, segment: str, special: Column, rate: float, lag: int) -> DataFrame:
    """(entity, date, average) for each row of ``calendar`` (entity, date) that is an ordinary day of ``df``.

    Per segment (say, the weekday): the values of ``special`` days are null, though the days count as rows; each row gets
    the weighted average of the entity's rows up to it, ``lag`` rows back. Special rows go afterwards; what is null gets the
    entity's mean in the segment; segments are stacked and met with the calendar."""
    name = f"{value}_wg{rate}_avg@{entity}"
    rows = df.select(entity, date, segment, F.coalesce(special, F.lit(False)).alias("_special"), F.when(~F.coalesce(special, F.lit(False)), F.col(value)).alias(value))
    made = lagged_weighted_average(rows, [entity, segment], value, rate, date, lag, name).filter("NOT _special")
    mean = F.avg(f"`{name}`").over(Window.partitionBy(entity, segment))
    filled = made.select(entity, date, F.coalesce(F.col(f"`{name}`"), mean).alias(name))
    return calendar.select(entity, date).distinct().join(filled, [entity, date])


def time_holdout(df: DataFrame, date: str, cut: str) -> DataFrame:
    """``val_label``: 0 before ``cut``, 1 from then on."""
    return df.withColumn("val_label", (F.col(date) >= F.lit(cut)).cast("int"))
