"""Exact running sums, row numbers and quantiles over large orders.

A window over a whole order is one task. Here the order is cut into ranges: windows run within a range, and what the ranges
before it sum up to is added. The cuts come from approximate quantiles (numbers) or from a range partition that is
written once (any type); they steer the cost, never the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored

RANGES = 64


def cuts(df: DataFrame, columns: Sequence[str], ranges: int = RANGES) -> list[list[float]]:
    """Approximate quantiles of each numeric column, in one pass; nulls and NaN are left out."""
    if not columns:
        return []
    numbers = df.select(*[F.col(f"`{c}`").cast("double").alias(f"_c{i}") for i, c in enumerate(columns)])
    found = numbers.approxQuantile(numbers.columns, [k / ranges for k in range(1, ranges)], 1 / (4 * ranges))
    return [sorted(set(x)) for x in found]


def range_of(value: Column, at: Sequence[float]) -> Column:
    """The number of cuts below ``value`` (null: 0), by halving the sorted cuts: a few comparisons a row."""

    def below(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        half = (low + high) // 2
        return F.when(value > F.lit(at[half]), below(half + 1, high)).otherwise(below(low, half))

    return below(0, len(at))


def running(df: DataFrame, value: str, sums: dict[str, Column], part: Column, by: Sequence[str] = (), descending: bool = False, inclusive: bool = True) -> DataFrame:
    """``df`` with the sum of each of ``sums`` over the rows of ``by`` that come no later (or earlier, if not ``inclusive``)
    in the order of ``value``. ``part``: the range of a row, which must not fall as ``value`` rises. Values are distinct in ``by``."""
    placed = df.withColumns({"_range": part, **{f"_x{i}": c for i, c in enumerate(sums.values())}})
    totals = placed.groupBy(*by, "_range").agg(*[F.sum(f"_x{i}").alias(f"_t{i}") for i in range(len(sums))])
    w = Window.partitionBy(*by).orderBy(F.desc("_range") if descending else F.asc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    keys = [*by, "_range"]
    offsets = totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[F.sum(f"_t{i}").over(w).alias(f"_o{i}") for i in range(len(sums))])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    order = F.desc(value) if descending else F.asc(value)
    own = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    zero = F.lit(0)
    made = [(F.coalesce(F.sum(f"_x{i}").over(own), zero) + F.coalesce(f"_o{i}", zero)).alias(n) for i, n in enumerate(sums)]
    return placed.join(offsets, same).select(*df.columns, *made)


def numbered(df: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """``df`` with the row's number, from 1, in ``order`` over everything. One shuffle, whose sorted ranges are written when called."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # the upper bits of _at are the range, the lower 33 the row's place in it
    laid = stored(cut.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    # a row for each range
    upto = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    sizes = laid.groupBy(F.shiftright("_at", 33).alias("_range")).agg(F.count("*").alias("_n"))
    before = sizes.select("_range", F.coalesce(upto, F.lit(0)).alias("_before"))
    placed = laid.join(F.broadcast(before), F.shiftright("_at", 33) == F.col("_range"))
    return placed.select(*df.columns, (F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("int").alias(name))


def quantiles_by(df: DataFrame, by: str, value: str, probabilities: Sequence[float], part: Column | None = None) -> DataFrame:
    """(by, n_distinct, q0, q1, …): exact quantiles of ``value`` per group, interpolated between neighbours; nulls left out."""
    rows = df.select(by, F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL")
    if part is None:
        part = range_of(F.col("_v"), cuts(rows, ["_v"])[0])
    counts = rows.groupBy(by, "_v").agg(F.count("*").alias("_n"))
    upto = running(counts, "_v", {"_upto": F.col("_n")}, part, [by])
    total = counts.groupBy(by).agg(F.sum("_n").alias("_total"), F.count("*").alias("n_distinct")).withColumnRenamed(by, "_by")
    both = upto.join(total, F.col(by).eqNullSafe(F.col("_by")))
    made = []
    for i, p in enumerate(probabilities):
        at = F.lit(float(p)) * (F.col("_total") - 1)
        made += [F.min(F.when(F.col("_upto") > f(at), F.col("_v"))).alias(f"_{s}{i}") for s, f in (("l", F.floor), ("h", F.ceil))]
    found = both.groupBy(by, "n_distinct", "_total").agg(*made)

    def value_at(i: int, p: float) -> Column:
        at = F.lit(float(p)) * (F.col("_total") - 1)
        low, high = F.col(f"_l{i}"), F.col(f"_h{i}")
        return F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)

    return found.select(by, "n_distinct", *[value_at(i, p).alias(f"q{i}") for i, p in enumerate(probabilities)])


def quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> dict[str, tuple[int, list[float]]]:
    """Of each column with a value: the number of distinct values, and the exact quantiles."""
    at = cuts(df, columns)
    long = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("column"), F.col(f"`{c}`").cast("double").alias("value")) for i, c in enumerate(columns)])).alias("x")).select("x.*")
    part = F.lit(0)
    for i, x in enumerate(at):
        part = F.when(F.col("column") == i, range_of(F.col("_v"), x)).otherwise(part)
    rows = quantiles_by(long, "column", "value", probabilities, part).collect()
    return {columns[r.column]: (r.n_distinct, [r[f"q{i}"] for i in range(len(probabilities))]) for r in rows}
