"""Column profiles and data-quality checks: one wide aggregate, turned long with ``stack``."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cleanse import numerics, strings
from .ranges import quantiles_by


def kinds(df: DataFrame) -> dict[str, list[str]]:
    dates = [f.name for f in df.schema if isinstance(f.dataType, T.DateType | T.TimestampType | T.TimestampNTZType)]
    return {"categorical": strings(df), "datetime": dates, "numeric": numerics(df)}


def melt(df: DataFrame, columns: Sequence[str], kind: str = "string") -> DataFrame:
    """(column, value) rows of ``columns``."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast(kind).alias("value")) for c in columns])).alias("x")).select("x.*")


def long_aggregate(df: DataFrame, columns: Sequence[str], stats: dict[str, object]) -> DataFrame:
    """One row per column with each of ``stats`` {name: Column -> Column}; a single scan."""
    one = df.agg(*[f(F.col(c)).alias(f"{n}_{i}") for i, c in enumerate(columns) for n, f in stats.items()])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{n}_{i}").alias(n) for n in stats]) for i, c in enumerate(columns)])
    return one.select(F.explode(rows).alias("x")).select("x.*")


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return long_aggregate(df, columns or df.columns, {"nulls": lambda c: F.count_if(c.isNull())})


def infinity_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    inf = float("inf")
    return long_aggregate(df, columns, {"nulls": lambda c: F.count_if(c.isNull()), "pos_inf": lambda c: F.count_if(c == inf), "neg_inf": lambda c: F.count_if(c == -inf)})


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per numeric column: nulls, distinct, min, mean, max, std, the values at z = 1.96 and the counts beyond them."""
    first = long_aggregate(
        df,
        columns,
        {
            "nulls": lambda c: F.count_if(c.isNull()),
            "n_distinct": F.count_distinct,
            "min": lambda c: F.min(c).cast("double"),
            "mean": F.avg,
            "max": lambda c: F.max(c).cast("double"),
            "std": F.stddev_samp,
        },
    )
    ends = first.select("*", (F.col("mean") + 1.96 * F.col("std")).alias("z_high"), (F.col("mean") - 1.96 * F.col("std")).alias("z_low"))
    beyond = melt(df, columns, "double").join(F.broadcast(ends.select("column", "z_high", "z_low")), "column")
    counts = beyond.groupBy("column").agg(F.count_if(F.col("value") >= F.col("z_high")).alias("n_high"), F.count_if(F.col("value") <= F.col("z_low")).alias("n_low"))
    return ends.join(counts, "column")


def top_values(df: DataFrame, columns: Sequence[str], n: int) -> DataFrame:
    """(column, value, n, ratio, place) of the ``n`` most frequent values of each column; ties by value."""
    from pyspark.sql import Window

    counts = melt(df, columns).groupBy("column", "value").agg(F.count("*").alias("n"))
    total = Window.partitionBy("column")
    ranked = counts.select("*", F.round(F.col("n") / F.sum("n").over(total), 2).alias("ratio"), F.row_number().over(total.orderBy(F.desc("n"), F.asc_nulls_last("value"))).alias("place"))
    return ranked.filter(F.col("place") <= n)


def low_variance(df: DataFrame, columns: Sequence[str], limit: float = 0.0) -> DataFrame:
    return long_aggregate(df, columns, {"variance": F.var_samp}).filter(F.col("variance") <= limit)


def constant(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns of zero population variance without any null."""
    stats = long_aggregate(df, columns, {"variance": F.var_pop, "nulls": lambda c: F.count_if(c.isNull())})
    return stats.filter("variance = 0 AND nulls = 0").select("column")


#: Columns up to which all pairs are one aggregate; columns whose products a task holds at a time (four matrices of their square).
NARROW, WIDE = 40, 2048


def wide_correlations(df: DataFrame, columns: Sequence[str], wide: int = WIDE) -> DataFrame:
    """(a, b, r) of all pairs of many columns, each pair over the rows where both have a value.

    Rows become arrays, and each task adds up four matrix products of its rows (counts, sums, squares and products over the rows of
    both columns); the sums are added by pair. There are no more tasks than cores, so that their results stay a small part of the data.
    More columns than ``wide`` take a pass for each pair of groups of half as many. Columns are shifted by their means, so nothing cancels."""
    numbers = [F.col(f"`{c}`").cast("double") for c in columns]
    numbers = [F.when(~F.isnan(c), c) for c in numbers]
    means = np.array([m or 0.0 for m in df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(numbers)]).first()])
    half = max(1, wide // 2)
    groups = [list(range(at, min(at + half, len(columns)))) for at in range(0, len(columns), half)]
    rows = df.sparkSession.sparkContext.defaultParallelism

    def added(first: list[int], second: list[int]) -> DataFrame:
        own = first + [k for k in second if k not in first]
        inner = len(groups) == 1 or first == second

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((4, len(own), len(own)))
            for batch in batches:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(own)) - means[own]
                there = ~np.isnan(x)
                x, there = np.where(there, x, 0), there.astype(float)
                total += np.stack([there.T @ there, x.T @ there, (x * x).T @ there, x.T @ x])
            for i in range(len(own) if inner else len(first)):
                j = np.arange(i + 1 if inner else len(first), len(own))
                n, s, q, p = total
                parts = [np.full(len(j), own[i]), np.array(own)[j], n[i, j], s[i, j], s[j, i], q[i, j], q[j, i], p[i, j]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in parts], names=["i", "j", "n", "sx", "sy", "sxx", "syy", "sxy"])

        arrays = df.select(F.array(*[numbers[k] for k in own]).alias("x")).coalesce(rows)
        return arrays.mapInArrow(run, "i long, j long, n double, sx double, sy double, sxx double, syy double, sxy double")

    passes = [added(a, b) for at, a in enumerate(groups) for b in groups[at:]]
    sums = reduce(DataFrame.union, passes).groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    n, varied = F.col("n"), {}
    for c in "xy":
        square = n * F.col(f"s{c}{c}")
        spread = square - F.col(f"s{c}") * F.col(f"s{c}")
        varied[c] = F.when(spread > 1e-12 * square, spread)
    r = (n * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(varied["x"] * varied["y"])
    names = F.array(*map(F.lit, columns))
    return sums.select(F.get(names, F.col("i").cast("int")).alias("a"), F.get(names, F.col("j").cast("int")).alias("b"), r.alias("r"))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, r) of all pairs, in one aggregate or, beyond ``NARROW`` columns, by matrix products; null where a column is constant."""
    if len(columns) > NARROW:
        return wide_correlations(df, columns)

    def r(a: str, b: str) -> Column:
        return F.when((F.stddev_samp(a) > 0) & (F.stddev_samp(b) > 0), F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b)))

    pairs = list(combinations(columns, 2))
    one = df.agg(*[r(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")


def correlated(df: DataFrame, columns: Sequence[str], limit: float) -> list[str]:
    """Columns to drop: of each pair with |r| >= limit the later one, unless the earlier one went before."""
    gone: list[str] = []
    found = {(x.a, x.b) for x in correlations(df, columns).filter(F.abs("r") >= limit).collect()}
    for a, b in combinations(columns, 2):
        if (a, b) in found and a not in gone and b not in gone:
            gone.append(b)
    return gone


def category_drift(train: DataFrame, test: DataFrame, column: str, target: str) -> DataFrame:
    a = train.groupBy(column).agg(F.count("*").alias("n_train"), F.avg(target).alias("target_mean"))
    b = test.groupBy(column).agg(F.count("*").alias("n_test"))
    both = a.join(b, column, "full")
    n, m = F.coalesce("n_train", F.lit(0)), F.coalesce("n_test", F.lit(0))
    return both.select(column, n.alias("n_train"), m.alias("n_test"), F.coalesce("target_mean", F.lit(0.0)).alias("target_mean"), F.abs(n - m).alias("diff"))


def overlap(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Values of ``column`` in the first only, the second only, and both."""
    x = a.select(column).distinct().select(F.col(column).alias("v"), F.lit(1).alias("in_a"))
    y = b.select(column).distinct().select(F.col(column).alias("v"), F.lit(1).alias("in_b"))
    both = x.filter("v IS NOT NULL").join(y.filter("v IS NOT NULL"), "v", "full")
    return both.agg(F.count_if(F.col("in_b").isNull()).alias("only_a"), F.count_if(F.col("in_a").isNull()).alias("only_b"), F.count_if(F.col("in_a") + F.col("in_b") == 2).alias("both"))


def histogram(df: DataFrame, column: str, bins: int = 30, by: Sequence[str] = ()) -> DataFrame:
    """(bin from 1, n): equal widths between the minimum and the maximum, the last one closed."""
    c = F.col(column).cast("double")
    ends = df.agg(F.min(c).alias("_lo"), F.max(c).alias("_hi"))
    place = F.floor((c - F.col("_lo")) * bins / (F.col("_hi") - F.col("_lo"))) + 1
    inside = F.when(F.col("_hi") == F.col("_lo"), 1).otherwise(F.least(F.lit(bins), place)).cast("int")
    return df.crossJoin(F.broadcast(ends)).filter(c.isNotNull()).groupBy(*by, inside.alias("bin")).agg(F.count("*").alias("n"))


def five_numbers(df: DataFrame, by: str, column: str) -> DataFrame:
    found = quantiles_by(df, by, column, (0.0, 0.25, 0.5, 0.75, 1.0))
    return found.select(by, *[F.col(f"q{i}").alias(n) for i, n in enumerate(("low", "q1", "median", "q3", "high"))])


def narrowed(df: DataFrame, ignore: Sequence[str] = ()) -> DataFrame:
    """Integers in the smallest type that holds them with room at both ends, doubles as float."""
    sizes = [(T.ByteType(), 127), (T.ShortType(), 32767), (T.IntegerType(), 2147483647)]
    whole = [f.name for f in df.schema if isinstance(f.dataType, T.IntegralType) and f.name not in ignore]
    ends = df.agg(*[x for i, c in enumerate(whole) for x in (F.min(c).alias(f"l{i}"), F.max(c).alias(f"h{i}"))]).first() if whole else ()
    to = {}
    for i, c in enumerate(whole):
        low, high = ends[2 * i], ends[2 * i + 1]
        to[c] = next((t for t, m in sizes if low is not None and -m - 1 < low and high < m), T.LongType())
    to |= {f.name: T.FloatType() for f in df.schema if isinstance(f.dataType, T.DoubleType) and f.name not in ignore}
    return df.select(*[F.col(c).cast(to[c]).alias(c) if c in to else F.col(c) for c in df.columns])


def unusable(train: DataFrame, test: DataFrame) -> list[str]:
    """Date columns, and columns of one distinct value or none in the test rows; one aggregate."""
    dates = kinds(train)["datetime"]
    rest = [c for c in test.columns if c not in dates and c in train.columns]
    n = test.agg(*[F.count_distinct(c).alias(f"n{i}") for i, c in enumerate(rest)]).first()
    return sorted({*dates, *[c for i, c in enumerate(rest) if n[i] <= 1]})


def types(df: DataFrame) -> DataFrame:
    """(column, kind, n): the type of each column and how many values it has."""
    kinds_of = F.create_map(*[F.lit(x) for pair in df.dtypes for x in pair])
    return long_aggregate(df, df.columns, {"n": F.count}).select("column", kinds_of[F.col("column")].alias("kind"), "n")


def described(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: type, nulls, distinct values and infinities."""
    inf, kind = float("inf"), dict(df.dtypes)
    real = {c for c in columns if kind[c] in ("double", "float")}
    stats = {
        "nulls": lambda c: F.count_if(c.isNull()),
        "n_distinct": F.count_distinct,
        "pos_inf": lambda c: F.count_if(c == inf),
        "neg_inf": lambda c: F.count_if(c == -inf),
    }
    rest = [c for c in columns if c not in real]
    parts = [long_aggregate(df, sorted(real, key=list(columns).index), stats)] if real else []
    parts += [long_aggregate(df, rest, {"nulls": stats["nulls"], "n_distinct": stats["n_distinct"]}).withColumns({"pos_inf": F.lit(0).cast("long"), "neg_inf": F.lit(0).cast("long")})] if rest else []
    named = F.create_map(*[F.lit(x) for c in columns for x in (c, kind[c])])
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.select("column", named[F.col("column")].alias("data_type"), *stats)


def top_lists(df: DataFrame, columns: Sequence[str], n: int) -> DataFrame:
    """Per column the ``n`` most frequent values, their counts and ratios, as lists in order."""
    rows = top_values(df, columns, n).groupBy("column").agg(F.array_sort(F.collect_list(F.struct("place", "value", "n", "ratio"))).alias("x"))
    return rows.select("column", F.col("x.value").alias("top_values"), F.col("x.n").alias("top_counts"), F.col("x.ratio").alias("top_ratios"))


def dictionary(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, column, length of its name, distinct values) over several tables."""
    parts = [long_aggregate(df, df.columns, {"n_distinct": F.count_distinct}).select(F.lit(name).alias("table"), "column", F.length("column").cast("long").alias("length"), "n_distinct") for name, df in tables.items()]
    return reduce(DataFrame.union, parts)
