"""Exact metrics of predictions, blends and splits. Equal scores are counted first; running sums go by ranges of scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranges import cuts, range_of, running


def _by_score(df: DataFrame, target: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    rows = df.filter(F.col(target).isNotNull() & F.col(score).isNotNull())
    return rows.groupBy(*by, F.col(score).alias("_s")).agg(F.sum(F.col(target).cast("long")).alias("_p"), F.count("*").alias("_n"))


def auc(df: DataFrame, target: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the curve by sums over distinct scores, tied pairs by half; null with one class only."""
    neg = F.col("_n") - F.col("_p")
    part = range_of(F.col("_s"), cuts(df, [score])[0])
    below = running(_by_score(df, target, score, by), "_s", {"_below": neg}, part, by, inclusive=False)
    won = below.select(*by, (F.col("_p") * (F.col("_below") + neg / 2)).alias("_won"), "_p", neg.alias("_q"))
    return won.groupBy(*by).agg(F.try_divide(F.sum("_won"), (F.sum("_p") * F.sum("_q")).cast("double")).alias("auc"))


def metrics(df: DataFrame, target: str, score: str, eps: float = 1e-15) -> DataFrame:
    """logloss, accuracy at 0.5, rmse, r2, auc: one row."""
    y, p = F.col(target).cast("double"), F.col(score)
    clipped = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))
    rows = df.filter(y.isNotNull() & p.isNotNull())
    one = rows.agg(
        (-F.avg(y * F.log(clipped) + (1 - y) * F.log(1 - clipped))).alias("logloss"),
        F.avg(F.when((p >= 0.5) == (y == 1), 1.0).otherwise(0.0)).alias("accuracy"),
        F.sqrt(F.avg(F.pow(y - p, 2))).alias("rmse"),
        (1 - F.try_divide(F.sum(F.pow(y - p, 2)), F.var_pop(y) * F.count(y))).alias("r2"),
    )
    return one.crossJoin(auc(df, target, score))


def best_f1(df: DataFrame, target: str, score: str) -> DataFrame:
    """The threshold (predict 1 from it on) with the largest F1, the least of equals, and its confusion counts."""
    rows, part = _by_score(df, target, score), range_of(F.col("_s"), cuts(df, [score])[0])
    every = rows.agg(F.sum("_p").alias("_pos"), F.sum("_n").alias("_all"))
    c = running(rows, "_s", {"tp": F.col("_p"), "fp": F.col("_n") - F.col("_p")}, part, descending=True).crossJoin(F.broadcast(every))
    c = c.select(F.col("_s").alias("threshold"), "tp", "fp", (F.col("_pos") - F.col("tp")).alias("fn"), (F.col("_all") - F.col("_pos") - F.col("fp")).alias("tn"))
    f1 = F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return c.withColumn("f1", f1).withColumn("accuracy", (F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))).orderBy(F.desc("f1"), "threshold").limit(1)


def blends(df: DataFrame, target: str, columns: Sequence[str], steps: int = 10, least: int = 1) -> DataFrame:
    """(ratios, auc) of each blend of ``columns`` by whole parts of 1 / ``steps``, each at least ``least`` parts; the ratios as
    an array of parts. The grid, whose size only depends on ``columns`` and ``steps``, stands beside each row."""

    def grids(left: int, n: int) -> list[list[int]]:
        return [[left]] if n == 1 else [[k, *rest] for k in range(least, left - least * (n - 1) + 1) for rest in grids(left - k, n - 1)]

    ratios = F.explode(F.array(*[F.array(*map(F.lit, g)) for g in grids(steps, len(columns))])).alias("ratios")
    mixed = df.select(target, *columns, ratios)
    blend = sum((F.col("ratios")[i] * F.col(c) for i, c in enumerate(columns)), F.lit(0.0)) / steps
    return auc(mixed.select(target, "ratios", blend.alias("_mix")), target, "_mix", ["ratios"])


def best_blend(df: DataFrame, target: str, columns: Sequence[str], steps: int = 10) -> DataFrame:
    """The blend with the largest AUC; of equals the one with the least first ratios."""
    return blends(df, target, columns, steps).orderBy(F.desc("auc"), "ratios").limit(1)


def best_split(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """(feature, threshold, impurity): the split ``>=`` / ``<`` with the least Gini impurity; ties by feature and value."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])).alias("x"), F.col(label).alias("label")).select("x.*", "label")
    counts = long.groupBy("feature", "value").pivot("label", [0, 1]).count().fillna(0)
    part = F.lit(0)
    for f, at in zip(features, cuts(df, features)):
        part = F.when(F.col("feature") == f, range_of(F.col("value"), at)).otherwise(part)
    total = counts.groupBy("feature").agg(F.sum("0").alias("t0"), F.sum("1").alias("t1"))
    c = running(counts, "value", {"l0": F.col("0"), "l1": F.col("1")}, part, ["feature"], inclusive=False).join(F.broadcast(total), "feature")

    def gini(x, y):
        n = x + y
        return 1 - F.pow(x / n, 2) - F.pow(y / n, 2)

    l0, l1, r0, r1 = F.col("l0"), F.col("l1"), F.col("t0") - F.col("l0"), F.col("t1") - F.col("l1")
    total = l0 + l1 + r0 + r1
    c = c.filter((l0 + l1 > 0) & (r0 + r1 > 0)).select("feature", F.col("value").alias("threshold"), ((l0 + l1) / total * gini(l0, l1) + (r0 + r1) / total * gini(r0, r1)).alias("impurity"))
    return c.orderBy("impurity", "feature", "threshold").limit(1)


def residual_rule(df: DataFrame, prediction: str, hits: str, bounces: str, threshold: float) -> DataFrame:
    """Zero for single hits or bounces and below ``threshold``."""
    p = F.col(prediction) * (F.col(hits) != 1).cast("double") * (F.col(bounces) != 1).cast("double")
    return df.withColumn(prediction, F.when(p < threshold, 0.0).otherwise(p))
