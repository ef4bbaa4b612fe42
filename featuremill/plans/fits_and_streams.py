"""Queries: fits whose results have a closed form, permuted columns, searches side by side, streams against their batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models
from ..sources.scratch import scratch, stored
from ..streaming.features import decayed_stream, latest, merged_decays, run_into, trailing_stream
from .catalog import query, rounded
from .features import _model_rows

# An order's lines: their price by their quantity, weighted by the lines beyond the first; each seventh order has no target.
ORDERS = """o AS (SELECT l_orderkey AS k, CASE WHEN l_orderkey % 7 <> 0 THEN sum(l_extendedprice) END AS y, sum(l_quantity)::DOUBLE AS x, avg(l_discount) AS d, (count(*) > 3)::INT AS many, count(*) - 1 AS w, (l_orderkey % 3)::INT AS f FROM lineitem GROUP BY l_orderkey)"""


def _orders(t):
    k = F.col("l_orderkey")
    n = F.count("*")
    rows = t("lineitem").groupBy(k.alias("k")).agg(F.sum("l_extendedprice").alias("y"), F.sum("l_quantity").cast("double").alias("x"), F.avg("l_discount").alias("d"), (n > 3).cast("int").alias("many"), (n - 1).alias("w"))
    return rows.withColumn("y", F.expr("CASE WHEN k % 7 <> 0 THEN y END")).withColumn("f", (F.col("k") % 3).cast("int"))


@query(
    "ml03_linear_folds",
    f"""WITH {ORDERS}, m AS (SELECT g.f, sum(w) AS sw, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy FROM o, (SELECT DISTINCT f FROM o) g WHERE o.f <> g.f AND y IS NOT NULL GROUP BY g.f),
    s AS (SELECT *, (sw * sxy - sx * sy) / (sw * sxx - sx * sx) AS b FROM m)
    SELECT k, round(avg((sy - b * sx) / sw + b * x), 1) AS prediction FROM o JOIN s ON y IS NULL OR o.f = s.f GROUP BY k""",
)
def ml03_linear(t):
    """Weighted least squares by fold: out-of-fold predictions, and the mean over the folds' models for orders without a target."""
    cv = models.cross_validate(_orders(t), "k", "y", "f", ["x"], "linear", weight="w", indicators=False)
    return models.stacked(cv, "k").select("k", F.round("prediction", 1).alias("prediction"))


@query(
    "ml01_boosted_early_stop",
    f"""WITH {ORDERS}, s AS (SELECT g.f, many, sum(w * y) / sum(w) AS p FROM o, (SELECT DISTINCT f FROM o) g WHERE o.f <> g.f AND y IS NOT NULL AND w > 0 GROUP BY g.f, many)
    SELECT k, round(avg(p), 1) AS prediction, 1::BIGINT AS trees FROM o JOIN s ON o.many = s.many AND (y IS NULL OR o.f = s.f) GROUP BY k""",
)
def ml01_boosted(t):
    """Boosted trees on one two-valued column: the first tree gives the weighted means of both sides, a second has nothing to
    add, so that the fit stops there of thirty."""
    cv = models.cross_validate(_orders(t), "k", "y", "f", ["many"], "gbt_regression", weight="w", early=True, indicators=False, maxIter=30, maxDepth=1)
    return models.stacked(cv, "k").select("k", F.round("prediction", 1).alias("prediction"), F.lit(max(cv.trees)).cast("long").alias("trees"))


@query(
    "ml09_permuted_columns",
    f"""WITH {ORDERS}, m AS (SELECT avg(y) AS my, avg(x) AS mx, avg(d) AS md, covar_pop(y, x) AS yx, covar_pop(y, d) AS yd, var_pop(x) AS xx, var_pop(d) AS dd, covar_pop(x, d) AS xd FROM o WHERE y IS NOT NULL AND f <> 0),
    c AS (SELECT *, (yx * dd - yd * xd) / (xx * dd - xd * xd) AS bx, (yd * xx - yx * xd) / (xx * dd - xd * xd) AS bd FROM m),
    h AS (SELECT *, row_number() OVER (ORDER BY md5(k::VARCHAR || '|1208'), k) AS p, count(*) OVER () AS n FROM o WHERE y IS NOT NULL AND f = 0),
    e AS (SELECT h.y - my - bx * (h.x - mx) - bd * (h.d - md) AS e0, e0 + bx * (h.x - g.x) AS e1, e0 + bd * (h.d - g.d) AS e2 FROM h JOIN h g ON g.p = h.p % h.n + 1, c)
    SELECT unnest(['x', 'd']) AS feature, round(unnest([sqrt(avg(e1 * e1)), sqrt(avg(e2 * e2))]) - sqrt(avg(e0 * e0)), 1) AS importance FROM e""",
)
def ml09_permuted(t):
    """A fit on two folds, both columns permuted on the third: quantities matter, discounts hardly."""
    rows = stored(_orders(t).filter("y IS NOT NULL"), "orders")
    predict = models.fitted(rows.filter("f <> 0"), "y", ["x", "d"], "linear", indicators=False)
    found = models.permutation_importance(rows.filter("f = 0"), "k", "y", ["x", "d"], predict)
    return found.select("feature", F.round("importance", 1).alias("importance"))


@query("ml14_parzen_search")
def ml14_parzen(t):
    found = models.parzen_search(_model_rows(t), "c_custkey", "target", "valid_no", ["total", "n", "c_nationkey"], "logistic", {"regParam": (0.0, 0.5)}, 6, start=4, maxIter=5)
    return t.spark.createDataFrame([(s, p["regParam"]) for s, p in found], "score double, regParam double")


@query("ml01_boosted_classes")
def ml01_classes(t):
    cv = models.cross_validate(_model_rows(t), "c_custkey", "target", "valid_no", ["total", "n", "c_nationkey"], "gbt", early=True, maxIter=10, maxDepth=3)
    return models.stacked(cv, "c_custkey")


@query("ml02_forest_regressor")
def ml02_forest(t):
    return models.stacked(models.cross_validate(_orders(t), "k", "y", "f", ["x", "d"], "forest_regression", weight="w", numTrees=5, maxDepth=4), "k")


# ---- streams ------------------------------------------------------------------------------------------------------------------
def _streamed(t):
    """The events as a stream of eight files, one a batch, that are not in the order of time."""
    rows = t("events").select("event_id", "ts", "user_id", "event_type", "value")
    path = scratch(t.spark, "events")
    rows.repartition(8, "event_id").write.parquet(path)
    return t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("a09_decayed_stream", "WITH l AS (SELECT *, max(ts::DATE) OVER (PARTITION BY event_type) - ts::DATE AS days FROM events) SELECT event_type, round(sum(value * pow(0.985, days)) / sum(pow(0.985, days)), 4) AS mean FROM l GROUP BY 1")
def a09_stream(t):
    states = run_into(decayed_stream(_streamed(t), "ts", ["event_type"], "value", 0.985), scratch(t.spark, "states"), scratch(t.spark, "progress"))
    return rounded(merged_decays(latest(states, ["event_type", "salt"]), ["event_type"], 0.985))


@query(
    "a07_trailing_stream",
    """SELECT strftime(ts::DATE + (k + 1)::INT, '%Y-%m-%d') AS until, event_type, round(min(value), 4) AS min, round(max(value), 4) AS max, count(value) AS count, round(stddev_samp(value), 4) AS std,
    round(CASE WHEN var_pop(value) > 0 THEN (avg(value ** 3) - 3 * avg(value) * avg(value ** 2) + 2 * avg(value) ** 3) / var_pop(value) ** 1.5 END, 4) AS skew FROM events, range(0, 7) r(k) GROUP BY 1, 2""",
)
def a07_stream(t):
    stream = trailing_stream(_streamed(t), "ts", ["event_type"], "value", 7, "60 days", ["min", "max", "count", "std", "skew"])
    found = latest(run_into(stream, scratch(t.spark, "windows"), scratch(t.spark, "progress")), ["until", "event_type"])
    return rounded(found.withColumn("until", F.date_format("until", "yyyy-MM-dd")))
