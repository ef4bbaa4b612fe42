"""Queries: field-aware factorisation machines, fitted, and their first gradient against SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import ffm
from ..sources.tables import field_codes
from .catalog import query

FIELDS = ["l_returnflag", "l_linestatus", "year"]


def _lines(t):
    key = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("k")
    return t("lineitem").select(key, (F.col("l_discount") > 0.05).cast("int").alias("y"), (F.col("l_quantity") / 50).cast("double").alias("q"), "l_returnflag", "l_linestatus", F.year("l_shipdate").alias("year"))


@query(
    "ml17_ffm_gradient",
    """WITH r AS (SELECT (l_discount > 0.05)::INT AS y, l_returnflag, l_linestatus, year(l_shipdate)::VARCHAR AS year FROM lineitem),
    e AS (SELECT 1 / (1 + exp(-1.5)) - y AS e, l_returnflag, l_linestatus, year FROM r),
    l AS (SELECT 0 AS f, l_returnflag AS v, e FROM e UNION ALL SELECT 1, l_linestatus, e FROM e UNION ALL SELECT 2, year, e FROM e),
    s AS (SELECT f, v, sum(e) AS s FROM l GROUP BY f, v),
    g AS (SELECT * FROM (VALUES (0), (1), (2)) t(g), (VALUES (0), (1)) u(k))
    SELECT f AS field, v AS value, 0 AS at, round(s, 4) AS total FROM s UNION ALL SELECT f, v, 1 + 2 * g + k, round(0.5 * s, 4) FROM s, g WHERE g <> f""",
)
def ml17_gradient(t):
    """The first step's summed gradient with all latent factors at a half: each pair of fields gives a half to the logit."""
    rows, codes = _lines(t), field_codes(_lines(t), [], FIELDS)
    n = codes.count()
    sums = ffm.summed_gradient(ffm.coded_rows(rows, "y", [], FIELDS, codes), ffm.Weights(0.0, np.zeros(n), np.full((n, len(FIELDS), 2), 0.5)))
    return sums.join(codes, F.col("feature") == F.col("code")).select("field", "value", "at", F.round("sum", 4).alias("total"))


@query("ml17_field_aware")
def ml17_fit(t):
    """Trained on three of four lines, all are predicted."""
    rows = _lines(t).withColumn("y", F.when(F.col("k") % 4 != 0, F.col("y")))
    model = ffm.fit(rows, "k", "y", ["q"], FIELDS, epochs=3, batches=2)
    return ffm.predict(rows, model, "k").select("k", F.round("prediction", 6).alias("prediction"))
