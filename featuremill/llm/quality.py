"""Quality rules with adaptive thresholds per language and source.

Each document gets base counts. Documents that pass the base rule feed one mergeable quantile sketch per metric and
(language, source): counts in logarithmic buckets of 2 % width, so a quantile is off by 1 % of its value at most and
sketches merge by adding counts. Groups of fewer than ``MIN_GROUP`` documents use the merged sketch of their language,
and where that is small, too, of everything. A document is kept if every metric lies within
``q25 - 3 (q75 - q25) - slack`` and ``q75 + 3 (q75 - q25) + slack`` of its group. The bounds are joined back. The slack of the
repeat rate is below the base rule's 20 %, so that the group's own sketch can reject what the base rule lets pass.
The coarsest level, one row of bounds for everything, meets the groups by a join without keys: one side is one row.

Defined cases: null text has no words and fails the base rule; null language or source is a group of its own; a
group that feeds no document into any sketch keeps what passes the base rule; an empty table gives an empty result;
equal rows each get a row; columns beyond doc_id, text, lang and source are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, table, words_of, written

#: Width of a bucket's bounds (ratio), documents from which a group has thresholds of its own, window of repeats.
GAMMA, MIN_GROUP, SPAN = 1.02, 100, 5
#: metric: (numerator, denominator, slack: the least distance from the quartiles that counts).
METRICS = {
    "word_length": ("word_chars", "n_words", 0.5),
    "symbol_rate": ("n_symbols", "n_words", 0.1),
    "dup_line_rate": ("n_dup_lines", "n_lines", 0.25),
    "repeat_rate": ("n_repeat_words", "n_words", 0.12),
}
SYMBOLS = r"[#*$%&|<>]+"


def base_features(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the base counts and base_failed. One pass without a shuffle."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").alias("lang"), F.col("source").alias("source"),
        words_of(F.col("text")).alias("words"), lines.alias("lines"),
        (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    w = F.col("words")
    rows = rows.select(
        "doc_id", "lang", "source", "n_symbols",
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(w) >= SPAN, F.transform(F.sequence(F.lit(0), F.size(w) - SPAN), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SPAN)]))).alias("windows"),
    )
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("placed", F.when(repeats, placed)).drop("windows")
    p = F.col("placed")
    again = F.filter(p, lambda x, k: (F.get(p, k + 1)["h"] == x["h"]) | ((k > 0) & (F.get(p, F.greatest(k - 1, F.lit(0)))["h"] == x["h"])))
    rows = rows.withColumn("starts", F.sort_array(F.transform(again, lambda x: x["i"]))).drop("placed")
    s = F.col("starts")
    steps = F.transform(s, lambda x, k: F.when(k == 0, SPAN).otherwise(F.least(F.lit(SPAN), x - F.get(s, F.greatest(k - 1, F.lit(0))))))
    covered = F.coalesce(F.aggregate(steps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")
    rows = rows.withColumn("n_repeat_words", covered).drop("starts")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def metric(name: str) -> Column:
    over, under, _ = METRICS[name]
    return F.when(F.col(under) > 0, F.col(over) / F.col(under)).otherwise(F.lit(0.0))


def sketches(features: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket, n): the sketch of each group; bucket null holds the zeros."""
    long = features.filter(~F.col("base_failed")).select(
        "lang", "source", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), metric(m).alias("v")) for m in METRICS])).alias("x")
    )
    bucket = F.when(F.col("x.v") > 0, F.ceil(F.log("x.v") / F.lit(GAMMA_LOG)).cast("int"))
    return long.groupBy("lang", "source", F.col("x.metric").alias("metric"), bucket.alias("bucket")).agg(F.count("*").alias("n"))


GAMMA_LOG = 0.01980262729617973  # ln 1.02


def thresholds(sketch: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """(lang, source, low and high of every metric) of each group that feeds a sketch."""
    groups = sketch.select("lang", "source").distinct()
    levels = []
    for level, (lang, source) in enumerate([(True, True), (True, False), (False, False)]):
        keys = ["lang"] * lang + ["source"] * source
        merged = sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
        upto = Window.partitionBy(*keys, "metric").orderBy(F.col("bucket").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
        total = Window.partitionBy(*keys, "metric")
        value = F.when(F.col("bucket").isNull(), 0.0).otherwise(2 * F.pow(F.lit(GAMMA), F.col("bucket")) / (1 + GAMMA))
        at = merged.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(total)).withColumn("value", value)
        quart = at.groupBy(*keys, "metric").agg(
            F.max("total").alias("total"),
            F.min(F.when(4 * F.col("upto") >= F.col("total"), F.col("value"))).alias("q1"),
            F.min(F.when(4 * F.col("upto") >= 3 * F.col("total"), F.col("value"))).alias("q3"),
        )
        slack = reduce(lambda e, m: F.when(F.col("metric") == m, METRICS[m][2]).otherwise(e), METRICS, F.lit(None).cast("double"))
        spread = 3 * (F.col("q3") - F.col("q1"))
        bounds = quart.withColumn("low", F.col("q1") - spread - slack).withColumn("high", F.col("q3") + spread + slack)
        wide = bounds.groupBy(*keys).agg(F.max("total").alias("total"), *[F.max(F.when(F.col("metric") == m, F.col(b))).alias(f"{m}_{b}") for m in METRICS for b in ("low", "high")])
        held = [F.lit(level).alias("level"), "total", *[f"{m}_{b}" for m in METRICS for b in ("low", "high")]]
        g, x = groups.alias("g"), wide.alias("x")
        on = [F.col(f"g.{k}").eqNullSafe(F.col(f"x.{k}")) for k in keys] or [F.lit(True)]
        levels.append(g.join(x, reduce(lambda a, b: a & b, on)).select("g.lang", "g.source", *held))
    every = reduce(DataFrame.unionByName, levels).filter((F.col("total") >= min_group) | (F.col("level") == 2))
    names = [f"{m}_{b}" for m in METRICS for b in ("low", "high")]
    best = every.groupBy("lang", "source").agg(F.min_by(F.struct(*names), "level").alias("b"))
    return best.select("lang", "source", "b.*")


def quality_verdicts(docs: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    features = written(base_features(docs), "quality")
    bounds = written(thresholds(sketches(features), min_group), "bounds")
    f, b = features.alias("f"), bounds.alias("b")
    joined = f.join(b, F.col("f.lang").eqNullSafe(F.col("b.lang")) & F.col("f.source").eqNullSafe(F.col("b.source")), "left")
    inside = [(metric(m) >= F.col(f"b.{m}_low")) & (metric(m) <= F.col(f"b.{m}_high")) for m in METRICS]
    kept = ~F.col("base_failed") & F.coalesce(reduce(lambda x, y: x & y, inside), F.lit(True))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    m = {k: f"CASE WHEN {under} > 0 THEN {over}::DOUBLE / {under} ELSE 0.0 END" for k, (over, under, _) in METRICS.items()}
    long = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS metric, {e} AS v FROM feat WHERE NOT base_failed" for k, e in m.items())
    slack = "CASE metric " + " ".join(f"WHEN '{k}' THEN {s}" for k, (_, _, s) in METRICS.items()) + " END"
    level = lambda keys, g: f"""SELECT {keys} metric, max(total) AS total,
      min(CASE WHEN 4 * upto >= total THEN value END) AS q1, min(CASE WHEN 4 * upto >= 3 * total THEN value END) AS q3
      FROM (SELECT *, sum(n) OVER (PARTITION BY {keys} metric ORDER BY bucket NULLS FIRST ROWS UNBOUNDED PRECEDING) AS upto,
        sum(n) OVER (PARTITION BY {keys} metric) AS total, CASE WHEN bucket IS NULL THEN 0.0 ELSE 2 * power({GAMMA}, bucket) / (1 + {GAMMA}) END AS value
        FROM (SELECT {keys} metric, bucket, sum(n) AS n FROM sketch GROUP BY {keys} metric, bucket)) GROUP BY {keys} metric"""  # noqa: E731
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, list_filter(regexp_split_to_array(t, '{SPACE_CLASS}'), lambda x: x <> '') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
    grams AS (SELECT rid, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
    dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM grams) WHERE c >= 2),
    cov AS (SELECT rid, sum(step)::BIGINT AS n_repeat_words FROM (SELECT rid, least(5, coalesce(i - lag(i) OVER (PARTITION BY rid ORDER BY i), 5)) AS step FROM dup) GROUP BY rid),
    feat0 AS (SELECT w.rid, doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '{SYMBOLS}', '', 'g')))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN cov ON w.rid = cov.rid),
    feat AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM feat0),
    sketch AS (SELECT lang, source, metric, CASE WHEN v > 0 THEN ceil(ln(v) / {GAMMA_LOG})::INT END AS bucket, count(*) AS n FROM ({long}) GROUP BY ALL),
    l0 AS ({level("lang, source,", 2)}), l1 AS ({level("lang,", 1)}), l2 AS ({level("", 0)}),
    grp AS (SELECT DISTINCT lang, source, metric FROM sketch),
    picked AS (SELECT g.lang, g.source, g.metric,
        CASE WHEN l0.total >= {MIN_GROUP} THEN l0.q1 WHEN l1.total >= {MIN_GROUP} THEN l1.q1 ELSE l2.q1 END AS q1,
        CASE WHEN l0.total >= {MIN_GROUP} THEN l0.q3 WHEN l1.total >= {MIN_GROUP} THEN l1.q3 ELSE l2.q3 END AS q3
        FROM grp g JOIN l0 ON g.lang IS NOT DISTINCT FROM l0.lang AND g.source IS NOT DISTINCT FROM l0.source AND g.metric = l0.metric
        JOIN l1 ON g.lang IS NOT DISTINCT FROM l1.lang AND g.metric = l1.metric JOIN l2 ON g.metric = l2.metric),
    bounds AS (SELECT *, q1 - 3 * (q3 - q1) - {slack} AS low, q3 + 3 * (q3 - q1) + {slack} AS high FROM picked),
    vals AS ({" UNION ALL ".join(f"SELECT rid, lang, source, '{k}' AS metric, {e} AS v FROM feat" for k, e in m.items())}),
    bad AS (SELECT DISTINCT rid FROM vals JOIN bounds b ON vals.lang IS NOT DISTINCT FROM b.lang AND vals.source IS NOT DISTINCT FROM b.source AND vals.metric = b.metric WHERE v < low OR v > high)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rid NOT IN (SELECT rid FROM bad) AS kept FROM feat
    """


OP2_SQL = _oracle()
