"""Queries: sources and sinks, profiles, cleansing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assemble, cleanse, folds, profile
from ..sources import tables
from .catalog import Tables, query, r4, rounded

GAPS = "CASE WHEN l_linenumber % 7 = 0 THEN NULL ELSE l_discount END"
LINES = f"(SELECT *, {GAPS} AS gap FROM lineitem)"


def _gaps(t: Tables):
    return t("lineitem").withColumn("gap", F.expr(GAPS))


def _customers(t: Tables):
    """Base table: every fifth customer is a test row."""
    return t("customer").withColumn("target", F.expr("CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_acctbal < 3000 AS INT) END"))


BASE = "(SELECT *, CASE WHEN c_custkey % 5 <> 0 THEN (c_acctbal < 3000)::INT END AS target FROM customer)"


@query("io12_sql", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus")
def io12(t):
    return t.spark.sql("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} GROUP BY o_orderstatus", orders=t("orders"))


@query("io03_pruned_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01'")
def io03(t):
    return tables.read_parts(t.spark, f"{t.folder}/orders.parquet", ["o_orderkey", "o_totalprice", "o_orderdate"]).filter("o_orderdate >= '2000-01-01'").drop("o_orderdate")


@query("io05_feature_check", f"SELECT 'gap' AS \"column\", count(*) FILTER (gap IS NULL) AS nulls, count(*) FILTER (gap = 'inf'::DOUBLE) AS pos_inf, count(*) FILTER (gap = '-inf'::DOUBLE) AS neg_inf FROM {LINES} UNION ALL SELECT 'l_tax', count(*) FILTER (l_tax IS NULL), 0, 0 FROM lineitem")
def io05(t):
    return profile.infinity_report(_gaps(t), ["gap", "l_tax"])


@query("io14_delete_rows", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus NOT IN ('F', 'P') OR o_orderstatus IS NULL")
def io14(t):
    return tables.without_rows(t("orders"), "o_orderstatus", ["F", "P"]).select("o_orderkey", "o_orderstatus")


@query("io15_new_field", "SELECT n_nationkey, NULL::DOUBLE AS gdp FROM nation")
def io15(t):
    return tables.with_column(t("nation").select("n_nationkey"), "gdp", "double")


@query(
    "io20_ffm_lines",
    """WITH v AS (SELECT DISTINCT 1 AS f, l_returnflag AS value FROM lineitem UNION SELECT DISTINCT 2, l_linestatus FROM lineitem),
    c AS (SELECT *, row_number() OVER (ORDER BY f, value) AS code FROM v)
    SELECT l_orderkey, l_linenumber, concat_ws(' ', (l_quantity > 25)::INT::VARCHAR, '0:0:' || l_quantity::INT::VARCHAR, '1:' || a.code || ':1', '2:' || b.code || ':1') AS line
    FROM lineitem JOIN c a ON a.f = 1 AND a.value = l_returnflag JOIN c b ON b.f = 2 AND b.value = l_linestatus""",
)
def io20(t):
    df = t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("q"), "l_returnflag", "l_linestatus", (F.col("l_quantity") > 25).cast("int").alias("y"))
    return tables.ffm_lines(df, "y", ["q"], ["l_returnflag", "l_linestatus"]).select("l_orderkey", "l_linenumber", "line")


@query("io21_labelled_lines", "SELECT d.doc_id, '__label__' || quality || ', ' || array_to_string(list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''), ' ') AS line FROM documents d JOIN labels USING (doc_id)")
def io21(t):
    return tables.labelled_lines(t("documents").join(t("labels"), "doc_id"), "quality", "text").select("doc_id", "line")


PROFILE = "WITH s AS (SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS nulls, count(DISTINCT {c}) AS n_distinct, min({c})::DOUBLE AS min, avg({c}) AS mean, max({c})::DOUBLE AS max, stddev_samp({c}) AS std FROM lineitem) SELECT \"column\", nulls, n_distinct, round(min, 4) AS min, round(mean, 4) AS mean, round(max, 4) AS max, round(std, 4) AS std, round(mean + 1.96 * std, 4) AS z_high, round(mean - 1.96 * std, 4) AS z_low, (SELECT count(*) FROM lineitem WHERE {c} >= mean + 1.96 * std) AS n_high, (SELECT count(*) FROM lineitem WHERE {c} <= mean - 1.96 * std) AS n_low FROM s"


@query("q02_column_profile", " UNION ALL ".join(f"({PROFILE.format(c=c)})" for c in ("l_quantity", "l_extendedprice", "l_tax")))
def q02(t):
    return rounded(profile.profile(t("lineitem"), ["l_quantity", "l_extendedprice", "l_tax"]))


@query(
    "q02_top_values",
    """WITH v AS (SELECT 'o_orderstatus' AS "column", o_orderstatus AS value FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders),
    c AS (SELECT "column", value, count(*) AS n FROM v GROUP BY ALL)
    SELECT "column", value, n, ratio, place FROM (SELECT *, round(n / sum(n) OVER (PARTITION BY "column"), 2) AS ratio, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value)::INT AS place FROM c) WHERE place <= 3""",
)
def q02_top(t):
    return profile.top_values(t("orders"), ["o_orderstatus", "o_orderpriority"], 3)


@query("q05_null_counts", f"SELECT 'gap' AS \"column\", count(*) FILTER (gap IS NULL) AS nulls FROM {LINES} UNION ALL SELECT 'l_tax', count(*) FILTER (l_tax IS NULL) FROM lineitem")
def q05(t):
    return profile.null_counts(_gaps(t), ["gap", "l_tax"])


@query("q06_low_variance", " UNION ALL ".join(f"SELECT * FROM (SELECT '{c}' AS \"column\", round(var_samp({c}), 6) AS variance FROM lineitem) WHERE variance <= 1" for c in ("l_tax", "l_discount", "l_quantity")))
def q06(t):
    return profile.low_variance(t("lineitem"), ["l_tax", "l_discount", "l_quantity"], 1.0).withColumn("variance", F.round("variance", 6))


@query("q10_correlations", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 4) AS r FROM lineitem" for a, b in (("l_quantity", "l_extendedprice"), ("l_quantity", "l_tax"), ("l_extendedprice", "l_tax"))))
def q10(t):
    return rounded(profile.correlations(t("lineitem"), ["l_quantity", "l_extendedprice", "l_tax"]))


@query("q08_correlated_pairs", "SELECT * FROM (SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 4) AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'twice', round(corr(l_quantity, 2 * l_quantity), 4) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'twice', round(corr(l_extendedprice, 2 * l_quantity), 4) FROM lineitem) WHERE abs(r) >= 0.8")
def q08(t):
    df = t("lineitem").withColumn("twice", 2 * F.col("l_quantity"))
    return rounded(profile.correlations(df, ["l_quantity", "l_extendedprice", "twice"])).filter("abs(r) >= 0.8")


@query("q11_distinct_values", "SELECT DISTINCT 'l_returnflag' AS \"column\", l_returnflag AS value FROM lineitem UNION ALL SELECT DISTINCT 'l_linestatus', l_linestatus FROM lineitem")
def q11(t):
    return profile.melt(t("lineitem"), ["l_returnflag", "l_linestatus"]).distinct().orderBy("column", "value")


@query(
    "q13_category_drift",
    f"""WITH a AS (SELECT c_mktsegment, count(*) AS n_train, avg(target) AS m FROM {BASE} WHERE target IS NOT NULL GROUP BY 1),
    b AS (SELECT c_mktsegment, count(*) AS n_test FROM {BASE} WHERE target IS NULL GROUP BY 1)
    SELECT coalesce(a.c_mktsegment, b.c_mktsegment) AS c_mktsegment, coalesce(n_train, 0) AS n_train, coalesce(n_test, 0) AS n_test, round(coalesce(m, 0), 4) AS target_mean, abs(coalesce(n_train, 0) - coalesce(n_test, 0)) AS diff FROM a FULL JOIN b ON a.c_mktsegment = b.c_mktsegment""",
)
def q13(t):
    return rounded(profile.category_drift(*cleanse.train_test(_customers(t), "target"), "c_mktsegment", "target")).orderBy(F.desc("diff"))


@query("q14_train_test_counts", f"SELECT c_mktsegment, (target IS NOT NULL)::INT AS is_train, count(*) AS n FROM {BASE} GROUP BY ALL")
def q14(t):
    a, b = cleanse.train_test(_customers(t), "target")
    counted = [d.groupBy("c_mktsegment").agg(F.count("*").alias("n")).withColumn("is_train", F.lit(k)) for k, d in ((1, a), (0, b))]
    return assemble.union_all(counted)


@query("q15_target_by_category", f"SELECT c_nationkey, round(avg(target), 4) AS mean, count(*) AS n FROM {BASE} WHERE target IS NOT NULL GROUP BY 1 HAVING count(*) > 40")
def q15(t):
    train, _ = cleanse.train_test(_customers(t), "target")
    return train.groupBy("c_nationkey").agg(r4(F.avg("target")).alias("mean"), F.count("*").alias("n")).filter("n > 40")


@query("q16_overlap", "WITH a AS (SELECT DISTINCT o_custkey AS v FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS v FROM orders WHERE o_orderstatus = 'O') SELECT count(*) FILTER (b.v IS NULL) AS only_a, count(*) FILTER (a.v IS NULL) AS only_b, count(*) FILTER (a.v = b.v) AS both FROM a FULL JOIN b ON a.v = b.v")
def q16(t):
    o = t("orders")
    return profile.overlap(o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'O'"), "o_custkey")


HIST = "least(30, floor((l_extendedprice - lo) * 30 / (hi - lo)) + 1)::INT"


@query("q17_histogram", f"SELECT {HIST} AS bin, count(*) AS n FROM lineitem, (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) GROUP BY 1")
def q17(t):
    return profile.histogram(t("lineitem"), "l_extendedprice")


@query("q18_histogram_by_class", f"SELECT l_returnflag, {HIST} AS bin, count(*) AS n FROM lineitem, (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) GROUP BY 1, 2")
def q18(t):
    return profile.histogram(t("lineitem"), "l_extendedprice", by=["l_returnflag"])


@query("q19_five_numbers", "SELECT p_brand, round(min(p_retailprice), 4) AS low, round(quantile_cont(p_retailprice, 0.25), 4) AS q1, round(quantile_cont(p_retailprice, 0.5), 4) AS median, round(quantile_cont(p_retailprice, 0.75), 4) AS q3, round(max(p_retailprice), 4) AS high FROM part GROUP BY 1")
def q19(t):
    return rounded(profile.five_numbers(t("part"), "p_brand", "p_retailprice"))


@query("q20_narrowed_types", "SELECT l_orderkey::BIGINT AS l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey::BIGINT AS l_partkey FROM lineitem")
def q20(t):
    small = profile.narrowed(t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey"))
    return small.select(*[F.col(c).cast("long").alias(c) for c in small.columns])


@query("p01_where", "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN o_totalprice ELSE 0.0 END AS price FROM orders")
def p01(t):
    return t("orders").select("o_orderkey", F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")).otherwise(0.0).alias("price"))


@query("p02_cap", "SELECT c_custkey, CASE WHEN c_acctbal <= 5000 THEN c_acctbal ELSE 5000.0 END AS c_acctbal FROM customer")
def p02(t):
    return cleanse.cap(t("customer").select("c_custkey", "c_acctbal"), {"c_acctbal": 5000.0})


@query("p03_sentinel_to_null", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS c_acctbal FROM customer")
def p03(t):
    return cleanse.keep_where(t("customer").select("c_custkey", "c_acctbal"), {"c_acctbal": (">", 0)})


@query("p04_replace", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'O' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def p04(t):
    return t("orders").select("o_orderkey", "o_orderstatus").replace({"P": "O"}, subset=["o_orderstatus"])


@query("p05_fill", f"SELECT l_orderkey, l_linenumber, coalesce(gap, 0.0) AS gap FROM {LINES}")
def p05(t):
    return _gaps(t).select("l_orderkey", "l_linenumber", "gap").fillna(0.0, ["gap"])


@query("p06_conditional_copies", "SELECT o_orderkey, o_totalprice, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS f_o_totalprice FROM orders")
def p06(t):
    df = t("orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return cleanse.conditional_copies(df, F.col("o_orderstatus") == "F", "f_", ["o_orderkey", "o_orderstatus"]).drop("o_orderstatus")


@query("p07_drop_named", "SELECT o_orderkey, o_custkey FROM orders")
def p07(t):
    return cleanse.drop_named(cleanse.drop_named(cleanse.drop_named(t("orders"), "o_order" + "d"), "price"), "prio").drop("o_orderstatus")


@query("p08_null_safe_filter", f"SELECT l_orderkey, l_linenumber FROM {LINES} WHERE gap IS DISTINCT FROM 0.05 AND l_quantity > 10")
def p08(t):
    return _gaps(t).filter(cleanse.not_equal(F.col("gap"), 0.05) & (F.col("l_quantity") > 10)).select("l_orderkey", "l_linenumber")


@query("p09_last_per_key", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders WHERE o_orderstatus = 'F') WHERE n = 1 UNION ALL SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus <> 'F'")
def p09(t):
    o = t("orders")
    done = cleanse.last_per_key(o.filter("o_orderstatus = 'F'"), "o_custkey", F.col("o_orderdate"), F.col("o_orderkey"))
    return assemble.union_all([done, o.filter("o_orderstatus <> 'F'")]).select("o_custkey", "o_orderkey")


INF = "CASE WHEN l_linenumber = 3 THEN 'inf'::DOUBLE WHEN l_linenumber = 5 THEN '-inf'::DOUBLE ELSE l_tax END"


def _infinite(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") == 3, float("inf")).when(F.col("l_linenumber") == 5, float("-inf")).otherwise(F.col("l_tax")).alias("x"))


@query("p10_infinite_to_null", f"SELECT l_orderkey, l_linenumber, CASE WHEN isfinite(x) THEN x END AS x FROM (SELECT *, {INF} AS x FROM lineitem)")
def p10(t):
    return cleanse.infinite_to_null(_infinite(t))


@query("p11_infinite_to_range", f"WITH v AS (SELECT *, {INF} AS x FROM lineitem), e AS (SELECT max(x) FILTER (isfinite(x)) AS hi, min(x) FILTER (isfinite(x)) AS lo FROM v) SELECT l_orderkey, l_linenumber, CASE WHEN x = 'inf'::DOUBLE THEN hi WHEN x = '-inf'::DOUBLE THEN lo ELSE x END AS x FROM v, e")
def p11(t):
    return cleanse.infinite_to_range(_infinite(t), "x")


for _how, _sql in (("mean", "avg(gap)"), ("median", "median(gap)")):
    _name = {"mean": "p12_impute_mean", "median": "p15_impute_median"}[_how]

    @query(_name, f"SELECT l_orderkey, l_linenumber, round(coalesce(gap, m), 4) AS gap FROM {LINES}, (SELECT {_sql} AS m FROM {LINES})")
    def _impute(t, how=_how):
        return rounded(cleanse.impute(_gaps(t).select("l_orderkey", "l_linenumber", "gap"), ["gap"], how))


@query("p13_impute_by_group", f"SELECT l_orderkey, l_linenumber, round(coalesce(gap, avg(gap) OVER (PARTITION BY l_partkey)), 4) AS gap FROM {LINES}")
def p13(t):
    return rounded(cleanse.impute_by_group(_gaps(t).select("l_orderkey", "l_linenumber", "l_partkey", "gap"), ["l_partkey"], "gap")).drop("l_partkey")


@query("p14_impute_mode", f"SELECT l_orderkey, l_linenumber, coalesce(gap, m) AS gap FROM {LINES}, (SELECT gap AS m FROM {LINES} WHERE gap IS NOT NULL GROUP BY gap ORDER BY count(*) DESC, gap LIMIT 1)")
def p14(t):
    return cleanse.impute(_gaps(t).select("l_orderkey", "l_linenumber", "gap"), ["gap"], "mode")


@query("p16_standardise", "SELECT p_partkey, round((p_retailprice - m) / s, 4) AS p_retailprice FROM part, (SELECT avg(p_retailprice) AS m, stddev_samp(p_retailprice) AS s FROM part)")
def p16(t):
    return rounded(cleanse.standardise(t("part").select("p_partkey", "p_retailprice"), ["p_retailprice"]))


@query("p17_standardise_population", "SELECT p_partkey, round((p_retailprice - m) / s, 4) AS p_retailprice FROM part, (SELECT avg(p_retailprice) AS m, stddev_pop(p_retailprice) AS s FROM part)")
def p17(t):
    return rounded(cleanse.standardise(t("part").select("p_partkey", "p_retailprice"), ["p_retailprice"], True))


@query("p18_max_scale", "SELECT c_custkey, round((c_acctbal + sh) / (hi + sh), 4) AS c_acctbal FROM customer, (SELECT max(c_acctbal) AS hi, CASE WHEN min(c_acctbal) < 0 THEN abs(min(c_acctbal)) ELSE 0 END AS sh FROM customer)")
def p18(t):
    return rounded(cleanse.max_scale(t("customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]))


@query("p19_regularise", f"WITH v AS (SELECT l_orderkey, l_linenumber, coalesce(gap, avg(gap) OVER ()) AS x FROM {LINES}) SELECT l_orderkey, l_linenumber, round((x - avg(x) OVER ()) / stddev_samp(x) OVER (), 2) + 0.0 AS gap FROM v")
def p19(t):
    df = cleanse.regularise(_gaps(t).select("l_orderkey", "l_linenumber", "gap"), ["gap"])
    return df.select("l_orderkey", "l_linenumber", (F.round(F.col("gap").cast("double"), 2) + 0.0).alias("gap"))


Z = "WITH v AS (SELECT c_custkey, c_acctbal, (c_acctbal - avg(c_acctbal) OVER ()) / stddev_samp(c_acctbal) OVER () AS z FROM customer)"


@query("p20_outliers_inner", f"{Z}, e AS (SELECT max(c_acctbal) AS hi, min(c_acctbal) AS lo FROM v WHERE abs(z) < 1.5) SELECT c_custkey, CASE WHEN z >= 1.5 THEN hi WHEN z <= -1.5 THEN lo ELSE c_acctbal END AS c_acctbal, round(z, 4) AS z FROM v, e")
def p20(t):
    return cleanse.outliers(t("customer").select("c_custkey", "c_acctbal"), "c_acctbal", 1.5).withColumn("z", F.round("z", 4))


@query("p20_outliers_drop", f"{Z} SELECT c_custkey, c_acctbal, round(z, 4) AS z FROM v WHERE abs(z) < 1.5")
def p20_drop(t):
    return cleanse.outliers(t("customer").select("c_custkey", "c_acctbal"), "c_acctbal", 1.5, "drop").withColumn("z", F.round("z", 4))


@query("p21_contraction", "SELECT o_orderkey, least(o_totalprice, 200000.0) AS capped, CASE WHEN o_totalprice >= 50000 THEN o_totalprice END AS floored FROM orders")
def p21(t):
    from ..functions.columns import contract

    c = F.col("o_totalprice")
    return t("orders").select("o_orderkey", contract(c, 200000).alias("capped"), contract(c, 50000, above=False, to_null=True).alias("floored"))


@query("p22_frequent_groups", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 12)")
def p22(t):
    return cleanse.frequent_groups(t("orders").select("o_orderkey", "o_custkey"), "o_custkey", 12)


@query("p23_date_range", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate <= TIMESTAMP '1998-03-01'")
def p23(t):
    return t("orders").filter(F.col("o_orderdate").between("1998-01-01", "1998-03-01")).select("o_orderkey")


@query("p24_trailing_filter", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-13' AND ts < TIMESTAMP '2024-01-20'")
def p24(t):
    end = F.to_timestamp(F.lit("2024-01-20"))
    return t("events").filter((F.col("ts") >= end - F.expr("INTERVAL 7 DAYS")) & (F.col("ts") < end)).select("event_id")


@query("p25_train_test", f"SELECT (target IS NOT NULL)::INT AS is_train, count(*) AS n FROM {BASE} GROUP BY 1")
def p25(t):
    a, b = cleanse.train_test(_customers(t), "target")
    return a.agg(F.lit(1).alias("is_train"), F.count("*").alias("n")).union(b.agg(F.lit(0).alias("is_train"), F.count("*").alias("n")))


FOLDED = "SELECT *, ((row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(c_custkey::VARCHAR || '|1208'), c_custkey) - 1) % 5 + 1)::INT AS valid_no FROM customer"


@query("p26_fold_split", f"SELECT c_custkey FROM ({FOLDED}) WHERE valid_no = 2")
def p26(t):
    return cleanse.fold_split(folds.folds(t("customer"), "c_custkey", 5, ["c_mktsegment"]), "valid_no", 2)[1].select("c_custkey")


@query("p28_clean_rows", "SELECT DISTINCT TRY_CAST(CASE WHEN p_size % 9 = 0 THEN 'size' ELSE p_size::VARCHAR END AS DOUBLE) AS size, p_brand FROM part WHERE p_size % 9 <> 0")
def p28(t):
    raw = t("part").select(F.when(F.col("p_size") % 9 == 0, "size").otherwise(F.col("p_size").cast("string")).alias("size"), "p_brand")
    return raw.filter("size <> 'size'").select(F.col("size").try_cast("double").alias("size"), "p_brand").dropDuplicates()


@query("p29_residual_rule", "SELECT event_id, CASE WHEN p < 0.5 THEN 0.0 ELSE p END AS p FROM (SELECT event_id, round(value / 100, 4) * (event_id % 4 <> 1)::INT * (event_id % 5 <> 1)::INT AS p FROM events)")
def p29(t):
    from ..operators.metrics import residual_rule

    e = t("events").select("event_id", F.round(F.col("value") / 100, 4).alias("p"), (F.col("event_id") % 4).alias("hits"), (F.col("event_id") % 5).alias("bounces"))
    return residual_rule(e, "p", "hits", "bounces", 0.5).select("event_id", "p")


@query("p30_log_target", "SELECT o_orderkey, round(ln(1 + o_totalprice), 4) AS y, round(exp(ln(1 + o_totalprice)) - 1, 2) AS back FROM orders")
def p30(t):
    return t("orders").select("o_orderkey", r4(F.log1p("o_totalprice")).alias("y"), F.round(F.expm1(F.log1p("o_totalprice")), 2).alias("back"))


@query("c01_clean_base", "SELECT c_custkey, least(c_acctbal, 9000.0) AS c_acctbal, coalesce(CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_mktsegment END, 'XNA') AS c_mktsegment, CASE WHEN c_nationkey = 3 THEN least(c_acctbal, 9000.0) END AS revo_c_acctbal FROM customer")
def c01(t):
    df = t("customer").select("c_custkey", "c_acctbal", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("c_mktsegment"), "c_nationkey")
    df = cleanse.cap(df, {"c_acctbal": 9000.0}).fillna("XNA", ["c_mktsegment"])
    return cleanse.conditional_copies(df, F.col("c_nationkey") == 3, "revo_", ["c_custkey", "c_mktsegment", "c_nationkey"]).drop("c_nationkey")
