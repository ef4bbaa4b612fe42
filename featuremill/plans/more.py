"""Queries: round trips through sources, composite pipelines, smaller operators, models."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as fn
from ..operators import aggregate, assemble, cleanse, encode, folds, metrics, models, profile
from ..sources import tables
from ..sources.scratch import scratch, stored
from .catalog import query, r4, rounded
from .features import IMPORTANCE, PRED, _importance, _model_rows, _predictions, _registry
from .tables_and_quality import BASE, LINES, _customers, _gaps

FEATURES = ["total", "n", "c_nationkey"]


# ---- sources ------------------------------------------------------------------------------------------------------
@query("io01_csv_scan", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def io01(t):
    df, path = t("customer").select("c_custkey", "c_name", "c_acctbal"), scratch(t.spark, "csv")
    tables.write_csv(df, path)
    return tables.read_csv(t.spark, path, df.schema)


@query("io02_part_files", "SELECT o_orderkey, o_totalprice FROM orders")
def io02(t):
    path = scratch(t.spark, "parts")
    tables.write_parts(t("orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), path, 3)
    return tables.read_parts(t.spark, path, ["o_orderkey", "o_totalprice"])


STORE = f"WITH o AS (SELECT o_custkey AS c_custkey, sum(o_totalprice)::FLOAT::DOUBLE AS total, count(*)::FLOAT::DOUBLE AS n FROM orders GROUP BY 1) SELECT c_custkey, total, n FROM {BASE} LEFT JOIN o USING (c_custkey)"


@query("io04_feature_store", STORE)
def io04(t):
    sums = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("total"), F.count("*").alias("n"))
    wide = assemble.feature_matrix(_customers(t).select("c_custkey", "target"), [sums], "c_custkey")
    registry = tables.save_features(wide, "c_custkey", "target", scratch(t.spark, "store"))
    out = tables.load_features(t.spark, registry, "c_custkey")
    return out.select("c_custkey", F.col("total").cast("double").alias("total"), F.col("n").cast("double").alias("n"))


@query("io06_select_named", "SELECT o_custkey, round(sum(o_totalprice), 4) AS agg_total FROM orders GROUP BY 1")
def io06(t):
    df = aggregate.aggregate(t("orders").withColumn("raw", F.lit(1)), "o_custkey", ["o_totalprice"], ["sum"])
    named = tables.select_named(df, "o_custkey", prefix="agg_")
    return rounded(named.withColumnRenamed("agg_o_totalprice_sum@o_custkey", "agg_total"))


@query("io13_catalog_table", "SELECT o_orderstatus, count(*) AS n FROM (SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderstatus = 'P') GROUP BY 1")
def io13(t):
    name, df = f"t_{uuid.uuid4().hex}", t("orders")
    tables.create_table(t.spark, name, df.schema)
    tables.append_table(df, name)
    tables.append_table(df.filter("o_orderstatus = 'P'"), name)
    made = stored(tables.table_from_query(t.spark, f"{name}_q", f"SELECT o_orderstatus, count(*) AS n FROM {name} GROUP BY o_orderstatus"), "rows")
    tables.drop_tables(t.spark, "default", name)
    return made


@query("io19_appended_batches", "SELECT s_suppkey, s_name FROM supplier")
def io19(t):
    df, path = t("supplier").select("s_suppkey", "s_name"), scratch(t.spark, "batches")
    tables.append_csv(df.filter("s_suppkey % 2 = 0"), path)
    tables.append_csv(df.filter("s_suppkey % 2 <> 0"), path)
    return tables.read_csv(t.spark, path, df.schema)


# ---- profiles and cleansing -------------------------------------------------------------------------------------------
@query("q03_shape", f"SELECT count(*) AS n_rows, count(gap) AS gap_values, count(DISTINCT gap) AS gap_distinct FROM {LINES}")
def q03(t):
    return _gaps(t).agg(F.count("*").alias("n_rows"), F.count("gap").alias("gap_values"), F.count_distinct("gap").alias("gap_distinct"))


@query("q09_without_correlated", "SELECT l_orderkey, l_linenumber, l_quantity, l_tax FROM lineitem")
def q09(t):
    df = t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax", (2 * F.col("l_quantity")).alias("twice"), F.lit(1).alias("one"))
    flat = [r.column for r in profile.low_variance(df, ["one", "l_quantity"]).collect()]
    return df.drop(*flat, *profile.correlated(df, ["l_quantity", "l_tax", "twice"], 0.99))


DICTIONARY = {
    "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"),
    "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"),
    "nation": ("n_nationkey", "n_name", "n_regionkey"),
}


@query("q12_data_dictionary", " UNION ALL ".join(f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", {len(c)}::BIGINT AS n, count({c}) AS n_values FROM {t}" for t, cs in DICTIONARY.items() for c in cs))
def q12(t):
    parts = [profile.long_aggregate(t(name), columns, {"n_values": F.count}).select(F.lit(name).alias("table"), "column", F.length("column").cast("long").alias("n"), "n_values") for name, columns in DICTIONARY.items()]
    return assemble.union_all(parts).orderBy(F.desc("n"), "table", "column")


@query("q22_unusable_columns", "SELECT unnest(['flat', 'o_orderdate']) AS \"column\" FROM (SELECT count(*) AS n FROM orders) WHERE n > 0")
def q22(t):
    df = t("orders").withColumn("flat", F.lit("x"))
    dates = df.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    return t.spark.createDataFrame([(c,) for c in profile.unusable(dates, dates.filter("o_custkey % 5 = 0"))], "`column` string")


@query("c02_sentinels", "SELECT o_orderkey, CASE WHEN d > 500 THEN d END AS d, CASE WHEN e > 0 THEN e END AS e FROM (SELECT o_orderkey, date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) AS d, (o_totalprice - 100000) AS e FROM orders)")
def c02(t):
    df = t("orders").select("o_orderkey", F.datediff("o_orderdate", F.lit("1995-01-01")).cast("long").alias("d"), (F.col("o_totalprice") - 100000).alias("e"))
    return cleanse.keep_where(df, {"d": (">", 500), "e": (">", 0)})


@query("c03_mixed_cleansing", "SELECT p_partkey, CASE WHEN p_size <= 30 THEN p_size ELSE 30 END AS p_size, coalesce(CASE WHEN p_brand = 'Brand#11' THEN NULL ELSE p_brand END, 'XNA') AS p_brand, CASE WHEN p_type LIKE '%A%' THEN p_retailprice END AS revo_p_retailprice FROM part")
def c03(t):
    df = t("part").select("p_partkey", "p_size", F.nullif("p_brand", F.lit("Brand#11")).alias("p_brand"), "p_type", "p_retailprice")
    df = df.withColumn("p_size", F.when(F.col("p_size") <= 30, F.col("p_size")).otherwise(30)).fillna("XNA", ["p_brand"])
    return cleanse.conditional_copies(df, F.col("p_type").contains("A"), "revo_", ["p_partkey", "p_size", "p_brand", "p_type"]).drop("p_type", "p_retailprice")


@query("c05_positive_amounts", f"SELECT l_orderkey, l_linenumber, coalesce(gap, 0.0) AS gap FROM {LINES} WHERE l_quantity > 20")
def c05(t):
    return _gaps(t).filter("l_quantity > 20").select("l_orderkey", "l_linenumber", "gap").fillna(0.0, ["gap"])


@query("c08_model_ready", f"WITH v AS (SELECT l_orderkey, l_linenumber, coalesce(gap, avg(gap) OVER ()) AS x FROM {LINES}) SELECT l_orderkey, l_linenumber, round(x / max(x) OVER (), 3) AS gap FROM v")
def c08(t):
    df = cleanse.regularise(_gaps(t).select("l_orderkey", "l_linenumber", "gap"), ["gap"], "max")
    return df.select("l_orderkey", "l_linenumber", F.round(F.col("gap").cast("double"), 3).alias("gap"))


# ---- joins, sorts, sets --------------------------------------------------------------------------------------------------
@query("j01_left_join", "SELECT c_custkey, n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON c_custkey = o_custkey")
def j01(t):
    agg = t("orders").filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return assemble.feature_matrix(t("customer").select("c_custkey"), [agg], "c_custkey")


@query("j03_columns_from_both", f"SELECT o_orderkey, c_acctbal FROM orders LEFT JOIN {BASE} ON o_custkey = c_custkey")
def j03(t):
    both = assemble.union_all([d.select("c_custkey", "c_acctbal") for d in cleanse.train_test(_customers(t), "target")])
    return t("orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(both, "c_custkey", "left").drop("c_custkey")


@query("j10_combinations_made", f"SELECT x, y, z, (EXISTS (SELECT 1 FROM {IMPORTANCE} i WHERE contains(i.feature, x) AND contains(i.feature, y) AND contains(i.feature, z)))::INT AS made FROM (SELECT unnest(['1', '2']) AS x), (SELECT unnest(['33', '44']) AS y), (SELECT unnest(['_5', '_9']) AS z)")
def j10(t):
    return assemble.combinations_made([["1", "2"], ["33", "44"], ["_5", "_9"]], _importance(t).select("feature"))


@query("j11_column_usage", f"SELECT p_brand AS dataset, c AS \"column\", count(DISTINCT feature) AS n FROM {IMPORTANCE}, (SELECT unnest(['11', '7', '300']) AS c) WHERE contains(feature, c) GROUP BY 1, 2")
def j11(t):
    return assemble.column_usage(_importance(t).select("feature", F.col("p_brand").alias("dataset")), ["11", "7", "300", "7"])


@query("k01_sorted", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey")
def k01(t):
    return t("orders").select("o_orderkey", "o_totalprice").orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey")


@query("k04_head", "SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 10")
def k04(t):
    return t("orders").orderBy("o_orderdate", "o_orderkey").limit(10).select("o_orderkey")


@query("a18_mean_importance", "SELECT p_brand, round(avg(p_retailprice), 4) AS importance FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def a18(t):
    return t("part").groupBy("p_brand").agg(r4(F.avg("p_retailprice")).alias("importance")).orderBy(F.desc("importance"), "p_brand").limit(10)


@query("t08_dense_rank", "SELECT p_brand, dense_rank() OVER (ORDER BY n)::INT AS place FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY 1)")
def t08(t):
    return t("part").groupBy("p_brand").agg(F.count("*").alias("n")).select("p_brand", F.dense_rank().over(Window.orderBy("n")).alias("place"))


@query("u02_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def u02(t):
    return t("lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("u04_intersection", "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def u04(t):
    o = t("orders")
    return o.filter("o_orderstatus = 'F'").select("o_custkey").intersect(o.filter("o_orderstatus = 'P'").select("o_custkey"))


# ---- scalar functions -------------------------------------------------------------------------------------------------------
@query("m05_math", "SELECT p_partkey, round(sqrt(p_retailprice), 4) AS a, round(sin(radians(p_size)), 4) AS b, round(ln(1 + p_size), 4) AS c, abs(p_size - 25)::INT AS d FROM part")
def m05(t):
    s = F.col("p_size")
    return t("part").select("p_partkey", r4(F.sqrt("p_retailprice")).alias("a"), r4(F.sin(F.radians(s))).alias("b"), r4(F.log1p(s)).alias("c"), F.abs(s - 25).alias("d"))


@query("m06_rounded", "SELECT o_orderkey, round(o_totalprice, 1) AS r1, round(o_totalprice / 7, 3) AS r3 FROM orders")
def m06(t):
    return t("orders").select("o_orderkey", F.round("o_totalprice", 1).alias("r1"), F.round(F.col("o_totalprice") / 7, 3).alias("r3"))


@query("m07_display_decimals", """
SELECT p_partkey, CASE WHEN i > 1 THEN CASE WHEN right(s, 1) = '0' THEN CASE WHEN width > 10 THEN 0 ELSE 2 END ELSE 1 END WHEN length(s) - i - 1 > 3 THEN 3 ELSE 2 END::INT AS decimals, 0 AS whole
FROM (SELECT p_partkey, v::VARCHAR AS s, length(trunc(v)::BIGINT::VARCHAR) AS i, trunc(p_size - 20.0)::BIGINT AS width
  FROM (SELECT p_partkey, p_size, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice WHEN p_partkey % 3 = 1 THEN p_size / 64.0::DOUBLE ELSE p_size::DOUBLE END AS v FROM part))""")
def m07(t):
    key, size = F.col("p_partkey"), F.col("p_size").cast("double")
    v = F.when(key % 3 == 0, F.col("p_retailprice")).when(key % 3 == 1, size / 64).otherwise(size)
    return t("part").select("p_partkey", fn.display_decimals(v, F.lit(20.0), size).alias("decimals"), fn.display_decimals(F.col("p_size"), F.lit(0), F.lit(0), whole=True).alias("whole"))


@query("x05_half_width", "SELECT p_partkey, p_size::VARCHAR AS size FROM part")
def x05(t):
    return t("part").select("p_partkey", fn.half_width_digits(F.translate(F.col("p_size").cast("string"), "0123456789", "０１２３４５６７８９")).alias("size"))


@query("x08_primary_label", "SELECT p_partkey, CASE WHEN contains(w, 'TIN') THEN 'tin' WHEN contains(w, 'S') THEN 's' ELSE 'other' END AS label FROM (SELECT p_partkey, string_split(p_type || '、' || p_brand, '、')[1] AS w FROM part)")
def x08(t):
    first = F.split(F.concat_ws("、", "p_type", "p_brand"), "、")[0]
    return t("part").select("p_partkey", fn.first_label(first, [("TIN", "tin"), ("S", "s")]).alias("label"))


@query("x09_ward", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE '港' END AS ward FROM nation")
def x09(t):
    text = F.when(F.col("n_nationkey") % 2 == 0, F.concat("n_name", F.lit("区x"))).otherwise(F.col("n_name"))
    return t("nation").select("n_nationkey", fn.ward(text).alias("ward"))


@query("v01_exploded", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def v01(t):
    return t("part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))


@query("v02_top_values_text", "SELECT string_agg(o_orderpriority, ',' ORDER BY n DESC, o_orderpriority) AS top FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3)")
def v02(t):
    top = assemble.top_values(t("orders"), "o_orderpriority", 3)
    return top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "o_orderpriority"))), lambda x: x["o_orderpriority"]), ",").alias("top"))


@query("v04_json_fields", "SELECT event_id, nullif(json_extract_string(props, '$.k'), '') AS k FROM events")
def v04(t):
    return t("events").select("event_id", F.nullif(F.get_json_object("props", "$.k"), F.lit("")).alias("k"))


# ---- folds, registry ---------------------------------------------------------------------------------------------------------
@query("s_f4_folds_by_population", "SELECT c_custkey, ((row_number() OVER (PARTITION BY c_nationkey ORDER BY md5(c_custkey::VARCHAR || '|1208'), c_custkey) - 1) % 4 + 1)::INT AS valid_no FROM customer")
def sf4(t):
    return folds.folds(t("customer"), "c_custkey", 4, ["c_nationkey"]).select("c_custkey", "valid_no")


@query("s_f6_shuffled_split", "SELECT p_partkey, (((row_number() OVER (ORDER BY md5(p_partkey::VARCHAR || '|1208'), p_partkey) - 1) % 5) = 0)::INT AS is_valid FROM part")
def sf6(t):
    return folds.holdout(t("part"), "p_partkey").select("p_partkey", "is_valid")


@query("f04_not_containing", f"SELECT feature FROM {IMPORTANCE} WHERE NOT contains(feature, '1') AND NOT contains(feature, '5')")
def f04(t):
    return assemble.not_containing(_registry(t), ["1", "5"]).select("feature")


@query("f05_first_per_combination", f"SELECT x, y, min(feature) AS feature FROM {IMPORTANCE}, (SELECT unnest(['1', '2']) AS x), (SELECT unnest(['4', '6']) AS y) WHERE contains(feature, x) AND contains(feature, y) AND contains(feature, '9') GROUP BY 1, 2")
def f05(t):
    return assemble.first_per_combination(["1", "2"], ["4", "6"], _registry(t).select("feature"), "9")


@query("f06_correlation_groups")
def f06(t):
    pairs = profile.correlations(t("lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    groups = assemble.correlation_groups(pairs, 2)
    return t.spark.createDataFrame([(i, f) for i, g in enumerate(groups) for f in g], "group_no int, feature string")


@query("f07_random_decrease")
def f07(t):
    tried = models.random_decrease(_model_rows(t), "c_custkey", "target", "valid_no", FEATURES, 1, 2)
    return t.spark.createDataFrame([(s, ",".join(c)) for s, c in tried], "score double, features string")


@query("f08_forward_selection")
def f08(t):
    kept, score = models.forward_selection(_model_rows(t), "c_custkey", "target", "valid_no", ["total"], ["n"])
    return t.spark.createDataFrame([(score, ",".join(kept))], "score double, features string")


# ---- models -------------------------------------------------------------------------------------------------------------------
def _regression_rows(t):
    return _model_rows(t).withColumn("y", F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")))


@query("ml02_regressors")
def ml02(t):
    kinds = ("linear", "ridge", "lasso")
    rows = [(k, models.cross_validate(_regression_rows(t), "c_custkey", "y", "valid_no", FEATURES, k).mean) for k in kinds]
    return t.spark.createDataFrame(rows, "model string, score double")


@query("ml06_time_prediction")
def ml06(t):
    rows = t("orders").select("o_orderkey", "o_totalprice", F.col("o_custkey").cast("double").alias("c"), (F.col("o_orderdate") >= "2000-01-01").cast("int").alias("val_label"))
    return models.time_predict(rows, "o_orderkey", "o_totalprice", ["c"])


@query("ml09_importance")
def ml09(t):
    return models.cross_validate(_model_rows(t), "c_custkey", "target", "valid_no", FEATURES, "forest", numTrees=5, maxDepth=3).importance


@query("ml11_seed_average")
def ml11(t):
    return models.seed_average(_model_rows(t), "c_custkey", "target", "valid_no", FEATURES, "forest", [1, 2], numTrees=3, maxDepth=3)


@query("ml12_model_imputation")
def ml12(t):
    rows = t("lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("key"), F.expr("CASE WHEN l_linenumber <> 2 THEN l_extendedprice END").alias("price"), "l_quantity", (F.col("l_orderkey") % 2).cast("int").alias("fold"))
    return models.impute_by_model(rows, "key", "price", ["l_quantity"], "fold")


@query("ml13_grid_search")
def ml13(t):
    found = models.grid_search(_model_rows(t), "c_custkey", "target", "valid_no", FEATURES, "logistic", [{"regParam": 0.0}, {"regParam": 0.1}])
    return t.spark.createDataFrame([(s, str(p)) for s, p in found], "score double, parameters string")


@query("ml14_random_search")
def ml14(t):
    found = models.random_search(_model_rows(t), "c_custkey", "target", "valid_no", FEATURES, "logistic", {"regParam": (0.0, 0.5)}, 2)
    return t.spark.createDataFrame([(s, str(p)) for s, p in found], "score double, parameters string")


@query("ml17_factorisation_machine")
def ml17(t):
    return models.train_predict(_model_rows(t), "c_custkey", "target", ["c_nationkey"], "fm", maxIter=5)


@query("ml18_network")
def ml18(t):
    return models.train_predict(_model_rows(t), "c_custkey", "target", ["c_nationkey"], "network", layers=[2, 4, 2], maxIter=5)


@query("ml19_prediction_report", f"SELECT c_custkey, round(p * 2 + 5, 4) AS prediction, round(p * 2 + 5 - (y * 2 + 5), 4) AS diff FROM {PRED}")
def ml19(t):
    p = _predictions(t).select("c_custkey", (F.col("p") * 2 + 5).alias("prediction"), (F.col("y") * 2 + 5).alias("target"))
    out = assemble.compare_predictions(p.select("c_custkey", "prediction"), p.select("c_custkey", "target"), "c_custkey")
    return rounded(out.select("c_custkey", "prediction", "diff"))


@query("ml10_calibrated_auc_by_group", f"SELECT k::BIGINT AS k, round(auc, 4) AS auc FROM (SELECT k, sum(p * (below + (n - p) / 2)) / (sum(p) * sum(n - p)) AS auc FROM (SELECT *, coalesce(sum(n - p) OVER (PARTITION BY k ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT c_custkey % 3 AS k, p AS s, sum(y) AS p, count(*) AS n FROM {PRED} GROUP BY 1, 2)) GROUP BY k)")
def ml10_groups(t):
    return rounded(metrics.auc(_predictions(t).withColumn("k", F.col("c_custkey") % 3), "y", "p", ["k"]))


@query("e03_one_hot_by_values", "SELECT c_custkey, (c_mktsegment = 'BUILDING')::INT AS ohe_c_mktsegment_BUILDING FROM customer")
def e03_values(t):
    return encode.one_hot(t("customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", ["BUILDING"], prefix="ohe_")
