"""Queries: joins, aggregates, windows, scalar functions, encodings, folds, registry, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as fn
from ..operators import aggregate, assemble, cleanse, encode, folds, metrics, profile, series
from .catalog import half_up, query, r4, rounded
from .tables_and_quality import BASE, FOLDED, _customers, _gaps

ORDER_METHODS = ("sum", "mean", "var", "max", "min", "count")
SQL_OF = {"sum": "sum({c})", "mean": "avg({c})", "var": "var_samp({c})", "max": "max({c})", "min": "min({c})", "count": "count({c})", "std": "stddev_samp({c})", "median": "median({c})", "skew": "CASE WHEN stddev_pop({c}) > 0 THEN skewness({c}) END"}


def _sql_agg(column: str, methods, form: str = "{c}_{m}", cond: str = "") -> str:
    return ", ".join(f"round({SQL_OF[m].format(c=column)}{cond}, 4)::DOUBLE AS {form.format(c=column, m=m)}" if m != "count" else f"{SQL_OF[m].format(c=column)} AS {form.format(c=column, m=m)}" for m in methods)


def _plain(df, key):
    """Names without the level, which SQL cannot carry bare."""
    return df.select(key, *[F.col(f"`{c}`").alias(c.split("@")[0]) for c in df.columns if c != key])


@query("a01_base_aggregation", f"SELECT c_custkey, {_sql_agg('o_totalprice', ORDER_METHODS)} FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey".replace("count(o_totalprice)", "nullif(count(o_totalprice), 0)").replace("round(var_samp(o_totalprice), 4)", "round(var_samp(o_totalprice) / 1e6, 4)"))
def a01(t):
    child = t("orders").withColumnRenamed("o_custkey", "c_custkey")
    out = _plain(aggregate.base_aggregation(t("customer").select("c_custkey"), child, "c_custkey", ["o_totalprice"], ORDER_METHODS), "c_custkey")
    return rounded(out.withColumn("o_totalprice_var", F.col("o_totalprice_var") / 1e6))  # in millions: a double has no more digits


@query("a02_many_columns", "SELECT l_partkey, " + ", ".join(_sql_agg(c, ("sum", "mean", "max", "min", "std")) for c in ("l_quantity", "l_extendedprice", "l_discount")) + " FROM lineitem GROUP BY 1")
def a02(t):
    return rounded(_plain(aggregate.aggregate(t("lineitem"), "l_partkey", ["l_quantity", "l_extendedprice", "l_discount"], ["sum", "mean", "max", "min", "std"]), "l_partkey"))


@query("a03_category_aggregation", "SELECT o_custkey, " + ", ".join(f"round(sum(o_totalprice) FILTER (o_orderstatus = '{s}'), 4) AS o_totalprice_{s}_sum, round(avg(o_totalprice) FILTER (o_orderstatus = '{s}'), 4) AS o_totalprice_{s}_mean" for s in "FO") + " FROM orders GROUP BY 1")
def a03(t):
    return rounded(aggregate.category_aggregation(t("orders"), "o_custkey", "o_orderstatus", ["F", "O"], "o_totalprice", ["sum", "mean"]))


@query("a04_category_shares", "SELECT o_custkey, " + ", ".join(f"round(avg((o_orderstatus = '{s}')::INT), 4) AS o_orderstatus_{s}_mean" for s in "FOP") + " FROM orders GROUP BY 1")
def a04(t):
    return rounded(aggregate.category_shares(t("orders"), "o_custkey", "o_orderstatus", ["F", "O", "P"]))


@query("a05_count_encode_aggregate", "WITH c AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1) SELECT o_custkey, round(avg(n), 4) AS n_mean, max(n) AS n_max FROM orders JOIN c USING (o_orderpriority) GROUP BY 1")
def a05(t):
    coded = encode.count_encode(t("orders").select("o_custkey", "o_orderpriority"), "o_orderpriority")
    return coded.groupBy("o_custkey").agg(r4(F.avg("cnt_o_orderpriority")).alias("n_mean"), F.max("cnt_o_orderpriority").alias("n_max"))


@query("a06_label_encode_aggregate", "WITH c AS (SELECT o_orderpriority, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS code FROM (SELECT DISTINCT o_orderpriority FROM orders)) SELECT o_custkey, round(avg(code), 4) AS code_mean, max(code)::INT AS code_max FROM orders JOIN c USING (o_orderpriority) GROUP BY 1")
def a06(t):
    coded = encode.label_encode(t("orders").select("o_custkey", "o_orderpriority"), "o_orderpriority")
    return coded.groupBy("o_custkey").agg(r4(F.avg("o_orderpriority_code")).alias("code_mean"), F.max("o_orderpriority_code").alias("code_max"))


SEVEN = ("min", "mean", "median", "max", "count", "std", "skew")
EVENTS = "(SELECT *, isodow(ts) - 1 AS dow FROM events)"
# Sums of amounts in cents are exact, so the quotient of sum and count is the same double in every order of summation.
CENTS = "sum(value::DECIMAL(18, 2))"


@query("a07_trailing_stats", f"SELECT user_id, {_sql_agg('value', [m for m in SEVEN if m != 'mean'])}, {CENTS}::DOUBLE / count(value) AS value_mean FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-22' GROUP BY 1")
def a07(t):
    return rounded(aggregate.trailing(t("events"), ["user_id"], "ts", "value", "2024-01-08", "2024-01-22", decimals=2), "value_mean")


@query("a08_weekday_stats", f"SELECT event_type, dow::INT AS dow, {_sql_agg('value', SEVEN)} FROM {EVENTS} WHERE ts > TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-22' GROUP BY 1, 2")
def a08(t):
    return rounded(aggregate.trailing(t("events").withColumn("dow", F.weekday("ts")), ["event_type", "dow"], "ts", "value", "2024-01-08", "2024-01-22", inclusive=False))


DAYS = "(DATE '2024-01-31' - ts::DATE)"


@query("a09_decayed_mean", f"SELECT user_id, round(sum(value * pow(0.985, {DAYS})) / sum(pow(0.985, {DAYS})), 4) AS exp_0 FROM events GROUP BY 1")
def a09(t):
    return rounded(aggregate.decayed_means(t("events"), ["user_id"], "ts", "value", "2024-01-31", [0.985]))


@query("a10_many_decays", f"SELECT event_type, round(sum(value * pow(0.99, {DAYS})) / sum(pow(0.99, {DAYS})), 4) AS exp_0, round(sum(value * pow(0.99, {DAYS})) / sum(pow(0.99, {DAYS})), 4) AS exp2_0, round(sum(value * pow(0.95, {DAYS})) / sum(pow(0.95, {DAYS})), 4) AS exp_1, round(sum(value * pow(0.99 * 0.95, {DAYS})) / sum(pow(0.95, {DAYS})), 4) AS exp2_1 FROM events GROUP BY 1")
def a10(t):
    return rounded(aggregate.decayed_means(t("events"), ["event_type"], "ts", "value", "2024-01-31", [0.99, 0.95], compound=True))


DAILY = "SELECT event_type, ts::DATE AS day, sum(value) AS v FROM events GROUP BY 1, 2"


def _daily(t):
    return t("events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"))


@query("a11_difference_stats", f"SELECT event_type, round(avg(abs(d)), 4) AS diff_mean, round(stddev_samp(d), 4) AS diff_std, round(max(d), 4) AS diff_max, round(min(d), 4) AS diff_min FROM (SELECT event_type, CASE WHEN day - lag(day) OVER w = 1 THEN v - lag(v) OVER w END AS d FROM ({DAILY}) WINDOW w AS (PARTITION BY event_type ORDER BY day)) GROUP BY 1")
def a11(t):
    return rounded(aggregate.difference_stats(_daily(t), "event_type", "day", "v"))


@query("a13_pivot_counts", "SELECT ts::DATE AS day, " + ", ".join(f"count(*) FILTER (event_type = '{e}') AS {e}" for e in ("click", "view", "purchase")) + " FROM events GROUP BY 1")
def a13(t):
    return aggregate.pivot(t("events").withColumn("day", F.to_date("ts")), "day", "event_type", ["click", "view", "purchase"], [F.count("event_id")], 0)


@query("a14_pivot_mean", "SELECT l_returnflag, round(avg(l_tax) FILTER (l_linestatus = 'F'), 4) AS F, round(avg(l_tax) FILTER (l_linestatus = 'O'), 4) AS O FROM lineitem GROUP BY 1")
def a14(t):
    return rounded(aggregate.pivot(t("lineitem"), "l_returnflag", "l_linestatus", ["F", "O"], [F.avg("l_tax")]))


@query("a15_distinct_counts", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(*) AS n FROM lineitem GROUP BY 1")
def a15(t):
    return t("lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"), F.count("*").alias("n"))


@query("a16_label_frequencies", "WITH p AS (SELECT DISTINCT p_partkey, unnest(string_split(p_type || ' ' || p_brand, ' ')) AS part FROM part), c AS (SELECT part, count(*) AS n FROM p GROUP BY 1) SELECT p_partkey, count(*) AS n_parts, sum(n)::BIGINT AS frequency FROM p JOIN c USING (part) GROUP BY 1")
def a16(t):
    return aggregate.label_frequencies(t("part").withColumn("l", F.concat_ws(" ", "p_type", "p_brand")), "p_partkey", "l", " ")


PRED = "(SELECT c_custkey, (c_acctbal < 3000)::INT AS y, round(0.5 - (c_acctbal - 4500) / 20000 + (c_nationkey - 12) / 50.0, 2) AS p, round(c_nationkey / 25.0, 2) AS q FROM customer)"


def _predictions(t):
    c = t("customer")
    return c.select("c_custkey", (F.col("c_acctbal") < 3000).cast("int").alias("y"), half_up(0.5 - (F.col("c_acctbal") - 4500) / 20000 + (F.col("c_nationkey") - 12) / 50.0, 2).alias("p"), half_up(F.col("c_nationkey") / 25.0, 2).alias("q"))


@query("a17_error_metrics", f"SELECT round(avg((y - p) * (y - p)), 4) AS mse, round(avg(abs(y - p)), 4) AS mae, round(1 - (sum((y - p) * (y - p)) / (count(*) - 4)) / (var_pop(y) * count(*) / (count(*) - 1)), 4) AS adjusted_r2 FROM {PRED}")
def a17(t):
    return rounded(aggregate.error_metrics(_predictions(t), "y", "p", 3))


@query("a19_collected_lists", "SELECT n_regionkey, list_sort(list(n_name)) AS names FROM nation GROUP BY 1")
def a19(t):
    return t("nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("names"))


@query("j02_inner_join", "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def j02(t):
    return t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment")


@query("j04_feature_matrix", "WITH a AS (SELECT o_custkey AS k, sum(o_totalprice) AS s FROM orders GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT c_custkey, round(s, 2) AS s, n FROM customer LEFT JOIN a ON c_custkey = a.k LEFT JOIN b ON c_custkey = b.k")
def j04(t):
    o = t("orders").withColumnRenamed("o_custkey", "c_custkey")
    a = o.groupBy("c_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("s"))
    b = o.filter("o_orderstatus = 'F'").groupBy("c_custkey").agg(F.count("*").alias("n"))
    return assemble.feature_matrix(t("customer").select("c_custkey"), [a, b], "c_custkey")


@query("j05_stacked_predictions", f"SELECT a.c_custkey, a.p AS oof_one, b.q AS oof_two FROM {PRED} a LEFT JOIN (SELECT * FROM {PRED} WHERE c_custkey % 2 = 0) b USING (c_custkey)")
def j05(t):
    p = _predictions(t)
    return assemble.stack_predictions({"one": p.withColumn("prediction", F.col("p")), "two": p.filter("c_custkey % 2 = 0").withColumn("prediction", F.col("q"))}, "c_custkey")


@query("j06_nearest", "SELECT p_brand, p_partkey, p_retailprice FROM part JOIN (SELECT p_brand, min(p_retailprice) AS m FROM part GROUP BY 1) USING (p_brand) WHERE p_retailprice = m")
def j06(t):
    return assemble.nearest(t("part").select("p_brand", "p_partkey", "p_retailprice"), "p_brand", "p_retailprice")


@query("j07_lookup", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def j07(t):
    n = assemble.lookup(t("nation").withColumnRenamed("n_regionkey", "r_regionkey"), t("region"), "r_regionkey").withColumnRenamed("n_nationkey", "c_nationkey")
    return assemble.lookup(t("customer"), n, "c_nationkey").select("c_custkey", "n_name", "r_name")


@query("j08_reindexed", "SELECT event_id, CASE WHEN event_type <> 'click' THEN value END AS value FROM events")
def j08(t):
    return assemble.reindexed(t("events"), "value", F.col("event_type") != "click").select("event_id", "value")


@query("j09_compared", f"SELECT c_custkey, round(p - y, 4) AS diff FROM {PRED}")
def j09(t):
    p = _predictions(t)
    out = assemble.compare_predictions(p.select("c_custkey", F.col("p").alias("prediction")), p.select("c_custkey", F.col("y").alias("target")), "c_custkey")
    return out.select("c_custkey", r4("diff").alias("diff"))


@query("j12_incremental_load", "SELECT p_partkey FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_size < 20)")
def j12(t):
    p = t("part")
    return assemble.new_rows(p, p.filter("p_size < 20").select("p_name").distinct(), "p_name").select("p_partkey")


@query("t01_row_number", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INT AS row_no FROM orders")
def t01(t):
    return series.row_number(t("orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_orderkey", "row_no")


@query("t02_lag", "SELECT o_orderkey, lag(o_totalprice) OVER w AS back, lead(o_totalprice, 2) OVER w AS ahead FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def t02(t):
    args = (["o_custkey"], ["o_orderdate", "o_orderkey"])
    df = series.lag_feature(series.lag_feature(t("orders"), "o_totalprice", 1, *args), "o_totalprice", -2, *args)
    return df.select("o_orderkey", F.col("`shift1_o_totalprice@o_custkey`").alias("back"), F.col("`shift-2_o_totalprice@o_custkey`").alias("ahead"))


@query("t03_moving_average", "SELECT event_id, CASE WHEN count(value) OVER w >= 3 THEN round(avg(value) OVER w, 4) END AS mv FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 6 PRECEDING)")
def t03(t):
    return series.moving(t("events"), "avg", ["user_id"], ["ts", "event_id"], "value", 7, 3).select("event_id", r4("`value_mv_avg_w7_p3@user_id`").alias("mv"))


@query("t04_weighted_average", "WITH m AS (SELECT max(ts)::DATE AS last FROM events), v AS (SELECT user_id, CASE WHEN event_id % 6 = 0 THEN NULL ELSE value END AS v, pow(0.9, last - ts::DATE) AS w FROM events, m) SELECT user_id, round(sum(v * w) / sum(w) FILTER (v IS NOT NULL), 4) AS wg FROM v GROUP BY 1")
def t04(t):
    e = t("events").withColumn("value", F.expr("CASE WHEN event_id % 6 <> 0 THEN value END"))
    return series.weighted_average(e, ["user_id"], "value", 0.9, "ts").select("user_id", r4("`value_wg0.9_avg@user_id`").alias("wg"))


@query("t05_lagged_weighted_average", f"WITH d AS ({DAILY}) SELECT a.event_type, a.day, round(sum(b.v * pow(0.9, a.day - b.day)) / sum(pow(0.9, a.day - b.day)), 4) AS wg FROM d a LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) AS n FROM d) b ON a.event_type = b.event_type AND b.n <= (SELECT count(*) FROM d c WHERE c.event_type = a.event_type AND c.day <= a.day) - 2 GROUP BY 1, 2")
def t05(t):
    return series.lagged_weighted_average(_daily(t), ["event_type"], "v", 0.9, "day", 2).select("event_type", "day", r4("`v_wg0.9_lag2`").alias("wg"))


@query("t09_time_holdout", "SELECT event_id, (ts >= TIMESTAMP '2024-01-20')::INT AS val_label FROM events")
def t09(t):
    return series.time_holdout(t("events"), "ts", "2024-01-20").select("event_id", "val_label")


@query("k02_top_categories", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 30")
def k02(t):
    return assemble.top_values(t("orders"), "o_custkey", 30)


@query("k03_counts_of_top", "WITH top AS (SELECT l_partkey FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10) SELECT l_partkey, l_returnflag, count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT * FROM top) GROUP BY 1, 2")
def k03(t):
    li = t("lineitem")
    return li.join(assemble.top_values(li, "l_partkey", 10), "l_partkey", "left_semi").groupBy("l_partkey", "l_returnflag").agg(F.count("*").alias("n"))


IMPORTANCE = "(SELECT p_name || '_' || p_partkey AS feature, p_retailprice AS importance, p_brand FROM part)"


def _importance(t):
    return t("part").select(F.concat_ws("_", "p_name", "p_partkey").alias("feature"), F.col("p_retailprice").alias("importance"), "p_brand")


@query("k05_select_features", f"SELECT feature FROM (SELECT *, row_number() OVER (ORDER BY importance DESC, feature) AS rank FROM {IMPORTANCE}) WHERE rank <= 100 AND importance >= 950")
def k05(t):
    return assemble.select_features(assemble.ranked(_importance(t)), 100, 950.0).select("feature")


@query("t06_ranked_features", f"SELECT feature, row_number() OVER (ORDER BY importance DESC, feature)::INT AS rank FROM {IMPORTANCE}")
def t06(t):
    return assemble.ranked(_importance(t)).select("feature", "rank")


@query("u01_union_by_name", "SELECT c_custkey AS key, c_acctbal AS balance, NULL::VARCHAR AS s_name FROM customer UNION ALL SELECT s_suppkey, s_acctbal, s_name FROM supplier")
def u01(t):
    a = t("customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"))
    return assemble.union_all([a, t("supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"), "s_name")])


@query("u03_difference", "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def u03(t):
    o = t("orders")
    return o.filter("o_orderstatus = 'F'").select("o_custkey").subtract(o.filter("o_orderstatus = 'P'").select("o_custkey"))


@query("m01_arithmetic", "SELECT l_orderkey, l_linenumber, round(l_extendedprice - l_quantity, 4) AS d, round(l_extendedprice / (l_quantity + 1e5), 6) AS q, round(l_extendedprice * l_quantity, 2) AS p FROM lineitem")
def m01(t):
    a, b = F.col("l_extendedprice"), F.col("l_quantity")
    return t("lineitem").select("l_orderkey", "l_linenumber", r4(fn.difference(a, b)).alias("d"), F.round(fn.damped_ratio(a, b), 6).alias("q"), F.round(fn.product(a, b), 2).alias("p"))


@query("m04_pairs", "SELECT l_orderkey, l_linenumber, " + ", ".join(f"round({a} - {b}, 4) AS {a}_diff_{b}, round({a} * {b}, 4) AS {a}_pro_{b}" for a, b in (("l_quantity", "l_discount"), ("l_quantity", "l_tax"), ("l_discount", "l_tax"))) + " FROM lineitem")
def m04(t):
    names = ["l_quantity", "l_discount", "l_tax"]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    made = [x for a, b in pairs for x in (r4(fn.difference(F.col(a), F.col(b))).alias(f"{a}_diff_{b}"), r4(fn.product(F.col(a), F.col(b))).alias(f"{a}_pro_{b}"))]
    return t("lineitem").select("l_orderkey", "l_linenumber", *made)


PLACE = "(SELECT c_custkey, 139 + c_nationkey / 100.0 AS lon, 35 + c_acctbal / 100000 AS lat FROM customer)"


@query(
    "g01_distances",
    f"""SELECT c_custkey, round(2 * 6378137 * asin(sqrt(pow(sin(radians(35.7 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(35.7)) * pow(sin(radians(139.7 - lon) / 2), 2))), 2) AS haversine_m,
    round(6378.137 * acos(greatest(-1, least(1, sin(radians(lat)) * sin(radians(35.7)) + cos(radians(lat)) * cos(radians(35.7)) * cos(radians(139.7 - lon))))), 3) AS cosine_km,
    round(CASE WHEN a < 0 THEN a + 360 ELSE a END, 4) AS azimuth FROM (SELECT *, degrees(atan2(sin(radians(139.7 - lon)), cos(radians(lat)) * tan(radians(35.7)) - sin(radians(lat)) * cos(radians(139.7 - lon)))) AS a FROM {PLACE})""",
)
def g01(t):
    lon, lat, lon2, lat2 = 139 + F.col("c_nationkey") / 100.0, 35 + F.col("c_acctbal") / 100000, F.lit(139.7), F.lit(35.7)
    return t("customer").select("c_custkey", F.round(fn.haversine_m(lon, lat, lon2, lat2), 2).alias("haversine_m"), F.round(fn.cosine_law_km(lon, lat, lon2, lat2), 3).alias("cosine_km"), r4(fn.azimuth_deg(lon, lat, lon2, lat2)).alias("azimuth"))


@query("x01_safe_values", "SELECT page_id, replace(translate(url, '/().', '___-'), '\"', '') AS safe, translate(replace(url, '\"', ''), '/: .', '____') AS file FROM pages")
def x01(t):
    return t("pages").select("page_id", F.replace(fn.safe_value(F.col("url")), F.lit('"'), F.lit("")).alias("safe"), fn.file_value(F.col("url")).alias("file"))


@query("x04_strip_literals", "SELECT p_partkey, replace(replace(replace(replace(replace('[''' || p_name || ' -2'']', ' ', ''), '[', ''), ']', ''), '''', ''), '-2', '0') AS bare FROM part")
def x04(t):
    return t("part").select("p_partkey", fn.strip_literal(F.concat(F.lit("['"), "p_name", F.lit(" -2']"))).alias("bare"))


@query("x06_fixed_list", "SELECT p_partkey, CASE WHEN len(string_split(p_type || '-' || p_brand, '-')) > 3 THEN ['0', '0', '0'] ELSE list_resize(string_split(p_type || '-' || p_brand, '-'), 3, '0') END AS parts FROM part")
def x06(t):
    return t("part").select("p_partkey", fn.fixed_list(F.concat_ws("-", "p_type", "p_brand"), "-").alias("parts"))


@query("x07_first_label", "SELECT p_partkey, CASE WHEN contains(p_type, 'STEEL') THEN 'metal' WHEN contains(p_type, 'A') THEN 'with a' ELSE 'other' END AS label FROM part")
def x07(t):
    return t("part").select("p_partkey", fn.first_label(F.col("p_type"), [("STEEL", "metal"), ("A", "with a")]).alias("label"))


@query("x10_html_fields", "SELECT page_id, nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '') AS title, nullif(trim(regexp_extract(html, 'href=\"([^\"]*)\"', 1)), '') AS link, contains(html, '<table')::INT AS has_table FROM pages")
def x10(t):
    fields = fn.pattern_fields(F.col("html"), {"title": "<title>([^<]*)</title>", "link": 'href="([^"]*)"'})
    return t("pages").select("page_id", *fields, F.col("html").contains("<table").cast("int").alias("has_table"))


@query("x11_page_lists", "SELECT page_id, url || '/list/' || n || '/' AS page FROM pages, range(1, 6) r(n)")
def x11(t):
    url = F.when(F.col("page_id") % 2 == 0, F.concat("url", F.lit("/list/3/?x=1"))).otherwise(F.col("url"))
    return t("pages").select("page_id", F.explode(fn.page_list(url, 5)).alias("page"))


@query("x12_key_groups", f"SELECT feature FROM {IMPORTANCE} WHERE (contains(feature, '1') AND contains(feature, '7')) OR contains(feature, '99')")
def x12(t):
    return _importance(t).filter(fn.contains_groups(F.col("feature"), [["1", "7"], ["99"]])).select("feature")


@query("d01_day_difference", "SELECT o_orderkey, floor(epoch(o_orderdate - TIMESTAMP '1997-01-01 12:00:00') / 86400)::BIGINT AS days, epoch(o_orderdate - TIMESTAMP '1997-01-01 12:00:00')::BIGINT AS seconds FROM orders")
def d01(t):
    at = F.to_timestamp(F.lit("1997-01-01 12:00:00"))
    return t("orders").select("o_orderkey", fn.days_between(F.col("o_orderdate"), at).alias("days"), fn.seconds_between(F.col("o_orderdate"), at).alias("seconds"))


@query("d03_add_days_hours", "SELECT o_orderkey, strftime(o_orderdate + INTERVAL 10 DAY, '%Y%m%d') AS day, strftime(o_orderdate + INTERVAL 30 HOUR, '%Y-%m-%d-%H') AS hour FROM orders")
def d03(t):
    return t("orders").select("o_orderkey", fn.add_days_text(F.col("o_orderdate"), 10).alias("day"), fn.add_hours_text(F.col("o_orderdate"), 30).alias("hour"))


@query("d05_opening_age", "SELECT o_orderkey, DATE '2020-01-01' - date_trunc('month', o_orderdate)::DATE AS age FROM orders")
def d05(t):
    text = F.translate(F.date_format("o_orderdate", "yyyy年M月d日"), "0123456789", "０１２３４５６７８９")
    return t("orders").select("o_orderkey", F.datediff(F.lit("2020-01-01"), fn.japanese_month(text)).cast("long").alias("age"))


@query("v03_category_maps", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def v03(t):
    counts = t("events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    text = counts.groupBy("user_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("event_type", "n")))).alias("j"))
    return text.select("user_id", F.explode(F.from_json("j", "map<string,bigint>")).alias("event_type", "n"))


@query("v05_similar_vectors", "WITH w AS (SELECT user_id AS doc_id, event_type AS category, count(*)::DOUBLE AS w FROM events GROUP BY 1, 2), n AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1) SELECT doc_id, round(w / norm, 4) AS similarity FROM w JOIN n USING (doc_id) WHERE category = 'click' ORDER BY w / norm DESC, doc_id LIMIT 10")
def v05(t):
    counts = t("events").groupBy("user_id", "event_type").agg(F.count("*").cast("double").alias("w"))
    vectors = counts.groupBy(F.col("user_id").alias("doc_id")).agg(F.map_from_entries(F.collect_list(F.struct("event_type", "w"))).alias("categories"))
    q = t.spark.createDataFrame([("click", 1.0)], "category string, weight double")
    return rounded(assemble.similar(vectors, q, 10))


@query("e01_label_encode", "SELECT p_partkey, (dense_rank() OVER (ORDER BY p_brand) - 1)::INT AS p_brand_code FROM part")
def e01(t):
    return encode.label_encode(t("part").select("p_partkey", "p_brand"), "p_brand").drop("p_brand")


@query("e02_ordinal_codes", "SELECT p_type AS value, row_number() OVER (ORDER BY min(p_partkey))::INT AS code FROM part GROUP BY p_type")
def e02(t):
    return encode.ordinal_codes(t("part"), "p_type", ["p_partkey"])


@query("e03_one_hot", "SELECT o_orderkey, " + ", ".join(f"(o_orderstatus = '{s}')::INT AS dummie_o_orderstatus_{s}" for s in "FOP") + " FROM orders")
def e03(t):
    return encode.one_hot(t("orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus")


@query("e04_count_encode", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand) AS cnt_p_brand FROM part")
def e04(t):
    return encode.count_encode(t("part").select("p_partkey", "p_brand"), "p_brand")


@query(
    "e05_target_encoding",
    f"""WITH f AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 5 <> 0 THEN (c_acctbal < 3000)::INT END AS target, valid_no FROM ({FOLDED})),
    tr AS (SELECT * FROM f WHERE target IS NOT NULL),
    s AS (SELECT c_nationkey, valid_no, sum(target) AS s, count(*) AS n FROM tr GROUP BY 1, 2), a AS (SELECT c_nationkey, sum(s) AS s, sum(n) AS n FROM s GROUP BY 1)
    SELECT c_custkey, round((a.s - coalesce(s.s, 0)) / nullif(a.n - coalesce(s.n, 0), 0), 4)::DOUBLE AS te FROM f LEFT JOIN a USING (c_nationkey) LEFT JOIN s ON f.c_nationkey = s.c_nationkey AND s.valid_no = CASE WHEN f.target IS NOT NULL THEN f.valid_no END""",
)
def e05(t):
    df = folds.folds(_customers(t), "c_custkey", 5, ["c_mktsegment"]).withColumn("valid_no", F.when(F.col("target").isNotNull(), F.col("valid_no")))
    return encode.target_encode(df, ["c_nationkey"], "target", "valid_no").select("c_custkey", r4("`TE_target@c_nationkey`").alias("te"))


@query("e06_target_bins", f"WITH m AS (SELECT c_nationkey, avg(target) AS m FROM {BASE} GROUP BY 1), e AS (SELECT quantile_cont(m, 0.25) AS a, quantile_cont(m, 0.5) AS b, quantile_cont(m, 0.75) AS c FROM m) SELECT c_custkey, (1 + (m > a)::INT + (m > b)::INT + (m > c)::INT)::INT AS bin FROM customer JOIN m USING (c_nationkey), e")
def e06(t):
    return encode.target_bins(_customers(t), "c_nationkey", "target", 4).select("c_custkey", F.col("bin4_c_nationkey").alias("bin"))


@query("e07_numeric_bins", "WITH e AS (SELECT quantile_cont(p_retailprice, 0.25) AS a, quantile_cont(p_retailprice, 0.5) AS b, quantile_cont(p_retailprice, 0.75) AS c FROM part) SELECT p_partkey, (1 + (p_retailprice > a)::INT + (p_retailprice > b)::INT + (p_retailprice > c)::INT)::INT AS bin FROM part, e")
def e07(t):
    return encode.numeric_bins(t("part"), ["p_retailprice"], 4).select("p_partkey", F.col("bin4_p_retailprice").alias("bin"))


@query("e08_crosses", "SELECT l_returnflag || '_' || l_linestatus AS cross_value, count(*) AS n FROM lineitem GROUP BY 1")
def e08(t):
    crossed = encode.crosses(t("lineitem").select("l_returnflag", "l_linestatus"), ["l_returnflag", "l_linestatus"])
    return crossed.groupBy(F.col("l_returnflag_l_linestatus").alias("cross_value")).agg(F.count("*").alias("n"))


@query("s_f1_stratified_folds", f"SELECT c_custkey, valid_no FROM ({FOLDED})")
def sf1(t):
    return folds.folds(t("customer"), "c_custkey", 5, ["c_mktsegment"]).select("c_custkey", "valid_no")


@query("s_f2_holdout", f"SELECT c_custkey, (valid_no = 1)::INT AS is_valid FROM ({FOLDED})")
def sf2(t):
    return folds.holdout(t("customer"), "c_custkey", ["c_mktsegment"]).select("c_custkey", "is_valid")


@query("s_f3_group_folds", "SELECT o_orderkey, (('0x' || substr(md5(o_custkey::VARCHAR || '|1208'), 1, 8))::BIGINT % 5 + 1)::INT AS valid_no FROM orders")
def sf3(t):
    return folds.group_folds(t("orders"), "o_custkey").select("o_orderkey", "valid_no")


@query("s_f5_sampled_rows", "SELECT o_orderkey FROM orders ORDER BY md5(o_orderkey::VARCHAR || '|1208'), o_orderkey LIMIT 500")
def sf5(t):
    return folds.sample_rows(t("orders"), "o_orderkey", 500).select("o_orderkey")


REGISTRY = f"(SELECT feature, 'first_valid' AS tier, p_brand, row_number() OVER (ORDER BY importance DESC, feature) AS rank FROM {IMPORTANCE})"


def _registry(t):
    return _importance(t).select("feature", F.lit("first_valid").alias("tier"))


@query("f01_demote", f"SELECT feature, CASE WHEN rank >= 50 AND contains(feature, '5') THEN 'third_valid' ELSE tier END AS tier FROM {REGISTRY}")
def f01(t):
    return assemble.demote(_registry(t), assemble.ranked(_importance(t)), 50, ["5"])


@query("f02_promote", f"SELECT feature, CASE WHEN rank <= 20 THEN 'winner' ELSE tier END AS tier FROM {REGISTRY}")
def f02(t):
    return assemble.promote(_registry(t), assemble.select_features(assemble.ranked(_importance(t)), 20))


@query("f03_move_named", f"SELECT feature, CASE WHEN contains(feature, '77') THEN 'delete' ELSE tier END AS tier FROM {REGISTRY}")
def f03(t):
    return assemble.move_named(_registry(t), "77", "delete")


@query("q21_parity", f"SELECT feature, CASE WHEN rank % 3 = 0 THEN 'train' ELSE 'test' END AS side FROM {REGISTRY} WHERE (rank % 3 = 0) <> (rank % 2 = 0)")
def q21(t):
    r = assemble.ranked(_importance(t)).select("feature", (F.col("rank") % 3 == 0).alias("has_train"), (F.col("rank") % 2 == 0).alias("has_test"))
    return assemble.parity(r)


@query("f10_gini_split", "WITH v AS (SELECT f, v, count(*) FILTER (y = 0) AS a, count(*) FILTER (y = 1) AS b FROM (SELECT 'c_acctbal' AS f, c_acctbal AS v, (c_nationkey < 9 AND c_acctbal > 2000)::INT AS y FROM customer UNION ALL SELECT 'c_nationkey', c_nationkey, (c_nationkey < 9 AND c_acctbal > 2000)::INT FROM customer) GROUP BY 1, 2), c AS (SELECT f, v, sum(a) OVER w AS l0, sum(b) OVER w AS l1, sum(a) OVER (PARTITION BY f) AS t0, sum(b) OVER (PARTITION BY f) AS t1 FROM v WINDOW w AS (PARTITION BY f ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), g AS (SELECT f, v, l0, l1, t0 - l0 AS r0, t1 - l1 AS r1 FROM c WHERE l0 + l1 > 0 AND t0 + t1 - l0 - l1 > 0) SELECT f AS feature, v::DOUBLE AS threshold, round((l0 + l1) / (l0 + l1 + r0 + r1) * (1 - pow(l0 / (l0 + l1), 2) - pow(l1 / (l0 + l1), 2)) + (r0 + r1) / (l0 + l1 + r0 + r1) * (1 - pow(r0 / (r0 + r1), 2) - pow(r1 / (r0 + r1), 2)), 4) AS impurity FROM g ORDER BY (l0 + l1) / (l0 + l1 + r0 + r1) * (1 - pow(l0 / (l0 + l1), 2) - pow(l1 / (l0 + l1), 2)) + (r0 + r1) / (l0 + l1 + r0 + r1) * (1 - pow(r0 / (r0 + r1), 2) - pow(r1 / (r0 + r1), 2)), f, v LIMIT 1")
def f10(t):
    c = t("customer").withColumn("y", F.expr("CAST(c_nationkey < 9 AND c_acctbal > 2000 AS INT)"))
    return rounded(metrics.best_split(c, ["c_acctbal", "c_nationkey"], "y"))


AUC = "SELECT {by} sum(p * (below + (n - p) / 2)) / (sum(p) * sum(n - p)) AS auc FROM (SELECT *, coalesce(sum(n - p) OVER (PARTITION BY {part} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM ({src}))"


@query("ml07_metrics", f"WITH a AS ({AUC.format(by='', part='1', src=f'SELECT p AS s, sum(y) AS p, count(*) AS n FROM {PRED} GROUP BY 1')}) SELECT round(-avg(y * ln(greatest(1e-15, least(1 - 1e-15, p))) + (1 - y) * ln(1 - greatest(1e-15, least(1 - 1e-15, p)))), 4) AS logloss, round(avg(((p >= 0.5) = (y = 1))::INT), 4) AS accuracy, round(sqrt(avg(pow(y - p, 2))), 4) AS rmse, round(1 - sum(pow(y - p, 2)) / (var_pop(y) * count(*)), 4) AS r2, round((SELECT auc FROM a), 4) AS auc FROM {PRED}")
def ml07(t):
    return rounded(metrics.metrics(_predictions(t), "y", "p"))


@query("ml08_best_f1", f"WITH c AS (SELECT p AS s, sum(y) AS p, count(*) AS n FROM {PRED} GROUP BY 1), k AS (SELECT s AS threshold, sum(p) OVER w AS tp, sum(n - p) OVER w AS fp, sum(p) OVER () - sum(p) OVER w AS fn, sum(n - p) OVER () - sum(n - p) OVER w AS tn FROM c WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING)) SELECT threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, round(2 * tp / (2 * tp + fp + fn), 4)::DOUBLE AS f1, round((tp + tn) / (tp + tn + fp + fn), 4)::DOUBLE AS accuracy FROM k ORDER BY 2 * tp / (2 * tp + fp + fn) DESC, threshold LIMIT 1")
def ml08(t):
    return rounded(metrics.best_f1(_predictions(t), "y", "p"))


@query("ml10_blend", f"WITH m AS (SELECT k, (k * p + (10 - k) * q) / 10 AS s, y FROM {PRED}, range(0, 11) g(k)) SELECT k::INT AS k, round(auc, 4) AS auc FROM ({AUC.format(by='k,', part='k', src='SELECT k, s, sum(y) AS p, count(*) AS n FROM m GROUP BY 1, 2')} GROUP BY k)")
def ml10(t):
    found = metrics.blends(_predictions(t), "y", ["p", "q"], least=0)
    return rounded(found.select(F.col("ratios")[0].alias("k"), "auc"))


def _model_rows(t):
    base = folds.folds(_customers(t), "c_custkey", 3, ["c_mktsegment"])
    sums = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("total"), F.count("*").alias("n"))
    return assemble.feature_matrix(base, [sums], "c_custkey")


@query("ml03_cross_validation")
def ml03(t):
    from ..operators import models

    cv = models.cross_validate(_model_rows(t), "c_custkey", "target", "valid_no", ["total", "n", "c_nationkey"], "logistic", maxIter=10)
    return models.stacked(cv, "c_custkey")


@query("ml05_train_predict")
def ml05(t):
    from ..operators import models

    return models.train_predict(_model_rows(t), "c_custkey", "target", ["total", "n", "c_nationkey"], "forest", numTrees=10, maxDepth=4)


@query("ml16_clusters")
def ml16(t):
    from ..operators import models

    return models.clusters(_model_rows(t).select("c_custkey", "total", "n"), ["total", "n"], 5).select("c_custkey", "cluster")


@query("ud01_parallel_chunks", "SELECT o_orderkey, round(o_totalprice * 2, 2) AS twice FROM orders")
def ud01(t):
    from ..sources.tables import map_chunks

    return map_chunks(t("orders").select("o_orderkey", "o_totalprice"), lambda f: f.assign(twice=(f.o_totalprice * 2).round(2))[["o_orderkey", "twice"]], "o_orderkey long, twice double")


@query("ud04_aggregate_by_name", "SELECT l_returnflag, round(median(l_quantity), 4) AS median, count(DISTINCT l_suppkey) AS nunique, max(l_tax) AS max FROM lineitem GROUP BY 1")
def ud04(t):
    df = t("lineitem").groupBy("l_returnflag")
    return rounded(df.agg(*[aggregate.by_name(m, F.col(c)).alias(m) for m, c in (("median", "l_quantity"), ("nunique", "l_suppkey"), ("max", "l_tax"))]))


@query("q07_constant_columns", "SELECT 'one' AS \"column\" FROM lineitem HAVING count(*) > 0")
def q07(t):
    return profile.constant(_gaps(t).withColumn("one", F.lit(1)), ["one", "gap", "l_tax"])


@query("c06_count_encoded_base", "WITH c AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1) SELECT c_custkey, o_orderkey, n AS cnt_o_orderpriority FROM orders JOIN c USING (o_orderpriority) JOIN customer ON o_custkey = c_custkey")
def c06(t):
    coded = encode.count_encode(t("orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderpriority"), "o_orderpriority")
    return coded.join(t("customer").select("c_custkey"), "c_custkey").select("c_custkey", "o_orderkey", "cnt_o_orderpriority")


@query("c04_monthly_cleansing", "SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM lineitem WHERE l_returnflag IS DISTINCT FROM 'R') WHERE n = 1")
def c04(t):
    df = t("lineitem").filter(cleanse.not_equal(F.col("l_returnflag"), "R"))
    return cleanse.last_per_key(df, "l_orderkey", F.col("l_linenumber")).select("l_orderkey", "l_linenumber")
