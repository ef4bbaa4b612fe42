"""Queries: composite data sets, registry rules, catalog work, whole profiles, checked model work.

The tables of a loan application and of stores are made from the given ones by expressions that both dialects read."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import columns as fn
from ..operators import aggregate, assemble, cleanse, datasets, encode, folds, metrics, models, profile, series
from ..sources import tables
from ..sources.scratch import scratch, stored
from .catalog import query, r4, rounded
from .features import AUC, CENTS, DAILY, PRED, _daily, _importance, _model_rows, _predictions
from .tables_and_quality import LINES, _customers, _gaps


def _sql(expressions, table):
    return f"(SELECT {', '.join(expressions)} FROM {table})"


def _list(*columns):
    return ", ".join(columns)


# ---- cleansing ----------------------------------------------------------------------------------------------------
APPLICATION = [
    "c_custkey AS SK_ID_CURR",
    "CASE WHEN c_nationkey % 3 = 0 THEN 'Revolving loans' ELSE 'Cash loans' END AS NAME_CONTRACT_TYPE",
    "CASE WHEN c_nationkey % 4 = 0 THEN 'XNA' WHEN c_nationkey % 4 = 1 THEN 'M' ELSE 'F' END AS CODE_GENDER",
    "NULLIF(c_mktsegment, 'FURNITURE') AS OCCUPATION_TYPE",
    "CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal * 200 END AS AMT_INCOME_TOTAL",
    "c_acctbal AS AMT_ANNUITY",
    "c_acctbal * 2 AS AMT_CREDIT",
    "c_acctbal * 3 AS AMT_GOODS_PRICE",
    "1 AS is_train_1",
    "c_custkey % 4 AS valid_no_4",
]
AMOUNTS = datasets.APPLICATION_AMOUNTS
APPLICATION_SQL = f"""SELECT SK_ID_CURR, NAME_CONTRACT_TYPE, CASE WHEN CODE_GENDER = 'XNA' THEN 'F' ELSE CODE_GENDER END AS CODE_GENDER, coalesce(OCCUPATION_TYPE, 'XNA') AS OCCUPATION_TYPE,
CASE WHEN AMT_INCOME_TOTAL < 1000000 THEN AMT_INCOME_TOTAL ELSE 1000000.0 END::DOUBLE AS AMT_INCOME_TOTAL, {_list(*AMOUNTS)}, {_list(*[f"CASE WHEN NAME_CONTRACT_TYPE = 'Revolving loans' THEN {c} END AS revo_{c}" for c in AMOUNTS])}
FROM {_sql(APPLICATION, 'customer')}"""


@query("c01_application", APPLICATION_SQL)
def c01(t):
    return datasets.clean_application(t("customer").selectExpr(*APPLICATION))


BUREAU = ["o_custkey AS SK_ID_CURR", "o_orderkey AS SK_ID_BUREAU", "-(o_totalprice / 5) AS DAYS_CREDIT_ENDDATE", "CASE WHEN o_custkey % 5 <> 0 THEN -(o_totalprice / 8) END AS DAYS_ENDDATE_FACT", "-(o_totalprice / 10) AS DAYS_CREDIT_UPDATE"]


@query("c02_bureau", f"SELECT SK_ID_CURR, SK_ID_BUREAU, {_list(*[f'CASE WHEN {c} > -36000 THEN {c} END AS {c}' for c in datasets.BUREAU_DAYS])} FROM {_sql(BUREAU, 'orders')}")
def c02(t):
    return datasets.clean_bureau(t("orders").selectExpr(*BUREAU))


PREVIOUS = [
    "o_custkey AS SK_ID_CURR",
    "o_orderkey AS SK_ID_PREV",
    "CASE WHEN o_orderstatus = 'P' THEN 'Revolving loans' ELSE 'Cash loans' END AS NAME_CONTRACT_TYPE",
    "o_orderstatus AS NAME_CONTRACT_STATUS",
    "NULLIF(o_orderpriority, '5-LOW') AS NAME_TYPE_SUITE",
    "NULLIF(o_orderstatus, 'F') AS PRODUCT_COMBINATION",
    *[f"o_totalprice - {k} AS {c}" for c, k in zip(("AMT_CREDIT", "AMT_ANNUITY", "AMT_APPLICATION"), (100000, 50000, 150000))],
    *[f"CAST(o_custkey % {k} AS DOUBLE) AS {c}" for c, k in zip(("CNT_PAYMENT", "AMT_DOWN_PAYMENT", "RATE_DOWN_PAYMENT"), (5, 3, 2))],
    *[f"o_totalprice / 2 + {k} AS {c}" for k, c in enumerate(datasets.PREVIOUS_DAYS)],
    "CASE WHEN o_custkey % 9 <> 0 THEN CAST(o_custkey % 400 AS DOUBLE) END AS SELLERPLACE_AREA",
]
_OTHER = ["NAME_TYPE_SUITE", "PRODUCT_COMBINATION", *datasets.PREVIOUS_AMOUNTS, *datasets.PREVIOUS_DAYS, "SELLERPLACE_AREA"]
PREVIOUS_SQL = f"""WITH v AS (SELECT {_list(*datasets.PREVIOUS_KEYS)}, NAME_TYPE_SUITE, PRODUCT_COMBINATION, {_list(*[f"CASE WHEN {c} > 0 THEN {c} END AS {c}" for c in datasets.PREVIOUS_AMOUNTS])},
{_list(*[f"CASE WHEN {c} < 100000 THEN {c} END AS {c}" for c in datasets.PREVIOUS_DAYS])}, CASE WHEN SELLERPLACE_AREA < 200 THEN SELLERPLACE_AREA ELSE 200.0 END::DOUBLE AS SELLERPLACE_AREA FROM {_sql(PREVIOUS, 'orders')})
SELECT {_list(*datasets.PREVIOUS_KEYS)}, {_list(*[f"coalesce({c}, 'XNA') AS {c}" if c in datasets.PREVIOUS_FILLED else c for c in _OTHER])}, {_list(*[f"CASE WHEN NAME_CONTRACT_TYPE = 'Revolving loans' THEN {c} END AS revo_{c}" for c in _OTHER])} FROM v"""


@query("c03_previous", PREVIOUS_SQL)
def c03(t):
    return datasets.clean_previous(t("orders").selectExpr(*PREVIOUS))


MONTHS = [
    "l_orderkey AS SK_ID_PREV",
    "-l_linenumber AS MONTHS_BALANCE",
    "CASE WHEN l_linenumber % 7 <> 0 THEN CAST(l_linenumber % 3 AS DOUBLE) END AS CNT_INSTALMENT_FUTURE",
    "CASE WHEN l_returnflag = 'A' THEN 'Active' WHEN l_returnflag = 'N' THEN 'Completed' WHEN l_linestatus = 'F' THEN 'Signed' END AS NAME_CONTRACT_STATUS",
]
MONTHS_SQL = f"""WITH v AS (SELECT * FROM {_sql(MONTHS, 'lineitem')} WHERE coalesce(NAME_CONTRACT_STATUS NOT IN ('Signed', 'Approved', 'XNA'), true))
SELECT SK_ID_PREV, min(MONTHS_BALANCE) AS MONTHS_BALANCE, 0.0::DOUBLE AS CNT_INSTALMENT_FUTURE, 'Completed' AS NAME_CONTRACT_STATUS FROM v WHERE CNT_INSTALMENT_FUTURE = 0 GROUP BY 1
UNION ALL SELECT SK_ID_PREV, MONTHS_BALANCE, CNT_INSTALMENT_FUTURE, CASE WHEN NAME_CONTRACT_STATUS = 'Completed' THEN 'Active' ELSE NAME_CONTRACT_STATUS END FROM v WHERE CNT_INSTALMENT_FUTURE > 0"""


@query("c04_monthly", MONTHS_SQL)
def c04(t):
    return datasets.clean_monthly(t("lineitem").selectExpr(*MONTHS))


@query("c05_instalments", "SELECT l_orderkey, l_linenumber, AMT_INSTALMENT FROM (SELECT l_orderkey, l_linenumber, l_extendedprice - 20000 AS AMT_INSTALMENT FROM lineitem) WHERE AMT_INSTALMENT > 0")
def c05(t):
    return datasets.clean_instalments(t("lineitem").selectExpr("l_orderkey", "l_linenumber", "l_extendedprice - 20000 AS AMT_INSTALMENT"))


@query("c05_card_balance", f"SELECT l_orderkey, l_linenumber, coalesce(gap, 0) AS AMT_DRAWN, coalesce(CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber END, 0)::INT AS CNT_DRAWN, CASE WHEN l_linenumber % 3 = 0 THEN l_tax END AS RATE FROM {LINES}")
def c05_card(t):
    df = _gaps(t).selectExpr("l_orderkey", "l_linenumber", "gap AS AMT_DRAWN", "CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber END AS CNT_DRAWN", "CASE WHEN l_linenumber % 3 = 0 THEN l_tax END AS RATE")
    return datasets.clean_card(df)


@query(
    "c06_count_features",
    """WITH a AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)
    SELECT o_custkey AS c_custkey, a.n AS cnt_o_orderstatus, b.n AS cnt_o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey JOIN a USING (o_orderstatus) JOIN b USING (o_orderpriority)""",
)
def c06(t):
    child = t("orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus", "o_orderpriority", F.lit("same").alias("flat"))
    return datasets.count_features(t("customer"), child, "c_custkey")


STORES = [
    "concat('s', CAST(c_custkey % 300 AS VARCHAR(9))) AS name",
    "concat('st', CAST(c_nationkey AS VARCHAR(9))) AS station",
    "'l' AS local",
    "'t' AS street",
    "'p' AS pr_comment",
    "139 + CAST(c_custkey % 97 AS DOUBLE) / 100 AS longitude",
    "35 + CAST(c_custkey % 89 AS DOUBLE) / 100 AS latitude",
    "CASE WHEN c_custkey % 11 = 0 THEN '0.00' WHEN c_custkey % 13 = 0 THEN '-' ELSE CAST(1 + c_custkey % 4 AS VARCHAR(9)) END AS rate",
    "CAST(c_custkey % 40 AS VARCHAR(9)) AS review",
    "CASE WHEN c_custkey % 50 = 0 THEN 'seat' WHEN c_custkey % 6 = 0 THEN '１２' ELSE CAST(c_custkey % 30 AS VARCHAR(9)) END AS seat",
    "CASE WHEN c_custkey % 5 = 0 THEN '2015年４月1日' WHEN c_custkey % 5 = 1 THEN '2012年' END AS open_date",
    "CASE WHEN c_custkey % 3 = 0 THEN 'soba、udon' WHEN c_custkey % 3 = 1 THEN 'sushi' ELSE 'soba' END AS genre",
]
STATIONS = ["concat('st', CAST(n_nationkey AS VARCHAR(9))) AS station", "139 + CAST(n_nationkey AS DOUBLE) / 50 AS station_longitude", "35.5 AS station_latitude"]
STORE_SQL = f"""s AS (SELECT DISTINCT * REPLACE (try_cast(rate AS DOUBLE) AS rate, try_cast(review AS DOUBLE) AS review) FROM {_sql(STORES, 'customer')} WHERE seat <> 'seat'),
j AS (SELECT s.*, station_longitude, station_latitude::DOUBLE AS station_latitude, 6378.137 * acos(least(1.0, greatest(-1.0, sin(radians(station_latitude)) * sin(radians(latitude)) + cos(radians(station_latitude)) * cos(radians(latitude)) * cos(radians(longitude - station_longitude))))) AS distance_station
  FROM s JOIN {_sql(STATIONS, 'nation')} USING (station) WHERE rate <> 0 OR rate IS NULL),
near AS (SELECT j.* REPLACE (CASE open_date WHEN '2015年４月1日' THEN DATE '2015-04-01' WHEN '2012年' THEN DATE '2012-01-01' END AS open_date, replace(replace(seat, '１', '1'), '２', '2')::DOUBLE AS seat)
  FROM j JOIN (SELECT name, min(distance_station) AS d FROM j GROUP BY 1) m ON j.name = m.name AND j.distance_station = m.d)"""


def _stores(t, encoded):
    return datasets.store_set(t("customer").selectExpr(*STORES), t("nation").selectExpr(*STATIONS).withColumn("station_latitude", F.col("station_latitude").cast("double")), encode=encoded)


@query("c07_stores", f"WITH {STORE_SQL} SELECT name, station, open_date, rate, review, seat, genre, round(distance_station, 3) AS distance_station FROM near")
def c07(t):
    return _stores(t, False).select("name", "station", "open_date", "rate", "review", "seat", "genre", F.round("distance_station", 3).alias("distance_station"))


@query(
    "c07_store_model_set",
    f"""WITH {STORE_SQL}, g AS (SELECT DISTINCT name, unnest(string_split(genre, '、')) AS part FROM near), f AS (SELECT part, count(*) AS n FROM g GROUP BY 1),
    h AS (SELECT name, count(*) AS n_genres, sum(n)::BIGINT AS genre_frequency FROM g JOIN f USING (part) GROUP BY 1),
    d AS (SELECT DISTINCT near.*, n_genres, genre_frequency FROM near LEFT JOIN h USING (name))
    SELECT name, open_date, {_list(*[f"round((d.{c} - avg(d.{c}) OVER ()) / stddev_samp(d.{c}) OVER (), 3) + 0.0 AS {c}" for c in ("rate", "review", "seat", "n_genres", "genre_frequency", "distance_station")])} FROM d""",
)
def c07_model(t):
    return _stores(t, True).select("name", "open_date", *[(F.round(c, 3) + 0.0).alias(c) for c in ("rate", "review", "seat", "n_genres", "genre_frequency", "distance_station")])


@query(
    "c08_model_ready_with_predictions",
    f"WITH a AS (SELECT c_custkey, y, p, q FROM {PRED}), m AS (SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS b FROM customer), f AS (SELECT c_custkey, coalesce(b, avg(b) OVER ()) AS b FROM m), s AS (SELECT c_custkey, CASE WHEN min(b) OVER () < 0 THEN (b + abs(min(b) OVER ())) / (max(b) OVER () + abs(min(b) OVER ())) ELSE b / max(b) OVER () END AS b FROM f) SELECT c_custkey, round(b, 3) AS b, p AS first, q AS second FROM s JOIN a USING (c_custkey)",
)
def c08(t):
    df = t("customer").select("c_custkey", F.expr("CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS b"))
    parts = {"first": _predictions(t).withColumnRenamed("p", "prediction"), "second": _predictions(t).withColumnRenamed("q", "prediction")}
    ready = datasets.model_ready(df, parts, "c_custkey")
    return ready.select("c_custkey", F.round(F.col("b").cast("double"), 3).alias("b"), "first", "second")


@query("c08_prediction_correlation", f"SELECT 'p' AS a, 'q' AS b, round(corr(p, q), 4) AS r FROM {PRED}")
def c08_r(t):
    return rounded(datasets.prediction_correlations(_predictions(t), ["p", "q"]))


# ---- matrix, averages, checks --------------------------------------------------------------------------------------
REGISTRY = "(SELECT p_name || '_' || p_partkey AS feature, p_partkey % 10 <> 0 AS has_train, p_partkey % 7 <> 0 AS has_test, p_partkey % 97 = 1 AS is_valid, p_retailprice AS importance FROM part)"


def _registered(t):
    key = F.col("p_partkey")
    return t("part").select(F.concat_ws("_", "p_name", "p_partkey").alias("feature"), (key % 10 != 0).alias("has_train"), (key % 7 != 0).alias("has_test"), (key % 97 == 1).alias("is_valid"))


@query(
    "j04_matrix_features",
    f"""WITH r AS (SELECT *, row_number() OVER (ORDER BY importance DESC, feature) AS rank FROM {REGISTRY}),
    c AS (SELECT feature, has_train AND (importance >= 1000 OR is_valid) AS in_train, has_test AND (rank <= 150 OR is_valid) AS in_test FROM r)
    SELECT feature, in_train FROM c WHERE in_test ORDER BY feature LIMIT 100""",
)
def j04(t):
    importance = assemble.ranked(_importance(t).drop("p_brand"))
    return assemble.matrix_features(_registered(t), importance, 150, 1000.0, 100)


@query("j04_narrow_matrix", "SELECT c_custkey, c_nationkey AS n, round(total, 0) AS total FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice)::FLOAT::DOUBLE AS total FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def j04_narrow(t):
    sums = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("total"))
    wide = profile.narrowed(assemble.feature_matrix(t("customer").select("c_custkey", F.col("c_nationkey").alias("n")), [sums], "c_custkey"), ["c_custkey"])
    return wide.select("c_custkey", F.col("n").cast("int").alias("n"), F.round(F.col("total").cast("double"), 0).alias("total"))


T05_SQL = f"""WITH d AS (SELECT *, isodow(day) % 2 AS seg, day IN (DATE '2024-01-10', DATE '2024-01-15') AS special FROM ({DAILY})),
r AS (SELECT *, CASE WHEN NOT special THEN v END AS w, row_number() OVER (PARTITION BY event_type, seg ORDER BY day) AS n FROM d),
a AS (SELECT x.event_type, x.day, x.seg, sum(y.w * pow(0.9, x.day - y.day)) / sum(pow(0.9, x.day - y.day)) FILTER (y.w IS NOT NULL) AS wg FROM r x LEFT JOIN r y ON x.event_type = y.event_type AND x.seg = y.seg AND y.n <= x.n - 1 WHERE NOT x.special GROUP BY 1, 2, 3)
SELECT event_type, day, round(coalesce(wg, avg(wg) OVER (PARTITION BY event_type, seg)), 4) AS wg FROM a WHERE day >= DATE '2024-01-03'"""


@query("t05_segment_averages", T05_SQL)
def t05(t):
    daily = _daily(t).withColumn("seg", (F.weekday("day") + 1) % 2)
    calendar = daily.filter("day >= '2024-01-03'")
    out = series.segment_averages(daily, calendar, "event_type", "day", "v", "seg", F.col("day").isin("2024-01-10", "2024-01-15"), 0.9, 1)
    return out.select("event_type", "day", r4("`v_wg0.9_avg@event_type`").alias("wg"))


@query("q01_columns_by_kind", "SELECT 'categorical' AS kind, 'o_orderstatus' AS \"column\", count(o_orderstatus) AS n FROM orders UNION ALL SELECT 'categorical', 'o_orderpriority', count(o_orderpriority) FROM orders UNION ALL SELECT 'datetime', 'o_orderdate', count(o_orderdate) FROM orders UNION ALL SELECT 'numeric', 'o_custkey', count(o_custkey) FROM orders UNION ALL SELECT 'numeric', 'o_totalprice', count(o_totalprice) FROM orders")
def q01(t):
    df = t("orders").drop("o_orderkey")
    kinds = {c: k for k, names in profile.kinds(df).items() for c in names}
    counts = profile.long_aggregate(df, list(kinds), {"n": F.count})
    return counts.select(F.create_map(*[F.lit(x) for c, k in kinds.items() for x in (c, k)])[F.col("column")].alias("kind"), "column", "n")


PROFILED = "SELECT '{c}' AS \"column\", '{k}' AS data_type, count(*) FILTER ({c} IS NULL) AS nulls, count(DISTINCT {c}) AS n_distinct, count(*) FILTER ({c} = 'inf'::DOUBLE) AS pos_inf, count(*) FILTER ({c} = '-inf'::DOUBLE) AS neg_inf FROM {s}"


@query("q02_whole_profile", " UNION ALL ".join(PROFILED.format(c=c, k=k, s=f"(SELECT CASE WHEN l_linenumber = 3 THEN 'inf'::DOUBLE WHEN l_linenumber = 4 THEN NULL ELSE l_tax END AS x, l_quantity FROM lineitem)") for c, k in (("x", "double"), ("l_quantity", "double"))))
def q02(t):
    df = t("lineitem").selectExpr("CASE WHEN l_linenumber = 3 THEN double('inf') WHEN l_linenumber = 4 THEN NULL ELSE l_tax END AS x", "l_quantity")
    return profile.described(df, ["x", "l_quantity"])


@query("q02_top_values_listed", "WITH c AS (SELECT l_returnflag AS v, count(*) AS n FROM lineitem GROUP BY 1) SELECT 'l_returnflag' AS \"column\", list(v ORDER BY n DESC, v) AS top_values, list(n ORDER BY n DESC, v) AS top_counts FROM c")
def q02_top(t):
    return profile.top_lists(t("lineitem"), ["l_returnflag"], 10).select("column", "top_values", "top_counts")


@query("q04_types", "SELECT name AS \"column\", kind, n FROM (SELECT 's_suppkey' AS name, 'bigint' AS kind, count(s_suppkey) AS n FROM supplier UNION ALL SELECT 's_name', 'string', count(s_name) FROM supplier UNION ALL SELECT 's_nationkey', 'int', count(s_nationkey) FROM supplier UNION ALL SELECT 's_acctbal', 'double', count(s_acctbal) FROM supplier)")
def q04(t):
    df = t("supplier")
    return profile.types(df)


@query("q12_dictionary_with_counts", "SELECT 'nation' AS \"table\", 'n_name' AS \"column\", 6::BIGINT AS length, count(DISTINCT n_name) AS n_distinct FROM nation UNION ALL SELECT 'nation', 'n_nationkey', 11, count(DISTINCT n_nationkey) FROM nation UNION ALL SELECT 'nation', 'n_regionkey', 11, count(DISTINCT n_regionkey) FROM nation UNION ALL SELECT 'region', 'r_name', 6, count(DISTINCT r_name) FROM region UNION ALL SELECT 'region', 'r_regionkey', 11, count(DISTINCT r_regionkey) FROM region")
def q12(t):
    return profile.dictionary({"nation": t("nation"), "region": t("region")})


@query("q22_checked_label", "WITH o AS (SELECT o_orderkey, o_custkey % 5 <> 0 AS trains, o_totalprice, dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS s FROM orders) SELECT o_orderkey, CASE WHEN trains THEN (o_totalprice > 200000)::INT END AS y, s::INT AS o_orderstatus FROM o")
def q22(t):
    df = t("orders").select("o_orderkey", "o_orderdate", "o_orderstatus", F.lit("x").alias("flat"), "o_custkey", (F.col("o_totalprice") > 200000).cast("int").alias("y"))
    train, test = df.filter("o_custkey % 5 <> 0").drop("o_custkey"), df.filter("o_custkey % 5 = 0").drop("o_custkey", "y")
    out, gone = datasets.checked(train, test, "y", "label", ["o_orderkey"])
    return out.drop(*gone).select("o_orderkey", "y", "o_orderstatus")


@query("q22_checked_dummies", "SELECT o_orderkey, (o_orderstatus = 'F')::INT AS dummie_o_orderstatus_F, (o_orderstatus = 'O')::INT AS dummie_o_orderstatus_O, (o_orderstatus = 'P')::INT AS dummie_o_orderstatus_P FROM orders")
def q22_dummies(t):
    df = t("orders").select("o_orderkey", "o_orderstatus", "o_custkey", (F.col("o_totalprice") > 200000).cast("int").alias("y"))
    out, gone = datasets.checked(df.filter("o_custkey % 5 <> 0"), df.filter("o_custkey % 5 = 0").drop("y"), "y", "dummie", ["o_orderkey", "o_custkey"])
    return out.drop(*gone, "o_custkey", "y")


Z = "WITH v AS (SELECT c_custkey, c_acctbal, (c_acctbal - avg(c_acctbal) OVER ()) / stddev_samp(c_acctbal) OVER () AS z FROM customer)"


@query("p20_outliers_value", f"{Z} SELECT c_custkey, CASE WHEN abs(z) <= 1.5 THEN c_acctbal ELSE -1 END::DOUBLE AS two_sided, CASE WHEN z <= 1.0 AND z >= -1.2 THEN c_acctbal ELSE -1 END::DOUBLE AS limited, CASE WHEN z <= 1.0 THEN c_acctbal ELSE -1 END::DOUBLE AS above FROM v")
def p20(t):
    df, out = t("customer").select("c_custkey", "c_acctbal"), None
    for name, more in (("two_sided", {}), ("limited", {"plus": 1.0, "minus": 1.2}), ("above", {"plus": 1.0})):
        part = cleanse.outliers(df, "c_acctbal", 1.5, "value", -1.0, **more).select("c_custkey", F.col("c_acctbal").alias(name))
        out = part if out is None else out.join(part, "c_custkey")
    return out


@query("p20_outliers_one_side", f"{Z}, e AS (SELECT max(c_acctbal) AS hi FROM v WHERE abs(z) <= 1.5) SELECT c_custkey, CASE WHEN z > 1.5 THEN hi ELSE c_acctbal END AS c_acctbal, z >= -1.5 AS stays FROM v, e")
def p20_one(t):
    df = t("customer").select("c_custkey", "c_acctbal")
    moved = cleanse.outliers(df, "c_acctbal", 1.5, two_sided=False).drop("z")
    stays = cleanse.outliers(df, "c_acctbal", 1.5, "drop", two_sided=False).select("c_custkey", F.lit(True).alias("stays"))
    return moved.join(stays, "c_custkey", "left").select("c_custkey", "c_acctbal", F.coalesce("stays", F.lit(False)).alias("stays"))


@query("p27_renamed_level", "SELECT o_custkey, n AS p_n_s, total AS p_total_s FROM (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1)")
def p27(t):
    sums = t("orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    out = cleanse.rename_level(sums, "o_custkey", ["o_custkey"], "p_", "_s")
    return out.select("o_custkey", *[F.col(f"`{c}`").alias(c.split("@")[0]) for c in out.columns[1:]])


@query("p28_store_rows", f"SELECT DISTINCT name, station, try_cast(rate AS DOUBLE) AS rate, try_cast(review AS DOUBLE) AS review, seat FROM {_sql(STORES, 'customer')} WHERE seat <> 'seat' AND coalesce(try_cast(rate AS DOUBLE) <> 0, true)")
def p28(t):
    return datasets.clean_stores(t("customer").selectExpr(*STORES).select("name", "station", "rate", "review", "seat"), ("rate", "review"))


@query("a12_weekday_pivot", "SELECT user_id, " + ", ".join(f"coalesce({CENTS} FILTER (isodow(ts) = {d + 1})::DOUBLE / count(value) FILTER (isodow(ts) = {d + 1}), 0) AS \"{d}_mean\", coalesce(median(value) FILTER (isodow(ts) = {d + 1}), 0) AS \"{d}_median\", coalesce(max(value) FILTER (isodow(ts) = {d + 1}), 0) AS \"{d}_max\", count(value) FILTER (isodow(ts) = {d + 1}) AS \"{d}_count\"" for d in range(7)) + " FROM events GROUP BY 1")
def a12(t):
    made = [aggregate.exact_mean(F.col("value"), 2).alias("mean"), F.median("value").alias("median"), F.max("value").alias("max"), F.count("value").alias("count")]
    return aggregate.pivot(t("events").withColumn("dow", F.weekday("ts")), "user_id", "dow", range(7), made, 0)


# ---- text and pages --------------------------------------------------------------------------------------------------
@query("x03_bracket_free", "SELECT p_partkey, replace(replace(replace('[' || p_brand || ',' || p_size || ']', '[', '-q-'), ']', '-p-'), ',', '-o-') AS name FROM part")
def x03(t):
    name = F.concat(F.lit("["), "p_brand", F.lit(","), F.col("p_size").cast("string"), F.lit("]"))
    return t("part").select("p_partkey", fn.bracket_free(name).alias("name"))


@query("x09_ward_dummies", "SELECT n_nationkey, (n_nationkey % 3 = 0)::INT AS \"dummie_street_a\", (n_nationkey % 3 = 1)::INT AS \"dummie_street_b\" FROM nation WHERE n_nationkey % 3 < 2")
def x09(t):
    text = F.expr("CASE WHEN n_nationkey % 3 = 0 THEN '港区a' WHEN n_nationkey % 3 = 1 THEN 'b' ELSE '千代田区c' END")
    return datasets.ward_dummies(t("nation").select("n_nationkey", text.alias("address")), "address")


@query(
    "x10_page_fields",
    """SELECT page_id, nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '') AS title, (contains(html, '<p'))::INT AS has_text, (page_id % 5)::VARCHAR AS rating, coalesce(page_id % 1000, 0)::DOUBLE AS budget,
    (35 + page_id % 10)::DOUBLE AS latitude, 139.5::DOUBLE AS longitude FROM pages""",
)
def x10(t):
    block = F.concat(F.lit('<script type="application/ld+json">{"aggregateRating": {"ratingValue": "'), (F.col("page_id") % 5).cast("string"), F.lit('"}}</script><b class="budget">￥'), (F.col("page_id") % 1000).cast("string"), F.lit("～</b>"))
    pages = t("pages").select("page_id", F.concat("html", block).alias("html"), F.concat(F.lit("http://map/?zoom=3&center="), (35 + F.col("page_id") % 10).cast("string"), F.lit(".0,139.5")).alias("map"))
    fields = datasets.page_fields(F.col("html"), {"title": "<title>([^<]*)</title>", "budget": 'class="budget">([^<]*)<'}, {"has_text": "<p"}, {"rating": "$.aggregateRating.ratingValue"}, ["budget"])
    latitude, longitude = datasets.point_of(F.col("map"))
    return pages.select("page_id", *fields, latitude.alias("latitude"), longitude.alias("longitude"))


# ---- catalog ------------------------------------------------------------------------------------------------------------
@query("io07_raw_columns", "SELECT o_custkey, total AS raw_total_ FROM (SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1)")
def io07(t):
    df = t("orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total("), F.count("*").alias("total_n"), F.max("o_orderdate").alias("last"))
    return tables.select_named(df, "o_custkey", "total", "raw_", ignore=["total_n"])


@query("io11_csv_into_table", "SELECT c_nationkey, count(*) AS n, sum(c_custkey)::BIGINT AS keys FROM customer GROUP BY 1")
def io11(t):
    name, path = f"csv_{uuid.uuid4().hex}", scratch(t.spark, "csv")
    df = t("customer").select("c_custkey", "c_nationkey")
    tables.write_csv(df, path)
    tables.create_table(t.spark, name, tables.schema_of([("c_custkey", "long", True), ("c_nationkey", "int", True)]))
    tables.insert_csv(t.spark, path, name, df.schema)
    out = t.spark.table(name).groupBy("c_nationkey").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys"))
    return _read_and_dropped(t, out, [name])


def _read_and_dropped(t, out, names):
    """The rows of ``out``, stored before its catalog tables go."""
    kept = stored(out, "rows")
    for n in names:
        t.spark.sql(f"DROP TABLE {n}")
    return kept


@query("io16_listed_tables", "SELECT unnest(['keep_nation', 'part_a', 'part_b']) AS name, count(*) AS n_rows, false AS left_over FROM nation")
def io16(t):
    base = f"d_{uuid.uuid4().hex}"
    tables.create_database(t.spark, base)
    for n in ("part_a", "part_b", "keep_nation"):
        tables.append_table(t("nation"), f"{base}.{n}")
    names = tables.list_tables(t.spark, base)
    rows = [t.spark.table(f"{base}.{n}").agg(F.lit(n).alias("name"), F.count("*").alias("n_rows")) for n in names]
    kept = stored(assemble.union_all(rows), "rows")
    tables.drop_tables(t.spark, base, "part_")
    left = tables.list_tables(t.spark, base) != ["keep_nation"]
    tables.drop_database(t.spark, base)
    return kept.withColumn("left_over", F.lit(left or t.spark.catalog.databaseExists(base)))


@query("u05_changed_columns", "SELECT unnest(['gap', 'l_discount']) AS \"column\", unnest(['after', 'before']) AS side, count(*) AS n_rows FROM lineitem")
def u05(t):
    return assemble.changed_columns(t("lineitem"), _gaps(t).drop("l_discount"))


@query("ud03_element_wise", "SELECT p_partkey, upper(p_brand) AS brand, p_size * 2 + 1 AS size FROM part")
def ud03(t):
    df = t("part").select("p_partkey", F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))
    return assemble.mapped(df, {"brand": F.upper, "size": lambda c: c * 2 + 1})


# ---- models ------------------------------------------------------------------------------------------------------------------
@query("ml10_best_blend", f"WITH m AS (SELECT k, (k * p + (10 - k) * q) / 10 AS s, y FROM {PRED}, range(1, 10) g(k)) SELECT k::INT AS k, round(auc, 4) AS auc FROM ({AUC.format(by='k,', part='k', src='SELECT k, s, sum(y) AS p, count(*) AS n FROM m GROUP BY 1, 2')} GROUP BY k) ORDER BY auc DESC, k LIMIT 1")
def ml10(t):
    return rounded(metrics.best_blend(_predictions(t), "y", ["p", "q"]).select(F.col("ratios")[0].alias("k"), "auc"))


@query("ml15_early_stop", "SELECT 1::BIGINT AS folds_run, count(*) AS oof_rows FROM (SELECT c_custkey, ((row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(c_custkey::VARCHAR || '|1208'), c_custkey) - 1) % 3 + 1) AS valid_no FROM customer) WHERE valid_no = 1 AND c_custkey % 5 <> 0")
def ml15(t):
    cv = models.cross_validate(_model_rows(t), "c_custkey", "target", "valid_no", ["total", "n"], stops=[1.01])
    return cv.oof.agg(F.lit(len(cv.scores)).cast("long").alias("folds_run"), F.count("*").alias("oof_rows"))


@query("ud05_own_folds", "SELECT c_custkey % 4 AS fold, count(*) AS oof_rows FROM customer WHERE c_custkey % 5 <> 0 GROUP BY 1")
def ud05(t):
    own = _model_rows(t).withColumn("own", F.col("c_custkey") % 4)
    cv = models.cross_validate(own, "c_custkey", "target", "own", ["total", "n"])
    return cv.oof.groupBy(F.col("own").alias("fold")).agg(F.count("*").alias("oof_rows"))


@query("f09_chunks")
def f09(t):
    found = models.demote_by_chunks(_model_rows(t), "c_custkey", "target", "valid_no", ["total", "n", "c_nationkey"], [1], chunk=2, numTrees=2, maxDepth=2)
    return t.spark.createDataFrame([(k, ",".join(names), score, ",".join(kept)) for k, names, score, kept in found], "chunk int, features string, score double, kept string")


# What a fit gives differs between engines; which rows it gives, and in which range, does not.
EVERY, TESTED = "SELECT c_custkey, true AS in_range FROM customer", "SELECT c_custkey, true AS in_range FROM customer WHERE c_custkey % 5 = 0"


def _in_range(df, key="c_custkey", column="prediction", low=0.0, high=1.0):
    return df.select(key, F.col(column).between(low, high).alias("in_range"))


@query("ml03_rows", EVERY)
def ml03(t):
    cv = models.cross_validate(_model_rows(t), "c_custkey", "target", "valid_no", ["total", "n"], "logistic", maxIter=5)
    return _in_range(models.stacked(cv, "c_custkey"))


@query("ml05_rows", TESTED)
def ml05(t):
    return _in_range(models.train_predict(_model_rows(t), "c_custkey", "target", ["total", "n"], "forest", numTrees=3, maxDepth=3))


@query("ml06_rows", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01'")
def ml06(t):
    rows = t("orders").select("o_orderkey", "o_totalprice", F.col("o_custkey").cast("double").alias("c"), (F.col("o_orderdate") >= "2000-01-01").cast("int").alias("val_label"))
    return models.time_predict(rows, "o_orderkey", "o_totalprice", ["c"]).filter("prediction IS NOT NULL").select("o_orderkey", "o_totalprice")


@query("ml09_rows", "SELECT unnest(['c_nationkey', 'n', 'total']) AS feature, true AS in_range FROM (SELECT count(*) FROM customer)")
def ml09(t):
    found = models.cross_validate(_model_rows(t), "c_custkey", "target", "valid_no", ["total", "n", "c_nationkey"], "forest", numTrees=3, maxDepth=3).importance
    return _in_range(found, "feature", "importance")


@query("ml12_rows", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 2 THEN l_extendedprice END AS known, true AS filled FROM lineitem")
def ml12(t):
    lines = t("lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", F.xxhash64("*")).alias("key"), "l_orderkey", "l_linenumber", F.expr("CASE WHEN l_linenumber <> 2 THEN l_extendedprice END").alias("price"), "l_quantity", (F.col("l_orderkey") % 2).cast("int").alias("fold"))
    out = models.impute_by_model(lines, "key", "price", ["l_quantity"], "fold", -1e9)
    return out.select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") != 2, F.col("price")).alias("known"), F.col("price").isNotNull().alias("filled"))


@query("ml16_rows", EVERY)
def ml16(t):
    return _in_range(models.clusters(_model_rows(t).select("c_custkey", "total", "n"), ["total", "n"], 5), column="cluster", high=4)


@query("f07_rows", "SELECT 2::BIGINT AS tries, 2::BIGINT AS features_each FROM (SELECT count(*) FROM customer)")
def f07(t):
    tried = models.random_decrease(_model_rows(t), "c_custkey", "target", "valid_no", ["total", "n", "c_nationkey"], 1, 2, maxIter=3)
    return t("customer").agg(F.lit(len(tried)).cast("long").alias("tries"), F.lit(max(len(c) for _, c in tried)).cast("long").alias("features_each"))


@query("f09_rows", "SELECT unnest([0, 1])::INT AS chunk, unnest([2, 1])::BIGINT AS tried, 1::BIGINT AS kept FROM (SELECT count(*) FROM customer)")
def f09_rows(t):
    found = models.demote_by_chunks(_model_rows(t), "c_custkey", "target", "valid_no", ["total", "n", "c_nationkey"], [1], chunk=2, numTrees=2, maxDepth=2)
    return t.spark.createDataFrame([(k, len(names), len(kept)) for k, names, _, kept in found], "chunk int, tried long, kept long")


@query("k03_two_frames", "WITH top AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12) SELECT o_custkey, row_number() OVER (ORDER BY o_custkey)::INT AS place, n AS finished, (SELECT count(*) FROM orders o WHERE o.o_custkey = top.o_custkey AND o_orderstatus = 'O') AS open FROM top")
def k03(t):
    o = t("orders")
    return assemble.counts_of_top({"finished": o.filter("o_orderstatus = 'F'"), "open": o.filter("o_orderstatus = 'O'")}, "o_custkey", 12, alphabetic=True)


@query("e08_crosses_of_three", "SELECT o_orderkey, o_orderstatus || '_' || o_orderpriority || '_' || (o_custkey % 2) AS crossed FROM orders")
def e08(t):
    df = t("orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", (F.col("o_custkey") % 2).cast("string").alias("even"))
    return encode.crosses(df, ["o_orderstatus", "o_orderpriority", "even"], 3).select("o_orderkey", F.col("o_orderstatus_o_orderpriority_even").alias("crossed"))
