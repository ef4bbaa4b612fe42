"""Edge rows of operators, sources and models that the table queries don't reach."""

import math

from pyspark.sql import functions as F

from featuremill.functions import columns as fn
from featuremill.operators import aggregate, assemble, cleanse, encode, folds, metrics, models, profile
from featuremill.sources import tables
from featuremill.streaming.features import daily_counts_stream


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_geo_known_values(spark):
    p = [F.lit(x) for x in (139.988909, 35.685828, 139.990339, 35.685879)]
    assert abs(one(spark, fn.azimuth_deg(*p)) - 87.485) < 0.01 and abs(one(spark, fn.cosine_law_km(*p)) - 0.129) < 0.001
    assert abs(one(spark, fn.haversine_m(*p)) - 129.5) < 1


def test_text_and_dates(spark):
    assert str(one(spark, fn.japanese_month(F.lit("２０１５年４月１日")))) == "2015-04-01" and str(one(spark, fn.japanese_month(F.lit("2015年")))) == "2015-01-01"
    assert one(spark, fn.japanese_month(F.lit("soon"))) is None and one(spark, fn.japanese_month(F.lit("2015年13月"))) is None
    for text, want in (("a", ["a", "0", "0"]), ("a、b、c", ["a", "b", "c"]), ("a、b、c、d", ["0", "0", "0"]), (None, None)):
        assert one(spark, fn.fixed_list(F.lit(text).cast("string"))) == want
    assert one(spark, fn.ward(F.lit("中央区銀座"))) == "中央" and one(spark, fn.ward(F.lit("x"))) == "港"
    assert fn.safe_name("a(b)/c.d") == "a_b__c-d" and fn.bracket_free_name("a[1],b") == "a-q-1-p--o-b"


def test_nulls_nan_and_infinities(spark):
    df = spark.createDataFrame([(1, None), (2, float("nan")), (3, float("inf")), (4, float("-inf")), (5, 2.0), (6, 4.0)], "k long, x double")
    assert [r.x for r in cleanse.infinite_to_null(df).orderBy("k").collect()] == [None] * 4 + [2.0, 4.0]
    got = [r.x for r in cleanse.infinite_to_range(df, "x").orderBy("k").collect()]
    assert got[0] is None and math.isnan(got[1]) and got[2:] == [4.0, 2.0, 2.0, 4.0]
    flat = spark.createDataFrame([(1, 3.0, None), (2, 3.0, None)], "k long, x double, y double")
    assert all(r.x is None for r in cleanse.standardise(flat, ["x", "y"]).collect())
    assert profile.constant(flat, ["x", "y"]).collect()[0].column == "x"
    assert profile.correlations(flat, ["x", "y"]).first().r is None


def test_aggregate_edges(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, None), (None, 9.0), (3, 5.0)], "k long, x double")
    base = spark.createDataFrame([(1, 1), (2, None), (3, 0), (9, None)], "k long, target int")
    out = {r.k: r for r in aggregate.base_aggregation(base, df, "k", ["x"], ["sum", "count", "var", "skew"]).collect()}
    assert set(out) == {1, 2, 3, 9} and out[2]["x_sum@k"] is None and out[1]["x_var@k"] == 2.0 and out[1]["x_skew@k"] is None
    wide = base.withColumns({"same@k": F.lit(1), "varied@k": F.col("k").cast("double")})
    assert aggregate.drop_constant(wide, "target").columns == ["k", "target", "varied@k"]


def test_encodings(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "b")], "k long, c string")
    assert [r.c_code for r in encode.label_encode(df, "c").orderBy("k").collect()] == [1, 0, -1, 1]
    assert [tuple(r)[1:] for r in encode.one_hot(df, "c").orderBy("k").collect()] == [(0, 1), (1, 0), (0, 0), (0, 1)]
    assert {r.k: r.cnt_c for r in encode.count_encode(df, "c").collect()} == {1: 2, 2: 1, 3: None, 4: 2}
    rows = spark.createDataFrame([(1, "a", 1.0, 1), (2, "a", 0.0, 2), (3, "a", None, None), (4, "z", None, None)], "k long, c string, y double, f int")
    for method in ("mean", "max"):
        got = {r.k: r["TE_y@c"] for r in encode.target_encode(rows, ["c"], "y", "f", method).collect()}
        assert got == {1: 0.0, 2: 1.0, 3: 0.5 if method == "mean" else 1.0, 4: None}


def test_folds_are_balanced(spark):
    df = spark.range(1000).withColumn("s", F.col("id") % 3)
    got = folds.folds(df, "id", 5, ["s"]).groupBy("s", "valid_no").count().collect()
    assert len(got) == 15 and {r["count"] for r in got} <= {66, 67}


def test_metrics(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.4), (0, 0.1), (None, 0.3)], "y int, p double")
    assert metrics.auc(df, "y", "p").first().auc == 0.625
    assert metrics.best_f1(df, "y", "p").first().threshold == 0.4
    assert metrics.auc(df.filter("y = 1"), "y", "p").first().auc is None


def test_sources_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, 2.0, 3.0), (2, None, 4.0, None)], "k long, target int, `a@k` double, `b@k` double")
    registry = tables.save_features(df, "k", "target", f"file://{tmp_path}/f")
    tables.save_features(df.withColumn("a@k", F.lit(0.0)), "k", "target", f"file://{tmp_path}/f")
    assert sorted(map(tuple, tables.load_features(spark, registry, "k").select("k", "`a@k`", "`b@k`").collect())) == [(1, 2.0, 3.0), (2, 4.0, None)]
    assert tables.select_named(df, "k", prefix="x_").columns == ["k", "x_a@k", "x_b@k"]
    tables.write_csv(df, f"file://{tmp_path}/c")
    tables.append_csv(df, f"file://{tmp_path}/c")
    assert tables.read_csv(spark, f"file://{tmp_path}/c", df.schema).count() == 4
    tables.write_parts(df, f"file://{tmp_path}/p", 2)
    assert tables.read_parts(spark, f"file://{tmp_path}/p", ["k"]).count() == 2
    spark.sql("CREATE DATABASE IF NOT EXISTS shelf")
    tables.create_table(spark, "shelf.t_one", df.schema)
    tables.append_table(df, "shelf.t_one")
    assert tables.table_from_query(spark, "shelf.t_two", "SELECT k FROM shelf.t_one").count() == 2
    assert tables.drop_tables(spark, "shelf", "t_") == ["t_one", "t_two"]
    spark.sql("DROP DATABASE shelf CASCADE")


def test_models(spark):
    df = spark.range(300).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"))
    df = df.withColumn("target", F.when(F.col("id") % 6 != 0, (F.col("a") > 3).cast("int"))).withColumn("f", F.when(F.col("target").isNotNull(), (F.col("id") % 2).cast("int")))
    cv = models.cross_validate(df, "id", "target", "f", ["a", "b"], "logistic", maxIter=5)
    assert len(cv.scores) == 2 and cv.mean > 0.95 and cv.oof.count() == 250 and cv.test.count() == 50
    assert models.stacked(cv, "id").count() == 300
    assert models.forward_selection(df, "id", "target", "f", ["b"], ["a"])[0] == ["b", "a"]
    holes = df.withColumn("y", F.when(F.col("id") % 4 != 0, 2 * F.col("a") + F.col("b"))).withColumn("g", (F.col("id") % 2).cast("int"))
    filled = models.impute_by_model(holes, "id", "y", ["a", "b"], "g")
    assert filled.filter(F.abs(F.col("y") - 2 * F.col("a") - F.col("b")) < 0.01).count() == 300
    late = models.time_predict(df.withColumn("v", F.col("a") + 1).withColumn("val_label", (F.col("id") > 200).cast("int")), "id", "v", ["a"])
    assert late.count() == 99
    assert models.cross_validate(df, "id", "target", "f", ["b"], "logistic", stops=[2.0], maxIter=2).scores.__len__() == 1


def test_registry_helpers(spark):
    feats = spark.createDataFrame([("sum_price_by_day", "d1"), ("mean_size", "d1")], "feature string, dataset string")
    made = {(r.x, r.y, r.z): r.made for r in assemble.combinations_made([["sum", "mean"], ["price"], ["day"]], feats).collect()}
    assert made == {("sum", "price", "day"): 1, ("mean", "price", "day"): 0}
    usage = assemble.column_usage(feats, ["price", "size", "price"]).collect()
    assert {(r.column, r.n) for r in usage} == {("price", 1), ("size", 1)}
    assert [r.feature for r in assemble.not_containing(feats, ["size"]).collect()] == ["sum_price_by_day"]
    pairs = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.5), ("a", "c", None)], "a string, b string, r double")
    assert assemble.correlation_groups(pairs, 2)[0] == ["a", "b"]


def test_stream_counts(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "event_type")
    src.write.parquet(f"file://{tmp_path}/in")
    stream = daily_counts_stream(spark.readStream.schema(src.schema).parquet(f"file://{tmp_path}/in"), "ts", "event_type")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("SELECT sum(n) AS n FROM counts").first().n == src.count()


def test_ranges_against_plain_python(spark):
    """Running sums, numbers, quantiles, AUC and Gini with scores that are nearly all distinct, ties, nulls and few rows."""
    import random

    import numpy as np
    from pyspark.sql import functions as F

    from featuremill.operators import metrics
    from featuremill.operators.ranges import numbered, quantiles, quantiles_by

    rng = random.Random(4)
    rows = [(k, rng.choice(["a", "b", None]), rng.choice([None, rng.random(), round(rng.random(), 1), 0.5]), int(rng.random() < 0.4)) for k in range(700)]
    df = spark.createDataFrame(rows, "id long, g string, s double, y int")
    got = sorted((r.n, r.id) for r in numbered(df, [F.asc_nulls_last("s"), "id"], "n").collect())
    want = [r[0] for r in sorted(rows, key=lambda r: (r[2] is None, r[2] or 0, r[0]))]
    assert got == [(i + 1, k) for i, k in enumerate(want)]
    ps = [0.0, 0.1, 0.5, 0.77, 1.0]
    values = [r[2] for r in rows if r[2] is not None]
    n, qs = quantiles(df, ["s", "id"], ps)["s"]
    assert n == len(set(values)) and np.allclose(qs, np.quantile(values, ps))
    for r in quantiles_by(df, "g", "s", ps).collect():
        own = [x[2] for x in rows if x[1] == r.g and x[2] is not None]
        assert np.allclose([r[f"q{i}"] for i in range(5)], np.quantile(own, ps))
    pairs = [(x[2], x[3]) for x in rows if x[2] is not None]
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    auc = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg))
    assert abs(metrics.auc(df, "y", "s").first().auc - auc) < 1e-12
    best = metrics.best_f1(df, "y", "s").first()
    f1 = lambda t: 2 * sum(p >= t for p in pos) / (sum(s >= t for s, _ in pairs) + len(pos))
    assert abs(best.f1 - max(map(f1, {s for s, _ in pairs}))) < 1e-12 and abs(f1(best.threshold) - best.f1) < 1e-12

    def gini(t):
        parts = [[y for s, y in pairs if s < t], [y for s, y in pairs if s >= t]]
        return sum(len(p) / len(pairs) * (1 - (sum(p) / len(p)) ** 2 - (1 - sum(p) / len(p)) ** 2) for p in parts)

    split = metrics.best_split(df.filter("s IS NOT NULL"), ["s"], "y").first()
    assert abs(split.impurity - min(gini(t) for t in {s for s, _ in pairs} - {min(s for s, _ in pairs)})) < 1e-12
    nothing = df.limit(0)
    assert numbered(nothing, ["id"], "n").count() == 0 and quantiles(nothing, ["s"], ps) == {} and metrics.auc(nothing, "y", "s").first().auc is None


def test_features_are_saved_once(spark, tmp_path):
    from featuremill.sources import tables

    df = spark.createDataFrame([(1, 0, 1.5, None), (2, None, 2.5, 3.0)], "id long, target int, `a.b` double, c double")
    path = f"file://{tmp_path}/store"
    tables.save_features(df.drop("c"), "id", "target", path)
    registry = tables.save_features(df, "id", "target", path)
    rows = {r.id: (r["a.b"], r.c) for r in tables.load_features(spark, registry, "id").collect()}
    assert rows == {1: (1.5, None), 2: (2.5, 3.0)}
    assert spark.read.parquet(path).count() == 4


def test_stream_trailing(spark, tmp_path):
    """The stream's windows against the same windows over the whole table, by plain pandas."""
    import pandas as pd

    from featuremill.streaming.features import trailing_stream

    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "event_type", "value")
    src.write.parquet(f"file://{tmp_path}/in")
    stream = trailing_stream(spark.readStream.schema(src.schema).parquet(f"file://{tmp_path}/in"), "ts", ["event_type"], "value", 3)
    q = stream.writeStream.outputMode("complete").format("memory").queryName("trailing").option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = src.toPandas()
    got = {(r.until, r.event_type): (r.n, r.low, r.high) for r in spark.sql("SELECT until, event_type, `count` AS n, `min` AS low, `max` AS high FROM trailing").collect()}
    assert got
    for (until, kind), found in got.items():
        own = rows[(rows.event_type == kind) & (rows.ts < pd.Timestamp(until)) & (rows.ts >= pd.Timestamp(until) - pd.Timedelta(days=3))].value
        assert found == (len(own), own.min(), own.max())
