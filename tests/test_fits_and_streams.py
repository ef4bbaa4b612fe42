"""Early stopping, weights, permuted columns, searches and keyed state of streams, against what they must give."""

import random

import pytest
from pyspark.sql import functions as F

from featuremill.operators import models
from featuremill.operators.ranges import range_of
from featuremill.sources.scratch import scratch
from featuremill.streaming.features import decayed_stream, latest, merged_decays, run_into


@pytest.fixture(scope="module")
def rows(spark):
    """y follows a; b and c are noise."""
    rng = random.Random(5)
    made = [(i, rng.random(), rng.random(), rng.random()) for i in range(600)]
    data = [(i, a, b, c, int(a + rng.gauss(0, 0.2) > 0.5), i % 3) for i, a, b, c in made]
    return spark.createDataFrame(data, "id long, a double, b double, c double, y int, f int")


def test_boosting_stops_early_and_no_earlier_score_is_lost(rows):
    p = models.prepare(rows, "id", "y", "f", ["a", "b", "c"])
    stopped = models.validate(p, "gbt", early=True, maxIter=25, maxDepth=4, stepSize=0.5)
    whole = models.validate(p, "gbt", maxIter=25, maxDepth=4, stepSize=0.5)
    assert whole.trees == [25] * 3 and max(stopped.trees) < 25
    assert stopped.mean > whole.mean and stopped.oof.count() == 600
    with pytest.raises(ValueError):
        models.validate(p, "logistic", early=True)


def test_rows_without_weight_do_not_train(rows):
    poisoned = rows.select("id", "a", "f", F.expr("CASE WHEN id % 4 = 0 THEN 1000.0 ELSE 2 * a END").alias("y"), F.expr("CASE WHEN id % 4 <> 0 THEN 1.5 WHEN id % 8 = 0 THEN 0.0 END").alias("w"))
    # a tree errs within the range of its targets, 0 to 2; a single 1000 in a leaf of 100 rows would move it by 10
    for kind, params, most in (("linear", {"indicators": False}, 1e-6), ("gbt_regression", {"maxIter": 3, "maxDepth": 4}, 2), ("forest_regression", {"numTrees": 3}, 2)):
        cv = models.cross_validate(poisoned, "id", "y", "f", ["a"], kind, weight="w", **params)
        worst = cv.oof.join(rows.select("id", "a"), "id").agg(F.max(F.abs(F.col("prediction") - 2 * F.col("a"))), F.count("*")).first()
        assert worst[0] < most and worst[1] == 600


def test_sliced_columns_give_what_their_own_matrix_gives(rows):
    p = models.prepare(rows, "id", "y", "f", ["a", "b", "c"])
    sliced = models.validate(p, "logistic", ["c", "a"], maxIter=20)
    own = models.cross_validate(rows, "id", "y", "f", ["c", "a"], "logistic", maxIter=20)
    assert sliced.scores == pytest.approx(own.scores, abs=1e-9)
    assert {r.feature: r.importance for r in sliced.importance.collect()} == pytest.approx({r.feature: r.importance for r in own.importance.collect()})


def test_trials_side_by_side_give_what_they_give_one_by_one(rows):
    grid = [{"regParam": r, "maxIter": 10} for r in (0.0, 0.1, 1.0)]
    assert models.grid_search(rows, "id", "y", "f", ["a", "b"], "logistic", grid, 3) == models.grid_search(rows, "id", "y", "f", ["a", "b"], "logistic", grid, 1)


def test_next_points_gather_where_trials_are_good():
    rng = random.Random(1)
    seen = [(-((x - 0.8) ** 2), {"r": x}) for x in (rng.random() for _ in range(40))]
    points = models.next_points(seen, {"r": (0.0, 1.0)}, 50, rng)
    assert sum(abs(p["r"] - 0.8) < 0.3 for p in points) > 40 and all(0 <= p["r"] <= 1 for p in points)


def test_partners_are_a_permutation_and_the_signal_ranks_first(rows):
    met = models.partnered(rows, "id", ["id"])
    assert met.filter("_p0 = id").count() == 0 and met.select("_p0").distinct().count() == 600
    predict = models.fitted(rows.filter("f > 0"), "y", ["b", "a", "c"], "gbt", maxIter=5)
    found = {r.feature: r.importance for r in models.permutation_importance(rows.filter("f = 0"), "id", "y", ["b", "a", "c"], predict, "auc").collect()}
    assert found["a"] > 0.2 and abs(found["b"]) < 0.08 and abs(found["c"]) < 0.08


def _stream(spark, batches):
    """A stream whose batches are ``batches`` of (entity, timestamp, value)."""
    path = scratch(spark, "in")
    schema = "e string, ts timestamp, v double"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "e string, ts string, v double").select("e", F.col("ts").cast("timestamp").alias("ts"), "v").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_decayed_state_takes_late_rows_nulls_and_hot_keys(spark):
    batches = [[("a", "2024-01-10", 4.0), ("a", "2024-01-01", 1.0), (None, "2024-01-01", 3.0)], [("a", "2024-01-05", None), ("a", "2023-12-01", 7.0), ("b", "2024-01-05", None)]]
    batches += [[("hot", f"2024-02-{1 + i % 20:02d}", float(i)) for i in range(300)]]
    got = {}
    for salt in (1, 7):
        states = run_into(decayed_stream(_stream(spark, batches), "ts", ["e"], "v", 0.9, salt), scratch(spark, "out"), scratch(spark, "ck"), 300)
        got[salt] = {r.e: r.mean for r in merged_decays(latest(states, ["e", "salt"]), ["e"], 0.9).collect()}
    a = [(0, 4.0), (9, 1.0), (5, None), (40, 7.0)]
    hot = [(19 - i % 20, float(i)) for i in range(300)]
    want = {"a": a, None: [(0, 3.0)], "hot": hot}
    want = {e: sum(v * 0.9**d for d, v in x if v is not None) / sum(0.9**d for d, _ in x) for e, x in want.items()} | {"b": None}
    assert got[1] == pytest.approx(want) and got[7] == pytest.approx(want)


def test_states_go_after_their_time(spark):
    batches = [[("a", "2024-01-01", 1.0)], [("b", "2024-03-01", 2.0)], [("b", "2024-03-02", 2.0)], [("a", "2024-03-03", 5.0)]]
    states = run_into(decayed_stream(_stream(spark, batches), "ts", ["e"], "v", 0.5, 1, keep=10), scratch(spark, "out"), scratch(spark, "ck"), 300)
    last = {r.e: (r.n, r.top) for r in latest(states, ["e", "salt"]).collect()}
    assert last["a"] == (1, 5.0)


def test_trials_are_scored_together(spark, monkeypatch):
    """The scores of a round's fits are those of each fit alone, by one AUC; ranges are the numbers of cuts below a value."""
    rows = [(k, k % 3, float(k * 7 % 11), float(k * k % 5), k % 4 if k % 4 < 2 else int(k * 7 % 11 > 5)) for k in range(300)]
    df = spark.createDataFrame(rows, "k long, f int, a double, b double, y int")
    p = models.prepare(df, "k", "y", "f", ["a", "b"])
    trials = [(["a", "b"], {"regParam": 0.0, "maxIter": 3}), (["b"], {"regParam": 0.2, "maxIter": 3})]
    alone = [models.validate(p, "logistic", c, **x).scores for c, x in trials]
    calls, auc = [], models.auc
    monkeypatch.setattr(models, "auc", lambda *a: calls.append(a) or auc(*a))
    assert [cv.scores for cv in models.tried(p, "logistic", trials)] == alone and len(alone[0]) == 3 and len(calls) == 1
    assert [cv.scores for cv in models.tried(p, "linear", [(["a"], {})])][0] == pytest.approx(models.validate(p, "linear", ["a"]).scores)


def test_range_of(spark):
    at = [-1.0, 0.5, 0.5000001, 3.0, 7.0]
    values = [None, float("nan"), float("-inf"), -1.0, -0.5, 0.5, 0.50000005, 1.0, 3.0, 3.5, 7.0, 8.0]
    got = [r[1] for r in spark.createDataFrame([(v,) for v in values], "v double").select("v", range_of(F.col("v"), at)).collect()]
    assert got == [0, 5, 0, 0, 1, 1, 2, 3, 3, 4, 4, 5]
