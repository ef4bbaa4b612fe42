"""Field-aware factorisation machines: the gradient by differences, planted field effects, rows without values."""

import math

import numpy as np
import pytest
from pyspark.ml.classification import FMClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from featuremill.operators import ffm


def test_gradient_is_the_losses_slope():
    rng = np.random.default_rng(3)
    codes, x, y = rng.integers(0, 5, (40, 3)), rng.normal(size=(40, 3)), rng.integers(0, 2, 40).astype(float)
    w = ffm.Weights(0.3, rng.normal(size=5), rng.normal(size=(5, 3, 2)))
    _, g = ffm.gradient(codes, x, y, w)
    for part, own in ((w.linear, g.linear), (w.latent, g.latent)):
        for at in np.ndindex(part.shape):
            part[at] += 1e-6
            up = ffm.gradient(codes, x, y, w)[0]
            part[at] -= 2e-6
            down = ffm.gradient(codes, x, y, w)[0]
            part[at] += 1e-6
            assert own[at] == pytest.approx((up - down) / 2e-6, abs=1e-4)
    up, down = (ffm.gradient(codes, x, y, ffm.Weights(b, w.linear, w.latent))[0] for b in (0.3 + 1e-6, 0.3 - 1e-6))
    assert g.bias == pytest.approx((up - down) / 2e-6, abs=1e-4)


@pytest.fixture(scope="module")
def planted(spark):
    """What a does to b and what it does to c have nothing to do with each other."""
    rng = np.random.default_rng(8)
    ab, ac, bc = (rng.normal(size=(8, 2)) @ rng.normal(size=(2, 8)) for _ in range(3))
    a, b, c = rng.integers(0, 8, (3, 6000))
    y = (rng.random(6000) < 1 / (1 + np.exp(-2 * (ab[a, b] + ac[a, c] + bc[b, c])))).astype(int)
    data = [(i, f"a{a[i]}", f"b{b[i]}", f"c{c[i]}", int(y[i])) for i in range(6000)]
    return spark.createDataFrame(data, "k long, a string, b string, c string, y int")


def log_loss(rows):
    return -sum(math.log(max(1e-12, r.p if r.y else 1 - r.p)) for r in rows) / len(rows)


def test_planted_field_effects_beat_the_plain_machine(planted):
    train, held = planted.filter("k % 4 <> 0"), planted.filter("k % 4 = 0")
    model = ffm.fit(train, "k", "y", [], ["a", "b", "c"], factors=2, epochs=30, batches=2)
    assert model.losses[-1] < model.losses[0]
    got = ffm.predict(held, model, "k").join(held, "k").select("y", F.col("prediction").alias("p")).collect()
    assert len(got) == held.count()
    hot = array_to_vector(F.array(*[(F.col(f) == f"{f}{i}").cast("double") for f in "abc" for i in range(8)]))
    plain = FMClassifier(labelCol="y", featuresCol="x", factorSize=2, maxIter=200, stepSize=0.1, seed=1).fit(train.withColumn("x", hot))
    other = plain.transform(held.withColumn("x", hot)).select("y", vector_to_array("probability")[1].alias("p")).collect()
    assert log_loss(got) < 0.9 * log_loss(other)


def test_rows_without_values_and_targets(spark):
    rows = spark.createDataFrame([(1, 1.0, "u", 1), (2, None, "u", 0), (3, float("inf"), None, 1), (4, 2.0, "v", None), (None, float("nan"), "u", 0)], "k long, q double, c string, y int")
    model = ffm.fit(rows, "k", "y", ["q"], ["c"], factors=2, epochs=2)
    assert [r.value for r in model.codes.collect()] == ["u"]
    got = ffm.predict(rows, model, "k").collect()
    assert len(got) == 5 and all(0 < r.prediction < 1 for r in got)
    by_key = {r.k: r.prediction for r in got}
    assert by_key[3] == pytest.approx(1 / (1 + math.exp(-model.weights.bias)))  # nothing but the bias
    with pytest.raises(ValueError):
        ffm.fit(rows.filter("y > 1"), "k", "y", ["q"], ["c"])
    with pytest.raises(ValueError):
        ffm.start(ffm.MOST_WEIGHTS, 2, 2)


def test_no_category_and_partitions_do_not_matter(planted):
    numbers = planted.select("k", "y", (F.hash("a") % 7).alias("q"))
    one, many = (ffm.fit(numbers.repartition(n), "k", "y", ["q"], [], factors=2, epochs=2, batches=2) for n in (1, 5))
    assert one.weights.linear == pytest.approx(many.weights.linear)
