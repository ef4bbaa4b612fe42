"""Training and prediction on Spark ML by fold columns."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator
from pyspark.ml.classification import FMClassifier, GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import FMRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .metrics import auc
from .ranges import numbered

SEED = 1208
MODELS: dict[str, Callable[..., Estimator]] = {
    "gbt": GBTClassifier,
    "forest": RandomForestClassifier,
    "logistic": LogisticRegression,
    "fm": FMClassifier,
    "network": MultilayerPerceptronClassifier,
    "gbt_regression": GBTRegressor,
    "forest_regression": RandomForestRegressor,
    "linear": LinearRegression,
    "ridge": lambda **p: LinearRegression(**{"regParam": 1.0, "elasticNetParam": 0.0} | p),
    "lasso": lambda **p: LinearRegression(**{"regParam": 1.0, "elasticNetParam": 1.0} | p),
    "fm_regression": FMRegressor,
}
SEEDED = {"gbt", "forest", "fm", "network", "gbt_regression", "forest_regression", "fm_regression"}


def estimator(kind: str, label: str, weight: str | None = None, seed: int = SEED, **params) -> Estimator:
    given = {"featuresCol": "_x", "labelCol": label} | ({"seed": seed} if kind in SEEDED else {}) | ({"weightCol": weight} if weight else {})
    return MODELS[kind](**given | params)


def assembled(df: DataFrame, columns: Sequence[str], indicators: bool = True) -> DataFrame:
    """Features as a vector; nulls count as 0 beside an indicator, which every estimator can read. Where no column has
    nulls, ``indicators=False`` leaves the constant ones out, so that linear fits have a closed form."""
    filled = [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(f"_f{i}") for i, c in enumerate(columns)]
    missing = [F.col(f"`{c}`").isNull().cast("double").alias(f"_n{i}") for i, c in enumerate(columns)] if indicators else []
    wide = df.select("*", *filled, *missing)
    parts = [f"_f{i}" for i in range(len(columns))] + [f"_n{i}" for i in range(len(missing))]
    return VectorAssembler(inputCols=parts, outputCol="_x").transform(wide).drop(*parts)


def scored(model, df: DataFrame, key: str, keep: Sequence[str] = ()) -> DataFrame:
    out = model.transform(df.drop("prediction"))
    p = vector_to_array("probability")[1] if "probability" in out.columns else F.col("prediction")
    return out.select(key, p.cast("double").alias("prediction"), *keep)


def importances(model, columns: Sequence[str]) -> list[tuple[str, float]]:
    if hasattr(model, "featureImportances"):
        values = model.featureImportances.toArray()
    elif hasattr(model, "coefficients"):
        values = abs(model.coefficients.toArray())
    else:
        return []
    n = len(columns)
    return [(c, float(values[i::n].sum())) for i, c in enumerate(columns)]


@dataclass
class CrossValidated:
    scores: list[float]
    oof: DataFrame
    test: DataFrame
    importance: DataFrame | None
    trees: list[int]

    @property
    def mean(self) -> float:
        return sum(self.scores) / len(self.scores)


@dataclass
class Prepared:
    """Model rows, assembled and written once; any number of fits, over any of the columns, read them."""

    rows: DataFrame
    key: str
    target: str
    fold: str
    columns: list[str]
    weight: str | None
    indicators: bool
    folds: list[int]

    def over(self, columns: Sequence[str]) -> DataFrame:
        """The rows with ``_x`` cut to ``columns``."""
        if list(columns) == self.columns:
            return self.rows
        at, n = [self.columns.index(c) for c in columns], len(self.columns)
        slicer = VectorSlicer(inputCol="_whole", outputCol="_x", indices=at + [n + i for i in at] if self.indicators else at)
        return slicer.transform(self.rows.withColumnRenamed("_x", "_whole")).drop("_whole")


def prepare(df: DataFrame, key: str, target: str, fold: str, columns: Sequence[str], weight: str | None = None, indicators: bool = True) -> Prepared:
    """Runs a job that writes the rows, and one that lists the folds."""
    own = [c for c in (key, target, fold, weight) if c]
    wide = df.select(*own, *[F.col(f"`{c}`") for c in columns if c not in own])
    rows = stored(assembled(wide, columns, indicators).select(*own, "_x"), "model-rows")
    found = rows.filter(F.col(target).isNotNull() & F.col(fold).isNotNull()).select(fold).distinct().collect()
    return Prepared(rows, key, target, fold, list(columns), weight, indicators, sorted(r[0] for r in found))


def _is_regression(kind: str) -> bool:
    return kind.endswith("regression") or kind in ("linear", "ridge", "lasso")


def validate(p: Prepared, kind: str, columns: Sequence[str] | None = None, stops: Sequence[float] = (), seed: int = SEED, early: bool = False, score: bool = True, **params) -> CrossValidated:
    """A model per fold: score (AUC, or minus RMSE for regressions), out-of-fold predictions, the test rows' mean
    prediction (test: target null), importances, the number of trees.

    ``stops``: least cumulative scores; below one, no further folds. ``early`` (boosted trees): no more trees once the error on
    the fold's own rows has stopped to fall. Rows whose weight is null or not above 0 do not train, but are predicted.
    Without ``score`` no scores are taken, for ``scores_of`` to take those of many fits at once."""
    columns = p.columns if columns is None else list(columns)
    if early and not kind.startswith("gbt"):
        raise ValueError("only boosted trees stop early")
    rows, key, target, fold = p.over(columns), p.key, p.target, p.fold
    known, test = rows.filter(F.col(target).isNotNull()), rows.filter(F.col(target).isNull())
    fitted = known.withColumn(target, F.col(target).cast("double"))
    if p.weight:
        fitted = fitted.filter(F.col(p.weight) > 0).withColumn(p.weight, F.col(p.weight).cast("double"))
    scores, oofs, tests, gains, trees = [], [], [], [], []
    for k in p.folds:
        held = F.col(fold).eqNullSafe(F.lit(k))
        if early:
            model = estimator(kind, target, p.weight, seed, validationIndicatorCol="_held", **params).fit(fitted.withColumn("_held", held))
        else:
            model = estimator(kind, target, p.weight, seed, **params).fit(fitted.filter(~held))
        oof = scored(model, known.filter(held), key, [target, fold])
        oofs.append(oof)
        tests.append(scored(model, test, key))
        gains += [(c, k, g) for c, g in importances(model, columns)]
        if hasattr(model, "getNumTrees"):
            trees.append(model.getNumTrees if isinstance(model.getNumTrees, int) else model.getNumTrees())
        if not score:
            continue
        if _is_regression(kind):
            scores.append(-oof.agg(F.sqrt(F.avg(F.pow(F.col(target) - F.col("prediction"), 2)))).first()[0])
        else:
            scores.append(auc(oof, target, "prediction").first()[0])
        if len(scores) <= len(stops) and sum(scores) < stops[len(scores) - 1]:
            break
    mean_test = reduce(DataFrame.union, tests).groupBy(key).agg(F.avg("prediction").alias("prediction"))
    table = rows.sparkSession.createDataFrame(gains, "feature string, fold int, importance double") if gains else None
    merged = table.groupBy("feature").agg(F.avg("importance").alias("importance")) if table else None
    return CrossValidated(scores, reduce(DataFrame.union, oofs), mean_test, merged, trees)


def cross_validate(df: DataFrame, key: str, target: str, fold: str, columns: Sequence[str], kind: str = "logistic", stops: Sequence[float] = (), seed: int = SEED, weight: str | None = None, early: bool = False, indicators: bool = True, **params) -> CrossValidated:
    """``validate`` on rows written for it alone."""
    return validate(prepare(df, key, target, fold, columns, weight, indicators), kind, None, stops, seed, early, **params)


#: Fits that run at a time; each is a chain of small jobs that leaves most of a cluster idle.
AT_A_TIME = 4


def tried(p: Prepared, kind: str, trials: Sequence[tuple[Sequence[str], dict]], at_a_time: int = AT_A_TIME, score: bool = True) -> list[CrossValidated]:
    """``validate`` for each (columns, parameters), ``at_a_time`` of them side by side over the one written matrix; the held-out
    predictions of all fits are written once and scored together."""
    run = inheritable_thread_target(p.rows.sparkSession)(lambda trial: validate(p, kind, trial[0], **({"score": bool(trial[1].get("stops"))} | trial[1])))
    with ThreadPoolExecutor(at_a_time) as pool:
        found = list(pool.map(run, trials))
    if score:
        _score(p, kind, [cv for cv in found if not cv.scores])
    return found


def _score(p: Prepared, kind: str, fits: Sequence[CrossValidated]) -> None:
    """Fills in the ``scores`` of ``fits``, by one job over the predictions of them all."""
    if not fits or not p.folds:
        return
    oofs = [cv.oof.select(F.lit(i).alias("_trial"), F.col(p.fold).alias("_fold"), F.col(p.target).alias("_y"), "prediction") for i, cv in enumerate(fits)]
    rows = stored(reduce(DataFrame.union, oofs), "held-out")
    if _is_regression(kind):
        by = rows.groupBy("_trial", "_fold").agg((-F.sqrt(F.avg(F.pow(F.col("_y") - F.col("prediction"), 2)))).alias("score"))
    else:
        by = auc(rows, "_y", "prediction", ["_trial", "_fold"]).withColumnRenamed("auc", "score")
    of = {(r["_trial"], r["_fold"]): r["score"] for r in by.collect()}
    for i, cv in enumerate(fits):
        cv.scores.extend(of.get((i, k)) for k in p.folds)


def stacked(result: CrossValidated, key: str) -> DataFrame:
    """Out-of-fold and test predictions of every key."""
    return result.oof.select(key, "prediction").union(result.test)


def seed_average(df: DataFrame, key: str, target: str, fold: str, columns: Sequence[str], kind: str, seeds: Sequence[int], **params) -> DataFrame:
    p = prepare(df, key, target, fold, columns)
    parts = [stacked(cv, key) for cv in tried(p, kind, [(columns, {"seed": s} | params) for s in seeds], score=False)]
    return reduce(DataFrame.union, parts).groupBy(key).agg(F.avg("prediction").alias("prediction"))


def fitted(df: DataFrame, target: str, columns: Sequence[str], kind: str, weight: str | None = None, indicators: bool = True, **params) -> Callable[[DataFrame], DataFrame]:
    """A function that adds ``prediction`` to a frame with ``columns``, by a model of the rows of ``df`` with a target."""
    rows = assembled(df, columns, indicators).filter(F.col(target).isNotNull()).withColumn(target, F.col(target).cast("double"))
    if weight:
        rows = rows.filter(F.col(weight) > 0).withColumn(weight, F.col(weight).cast("double"))
    model = estimator(kind, target, weight, **params).fit(rows)

    def predict(new: DataFrame) -> DataFrame:
        out = model.transform(assembled(new, columns, indicators))
        if "probability" in out.columns:
            out = out.withColumn("prediction", vector_to_array("probability")[1])
        return out.select(*[F.col(f"`{c}`") for c in new.columns], "prediction")

    return predict


def train_predict(df: DataFrame, key: str, target: str, columns: Sequence[str], kind: str, **params) -> DataFrame:
    """Fitted on all rows with a target; predictions of the others."""
    rows = assembled(df, columns)
    model = estimator(kind, target, **params).fit(rows.filter(F.col(target).isNotNull()).withColumn(target, F.col(target).cast("double")))
    return scored(model, rows.filter(F.col(target).isNull()), key)


def time_predict(df: DataFrame, key: str, target: str, columns: Sequence[str], label: str = "val_label", kind: str = "linear", **params) -> DataFrame:
    """Trained before the cut on log1p of the target; predictions after it, transformed back."""
    rows = assembled(df.withColumn("_y", F.log1p(target)), columns)
    model = estimator(kind, "_y", **params).fit(rows.filter(F.col(label) == 0))
    return scored(model, rows.filter(F.col(label) == 1), key, [target]).withColumn("prediction", F.expm1("prediction"))


def impute_by_model(df: DataFrame, key: str, column: str, columns: Sequence[str], fold: str, least: float = 0.25, kind: str = "linear") -> DataFrame:
    """Nulls of ``column`` by regression on ``columns``, if its cross-validated R² reaches ``least``; else unchanged."""
    cv = cross_validate(df, key, column, fold, columns, kind)
    r2 = cv.oof.agg(1 - F.try_divide(F.sum(F.pow(F.col(column) - F.col("prediction"), 2)), F.var_pop(column) * F.count(column))).first()[0]
    if r2 is None or r2 < least:
        return df
    p = cv.test.select(key, F.col("prediction").alias("_p"))
    return df.join(p, key, "left").select(*[F.coalesce(c, "_p").alias(c) if c == column else F.col(c) for c in df.columns])


def grid_search(df: DataFrame, key: str, target: str, fold: str, columns: Sequence[str], kind: str, grid: Sequence[dict], at_a_time: int = AT_A_TIME) -> list[tuple[float, dict]]:
    """(mean score, parameters) of each grid point, best first."""
    found = tried(prepare(df, key, target, fold, columns), kind, [(columns, g) for g in grid], at_a_time)
    return sorted(((cv.mean, g) for cv, g in zip(found, grid)), key=lambda x: -x[0])


def random_search(df: DataFrame, key: str, target: str, fold: str, columns: Sequence[str], kind: str, ranges: dict[str, tuple[float, float]], trials: int, seed: int = SEED) -> list[tuple[float, dict]]:
    rng = random.Random(seed)
    return grid_search(df, key, target, fold, columns, kind, [{n: rng.uniform(*r) for n, r in ranges.items()} for _ in range(trials)])


def _parzen(x: float, centres: Sequence[float], low: float, high: float) -> float:
    """Density at ``x`` of normal kernels around ``centres`` beside a flat one over the range."""
    width = (high - low) / max(2.0, len(centres) ** 0.5) or 1.0
    peaks = sum(math.exp(-(((x - c) / width) ** 2) / 2) / (width * math.sqrt(2 * math.pi)) for c in centres)
    return (peaks + 1 / ((high - low) or 1.0)) / (len(centres) + 1)


def next_points(seen: Sequence[tuple[float, dict]], ranges: dict[str, tuple[float, float]], n: int, rng: random.Random, good: float = 0.25, drawn: int = 24) -> list[dict]:
    """``n`` points where trials like the best ``good`` share of ``seen`` are dense and others are not (Parzen estimators)."""
    order = sorted(seen, key=lambda x: -x[0])
    cut = max(1, math.ceil(good * len(order)))
    out = []
    for _ in range(n):
        point = {}
        for name, (low, high) in ranges.items():
            best, rest = [x[name] for _, x in order[:cut]], [x[name] for _, x in order[cut:]]
            width = (high - low) / max(2.0, len(best) ** 0.5)
            draws = [min(high, max(low, rng.gauss(rng.choice(best), width))) for _ in range(drawn)]
            point[name] = max(draws, key=lambda x: _parzen(x, best, low, high) / _parzen(x, rest, low, high))
        out.append(point)
    return out


def parzen_search(df: DataFrame, key: str, target: str, fold: str, columns: Sequence[str], kind: str, ranges: dict[str, tuple[float, float]], trials: int, start: int = 8, at_a_time: int = AT_A_TIME, seed: int = SEED, **params) -> list[tuple[float, dict]]:
    """(mean score, parameters), best first: ``start`` random points, then rounds of ``at_a_time`` points by ``next_points``."""
    rng, p = random.Random(seed), prepare(df, key, target, fold, columns)
    seen: list[tuple[float, dict]] = []
    while len(seen) < trials:
        if len(seen) < start:
            points = [{n: rng.uniform(*r) for n, r in ranges.items()} for _ in range(min(start, trials))]
        else:
            points = next_points(seen, ranges, min(at_a_time, trials - len(seen)), rng)
        seen += [(cv.mean, x) for cv, x in zip(tried(p, kind, [(columns, x | params) for x in points], at_a_time), points)]
    return sorted(seen, key=lambda x: -x[0])


def forward_selection(df: DataFrame, key: str, target: str, fold: str, start: Sequence[str], candidates: Sequence[str], kind: str = "logistic") -> tuple[list[str], float]:
    """Adds each candidate in turn and keeps it if the mean score rises."""
    kept, p = list(start), prepare(df, key, target, fold, list(dict.fromkeys([*start, *candidates])))
    best = validate(p, kind, kept).mean if kept else float("-inf")
    for c in candidates:
        score = validate(p, kind, [*kept, c]).mean
        if score > best:
            kept, best = [*kept, c], score
    return kept, best


def random_decrease(df: DataFrame, key: str, target: str, fold: str, columns: Sequence[str], batch: int, rounds: int, kind: str = "logistic", seed: int = SEED, **params) -> list[tuple[float, list[str]]]:
    """(score, columns) of random drops of ``batch`` columns, best first."""
    rng = random.Random(seed)
    left = [sorted(set(columns) - set(rng.sample(sorted(columns), min(batch, len(columns) - 1)))) for _ in range(rounds)]
    found = tried(prepare(df, key, target, fold, columns), kind, [(c, params) for c in left])
    return sorted(((cv.mean, c) for cv, c in zip(found, left)), key=lambda x: -x[0])


def partnered(df: DataFrame, key: str, columns: Sequence[str], seed: int = SEED) -> DataFrame:
    """``df`` with ``_p0``, ``_p1``, …: the values of ``columns`` in the row that follows in the order of MD5(key|seed), the
    last row's follower being the first. Every value is met once, so each column is permuted. Runs jobs (row numbers by ranges)."""
    order = [F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))).cast("binary")), F.col(key)]
    placed = stored(numbered(df, order, "_place"), "placed")
    n = placed.count()
    other = placed.select((F.when(F.col("_place") == 1, n).otherwise(F.col("_place") - 1)).alias("_place"), *[F.col(f"`{c}`").alias(f"_p{i}") for i, c in enumerate(columns)])
    return placed.join(other, "_place").drop("_place")


def permutation_importance(df: DataFrame, key: str, target: str, columns: Sequence[str], predict: Callable[[DataFrame], DataFrame], score: str = "rmse", seed: int = SEED) -> DataFrame:
    """(feature, importance): by how much the score (``rmse`` rises, ``auc`` falls) gets worse when a column is permuted.

    No refit: each row is predicted as it is and once a column with its partner's value there, all in one pass. ``predict`` adds
    ``prediction`` to a frame that holds ``columns``, ``target`` and ``_at``. Rows without a target do not count."""
    rows = partnered(df.filter(F.col(target).isNotNull()).select(key, target, *[F.col(f"`{c}`") for c in columns]), key, columns, seed)
    long = rows.withColumn("_at", F.explode(F.sequence(F.lit(0), F.lit(len(columns)))))
    swapped = [F.when(F.col("_at") == i + 1, F.col(f"_p{i}")).otherwise(F.col(f"`{c}`")).alias(c) for i, c in enumerate(columns)]
    found = predict(long.select(key, target, "_at", *swapped))
    if score == "auc":
        by = auc(stored(found.select(target, "prediction", "_at"), "permuted"), target, "prediction", ["_at"]).select("_at", (-F.col("auc")).alias("loss"))
    else:
        by = found.groupBy("_at").agg(F.sqrt(F.avg(F.pow(F.col(target) - F.col("prediction"), 2))).alias("loss"))
    losses = by.agg(F.map_from_entries(F.collect_list(F.struct("_at", "loss"))).alias("of"))  # a row a column
    names = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(i + 1).alias("at")) for i, c in enumerate(columns)])).alias("x")
    return losses.select("of", names).select("x.feature", (F.try_element_at("of", F.col("x.at")) - F.try_element_at("of", F.lit(0))).alias("importance"))


def clusters(df: DataFrame, columns: Sequence[str], k: int = 10, seed: int = SEED) -> DataFrame:
    """``cluster`` beside each row."""
    rows = assembled(df, columns)
    return KMeans(featuresCol="_x", predictionCol="cluster", k=k, seed=seed).fit(rows).transform(rows).drop("_x")


def demote_by_chunks(df: DataFrame, key: str, target: str, fold: str, candidates: Sequence[str], ranks: Sequence[int], chunk: int = 1000, kind: str = "forest", **params) -> list[tuple[int, list[str], float, list[str]]]:
    """(chunk number, its columns, mean score, kept columns) of each chunk of sorted ``candidates``.

    A chunk is scored once per rank in turn: columns beyond the rank, by mean importance and then name, go."""
    names, out = sorted(candidates), []
    p = prepare(df, key, target, fold, names)
    for at in range(0, len(names), chunk):
        kept, score = names[at : at + chunk], float("-inf")
        for rank in ranks:
            cv = validate(p, kind, kept, **params)
            score, gains = cv.mean, {r.feature: r.importance for r in cv.importance.collect()}
            kept = sorted(sorted(kept, key=lambda c: (-gains.get(c, 0.0), c))[:rank])
        out.append((at // chunk, names[at : at + chunk], score, kept))
    return out
