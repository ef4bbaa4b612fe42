"""Field-aware factorisation machines for a binary target: every feature holds one latent vector per field it meets.

Rows hold one feature a field: a number's own code, or the code of a category's value. A step sums the gradient over
the rows of a mini-batch in tasks, adds it up by weight in a shuffle, and updates the weights at the driver by their accumulated
squares. Only weights reach the driver, and their number is checked, as every task holds them.

Defined cases: a null, NaN or infinite number, a null category and one that training did not see have no effect; rows without a target do not
train, but are predicted; no rows to train on is an error.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored
from ..sources.tables import field_codes, with_field_codes

#: Most weights of a model (8 bytes each, at the driver and in every task).
MOST_WEIGHTS = 1 << 24
SEED = 1208


@dataclass
class Weights:
    bias: float
    linear: np.ndarray
    latent: np.ndarray  # features x fields x factors


@dataclass
class FieldAware:
    numbers: list[str]
    categories: list[str]
    codes: DataFrame
    weights: Weights
    losses: list[float] = field(default_factory=list)


def scores(codes: np.ndarray, x: np.ndarray, w: Weights) -> np.ndarray:
    """The logit of each row; ``codes``, ``x``: rows x fields."""
    out = w.bias + (w.linear[codes] * x).sum(axis=1)
    for f, g in combinations(range(codes.shape[1]), 2):
        out += (w.latent[codes[:, f], g] * w.latent[codes[:, g], f]).sum(axis=1) * x[:, f] * x[:, g]
    return out


def gradient(codes: np.ndarray, x: np.ndarray, y: np.ndarray, w: Weights) -> tuple[float, Weights]:
    """(loss, gradient) summed over the rows: minus the log likelihood of ``y``, and its derivatives."""
    z = scores(codes, x, w)
    loss = float(np.logaddexp(0.0, np.where(y > 0, -z, z)).sum())
    r = 1.0 / (1.0 + np.exp(-z)) - y
    out = Weights(float(r.sum()), np.zeros_like(w.linear), np.zeros_like(w.latent))
    np.add.at(out.linear, codes, r[:, None] * x)
    for f, g in combinations(range(codes.shape[1]), 2):
        a, b, e = codes[:, f], codes[:, g], (r * x[:, f] * x[:, g])[:, None]
        np.add.at(out.latent, (a, g), e * w.latent[b, f])
        np.add.at(out.latent, (b, f), e * w.latent[a, g])
    return loss, out


def _arrays(batch: pa.RecordBatch, fields: int) -> tuple[np.ndarray, np.ndarray]:
    codes, x = (batch.column(n).flatten().to_numpy(zero_copy_only=False).reshape(-1, fields) for n in ("_codes", "_x"))
    return codes, x


def _coded(df: DataFrame, codes: DataFrame, numbers: Sequence[str], categories: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """``keep``, ``_codes`` and ``_x`` (0 where a field has no effect) of every row."""
    joined = with_field_codes(df, codes, numbers, categories)
    value = [F.col(f"`{c}`").cast("double") for c in numbers]
    finite = [v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))) for v in value]
    at = [F.lit(i) for i in range(len(numbers))] + [F.coalesce(F.col(f"_c_{c}"), F.lit(0)) for c in categories]
    x = [F.when(ok, v).otherwise(0.0) for ok, v in zip(finite, value)] + [F.col(f"_c_{c}").isNotNull().cast("double") for c in categories]
    return joined.select(*keep, F.array(*[a.cast("int") for a in at]).alias("_codes"), F.array(*x).alias("_x"))


def summed_gradient(rows: DataFrame, w: Weights) -> DataFrame:
    """(feature, at, sum) over ``rows`` (_codes, _x, _y): ``at`` 0 is the linear weight, then field by field the factors.

    Feature -1 holds the bias' sum, the loss and the number of rows. Tasks add up their own rows first."""
    sc = rows.sparkSession.sparkContext
    shared, fields = sc.broadcast(w), w.latent.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = shared.value
        bias, loss, n = 0.0, 0.0, 0
        flat = np.zeros((len(now.linear), 1 + now.latent[0].size))
        for batch in batches:
            if batch.num_rows:
                codes, x = _arrays(batch, fields)
                more, g = gradient(codes, x, batch.column("_y").to_numpy(zero_copy_only=False), now)
                bias, loss, n = bias + g.bias, loss + more, n + batch.num_rows
                flat[:, 0] += g.linear
                flat[:, 1:] += g.latent.reshape(len(flat), -1)
        feature, at = np.nonzero(flat)
        columns = [np.concatenate([[-1] * 3, feature]).astype(np.int32), np.concatenate([range(3), at]).astype(np.int32), np.concatenate([[bias, loss, n], flat[feature, at]])]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["feature", "at", "sum"])

    return rows.select("_codes", "_x", "_y").mapInArrow(run, "feature int, at int, sum double").groupBy("feature", "at").agg(F.sum("sum").alias("sum"))


def _stepped(now: Weights, squares: Weights, sums: pa.Table, rate: float, penalty: float) -> tuple[float, int]:
    """One update in place; (loss, rows) of the batch before it."""
    feature, at, total = (sums.column(c).to_numpy() for c in ("feature", "at", "sum"))
    head = dict(zip(at[feature < 0], total[feature < 0]))
    n = int(head.get(2, 0))
    if not n:
        return 0.0, 0
    flat = np.zeros((len(now.linear), 1 + now.latent[0].size))
    own = feature >= 0
    flat[feature[own], at[own]] = total[own] / n
    moved = flat != 0
    bias = head[0] / n
    squares.bias += bias * bias
    now.bias -= rate * bias / np.sqrt(squares.bias + 1e-12)
    for part, seen, g, m in ((now.linear, squares.linear, flat[:, 0], moved[:, 0]), (now.latent, squares.latent, flat[:, 1:].reshape(now.latent.shape), moved[:, 1:].reshape(now.latent.shape))):
        step = np.where(m, g + penalty * part, 0.0)
        seen += step * step
        part -= rate * step / np.sqrt(seen + 1e-12)
    return float(head[1]), n


def start(features: int, fields: int, factors: int, seed: int = SEED) -> Weights:
    size = features * (1 + fields * factors)
    if size > MOST_WEIGHTS:
        raise ValueError(f"{size} weights: more than {MOST_WEIGHTS}; use fewer categories or factors")
    latent = np.random.default_rng(seed).uniform(-0.5, 0.5, (features, fields, factors)) / np.sqrt(factors)
    return Weights(0.0, np.zeros(features), latent)


def coded_rows(df: DataFrame, target: str, numbers: Sequence[str], categories: Sequence[str], codes: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The rows of ``df`` with a target as ``summed_gradient`` reads them, and ``keep``."""
    known = df.filter(F.col(target).isNotNull()).withColumn("_y", F.col(target).cast("double"))
    return _coded(known, codes, numbers, categories, ["_y", *keep])


def fit(df: DataFrame, key: str, target: str, numbers: Sequence[str], categories: Sequence[str], factors: int = 4, epochs: int = 10, batches: int = 1, rate: float = 0.2, penalty: float = 2e-5, seed: int = SEED) -> FieldAware:
    """Runs its jobs when called: one that writes the rows' codes, then one a mini-batch.

    A row's batch comes from its ``key``'s hash, so that neither partitions nor retries of tasks change the steps."""
    known = df.filter(F.col(target).isNotNull())
    codes = stored(field_codes(known, numbers, categories), "field-codes")
    batch = F.pmod(F.xxhash64(key), F.lit(batches)).alias("_batch")
    rows = stored(coded_rows(df, target, numbers, categories, codes, [batch]).sortWithinPartitions("_batch"), "ffm-rows")
    now = start(len(numbers) + codes.count(), len(numbers) + len(categories), factors, seed)
    squares = Weights(0.0, np.zeros_like(now.linear), np.zeros_like(now.latent))
    losses = []
    for _ in range(epochs):
        loss, n = 0.0, 0
        for b in range(batches):
            part = _stepped(now, squares, summed_gradient(rows.filter(F.col("_batch") == b), now).toArrow(), rate, penalty)
            loss, n = loss + part[0], n + part[1]
        if not n:
            raise ValueError("no rows with a target")
        losses.append(loss / n)
    return FieldAware(list(numbers), list(categories), codes, now, losses)


def predict(df: DataFrame, model: FieldAware, key: str) -> DataFrame:
    """(key, prediction) of every row of ``df``: the probability of the target."""
    rows = _coded(df, model.codes, model.numbers, model.categories, [key])
    shared, fields = df.sparkSession.sparkContext.broadcast(model.weights), len(model.numbers) + len(model.categories)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            z = scores(*_arrays(batch, fields), shared.value) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(1.0 / (1.0 + np.exp(-z)))], names=[key, "prediction"])

    return rows.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, prediction double")
