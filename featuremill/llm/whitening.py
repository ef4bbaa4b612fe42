"""Whitening of embeddings; the components come from FEAST contour integration.

The fit is two passes over the table: sums, then the centred second moments of each batch, added up by entries, so that the
driver gets one d x d matrix V whatever the rows (d: the vectors' length). Its largest eigenvalues are then found interval by interval,
each interval a task of a Spark job:

1. the inertia of V - s (signs of the pivots of a symmetric elimination) counts the eigenvalues beyond a shift s; bisection by
   counts cuts the range of the wanted eigenvalues into intervals of ``PER_INTERVAL`` at most, at shifts where a step
   aside changes no count;
2. a circle through the ends of an interval is integrated by Gauss-Legendre quadrature: at each node z of the upper half the complex
   shifted system (z - V) X = Y is solved, and the weighted real parts add up to the projection of Y on the eigenvectors inside;
3. Rayleigh-Ritz on the projected block gives pairs, which are projected again until their residuals are at rounding;
4. the pairs inside are as many as the inertia counts say; else the block is enlarged, and in the end it is an error.

Every row is then centred, projected and scaled in one more pass.

Defined cases: vectors that are null or hold null or non-finite entries are left out, and so are those of another length than the most
common one (of equals the greater); equal rows are rows each, null ids too; components whose eigenvalue is rounding against the
largest are left out (of constant data all are); an empty table gives an empty result; extra columns are ignored; entries
whose 64-fold does not fit a long, and deviations that do not, are errors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

COMPONENTS, SCALE, SHIFT = 32, 64, 1_000_000
#: Eigenvalues of an interval; nodes of the half circle; spare columns of a block; rounds of projection.
PER_INTERVAL, NODES, SPARE, ROUNDS = 8, 8, 6, 12
#: Rows of vectors that a worker holds at a time.
ROWS = 2048


def whole_vectors(df: DataFrame, column: str) -> DataFrame:
    """``df`` without the vectors that are left out, with ``x``: the entries as long."""
    entry = lambda c: F.when(F.abs(c) < float("inf"), F.floor(c * SCALE) + SHIFT)  # noqa: E731  NaN is not below anything
    whole = df.withColumn("x", F.transform(F.col(f"`{column}`").cast("array<double>"), entry))
    kept = whole.filter(F.col("x").isNotNull() & (F.size("x") > 0) & ~F.exists("x", lambda c: c.isNull()))
    lengths = kept.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "d")).alias("most")).first()
    return kept.filter(F.size("x") == (lengths.most.d if lengths.most else 0))


def _rows(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """The batch's vectors as a matrix of longs."""
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _added(df: DataFrame, kernel, width: int) -> np.ndarray:
    """The sum over all rows of ``kernel`` (matrix of longs to ``width`` numbers): per task, then by entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in _parts(batches):
            total += kernel(_rows(batch, "x"))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(total)], names=["k", "value"])

    rows = df.select("x").mapInArrow(run, "k long, value double").groupBy("k").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(width)
    out[rows.column("k").to_numpy()] = rows.column("value").to_numpy()
    return out


def sums(df: DataFrame) -> tuple[int, list[int]]:
    """(n, per-dimension sums of x), exact."""
    n = df.count()
    long = df.select(F.posexplode("x").alias("k", "x")).groupBy("k").agg(F.sum(F.col("x").cast("decimal(20,0)")).alias("s")).orderBy("k").collect()
    return n, [int(r.s) for r in long]


def covariance(df: DataFrame, n: int, total: list[int]) -> np.ndarray:
    """V, divisor n, centred before multiplying."""
    mean, d = np.array(total, float) / n, len(total)

    def moments(x: np.ndarray) -> np.ndarray:
        z = x - mean
        return (z.T @ z).ravel()

    v = _added(df, moments, d * d).reshape(d, d) / n
    return (v + v.T) / 2


def below(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues of ``v`` are below ``shift``: the negative pivots of a symmetric elimination (Bunch-Parlett)."""
    a, negative = v - shift * np.eye(len(v)), 0
    while len(a):
        diagonal = np.abs(np.diag(a))
        p = int(diagonal.argmax())
        off = np.abs(np.triu(a, 1))
        i, j = divmod(int(off.argmax()), len(a))
        if len(a) == 1 or diagonal[p] >= 0.6404 * off[i, j]:
            pivot, block = [p], a[p : p + 1, p : p + 1]
            negative += int(a[p, p] < 0)
            if a[p, p] == 0:  # what is left is zero
                return negative
        else:
            pivot, block = [i, j], a[np.ix_([i, j], [i, j])]
            negative += 1  # such a block has one eigenvalue of either sign
        rest = np.delete(np.arange(len(a)), pivot)
        c = a[np.ix_(rest, pivot)]
        a = a[np.ix_(rest, rest)] - c @ np.linalg.solve(block, c.T)
        a = (a + a.T) / 2
    return negative


def _clear(v: np.ndarray, shift: float, step: float) -> tuple[float, int]:
    """(a shift near ``shift`` with no eigenvalue within ``step``, if there is one, how many are below it)."""
    for k in range(16):
        at = shift + (k // 2 + k % 2) * (1 if k % 2 else -1) * 4 * step
        n = below(v, at)
        if below(v, at - step) == n == below(v, at + step):
            return at, n
    return shift, below(v, shift)


def intervals(v: np.ndarray, wanted: int) -> list[tuple[float, float, int]]:
    """(low, high, count): cuts of the range of the ``wanted`` largest eigenvalues at least, by counts alone."""
    high = float(np.abs(v).sum(axis=1).max()) * (1 + 1e-9)  # Gershgorin's bound
    low, step, d = -1e-9 * high, 1e-9 * high, len(v)
    floor, at_floor = low, below(v, low)
    top = high
    while top - floor > 1e-6 * high:  # the highest shift found with enough eigenvalues above it
        at, n = _clear(v, (floor + top) / 2, step)
        if d - n >= wanted:
            floor, at_floor = at, n
            if d - n == wanted:
                break
        else:
            top = at
    todo, out = [(floor, high, at_floor, d)], []
    while todo:
        a, b, n_a, n_b = todo.pop()
        if n_b - n_a > PER_INTERVAL and b - a > 1e-6 * high:
            at, n = _clear(v, (a + b) / 2, step)
            todo += [(a, at, n_a, n), (at, b, n, n_b)]
        elif n_b > n_a:
            out.append((a, b, n_b - n_a))
    return sorted(out)


def contour(v: np.ndarray, low: float, high: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as columns) of ``v`` between ``low`` and ``high``, which are ``count``."""
    d, scale = len(v), float(np.abs(v).sum(axis=1).max())
    centre, radius = (low + high) / 2, (high - low) / 2
    x, weights = np.polynomial.legendre.leggauss(NODES)
    turns = np.exp(1j * np.pi / 2 * (1 - x))
    inverse = [np.linalg.inv((centre + radius * t) * np.eye(d) - v) for t in turns]
    for size in (count + SPARE, 2 * count + 2 * SPARE, d):
        size = min(size, d)
        block = np.random.default_rng(size).standard_normal((d, size))
        for _ in range(ROUNDS):
            # the lower half of the circle gives the conjugates
            projected = sum(w / 2 * radius * np.real(t * (s @ block)) for w, t, s in zip(weights, turns, inverse))
            basis, strength, _ = np.linalg.svd(projected, full_matrices=False)
            basis = basis[:, strength > 1e-13 * strength[0]]
            values, ritz = np.linalg.eigh(basis.T @ v @ basis)
            block = basis @ ritz
            inside = (values >= low) & (values < high)
            residual = np.linalg.norm(v @ block[:, inside] - block[:, inside] * values[inside], axis=0)
            if inside.sum() == count and residual.max(initial=0) <= 4e-15 * d**0.5 * scale:
                return values[inside], block[:, inside]
        if inside.sum() == count and residual.max(initial=0) <= 1e-12 * scale:
            return values[inside], block[:, inside]
    raise ArithmeticError(f"{count} eigenvalues lie between {low} and {high}, {int(inside.sum())} were found")


def components(spark: SparkSession, v: np.ndarray, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns), by falling eigenvalue, ``wanted`` at most; those at rounding are left out."""
    if not len(v) or not np.abs(v).max() > 0:
        return np.zeros(0), np.zeros((len(v), 0))
    cut = intervals(v, min(wanted, len(v)))
    matrix = spark.sparkContext.broadcast(v)  # d x d, whatever the rows

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for low, high, count in frame.itertuples(index=False):
                values, vectors = contour(matrix.value, low, high, count)
                yield pd.DataFrame({"value": values, "vector": list(vectors.T)})

    jobs = spark.createDataFrame(cut, "low double, high double, count long").repartition(len(cut))
    rows = jobs.mapInPandas(solve, "value double, vector array<double>").collect()
    rows = sorted(rows, key=lambda r: -r.value)[:wanted]
    values = np.array([r.value for r in rows])
    kept = values > len(v) * 1e-15 * values.max(initial=0)
    return values[kept], np.array([r.vector for r in rows], float).reshape(len(rows), len(v)).T[:, kept]


def whitened(df: DataFrame, id_column: str, column: str, wanted: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of each remaining row and component.

    Fitting runs jobs: one for the length of vectors, two for the sums, one for the moments, one for the components and one
    for the covariance of the whitened rows."""
    spark = df.sparkSession
    rows = whole_vectors(df.select(F.col(f"`{id_column}`").cast("long").alias("vec_id"), F.col(f"`{column}`").alias("vector")), "vector").select("vec_id", "x")
    n, total = sums(rows)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not n:
        return spark.createDataFrame([], schema)
    v = covariance(rows, n, total)
    values, vectors = components(spark, v, wanted)
    k = len(values)
    if not k:
        return spark.createDataFrame([], schema)
    mean, projection, explained = np.array(total, float) / n, vectors / np.sqrt(values), values / np.trace(v)

    def white(x: np.ndarray) -> np.ndarray:
        return (x - mean) @ projection

    def moments(x: np.ndarray) -> np.ndarray:
        w = white(x)
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    found = _added(rows, moments, k + k * k) / n
    error = float(np.abs(found[k:].reshape(k, k) - np.outer(found[:k], found[:k]) - np.eye(k)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = np.array(total, object)
        for batch in _parts(batches):
            x = _rows(batch, "x")
            if float(np.abs(x - mean).max(initial=0)) * n < 2**31 / len(total) ** 0.5 and n * float(np.abs(x).max(initial=0)) < 2**62:
                deviation = ((n * x - s.astype(np.int64)) ** 2).sum(axis=1)
            else:
                deviation = [int(((n * r.astype(object) - s) ** 2).sum()) for r in x]
            m = len(x)
            columns = [batch.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n))]
            columns += [pa.array(np.repeat(np.array(deviation, np.int64), k)), pa.array(white(x).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
