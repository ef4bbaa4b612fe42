"""Whitening against plain linear algebra; the contour's counts against a full decomposition."""

import math

import numpy as np
import pytest

from featuremill.llm import whitening


def expected(vectors, wanted=32):
    x = np.floor(64 * np.array(vectors, float)) + 1_000_000
    s, n = [int(c) for c in x.sum(axis=0)], len(x)
    z = x - x.mean(axis=0)
    values, axes = np.linalg.eigh(z.T @ z / n)
    values, axes = values[::-1][:wanted], axes[:, ::-1][:, :wanted]
    deviation = [sum((n * int(c) - t) ** 2 for c, t in zip(row, s)) for row in x]
    return n, deviation, z @ axes / np.sqrt(values), values / (z**2).sum() * n


def check(got, ids, vectors):
    n, deviation, white, explained = expected(vectors)
    k = white.shape[1]
    assert len(got) == n * k
    rows = {}
    for r in got:
        rows.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    have = np.array([[rows[i][c + 1][0].whitened for c in range(k)] for i in ids])
    signs = np.sign((have * white).sum(axis=0))
    assert np.abs(have - signs * white).max() < 1e-8
    assert {i: rows[i][1][0].deviation for i in ids} == dict(zip(ids, deviation))
    assert {r.n for r in got} == {n}
    assert np.allclose([rows[ids[0]][c + 1][0].explained for c in range(k)], explained, rtol=1e-9)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_against_eigh_with_rows_left_out(spark):
    rng = np.random.default_rng(1)
    base = (rng.standard_normal((300, 40)) * np.linspace(0.1, 2, 40)).astype(np.float32).astype(float)
    rows = [(k, "x", v.tolist()) for k, v in enumerate(base)]
    odd = [None, [], [1.0] * 3, [None] + [1.0] * 39, [math.nan] + [1.0] * 39, [math.inf] * 40, [-math.inf] * 40]
    rows += [(1000 + k, None, v) for k, v in enumerate(odd)]
    df = spark.createDataFrame(rows, "vec_id long, x string, embedding array<double>").selectExpr("1 AS component", "embedding", "x", "vec_id").repartition(3)
    check(whitening.whitened(df, "vec_id", "embedding").collect(), list(range(300)), base)


def test_small_and_degenerate_tables(spark):
    df = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    run = lambda rows: whitening.whitened(df(rows), "vec_id", "embedding").collect()
    assert run([]) == [] and run([(1, None)]) == [] and run([(1, [0.5, 0.5])] * 3) == []
    # two copies and a null id; one direction only
    got = run([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, 2.0])])
    assert sorted((r.vec_id is None, r.component, r.n, r.deviation) for r in got) == [(False, 1, 3, 128**2)] * 2 + [(True, 1, 3, 256**2)]
    assert np.allclose(sorted(abs(r.whitened) for r in got), [0.5**0.5, 0.5**0.5, 2**0.5]) and got[0].explained == pytest.approx(1)


def test_whole_query(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    check(whitening.op13_whitening(spark, "/root/testdata/sf0.01").collect(), [r.vec_id for r in df], [r.embedding for r in df])


@pytest.mark.parametrize("values", [np.linspace(1, 9, 45), np.r_[np.full(12, 7.0), np.full(20, 3.0), np.arange(8) / 10], 10.0 ** -np.arange(30), np.full(9, 2.0), [4.0], np.r_[1e6, 5, np.zeros(10)]])
def test_contours_miss_no_component(values):
    rng = np.random.default_rng(2)
    q, _ = np.linalg.qr(rng.standard_normal((len(values), len(values))))
    v = q @ np.diag(values) @ q.T
    v = (v + v.T) / 2
    for shift in np.linspace(-1, max(values) + 1, 7) + 0.0123:
        assert whitening.below(v, shift) == (np.array(values) < shift).sum()
    cut = whitening.intervals(v, 32)
    found = [whitening.contour(v, *c) for c in cut]
    have = np.sort(np.concatenate([f[0] for f in found]))[::-1][:32]
    assert np.allclose(have, np.sort(values)[::-1][:32], atol=1e-12 * max(values))
    vectors = np.concatenate([f[1] for f in found], axis=1)
    assert np.abs(vectors.T @ vectors - np.eye(vectors.shape[1])).max() < 1e-9


def test_a_wrong_count_is_an_error():
    with pytest.raises(ArithmeticError):
        whitening.contour(np.diag(np.arange(6.0)), 0.5, 2.5, 3)
