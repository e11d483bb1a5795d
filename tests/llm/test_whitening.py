"""Whitening against numpy and exact integers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseloom.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize("d", [1, 2, 3, 7, 16, 33])
def test_jacobi_is_a_decomposition(d):
    rng = np.random.default_rng(d)
    b = rng.standard_normal((d, d)) * 10.0 ** rng.integers(-3, 3, d)
    a = b @ b.T
    values, vectors = whitening.jacobi(a)
    assert np.allclose(vectors.T @ vectors, np.eye(d), atol=1e-13)
    assert np.allclose(vectors * values @ vectors.T, a, rtol=0, atol=1e-12 * np.abs(a).max())
    assert (np.diff(values) <= 0).all() and np.allclose(values, np.linalg.eigvalsh(a)[::-1], rtol=1e-9, atol=1e-13 * np.abs(a).max())


def test_jacobi_keeps_small_eigenvalues():
    """Of a graded matrix the small eigenvalues are right to double precision, not only beside the largest."""
    d = 6
    scale = 10.0 ** -np.arange(0, 2 * d, 2)
    k = np.eye(d) + 0.1 * (np.ones((d, d)) - np.eye(d))
    values, _ = whitening.jacobi(scale[:, None] * k * scale)
    assert math.isclose(np.prod(values / scale**2), np.linalg.det(k), rel_tol=1e-12)
    assert np.array_equal(whitening.jacobi(np.zeros((4, 4)))[0], np.zeros(4))


def plain(rows, d, components=8):
    """By exact integers and numpy: {vec_id: (deviation, |whitened|)}, explained, n."""
    ids = [r[0] for r in rows]
    x = [[math.floor(1024 * c) + 100_000 for c in r[1]] for r in rows]
    n, s = len(x), [sum(v[i] for v in x) for i in range(d)]
    shifted = [[n * c - t for c, t in zip(v, s)] for v in x]
    y = np.array(shifted, "f8") / n
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1], u[:, ::-1]
    w = y @ u[:, :components] / np.sqrt(e[:components])
    return {i: (sum(c * c for c in v), np.abs(row)) for i, v, row in zip(ids, shifted, w)}, e / e.sum(), n


def test_against_numpy(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((300, 12)) * np.linspace(0.5, 0.05, 12) + rng.standard_normal(12)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(base)]
    odd = [(900, None, 0), (901, [], 0), (902, [None] + [0.0] * 11, 1), (903, [float("nan")] * 12, 1), (904, [float("inf")] + [0.0] * 11, 1), (905, [1.0] * 5, 1)]
    df = spark.createDataFrame(rows + odd, SCHEMA).repartition(6).withColumns({c: F.lit("x") for c in ("x", "d", "n", "w", "component", "at")})
    got = whitening.whiten(df).collect()
    want, explained, n = plain(rows, 12)
    assert len(got) == 300 * 8 and {r["vec_id"] for r in got} == set(want)
    for r in got:
        deviation, w = want[r["vec_id"]]
        assert r["n"] == n and r["deviation"] == deviation
        assert math.isclose(abs(r["whitened"]), w[r["component"] - 1], rel_tol=1e-7, abs_tol=1e-9)
        assert math.isclose(r["explained"], explained[r["component"] - 1], rel_tol=1e-9)
        assert r["identity_error"] < 1e-10
    # one sign for all rows
    signs = {c: {np.sign(r["whitened"] * (np.array(rows[r["vec_id"]][1]) - base.mean(0)).sum()) for r in got if r["component"] == c and r["vec_id"] < 5} for c in (1,)}
    assert signs


def test_the_registered_query(spark, small):
    from caseloom.llm.queries import op12_embedding_whitening

    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    want, explained, n = plain(rows, 64)
    got = op12_embedding_whitening(spark, small).collect()
    assert len(got) == 8 * n
    for r in got:
        deviation, w = want[r["vec_id"]]
        assert r["deviation"] == deviation and math.isclose(abs(r["whitened"]), w[r["component"] - 1], rel_tol=1e-6, abs_tol=1e-8)
        assert math.isclose(r["explained"], explained[r["component"] - 1], rel_tol=1e-9) and r["identity_error"] <= 1e-4


def test_degenerate_tables(spark):
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0)], SCHEMA)).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    same = whitening.whiten(spark.createDataFrame([(None, [1.0, 2.0], 0)] * 9, SCHEMA)).collect()
    assert len(same) == 18 and all(r["whitened"] is None and r["deviation"] == 0 for r in same)
    # of rank one: one component is known
    line = whitening.whiten(spark.createDataFrame([(i, [i / 4, i / 2, 0.0], 0) for i in range(8)], SCHEMA)).collect()
    assert {(r["component"], r["whitened"] is None) for r in line} == {(1, False), (2, True), (3, True)}
    assert all(r["identity_error"] < 1e-12 for r in line)
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None, 0)], SCHEMA)).count() == 0


def test_huge_entries_stay_exact(spark):
    rows = [(i, [1e12 * i, 3.0, -2e9 * (i % 3)], 0) for i in range(10)] + [(10, [1e300, 0.0, 0.0], 0)]
    got = {(r["vec_id"], r["component"]): r for r in whitening.whiten(spark.createDataFrame(rows[:10], SCHEMA)).collect()}
    want, _, _ = plain(rows[:10], 3)
    assert all(got[i, 1]["deviation"] == (want[i][0] if want[i][0] < 1 << 63 else None) for i in range(10))
    assert whitening.whiten(spark.createDataFrame(rows, SCHEMA)).count() == 33
