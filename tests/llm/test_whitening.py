import math

import numpy as np
import pytest

from nascent.llm import bidiagonal, whitening

SCHEMA = "vec_id long, v array<double>, n long, id string, w string"


def frame(spark, vectors, parts=3, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    rows = [(i, v, 1, "x", "y") for i, v in zip(ids, vectors)]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def run(spark, vectors, **kw):
    return whitening.whiten(frame(spark, vectors, **kw), "v", "vec_id").collect()


def grid(vectors):
    return np.floor(np.array(vectors, dtype=float) * 1024) + 100_000


def test_equals_brute_force_over_many_parts(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(700, 12)) * np.linspace(0.2, 1.4, 12) + 3).tolist()
    got = run(spark, vectors, parts=40)
    x = grid(vectors)
    n, sums = len(x), x.sum(axis=0)
    e, v = np.linalg.eigh(np.cov(x.T, bias=True))
    e, v = e[::-1], v[:, ::-1]
    want = (x - x.mean(axis=0)) @ v[:, :8] / np.sqrt(e[:8])
    assert len(got) == 700 * 8
    for r in got:
        assert r.n == n and r.identity_error < 1e-10
        assert abs(r.explained - e[r.component - 1] / e.sum()) < 1e-12
        assert abs(abs(r.whitened) - abs(want[r.id, r.component - 1])) < 1e-8
    exact = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x]
    assert {(r.id, r.deviation) for r in got} == set(enumerate(exact))


def test_bad_rows_are_dropped_and_null_ids_kept(spark):
    good = [[float(i % 5), float(i % 3), float(i * i % 7)] for i in range(20)]
    bad = [None, [], [1.0, None, 2.0], [1.0, math.nan, 2.0], [math.inf, 0.0, 0.0], [1.0, 2.0]]
    got = run(spark, good + bad, ids=[None, *range(1, 20), *range(100, 106)])
    assert {r.id for r in got} == {None, *range(1, 20)} and {r.n for r in got} == {20}
    assert {r.component for r in got} == {1, 2, 3}


def test_directions_without_variance_are_null(spark):
    got = run(spark, [[1.0, 2.0, float(i), float(2 * i)] for i in range(9)])
    assert all((r.whitened is None) == (r.component > 1) for r in got)
    assert all(abs(r.explained - (r.component == 1)) < 1e-12 and r.identity_error < 1e-12 for r in got)
    alone = run(spark, [[1.0, 2.0]])
    assert [(r.whitened, r.explained, r.identity_error, r.deviation) for r in alone] == [(None, None, None, 0)] * 2


def test_empty_table(spark):
    assert run(spark, []) == [] and run(spark, [None, []]) == []


def test_huge_entries_have_no_deviation_but_count(spark):
    got = run(spark, [[1e300, 0.0], [-1e300, 1.0], [0.5, 0.5]])
    assert {r.deviation for r in got if r.id < 2} == {None} and {r.n for r in got} == {3}


def test_repeated_rows_weigh_as_often_as_they_stand(spark):
    base = [[float(i % 4), float((i * 3) % 5)] for i in range(12)]
    vectors = base + [base[0]] * 30
    got = run(spark, vectors)
    e = np.linalg.eigvalsh(np.cov(grid(vectors).T, bias=True))[::-1]
    assert {r.component: round(r.explained, 12) for r in got} == {i + 1: round(x / e.sum(), 12) for i, x in enumerate(e)}


@pytest.mark.parametrize("name", ["gauss", "graded", "repeated", "zero", "rank two", "one"])
def test_solver_against_numpy(name):
    rng = np.random.default_rng(1)
    left, right = (np.linalg.qr(rng.normal(size=(20, 20)))[0] for _ in range(2))
    matrix = {
        "gauss": rng.normal(size=(50, 50)),
        "graded": np.triu(rng.normal(size=(12, 12))) * 10.0 ** -np.arange(12)[:, None],
        "repeated": left @ np.diag([5.0] * 6 + [4.0] * 6 + [1e-3] * 4 + [0.0] * 4) @ right,
        "zero": np.zeros((4, 4)),
        "rank two": np.outer(np.ones(6), np.arange(6.0)) + np.diag([3.0, 0, 0, 0, 0, 0]),
        "one": np.array([[-2.0]]),
    }[name]
    values, vectors = bidiagonal.leading_right_vectors(matrix, 8)
    want = np.linalg.svd(matrix, compute_uv=False) ** 2
    assert np.allclose(values, want, rtol=1e-12, atol=1e-14 * (want[0] + 1e-300))
    assert np.abs(vectors @ vectors.T - np.eye(len(vectors))).max() < 1e-11
    left_over = matrix.T @ (matrix @ vectors.T) - vectors.T * values[: len(vectors)]
    assert np.abs(left_over).max() <= 1e-12 * (want[0] + 1e-300)


def test_small_singular_values_are_accurate():
    diagonal, upper = 10.0 ** -np.arange(10), 0.3 * 10.0 ** -np.arange(9)
    squares = bidiagonal.squared_values(diagonal, upper)
    assert np.isclose(np.prod(np.sqrt(squares) / diagonal), 1.0, rtol=1e-12)
