"""Whitening against exact and against floating-point linear algebra."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from sprintgauge.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>"


def plain(vectors):
    x = np.floor(1024 * np.asarray(vectors, dtype=np.float64)).astype(np.int64) + 100_000
    centred = x - x.mean(axis=0)
    values, axes = np.linalg.eigh(centred.T @ centred / len(x))
    order = np.argsort(values)[::-1][:8]
    deviation = [sum((len(x) * int(v) - int(s)) ** 2 for v, s in zip(row, x.sum(axis=0))) for row in x]
    return deviation, centred @ axes[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def test_whole_table(spark, sf_dir):
    given = {r.vec_id: list(r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    ids = sorted(given)
    deviation, white, explained = plain([given[i] for i in ids])
    got = {(r.vec_id, r.component): r for r in queries.whitening_query(spark, sf_dir).collect()}
    assert set(got) == {(i, k) for i in ids for k in range(1, 9)}
    for k in range(8):
        own = np.array([got[i, k + 1].whitened for i in ids])
        assert min(np.abs(own - white[:, k]).max(), np.abs(own + white[:, k]).max()) < 1e-6
        assert got[ids[0], k + 1].explained == pytest.approx(explained[k], rel=1e-9)
    assert [got[i, 1].deviation for i in ids] == deviation
    assert {r.n for r in got.values()} == {len(ids)}
    errors = {r.identity_error for r in got.values()}
    assert len(errors) == 1 and errors.pop() < 1e-9


def test_polynomial_is_exact(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(-50, 50, (5, 4)).astype(object)
    matrix = (y.T @ y).tolist()
    def det(a):
        return a[0][0] if len(a) == 1 else sum((-1) ** j * a[0][j] * det([r[:j] + r[j + 1:] for r in a[1:]]) for j in range(len(a)))
    c = whitening.characteristic_polynomial(spark, matrix)
    for x in (0, 1, -7, 100):
        shifted = [[x * (i == j) - matrix[i][j] for j in range(4)] for i in range(4)]
        assert sum(k * x ** i for i, k in enumerate(c)) == det(shifted)


def test_roots_close_together_repeated_and_zero():
    def poly(*roots):
        c = [1]
        for r in roots:
            c = [(c[k - 1] if k else 0) - (r * c[k] if k < len(c) else 0) for k in range(len(c) + 1)]
        return c
    find = lambda *r: whitening.Roots(poly(*r)).largest(8)
    assert [(math.ceil(r), m) for r, m in find(7, 7, 3, 0, 0)] == [(7, 2), (3, 1)]
    assert [m for _, m in find(10**12, 10**12 - 1, 5)] == [1, 1, 1]
    # (x^2 - 2)(x - 1): roots 1.414.. and 1 (and a negative one, which does not matter here)
    (top, _), *_ = whitening.Roots([2, -2, -1, 1]).largest(1)
    assert abs(top * top - 2) < Fraction(1, 1 << 120)
    near = [(1 << 40) ** 2 * 6 + 1, -5 * (1 << 40), 1]  # two roots near 2 and 3 times 2**40
    assert [m for _, m in whitening.Roots(near).largest(2)] == [1, 1]


def test_repeated_roots_give_a_whole_space(spark):
    # The corners of a square, twice: both directions have equal variance.
    rows = [(i, [float(a), float(b), 0.5]) for i, (a, b) in enumerate([(1, 1), (1, -1), (-1, 1), (-1, -1)] * 2)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.component for r in got} == {1, 2} and {round(r.explained, 12) for r in got} == {0.5}
    assert all(r.identity_error < 1e-12 for r in got)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, -1.0]), (2, None), (3, [None, 1.0]), (4, [nan, 1.0]),
            (5, [inf, 0.0]), (6, []), (7, [1.0, 2.0, 3.0]), (8, [1e30, 0.0]), (9, [5.0, 5.5])]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("n", "component", "deviation", "vector", "id")})
    got = whitening.whiten(df).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == [(0, 1), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2), (9, 1), (9, 2)]
    assert {r.n for r in got} == {4} and all(r.identity_error < 1e-9 for r in got)
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.filter("vec_id = 1")).count() == 0  # no variance
    wide = spark.createDataFrame([(1, [1e9, 0.0]), (2, [-1e9, 1.0]), (3, [0.0, 5.0])], "vec_id long, embedding array<double>")
    far = {r.vec_id: r.deviation for r in whitening.whiten(wide).collect()}
    assert far[1] is None and far[3] is not None
    assert list(far) and {r.component for r in whitening.whiten(wide).collect()} == {1, 2}
