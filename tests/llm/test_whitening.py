"""Whitening against numpy's eigensolver and exact sums in Python integers."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

pytest.importorskip("colloquy.llm")
from colloquy.llm import whitening  # noqa: E402

SCHEMA = "vec_id long, embedding array<float>, n int, d string, i string"


def matrices():
    rng = np.random.default_rng(4)
    spread = rng.normal(size=(300, 20))
    block = spread[:, :10].T @ spread[:, :10]
    return [spread.T @ spread, np.eye(12) * 3, np.outer(spread[0], spread[0]), np.kron(np.eye(2), block), np.diag([5.0, 5, 5, 1, 0, 0]), np.array([[2.0]]),
            np.zeros((3, 3)), np.diag(10.0 ** -np.arange(12)), (spread * 1e-120).T @ (spread * 1e-120), np.array([[1.0, 1e-9], [1e-9, 1.0]])]


@pytest.mark.parametrize("v", matrices())
def test_eigen(v):
    e, z = whitening.eigen(v, 32)
    want = np.linalg.eigvalsh(v)[::-1]
    scale = max(np.abs(v).max(), np.finfo(float).tiny)
    assert np.abs(e - want).max() <= 1e-13 * scale * len(v)
    assert np.abs(z @ z.T - np.eye(len(v))).max() < 1e-13
    assert np.abs(v @ z.T - z.T * e).max() <= 1e-13 * scale * len(v)


def test_sturm_counts():
    d, off = np.array([4.0, 1, 3, 2, 2]), np.array([1.0, 0.5, 0.0, 2])
    want = np.linalg.eigvalsh(np.diag(d) + np.diag(off, 1) + np.diag(off, -1))
    at = np.linspace(-2, 6, 41) + 1e-3
    assert whitening.below(d, off, at).tolist() == [(want < a).sum() for a in at]


def table(d=40, n=500):
    rng, rnd = np.random.default_rng(6), random.Random(6)
    base = rng.normal(size=(n, d)) * np.linspace(0.2, 0.05, d)
    rows = [(i, [float(np.float32(x)) for x in v], 1, "x", "y") for i, v in enumerate(base)]
    rows += [(None, rows[0][1], 1, "x", "y"), (3, rows[0][1], 1, "x", "y")] + [(900 + i, rows[1][1], 1, "x", "y") for i in range(200)]
    bad = [None, [], [None] * d, [math.nan, *[0.0] * (d - 1)], [math.inf, *[0.0] * (d - 1)], [0.5] * (d - 1), [*[0.1] * (d - 1), None]]
    rows += [(2000 + i, v, 1, "x", "y") for i, v in enumerate(bad)]
    rnd.shuffle(rows)
    return rows, d


@pytest.mark.parametrize("kind", ["float", "double"])
def test_components(spark, kind):
    rows, d = table()
    df = spark.createDataFrame(rows, SCHEMA.replace("float", kind)).repartition(4)
    good = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v, *_ in rows if i is None or i < 2000]
    n, sums = len(good), [sum(c) for c in zip(*(x for _, x in good))]
    exact = [[float(Fraction(sum((n * x[i] - sums[i]) * (n * x[j] - sums[j]) for _, x in good), n**3)) for j in range(d)] for i in range(d)]
    fitted = whitening.fit(df)
    assert (fitted.n, fitted.sums) == (n, sums) and np.array_equal(fitted.covariance, np.array(exact))
    e, z = np.linalg.eigh(np.array(exact))
    e, z = e[::-1][:32], z.T[::-1][:32]
    y = np.array([[(n * a - s) / n for a, s in zip(x, sums)] for _, x in good])
    want = {(i, k): (w, sum((n * a - s) ** 2 for a, s in zip(x, sums))) for (i, x), row in zip(good, y @ (z / np.sqrt(e)[:, None]).T) for k, w in enumerate(row, 1)}
    got = whitening.components(df).collect()
    assert len(got) == n * 32
    sign = {}
    for r in got:
        w, far = want[r.vec_id, r.component]
        if abs(w) > 0.1:
            sign.setdefault(r.component, round(w * r.whitened / abs(w * r.whitened)))
    for r in got:
        if r.vec_id != 3:  # two different vectors have this id
            w, far = want[r.vec_id, r.component]
            assert abs(w * sign[r.component] - r.whitened) < 1e-9 and r.deviation == far and r.n == n
        assert abs(r.explained - e[r.component - 1] / np.trace(exact)) < 1e-12 and r.identity_error < 1e-10


def test_long_integers_stay_exact(spark):
    """Components beyond what products in 64 bits can hold."""
    rows = [(i, [1e15 * (i % 3), float(i), -3e15 * (i % 2)], 1, "", "") for i in range(50)]
    fitted = whitening.fit(spark.createDataFrame(rows, SCHEMA.replace("float", "double")).repartition(3))
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v, *_ in rows]
    s = [sum(c) for c in zip(*x)]
    assert fitted.sums == s
    for i in range(3):
        for j in range(3):
            assert fitted.covariance[i, j] == float(Fraction(sum((50 * a[i] - s[i]) * (50 * a[j] - s[j]) for a in x), 50**3))


@pytest.mark.parametrize("vectors", [[], [None], [[0.5, 0.5]], [[0.5, 0.25]] * 3])
def test_nothing_to_scale(spark, vectors):
    """No rows, one row or equal rows: no variance, no component."""
    assert whitening.components(spark.createDataFrame([(i, v, 1, "", "") for i, v in enumerate(vectors)], SCHEMA)).count() == 0
