"""Whitening against numpy's eigenvectors of the exact covariance."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from canopy.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, n string"


def brute(rows, k=8):
    """{(id, place): ...} by the definition: exact integers, then eigenvectors of the covariance."""
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows]
    n, dims = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(dims)]
    wide = [[n * r[j] - s[j] for j in range(dims)] for r in x]
    c = np.array([[float(Fraction(w, n)) for w in r] for r in wide])
    e, q = np.linalg.eigh(c.T @ c / n)
    e, q = e[::-1], q[:, ::-1]
    k = min(k, int((e > e[0] * 1e-12).sum()))
    return n, [sum(w * w for w in r) for r in wide], c @ q[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def same(got, rows, k=8):
    n, deviation, white, explained = brute(rows, k)
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], []).append(r)
    signs = None
    for i, (vec, _) in enumerate(rows):
        found = sorted(by[vec], key=lambda r: r["component"])
        assert [r["component"] for r in found] == list(range(1, len(explained) + 1))
        assert {(r["n"], r["deviation"]) for r in found} == {(n, deviation[i] if deviation[i] < 2 ** 63 else None)}
        assert [r["explained"] for r in found] == pytest.approx(explained.tolist(), rel=1e-9)
        assert all(r["identity_error"] < 1e-6 for r in found)
        w = np.array([r["whitened"] for r in found])
        if signs is None:
            signs = np.zeros(len(w))
        signs = np.where((signs == 0) & (np.abs(w) > 1e-6), np.sign(w * white[i]), signs)
        assert np.abs(w - np.where(signs == 0, 1, signs) * white[i]).max() < 1e-6
    return signs


def test_whitening_of_the_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    got = whitening.whiten(table.repartition(7)).collect()
    assert len(got) == 8 * len(rows) and got[0]["passes"] <= 5
    same(got, rows)


@pytest.mark.parametrize("dims,spread", [(3, 1.0), (12, 1e-3), (5, 1e6)])
def test_whitening_of_odd_vectors(spark, dims, spread):
    r = random.Random(dims)
    rows = [(i, [r.gauss(0, 1) * 10 ** (j % 4) * spread + (5.0 if j else 1e7) for j in range(dims)]) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(30)]
    odd = [(-1, None), (-2, []), (-3, [1.0] * (dims - 1) + [None]), (-4, [float("nan")] * dims), (-5, [float("inf")] * dims), (-6, [1.0] * (dims + 1)),
           (None, None)]
    docs = spark.createDataFrame([(i, v, "x") for i, v in rows + odd], SCHEMA).repartition(5)
    same(whitening.whiten(docs).collect(), rows)


def test_dependent_and_constant_dimensions(spark):
    r = random.Random(1)
    rows = [(i, [a := r.gauss(0, 1), 3.0, 2 * math.floor(a * 1024) / 1024, r.gauss(0, 2)]) for i in range(200)]
    rows = [(i, [math.floor(v[0] * 1024) / 1024, v[1], v[2], v[3]]) for i, v in rows]
    got = whitening.whiten(spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)).collect()
    assert {x["component"] for x in got} == {1, 2}
    same(got, rows)


def test_deviations_beyond_a_double_and_a_long(spark):
    rows = [(i, [float(i % 7) * 2 ** 20, float(i)]) for i in range(60)]
    rows += [(100, [2.0 ** 30, 1.0]), (101, [1e300, 2.0])]
    got = {x["vec_id"]: x for x in whitening.whiten(spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)).collect()}
    clipped = [[min(math.floor(1024 * c), 2 ** 52) + 100_000 for c in v] for _, v in rows]
    s = [sum(c) for c in zip(*clipped)]
    for (i, _), x in zip(rows, clipped):
        exact = sum((len(rows) * a - b) ** 2 for a, b in zip(x, s))
        assert got[i]["deviation"] == (exact if exact < 2 ** 63 else None)


def test_no_variance_and_no_rows(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0], "x"), (2, [1.0, 2.0], "y"), (3, None, "z")], SCHEMA)
    assert whitening.whiten(one).collect() == []
    empty = whitening.whiten(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == [] and dict(empty.dtypes)["whitened"] == "double"


def test_factors_by_hand():
    g = np.random.default_rng(0).normal(size=(40, 6))
    r = whitening._cholesky(g.T @ g, 40, False)
    assert np.allclose(r.T @ r, g.T @ g) and np.allclose(r, np.triu(r))
    assert np.allclose(r @ whitening.triangular_solve(r, np.eye(6)), np.eye(6))
