"""Whitening against numpy's eigenvectors, and its exact parts against plain integer arithmetic."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigia.llm import whitening as w
from vigia.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int"


def integers(vectors):
    return [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in vectors]


def brute_scatter(xs):
    n, d = len(xs), len(xs[0])
    s = [sum(x[i] for x in xs) for i in range(d)]
    return s, [[n * sum(x[i] * x[j] for x in xs) - s[i] * s[j] for j in range(d)] for i in range(d)]


def some_vectors(n, d, seed=1, size=1.0):
    r = random.Random(seed)
    return [[r.gauss(0, size * (1 + j % 5)) for j in range(d)] for _ in range(n)]


@pytest.mark.parametrize("size", [0.3, 5000.0])  # the second needs several limbs
def test_scatter_is_exact(spark, size):
    vs = some_vectors(300, 6, size=size)
    rows = spark.createDataFrame([(v,) for v in vs], "vector array<float>").withColumn("vector", F.col("vector").cast("array<double>"))
    n, s, got = w.scatter(rows.repartition(7), 6)
    want_s, want = brute_scatter(integers(vs))
    assert n == 300 and [x + n * 100_000 for x in s] == want_s and got.tolist() == want


def determinant(m):
    """Bareiss elimination over the integers."""
    m, sign, before = [row[:] for row in m], 1, 1
    for k in range(len(m) - 1):
        if not m[k][k]:
            swap = next((i for i in range(k + 1, len(m)) if m[i][k]), None)
            if swap is None:
                return 0
            m[k], m[swap], sign = m[swap], m[k], -sign
        for i in range(k + 1, len(m)):
            for j in range(k + 1, len(m)):
                m[i][j] = (m[i][j] * m[k][k] - m[i][k] * m[k][j]) // before
        before = m[k][k]
    return sign * m[-1][-1]


def test_characteristic_polynomial_is_exact(spark):
    for vs in (some_vectors(40, 7), some_vectors(4, 7), [[1.0, 0, 0, 2.0], [0, 1.0, 0, 2.0], [0, 0, 1.0, 2.0], [0, 0, 0, 0]]):
        _, a = brute_scatter(integers(vs))
        poly = w.characteristic_polynomial(spark, np.array(a, object))
        for x in range(len(a) + 1):
            shifted = [[(x if i == j else 0) - a[i][j] for j in range(len(a))] for i in range(len(a))]
            assert sum(c * x ** k for k, c in enumerate(poly)) == determinant(shifted)


def test_primes():
    assert w.primes_below(30, 4) == [29, 23, 19, 17]
    assert w.primes_below(1 << 31, 3) == [2147483647, 2147483629, 2147483587]


def test_roots_with_repeats():
    poly = [1]
    for root in (0, 0, 3, 7, 7, 7, 1000):
        poly = [(poly[k - 1] if k else 0) - root * (poly[k] if k < len(poly) else 0) for k in range(len(poly) + 1)]
    got = w.largest_roots(poly, 1024, 8)
    assert [(r >> w.ROOT, m) for r, m in got] == [(1000, 1), (7, 3), (3, 1)]
    assert w.largest_roots(poly, 1024, 2) == got[:2]


def check(rows, vs, components):
    """Whitened rows against the covariance of the integer vectors."""
    x = np.array(integers(vs), float)
    e, u = np.linalg.eigh(np.cov(x.T, bias=True))
    e = e[::-1]
    by = {}
    for r in rows:
        by.setdefault(r.vec_id, {})[r.component] = r
    assert all(sorted(v) == list(range(1, components + 1)) for v in by.values()) and len(by) == len(vs)
    n, s = len(vs), [sum(c) for c in zip(*integers(vs))]
    for i, v in enumerate(integers(vs)):
        assert all(int(r.deviation) == sum((n * a - b) ** 2 for a, b in zip(v, s)) for r in by[i].values())
    white = np.array([[by[i][c].whitened for c in range(1, components + 1)] for i in range(n)])
    assert np.abs(white.T @ white / n - np.eye(components)).max() < 1e-9 and np.abs(white.mean(axis=0)).max() < 1e-9
    assert max(r.identity_error for r in rows) < 1e-9 and {r.n for r in rows} == {n}
    for c in range(components):
        assert by[0][c + 1].explained == pytest.approx(e[c] / e.sum(), rel=1e-9)
    # the projections of a component, undone, are an eigenvector: V v = e v
    v = np.linalg.lstsq(x - x.mean(axis=0), white * np.sqrt(e[:components]), rcond=None)[0]
    cov = np.cov(x.T, bias=True)
    assert np.abs(cov @ v - v * e[:components]).max() < 1e-6 * e[0]


def frame(spark, vs):
    return spark.createDataFrame([(i, v, 0) for i, v in enumerate(vs)], SCHEMA)


def test_against_numpy(spark):
    vs = some_vectors(200, 12)
    check(w.whiten(frame(spark, vs).repartition(5)).collect(), vs, 8)


def test_equal_eigenvalues(spark):
    """Plus and minus each axis: all eigenvalues equal, so any orthonormal basis whitens."""
    vs = [[s if i == j else 0.0 for j in range(10)] for i in range(10) for s in (1.0, -1.0)]
    rows = w.whiten(frame(spark, vs)).collect()
    assert len(rows) == 20 * 8 and max(r.identity_error for r in rows) < 1e-9
    assert {round(r.explained, 12) for r in rows} == {0.1}


def test_fewer_dimensions_than_components(spark):
    vs = [[a, 2 * a, b] for a, b in zip(range(9), (3, 1, 4, 1, 5, 9, 2, 6, 5))]
    vs = [[float(x) for x in v] for v in vs]
    check(w.whiten(frame(spark, vs)).collect(), vs, 2)  # the third eigenvalue is zero


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    vs = some_vectors(30, 4)
    rows = [(i, v, 0, 1.0, 5) for i, v in enumerate(vs)]
    bad = [(90, None, 0, 1.0, 5), (91, [], 0, 1.0, 5), (92, [None, 1.0, 1.0, 1.0], 0, 1.0, 5), (93, [nan] * 4, 0, 1.0, 5),
           (94, [inf, 0.0, 0.0, 0.0], 0, 1.0, 5), (95, [1.0, 2.0], 0, 1.0, 5)]
    clash = f"{SCHEMA}, whitened double, n int"
    want = sorted((r.vec_id, r.component, r.n, r.deviation, round(r.whitened, 9)) for r in w.whiten(frame(spark, vs)).collect())
    got = w.whiten(spark.createDataFrame(rows + bad, clash)).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, round(r.whitened, 9)) for r in got) == want
    # repeated rows and null ids stay; huge entries do not end the job
    again = w.whiten(spark.createDataFrame([(None, v, 0) for v in vs] * 2 + [(7, [3e38, 0.0, 1.0, 1.0], 0)], SCHEMA)).collect()
    assert len(again) == 61 * 4 and sum(r.vec_id is None for r in again) == 240
    for none in ([], [(1, None, 0)], [(1, [1.0, 2.0], 0)], [(1, [1.0], 0), (2, [1.0], 0)]):
        assert w.whiten(spark.createDataFrame(none, SCHEMA)).count() == 0


def test_query(spark, sf_small):
    df = QUERIES["op12_embedding_whitening"](spark, sf_small)
    vs = [r.embedding for r in spark.read.parquet(f"{sf_small}/embeddings.parquet").orderBy("vec_id").collect()]
    assert df.schema["deviation"].dataType.simpleString() == "bigint"
    check(df.collect(), vs, 8)
