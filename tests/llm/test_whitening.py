"""Exact whitening against numpy, and the polynomial, root and scatter steps against plain versions."""

import math

import numpy as np
import pytest

from strandlake.llm import whitening as w


def brute(vectors, count=8):
    """(deviations, eigenvalues, whitened up to sign, trace) by numpy."""
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    deviation = [int(sum((n * a - b) ** 2 for a, b in zip(r, sums, strict=True))) for r in x]
    centred = (x * n - sums).astype(float) / n
    values, vecs = np.linalg.eigh(centred.T @ centred / n)
    keep = [i for i in np.argsort(-values)[:count] if values[i] > 1e-9 * max(values.max(), 1e-300)]
    return deviation, values[keep], centred @ vecs[:, keep] / np.sqrt(values[keep]), values.sum()


def check(spark, vectors, rows=None):
    df = spark.createDataFrame([(i, [float(c) for c in v], 3) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, n int")
    got = {(r.vec_id, r.component): r for r in w.whiten(df).collect()}
    deviation, values, white, trace = brute(vectors)
    assert set(got) == {(i, k + 1) for i in range(len(vectors)) for k in range(len(values))}
    signs = [1 if got[int(np.argmax(abs(white[:, k]))), k + 1].whitened * white[np.argmax(abs(white[:, k])), k] > 0 else -1 for k in range(len(values))]
    for (i, k), r in got.items():
        assert r.n == len(vectors) and r.deviation == deviation[i] and r.identity_error < 1e-9
        assert abs(r.explained - values[k - 1] / trace) < 1e-9 and abs(r.whitened * signs[k - 1] - white[i, k - 1]) < 1e-6 * (1 + abs(white[i, k - 1]))


def test_random_and_correlated_vectors_equal_numpy(spark):
    rng = np.random.default_rng(1)
    check(spark, rng.normal(size=(300, 12)) * np.geomspace(3, 0.05, 12))
    check(spark, rng.integers(-4, 5, (60, 3)) @ rng.integers(-4, 5, (3, 10)))  # rank 3, exactly
    check(spark, rng.normal(size=(40, 1)))
    check(spark, rng.normal(size=(5, 9)))


def test_repeated_eigenvalues_and_zero_ones(spark):
    rows = [[s * 5.0 if i == j else 0.0 for j in range(4)] for i in range(3) for s in (1, -1)]
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    got = w.whiten(df).collect()
    assert {r.component for r in got} == {1, 2, 3} and all(abs(r.explained - 1 / 3) < 1e-12 and r.identity_error < 1e-12 for r in got)
    by = {(r.vec_id, r.component): r.whitened for r in got}
    assert all(abs(sum(by[i, k] ** 2 for k in (1, 2, 3)) - 3) < 1e-9 for i in range(6))


def test_rows_left_out_and_no_components(spark):
    schema = "vec_id long, embedding array<float>, y int, w string, d int"
    rows = [(1, [1.0, 2.0], 0, "", 0), (1, [1.0, 2.0], 0, "", 0), (None, [0.5, -1.0], 1, None, 1), (4, None, 0, "", 0), (5, [1.0, None], 0, "", 0), (6, [math.nan, 1.0], 0, "", 0), (7, [math.inf, 1.0], 0, "", 0), (8, [], 0, "", 0), (9, [1.0, 2.0, 3.0], 0, "", 0), (10, [3e38, 0.0], 0, "", 0)]
    got = w.whiten(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.vec_id or 0, r.component, r.n) for r in got) == [(0, 1, 3), (1, 1, 3), (1, 1, 3)]
    for few in ([], rows[:1], rows[:2], rows[3:8]):
        out = w.whiten(spark.createDataFrame(few, schema))
        assert out.collect() == [] and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_scatter_is_exact_beyond_doubles(spark):
    rows = [[(1 << 61) + 3, -(1 << 50) + 1, 5], [-(1 << 61) - 7, 12345678901, -3], [17, -(1 << 45), 1 << 20]]
    df = spark.createDataFrame([(r,) for r in rows], "y array<long>")
    n, sums, g = w.scatter(df, 3)
    assert n == 3 and sums == [sum(r[j] for r in rows) for j in range(3)]
    assert g == [[3 * sum(r[i] * r[j] for r in rows) - sums[i] * sums[j] for j in range(3)] for i in range(3)]


def test_deviation_beyond_a_long_is_null(spark):
    df = spark.createDataFrame([(0, [1e12, 0.0]), (1, [-1e12, 1.0]), (2, [0.0, 2.0])], "vec_id long, embedding array<double>")
    got = {(r.vec_id, r.component): r for r in w.whiten(df).collect()}
    assert got[0, 1].deviation is None and got[2, 1].deviation == 9 * 1024 ** 2 and got[0, 1].identity_error < 1e-4


@pytest.mark.parametrize("d", [1, 2, 3, 6])
def test_polynomial_and_roots(spark, d):
    rng = np.random.default_rng(d)
    a = rng.integers(-50, 50, (d + 2, d)).astype(object)
    m = (a.T @ a).tolist()
    poly = w.polynomial(spark, m)
    # Leverrier's recursion.
    want, power = [1], np.array(m, dtype=object)
    eye = np.array([[int(i == j) for j in range(d)] for i in range(d)], dtype=object)
    step = eye
    for k in range(1, d + 1):
        prod = power @ step
        c = -int(np.trace(prod)) // k
        want.append(c)
        step = prod + c * eye
    assert poly == want
    values = np.sort(np.linalg.eigvalsh(np.array(m, dtype=float)))[::-1]
    for x in (0, 100, 5000):
        assert w.roots_above(poly, x) == (values > x + 1e-6).sum()
    roots = w.largest_roots(poly, d)
    assert np.allclose([r / (1 << s) for r, s, _ in roots], values) and all(m == 1 for *_, m in roots)


def test_roots_of_any_size_and_multiplicity():
    poly = [1]
    for r in (10**30, 10**30, 7, 7, 7, 1, 0):
        poly = [a - r * b for a, b in zip([*poly, 0], [0, *poly], strict=True)]
    assert [(r + (1 << s - 1) >> s, m) for r, s, m in w.largest_roots(poly, 6)] == [(10**30, 2), (7, 3), (1, 1)]
    assert [m for *_, m in w.largest_roots(poly, 1)] == [2] and w.largest_roots([1, 0, 0], 4) == []


def test_whole_table_has_unit_covariance(spark):
    got = w.whiten(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet"))
    rows = got.filter("component <= 2").collect()
    assert got.count() == 8 * rows[0].n and rows[0].identity_error < 1e-9
