"""Exact cross-products by bit planes, and whitening against plain arithmetic."""

from fractions import Fraction

import numpy as np
import pytest

from foliant.llm import bit_whitening as w

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("top", [2, 300, 1 << 30, (1 << 53) - 1])
@pytest.mark.parametrize("rows", [1, 64, 130])
def test_cross_products_are_exact(top, rows):
    rng = np.random.default_rng(rows)
    y = rng.integers(0, top, (rows, 5), dtype=np.int64)
    y[:, 2] = 0
    bits = [int(c).bit_length() for c in y.max(0)]
    sums, cross = w.cross_products(y, bits)
    exact = y.astype(object)
    assert sums.tolist() == exact.sum(0).tolist()
    assert cross.tolist() == (exact.T @ exact).tolist()


def plain(vectors):
    """Fit list, sums and covariance with fractions."""
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors]
    fit = sorted(set(map(tuple, x)))
    n, width = len(fit), len(fit[0])
    sums = [sum(v[d] for v in fit) for d in range(width)]
    cov = [[float(sum(Fraction(v[i]) * v[j] for v in fit) / n - Fraction(sums[i]) * sums[j] / n ** 2)
            for j in range(width)] for i in range(width)]
    return x, fit, n, sums, np.array(cov)


def check(rows, got, components=16):
    x, fit, n, sums, cov = plain([v for _, v in rows])
    size = min(components, len(sums))
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:size], vectors[:, ::-1][:, :size]
    assert len(got) == len(rows) * size
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {})[r.component] = r
    signs = {}
    for (vec_id, _), v in zip(rows, x):
        dev = [n * a - s for a, s in zip(v, sums)]
        for k in range(size):
            r = by[vec_id][k + 1]
            assert r.n == n and r.deviation == sum(d * d for d in dev)
            assert r.explained == pytest.approx(values[k] / np.trace(cov), rel=1e-9)
            assert r.identity_error < 1e-9
            want = float(np.dot([d / n for d in dev], vectors[:, k]) / np.sqrt(values[k]))
            if abs(want) > 1e-3:
                signs.setdefault(k, np.sign(want * r.whitened))
                assert r.whitened == pytest.approx(want * signs[k], rel=1e-6)


def test_against_fractions(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 20)) * np.linspace(3, 0.3, 20)
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[5][1]) for i in range(200)]  # a hot copy counts once
    rows.append((2000, [-1e-20] * 20))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr(
        "*", "1 AS x", "2 AS n").repartition(7)
    check(rows, w.whiten(df).collect())


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0]),
            (None, [0.5, 1.0]), (7, [2.0, 1.0]), (7, [2.0, 1.0]), (8, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, w.whiten(df).collect()), key=repr)
    assert len(got) == 4 * 2 and {r[2] for r in got} == {3}
    second = [r for r in got if r[1] == 2]  # a dimension without variance
    assert all(r[4] is None and r[5] == pytest.approx(0) for r in second)
    first = {r[0]: r[4] for r in got if r[1] == 1}
    assert first[7] == pytest.approx(-first[None] * 5 / 4, rel=1e-9) or first[7] > 0
    assert w.whiten(df.limit(0)).collect() == []
    assert w.whiten(df.filter("vec_id = 8")).count() == 2  # one vector: no variance at all
    huge = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0])],
                                 "vec_id long, embedding array<double>")
    assert [r.deviation for r in w.whiten(huge).collect()] == [None] * 4


def test_whole_query(spark):
    from foliant.llm.queries import op12_bit_whitening
    rows = [(r.vec_id, [float(c) for c in r.embedding]) for r in spark.read.parquet(
        f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check(rows, op12_bit_whitening(spark, SF).collect())
