from fractions import Fraction

import numpy as np
import pytest

from quern.llm import whitening as W


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string, whitened int")


def vectors(n=60, width=5, seed=1):
    made = np.random.default_rng(seed)
    return (made.normal(size=(n, width)) @ made.normal(size=(width, width))).round(3)


def exact(xs):
    """Sums and covariance by fractions."""
    n, d = len(xs), len(xs[0])
    sums = [sum(x[i] for x in xs) for i in range(d)]
    cov = [[sum((n * x[i] - sums[i]) * (n * x[j] - sums[j]) for x in xs) / Fraction(n) ** 3 for j in range(d)] for i in range(d)]
    return sums, np.array([[float(c) for c in r] for r in cov])


def test_against_fractions(spark):
    data = vectors().tolist()
    rows = [(i, v, "x", 1) for i, v in enumerate(data)]
    odd = [(100, None, "x", 1), (101, [1.0, None, 0.0, 0.0, 0.0], "x", 1), (102, [float("nan")] * 5, "x", 1), (103, [float("-inf")] * 5, "x", 1), (104, [], "x", 1), (105, [1.0], "x", 1)]
    rows += [(None, data[3], None, None), (7, data[7], "x", 1)]
    got = W.op13_whitening(table(spark, [*rows, *odd])).collect()
    xs = [[int(np.floor(64 * c)) + 1000000 for c in v] for _, v, _, _ in rows]
    sums, cov = exact(xs)
    n = len(rows)
    values, basis = np.linalg.eigh(cov)
    assert len(got) == 5 * n and {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-9
    by = {(r.vec_id, r.component): r for r in got}
    for i, x in [(r[0], x) for r, x in zip(rows, xs, strict=True)]:
        far = np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums, strict=True)])
        for k in range(5):
            r = by[i, k + 1]
            assert r.deviation == sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
            assert r.explained == pytest.approx(values[4 - k] / cov.trace(), rel=1e-9)
            assert abs(r.whitened) == pytest.approx(abs(far @ basis[:, 4 - k]) / values[4 - k] ** 0.5, rel=1e-8, abs=1e-9)
    for k in range(1, 6):  # one sign for all rows
        signs = {np.sign(by[i, k].whitened * (np.array(x) - np.array(sums) / n).dot(basis[:, 5 - k])) for i, x in zip(range(20), xs, strict=False)}
        assert len(signs) == 1


def test_sums_keep_what_doubles_lose():
    values = np.array([[1e16], [1.0], [-1e16], [1e-3]])
    high, low = W._total(values, np.zeros_like(values))
    assert high[0] + low[0] == pytest.approx(1.001, rel=1e-12)
    a, b = np.array([1 + 2.0**-30]), np.array([1 - 2.0**-30])
    p, e = W._two_product(a, b)
    assert Fraction(p[0]) + Fraction(e[0]) == Fraction(a[0]) * Fraction(b[0])


def test_empty_single_and_flat(spark):
    assert W.op13_whitening(table(spark, [])).collect() == []
    (r,) = W.op13_whitening(table(spark, [(1, [0.5], "x", 1)])).collect()
    assert (r.component, r.n, r.deviation, r.whitened, r.identity_error) == (1, 1, 0, None, None)
    flat = [(i, [float(i), 2.0 * i, 5.0], "x", 1) for i in range(40)]
    got = W.op13_whitening(table(spark, flat)).collect()
    assert len(got) == 120 and all((r.whitened is None) == (r.component > 1) for r in got)
    assert {round(r.explained, 9) for r in got if r.component == 1} == {1.0}


def test_all_columns_and_reruns(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    a, b = (sorted(map(tuple, W.op13_whitening(df).collect())) for _ in range(2))
    assert a == b and len(a) == 32 * df.count()
