import math
from fractions import Fraction

import numpy as np
import pytest

from rasterloom.llm import queries
from rasterloom.llm import whitening as W


def brute(rows, components=16):
    """By exact sums and numpy's eigenvectors; the signs are open."""
    own = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in own})
    n = len(fit)
    sums = [sum(c) for c in zip(*fit)]
    exact = np.array([[n * a - s for a, s in zip(x, sums)] for x in fit], dtype=object)
    centred = (exact / n).astype(float)
    value, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-value)
    value, axes = value[order], axes[:, order]
    out = []
    for i, x in own:
        d = [n * a - s for a, s in zip(x, sums)]
        c = np.array([float(Fraction(a, n)) for a in d])
        for k in range(min(components, int((value > 1e-12 * value[0]).sum()))):
            out.append((i, k + 1, n, sum(a * a for a in d), float(c @ axes[:, k] / math.sqrt(value[k])), value[k] / value.sum()))
    return out


def compare(got, want):
    got = sorted([tuple(r) for r in got], key=lambda r: (r[0] is None, r[0] or 0, r[1], r[3], abs(r[4])))
    want = sorted(want, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[3], abs(r[4])))
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert np.allclose([abs(r[4]) for r in got], [abs(r[4]) for r in want], atol=1e-6, rtol=1e-6)
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-8)
    sign = {}
    for g, w in zip(got, want):
        if abs(w[4]) > 1e-3:
            assert sign.setdefault(g[1], math.copysign(1, g[4] * w[4])) == math.copysign(1, g[4] * w[4])
    assert len({r[6] for r in got}) == 1 and got[0][6] <= 1e-9


@pytest.fixture(scope="module")
def crafted():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 7)) @ np.diag([300, 90, 30, 9, 3, 1, 0.3]) @ np.linalg.qr(rng.normal(size=(7, 7)))[0]
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    return rows + rows[:40] + [(1000 + i, rows[0][1]) for i in range(200)] + [(None, rows[1][1])]


def test_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    compare(queries.op13_whitening(spark, "/root/testdata/sf0.01").collect(), brute(rows))


@pytest.mark.parametrize("block, fan", [(1 << 20, 16), (20, 2)])
def test_crafted(spark, crafted, monkeypatch, block, fan):
    monkeypatch.setattr(W, "BLOCK", block)
    monkeypatch.setattr(W, "FAN", fan)
    bad = [(1, None), (2, []), (3, [1.0] * 6 + [None]), (4, [1.0] * 6 + [math.nan]), (5, [math.inf] + [0.0] * 6), (6, [1.0, 2.0]), (7, [1.0] * 9)]
    table = spark.createDataFrame(crafted + bad, "vec_id long, embedding array<float>").repartition(11)
    compare(W.whitened(table).collect(), brute(crafted))
    compare(W.whitened(table, 3).collect(), brute(crafted, 3))


@pytest.mark.parametrize("shape", [(9, 6), (5, 5), (3, 8), (40, 31)])
def test_jacobi_keeps_small_values(shape):
    rng = np.random.default_rng(shape[0])
    k = min(shape)
    u, v = np.linalg.qr(rng.normal(size=(shape[0], k)))[0], np.linalg.qr(rng.normal(size=(shape[1], k)))[0]
    s = np.logspace(6, 0, k)
    got, axes = W.jacobi(u @ np.diag(s) @ v.T)
    assert np.allclose(got[:k], s, rtol=1e-8) and np.allclose(axes.T @ axes, np.eye(shape[1]), atol=1e-13)
    assert np.allclose(np.abs((axes[:, :k] * v).sum(axis=0)), 1, atol=1e-8)
    assert np.allclose(got[k:], 0, atol=1e-6)


def test_columns_of_different_size_keep_their_digits():
    a = np.array([[1.0, 1.0, 1.0], [0, 1, 1], [0, 0, 1], [0, 0, 0]]) @ np.diag([1e12, 1.0, 1e-9])
    got, _ = W.jacobi(a)
    assert math.isclose(np.prod(got), 1e12 * 1e-9, rel_tol=1e-12)  # the determinant; a covariance would lose the last value


def test_every_pair_meets_once():
    for d in (2, 4, 10):
        pairs = [tuple(sorted(p)) for i, j in W._rounds(d) for p in zip(i.tolist(), j.tolist())]
        assert sorted(pairs) == [(a, b) for a in range(d) for b in range(a + 1, d)]


def test_large_numbers_are_exact(spark):
    rows = [(1, [1e300, 0.0]), (2, [3.0e9, 5.0]), (3, [-1e300, 7.0]), (4, [2.0**31, -9.0])]
    got = {(r.vec_id, r.component): r for r in W.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    cut = {i: [max(-(2**45), min(2**45, math.floor(min(max(64 * c, -2.0**60), 2.0**60)))) for c in v] for i, v in rows}
    sums = [sum(v[k] for v in cut.values()) for k in (0, 1)]
    for (i, _), r in got.items():
        want = sum((4 * a - s) ** 2 for a, s in zip(cut[i], sums))
        assert r.deviation == (want if want < 2**63 else None)
    assert len(got) == 4 * len({c for _, c in got})


def test_no_variance_empty_and_clashing_names(spark):
    schema = "vec_id long, embedding array<float>, component string, X int, n double, dims int"
    rows = [(i, [float(i), 2.0 * i, 5.0], "a", 1, 0.5, 3) for i in range(4)]
    table = spark.createDataFrame(rows, schema)
    compare(W.whitened(table).collect(), brute([r[:2] for r in rows]))  # one component has variance
    assert W.whitened(table.where("vec_id = 1")).count() == 0
    assert W.whitened(table.limit(0)).count() == 0 and W.whitened(table.limit(0)).columns[0] == "vec_id"
    assert W.whitened(spark.createDataFrame([(1, None), (2, [])], "vec_id long, embedding array<float>")).count() == 0
