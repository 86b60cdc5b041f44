"""Fits and exchanges against the same by hand."""

import numpy as np
from pyspark.sql import functions as F

from rasterloom.operators import palette as P
from rasterloom.operators import statistics as S


def by_hand(values):
    """Expectation maximisation over the same bins with numpy."""
    bins, n = np.unique(np.floor(np.log2(values) * 16), return_counts=True)
    x = (bins + 0.5) / 16
    width = max((x[-1] - x[0]) / 6, 1 / 16)
    m, v, w = x[0] + (x[-1] - x[0]) * (np.arange(3) + 0.5) / 3, np.full(3, width**2), np.full(3, 1 / 3)
    likelihood = []
    for _ in range(60):
        d = w / np.sqrt(v) * np.exp(-((x[:, None] - m) ** 2) / (2 * v)) + 1e-300
        likelihood.append(float(n @ np.log(d.sum(axis=1))))
        r = d / d.sum(axis=1, keepdims=True) * n[:, None]
        s = r.sum(axis=0)
        w, m = s / n.sum(), (r * x[:, None]).sum(axis=0) / s
        v = np.maximum(1 / (12 * 256), (r * x[:, None] ** 2).sum(axis=0) / s - m**2)
    assert all(b >= a - 1e-6 * abs(a) for a, b in zip(likelihood, likelihood[1:]))
    o = np.argsort(m)
    return w[o], m[o], v[o]


def test_three_planted_modes(spark):
    rng = np.random.default_rng(1)
    planted = {"a": [(6, 0.3, 3000), (9, 0.4, 1500), (13, 0.5, 500)], "b": [(4, 0.2, 500), (8, 0.2, 500), (11, 0.2, 500)]}
    rows = [(c, int(v)) for c, modes in planted.items() for m, s, n in modes for v in 2 ** rng.normal(m, s, n)]
    rows += [("a", 0)] * 100 + [("few", v) for v in (3, 5, 9)] + [("none", 0)] * 5
    pixels = spark.createDataFrame(rows, "channel string, v long").withColumn("i", F.lit(0))
    got = {r.channel: r.modes for r in S.modes(pixels).collect()}
    for c, modes in planted.items():
        w, m, v = by_hand(np.array([x for k, x in rows if k == c and x > 0]))
        assert np.allclose([k.m for k in got[c]], m, atol=1e-6) and np.allclose([k.w for k in got[c]], w, atol=1e-6) and np.allclose([k.v for k in got[c]], v, atol=1e-6)
        total = sum(n for _, _, n in modes)
        assert all(abs(k.m - m_) < 0.1 and abs(k.w - n / total) < 0.03 for k, (m_, _, n) in zip(got[c], modes))
    limits = {r.channel: (r.lower, r.upper) for r in S.mixture_limits(pixels).collect()}
    assert 2**6.8 < limits["a"][0] < 2**8 and 2**13.5 < limits["a"][1] <= 2**15
    plain = {r.channel: (r.lower, r.upper) for r in S.percentile_limits(pixels).collect()}
    assert limits["few"] == plain["few"] and limits["none"] == plain["none"] and limits["a"] != plain["a"]


def lab(c):
    r = [x / 255 for x in c]
    r = [x / 12.92 if x <= 0.04045 else ((x + 0.055) / 1.055) ** 2.4 for x in r]
    return np.array(P._LAB) @ np.cbrt(np.array(P._CONES) @ r)


def nearest(colours):
    return min(np.linalg.norm(lab(a) - lab(b)) for i, a in enumerate(colours) for b in colours[:i])


def test_palettes(spark):
    groups = [(1, [(255, 0, 0), (250, 0, 0), (255, 5, 0), (0, 0, 255)], [False, False, True, False]), (2, [(1, 2, 3), (1, 2, 4)], [True, True]), (3, [(9, 9, 9)], [False]), (4, [(0, 0, 0)] * 6, [False] * 6)]
    df = spark.createDataFrame(groups, "group int, colours array<struct<r:int,g:int,b:int>>, locked array<boolean>")
    got = {r.group: r for r in P.optimised(df).collect()}
    again = {r.group: r for r in P.optimised(df.repartition(3)).collect()}
    assert got == again
    for g, colours, locked in groups:
        found = [tuple(c) for c in got[g].colours]
        assert all(f == c for f, c, fixed in zip(found, colours, locked) if fixed)
        if len(colours) > 1:
            assert abs(got[g].spread - nearest(found)) < 1e-6 and nearest(found) >= nearest(colours)
    assert [tuple(c) for c in got[2].colours] == groups[1][1] and [tuple(c) for c in got[3].colours] == groups[2][1] and got[3].spread is None
    assert got[1].spread > 0.2 and got[4].spread > 0.25
    light = [tuple(c) for c in got[4].colours]
    assert len(set(light)) == 6 and all(lab(c)[0] >= P.LEAST_LIGHT for c in light if c != (0, 0, 0))
