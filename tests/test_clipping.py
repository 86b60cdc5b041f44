import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from rasterloom.operators import clipping as C
from rasterloom.operators.polygons import convex_hull

POINTS = st.lists(st.tuples(st.integers(-20, 20), st.integers(-20, 20)), min_size=3, max_size=9)


def star(seed, n, x, y):
    rng = np.random.default_rng(seed)
    a = (np.arange(n) + 0.8 * rng.random(n)) * 2 * np.pi / n  # gaps stay below a half turn, so the ring is simple
    r = 3 + 10 * rng.random(n)
    return np.stack([x + r * np.cos(a), y + r * np.sin(a)], axis=1)


def area(rings):
    return sum(map(C.ring_area, rings))


@settings(max_examples=300, deadline=None)
@given(POINTS, POINTS)
def test_areas_of_convex_rings(p, q):
    a, b = convex_hull(np.array(p, float)), convex_hull(np.array(q, float))
    if len(a) > 2 and len(b) > 2:
        union, ab, ba = (area(C.clipped(*x)) for x in ((a, b, "union"), (a, b, "difference"), (b, a, "difference")))
        assert abs(ab + C.ring_area(b) - union) < 1e-5 and abs(ba + C.ring_area(a) - union) < 1e-5


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**6), st.integers(4, 14), st.integers(4, 14), st.floats(-12, 12), st.floats(-12, 12))
def test_areas_of_stars(seed, n, m, x, y):
    a, b = star(seed, n, 0, 0), star(seed + 1, m, x, y)
    union, ab, ba = (area(C.clipped(*v)) for v in ((a, b, "union"), (a, b, "difference"), (b, a, "difference")))
    assert abs(ab + abs(C.ring_area(b)) - union) < 1e-4 and abs(ba + abs(C.ring_area(a)) - union) < 1e-4
    grid = np.stack(np.meshgrid(np.arange(-25, 25, 0.5) + 0.013, np.arange(-25, 25, 0.5) + 0.017), axis=-1).reshape(-1, 2)
    want = (C._inside(grid, a) | C._inside(grid, b)).sum() * 0.25
    assert abs(union - want) < 0.15 * union + 8


def test_shared_edges():
    s = np.array([[0, 0], [4, 0], [4, 4], [0, 4]], float)
    assert area(C.clipped(s, s, "union")) == 16 and area(C.clipped(s, s, "difference")) == 0
    assert area(C.clipped(s, s + (4, 0), "union")) == 32 and len(C.clipped(s, s + (4, 0), "union")) == 1
    assert area(C.clipped(s, s + (4, 0), "difference")) == 16
    assert area(C.clipped(s, s + (2, 0), "union")) == 24 and area(C.clipped(s, s + (2, 0), "difference")) == 8
    assert C.ring_area(C.outline(C.clipped(s, s / 4 + 1, "difference"))[:-1]) == 16
    assert C.outline(C.clipped(s, s * 3 - 2, "difference")) is None
    assert len(C.clipped(s, s + 10, "union")) == 2


def test_strokes(spark):
    rows = [(k, t, 3.0 * t, float(k)) for k in range(3) for t in range(6)]
    got = C.united(spark.createDataFrame(rows, "id long, t long, x double, y double"), 2.0).collect()
    assert sorted(r.id for r in got) == [0, 1, 2]
    for r in got:
        a = C.ring_area(C._points(r.ring)[:-1])
        assert 15 * 3 < a < 15 * 4 + 4 * np.pi


def test_centres_of_strokes_move_once(spark):
    rows = [(k, t, float(t * 7 % 5), float(k)) for k in range(3) for t in range(200)]
    discs = C.united(spark.createDataFrame(rows, "id long, t long, x double, y double"), 2.0)
    plan = discs._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") < plan.rindex("HashAggregate")  # from the last step to the first
    angle = np.arange(32) * 2 * np.pi / 32
    disc = np.stack([np.cos(angle), np.sin(angle)], axis=1) * 2.0
    got = {r.id: C._points(r.ring) for r in discs.collect()}
    for k in range(3):
        want = disc + (0.0, k)
        for x in (2.0, 4.0, 1.0, 3.0):
            want = C.outline(C.clipped(want, disc + (x, k), "union"))[:-1]
        assert np.array_equal(got[k][:-1], want)
