import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from rasterloom.operators import polygons as O

POINTS = st.lists(st.tuples(st.integers(-50, 50), st.integers(-50, 50)), min_size=3, max_size=30)


def recursive(p, eps, to_line):
    if len(p) <= 2:
        return p
    d = O._distances(p[1:-1], p[0], p[-1], to_line)
    k = int(d.argmax())
    if d[k] < eps if to_line else d[k] <= eps:
        return p[[0, -1]]
    return np.vstack([recursive(p[: k + 2], eps, to_line)[:-1], recursive(p[k + 1 :], eps, to_line)])


@settings(max_examples=150, deadline=None)
@given(POINTS, st.sampled_from([0.5, 3.0, 10.0]), st.booleans())
def test_simplification(points, eps, to_line):
    p = np.array(points, float)
    assert (O.douglas_peucker(p, eps, to_line) == recursive(p, eps, to_line)).all()
    if not to_line:
        q = O.douglas_peucker(p, eps)
        for v in p:
            assert min(O._distances(v[None], a, b, False)[0] for a, b in zip(q, q[1:])) <= eps + 1e-9


@settings(max_examples=150, deadline=None)
@given(POINTS)
def test_hull_holds_all_points(points):
    p = np.array(points, float)
    h = O.convex_hull(p)
    if len(h) >= 3:
        for a, b in zip(h, np.roll(h, -1, axis=0)):
            assert ((b - a)[0] * (p[:, 1] - a[1]) - (b - a)[1] * (p[:, 0] - a[0]) >= -1e-9).all()
    assert {tuple(x) for x in h} <= {tuple(x) for x in p}


def test_boundaries():
    assert O.boundary(np.zeros((3, 3))) == []
    assert O.boundary(np.array([[0, 0], [0, 1]])) == [(1, 1)]
    square = O.boundary(np.ones((3, 3)))
    assert len(square) == 8 and (1, 1) not in square
    ring = np.ones((5, 5))
    ring[1:4, 1:4] = 0
    assert sorted(O.boundary(ring)) == sorted((x, y) for x in range(5) for y in range(5) if x in (0, 4) or y in (0, 4))


def test_ring_simplification_keeps_a_square():
    side = [(x, 0) for x in range(10)] + [(10, y) for y in range(10)] + [(x, 10) for x in range(10, 0, -1)] + [(0, y) for y in range(10, 0, -1)]
    out = O.simplified_ring(np.array([*side, side[0]], float), 0.5)
    assert {tuple(v) for v in out} >= {(0.0, 0.0), (10.0, 0.0), (10.0, 10.0)} and (out[0] == out[-1]).all()
