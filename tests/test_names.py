"""Unique names against the greedy rule, one row after the other."""

import random

import pytest

from rasterloom.operators import exports as X
from rasterloom.operators import polygons


def by_hand(rows, first, later, fold):
    used, out = {}, {}
    for g, i, s in sorted(rows, key=lambda r: r[1]):
        names = used.setdefault(g, set())
        name, n = first.format(s), 1
        while (name.lower() if fold else name) in names:
            n += 1
            name = later.format(s, n)
        names.add(name.lower() if fold else name)
        out[i] = name
    return out


@pytest.mark.parametrize("first, later, fold", [("{}.ome.tif", "{}_{}.ome.tif", True), ("{}", "{} ({})", False)])
def test_names(spark, first, later, fold):
    rng = random.Random(5)
    stems = ["a", "A", "a_2", "a_2_2", "A_3", "b", "b_x", "b_10", "_2", "a (2)", "a (2) (3)", "A (2)", "c.d", "c[d", "hot"]
    rows = [(rng.choice("uvw"), i, rng.choice(stems) if rng.random() < 0.6 else "hot") for i in range(500)]
    df = spark.createDataFrame(rows, "g string, i long, s string").repartition(7)
    got = {r.i: r.name for r in X.unique_names(df, "g", ["i"], "s", first, later, fold).collect()}
    assert got == by_hand(rows, first, later, fold)
    assert X.unique_names(df.limit(0), "g", ["i"], "s").columns == ["g", "i", "s", "name"]


def test_numbers_of_a_key_in_many_ranges(spark):
    df = spark.range(2000).selectExpr("id", "case when id % 10 = 0 then null when id % 3 = 0 then 'x' else 'hot' end k").repartition(5)
    want, seen = {}, {}
    for r in sorted(df.collect()):
        seen[r.k] = want[r.id] = seen.get(r.k, 0) + 1
    assert {r.id: r.n_ for r in X.numbered(df, ["k"], ["id"]).collect()} == want


def test_pixels_of_a_ring_partly_outside(spark):
    ring = [(-3.0, -2.0), (6.0, 1.0), (4.0, 9.0), (-1.0, 5.5)]
    df = spark.createDataFrame([(1, ring), (2, None), (3, [])], "id int, ring array<struct<x:double,y:double>>")

    def inside(px, py):
        edges = zip([ring[-1], *ring[:-1]], ring)
        return sum((b[1] > py) != (a[1] > py) and px < (a[0] - b[0]) * (py - b[1]) / (a[1] - b[1]) + b[0] for a, b in edges) % 2 == 1

    got = {(r.x, r.y) for r in polygons.rasterised(df, 5, 7).collect()}
    assert got == {(x, y) for x in range(5) for y in range(7) if inside(x + 0.5, y + 0.5)}
