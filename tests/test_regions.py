"""Loops, regions and their outlines against walks, pixel sets and flood fills."""

import random

import pytest

from rasterloom.operators import contours as C
from rasterloom.operators import intervals as I
from rasterloom.operators import links
from rasterloom.operators import regions as O


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_list_ranking(spark):
    rng = random.Random(1)
    want, chained = set(), []
    table = []
    for plane, sizes in ((0, [1, 2, 3, 257]), (1, [64, 65, 5])):
        names = rng.sample(range(-1000, 1000), sum(sizes) + 9)
        for n in sizes:
            ring, names = names[:n], names[n:]
            table += [(plane, a, ring[(i + 1) % n]) for i, a in enumerate(ring)]
            start = ring.index(min(ring))
            want |= {(plane, ring[(start + i) % n], min(ring), i, n) for i in range(n)}
        chained += [(plane, a, b) for a, b in zip(names, names[1:])]  # its last node has no successor
    rng.shuffle(table)
    links_of = spark.createDataFrame(table + chained, "plane int, node long, next long").repartition(5)
    assert {tuple(r) for r in links.loops(links_of).select("plane", "node", "loop", "pos", "n").collect()} == want
    assert links.loops(links_of.where("plane = 9")).count() == 0
    assert links.loops(spark.createDataFrame(chained, "plane int, node long, next long")).count() == 0


def mask(spark, lines):
    return spark.createDataFrame([(0, x, y, int(c == "#")) for y, line in enumerate(lines) for x, c in enumerate(line)], "plane int, x int, y int, v int")


def test_contours_hole_saddle_border_and_dot(spark):
    lines = [
        "............",
        ".####..#....",
        ".#..#.......",  # a hole
        ".#..#..##...",
        ".####..##.##",
        ".........###",  # meets the border: open
        ".##.........",
        "...##.......",  # touches the one above at a corner only
        "............",
    ]
    sized = C.outer(C.areas(C.loops(mask(spark, lines), 12, 9)))
    got = rows(sized, "area", "outer", "hull", "n")
    # corners are cut: half a pixel less in all around each piece; the single dot is no loop
    assert [g[0] for g in got] == [-3.5, 1.5, 1.5, 3.5, 15.5]
    assert [g[1] for g in got] == [False, True, True, True, True] and [g[2] for g in got] == [False] * 4 + [True]


def test_positive_area_first_then_negative(spark):
    sized = spark.createDataFrame([(0, 1, 9, -5.0), (0, 2, 9, -7.0), (1, 3, 9, 2.0), (1, 4, 9, -7.0), (1, 5, 9, 2.0)], "plane int, loop long, n long, area double")
    assert rows(C.outer(sized), "loop", "outer", "hull") == [(1, True, False), (2, True, True), (3, True, True), (4, False, False), (5, True, False)]


def pixels(intervals):
    return {(r.id, x, r.y) for r in intervals.collect() for x in range(r.x0, r.x1)}


def as_rows(spark, cells):
    return spark.createDataFrame([(i, y, x, x + 1) for i, x, y in cells] or [(0, 0, 0, 0)], "id int, y long, x0 long, x1 long")


@pytest.fixture(scope="module")
def scenes():
    rng = random.Random(7)
    return [{(i, x, y) for i in range(6) for x in range(9) for y in range(8) if rng.random() < 0.2 + 0.12 * i} for _ in range(2)]


def test_set_operations(spark, scenes):
    a, b = scenes
    da, db = as_rows(spark, a), as_rows(spark, b)
    assert pixels(O.united(da, db)) == a | b
    assert pixels(O.without(da, db)) == a - b
    assert pixels(I.combined(da, db, ("id", "y"), I.INTERSECTION)) == a & b
    assert pixels(I.combined(da, db, ("id", "y"), I.EXCLUSIVE)) == a ^ b
    merged = O.united(da, db).collect()
    assert not {(r.id, r.y, r.x1) for r in merged} & {(r.id, r.y, r.x0) for r in merged}  # as few rows as possible
    assert pixels(I.united(da.unionByName(da).unionByName(db), ("id", "y"))) == a | b


def flood_hull(cells):
    """Area within the outer ring of each 4-connected piece, the largest."""
    best, left = 0, set(cells)
    while left:
        piece, todo = set(), [left.pop()]
        while todo:
            x, y = p = todo.pop()
            piece.add(p)
            for q in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if q in left:
                    left.remove(q)
                    todo.append(q)
        x0, x1, y0, y1 = min(x for x, _ in piece) - 1, max(x for x, _ in piece) + 1, min(y for _, y in piece) - 1, max(y for _, y in piece) + 1
        out, todo = {(x0, y0)}, [(x0, y0)]
        while todo:  # the outside leaks through corners, as the ring's holes do not
            x, y = todo.pop()
            for q in ((x + dx, y + dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)):
                if q not in out and q not in piece and x0 <= q[0] <= x1 and y0 <= q[1] <= y1:
                    out.add(q)
                    todo.append(q)
        best = max(best, (x1 - x0 + 1) * (y1 - y0 + 1) - len(out))
    return best


def test_outlines(spark, scenes):
    cells = scenes[0] | {(9, x - 5, y - 3) for _, x, y in scenes[1]} | {(10, 0, 0), (10, 1, 1), (10, 2, 0), (10, 1, -1)}
    region = I.united(as_rows(spark, cells), ("id", "y"))
    points = O.outlines(region).collect()
    rings = {}
    for r in sorted(points, key=lambda r: r.pos):
        rings.setdefault((r.plane, r.loop), []).append((r.x, r.y))
        assert 0 <= r.pos < r.n
    area = {}
    for (i, _), ring in rings.items():
        assert len(ring) >= 4
        for (x, y), (u, v) in zip(ring, ring[1:] + ring[:1]):
            assert (x == u) != (y == v)  # a straight border
            area[i] = area.get(i, 0) + (x * v - u * y) / 2
        turns = [(a[0] == b[0]) != (b[0] == c[0]) for a, b, c in zip(ring, ring[1:] + ring[:1], ring[2:] + ring[:2])]
        assert all(turns)  # corners only
    assert area == {i: sum(c[0] == i for c in cells) for i in {c[0] for c in cells}}
    assert len([k for k in rings if k[0] == 10]) == 4  # pixels that touch at corners are pieces of their own
    sides = {i: sum((i, x + dx, y + dy) not in cells for j, x, y in cells if j == i for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))) for i in area}
    assert {r.id: (r.area, r.perimeter) for r in O.measured(region).collect()} == {i: (area[i], sides[i]) for i in area}
    got = {r.id: r.area for r in O.hulls(region).select("id", "area").distinct().collect()}
    assert got == {i: flood_hull({c[1:] for c in cells if c[0] == i}) for i in area}


def test_edits(spark):
    base = as_rows(spark, {(i, x, y) for i in range(4) for x in range(3) for y in range(3)})
    touching, apart, whole = {(0, x, 2) for x in range(2, 6)}, {(1, 7, 7)}, {(2, x, y) for x in range(3) for y in range(3)}
    brush = as_rows(spark, touching | apart | whole | {(8, 0, 0)})
    before = pixels(base)
    assert pixels(O.edited(base, brush, "add")) == before | touching
    assert pixels(O.edited(base, brush, "subtract")) == before - touching
    assert rows(O.overlapping(base, brush), "id") == [(0,), (2,)]
    assert pixels(O.edited(base, brush.limit(0), "add")) == before == pixels(O.edited(base, brush.limit(0), "subtract"))


def test_discs_and_rings(spark):
    rng = random.Random(3)
    discs = [(i, rng.choice([rng.uniform(-3, 25), float(rng.randrange(20))]), rng.choice([rng.uniform(-3, 25), float(rng.randrange(20))]), rng.choice([0.0, 0.5, 1.0, 5.0, 13.0, rng.uniform(0, 9)])) for i in range(60)]
    got = pixels(O.of_discs(spark.createDataFrame(discs, "id int, x double, y double, r double"), 20, 15))
    assert got == {(i, x, y) for i, cx, cy, r in discs for x in range(20) for y in range(15) if (x - cx) ** 2 + (y - cy) ** 2 <= r * r}
    rings = [(i, [(rng.choice([rng.uniform(-4, 24), float(rng.randrange(20)), rng.randrange(20) + 0.5]), float(rng.randrange(-2, 18)) / rng.choice([1, 2])) for _ in range(rng.randrange(0, 9))]) for i in range(60)]

    def inside(ring, px, py):
        return sum((b[1] > py) != (a[1] > py) and px < (a[0] - b[0]) * (py - b[1]) / (a[1] - b[1]) + b[0] for a, b in zip([ring[-1], *ring[:-1]], ring)) % 2 == 1

    got = pixels(O.of_rings(spark.createDataFrame(rings, "id int, ring array<struct<x:double,y:double>>"), 20, 15))
    assert got == {(i, x, y) for i, ring in rings if ring for x in range(20) for y in range(15) if inside(ring, x + 0.5, y + 0.5)}


def test_sets_are_dealt_over_tasks_by_their_size(spark, monkeypatch):
    rows = [(i, y, x, x + 2) for i in range(3) for y in range(10) for x in range(0, 12, 3)]
    a = spark.createDataFrame(rows, "id long, y long, x0 long, x1 long")
    b = spark.createDataFrame([(i, y, x0 + 1, x1 + 1) for i, y, x0, x1 in rows], "id long, y long, x0 long, x1 long")
    monkeypatch.setattr(I, "TASK_ENDS", 40)
    got = I.combined(a, b, ("id", "y"), I.UNION)
    assert got.rdd.getNumPartitions() == 12  # 480 ends
    assert sorted(map(tuple, got.collect())) == [(i, y, 0, 12) for i in range(3) for y in range(10)]
