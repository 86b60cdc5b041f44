import random

import numpy as np
import pytest

from rasterloom.operators import lines as L
from rasterloom.operators.polygons import douglas_peucker


@pytest.mark.parametrize("to_line", [False, True])
def test_same_as_one_line_after_the_other(spark, to_line):
    rng = random.Random(2)
    lines = {i: [(float(rng.randrange(40)), float(rng.randrange(40))) for _ in range(n)] for i, n in enumerate([1, 2, 3, 5, 30, 30, 200])}
    lines[9] = [(float(k), 0.0) for k in range(50)] + [(49.0, 30.0)] * 2 + [(0.0, 0.0)]  # closed, with repeats
    rows = [(i, k * 3, x, y) for i, line in lines.items() for k, (x, y) in enumerate(line)]
    got = {}
    for r in L.simplified(spark.createDataFrame(rows, "id int, k long, x double, y double").repartition(5), 3.0, to_line).collect():
        got.setdefault(r.id, {})[r.k] = (r.x, r.y)
    for i, line in lines.items():
        want = [tuple(p) for p in douglas_peucker(np.array(line), 3.0, to_line)]
        assert [got[i][k] for k in sorted(got[i])] == want


def test_no_lines(spark):
    assert L.simplified(spark.createDataFrame([], "id int, k long, x double, y double"), 1.0).count() == 0
