import numpy as np
import pytest

from rasterloom.operators import clipping as C
from rasterloom.operators import strokes as S


def disc_of(radius, segments=32):
    a = np.arange(segments) * 2 * np.pi / segments
    return np.stack([np.cos(a), np.sin(a)], axis=1) * radius


def one_by_one(centres, disc):
    ring = disc + tuple(centres[0])
    for c in centres[1:]:
        ring = C.outline(C.clipped(ring, disc + tuple(c), "union"))[:-1]
    return ring


RNG = np.random.default_rng(4)
STROKES = [
    ([np.stack([RNG.permutation(97)[:20] / 4, np.full(20, k % 7.0)], axis=1) for k in range(20)], 5.0, 32),  # as the query has them
    ([RNG.uniform(0, 20, (RNG.integers(1, 12), 2)) for _ in range(20)], 5.0, 32),
    ([RNG.integers(0, 12, (12, 2)).astype(float) for _ in range(20)], 2.0, 32),  # corners that meet, rings with holes, parts apart
    ([RNG.integers(0, 12, (12, 2)).astype(float) for _ in range(20)], 2.0, 4),  # shared edges
    ([RNG.uniform(0, 1e5, (4, 2)) for _ in range(5)], 1e-3, 32),
]


@pytest.mark.parametrize("strokes, radius, segments", STROKES)
def test_strokes_at_once(strokes, radius, segments):
    disc = disc_of(radius, segments)
    got = S.unions(np.array([len(c) for c in strokes]), np.concatenate(strokes), disc, radius)
    for ring, c in zip(got, strokes, strict=True):
        assert np.array_equal(ring, one_by_one(c, disc))


def test_hardly_any_step_is_done_alone(monkeypatch):
    """The time of a union: one stroke's disc at a time took 2.4 ms, whatever the number of strokes."""
    alone = []
    monkeypatch.setattr(S, "clipped", lambda *a: alone.append(0) or C.clipped(*a))
    n = 40
    strokes = [np.stack([np.random.default_rng(k).permutation(97)[:n] / 4, np.full(n, k % 7.0)], axis=1) for k in range(100)]
    S.unions(np.full(100, n), np.concatenate(strokes), disc_of(5.0), 5.0)
    assert len(alone) < 0.02 * 100 * n


def test_outline_goes_on_over_batches(spark, monkeypatch):
    rows = [(k if k < 6 else None, t, float(t * 5 % 13), float((k or 0) + t % 3)) for k in range(7) for t in range(30)]
    df = spark.createDataFrame(rows, "id long, t long, x double, y double")
    monkeypatch.setattr(C, "CENTRES", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {r.id: C._points(r.ring)[:-1] for r in C.united(df, 2.0).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 7
    for k in [*range(6), None]:
        own = list(dict.fromkeys((x, y) for i, t, x, y in rows if i == k))
        assert np.array_equal(got[k], one_by_one(np.array(own), disc_of(2.0)))
    assert C.united(df.limit(0), 2.0).count() == 0
