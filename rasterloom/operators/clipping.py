"""Union and difference of simple rings, by splitting edges where they meet and joining the pieces that bound the result."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .polygons import RING

_EPS = 1e-9

#: Centres of strokes that grow together, about.
CENTRES = 1 << 15


def _next(p: np.ndarray) -> np.ndarray:
    """The point after each; np.roll takes many times longer for short rings."""
    return np.concatenate([p[1:], p[:1]])


def ring_area(p: np.ndarray) -> float:
    q = _next(p)
    return float((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum() / 2)


def _oriented(p: np.ndarray) -> np.ndarray:
    """The ring without a closing or repeated point, counter-clockwise."""
    p = np.asarray(p, float).reshape(-1, 2)
    p = p[(p != np.concatenate([p[-1:], p[:-1]])).any(axis=1)]
    return p if len(p) < 3 or ring_area(p) > 0 else p[::-1]


def _inside(m: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Even-odd rule for many points."""
    a, b = ring, np.concatenate([ring[-1:], ring[:-1]])
    y = m[:, 1:2]
    span = (a[:, 1] > y) != (b[:, 1] > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        x = (b[:, 0] - a[:, 0]) * (y - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0]
    return (span & (m[:, 0:1] < x)).sum(axis=1) % 2 == 1


def _edges(ring: np.ndarray) -> np.ndarray:
    """Edges (p, q) of a ring."""
    return np.stack([ring, _next(ring)], axis=1)


def _split(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Pieces (p, q) of edges, cut where the other edges meet them."""
    if not len(own) or not len(other):
        return own
    p, d = own[:, 0], own[:, 1] - own[:, 0]
    b, e = other[:, 0], other[:, 1] - other[:, 0]
    w = b[None] - p[:, None]
    cross = d[:, None, 0] * e[None, :, 1] - d[:, None, 1] * e[None, :, 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (w[..., 0] * e[None, :, 1] - w[..., 1] * e[None, :, 0]) / cross
        u = (w[..., 0] * d[:, None, 1] - w[..., 1] * d[:, None, 0]) / cross
    scale = np.hypot(*d.T)[:, None] * np.hypot(*e.T)[None] + 1e-300
    crossing = np.abs(cross) > _EPS * scale
    crossing &= (t > _EPS) & (t < 1 - _EPS) & (u > -_EPS) & (u < 1 + _EPS)
    # where edges lie on each other, the ends of the other ones cut
    n2 = (d * d).sum(axis=1)[:, None]
    along = (w * d[:, None]).sum(axis=-1) / n2
    off = np.abs(w[..., 0] * d[:, None, 1] - w[..., 1] * d[:, None, 0]) / np.sqrt(n2)
    touching = (off < _EPS * (1 + np.abs(b).max())) & (along > _EPS) & (along < 1 - _EPS)
    met = (crossing | touching).any(axis=1)
    out = [own[~met]]
    for i in np.flatnonzero(met).tolist():
        cuts = np.sort(np.concatenate([[0.0], t[i][crossing[i]], along[i][touching[i]], [1.0]]))
        single = np.ones(len(cuts), bool)
        single[1:] = cuts[1:] - cuts[:-1] > _EPS
        cuts = cuts[single]
        cuts[-1] = 1.0
        points = p[i] + cuts[:, None] * d[i]
        points[-1] = own[i, 1]
        out.append(np.stack([points[:-1], points[1:]], axis=1))
    return np.concatenate(out)


def _keys(pieces: np.ndarray) -> list[tuple[complex, complex]]:
    """The ends of pieces, rounded so that equal points compare equal."""
    r = np.round(pieces, 7) + 0.0
    return list(zip((r[:, 0, 0] + 1j * r[:, 0, 1]).tolist(), (r[:, 1, 0] + 1j * r[:, 1, 1]).tolist()))


def _rings(pieces: np.ndarray) -> list[np.ndarray]:
    """Closed walks along the pieces; where several go on, the one that turns most to the right."""
    ends = _keys(pieces)
    leaving: dict[complex, list[int]] = {}
    for k, (p, _) in enumerate(ends):
        leaving.setdefault(p, []).append(k)
    way = pieces[:, 1] - pieces[:, 0]
    out, free = [], [True] * len(pieces)
    for start in range(len(pieces)):
        walk, k = [], start
        while free[k]:
            free[k] = False
            walk.append(k)
            onward = [j for j in leaving.get(ends[k][1], ()) if free[j]]
            if not onward:
                break
            d = way[k]
            k = onward[0] if len(onward) == 1 else min(onward, key=lambda j: np.arctan2(d[0] * way[j][1] - d[1] * way[j][0], d @ way[j]))  # noqa: B023
        if len(walk) > 2:
            out.append(pieces[walk, 0])
    return out


def clipped(a: np.ndarray, b: np.ndarray, how: str) -> list[np.ndarray]:
    """All rings of the union or the difference of two simple rings: outlines counter-clockwise, holes clockwise.

    Edges of a whose boxes don't meet the box of b are outside of b, so they are kept as they are."""
    a, b = _oriented(a), _oriented(b)
    if len(a) < 3 or len(b) < 3:
        return ([a] if len(a) > 2 else []) + ([b] if len(b) > 2 and how == "union" else [])
    ea, eb = _edges(a), _edges(b)
    margin = 1e-6 * (1 + np.abs(b).max())
    near = ((ea.min(axis=1) <= b.max(axis=0) + margin) & (ea.max(axis=1) >= b.min(axis=0) - margin)).all(axis=1)
    fa, fb = _split(ea[near], eb), _split(eb, ea[near])
    ka, kb = _keys(fa), _keys(fb)
    shared, own = set(kb), set(ka)
    same = np.array([k in shared for k in ka], bool)
    against = np.array([k[::-1] in shared for k in ka], bool)
    taken = np.array([k in own or k[::-1] in own for k in kb], bool)
    ina, inb = _inside(fa.mean(axis=1), b), _inside(fb.mean(axis=1), a)
    if how == "union":
        pieces = [ea[~near], fa[(~ina & ~same & ~against) | same], fb[~inb & ~taken]]
    else:
        pieces = [ea[~near], fa[(~ina & ~same & ~against) | against], fb[inb & ~taken][:, ::-1]]
    return _rings(np.concatenate(pieces))


def outline(rings: list[np.ndarray]) -> np.ndarray | None:
    """The outline of the largest piece alone: holes and other pieces go. Closed."""
    best = max(rings, key=ring_area, default=None)
    return None if best is None or ring_area(best) <= 0 else np.vstack([best, best[:1]])


def _points(ring) -> np.ndarray:
    return np.array([(p["x"], p["y"]) for p in ring], float).reshape(-1, 2)


def _struct(p: np.ndarray | None):
    return None if p is None else [{"x": float(x), "y": float(y)} for x, y in p]


def combined(pairs: DataFrame, a: str, b: str, how: str) -> DataFrame:
    """pairs with ring: the outline of the union or difference of two ring columns."""

    @F.pandas_udf(RING)
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_struct(outline(clipped(_points(p), _points(q), how))) for p, q in zip(x, y)])

    return pairs.withColumn("ring", run(a, b))


def united(discs: DataFrame, radius: float, segments: int = 32) -> DataFrame:
    """id and ring of the union of the discs of a stroke (id, t, x, y), added in order; of parts that don't meet the largest.

    A centre that comes again adds nothing, so only its first time counts and the others don't move. Points of a stroke
    come sorted and stream through; the outline so far is all that is kept. Strokes that come together grow together, a
    disc each at a time (strokes.unions)."""
    from .strokes import unions

    angle = np.arange(segments) * 2 * np.pi / segments
    disc = np.stack([np.cos(angle), np.sin(angle)], axis=1) * radius

    def rows(ids: list, rings: list[np.ndarray]) -> pa.RecordBatch:
        points = np.concatenate([np.vstack([r, r[:1]]) for r in rings]) if rings else np.zeros((0, 2))
        ends = np.cumsum([0, *(len(r) + 1 for r in rings)])
        xy = pa.StructArray.from_arrays([pa.array(points[:, 0]), pa.array(points[:, 1])], ["x", "y"])
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), xy)], ["id", "ring"])

    def run(batches):
        now, begun, parts, size = None, None, [], 0

        def grown(parts):
            ids, none, centres = (np.concatenate(x) for x in zip(*parts))
            first = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (none[1:] != none[:-1])))
            own = [None if x else i for i, x in zip(ids[first].tolist(), none[first].tolist())]
            goes_on = begun if begun is not None and now == own[0] else None
            before = [] if begun is None or goes_on is not None else [(now, begun)]
            return [*before, *zip(own, unions(np.diff(np.append(first, len(ids))), centres, disc, radius, goes_on))]

        def out(known):
            for lo in range(0, len(known), 512):
                yield rows([i for i, _ in known[lo : lo + 512]], [r for _, r in known[lo : lo + 512]])

        for b in batches:
            if b.num_rows:
                parts.append((b.column(0).fill_null(0).to_numpy(), b.column(0).is_null().to_numpy(zero_copy_only=False), np.stack([b.column(k).to_numpy(zero_copy_only=False).astype(float) for k in (1, 2)], axis=1)))
                size += b.num_rows
            if size >= CENTRES:
                *known, (now, begun) = grown(parts)
                parts, size = [], 0
                yield from out(known)
        if parts:
            *known, (now, begun) = grown(parts)
            yield from out(known)
        if begun is not None:
            yield rows([now], [begun])

    # the work is in the tasks, not in the bytes by which partitions are merged
    tasks = int(discs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = discs.groupBy("id", "x", "y").agg(F.min("t").alias("t"))
    return first.repartition(tasks, "id").sortWithinPartitions("id", "t").select(F.col("id").cast("long").alias("id"), "x", "y").mapInArrow(run, f"id long, ring {RING}")
