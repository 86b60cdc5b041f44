"""Rings as rows (id, ring): overlap join, simplification, hulls, boundaries and rasterising."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.functions import geometry as G

from . import regions

RING = "array<struct<x:double,y:double>>"


def overlaps(rings: DataFrame, cell: float) -> DataFrame:
    """a and b (a < b) of rings of which one holds a vertex of the other.

    Bounding boxes meet by the grid cells that they cover, an equi-join that Spark can split, and only in the first
    cell that both cover, so that each pair comes once. Only ids and boxes travel with the cells; rings are fetched for
    the pairs whose boxes meet."""
    b = rings.select("id", G.bounds(F.col("ring")).alias("box")).where("box.x0 is not null")
    span = lambda k: F.sequence(F.floor(F.col(f"box.{k}0") / cell), F.floor(F.col(f"box.{k}1") / cell))
    cells = b.withColumn("cx", F.explode(span("x"))).withColumn("cy", F.explode(span("y")))
    left, right = (cells.select(*(F.col(c).alias(f"{c}_{s}") for c in ("id", "box")), "cx", "cy") for s in "ab")
    first = lambda k: F.floor(F.greatest(F.col(f"box_a.{k}0"), F.col(f"box_b.{k}0")) / cell)
    near = left.join(right, ["cx", "cy"]).where("id_a < id_b").where((F.col("cx") == first("x")) & (F.col("cy") == first("y")))
    meet = near.where("box_a.x0 <= box_b.x1 AND box_b.x0 <= box_a.x1 AND box_a.y0 <= box_b.y1 AND box_b.y0 <= box_a.y1").select("id_a", "id_b")
    ring = lambda s: rings.select(F.col("id").alias(f"id_{s}"), F.col("ring").alias(f"ring_{s}"))
    pairs = meet.join(ring("a"), "id_a").join(ring("b"), "id_b")
    holds = lambda r, s: F.exists(F.col(f"ring_{s}"), lambda p: G.contains(F.col(f"ring_{r}"), p["x"], p["y"]))
    return pairs.where(holds("a", "b") | holds("b", "a")).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))


def rasterised(rings: DataFrame, width: int, height: int) -> DataFrame:
    """id, x and y of the pixels whose centre lies in the ring, from its crossings with the rows' centre lines."""
    return regions.of_rings(rings, width, height).select("id", F.explode(F.sequence("x0", F.col("x1") - 1)).alias("x"), "y")


def _each(f):
    """A pandas function over rings from one over (n, 2) arrays."""

    @F.pandas_udf(RING)
    def run(s: pd.Series) -> pd.Series:
        out = []
        for ring in s:
            p = np.array([(q["x"], q["y"]) for q in ring], float).reshape(-1, 2) if ring is not None else None
            out.append(None if p is None else [{"x": float(x), "y": float(y)} for x, y in f(p)])
        return pd.Series(out)

    return run


def _distances(p: np.ndarray, a: np.ndarray, b: np.ndarray, to_line: bool) -> np.ndarray:
    d = b - a
    n = float(d @ d)
    if n == 0:
        return np.hypot(*(p - a).T)
    if to_line:
        return np.abs(d[0] * (a[1] - p[:, 1]) - (a[0] - p[:, 0]) * d[1]) / np.sqrt(n)
    t = np.clip((p - a) @ d / n, 0, 1)
    return np.hypot(*(p - a - t[:, None] * d).T)


def douglas_peucker(p: np.ndarray, eps: float, to_line: bool = False) -> np.ndarray:
    """The points that a line within eps needs; a stack instead of recursion. Distances are to the segment and may
    equal eps, or to the whole line and must stay below."""
    keep = np.zeros(len(p), bool)
    keep[[0, -1] if len(p) else []] = True
    todo = [(0, len(p) - 1)]
    while todo:
        i, j = todo.pop()
        if j - i < 2:
            continue
        d = _distances(p[i + 1 : j], p[i], p[j], to_line)
        k = int(d.argmax())
        if d[k] < eps if to_line else d[k] <= eps:
            continue
        keep[i + 1 + k] = True
        todo += [(i, i + 1 + k), (i + 1 + k, j)]
    return p[keep]


def simplified_ring(p: np.ndarray, eps: float) -> np.ndarray:
    """A closed ring simplified between its leftmost and its rightmost vertex, without near duplicates."""
    if len(p) < 4:
        return p
    q = p[:-1] if (p[0] == p[-1]).all() else p
    if len(q) < 3:
        return p
    lo, hi = int(q[:, 0].argmin()), int(q[:, 0].argmax())
    if lo == hi:
        lo, hi = int(q[:, 1].argmin()), int(q[:, 1].argmax())
    turned = np.roll(q, -lo, axis=0)
    m = (hi - lo) % len(q)
    there = douglas_peucker(turned[: m + 1], eps)
    back = douglas_peucker(np.vstack([turned[m:], turned[:1]]), eps)
    kept: list[np.ndarray] = []
    for v in np.vstack([there, back[1:-1]]):
        if not kept or np.hypot(*(v - kept[-1])) > eps * 0.25:
            kept.append(v)
    return p if len(kept) < 3 else np.vstack([kept, kept[:1]])


def convex_hull(p: np.ndarray) -> np.ndarray:
    """Corners of the hull, counter-clockwise from the lowest left one (monotone chain)."""
    q = np.unique(p, axis=0)
    if len(q) < 3:
        return q

    def half(points):
        out: list[np.ndarray] = []
        for v in points:
            while len(out) > 1 and np.cross(np.append(out[-1] - out[-2], 0), np.append(v - out[-1], 0))[2] <= 0:
                out.pop()
            out.append(v)
        return out[:-1]

    return np.array(half(q) + half(q[::-1]))


def simplify(rings: DataFrame, eps: float) -> DataFrame:
    return rings.withColumn("ring", _each(lambda p: simplified_ring(p, eps))("ring"))


def simplify_line(lines: DataFrame, eps: float, to_line: bool = False) -> DataFrame:
    return lines.withColumn("ring", _each(lambda p: douglas_peucker(p, eps, to_line))("ring"))


def hulls(rings: DataFrame) -> DataFrame:
    return rings.withColumn("ring", _each(convex_hull)("ring"))


#: Directions around a pixel, clockwise from the left (y grows downwards).
_AROUND = ((-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1))


def boundary(mask: np.ndarray) -> list[tuple[int, int]]:
    """The outer boundary of the first part of a mask in reading order, by Moore's neighbours."""
    ys, xs = np.nonzero(mask)
    if not len(xs):
        return []
    start = (int(xs[0]), int(ys[0]))
    h, w = mask.shape
    on = lambda x, y: 0 <= x < w and 0 <= y < h and bool(mask[y, x])
    out, here, back = [start], start, 0
    for _ in range(4 * mask.size):
        for k in range(1, 9):
            d = (back + k) % 8
            x, y = here[0] + _AROUND[d][0], here[1] + _AROUND[d][1]
            if on(x, y):
                px, py = here[0] + _AROUND[(d - 1) % 8][0], here[1] + _AROUND[(d - 1) % 8][1]
                here, back = (x, y), _AROUND.index((px - x, py - y))
                break
        else:
            return out
        if here == start:
            return out
        out.append(here)
    return out


def traced(masks: DataFrame, width: int) -> DataFrame:
    """id and ring of the outer boundary of each row-major mask (id, mask)."""

    @F.pandas_udf(RING)
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([[{"x": float(x), "y": float(y)} for x, y in boundary(np.array(m).reshape(-1, width))] for m in s])

    return masks.select("id", run("mask").alias("ring"))
