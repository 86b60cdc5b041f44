"""Plane geometry on columns. A point is a struct of doubles x and y; a ring is an array of points."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def edges(ring: Column) -> Column:
    """Array of (a, b): each vertex with the one before it, the first with the last."""
    n = F.size(ring)
    return F.transform(ring, lambda p, i: F.struct(F.get(ring, F.pmod(i + n - 1, n)).alias("a"), p.alias("b")))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once a row, however often it is used: a function over the elements of an
    array works its other operands out for each element."""
    return F.get(F.transform(F.array(value), use), 0)


def signed_area(ring: Column) -> Column:
    """Half the sum of the cross products of the edges."""
    return once(ring, lambda r: _sum(F.transform(edges(r), lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])) / 2.0)


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def vertex_mean(ring: Column) -> Column:
    n = F.nullif(F.size(ring), F.lit(0))
    return point(_sum(F.transform(ring, lambda p: p["x"])) / n, _sum(F.transform(ring, lambda p: p["y"])) / n)


def bounds(ring: Column) -> Column:
    """x0, y0, x1, y1."""
    of = lambda xs, ys: F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))
    return once(ring, lambda r: of(F.transform(r, lambda p: p["x"]), F.transform(r, lambda p: p["y"])))


def contains(ring: Column, px: Column, py: Column) -> Column:
    """Even-odd rule."""

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        spans = (b["y"] > py) != (a["y"] > py)
        at = (a["x"] - b["x"]) * (py - b["y"]) / F.nullif(a["y"] - b["y"], F.lit(0.0)) + b["x"]
        return spans & F.coalesce(px < at, F.lit(False))

    return F.size(F.filter(edges(ring), crosses)) % 2 == 1


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A closed ring of five points from two corners."""
    lx, hx, ly, hy = F.least(x0, x1), F.greatest(x0, x1), F.least(y0, y1), F.greatest(y0, y1)
    return F.array(point(lx, ly), point(hx, ly), point(hx, hy), point(lx, hy), point(lx, ly))


def ellipse(cx: Column, cy: Column, rx: Column, ry: Column, segments: int) -> Column:
    """A closed ring of segments + 1 points."""
    angle = lambda k: k * F.lit(2 * math.pi / segments)
    return F.transform(F.sequence(F.lit(0), F.lit(segments)), lambda k: point(cx + rx * F.cos(angle(k)), cy + ry * F.sin(angle(k))))


def thick_line(x0: Column, y0: Column, x1: Column, y1: Column, width: float) -> Column:
    """A quad of the width around a segment; a square around a point."""
    n = F.hypot(x1 - x0, y1 - y0)
    h = width / 2
    nx, ny = -(y1 - y0) / F.nullif(n, F.lit(0.0)) * h, (x1 - x0) / F.nullif(n, F.lit(0.0)) * h
    quad = F.array(point(x0 + nx, y0 + ny), point(x1 + nx, y1 + ny), point(x1 - nx, y1 - ny), point(x0 - nx, y0 - ny), point(x0 + nx, y0 + ny))
    return F.when(n == 0, rectangle(x0 - h, y0 - h, x0 + h, y0 + h)).otherwise(quad)


def text_box(x: Column, y: Column, text: Column, size: float = 14.0) -> Column:
    """The area in which a text is hit: letters of 0.7 and lines of 1.2 of the size, and a margin."""
    margin = max(size * 2, 20.0)
    hw, hh = (F.length(text) * F.lit(size * 0.7) + 2 * margin) / 2.0, F.lit((size * 1.2 + 2 * margin) / 2)
    return rectangle(x - hw, y - hh, x + hw, y + hh)


def affine(p: Column, m: Column) -> Column:
    """p moved by a struct a00, a01, a02, a10, a11, a12; unmoved where that is null."""
    moved = point(m["a00"] * p["x"] + m["a01"] * p["y"] + m["a02"], m["a10"] * p["x"] + m["a11"] * p["y"] + m["a12"])
    return F.when(m.isNull(), p).otherwise(moved)


def parsed_points(text: Column) -> Column:
    """Points of 'x,y x,y'."""
    return F.transform(F.split(F.trim(text), r"\s+"), lambda s: point(F.split(s, ",")[0].try_cast("double"), F.split(s, ",")[1].try_cast("double")))


def length(dx: Column, dy: Column) -> Column:
    """The root of the squares' sum: hypot() rounds otherwise, and may put the farther of two places before the nearer."""
    return F.sqrt(dx * dx + dy * dy)


def segment_distance(p: Column, a: Column, b: Column) -> Column:
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    n = dx * dx + dy * dy
    t = F.when(n == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy) / F.nullif(n, F.lit(0.0)))))
    return length(p["x"] - a["x"] - t * dx, p["y"] - a["y"] - t * dy)


def closed(ring: Column) -> Column:
    return F.when((F.size(ring) > 0) & (F.get(ring, 0) != F.element_at(ring, -1)), F.concat(ring, F.slice(ring, 1, 1))).otherwise(ring)


def opened(ring: Column) -> Column:
    return F.when((F.size(ring) > 1) & (F.get(ring, 0) == F.element_at(ring, -1)), F.slice(ring, F.lit(1), F.size(ring) - 1)).otherwise(ring)


def moved_to(ring: Column, x: Column, y: Column) -> Column:
    """The ring shifted so that its first vertex is at x, y."""
    first = F.get(ring, 0)
    return F.transform(ring, lambda p: point(p["x"] - first["x"] + x, p["y"] - first["y"] + y))


def view_rect(zoom: Column, tx: Column, ty: Column, width: Column, height: Column, image_w: Column, image_h: Column) -> Column:
    """The part of the image that a camera shows; all of it without a viewport."""
    s = F.pow(F.lit(2.0), F.coalesce(zoom, F.lit(0.0)))
    inside = lambda v, top: F.greatest(F.lit(0.0), F.least(top.cast("double"), v))
    none = (F.coalesce(width, F.lit(0)) == 0) | (F.coalesce(height, F.lit(0)) == 0)
    cx, cy = F.coalesce(tx, image_w / 2.0), F.coalesce(ty, image_h / 2.0)
    part = F.struct(*(inside(c + k * v / 2.0 / s, top).alias(n) for c, k, v, top, n in ((cx, -1, width, image_w, "x0"), (cy, -1, height, image_h, "y0"), (cx, 1, width, image_w, "x1"), (cy, 1, height, image_h, "y1"))))
    whole = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), image_w.cast("double").alias("x1"), image_h.cast("double").alias("y1"))
    return F.when(none, whole).otherwise(part)


def letterbox(rect: Column, side: float = 1024.0) -> Column:
    """scale, pad_x and pad_y that fit a rectangle into a square; the identity for an empty one."""
    w, h = F.greatest(F.lit(0.0), rect["x1"] - rect["x0"]), F.greatest(F.lit(0.0), rect["y1"] - rect["y0"])
    empty = (w == 0) | (h == 0)
    s = F.lit(side) / F.nullif(F.greatest(w, h), F.lit(0.0))
    pad = lambda own: (F.lit(side) - own * s) / 2.0
    return F.struct(F.when(empty, 1.0).otherwise(s).alias("scale"), F.when(empty | (w >= h), 0.0).otherwise(pad(w)).alias("pad_x"), F.when(empty | (w < h), 0.0).otherwise(pad(h)).alias("pad_y"))


def into_letterbox(p: Column, rect: Column, box: Column) -> Column:
    return point((p["x"] - rect["x0"]) * box["scale"] + box["pad_x"], (p["y"] - rect["y0"]) * box["scale"] + box["pad_y"])


def out_of_letterbox(p: Column, rect: Column, box: Column) -> Column:
    return point((p["x"] - box["pad_x"]) / box["scale"] + rect["x0"], (p["y"] - box["pad_y"]) / box["scale"] + rect["y0"])


def view_to_bounds(zoom: Column, x: Column, y: Column, width: Column, height: Column) -> Column:
    s = F.pow(F.lit(2.0), zoom) * 2.0
    ok = (width > 0) & (height > 0)
    return F.when(ok, F.struct((x - width / s).alias("x0"), (y - height / s).alias("y0"), (x + width / s).alias("x1"), (y + height / s).alias("y1")))


def bounds_to_view(b: Column, width: Column, height: Column) -> Column:
    """zoom, x and y that show the bounds in the container."""
    side = lambda k: F.greatest(F.lit(1e-6), F.abs(b[f"{k}1"] - b[f"{k}0"]))
    s = F.least(width / side("x"), height / side("y"))
    return F.when((width > 0) & (height > 0), F.struct(F.log2(s).alias("zoom"), ((b["x0"] + b["x1"]) / 2.0).alias("x"), ((b["y0"] + b["y1"]) / 2.0).alias("y")))


def legacy_view(pan_x: Column, pan_y: Column, zoom: Column, image_w: Column, image_h: Column, container: Column) -> Column:
    """zoom, x and y of an older waypoint: pan in shares of the longer side, zoom in container widths, a little less."""
    longer = F.greatest(image_w, image_h)
    sized = (container > 0) & (image_w > 0)
    z = F.when(zoom.isNotNull() & sized, F.log2(zoom * container / F.nullif(image_w, F.lit(0))) - 0.3).when(zoom.isNotNull() & (container > 0), F.log2(F.greatest(zoom, F.lit(1e-9)))).when(sized, F.log2(container / F.nullif(image_w, F.lit(0)))).otherwise(0.0)
    return F.when(pan_x.isNotNull() | pan_y.isNotNull() | zoom.isNotNull(), F.struct(z.alias("zoom"), (F.coalesce(pan_x, F.lit(0.5)) * longer).alias("x"), (F.coalesce(pan_y, F.lit(0.5)) * longer).alias("y")))


def tile_range(low: Column, high: Column, scale: Column, tile: int, side: Column) -> Column:
    """Tile numbers along one side that a range of image coordinates meets at a level of the scale."""
    last = F.greatest(F.lit(0).cast("long"), F.ceil(side / F.lit(float(tile))) - 1)
    first = F.greatest(F.lit(0).cast("long"), F.floor(low / scale / tile))
    return F.struct(F.least(first, last).alias("first"), F.least(last, F.greatest(first, F.ceil(high / scale / tile) - 1)).alias("last"))


def square_crop(width: Column, height: Column) -> Column:
    side = F.least(width, height)
    return F.struct(F.floor((width - side) / 2).alias("x"), F.floor((height - side) / 2).alias("y"), side.alias("side"))
