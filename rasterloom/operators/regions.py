"""Regions of pixels as intervals of rows (id, y, x0, x1: [x0, x1)): strokes, polygons, brush edits, outlines.

A brush edit or a union of discs needs no polygon clipping here: both are set operations on rows of intervals, and the
outline of the result is read off its borders, as whole rings of corners."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions import geometry as G
from rasterloom.sources.written import written

from . import contours, intervals, links

_ROWS = ("id", "y")

#: Coordinates lie between -_FAR and _FAR.
_FAR = 1 << 29


def of_rings(rings: DataFrame, width: int, height: int) -> DataFrame:
    """Pixels of a width by height plane whose centre lies in the ring (id, ring), by the even-odd rule.

    Edges are rows: each gives its crossing with the centre line of every row that it spans, and sorted crossings of a
    row are paired. So a ring's work grows with its outline, not with its area, and the ring itself is not copied. The
    rows are written once: what is made of them reads them more than once."""
    edges = rings.select("id", F.explode(G.edges(F.col("ring"))).alias("e")).select("id", *(F.col(f"e.{p}.{c}").alias(p + c) for p in "ab" for c in "xy"))
    low, high = F.floor(F.least("ay", "by") - 0.5), F.ceil(F.greatest("ay", "by") - 0.5)
    first, last = F.greatest(low, F.lit(0).cast("long")), F.least(high, F.lit(height - 1).cast("long"))
    spans = edges.where((F.col("ay") != F.col("by")) & (first <= last)).withColumn("y", F.explode(F.sequence(first, last)))
    middle = F.col("y") + 0.5
    crossing = (F.col("ax") - F.col("bx")) * (middle - F.col("by")) / (F.col("ay") - F.col("by")) + F.col("bx")
    found = spans.where((F.col("by") > middle) != (F.col("ay") > middle))
    along = Window.partitionBy(*_ROWS).orderBy("c")
    found = intervals.dealt(found.select(*_ROWS, crossing.alias("c")), _ROWS, 4 * height * rings.count())
    pairs = found.select(*_ROWS, "c", F.lead("c").over(along).alias("d"), F.row_number().over(along).alias("k")).where("k % 2 = 1")
    edge = lambda c: F.greatest(F.lit(0).cast("long"), F.least(F.lit(width).cast("long"), F.ceil(F.col(c) - 0.5)))
    return written(pairs.select(*_ROWS, edge("c").alias("x0"), edge("d").alias("x1")).where("x0 < x1"))


def of_discs(discs: DataFrame, width: int, height: int) -> DataFrame:
    """Pixels of a plane whose distance to the centre of a disc (id, x, y, r) is at most r; overlapping as the discs do."""
    top = F.greatest(F.lit(0).cast("long"), F.ceil(F.col("y") - F.col("r")))
    bottom = F.least(F.lit(height - 1).cast("long"), F.floor(F.col("y") + F.col("r")))
    rows = discs.where(top <= bottom).select("id", F.col("x").alias("cx"), F.col("y").alias("cy"), "r", F.explode(F.sequence(top, bottom)).alias("y"))
    rows = rows.withColumn("rest", F.col("r") * F.col("r") - (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy"))).where("rest >= 0")
    fits = lambda x: (x - F.col("cx")) * (x - F.col("cx")) <= F.col("rest")
    side = lambda sign: F.col("cx") + sign * F.sqrt("rest")
    # the root may be off by a rounding: the pixel beside it decides by the squares
    first, last = F.ceil(side(-1)), F.floor(side(1))
    first = F.when(fits(first - 1), first - 1).when(fits(first), first).otherwise(first + 1)
    last = F.when(fits(last + 1), last + 1).when(fits(last), last).otherwise(last - 1)
    return rows.select("id", "y", F.greatest(F.lit(0).cast("long"), first).alias("x0"), F.least(F.lit(width).cast("long"), last + 1).alias("x1")).where("x0 < x1")


def strokes(points: DataFrame, width: int, height: int) -> DataFrame:
    """The union of the discs of each stroke (id, x, y, r); discs that come again add nothing."""
    points = intervals.dealt(points, ("id", "x", "y"), 2 * height * points.count()).dropDuplicates(["id", "x", "y", "r"])
    return intervals.united(of_discs(points, width, height), _ROWS)


def united(a: DataFrame, b: DataFrame) -> DataFrame:
    return intervals.combined(a, b, _ROWS, intervals.UNION)


def without(a: DataFrame, b: DataFrame) -> DataFrame:
    return intervals.combined(a, b, _ROWS, intervals.DIFFERENCE)


def overlapping(a: DataFrame, b: DataFrame) -> DataFrame:
    """The ids of which a and b share a pixel."""
    return intervals.combined(a, b, _ROWS, intervals.INTERSECTION).select("id").distinct()


def edited(base: DataFrame, brush: DataFrame, mode: str) -> DataFrame:
    """Base regions after a brush was added to or subtracted from those of its id.

    A brush that is added without touching its region does nothing, nor does one without a region, nor one that would
    leave nothing of it."""
    brush = brush.join(base.select("id").distinct(), "id", "left_semi")
    if mode == "add":
        return united(base, brush.join(overlapping(base, brush), "id", "left_semi"))
    left = without(base, brush)
    return left.unionByName(intervals.united(base.join(left.select("id").distinct(), "id", "left_anti"), _ROWS))


def measured(region: DataFrame) -> DataFrame:
    """id, area (pixels) and perimeter (sides of pixels) of disjoint rows."""
    region = written(region)
    above = region.select("id", (F.col("y") + 1).alias("y"), "x0", "x1")
    flat = intervals.combined(above, region, _ROWS, intervals.EXCLUSIVE).groupBy("id").agg(F.sum(F.col("x1") - F.col("x0")).alias("flat"))
    own = region.groupBy("id").agg(F.sum(F.col("x1") - F.col("x0")).alias("area"), (2 * F.count(F.lit(1))).alias("upright"))
    return own.join(flat, "id").select("id", "area", (F.col("upright") + F.col("flat")).alias("perimeter"))


def borders(region: DataFrame) -> DataFrame:
    """id, x0, y0, x1 and y1 of the straight borders of disjoint rows, the region on the right when y points down.

    tag0 and tag1 say at each end whether the border belongs to the row above (0) or below (1) that end: it tells
    apart the two corners that meet where pixels touch at a corner only."""
    region = written(region)
    above = region.select("id", (F.col("y") + 1).alias("y"), "x0", "x1")
    flat = lambda a, b: intervals.combined(a, b, _ROWS, intervals.DIFFERENCE)
    y, tag = F.col("y"), lambda k: F.lit(k)
    row = lambda xa, ya, ta, xb, yb, tb: (F.col("id"), xa.alias("x0"), ya.alias("y0"), ta.alias("tag0"), xb.alias("x1"), yb.alias("y1"), tb.alias("tag1"))
    left, right = F.col("x0"), F.col("x1")
    bottoms = flat(above, region).select(*row(right, y, tag(0), left, y, tag(0)))
    tops = flat(region, above).select(*row(left, y, tag(1), right, y, tag(1)))
    sides = region.select("id", "y", F.explode(F.array(F.struct(left.alias("x"), F.lit(True).alias("up")), F.struct(right.alias("x"), F.lit(False).alias("up")))).alias("s")).select("id", "y", "s.x", "s.up")
    island = F.col("y") - F.row_number().over(Window.partitionBy("id", "x", "up").orderBy("y"))
    long = sides.withColumn("island", island).groupBy("id", "x", "up", "island").agg(F.min("y").alias("top"), (F.max("y") + 1).alias("end"))
    x, top, end = F.col("x"), F.col("top"), F.col("end")
    ups = long.where("up").select(*row(x, end, tag(0), x, top, tag(1)))
    downs = long.where("not up").select(*row(x, top, tag(1), x, end, tag(0)))
    return bottoms.unionByName(tops).unionByName(ups).unionByName(downs)


def outlines(region: DataFrame) -> DataFrame:
    """plane (the id), loop, pos, x, y and n of the corners of every ring around or inside the region.

    Outer rings have a positive signed area, holes a negative one. Coordinates are whole and below 2^29 in size."""
    b = borders(region)
    here = Window.partitionBy("id", "x0", "y0")
    b = b.withColumn("meets", F.count(F.lit(1)).over(here) > 1)
    code = (F.col("y0") + _FAR) * F.lit(1 << 32) + (F.col("x0") + _FAR) * 2 + F.when(F.col("meets"), F.col("tag0")).otherwise(0)
    b = b.withColumn("node", code.cast("long"))
    starts = b.select("id", F.col("x0").alias("x1"), F.col("y0").alias("y1"), F.col("tag0").alias("tag"), "meets", F.col("node").alias("next"))
    follow = b.drop("meets").join(starts, ["id", "x1", "y1"]).where("not meets or tag = tag1")
    ranked = links.loops(follow.select(F.col("id").alias("plane"), "node", "next"))
    x, y = F.shiftright(F.col("node") % F.lit(1 << 32), 1) - _FAR, F.floor(F.col("node") / F.lit(1 << 32)) - _FAR
    return ranked.select("plane", "loop", "pos", x.cast("double").alias("x"), y.cast("double").alias("y"), "n")


def hulls(region: DataFrame) -> DataFrame:
    """id, pos, x, y and n of the outer ring of each region's largest piece, by the area within that ring."""
    points = outlines(region)
    best = contours.outer(contours.areas(points)).where("hull").select("plane", "loop", F.col("area"))
    return points.join(best, ["plane", "loop"]).select(F.col("plane").alias("id"), "pos", "x", "y", "n", "area")
