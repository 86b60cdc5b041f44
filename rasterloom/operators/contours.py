"""Closed contours of masks: marching-squares segments, stitched into loops by list ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import links
from . import raster as R

# Where a segment may end on a cell, in half pixels from its first corner.
_TOP, _RIGHT, _BOTTOM, _LEFT = (1, 0), (2, 1), (1, 2), (0, 1)

#: From and to of the segments of each case of raster.cell_cases; set pixels lie on the right when y points down.
#: Two set pixels that meet at a corner only are kept apart.
SEGMENTS = {
    8: [(_TOP, _LEFT)],
    4: [(_RIGHT, _TOP)],
    2: [(_BOTTOM, _RIGHT)],
    1: [(_LEFT, _BOTTOM)],
    12: [(_RIGHT, _LEFT)],
    3: [(_LEFT, _RIGHT)],
    6: [(_BOTTOM, _TOP)],
    9: [(_TOP, _BOTTOM)],
    7: [(_LEFT, _TOP)],
    11: [(_TOP, _RIGHT)],
    13: [(_RIGHT, _BOTTOM)],
    14: [(_BOTTOM, _LEFT)],
    10: [(_TOP, _LEFT), (_BOTTOM, _RIGHT)],
    5: [(_RIGHT, _TOP), (_LEFT, _BOTTOM)],
}

#: Points of a loop at least: the four around a single pixel are none.
LEAST_POINTS = 5

_ROW = 1 << 31


def node(x: Column, y: Column) -> Column:
    """A number for a point with whole coordinates from 0."""
    return y.cast("long") * F.lit(_ROW) + x.cast("long")


def segments(mask: DataFrame) -> DataFrame:
    """plane, x0, y0, x1 and y1 of the segments between set and unset pixels, in half pixels.

    mask has plane, x, y and v of whole planes. A loop that meets the border of the plane stays open."""
    ends = lambda pairs: F.array(*(F.array(*(F.lit(c) for point in pair for c in point)) for pair in pairs))
    table = F.create_map(*(c for case, pairs in SEGMENTS.items() for c in (F.lit(case), ends(pairs))))
    cells = R.cell_cases(mask).select("plane", "x", "y", F.explode(table[F.col("case")]).alias("s"))
    at = lambda k, side: (2 * F.col(side) + F.col("s")[k]).cast("int")
    return cells.select("plane", at(0, "x").alias("x0"), at(1, "y").alias("y0"), at(2, "x").alias("x1"), at(3, "y").alias("y1"))


def loops(mask: DataFrame, width: int, height: int) -> DataFrame:
    """plane, loop, pos, x, y and n of the points of each closed contour, in pixels; loop is its smallest node.

    Loops of fewer than LEAST_POINTS points, or of more than eight times width and height and one, are left out."""
    s = segments(mask)
    found = links.loops(s.select("plane", node(F.col("x0"), F.col("y0")).alias("node"), node(F.col("x1"), F.col("y1")).alias("next")))
    kept = found.where((F.col("n") >= LEAST_POINTS) & (F.col("n") - 1 <= 8 * (width + height)))
    return kept.select("plane", "loop", "pos", (F.col("node") % _ROW / 2).alias("x"), (F.floor(F.col("node") / _ROW) / 2).alias("y"), "n")


def to_world(points: DataFrame, bounds: Column, width: int, height: int) -> DataFrame:
    """The points of a screen as points of the world; bounds: left, bottom, right and top of what the screen shows."""
    x = bounds["left"] + F.col("x") / width * (bounds["right"] - bounds["left"])
    y = bounds["top"] + F.col("y") / height * (bounds["bottom"] - bounds["top"])
    return points.withColumns({"x": x, "y": y})


def areas(points: DataFrame) -> DataFrame:
    """plane, loop, n and the signed area of each loop of points (plane, loop, pos, x, y, n)."""
    after = points.select("plane", "loop", F.pmod(F.col("pos") - 1, F.col("n")).alias("pos"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    cross = F.col("x") * F.col("y1") - F.col("x1") * F.col("y")
    return points.join(after, ["plane", "loop", "pos"]).groupBy("plane", "loop").agg(F.first("n").alias("n"), (F.sum(cross) / 2).alias("area"))


def outer(sized: DataFrame) -> DataFrame:
    """The loops (plane, loop, n, area) with whether they are outer ones, and whether they are their plane's hull.

    Outer loops have a positive area; a plane without one, as where y points up, takes those with a negative area.
    The hull is what is left of the union of the filled outer loops when only the largest piece is kept: outer loops
    never cross, so that is the largest of them, the one with the smallest node among equals."""
    up = sized.groupBy("plane").agg(F.max(F.col("area") > 0).alias("up_"))
    marked = sized.join(up, "plane").withColumn("outer", F.when(F.col("up_"), F.col("area") > 0).otherwise(F.col("area") < 0)).drop("up_")
    best = marked.where("outer").groupBy("plane").agg(F.min_by("loop", F.struct(-F.abs("area"), "loop")).alias("best_"))
    return marked.join(best, "plane", "left").withColumn("hull", F.coalesce(F.col("outer") & (F.col("loop") == F.col("best_")), F.lit(False))).drop("best_")
