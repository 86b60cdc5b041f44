"""Simplification of lines as tables of vertices: every round splits all open pieces of all lines at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions import geometry as G
from rasterloom.sources.written import removed, written


def _distance(to_line: bool) -> Column:
    """Of a vertex to the segment between the ends of its piece, or to the whole line through them.

    Lengths are roots of sums of squares, as SQL has them: which of equals is the first depends on the last bit."""
    p, a, b = (G.point(F.col(f"{c}x"), F.col(f"{c}y")) for c in ("", "a", "b"))
    if not to_line:
        return G.segment_distance(p, a, b)
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    n = dx * dx + dy * dy
    across = F.abs(dx * (F.col("ay") - F.col("y")) - (F.col("ax") - F.col("x")) * dy) / F.sqrt(F.nullif(n, F.lit(0.0)))
    return F.when(n == 0, G.length(F.col("x") - F.col("ax"), F.col("y") - F.col("ay"))).otherwise(across)


def simplified(vertices: DataFrame, eps: float, to_line: bool = False) -> DataFrame:
    """The vertices (id, k, x, y) that lines within eps need, by Douglas and Peucker; k is the place in the line.

    A piece is the vertices between two that are kept. Its farthest one, the first of equals, is kept if its distance to
    the segment is above eps, or its distance to the whole line at least eps, and the piece becomes two; else the piece
    is done. A round is one aggregation by line and piece and one join, and open pieces get fewer; a long line is spread
    by its pieces. There are as many rounds as the splits of one line are deep."""
    first, last = F.struct("k", "x", "y"), F.col("k")
    ends = vertices.groupBy("id").agg(F.min_by(first, last).alias("a"), F.max_by(first, last).alias("b"))
    kept = [written(ends.select("id", F.explode(F.array_distinct(F.array("a", "b"))).alias("v")).select("id", "v.*"))]
    ends = ends.select("id", F.col("a.k").alias("lo"), F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.k").alias("hi"), F.col("b.x").alias("bx"), F.col("b.y").alias("by"))
    piece = ["id", "k", "x", "y", "lo", "ax", "ay", "hi", "bx", "by"]
    live = written(vertices.join(ends, "id").where("k > lo and k < hi").select(*piece))
    while not live.isEmpty():
        far = live.withColumn("d", _distance(to_line)).groupBy("id", "lo").agg(F.max_by(F.struct("k", "x", "y"), F.struct("d", -F.col("k"))).alias("m"), F.max("d").alias("d"))
        split = written(far.where(F.col("d") >= eps if to_line else F.col("d") > eps).select("id", "lo", "m"))
        kept.append(split.select("id", "m.*"))
        before = F.col("k") < F.col("m.k")
        side = lambda own, new, here: F.when(here, F.col(own)).otherwise(F.col(f"m.{new}")).alias(own)
        ends_now = [side("lo", "k", before), side("ax", "x", before), side("ay", "y", before), side("hi", "k", ~before), side("bx", "x", ~before), side("by", "y", ~before)]
        live = written(live.join(split, ["id", "lo"]).where("k <> m.k").select("id", "k", "x", "y", *ends_now), live)
    removed(live)
    return reduce(DataFrame.unionByName, kept)
