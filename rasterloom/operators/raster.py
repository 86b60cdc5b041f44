"""Masks and label images as rows of (plane, x, y, v); neighbours come by windows over rows and columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _row():
    return W.partitionBy("plane", "y").orderBy("x")


def _col():
    return W.partitionBy("plane", "x").orderBy("y")


def exploded(tiles: DataFrame, key: str, values: str, width: int) -> DataFrame:
    """One row for each pixel of row-major tiles."""
    p = tiles.select(F.col(key).alias("plane"), F.posexplode(values).alias("i", "v"))
    return p.select("plane", (F.col("i") % width).alias("x"), F.floor(F.col("i") / width).cast("int").alias("y"), "v")


def edges(mask: DataFrame) -> DataFrame:
    """Pixels of a 0/1 mask with a neighbour outside it among the four; the border counts as outside."""
    near = [F.coalesce(f("v", 1).over(w), F.lit(0)) for f in (F.lag, F.lead) for w in (_row(), _col())]
    return mask.withColumn("edge", ((F.col("v") == 1) & (F.least(*near) == 0)).cast("int"))


def dilated(mask: DataFrame, radius: int) -> DataFrame:
    """The mask grown by a square of the radius: two passes of running maxima."""
    across = mask.withColumn("v", F.max("v").over(_row().rangeBetween(-radius, radius)))
    return across.withColumn("v", F.max("v").over(_col().rangeBetween(-radius, radius)))


def painted(mask: DataFrame, cx: float, cy: float, r: float) -> DataFrame:
    """The mask with a disc set."""
    inside = (F.col("x") - cx) * (F.col("x") - cx) + (F.col("y") - cy) * (F.col("y") - cy) <= r * r
    return mask.withColumn("v", F.when(inside, 1).otherwise(F.col("v")))


def runs(mask: DataFrame) -> DataFrame:
    """plane, y, x0 and x1 of the maximal runs of set pixels in each row."""
    island = F.col("x") - F.row_number().over(_row())
    return mask.where("v = 1").withColumn("g", island).groupBy("plane", "y", "g").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("g")


def label_edges(labels: DataFrame) -> DataFrame:
    """Label pixels with a neighbour of another label among the four; the border is none."""
    differs = [F.coalesce(f("v", 1).over(w) != F.col("v"), F.lit(False)) for f in (F.lag, F.lead) for w in (_row(), _col())]
    out = differs[0]
    for d in differs[1:]:
        out = out | d
    return labels.withColumn("edge", (out & (F.col("v") > 0)).cast("int"))


def mask_rgba(mask: DataFrame, outline: bool, colour: tuple[int, int, int], radius: int = 1) -> DataFrame:
    """The mask as RGBA: its grown outline at alpha 230, or its area at 170; transparent elsewhere."""
    shown = dilated(edges(mask).withColumn("v", F.col("edge")), radius) if outline else mask
    alpha = 230 if outline else 170
    on = F.col("v") == 1
    return shown.select("plane", "x", "y", *(F.when(on, c).otherwise(0).alias(n) for n, c in zip("rgb", colour)), F.when(on, alpha).otherwise(0).alias("a"))


def cell_cases(mask: DataFrame) -> DataFrame:
    """The marching-squares case 0..15 of each 2 by 2 cell: top left 8, top right 4, bottom right 2, bottom left 1."""
    right = F.lead("v").over(_row())
    m = mask.withColumn("tr", right)
    m = m.withColumn("bl", F.lead("v").over(_col())).withColumn("br", F.lead("tr").over(_col()))
    return m.where("tr is not null and bl is not null and br is not null").select("plane", "x", "y", (8 * F.col("v") + 4 * F.col("tr") + 2 * F.col("br") + F.col("bl")).cast("int").alias("case"))


def padded(pixels: DataFrame, side: int) -> DataFrame:
    """Each plane on a full square grid; missing pixels are 0."""
    grid = pixels.select("plane").distinct().select("plane", F.explode(F.sequence(F.lit(0), F.lit(side - 1))).alias("y")).select("plane", "y", F.explode(F.sequence(F.lit(0), F.lit(side - 1))).alias("x"))
    return grid.join(pixels, ["plane", "x", "y"], "left").withColumn("v", F.coalesce("v", F.lit(0)))


def composited(layers: DataFrame) -> DataFrame:
    """RGB of each pixel: channels are added in order of pos and rounded, halves to even, and cut at 255 after each.

    layers has plane, i, pos, share (0..1), r, g, b."""
    lists = layers.groupBy("plane", "i").agg(F.sort_array(F.collect_list(F.struct("pos", "share", "r", "g", "b"))).alias("l"))

    def one(c: str) -> Column:
        return F.aggregate("l", F.lit(0.0), lambda acc, x: F.least(F.lit(255.0), F.bround(acc + x["share"] * x[c]))).cast("int").alias(c)

    return lists.select("plane", "i", one("r"), one("g"), one("b"))


def normalised(pixels: DataFrame, means: tuple[float, ...], deviations: tuple[float, ...]) -> DataFrame:
    """Bytes r, g, b as standardised shares."""
    return pixels.select("plane", "i", *(((F.col(c) / 255.0 - m) / d).alias(c) for c, m, d in zip("rgb", means, deviations)))
