"""OME-XML image descriptions by XPath expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rois import shapes


def is_ome(description: Column) -> Column:
    """Whether an image description looks like OME-XML."""
    return F.coalesce(description.rlike("(?i)OME|openmicroscopy|Pixels"), F.lit(False))


def pixels(rows: DataFrame, xml: str) -> DataFrame:
    """rows with size_x, size_y, size_c (else the number of channels), type and names of the first Pixels element.

    Namespaces are dropped first, so that plain paths match; what isn't XML gives nulls."""
    bare = F.regexp_replace(F.col(xml), r'\sxmlns(:\w+)?="[^"]*"', "")
    good = F.when(is_ome(F.col(xml)) & F.col(xml).rlike(r"(?s)^\s*<.*>\s*$"), bare)
    n = lambda path: F.xpath_string(good, F.lit(path)).try_cast("int")
    channels = F.xpath(good, F.lit("//Image[1]/Pixels/Channel/@ID"))
    return rows.select(
        "*", n("//Image[1]/Pixels/@SizeX").alias("size_x"), n("//Image[1]/Pixels/@SizeY").alias("size_y"), F.coalesce(n("//Image[1]/Pixels/@SizeC"), F.size(channels)).alias("size_c"),
        F.xpath_string(good, F.lit("//Image[1]/Pixels/@Type")).alias("type"), F.xpath(good, F.lit("//Image[1]/Pixels/Channel/@Name")).alias("names"),
    )


def rois(rows: DataFrame, key: str, xml: str) -> DataFrame:
    """key, pos (among those of a kind), kind, x, y, width and height of the valid rectangles and points of a description."""
    found = shapes(rows, key, xml).where("shape.type in ('rectangle', 'point')")
    order = F.row_number().over(Window.partitionBy(key, "shape.type").orderBy("roi", "pos")) - 1
    return found.select(key, F.col("shape.type").alias("kind"), order.alias("pos"), "shape.x", "shape.y", "shape.width", "shape.height")
