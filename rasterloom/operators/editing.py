"""Edits of a document as functions from tables to tables: shapes, groups, waypoints and imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rasterloom.functions import geometry as G


def patched(rows: DataFrame, key: str, patches: DataFrame, columns: list[str]) -> DataFrame:
    """rows with the columns of the patch of the same key; null in a patch leaves a value."""
    p = patches.select(F.col(key), *(F.col(c).alias(f"__{c}") for c in columns))
    out = rows.join(p, key, "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(f"__{c}", c))
    return out.select(rows.columns)


def added_once(rows: DataFrame, key: str, fresh: DataFrame) -> DataFrame:
    """rows and those of fresh whose key isn't there."""
    return rows.unionByName(fresh.join(rows.select(key).distinct(), key, "left_anti").select(rows.columns))


def ungrouped(shapes: DataFrame, members: DataFrame) -> DataFrame:
    """Shapes of no group; members has shape."""
    return shapes.join(members.select(F.col("shape").alias("id")).distinct(), "id", "left_anti")


def copied(shapes: DataFrame, members: DataFrame, groups: DataFrame, explicit: DataFrame) -> DataFrame:
    """Shapes of the selected groups, or named themselves."""
    ids = members.join(groups.select("group"), "group", "left_semi").select(F.col("shape").alias("id")).unionByName(explicit.select("id")).distinct()
    return shapes.join(ids, "id", "left_semi")


def recoloured(kind: Column, fill: Column, line: Column, colour: tuple[int, int, int]) -> tuple[Column, Column]:
    """fill and line (arrays of r, g, b, a) in a colour: areas keep their fill's alpha, texts and points change the fill alone."""
    new = lambda own: F.array(*(F.lit(c) for c in colour), F.element_at(own, 4))
    area, lined = kind.isin("polygon", "point", "text"), kind.isin("polygon", "polyline", "line")
    return F.when(area, new(fill)).otherwise(fill), F.when(lined, new(line)).otherwise(line)


def render_layer(kind: Column, angle: Column) -> tuple[Column, Column]:
    """The layer that draws a shape, and the angle in degrees of an arrow's head, which points up at zero."""
    layer = F.when(kind == "polygon", "polygon").when(kind.isin("polyline", "line", "arrow"), "path").when(kind == "text", "text").when(kind == "point", "scatter")
    return layer, F.when(kind == "arrow", F.degrees(angle) + 90.0)


def merged_after_import(shapes: DataFrame, fresh: DataFrame, drop_imported: bool) -> DataFrame:
    """shapes, without imported ones if asked, and then the first of each unseen id of fresh."""
    kept = shapes.where(~F.col("imported")) if drop_imported else shapes
    once = fresh.withColumn("__n", F.row_number().over(W.partitionBy("id").orderBy("pos"))).where("__n = 1").drop("__n")
    return kept.unionByName(once.join(kept.select("id"), "id", "left_anti").select(kept.columns))


def waypoint_updated(w: DataFrame) -> DataFrame:
    """Setting bounds drops an older pan and zoom, and the view state unless one is given."""
    has = F.col("new_bounds").isNotNull()
    return w.select("id", F.coalesce("new_bounds", "bounds").alias("bounds"), F.when(~has, F.col("pan")).alias("pan"), F.when(has, F.col("new_view")).otherwise(F.coalesce("new_view", "view")).alias("view"))


def view_priority(view: Column, from_pan: Column, from_bounds: Column) -> Column:
    return F.coalesce(view, from_pan, from_bounds)


def normalised_viewport(a: Column, b: Column) -> Column:
    """Two corners in any order as x0, y0, x1, y1."""
    return F.struct(F.least(a["x"], b["x"]).alias("x0"), F.least(a["y"], b["y"]).alias("y0"), F.greatest(a["x"], b["x"]).alias("x1"), F.greatest(a["y"], b["y"]).alias("y1"))


def neighbours(items: DataFrame, by: str, order: str) -> DataFrame:
    """before and after of each item, itself at the ends."""
    w = W.partitionBy(by).orderBy(order)
    return items.withColumn("before", F.coalesce(F.lag(order).over(w), order)).withColumn("after", F.coalesce(F.lead(order).over(w), order))


def largest_ring(rings: DataFrame) -> DataFrame:
    """The ring of the largest area of each piece of work; the first of equals."""
    a = G.area(F.col("ring"))
    return rings.groupBy("id").agg(F.max_by("part", F.struct(a, -F.col("part"))).alias("part"))


def stored_shape(kind: Column, ring: Column) -> Column:
    """Viewer shapes as they are stored: rectangles and ellipses are polygons without the closing point, lines have two points."""
    return F.when(kind.isin("rectangle", "ellipse", "polygon"), G.opened(ring)).when(kind == "line", F.slice(ring, 1, 2)).otherwise(ring)


def legacy_overlay(x: Column, y: Column, w: Column, h: Column, longer: Column) -> Column:
    """A ring from an older overlay in shares of the image's longer side."""
    return G.rectangle(x * longer, y * longer, (x + w) * longer, (y + h) * longer)


def legacy_arrow_angle(degrees: Column) -> Column:
    return F.radians(F.coalesce(degrees.try_cast("double"), F.lit(0.0)))


def arrow_tail(x: Column, y: Column, angle: Column, width: Column, height: Column) -> Column:
    """The tail of a stored arrow: half the image's shorter side away from its tip."""
    n = F.least(width, height) * 0.5
    return G.point(x + n * F.cos(angle), y + n * F.sin(angle))


def resolved_url(base: Column, link: Column) -> Column:
    """A link as seen from a document: absolute ones stay, '/' starts at the host, others in the document's folder."""
    host, folder = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1), F.regexp_extract(base, r"^(https?://[^?#]*/)", 1)
    return F.when(link.rlike("(?i)^[a-z][a-z0-9+.-]*:"), link).when(link.startswith("/"), F.concat(host, link)).otherwise(F.concat(F.coalesce(F.nullif(folder, F.lit("")), F.concat(host, F.lit("/"))), F.regexp_replace(link, r"^\./", "")))


def portable(source: Column, has_folder: Column, path: Column) -> Column:
    """Sources that were exported read from their folder."""
    return F.when(has_folder, F.struct(F.lit("jpeg").alias("kind"), path.alias("url"))).otherwise(source)


def form_validity(values: Column, required: list[str], urls: list[str]) -> Column:
    """Which of the fields of a map are good: required ones aren't blank, links look like links."""
    ok = {k: F.trim(F.coalesce(F.try_element_at(values, F.lit(k)), F.lit(""))) != "" for k in required}
    ok |= {k: F.coalesce(F.try_element_at(values, F.lit(k)), F.lit("")).rlike(r"^(https?://\S+)?$") for k in urls}
    return F.map_from_arrays(F.array(*map(F.lit, ok)), F.array(*ok.values()))


def sparkline(counts: Column, width: float, height: float) -> Column:
    """A path of line segments over an array of counts."""
    top = F.greatest(F.lit(1).cast("long"), F.array_max(counts))
    n = F.greatest(F.lit(1), F.size(counts) - 1)
    step = F.transform(counts, lambda c, i: F.concat(F.when(i == 0, "M").otherwise("L"), F.format_number(i * width / n, 2), F.lit(" "), F.format_number(height - c * height / top, 2)))
    return F.array_join(step, " ")


def lcg(seed: Column, steps: int) -> Column:
    """A seeded linear congruential generator, 32 bits."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.pmod(seed.cast("long"), F.lit(2**32)), lambda a, _: F.pmod(a * F.lit(1664525).cast("long") + F.lit(1013904223).cast("long"), F.lit(2**32)))


def rgb_to_rgba(pixels: DataFrame, width: Column, height: Column) -> DataFrame:
    """Pixels with an alpha of 255; zero where they lie outside the image."""
    out = (F.col("x") >= width) | (F.col("y") >= height)
    return pixels.select("plane", "x", "y", *(F.when(out, 0).otherwise(F.col(c)).alias(c) for c in "rgb"), F.when(out, 0).otherwise(255).alias("a"))
