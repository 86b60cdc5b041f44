"""Regions of interest of OME-XML: every shape an element of its own, so an attribute that is missing moves no other.

A description is cut into its ROI elements, these into their shapes in document order; attributes of one element come
from from_xml at once, with names in their own case. Shapes of a ROI are those of its Union, or its own if it has none.
Aliases of attributes, colours, and what makes a shape void follow the viewer that the files are for; a ROI without an
id or without a valid shape is left out. Where that viewer reads a Union twice, shapes come once here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions import geometry as G

_ATTRIBUTES = r"""(?:[^>"']|"[^"]*"|'[^']*')*"""
_KINDS = "rectangle|ellipse|line|point|polygon|polyline|label|mask"

# Fill and line colours of imported shapes that have none.
DEFAULTS = {
    "rectangle": ((255, 0, 0, 50), (255, 0, 0, 255)),
    "ellipse": ((0, 255, 0, 50), (0, 255, 0, 255)),
    "line": ((0, 255, 255, 255), (0, 255, 255, 255)),
    "point": ((255, 140, 0, 255), (255, 255, 255, 255)),
    "polygon": ((255, 165, 0, 50), (255, 165, 0, 255)),
    "polyline": (None, (0, 255, 0, 255)),
    "label": ((0, 0, 0, 150), (255, 255, 0, 255)),
}


def _bare(xml: Column) -> Column:
    """Without comments and prefixes of element names."""
    return F.regexp_replace(F.regexp_replace(xml, r"(?s)<!--.*?-->", ""), r"<(/?)[A-Za-z_][\w.-]*:", "<$1")


def _attributes(tag: Column) -> Column:
    """Array of (_k, _v) of the attributes of a start tag.

    Values in which XML may mean something else than it says go through from_xml, the others are cut out as they are."""
    name, value = r"""[A-Za-z_][\w.-]*""", r"""(?:"[^"]*"|'[^']*')"""
    keys = F.regexp_extract_all(tag, F.lit(rf"([\w:.-]+)\s*=\s*{value}"))
    values = F.regexp_extract_all(tag, F.lit(rf"[\w:.-]+\s*=\s*({value})"))
    plain = F.zip_with(keys, values, lambda k, v: F.struct(k.alias("_k"), F.trim(F.substring(v, F.lit(2), F.length(v) - 2)).alias("_v")))
    inner = F.regexp_replace(F.regexp_replace(tag, r"^<[\w.-]+", ""), r"/?>$", "")
    one = F.regexp_replace(inner, r"""([\w:.-]+)\s*=\s*("[^"]*"|'[^']*')""", '<a k="$1" v=$2/>')
    parsed = F.from_xml(F.concat(F.lit("<s>"), one, F.lit("</s>")), "a array<struct<_k string, _v string>>")["a"]
    return F.when(tag.rlike(rf"^<[\w.-]+(?:\s+{name}={value})*\s*/?>$") & ~tag.rlike(r"^<[^&<]*[&<]|[\x00-\x1f\ufffe\uffff]"), plain).otherwise(parsed)


def _by_name(attributes: Column) -> Column:
    """Map of the attributes that are not empty, of equal names the first."""
    there = F.filter(attributes, lambda a: a["_v"] != "")
    names = F.array_distinct(F.transform(there, lambda a: a["_k"]))
    first = F.map_from_arrays(names, F.transform(names, lambda n: F.get(F.filter(there, lambda a: a["_k"] == n), 0)["_v"]))
    return F.when(F.size(names) == F.size(there), F.map_from_entries(there)).otherwise(first)


def _attribute(attributes: Column, *names: str) -> Column:
    """The first of the names that is there; attributes by name."""
    return F.coalesce(*(F.try_element_at(attributes, F.lit(n)) for n in names))


def _number(attributes: Column, *names: str) -> Column:
    text = F.trim(_attribute(attributes, *names))
    return F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))


def colour(text: Column) -> Column:
    """Red, green, blue and alpha of a signed 32-bit number, of rgb() or rgba(), or of hex digits (alpha first of eight)."""
    t = F.trim(text)
    bits = F.when(t.rlike(r"^-?\d{1,18}$"), t.try_cast("long"))
    packed = F.array(*(F.shiftright(bits, k).bitwiseAND(F.lit(255)).cast("double") for k in (24, 16, 8, 0)))
    parts = F.transform(F.split(F.regexp_replace(F.regexp_replace(t, r"^rgba?\(", ""), r"\)\s*$", ""), r"[,\s]+"), lambda p: p.try_cast("double"))
    alpha = F.try_element_at(parts, F.lit(4))
    four = F.array(*(F.try_element_at(parts, F.lit(k)) for k in (1, 2, 3)), F.when(alpha.isNull(), 255.0).when(alpha <= 1, alpha * 255).otherwise(alpha))
    hex_ = F.regexp_replace(t, "^#", "")
    pair = lambda k: F.conv(F.substring(hex_, k, 2), 16, 10).cast("double")
    eight, six = F.array(pair(3), pair(5), pair(7), pair(1)), F.array(pair(1), pair(3), pair(5), F.lit(255.0))
    return (
        F.when(bits.isNotNull(), packed)
        .when(t.rlike(r"^rgba?\("), F.when((F.size(parts) >= 3) & ~F.exists(parts, lambda p: p.isNull()), four))
        .when(hex_.rlike("^[0-9A-Fa-f]{8}$"), eight)
        .when(hex_.rlike("^[0-9A-Fa-f]{6}$"), six)
    )


def shapes(rows: DataFrame, key: str, xml: str) -> DataFrame:
    """key, roi (number), roi_id, roi_name, roi_description, pos (number in the ROI) and shape, a struct of one type.

    x and y are a corner, a centre, an end or a place; x2 and y2 the other end; rx and ry radii; points as they are
    written. Sizes must be positive and numbers there; polygons need points, labels a text.

    ROIs, elements and shapes are each made by an outer generator and looked at after it: a filter on what a projection
    makes, or the one that Spark infers of an inner generator, would have all of it worked out once more."""
    blocks = F.regexp_extract_all(F.regexp_replace(_bare(F.col(xml)), rf"<ROI\b{_ATTRIBUTES}(?<=/)>", ""), F.lit(r"(?s)(<ROI\b.*?</ROI\s*>)"))
    r = rows.select(F.col(key).alias("key_"), F.posexplode_outer(blocks).alias("roi", "block")).where("block is not null")
    own = _attributes(F.regexp_extract("block", rf"^(<ROI\b{_ATTRIBUTES}>)", 1))
    said = F.when(F.col("block").rlike(r"<(?:Name|Description)\b"), F.from_xml(F.col("block"), "Name string, Description string"))
    text = lambda c: F.nullif(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit(""))
    inside = F.array_join(F.regexp_extract_all("block", F.lit(rf"(?s)<Union\b{_ATTRIBUTES}>(.*?)</Union\s*>")), "")
    roi = F.struct(
        _attribute(F.col("own"), "ID", "id").alias("roi_id"),
        F.coalesce(text(F.col("said.Name")), _attribute(F.col("own"), "Name", "name")).alias("roi_name"),
        text(F.col("said.Description")).alias("roi_description"),
        F.when(F.col("block").rlike(r"<Union\b"), inside).otherwise(F.col("block")).alias("body"),
    )
    r = r.withColumns({"own": own, "said": said}).withColumn("own", _by_name(F.col("own"))).select("key_", "roi", F.explode_outer(F.array(roi)).alias("r")).select("key_", "roi", "r.*").where("roi_id is not null")
    each = F.regexp_extract_all("body", F.lit(rf"(?is)(<(?:{_KINDS})\b{_ATTRIBUTES}(?:(?<=/)>|>.*?</(?:{_KINDS})\s*>))"))
    e = r.select("*", F.posexplode_outer(each).alias("pos", "element")).drop("body").where("element is not null")
    e = e.withColumn("a", _attributes(F.regexp_extract("element", rf"^(<[\w.-]+\b{_ATTRIBUTES}>)", 1)))
    e = e.withColumn("a", _by_name(F.col("a"))).withColumn("kind", F.lower(F.regexp_extract("element", r"^<(\w+)", 1)))
    kind = lambda *k: F.col("kind").isin(*k)
    n, at = (lambda *names: _number(F.col("a"), *names)), (lambda *names: _attribute(F.col("a"), *names))
    x = F.when(kind("ellipse"), n("X", "x", "cx")).when(kind("line"), n("X1", "x1", "X")).when(kind("point", "label"), n("X", "x", "px")).otherwise(n("X", "x"))
    y = F.when(kind("ellipse"), n("Y", "y", "cy")).when(kind("line"), n("Y1", "y1", "Y")).when(kind("point", "label"), n("Y", "y", "py")).otherwise(n("Y", "y"))
    rx = n("RadiusX", "radiusX", "rx", "Radius", "r")
    plane = lambda c: F.when(c >= 0, F.floor(c))
    words = F.when(kind("label"), F.coalesce(at("Text", "text", "Value", "name"), text(F.xpath_string("element", F.lit("/*"))))).otherwise(at("Text", "text", "Value"))
    only = lambda c, *k: F.when(kind(*k), c)
    shape = F.struct(
        F.coalesce(at("ID", "id", "Name", "name"), F.concat(F.lit("Shape:"), F.col("pos").cast("string"))).alias("id"),
        F.col("kind").alias("type"),
        at("Name", "name").alias("name"),
        words.alias("text"),
        x.alias("x"),
        y.alias("y"),
        only(n("Width", "width", "W", "w"), "rectangle").alias("width"),
        only(n("Height", "height", "H", "h"), "rectangle").alias("height"),
        only(rx, "ellipse").alias("rx"),
        only(F.coalesce(n("RadiusY", "radiusY", "ry"), rx), "ellipse").alias("ry"),
        only(n("X2", "x2"), "line").alias("x2"),
        only(n("Y2", "y2"), "line").alias("y2"),
        only(text(at("Points", "points", "Point", "Path")), "polygon", "polyline").alias("points"),
        colour(at("FillColor", "fillColor", "Fill", "fill")).alias("fill"),
        colour(at("StrokeColor", "strokeColor", "Stroke", "stroke")).alias("stroke"),
        F.when(n("StrokeWidth", "strokeWidth") > 0, n("StrokeWidth", "strokeWidth")).alias("stroke_width"),
        plane(n("TheC", "theC")).alias("the_c"),
        plane(n("TheT", "theT")).alias("the_t"),
        plane(n("TheZ", "theZ")).alias("the_z"),
    )
    needs = {"rectangle": "s.width > 0 and s.height > 0", "ellipse": "s.rx > 0 and s.ry > 0", "line": "s.x2 is not null and s.y2 is not null", "point": "true", "label": "s.text is not null"}
    valid = " or ".join(f"s.type = '{k}' and s.x is not null and s.y is not null and {v}" for k, v in needs.items()) + " or s.points is not null"
    out = e.select("key_", "roi", "roi_id", "roi_name", "roi_description", "pos", F.explode_outer(F.array(shape)).alias("shape"))
    return out.where(valid.replace("s.", "shape.")).withColumnRenamed("key_", key)


def label_of(name: Column, description: Column, roi_id: Column) -> Column:
    """What a ROI is called: its name, the first line of its description (120 characters at most), or its id."""
    trim = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    line = trim(F.split(trim(description), r"\r?\n")[0])
    short = F.when(F.length(line) > 120, F.concat(F.substring(line, 1, 117), F.lit("…"))).otherwise(line)
    tail = F.element_at(F.split(trim(roi_id), ":"), -1)
    return F.coalesce(F.nullif(trim(name), F.lit("")), F.nullif(short, F.lit("")), F.nullif(tail, F.lit("")), F.nullif(trim(roi_id), F.lit("")), F.lit("ROI"))


def _colour(own: Column, which: int) -> Column:
    given = F.when(F.lit(False), own)
    for kind, pair in DEFAULTS.items():
        if pair[which] is not None:
            given = given.when(F.col("shape.type") == kind, F.coalesce(own, F.array(*(F.lit(float(c)) for c in pair[which]))))
    return given


def geometry(s: Column) -> Column:
    """The points of a shape as the viewer keeps them: closed rings, a band around a line, corners of a polyline, a place."""
    width = F.coalesce(s["stroke_width"], F.lit(3.0))
    dx, dy = s["x2"] - s["x"], s["y2"] - s["y"]
    n = F.sqrt(dx * dx + dy * dy)
    ox, oy = -dy / F.nullif(n, F.lit(0.0)) * width / 2, dx / F.nullif(n, F.lit(0.0)) * width / 2
    band = F.array(G.point(s["x"] + ox, s["y"] + oy), G.point(s["x2"] + ox, s["y2"] + oy), G.point(s["x2"] - ox, s["y2"] - oy), G.point(s["x"] - ox, s["y"] - oy), G.point(s["x"] + ox, s["y"] + oy))
    dot = G.rectangle(s["x"] - width / 2, s["y"] - width / 2, s["x"] + width / 2, s["y"] + width / 2)
    return (
        F.when(s["type"] == "rectangle", G.rectangle(s["x"], s["y"], s["x"] + s["width"], s["y"] + s["height"]))
        .when(s["type"] == "ellipse", G.ellipse(s["x"], s["y"], s["rx"], s["ry"], 32))
        .when(s["type"] == "line", F.when(n == 0, dot).otherwise(band))
        .when(s["points"].isNotNull(), G.parsed_points(s["points"]))
        .otherwise(F.array(G.point(s["x"], s["y"])))
    )


def _extent(s: Column) -> Column:
    """Points whose bounding box places the label of a ROI."""
    line = F.array(G.point(s["x"], s["y"]), G.point(s["x2"], s["y2"]))
    return F.when(s["type"] == "line", line).when(s["type"] == "ellipse", G.ellipse(s["x"], s["y"], s["rx"], s["ry"], 24)).otherwise(geometry(s))


def viewer_shapes(found: DataFrame, key: str) -> DataFrame:
    """key, roi, pos, id, type, points, fill, line, line_width, text, label and description of shapes() as the viewer has them.

    Each ROI that has more than labels gets one text in the middle of its box as its last shape."""
    s = F.col("shape")
    kind = s["type"]
    to = F.when(kind.isin("rectangle", "ellipse", "polygon"), "polygon").when(kind == "label", "text").otherwise(kind)
    about = F.concat(F.lit("Imported from ROI "), F.coalesce("roi_name", "roi_id"), F.lit(", Shape "), s["id"])
    own = found.select(
        key,
        "roi",
        "pos",
        F.concat(F.lit("roi-"), "roi_id", F.lit("-"), s["id"]).alias("id"),
        to.alias("type"),
        geometry(s).alias("points"),
        _colour(s["fill"], 0).alias("fill"),
        _colour(s["stroke"], 1).alias("line"),
        F.when(~kind.isin("point", "label"), F.coalesce(s["stroke_width"], F.lit(3.0))).alias("line_width"),
        s["text"].alias("text"),
        F.coalesce(s["name"], s["id"]).alias("label"),
        about.alias("description"),
    )
    box = found.where("shape.type <> 'label'").select(key, "roi", "pos", "roi_id", "roi_name", "roi_description", G.bounds(_extent(s)).alias("b"))
    middle = box.groupBy(key, "roi").agg(
        *(F.first(c).alias(c) for c in ("roi_id", "roi_name", "roi_description")),
        ((F.min("b.x0") + F.max("b.x1")) / 2).alias("x"),
        ((F.min("b.y0") + F.max("b.y1")) / 2).alias("y"),
    )
    name = label_of(F.col("roi_name"), F.col("roi_description"), F.col("roi_id"))
    rgba = lambda *c: F.array(*(F.lit(float(v)) for v in c))
    texts = middle.select(
        key,
        "roi",
        F.lit(None).cast("int").alias("pos"),
        F.concat(F.lit("roi-"), "roi_id", F.lit("__import-centroid-label")).alias("id"),
        F.lit("text").alias("type"),
        F.array(G.point(F.col("x"), F.col("y"))).alias("points"),
        rgba(0, 0, 0, 150).alias("fill"),
        rgba(255, 255, 255, 255).alias("line"),
        F.lit(None).cast("double").alias("line_width"),
        name.alias("text"),
        name.alias("label"),
        F.concat(F.lit("Auto centroid label for imported ROI "), "roi_id").alias("description"),
    )
    return own.unionByName(texts)


def groups(viewer: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """key, roi, id, name and shape_ids (in order, the label last) of the group of each ROI."""
    names = found.select(key, "roi", "roi_id", F.coalesce("roi_name", F.concat(F.lit("ROI "), "roi_id")).alias("name")).distinct()
    last = F.coalesce("pos", F.lit((1 << 31) - 1))
    ids = viewer.groupBy(key, "roi").agg(F.transform(F.sort_array(F.collect_list(F.struct(last.alias("at"), "id"))), lambda x: x["id"]).alias("shape_ids"))
    return ids.join(names, [key, "roi"]).select(key, "roi", F.concat(F.lit("roi-group-"), "roi_id").alias("id"), "name", "shape_ids")


def ring(kind: Column, points: Column, text: Column, radius: Column, font_size: float = 14.0) -> Column:
    """The closed ring by which a viewer's shape selects pixels; null for one that encloses nothing.

    A polyline is closed by its first point, a point is a circle of 24 segments and at least two pixels, a text its box."""
    p = F.get(points, 0)
    r = F.greatest(F.lit(2.0), radius)
    return (
        F.when(kind.isin("polygon", "line"), F.when(F.size(points) >= 3, points))
        .when(kind == "polyline", F.when(F.size(points) >= 2, F.concat(points, F.slice(points, 1, 1))))
        .when(kind == "point", G.ellipse(p["x"], p["y"], r, r, 24))
        .when(kind == "text", G.text_box(p["x"], p["y"], text, font_size))
    )
