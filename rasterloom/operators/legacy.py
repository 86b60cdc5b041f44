"""Documents of older forms, stories that are read, and what leaves a document as JSON. One row is one document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions import geometry as G

from .integrity import uuid_of

_CHANNEL = "struct<id:string,Name:string,SourceIndex:int,Samples:int,sourceImageId:string,sourceDataTypeId:string>"
_GROUP = "struct<id:string,Name:string,State:struct<Expanded:boolean>,GroupChannels:array<struct<id:string,sourceChannelId:string,Color:struct<R:int,G:int,B:int>,LowerRange:double,UpperRange:double>>>"
_IMAGE = "struct<id:string,uuid:string,sizeX:int,sizeY:int,sizeC:int,basename:string,channels:array<string>>"

#: A snapshot of an editor, in the spelling of its first form.
SNAPSHOT = f"struct<imageWidth:int,imageHeight:int,waypoints:array<struct<id:string,Name:string,thumbnail:string>>,shapes:array<struct<id:string,type:string>>,groups:array<{_GROUP}>,channelGroups:array<{_GROUP}>,sourceChannels:array<{_CHANNEL}>,images:array<{_IMAGE}>>"

#: An exhibit of the older player.
EXHIBIT = (
    "struct<Name:string,Groups:array<struct<Name:string,Colors:array<string>,Channels:array<string>>>,"
    "Stories:array<struct<Waypoints:array<struct<Name:string,Description:string,`Group`:string,Zoom:double,Pan:array<double>,Lensing:struct<`group`:string>>>>>>"
)


def is_snapshot(d: Column) -> Column:
    """Whether a document has the lists of a snapshot, and no image with channels of its own."""
    there = d["waypoints"].isNotNull() & d["shapes"].isNotNull() & d["sourceChannels"].isNotNull() & (d["groups"].isNotNull() | d["channelGroups"].isNotNull())
    nested = F.exists(F.coalesce(d["images"], F.expr(f"cast(array() as array<{_IMAGE}>)")), lambda i: F.coalesce(F.size(i["channels"]), F.lit(0)) > 0)
    return there & ~nested


def _first_of(array: Column, same) -> Column:
    """Without elements that equal an earlier one by same."""
    return F.filter(array, lambda x, i: ~F.exists(F.slice(array, F.lit(1), i), lambda y: same(x, y)))


def snapshot_images(d: Column) -> Column:
    """Images of a snapshot with their channels: those that are listed, then others that channels name, of size 1.

    A channel id counts once in an image; a snapshot's own size is that of its first image."""
    listed = F.transform(F.coalesce(d["images"], F.expr(f"cast(array() as array<{_IMAGE}>)")), lambda i: F.struct(F.coalesce(i["id"], i["uuid"]).alias("id"), i["sizeX"].alias("x"), i["sizeY"].alias("y"), i["sizeC"].alias("c"), F.coalesce(i["basename"], F.lit("")).alias("basename")))
    named = F.transform(d["sourceChannels"], lambda c: F.struct(c["sourceImageId"].alias("id"), F.lit(1).alias("x"), F.lit(1).alias("y"), F.lit(0).alias("c"), F.lit("").alias("basename")))
    images = _first_of(F.concat(listed, named), lambda x, y: x["id"] == y["id"])
    own = (d["imageWidth"] > 0) & (d["imageHeight"] > 0)

    def whole(i: Column, k: Column) -> Column:
        mine = F.filter(d["sourceChannels"], lambda c: c["sourceImageId"] == i["id"])
        channels = F.transform(_first_of(mine, lambda x, y: x["id"] == y["id"]), lambda c: F.struct(c["id"].alias("id"), c["SourceIndex"].alias("index"), c["Name"].alias("name"), c["Samples"].alias("samples")))
        side = lambda own_, given: F.when(own & (k == 0), own_).otherwise(given)
        return F.struct(i["id"].alias("id"), side(d["imageWidth"], i["x"]).alias("width"), side(d["imageHeight"], i["y"]).alias("height"), i["c"].alias("size_c"), i["basename"].alias("basename"), channels.alias("channels"))

    return F.transform(images, whole)


def snapshot_groups(d: Column) -> Column:
    """Groups of a snapshot with rows in today's spelling."""
    none = F.expr("cast(array() as array<struct<id:string,sourceChannelId:string,Color:struct<R:int,G:int,B:int>,LowerRange:double,UpperRange:double>>)")
    row = lambda c: F.struct(c["id"].alias("id"), c["sourceChannelId"].alias("channel"), F.struct(c["Color"]["R"].alias("r"), c["Color"]["G"].alias("g"), c["Color"]["B"].alias("b")).alias("colour"), c["LowerRange"].alias("lower"), c["UpperRange"].alias("upper"))
    return F.transform(F.coalesce(d["channelGroups"], d["groups"]), lambda g: F.struct(g["id"].alias("id"), g["Name"].alias("name"), g["State"]["Expanded"].alias("expanded"), F.transform(F.coalesce(g["GroupChannels"], none), row).alias("rows")))


def exhibit_waypoints(rows: DataFrame, key: str, json: str) -> DataFrame:
    """key, story, pos, name, content, group (its index, -1 without one), lens (likewise, null without a lens), zoom, x and y."""
    d = F.from_json(F.col(json), EXHIBIT)
    names = F.coalesce(F.transform(F.col("d_.Groups"), lambda g: g["Name"]), F.expr("cast(array() as array<string>)"))
    at = lambda name: (F.coalesce(F.array_position(names, name), F.lit(0)) - 1).cast("int")
    w = rows.select(key, d.alias("d_")).select(key, "d_", F.posexplode("d_.Stories").alias("story", "s_")).select(key, "d_", "story", F.posexplode("s_.Waypoints").alias("pos", "w_"))
    lens = F.when(F.col("w_.Lensing").isNotNull(), at(F.col("w_.Lensing.group")))
    return w.select(key, "story", "pos", F.col("w_.Name").alias("name"), F.col("w_.Description").alias("content"), at(F.col("w_.Group")).alias("group"), lens.alias("lens"), F.col("w_.Zoom").alias("zoom"), F.get("w_.Pan", 0).alias("x"), F.get("w_.Pan", 1).alias("y"))


def exhibit_channels(rows: DataFrame, key: str, json: str) -> DataFrame:
    """key, group, group_name, pos, name and colour: as many channels of a group as it has both names and colours."""
    d = F.from_json(F.col(json), EXHIBIT)
    g = rows.select(key, F.posexplode(d["Groups"]).alias("group", "g_"))
    both = F.slice(F.arrays_zip(F.col("g_.Channels").alias("name"), F.col("g_.Colors").alias("colour")), 1, F.least(F.size("g_.Channels"), F.size("g_.Colors")))
    return g.select(key, "group", F.col("g_.Name").alias("group_name"), F.posexplode(both).alias("pos", "c_")).select(key, "group", "group_name", "pos", "c_.name", "c_.colour")


def stored_viewport(bounds: Column, zoom: Column, x: Column, y: Column, image_w: Column, image_h: Column, width: Column, height: Column) -> Column:
    """Corners that a waypoint is stored with: its own bounds, those of its view, the whole image, or a unit square."""
    sized = (image_w > 0) & (image_h > 0)
    view = F.when(sized & (width > 0) & (height > 0) & zoom.isNotNull() & x.isNotNull() & y.isNotNull(), G.view_to_bounds(zoom, x, y, width, height))
    box = lambda w, h: F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), w.cast("double").alias("x1"), h.cast("double").alias("y1"))
    b = F.coalesce(bounds, view, F.when(sized, box(image_w, image_h)), box(F.lit(1), F.lit(1)))
    return F.struct(G.point(b["x0"], b["y0"]).alias("upperLeft"), G.point(b["x1"], b["y1"]).alias("lowerRight"))


def authored_bounds(viewport: Column) -> Column:
    """The bounds of a stored viewport, whichever of its corners is which."""
    a, b = viewport["upperLeft"], viewport["lowerRight"]
    return F.struct(*(f(a[k], b[k]).alias(f"{k}{i}") for i, f in ((0, F.least), (1, F.greatest)) for k in ("x", "y")))


def story_export(waypoints: Column, shapes: Column) -> Column:
    """A story as JSON of version 2."""
    return F.to_json(F.struct(F.lit("2").alias("version"), waypoints.alias("waypoints"), shapes.alias("shapes")))


def copied(shapes: Column, kind: str, version: int = 1) -> Column:
    """The text that shapes are copied as."""
    return F.to_json(F.struct(F.lit(version).alias("v"), F.lit(kind).alias("kind"), shapes.alias("shapes")))


def pasted(text: Column, kinds: list[str], salt: Column) -> Column:
    """Shapes (id, type, points, imported) of a copied text of one of the kinds; null for any other text.

    Rectangles and ellipses of older copies are polygons. Each gets a new id, which follows from salt, its place and its
    old one, and counts as imported."""
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    e = F.from_json(F.when(trimmed.startswith("{"), trimmed), "v double, kind string, shapes array<struct<id:string,type:string,polygon:array<array<double>>>>")
    fresh = lambda s, i: F.struct(uuid_of(F.concat_ws("/", salt.cast("string"), i.cast("string"), s["id"])).alias("id"), F.when(s["type"].isin("rectangle", "ellipse"), "polygon").otherwise(s["type"]).alias("type"), s["polygon"].alias("points"), F.lit(True).alias("imported"))
    return F.when(e["v"].isNotNull() & e["kind"].isin(kinds), F.transform(e["shapes"], fresh))


def loaded(rows: DataFrame, key: str, json: str, schema: str, violation) -> DataFrame:
    """key, id, doc and error of published documents: error says why one isn't loaded, else doc is there, with its own id or one that follows from key."""
    d = rows.select(key, F.from_json(F.col(json), schema).alias("d_"), F.col(json).alias("j_"))
    wrong = F.when(F.col("d_").isNull() | ~F.coalesce(F.trim("j_").startswith("{"), F.lit(False)), "not a document").otherwise(violation(F.col("d_")))
    named = F.coalesce(F.nullif(F.get_json_object("j_", "$.metadata.id"), F.lit("")), uuid_of(F.col(key).cast("string")))
    return d.select(key, F.when(wrong.isNull(), named).alias("id"), F.when(wrong.isNull(), F.col("d_")).alias("doc"), wrong.alias("error"))


def listed(stories: DataFrame, store: str) -> DataFrame:
    """store, pos, id, title and modified of the stories of each store, the last modified first; of equals the smaller id."""
    order = Window.partitionBy(store).orderBy(F.desc("modified"), "id")
    return stories.select(store, (F.row_number().over(order) - 1).alias("pos"), "id", F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit("Untitled")).alias("title"), "modified")
