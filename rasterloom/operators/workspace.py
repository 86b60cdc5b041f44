"""What an editor does with a document's parts: publishing, removing, finishing shapes, groups, stories, first steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions import geometry as G

# Image sources whose tiles hold cube roots; colours of planar red, green and blue.
CUBE_ROOT_SOURCES, PLANAR_COLOURS = ("jpeg-pyramid-cube-root", "jpeg-ome-tiff"), ("ff0000", "00ff00", "0000ff")


def transfer_of(source: Column) -> Column:
    """How an image source's tiles were encoded."""
    return F.when(source.isin(*CUBE_ROOT_SOURCES), "cube-root").otherwise("contrast")


def folder_limits(transfer: Column, lower: Column, upper: Column) -> tuple[Column, Column]:
    """Limits that name a folder: those of the row, or the whole range where tiles don't depend on them."""
    whole = transfer == "cube-root"
    return F.when(whole, 0).otherwise(lower), F.when(whole, 65535).otherwise(upper)


def content_role(stored: Column, inferred: Column) -> Column:
    return F.when(stored.isin("segmentation", "intensity"), stored).otherwise(inferred)


def planar_colour(slot: Column) -> Column:
    return F.get(F.array(*map(F.lit, PLANAR_COLOURS)), slot)


def tile_scale(tile: Column, z: Column) -> Column:
    return tile * F.pow(F.lit(2.0), F.abs(z))


def snapshot_bounds(zoom: Column, x: Column, y: Column, width: Column, height: Column) -> Column:
    """What a view shows; zoom is a list whose first number counts, and without one there are no bounds."""
    s = F.pow(F.lit(2.0), F.get(zoom, 0)) * 2
    return F.when(F.get(zoom, 0).isNotNull(), F.struct((x - width / s).alias("x0"), (y - height / s).alias("y0"), (x + width / s).alias("x1"), (y + height / s).alias("y1")))


def arrow_ring(x: Column, y: Column) -> Column:
    """An arrow's tip as a ring of four equal points."""
    return F.array_repeat(G.point(x, y), 4)


def out_of_mask(ring: Column, rect: Column, box: Column, scale: float = 4.0) -> Column:
    """A polygon in cells of a small mask as a polygon of the image; empty for fewer than three points."""
    moved = F.transform(ring, lambda p: G.out_of_letterbox(G.point(p["x"] * scale, p["y"] * scale), rect, box))
    return F.when(F.size(ring) < 3, F.slice(moved, 1, 0)).otherwise(moved)


def shape_label(n: Column) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, " shape").otherwise(" shapes"))


def handle_key(story: Column, image: Column) -> Column:
    return F.concat(F.when(F.coalesce(story, F.lit("")) != "", F.concat(F.lit("story:"), story, F.lit(":"))).otherwise(""), F.lit("image:"), image)


def tile_file(z: Column, x: Column, y: Column) -> Column:
    return F.concat(F.concat_ws("_", (-z).cast("string"), x.cast("string"), y.cast("string")), F.lit(".jpg"))


def previewed(own: Column, previewed_id: Column, own_id: Column, preview: Column) -> Column:
    """A value as it is previewed for one channel; its own for the others, or where the preview has none."""
    return F.when(own_id == previewed_id, F.coalesce(preview, own)).otherwise(own)


def seed_action(stories: Column, waypoints: Column, aligned: Column, mirror_shapes: Column, shapes: Column, legacy: Column, unmigrated: Column, view_w: Column, view_h: Column, image_w: Column, image_h: Column) -> Column:
    """What is to do next with a configuration's waypoints: seedStore, setShapes, syncMirror, migratePan or noop.

    stories, waypoints, mirror_shapes and shapes are counts; aligned: ids are the same in order; legacy: old markers are
    left; unmigrated: a view is still in shares of the image."""
    sized = (image_w > 0) & (image_h > 0)
    return (
        F.when((stories == 0) | (view_w == 0) | (view_h == 0), "noop")
        .when(waypoints == 0, F.when(sized, "seedStore").otherwise("noop"))
        .when((mirror_shapes > 0) & (shapes == 0), "setShapes")
        .when(~aligned, "noop")
        .when(legacy, "syncMirror")
        .when(sized & unmigrated, "migratePan")
        .otherwise("noop")
    )


def published_group(active: DataFrame, groups: DataFrame) -> DataFrame:
    """document and its active group after new groups are published: none without groups, the first one on reset, else as it was.

    active: document, group, reset."""
    first = groups.groupBy("document").agg(F.min_by("group", "pos").alias("first_"))
    return active.join(first, "document", "left").select("document", F.when(F.col("first_").isNull(), None).when(F.col("reset"), F.col("first_")).otherwise(F.col("group")).alias("group"))


def after_removal(rows: DataFrame, channels: DataFrame, removed: DataFrame, active: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Group rows (document, group, pos, channel) without channels of removed images (image), and each document's active group.

    Groups that become empty go; where the active one did, the first that is left is active."""
    gone = channels.join(removed.select("image").distinct(), "image", "left_semi").select(F.col("id").alias("channel"))
    left = rows.join(gone, "channel", "left_anti").select(rows.columns)
    there = left.select("document", "group").distinct()
    lost = active.join(there, ["document", "group"], "left_anti").select("document", F.lit(True).alias("reset"))
    state = active.join(lost, "document", "left").na.fill({"reset": False})
    return left, published_group(state, there.withColumn("pos", F.col("group")))


def finished(drawn: DataFrame, counts: DataFrame) -> DataFrame:
    """drawn (document, id, tool, points) as shapes with type and label 'Untitled n'; what has too few points goes.

    A lasso needs three points, a polyline and a line two, others one. counts: document, n shapes that are there."""
    least = F.when(F.col("tool") == "lasso", 3).when(F.col("tool").isin("polyline", "line", "rectangle", "ellipse"), 2).otherwise(1)
    kept = drawn.where(F.size("points") >= least)
    n = F.row_number().over(Window.partitionBy("document").orderBy("id"))  # what one user drew
    kind = F.when(F.col("tool").isin("lasso", "rectangle", "ellipse"), "polygon").otherwise(F.col("tool"))
    p = F.col("points")
    box = G.rectangle(F.get(p, 0)["x"], F.get(p, 0)["y"], F.get(p, 1)["x"], F.get(p, 1)["y"])
    ring = F.when(F.col("tool") == "rectangle", box).when(F.col("tool") == "lasso", G.closed(p)).otherwise(p)
    label = F.concat(F.lit("Untitled "), (F.coalesce("n", F.lit(0)) + n).cast("string"))
    return kept.join(counts, "document", "left").select("document", "id", kind.alias("type"), ring.alias("points"), label.alias("label"))


def edited_members(members: DataFrame, added: DataFrame, removed: DataFrame, deleted: DataFrame) -> DataFrame:
    """Members of shape groups (group, pos, shape) after edits: removed ones and those of deleted groups go, added ones follow in their order."""
    left = members.join(removed, ["group", "shape"], "left_anti").join(deleted, "group", "left_anti")
    last = left.groupBy("group").agg(F.max("pos").alias("last_"))
    new = added.join(deleted, "group", "left_anti").join(last, "group", "left")
    at = F.coalesce("last_", F.lit(-1)) + F.row_number().over(Window.partitionBy("group").orderBy("order", "shape"))  # edits of one group
    return left.select("group", "pos", "shape").unionByName(new.select("group", at.alias("pos"), "shape"))


def changed_waypoints(waypoints: DataFrame, built: DataFrame, shapes: DataFrame) -> DataFrame:
    """waypoint and shape_ids of waypoints whose shapes, as they are now, differ from what is stored; others are not written.

    waypoints: waypoint, shape_ids; built: waypoint, pos, id, body; shapes: id, body of stored ones."""
    digest = lambda body: F.xxhash64(body)
    now = built.join(shapes.select("id", digest("body").alias("stored_")), "id", "left")
    ids = now.groupBy("waypoint").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("now_"), F.bool_or(~F.col("stored_").eqNullSafe(digest("body"))).alias("new_"))
    none = F.expr("cast(array() as array<string>)")
    found = waypoints.join(ids, "waypoint", "left").select("waypoint", F.coalesce("shape_ids", none).alias("before_"), F.coalesce("now_", none).alias("shape_ids"), F.coalesce("new_", F.lit(False)).alias("new_"))
    return found.where("new_ or before_ <> shape_ids").select("waypoint", "shape_ids")


def selection_shape(waypoints: DataFrame, shapes: DataFrame) -> DataFrame:
    """waypoint and the first of its shape ids, the preferred ones first, whose shape encloses something.

    waypoints: waypoint, shape_ids, preferred; shapes: id, encloses."""
    tried = F.array_union(F.coalesce("preferred", F.expr("cast(array() as array<string>)")), F.col("shape_ids"))
    each = waypoints.where(F.size("shape_ids") > 0).select("waypoint", F.posexplode(tried).alias("at", "id"))
    return each.join(shapes.where("encloses").select("id"), "id").groupBy("waypoint").agg(F.min_by("id", "at").alias("shape"))


def after_deletion(stories: DataFrame, deleted: DataFrame, active: DataFrame) -> DataFrame:
    """store and its active story after stories (store, id, modified) are deleted (store, id): the newest one left, or a new one."""
    left = stories.join(deleted, ["store", "id"], "left_anti")
    newest = left.groupBy("store").agg(F.max_by("id", F.struct("modified", "id")).alias("newest_"))
    lost = deleted.withColumn("lost_", F.lit(True))
    out = active.join(lost, ["store", "id"], "left").join(newest, "store", "left")
    return out.select("store", F.when(F.col("lost_"), F.coalesce("newest_", F.lit("Untitled Story"))).otherwise(F.col("id")).alias("id"))


def default_waypoints(documents: DataFrame, waypoints: DataFrame, groups: DataFrame) -> DataFrame:
    """document, name and group of the first waypoint that a document gets if it has none; its group is the document's first."""
    first = groups.groupBy("document").agg(F.min_by("group", "pos").alias("group"))
    return documents.join(waypoints.select("document").distinct(), "document", "left_anti").join(first, "document", "left").select("document", F.lit("Waypoint 1").alias("name"), "group")


def looked_up_groups(groups: DataFrame, lookup: DataFrame, channels: DataFrame) -> DataFrame:
    """document, path, pos, name and channel of the rows of groups (document, path, names) whose path the lookup (path, indices) knows.

    A group is taken if it has as many names as indices and all of them are channels of its document (document, index, id)."""
    known = groups.join(F.broadcast(lookup), "path").where(F.size("names") == F.size("indices"))  # a fixed list of paths
    n = channels.groupBy("document").agg(F.count("*").alias("n_"))
    inside = known.join(n, "document").where(F.forall("indices", lambda i: (i >= 0) & (i < F.col("n_"))))
    each = inside.select("document", "path", F.posexplode(F.arrays_zip("names", "indices")).alias("pos", "x"))
    return each.select("document", "path", "pos", F.col("x.names").alias("name"), F.col("x.indices").alias("index")).join(channels, ["document", "index"]).select("document", "path", "pos", "name", F.col("id").alias("channel"))


def loader_entries(rows: DataFrame, available: DataFrame) -> DataFrame:
    """image, group, folders (a map from channel to folder) and whether all of them are available (image, folder)."""
    there = available.select("image", "folder").distinct().withColumn("there_", F.lit(True))
    found = rows.join(there, ["image", "folder"], "left")
    return found.groupBy("image", "group").agg(F.map_from_entries(F.sort_array(F.collect_set(F.struct("channel", "folder")))).alias("folders"), F.every(F.coalesce("there_", F.lit(False))).alias("complete"))
