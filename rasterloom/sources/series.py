"""Tile series from instance metadata: frame maps, pyramids and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def full_frames(instances: DataFrame) -> DataFrame:
    """instance, key 'row-column-channel' and frame number of fully tiled instances.

    Frames run along columns, then rows, planes and channels; a later plane of the same key wins, as in a map that is
    written in that order. instances: instance, width, height, columns, rows, planes, channels (array of names)."""
    across, down = F.ceil(F.col("width") / F.col("columns")), F.ceil(F.col("height") / F.col("rows"))
    i = instances.withColumn("__c", across).withColumn("__r", down)
    i = i.select("instance", "planes", "__c", "__r", F.posexplode("channels").alias("__k", "channel"))
    i = i.withColumn("__p", F.col("planes") - 1)
    i = i.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), "__r"))).withColumn("col", F.explode(F.sequence(F.lit(1).cast("long"), "__c")))
    number = ((F.col("__k") * F.col("planes") + F.col("__p")) * F.col("__r") + F.col("row") - 1) * F.col("__c") + F.col("col")
    return i.select("instance", F.concat_ws("-", "row", "col", "channel").alias("key"), number.cast("long").alias("frame"))


def sparse_frames(frames: DataFrame) -> DataFrame:
    """instance, key and frame of frames with positions (instance, frame, x, y, rows, columns, channel); the last of a key wins."""
    key = F.concat_ws("-", F.ceil(F.col("y") / F.col("rows")), F.ceil(F.col("x") / F.col("columns")), "channel")
    return frames.select("instance", key.alias("key"), "frame").groupBy("instance", "key").agg(F.max("frame").alias("frame"))


def frame_path(instance: Column, frame: Column) -> Column:
    return F.concat(instance, F.lit("/frames/"), frame.cast("string"))


def last_segments(path: Column, n: int = 3) -> Column:
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - n + 1), F.lit(n)), "/")


def mapping_numbers(frames: DataFrame) -> DataFrame:
    """instance, label, number and frames: mappings are numbered by their first frame."""
    m = frames.groupBy("instance", "label").agg(F.min("frame").alias("__first"), F.sort_array(F.collect_list("frame")).alias("frames"))
    return m.withColumn("number", F.row_number().over(W.partitionBy("instance").orderBy("__first"))).drop("__first")


def pyramids(instances: DataFrame) -> DataFrame:
    """series, level (0: the smallest), width, height, tiles and zoom of each size; parts of the same size are one level.

    zoom is how many times the largest level is wider, to two decimals where it isn't whole."""
    sizes = instances.groupBy("series", "width", "height").agg(F.min("columns").alias("columns"), F.min("rows").alias("rows"), F.count("*").alias("parts"))
    w = W.partitionBy("series")
    zoom = F.max("width").over(w) / F.col("width")
    return sizes.select(
        "series", (F.row_number().over(w.orderBy("width", "height")) - 1).alias("level"), "width", "height", "parts",
        (F.ceil(F.col("width") / F.col("columns")) * F.ceil(F.col("height") / F.col("rows"))).alias("tiles"),
        F.when(zoom == F.floor(zoom), zoom).otherwise(F.round(zoom, 2)).alias("zoom"),
    )


def pyramid_errors(instances: DataFrame) -> DataFrame:
    """series and what differs between its instances: frame of reference, container or number of channels."""
    checks = {"frame of reference": "reference", "container": "container", "channels": "n_channels"}
    n = instances.groupBy("series").agg(*(F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in checks.values()))
    wrong = F.filter(F.array(*(F.when(F.col(c) > 1, F.lit(k)) for k, c in checks.items())), lambda x: x.isNotNull())
    return n.select("series", F.explode(wrong).alias("differs"))


def tile_extent(tile: Column, at: Column, side: Column) -> Column:
    """Pixels of a tile along one side: the rest at the index just past the whole tiles, else a whole tile."""
    return F.when(at == F.floor(side / tile), side % tile).otherwise(tile)


def served_tile(tiled: Column, tx: Column, ty: Column) -> Column:
    """Untiled planes have the one tile at the origin."""
    return tiled | ((tx == 0) & (ty == 0))


def first_readable(planes: DataFrame) -> DataFrame:
    """The coarsest level of each plane that can be read and isn't empty."""
    n = F.row_number().over(W.partitionBy("plane").orderBy(F.col("level").desc()))
    return planes.where("readable AND n_values > 0").withColumn("__n", n).where("__n = 1").drop("__n")


def routed(sources: DataFrame) -> DataFrame:
    """What opens each source, by its kind and role; series once each."""
    opener = F.when(F.col("kind") == "dicomWeb", "series").when(F.col("kind") == "jpeg", "folder").when((F.col("kind").isin("url", "local")) & (F.col("role") == "mask"), "mask").when(F.col("kind").isin("url", "local"), "intensity")
    key = F.when(opener == "series", F.col("series")).otherwise(F.col("id").cast("string"))
    return sources.select(opener.alias("opener"), key.alias("key")).where("opener is not null").distinct()
