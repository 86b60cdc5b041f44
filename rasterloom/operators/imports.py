"""Images that come into a document or replace one of it, and the joins that plan their export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import exports as X


def extracted(channels: DataFrame, kind: str = "channel") -> DataFrame:
    """image, index, name, kind and samples of new channels (image, index, name, samples, dtype).

    A name that is missing is 'Channel n'; an image that is one channel of three bytes is a stain picture, 'H&E'."""
    alone = F.count("*").over(Window.partitionBy("image")) == 1
    stain = alone & (F.col("samples") == 3) & (F.lower("dtype") == "uint8")
    plain = F.coalesce(F.nullif("name", F.lit("")), F.concat(F.lit("Channel "), (F.col("index") + 1).cast("string")))
    return channels.select("image", "index", F.when(stain, "H&E").otherwise(plain).alias("name"), F.lit(kind).alias("kind"), "samples")


def pixel_size(meta: Column, plane: Column) -> Column:
    """A side: the metadata's, else that of the finest plane, else null; it must be positive."""
    return F.coalesce(F.when(meta > 0, meta), F.when(plane > 0, plane))


def imported(images: DataFrame, fresh: DataFrame, channels: DataFrame) -> DataFrame:
    """images (document, pos, image, basename, role, width, height, n_channels) with fresh ones in their order after the others.

    Places follow the last one of a document, so nothing that is there is touched or numbered again."""
    last = images.groupBy("document").agg(F.max("pos").alias("last_"))
    counts = channels.groupBy("image").agg(F.count("*").alias("n_channels"))
    n = F.row_number().over(Window.partitionBy("document").orderBy("order", "image"))  # images of one import
    new = fresh.join(last, "document", "left").join(counts, "image", "left")
    new = new.withColumn("pos", F.coalesce("last_", F.lit(-1)) + n).withColumn("n_channels", F.coalesce("n_channels", F.lit(0)))
    return images.unionByName(new.select(images.columns))


def replaced(images: DataFrame, channels: DataFrame, swaps: DataFrame, fresh: DataFrame, fresh_channels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """images, channels and refusals after swaps (old, image): each new image takes the place of its old one.

    images and fresh have image, pos (of images) and role, and other columns alike; channels have image, id, index, name,
    kind and limits. Channels are matched by their rank in index: they keep id and name, and what else of the old one is
    set. A new image with another number of channels is refused, and so is one for an image that isn't there. It is one
    pass: rows that stay are read once and keep their place."""
    rank = lambda df: df.withColumn("rank_", F.row_number().over(Window.partitionBy("image").orderBy("index", "id")))
    size = lambda df, name: df.groupBy("image").agg(F.count("*").alias(name))
    old_n = size(channels, "expected").withColumnRenamed("image", "old")
    known = images.select(F.col("image").alias("old"), F.col("role").alias("role_"), F.col("pos").alias("pos_"))
    checked = swaps.join(known, "old", "left").join(old_n, "old", "left").join(size(fresh_channels, "got"), "image", "left").na.fill(0, ["expected", "got"])
    good = F.col("pos_").isNotNull() & (F.col("expected") == F.col("got"))
    refused = checked.where(~good).select("old", "image", F.when(F.col("pos_").isNull(), "missing").otherwise(F.concat(F.lit("expected "), F.col("expected").cast("string"), F.lit(" channels, got "), F.col("got").cast("string"))).alias("reason"))
    ok = checked.where(good)
    new = fresh.drop("pos").join(ok.select("image", F.col("pos_").alias("pos"), "role_"), "image").withColumn("role", F.coalesce("role_", "role")).select(images.columns)
    kept = images.join(ok.select(F.col("old").alias("image")), "image", "left_anti").select(images.columns)
    before = rank(channels.join(ok.select(F.col("old").alias("image"), F.col("image").alias("to_")), "image"))
    before = before.select(F.col("to_").alias("image"), "rank_", *(F.col(c).alias(f"{c}_") for c in channels.columns if c != "image"))
    after = rank(fresh_channels.join(ok.select("image"), "image", "left_semi")).join(before, ["image", "rank_"])
    first = {"id": F.col("id_"), "name": F.col("name_"), "index": F.col("index")}
    bound = after.select(*(F.col("image") if c == "image" else first.get(c, F.coalesce(f"{c}_", c)).alias(c) for c in channels.columns))
    rest = channels.join(ok.select(F.col("old").alias("image")), "image", "left_anti").select(channels.columns)
    return kept.unionByName(new), rest.unionByName(bound), refused


def new_group(groups: DataFrame, visible: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups (document, group, pos, name, expanded) with one more in each document of visible, and its rows.

    Only the first group of a document is filled, with its visible channels (document, pos, channel) in their order; a
    new group is the one that is open."""
    state = groups.groupBy("document").agg(F.max("pos").alias("last_"), F.count("*").alias("n_"))
    docs = visible.select("document").distinct().join(state, "document", "left").na.fill({"last_": -1, "n_": 0})
    number = (F.col("n_") + 1).cast("string")
    made = docs.select("document", F.concat_ws("-", F.lit("group"), F.col("document").cast("string"), number).alias("group"), (F.col("last_") + 1).alias("pos"), F.concat(F.lit("Group "), number).alias("name"), F.lit(True).alias("expanded"))
    closed = groups.join(docs.select("document", F.lit(False).alias("shut_")), "document", "left").withColumn("expanded", F.coalesce("shut_", "expanded")).select(groups.columns)
    rows = visible.join(docs.where("n_ = 0").select("document"), "document", "left_semi").join(made.select("document", "group"), "document").select("document", "group", "pos", "channel")
    return closed.unionByName(made.select(groups.columns)), rows


def without_group(groups: DataFrame, gone: DataFrame, active: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups without those of gone (document, group), and active (document, group): the first one left where it went."""
    left = groups.join(gone, ["document", "group"], "left_anti")
    first = left.groupBy("document").agg(F.min_by("group", "pos").alias("first_"))
    lost = active.join(gone.withColumn("lost_", F.lit(True)), ["document", "group"], "left").join(first, "document", "left")
    return left, lost.select("document", F.when(F.col("lost_"), F.col("first_")).otherwise(F.col("group")).alias("group"))


def activated(groups: DataFrame, chosen: DataFrame) -> DataFrame:
    """Groups of which the chosen one (document, group) of a document is the only one that is open."""
    c = chosen.withColumnRenamed("group", "open_")
    return groups.join(c, "document", "left").withColumn("expanded", F.when(F.col("open_").isNull(), F.col("expanded")).otherwise(F.col("group") == F.col("open_"))).select(groups.columns)


def export_folders(rows: DataFrame, channels: DataFrame) -> DataFrame:
    """group, channel, c, folder and settings (JSON) of each group row (group, channel, lower, upper) whose channel has an index c."""
    known = rows.join(channels.select(F.col("id").alias("channel"), F.col("index").alias("c")), "channel")
    settings = F.to_json(F.struct(F.col("c").alias("channel"), F.col("channel").alias("channelId"), F.col("lower").alias("lowerLimit"), F.col("upper").alias("upperLimit")))
    return known.select("group", "channel", "c", X.folder_of(F.col("channel"), F.col("lower"), F.col("upper")).alias("folder"), settings.alias("settings"))


def export_work(loaders: DataFrame, images: DataFrame, channels: DataFrame, rows: DataFrame) -> DataFrame:
    """image, basename, channels (ids by index) and tiles of what is exported: loaders (image, level, width, height, tile)
    of known images with intensity channels that some group shows."""
    wanted = channels.where("kind <> 'mask' OR kind IS NULL").join(rows.select(F.col("channel").alias("id")).distinct(), "id", "left_semi")
    lists = wanted.groupBy("image").agg(F.transform(F.sort_array(F.collect_list(F.struct("index", "id"))), lambda x: x["id"]).alias("channels"))
    tiles = loaders.groupBy("image").agg(F.sum(F.ceil(F.col("width") / F.col("tile")) * F.ceil(F.col("height") / F.col("tile"))).alias("tiles_"))
    out = images.select("image", "basename").join(tiles, "image").join(lists, "image")
    return out.select("image", "basename", "channels", (F.col("tiles_") * F.size("channels")).alias("tiles"))


def requested(requests: DataFrame, channels: DataFrame, loaders: DataFrame) -> DataFrame:
    """image and its requested channels (index, channel, in order of request) that exist and have a loader."""
    found = requests.join(channels.select(F.col("id").alias("channel"), "image", "index"), "channel").join(loaders.select("image").distinct(), "image", "left_semi")
    lists = F.sort_array(F.collect_list(F.struct("pos", "index", "channel")))
    return found.groupBy("image").agg(F.transform(lists, lambda x: F.struct(x["index"].alias("index"), x["channel"].alias("channel"))).alias("channels"))
