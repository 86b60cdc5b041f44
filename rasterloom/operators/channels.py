"""Channels, groups and layers: visibility, colours, limits and composition."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Channels that are on at import; layers that are drawn at once; limits without a fit.
FIRST_VISIBLE, MOST_LAYERS, DEFAULT_LIMITS = 4, 6, (32, 16384)


def effective_kind(kind: Column) -> Column:
    return F.when(kind == "mask", "mask").otherwise("channel")


def visible(flags: Column, key: Column) -> Column:
    """A missing entry is visible."""
    return F.coalesce(F.try_element_at(flags, key), F.lit(True))


def planar_slot(name: Column) -> Column:
    """0, 1, 2 for names that are or end in r, g, b: 'r', 'x_r', 'x-r', 'x[r]'; else null."""
    letter = F.lower(F.regexp_extract(F.trim(name), r"(?i)(?:^|[_-])([rgb])$|\[([rgb])\]$", 0))
    last = F.regexp_extract(letter, r"([rgb])\]?$", 1)
    return F.when(last == "r", 0).when(last == "g", 1).when(last == "b", 2)


def effective_limits(lower: Column, upper: Column, fit_lower: Column, fit_upper: Column) -> tuple[Column, Column]:
    """A fit first, then a channel's own limits, then the defaults."""
    return F.coalesce(fit_lower, lower, F.lit(DEFAULT_LIMITS[0])), F.coalesce(fit_upper, upper, F.lit(DEFAULT_LIMITS[1]))


def effective_colour(own: Column, planar: Column, is_rgb: Column, index: Column, seeds: list[str]) -> Column:
    """A channel's own colour, its planar one, magenta for RGB images, else the seeds in turn."""
    return F.coalesce(own, planar, F.when(is_rgb, F.lit("ff00ff")), F.get(F.array(*map(F.lit, seeds)), F.pmod(index, F.lit(len(seeds))).cast("int")))


def image_role(channels: DataFrame) -> DataFrame:
    """image and role: intensity, segmentation, mixed, by the kinds of its channels."""
    mask = F.bool_or(F.col("kind") == "mask")
    other = F.bool_or(F.col("kind") != "mask")
    return channels.groupBy("image").agg(F.when(mask & other, "mixed").when(mask, "segmentation").when(other, "intensity").alias("role"))


def rgb_display(channels: DataFrame) -> DataFrame:
    """Images that show as RGB: one channel of three samples, or three planar ones with r, g and b or all unsigned."""
    n = F.count("*")
    planar = (n == 3) & ((F.count_distinct(planar_slot(F.col("name"))) == 3) | F.every(F.col("dtype").startswith("Uint")))
    return channels.groupBy("image").agg((((n == 1) & (F.max("samples") == 3)) | planar).alias("rgb"))


def planar_ranks(channels: DataFrame) -> DataFrame:
    """slot: rank by index in images of exactly three channels; else null."""
    w = W.partitionBy("image")
    return channels.withColumn("slot", F.when(F.count("*").over(w) == 3, F.row_number().over(w.orderBy("index", "id")) - 1))


def default_visibility(channels: DataFrame, has_groups: bool = False) -> DataFrame:
    """id and visible at import, by pos: the first intensity channels and all masks are on.

    prev (null: unknown) is kept where the user has hidden something, or where few enough are on."""
    every = W.partitionBy("document")
    intensity = F.col("kind") != "mask"
    hidden = F.bool_or(F.col("prev") == F.lit(False)).over(every)
    shown = F.sum((intensity & F.coalesce("prev", F.lit(True))).cast("int")).over(every)
    keep = (F.coalesce(hidden, F.lit(False)) | (F.lit(not has_groups) & (shown <= FIRST_VISIBLE))) & F.col("prev").isNotNull()
    before = every.orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    # channels that are kept on count against the first ones; new ones count until the places are taken
    kept_before = F.coalesce(F.sum((keep & intensity & F.col("prev")).cast("int")).over(before), F.lit(0))
    new_before = F.coalesce(F.sum((~keep & intensity).cast("int")).over(before), F.lit(0))
    out = channels.withColumn("__keep", keep).withColumn("__seen", kept_before + new_before)
    fresh = F.when(F.col("kind") == "mask", True).otherwise(F.lit(not has_groups) & (F.col("__seen") < FIRST_VISIBLE))
    return out.select("document", "id", F.when(F.col("__keep"), F.col("prev")).otherwise(fresh).alias("visible"))


def composition(channels: DataFrame, group_rows: DataFrame, active: str | None, has_map: bool = True) -> DataFrame:
    """Layers in order: (branch, pos, channel, row).

    Without an active group the visible channels, or the first few if nothing says what is visible. With one: its rows
    that are on, in their order, then the visible channels of no group.
    channels: id, pos, on; group_rows: row, group, pos, channel, on."""
    null = F.lit(None).cast("long")
    if active is None:
        some = channels.where(F.coalesce("on", F.lit(True))) if has_map else channels.orderBy("pos").limit(FIRST_VISIBLE)
        return some.select(F.lit(0).alias("branch"), F.col("pos").cast("long").alias("pos"), F.col("id").alias("channel"), null.alias("row"))
    own = group_rows.where((F.col("group") == active) & F.coalesce("on", F.lit(True)))
    rows = own.join(channels.select(F.col("id").alias("channel")), "channel").select(F.lit(0).alias("branch"), F.col("pos").cast("long").alias("pos"), "channel", F.col("row").cast("long").alias("row"))
    if not has_map:
        return rows
    free = channels.join(group_rows.select(F.col("channel").alias("id")).distinct(), "id", "left_anti").where(F.coalesce("on", F.lit(True)))
    return rows.unionByName(free.select(F.lit(1).alias("branch"), F.col("pos").cast("long").alias("pos"), F.col("id").alias("channel"), null.alias("row")))


def effective_mask_style(rows: DataFrame, channels: DataFrame, active: str) -> DataFrame:
    """id and style: of the channel's row in the active group, then of its first other row, then its own."""
    order = W.partitionBy("channel").orderBy((F.col("group") != active), "gpos", "pos")
    first = rows.where("style is not null").withColumn("n", F.row_number().over(order)).where("n = 1").select(F.col("channel").alias("id"), F.col("style").alias("__style"))
    return channels.join(first, "id", "left").select("id", F.coalesce("__style", "style").alias("style"))


def legend(rows: DataFrame, channels: DataFrame) -> DataFrame:
    """Rows of a legend with names, colours and limits; rows without a channel go."""
    return rows.join(channels.select(F.col("id").alias("channel"), "name"), "channel").select("group", "pos", "channel", "name", "colour", "lower", "upper")


def legend_sections(rows: DataFrame, channels: DataFrame, active: str) -> DataFrame:
    """Per image: the active group's rows, a divider where both parts are there, then overlays of no group."""
    own = rows.where(F.col("group") == active).join(channels.select(F.col("id").alias("channel"), "image", "name"), "channel").select("image", F.lit(0).alias("part"), F.col("pos").cast("long").alias("pos"), "name")
    grouped = rows.select(F.col("channel").alias("id")).distinct()
    over = channels.join(grouped, "id", "left_anti").where("kind = 'mask'").select("image", F.lit(2).alias("part"), F.col("pos").cast("long").alias("pos"), "name")
    both = own.select("image").distinct().join(over.select("image").distinct(), "image", "left_semi")
    divider = both.select("image", F.lit(1).alias("part"), F.lit(0).cast("long").alias("pos"), F.lit("-").alias("name"))
    return own.unionByName(divider).unionByName(over)


def numbered_labels(rows: DataFrame, by: str, label: str, order: list[str]) -> DataFrame:
    """Repeated labels get ' (2)', ' (3)' and so on in order; the first stays."""
    n = F.row_number().over(W.partitionBy(by, label).orderBy(*order))
    return rows.withColumn("label", F.when(n > 1, F.concat(F.col(label), F.lit(" ("), n.cast("string"), F.lit(")"))).otherwise(F.col(label)))


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in order."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def cycled(rows: DataFrame, group: str, order: list[str], n: int = 4) -> DataFrame:
    """slot: place within the group modulo n."""
    return rows.withColumn("slot", F.pmod(F.row_number().over(W.partitionBy(group).orderBy(*order)) - 1, F.lit(n)))


def seeded(channels: DataFrame, n_seeds: int = 4) -> DataFrame:
    """seed: running number of intensity channels before each intensity channel of its image, modulo the seeds."""
    w = W.partitionBy("image").orderBy("index", "id").rowsBetween(W.unboundedPreceding, 0)
    k = F.count_if(F.col("kind") != "mask").over(w) - 1
    return channels.withColumn("seed", F.when(F.col("kind") != "mask", F.pmod(k, F.lit(n_seeds))))


def rebound(old: DataFrame, new: DataFrame) -> DataFrame:
    """Channels of a replaced image keep their ids by rank of index; counts must agree (see rebind_errors).

    old: image, index, id, name; new: image, index, name."""
    rank = lambda df: df.withColumn("__k", F.row_number().over(W.partitionBy("image").orderBy("index")))
    o = rank(old).select("image", "__k", "id", F.col("name").alias("__name"))
    return rank(new).join(o, ["image", "__k"], "left").select("image", "id", "index", F.coalesce("name", "__name").alias("name"))


def rebind_errors(old: DataFrame, new: DataFrame) -> DataFrame:
    """Images whose replacement has another number of channels."""
    a = old.groupBy("image").agg(F.count("*").alias("old_n"))
    b = new.groupBy("image").agg(F.count("*").alias("new_n"))
    return a.join(b, "image", "full").where(~F.col("old_n").eqNullSafe(F.col("new_n")))


def master_visibility(rows: DataFrame, key: str, on: str) -> DataFrame:
    """all_on and any_on for each key; hidden: there are rows and all are off."""
    on_ = F.coalesce(F.col(on), F.lit(True))
    return rows.groupBy(key).agg(F.every(on_).alias("all_on"), F.bool_or(on_).alias("any_on"), (~F.bool_or(on_)).alias("hidden"))


def reordered(items: DataFrame, start: int, to: int) -> DataFrame:
    """pos after the item at start moves to place to."""
    p = F.col("pos")
    if start < to:
        moved = F.when((p > start) & (p <= to), p - 1)
    else:
        moved = F.when((p >= to) & (p < start), p + 1)
    return items.withColumn("pos", F.when(p == start, to).otherwise(F.coalesce(moved, p)))


def removed_at(items: DataFrame, at: int) -> DataFrame:
    return items.where(F.col("pos") != at).withColumn("pos", F.when(F.col("pos") > at, F.col("pos") - 1).otherwise(F.col("pos")))


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)
