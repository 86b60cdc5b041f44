"""References between the tables of a document: repair, violations, overlays and id dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed value: the standard form of a UUID with its version and variant.
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"


#: Bits of a place within a block of places that are numbered together.
_BLOCK = 16


def is_uuid(c: Column) -> Column:
    return F.coalesce(c.rlike(UUID), F.lit(False))


def uuid_of(c: Column) -> Column:
    """A UUID that follows from the text: the digest's first digits with version 5 and variant 8."""
    h = F.sha2(c, 256)
    part = lambda k, n: F.substring(h, k, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(F.lit("8"), part(18, 3)), part(21, 12))


def drop_orphans(rows: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key a parent has."""
    return rows.join(parents.select(F.col(parent_key).alias(key)).distinct(), key, "left_semi").select(rows.columns)


def null_orphans(rows: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Rows with key null where no parent has it."""
    known = parents.select(F.col(parent_key).alias("__p")).distinct()
    return rows.join(known, F.col(key) == F.col("__p"), "left").withColumn(key, F.col("__p")).drop("__p").select(rows.columns)


def violations(rows: DataFrame, name: str, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """table and key of the references that lead nowhere."""
    lost = rows.where(F.col(key).isNotNull()).join(parents.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")
    return lost.select(F.lit(name).alias("table"), F.col(key).cast("string").alias("key")).distinct()


def resolved(owners: DataFrame, owner: str, ids: str, targets: DataFrame, target: str) -> DataFrame:
    """owner, pos and the columns of targets, in the order of the ids array; ids that lead nowhere go."""
    at = owners.select(owner, F.posexplode(ids).alias("pos", target))
    return at.join(targets, target)


def overlaid(base: DataFrame, over: DataFrame, key: str) -> DataFrame:
    """base (key, pos, …) with the rows of over in place of those with the same key; new ones follow.

    New rows are numbered in blocks of places: within a block by a window, blocks by the counts of those before."""
    last = base.agg(F.coalesce(F.max("pos"), F.lit(-1)).cast("long").alias("last")).first()["last"]
    kept = base.join(over.select(key), key, "left_anti")
    there = over.join(base.select(key, F.col("pos").alias("__pos")), key, "left")
    block = F.shiftright(F.col("pos").cast("long"), _BLOCK).alias("__block")
    new = there.where("__pos is null").select("*", block)
    counts = new.groupBy("__block").agg(F.count("*").alias("__rows"))
    before = F.sum("__rows").over(W.orderBy("__block")) - F.col("__rows")  # a row for each block of 2^_BLOCK places
    n = F.row_number().over(W.partitionBy("__block").orderBy("pos", key))
    fresh = new.withColumn("__n", n).join(counts.select("__block", before.alias("__before")), "__block").withColumn("pos", F.lit(last) + F.col("__before") + F.col("__n"))
    same = there.where("__pos is not null").withColumn("pos", F.col("__pos").cast("long"))
    cols = base.columns
    return kept.withColumn("pos", F.col("pos").cast("long")).select(cols).unionByName(same.select(cols)).unionByName(fresh.select(cols))


def first_match(rows: DataFrame, keys: list[str], right: DataFrame, order: str, take: str) -> DataFrame:
    """rows with take of the first row of right that has the same keys."""
    first = right.groupBy(*keys).agg(F.min_by(take, order).alias(take))
    return rows.join(first, keys, "left")


def id_dictionary(*columns: tuple[DataFrame, str]) -> DataFrame:
    """old and new of every id that occurs: UUIDs stay, others get one that follows from them."""
    every = None
    for df, c in columns:
        d = df.select(F.col(c).cast("string").alias("old")).where(F.col("old").isNotNull())
        every = d if every is None else every.unionByName(d)
    return every.distinct().select("old", F.when(is_uuid(F.col("old")), F.col("old")).otherwise(uuid_of(F.col("old"))).alias("new"))


def rewritten(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """rows with key replaced by the dictionary."""
    d = ids.select(F.col("old").alias("__old"), F.col("new").alias("__new"))
    return rows.join(d, F.col(key).cast("string") == F.col("__old"), "left").withColumn(key, F.coalesce("__new", F.col(key).cast("string"))).select(rows.columns)


def folded(images: DataFrame, flat: DataFrame) -> DataFrame:
    """Images with their flat channels, by index; images that only channels know are there with sides of 1."""
    lists = flat.groupBy("image").agg(F.sort_array(F.collect_list(F.struct("index", "id"))).alias("channels"))
    return images.join(lists, "image", "full").select("image", F.coalesce("width", F.lit(1)).alias("width"), F.coalesce("height", F.lit(1)).alias("height"), F.coalesce(F.transform("channels", lambda c: c["id"]), F.expr("cast(array() as array<bigint>)")).alias("channels"))


def merged_shapes(shapes: DataFrame, old_ids: DataFrame, used_elsewhere: DataFrame, fresh: DataFrame) -> DataFrame:
    """Shapes after a waypoint is saved: those that only it used go, fresh ones replace or join the others."""
    only = old_ids.join(used_elsewhere, "id", "left_anti").join(fresh.select("id"), "id", "left_anti")
    kept = shapes.join(only, "id", "left_anti").join(fresh.select("id"), "id", "left_anti")
    return kept.unionByName(fresh)


def without_image(rows: DataFrame, channels: DataFrame, image) -> DataFrame:
    """Group rows after an image goes: those of its channels go, and so do groups that it leaves empty."""
    gone = channels.where(F.col("image") == image).select(F.col("id").alias("channel"))
    return rows.join(gone, "channel", "left_anti")


def clamped_index(index: Column, size: Column) -> Column:
    """An index inside a list of the size; -1 for an empty one."""
    return F.when(size == 0, -1).otherwise(F.greatest(F.lit(0), F.least(index, size - 1)))
