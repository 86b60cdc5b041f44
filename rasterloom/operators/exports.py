"""Export plans: tiles, folders, names and metadata text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rasterloom.sources.written import written


def tile_jobs(images: DataFrame, folders: DataFrame, tile: int, levels: int) -> DataFrame:
    """image, folder, level, x and y of every tile to write, each folder once; level 0 is the finest.

    The order of writing is coarsest first: sort by level descending, then x, y and folder."""
    at = images.select("image", "width", "height", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level"))
    count = lambda side: F.ceil(F.col(side) / (F.lit(float(tile)) * F.pow(F.lit(2.0), F.col("level"))))
    at = at.withColumn("nx", count("width")).withColumn("ny", count("height"))
    t = at.withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nx") - 1))).withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ny") - 1)))
    return t.select("image", "level", "x", "y").join(folders.select("image", "folder").distinct(), "image")


def tile_count(levels: DataFrame) -> DataFrame:
    """image and how many tiles all its levels and channels have."""
    return levels.groupBy("image").agg(F.sum(F.ceil(F.col("width") / F.col("tile")) * F.ceil(F.col("height") / F.col("tile")) * F.col("channels")).alias("tiles"))


def folder_of(channel: Column, lower: Column, upper: Column) -> Column:
    """Folder of a channel at given limits: the digest of its canonical JSON."""
    return F.sha2(F.to_json(F.struct(channel.alias("channelId"), lower.alias("lowerLimit"), upper.alias("upperLimit"))), 256)


def missing_folders(needed: DataFrame, there: DataFrame) -> DataFrame:
    return needed.select("folder").distinct().join(there.select(F.lower("folder").alias("folder")).distinct(), "folder", "left_anti")


def complete_folder_map(rows: DataFrame, there: DataFrame, active: str) -> DataFrame:
    """The group of each image whose folders are all there: the active one first, else the first by name."""
    ok = rows.join(there.select("folder").distinct().withColumn("__there", F.lit(1)), "folder", "left")
    full = ok.groupBy("image", "group").agg((F.count("*") == F.count("__there")).alias("full")).where("full")
    n = F.row_number().over(W.partitionBy("image").orderBy((F.col("group") == active).desc(), "group"))
    return full.withColumn("__n", n).where("__n = 1").select("image", "group")


def remapped(channels: DataFrame) -> DataFrame:
    """index 0..k-1 of the exported channels of each image."""
    return channels.withColumn("index", F.row_number().over(W.partitionBy("image").orderBy("index", "id")) - 1)


def escaped_xml(c: Column) -> Column:
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(plain), F.lit(safe))
    return c


def channel_xml(channels: DataFrame) -> DataFrame:
    """image and its channel elements in order of index."""
    one = F.concat(F.lit('<Channel ID="Channel:0:'), F.col("index").cast("string"), F.lit('" Name="'), escaped_xml(F.col("name")), F.lit('" SamplesPerPixel="1"/>'))
    lists = channels.groupBy("image").agg(F.sort_array(F.collect_list(F.struct("index", one.alias("x")))).alias("l"))
    return lists.select("image", F.array_join(F.transform("l", lambda x: x["x"]), "").alias("xml"))


def file_stem(basename: Column, fallback: Column) -> Column:
    """A basename without its TIFF endings and unsafe characters."""
    raw = F.coalesce(F.nullif(F.regexp_replace(basename, r"(?i)\.(ome\.)?(tif|tiff)$", ""), F.lit("")), F.nullif(fallback, F.lit("")), F.lit("image"))
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(raw, r"[^A-Za-z0-9_.-]+", "_"), "^_+|_+$", ""), F.lit("")), F.lit("image"))


def mask_label(name: Column) -> Column:
    """A mask's name without its TIFF endings; 'Mask' for a blank one."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(name, r"(?i)\.ome\.tiff?$", ""), r"(?i)\.tiff?$", ""))
    return F.when(F.coalesce(bare, F.lit("")) == "", "Mask").otherwise(bare)


def unique_names(rows: DataFrame, group: str, order: list[str], stem: str, first: str = "{}.ome.tif", later: str = "{}_{}.ome.tif", fold: bool = True) -> DataFrame:
    """name: the stem in a form that no earlier row of its group has; greedy in order.

    The n-th row of a stem gets its n-th form, and forms of two stems can only be equal if the stems are once the
    numbers that later forms end in are taken off. So rows are numbered by group and stem, in blocks of a sorted table,
    and what is left to settle one after the other are the roots of which a group has more than one stem."""
    columns = rows.columns
    key = F.lower(stem) if fold else F.col(stem)
    tail = re.escape(later.removesuffix(first.removeprefix("{}"))).replace(re.escape("{}"), "{}").removeprefix("{}").format(r"\d+")
    keyed = rows.withColumns({"key_": key, "root_": F.regexp_replace(key, f"({tail})+$", "")})
    sorts = keyed.select(group, "key_", "root_").distinct().groupBy(group, "root_").agg((F.count("*") > 1).alias("mixed_"))
    known = keyed.join(sorts, [group, "root_"], "left")
    clear = numbered(known.where("mixed_ is null or not mixed_"), [group, "key_"], order)
    parts = later.split("{}")
    name = F.when(F.col("n_") == 1, F.concat(F.lit(first.split("{}")[0]), F.col(stem), F.lit(first.split("{}")[1]))).otherwise(F.concat(F.lit(parts[0]), F.col(stem), F.lit(parts[1]), F.col("n_").cast("string"), F.lit(parts[2])))
    settled = clear.withColumn("name", name).select(*columns, "name")
    return settled.unionByName(_greedy(known.where("mixed_").select(*columns, "root_"), group, order, stem, first, later, fold).select(*columns, "name"))


def numbered(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """rows with n_, their number from 1 among those with the same by, in order.

    The table is sorted into ranges, which split a frequent key too; each range is numbered by itself, and the rows of
    a key in the ranges before are added."""
    ranged = written(rows.repartitionByRange(*by, *order).withColumn("range_", F.spark_partition_id()))
    counts = ranged.groupBy(*by, "range_").agg(F.count("*").alias("rows_"))
    before = F.sum("rows_").over(W.partitionBy(*by).orderBy("range_").rowsBetween(W.unboundedPreceding, -1))  # a row for each range
    bases = counts.select(*(F.col(c).alias(f"{c}_by") for c in by), F.col("range_").alias("at_"), F.coalesce(before, F.lit(0)).alias("base_"))
    own = ranged.withColumn("own_", F.row_number().over(W.partitionBy("range_", *by).orderBy(*order)))
    same = [F.col(c).eqNullSafe(F.col(f"{c}_by")) for c in by]
    return own.join(bases, [*same, F.col("range_") == F.col("at_")]).withColumn("n_", F.col("own_") + F.col("base_"))


def _greedy(rows: DataFrame, group: str, order: list[str], stem: str, first: str, later: str, fold: bool) -> DataFrame:
    """Names of rows whose stems of one group and root_ may clash: they come sorted and stream through, and what is kept
    of a root is the set of its names, and of each stem the last number given."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, used, last = None, set(), {}
        for df in batches:
            names = []
            for g, r, s in zip(df[group], df["root_"], df[stem]):
                if (g, r) != now:
                    now, used, last = (g, r), set(), {}
                name, n = first.format(s), last.get(s, 1) + 1
                while (name.lower() if fold else name) in used:
                    name, last[s], n = later.format(s, n), n, n + 1
                used.add(name.lower() if fold else name)
                names.append(name)
            yield df.assign(name=names)

    schema = rows.withColumn("name", F.lit("")).schema
    return rows.repartition(group, "root_").sortWithinPartitions(group, "root_", *order).mapInPandas(run, schema)


def roi_label(name: Column, description: Column, roi: Column) -> Column:
    """A region's name, else the first line of its description, cut at 120, else what follows its id's last colon."""
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    line = bare(F.split(bare(description), "\n")[0])
    short = F.when(F.length(line) > 120, F.concat(F.substring(line, 1, 117), F.lit("…"))).otherwise(line)
    own = bare(roi)
    tail = F.element_at(F.split(own, ":"), -1)
    return F.coalesce(F.nullif(bare(name), F.lit("")), F.nullif(short, F.lit("")), F.when(own.contains(":"), F.nullif(tail, F.lit(""))), F.nullif(own, F.lit("")), F.lit("ROI"))


def eta_seconds(done: Column, total: Column, elapsed: Column) -> Column:
    """Time left at the mean pace; null before the first is done."""
    return F.when(done > 0, (total - done) * elapsed / done)


def minutes_left(seconds: Column) -> Column:
    m = F.ceil(seconds / 60.0)
    return F.when(seconds.isNull(), "estimating").when(m <= 1, "about a minute left").otherwise(F.concat(m.cast("string"), F.lit(" minutes left")))


def stroke_points(points: DataFrame, radius: float) -> DataFrame:
    """Points of brush strokes (stroke, t, x, y) with more between them, at most half a radius or a pixel apart."""
    w = W.partitionBy("stroke").orderBy("t")
    p = points.withColumn("px", F.lag("x").over(w)).withColumn("py", F.lag("y").over(w))
    step = max(1.0, radius / 2)
    n = F.greatest(F.lit(1).cast("long"), F.ceil(F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py")) / step))
    p = p.withColumn("n", F.coalesce(n, F.lit(1))).withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    between = lambda c: F.coalesce(F.col(f"p{c}") + (F.col(c) - F.col(f"p{c}")) * F.col("k") / F.col("n"), F.col(c))
    return p.select("stroke", "t", "k", between("x").alias("x"), between("y").alias("y"))
