"""Queries on image files that Spark writes from the embeddings: a mosaic of 8 by 8 planes, 25 side by side, in two levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom.sources import tiff
from rasterloom.sources.written import shared_folder

from .raster import table

QUERIES: dict = {}
SQL: dict = {}

ACROSS, TILE = 25, 32


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def mosaic(spark, sf_dir):
    """page, level, x, y and v of the pixels; the second level has every second one."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "f"))
    x = (F.col("vec_id") % ACROSS * 8 + F.col("i") % 8).cast("int")
    y = (F.floor(F.col("vec_id") / ACROSS) * 8 + F.floor(F.col("i") / 8)).cast("int")
    base = e.select(F.lit(0).alias("page"), F.lit(0).alias("level"), x.alias("x"), y.alias("y"), F.floor((F.col("f").cast("double") + 4) * 1000).alias("v"))
    half = lambda c: F.floor(F.col(c) / 2).cast("int").alias(c)
    return base.unionByName(base.where("x % 2 = 0 AND y % 2 = 0").select("page", F.lit(1).alias("level"), half("x"), half("y"), "v"))


def written_mosaic(spark, sf_dir) -> str:
    p = mosaic(spark, sf_dir)
    path = f"{shared_folder(spark)}.tif"
    top = table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0]
    width, height = ACROSS * 8, (top // ACROSS + 1) * 8
    tiff.write(tiff.encoded(p, TILE, "u2"), path.removeprefix("file:"), [(width, height), (width // 2, height // 2)], 1, TILE, "u2")
    return path


_MOSAIC = f"""(WITH e AS (SELECT vec_id, i - 1 AS i, CAST(floor((CAST(embedding[i] AS DOUBLE) + 4) * 1000) AS BIGINT) AS v FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS i FROM embeddings)),
  b AS (SELECT 0 AS level, vec_id % {ACROSS} * 8 + i % 8 AS x, vec_id // {ACROSS} * 8 + i // 8 AS y, v FROM e)
  SELECT * FROM b UNION ALL SELECT 1, x // 2, y // 2, v FROM b WHERE x % 2 = 0 AND y % 2 = 0)"""


@query(f"SELECT level, CAST(y // {TILE} AS INT) AS tile_y, CAST(x // {TILE} AS INT) AS tile_x, CAST(sum(v) AS DOUBLE) AS total, CAST(sum(v * (x % {TILE} + 7 * (y % {TILE}))) AS DOUBLE) AS moment FROM {_MOSAIC} GROUP BY ALL")
def k01_k05_tiles_of_one_file(spark, sf_dir):
    """Every tile of the written file, read back: sums of its values, and of its values by their place."""
    tiff.register(spark)
    tiles = spark.read.format("tiles").load(written_mosaic(spark, sf_dir))
    at = lambda i: i % F.col("width") + 7 * F.floor(i / F.col("width"))
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    return tiles.select("level", "tile_y", "tile_x", add("values").alias("total"), add(F.transform("values", lambda v, i: v * at(i))).alias("moment"))


@query(f"SELECT CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(v AS DOUBLE) AS v FROM {_MOSAIC} WHERE level = 0 AND x // {TILE} IN (2, 6) AND y // {TILE} BETWEEN 1 AND 2")
def s06_tile_window(spark, sf_dir):
    """Pixels of a window of tiles, of which the last column is cut at the edge; only those tiles are read."""
    tiff.register(spark)
    tiles = spark.read.format("tiles").load(written_mosaic(spark, sf_dir))
    return tiff.pixels(tiles.where("level = 0 AND tile_x IN (2, 6) AND tile_y >= 1 AND tile_y <= 2")).select("x", "y", "v")


@query(f"SELECT level, CAST(max(x) + 1 AS INT) AS width, CAST(max(y) + 1 AS INT) AS height, count(DISTINCT (x // {TILE}, y // {TILE})) AS tiles FROM {_MOSAIC} GROUP BY level")
def s03_s04_pyramid_levels(spark, sf_dir):
    tiff.register(spark)
    tiles = spark.read.format("tiles").load(written_mosaic(spark, sf_dir))
    return tiles.groupBy("level").agg(F.max(F.col("left") + F.col("width")).alias("width"), F.max(F.col("top") + F.col("height")).alias("height"), F.count("*").alias("tiles"))
