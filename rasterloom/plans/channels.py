"""Queries on channels, groups and layers: nations are channels of region images, customers are group rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom.operators import channels as H

from .raster import table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def channels(spark, sf_dir):
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        k.cast("long").alias("id"), F.col("n_regionkey").alias("image"), (k / 5).cast("int").alias("index"), k.alias("pos"), F.col("n_name").alias("name"),
        F.when(k % 6 == 5, "mask").when(k % 6 == 4, "field").alias("kind"), F.when(k % 7 == 3, False).when(k % 7 == 4, True).alias("on"),
        F.when(k % 8 == 1, "Float32").otherwise("Uint16").alias("dtype"), F.lit(1).alias("samples"), F.when(k % 9 == 2, "outline").alias("style"),
    )


CHANNELS = """SELECT CAST(n_nationkey AS BIGINT) AS id, n_regionkey AS image, CAST(n_nationkey // 5 AS INT) AS index, n_nationkey AS pos, n_name AS name,
  CASE WHEN n_nationkey % 6 = 5 THEN 'mask' WHEN n_nationkey % 6 = 4 THEN 'field' END AS kind, CASE WHEN n_nationkey % 7 = 3 THEN false WHEN n_nationkey % 7 = 4 THEN true END AS "on",
  CASE WHEN n_nationkey % 8 = 1 THEN 'Float32' ELSE 'Uint16' END AS dtype, 1 AS samples, CASE WHEN n_nationkey % 9 = 2 THEN 'outline' END AS style FROM nation"""


def rows(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("row"), F.col("c_mktsegment").alias("group"), k.alias("pos"), (F.col("c_nationkey") % 20).cast("long").alias("channel"), F.when(k % 5 == 0, False).alias("on"),
        F.when(k % 11 == 0, "full").when(k % 11 == 1, "outline").alias("style"), F.lower(F.lpad(F.hex(k * 7919 % 16777216), 6, "0")).alias("colour"), (k % 100).alias("lower"), (k % 100 + 500).alias("upper"),
    )


ROWS = """SELECT c_custkey AS row, c_mktsegment AS "group", c_custkey AS pos, CAST(c_nationkey % 20 AS BIGINT) AS channel, CASE WHEN c_custkey % 5 = 0 THEN false END AS "on",
  CASE WHEN c_custkey % 11 = 0 THEN 'full' WHEN c_custkey % 11 = 1 THEN 'outline' END AS style, printf('%06x', CAST(c_custkey * 7919 % 16777216 AS BIGINT)) AS colour, c_custkey % 100 AS lower, c_custkey % 100 + 500 AS upper FROM customer"""

ACTIVE = "MACHINERY"


@query(f"SELECT image, CAST(row_number() OVER (PARTITION BY image ORDER BY index, id) - 1 AS INT) AS at, id, CASE WHEN kind = 'mask' THEN 'mask' ELSE 'channel' END AS kind FROM ({CHANNELS})")
def p01_p03_flat_channels(spark, sf_dir):
    """Nested images, flattened again in order."""
    c = channels(spark, sf_dir)
    nested = c.groupBy("image").agg(F.sort_array(F.collect_list(F.struct("index", "id", "kind"))).alias("channels"))
    return nested.select("image", F.posexplode("channels").alias("at", "c")).select("image", "at", F.col("c.id").alias("id"), H.effective_kind(F.col("c.kind")).alias("kind"))


@query(f"SELECT id, coalesce(\"on\", true) AS visible FROM ({CHANNELS})")
def p12_visible_by_map(spark, sf_dir):
    c = channels(spark, sf_dir)
    flags = F.map_from_arrays(F.array(*(F.lit(k) for k in range(25) if k % 7 in (3, 4))), F.array(*(F.lit(k % 7 == 4) for k in range(25) if k % 7 in (3, 4))))
    return c.select("id", H.visible(flags, F.col("id").cast("int")).alias("visible"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN 0 WHEN n_nationkey % 5 = 1 THEN 1 WHEN n_nationkey % 5 = 2 THEN 2 WHEN n_nationkey % 5 = 3 THEN 0 END AS slot FROM nation")
def p06_planar_slots(spark, sf_dir):
    k = F.col("n_nationkey") % 5
    name = F.when(k == 0, F.concat("n_name", F.lit("_r"))).when(k == 1, F.concat("n_name", F.lit("-G"))).when(k == 2, F.concat("n_name", F.lit("[b]"))).when(k == 3, "R").otherwise(F.concat("n_name", F.lit("r")))
    return table(spark, sf_dir, "nation").select("n_nationkey", H.planar_slot(name).alias("slot"))


@query(f"SELECT image, count(*) = 3 AND bool_and(dtype LIKE 'Uint%') AS rgb FROM ({CHANNELS}) WHERE image <> 0 OR index < 3 GROUP BY image")
def p05_rgb_display(spark, sf_dir):
    return H.rgb_display(channels(spark, sf_dir).where("image <> 0 OR index < 3"))


@query(f"SELECT image, id, CASE WHEN image = 0 THEN CAST(row_number() OVER (PARTITION BY image ORDER BY index) - 1 AS INT) END AS slot FROM ({CHANNELS}) WHERE image <> 0 OR index < 3")
def w07_planar_ranks(spark, sf_dir):
    return H.planar_ranks(channels(spark, sf_dir).where("image <> 0 OR index < 3")).select("image", "id", F.col("slot").cast("int").alias("slot"))


@query(f"SELECT id, CASE WHEN id % 4 = 1 THEN 'aaaaaa' WHEN id % 4 = 2 THEN 'bbbbbb' WHEN image = 2 THEN 'ff00ff' ELSE ['111111', '222222', '333333', '444444'][index % 4 + 1] END AS colour, CAST(CASE WHEN id % 3 = 0 THEN 100 WHEN id % 3 = 1 THEN 7 ELSE 32 END AS INT) AS lower, CAST(CASE WHEN id % 3 = 0 THEN 200 WHEN id % 3 = 1 THEN 70 ELSE 16384 END AS INT) AS upper FROM ({CHANNELS})")
def p08_p10_effective_styles(spark, sf_dir):
    k = F.col("id")
    fit, own = k % 3 == 0, k % 3 < 2
    lo, hi = H.effective_limits(F.when(own, 7), F.when(own, 70), F.when(fit, 100), F.when(fit, 200))
    colour = H.effective_colour(F.when(k % 4 == 1, "aaaaaa"), F.when(k % 4 == 2, "bbbbbb"), F.col("image") == 2, F.col("index"), ["111111", "222222", "333333", "444444"])
    return channels(spark, sf_dir).select("id", colour.alias("colour"), lo.alias("lower"), hi.alias("upper"))


@query(f"SELECT image, CASE WHEN bool_or(k = 'mask') AND bool_or(k <> 'mask') THEN 'mixed' WHEN bool_or(k = 'mask') THEN 'segmentation' ELSE 'intensity' END AS role FROM (SELECT image, coalesce(kind, 'channel') AS k FROM ({CHANNELS})) GROUP BY image")
def a10_image_roles(spark, sf_dir):
    return H.image_role(channels(spark, sf_dir).withColumn("kind", H.effective_kind(F.col("kind"))))


@query(f"""WITH c AS (SELECT *, coalesce(kind, 'channel') <> 'mask' AS intensity FROM ({CHANNELS})),
  f AS (SELECT bool_or("on" = false) AS hidden FROM c),
  k AS (SELECT c.*, hidden AND "on" IS NOT NULL AS keep FROM c, f),
  s AS (SELECT *, coalesce(sum(CAST(CASE WHEN keep THEN intensity AND "on" ELSE intensity END AS INT)) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM k)
  SELECT 1 AS document, id, CASE WHEN keep THEN "on" WHEN NOT intensity THEN true ELSE seen < 4 END AS visible FROM s""")
def w01_default_visibility(spark, sf_dir):
    c = channels(spark, sf_dir).withColumn("kind", H.effective_kind(F.col("kind"))).withColumn("document", F.lit(1)).withColumnRenamed("on", "prev")
    return H.default_visibility(c)


@query(f"""WITH c AS ({CHANNELS}), r AS ({ROWS})
  SELECT 0 AS branch, r.pos, r.channel, r.row FROM r JOIN c ON c.id = r.channel WHERE r."group" = '{ACTIVE}' AND coalesce(r."on", true)
  UNION ALL SELECT 1, CAST(pos AS BIGINT), id, NULL FROM c WHERE id NOT IN (SELECT channel FROM r) AND coalesce("on", true)""")
def j02_composition(spark, sf_dir):
    return H.composition(channels(spark, sf_dir), rows(spark, sf_dir), ACTIVE)


@query(f"SELECT 0 AS branch, CAST(pos AS BIGINT) AS pos, id AS channel, CAST(NULL AS BIGINT) AS row FROM ({CHANNELS}) ORDER BY pos LIMIT 4")
def j02_composition_without_map(spark, sf_dir):
    return H.composition(channels(spark, sf_dir), rows(spark, sf_dir), None, has_map=False)


@query(f"SELECT id FROM ({CHANNELS}) WHERE id IN (SELECT channel FROM ({ROWS}))")
def j03_channels_in_groups(spark, sf_dir):
    return channels(spark, sf_dir).join(rows(spark, sf_dir).select(F.col("channel").alias("id")).distinct(), "id", "left_semi").select("id")


@query(f"SELECT id FROM ({CHANNELS}) WHERE id NOT IN (SELECT channel FROM ({ROWS})) AND coalesce(\"on\", true)")
def p14_ungrouped_visible(spark, sf_dir):
    c = channels(spark, sf_dir).join(rows(spark, sf_dir).select(F.col("channel").alias("id")).distinct(), "id", "left_anti")
    return c.where(F.coalesce("on", F.lit(True))).select("id")


@query(f"SELECT id FROM ({CHANNELS}) WHERE id IN (SELECT channel FROM ({ROWS}) WHERE \"group\" = '{ACTIVE}')")
def p13_displayed_by_active_group(spark, sf_dir):
    r = rows(spark, sf_dir).where(F.col("group") == ACTIVE)
    return channels(spark, sf_dir).join(r.select(F.col("channel").alias("id")).distinct(), "id", "left_semi").select("id")


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY ("group" <> '{ACTIVE}'), dense, pos) AS n FROM (SELECT *, dense_rank() OVER (ORDER BY "group") AS dense FROM ({ROWS})) WHERE style IS NOT NULL)
  SELECT c.id, coalesce(r.style, c.style) AS style FROM ({CHANNELS}) c LEFT JOIN r ON r.channel = c.id AND r.n = 1""")
def p11_mask_styles(spark, sf_dir):
    r = rows(spark, sf_dir).withColumn("gpos", F.col("group"))
    return H.effective_mask_style(r, channels(spark, sf_dir), ACTIVE)


@query(f"SELECT r.\"group\", r.pos, r.channel, c.name, r.colour, r.lower, r.upper FROM ({ROWS}) r JOIN ({CHANNELS}) c ON c.id = r.channel")
def j01_p26_legend(spark, sf_dir):
    return H.legend(rows(spark, sf_dir), channels(spark, sf_dir))


@query(f"""WITH c AS ({CHANNELS}), r AS ({ROWS}), o AS (SELECT c.image, 0 AS part, r.pos, c.name FROM r JOIN c ON c.id = r.channel WHERE r."group" = '{ACTIVE}'),
  v AS (SELECT image, 2 AS part, CAST(pos AS BIGINT) AS pos, name FROM c WHERE kind = 'mask' AND id NOT IN (SELECT channel FROM r))
  SELECT * FROM o UNION ALL SELECT DISTINCT image, 1, CAST(0 AS BIGINT), '-' FROM o WHERE image IN (SELECT image FROM v) UNION ALL SELECT * FROM v""")
def j24_legend_sections(spark, sf_dir):
    return H.legend_sections(rows(spark, sf_dir), channels(spark, sf_dir), ACTIVE)


@query("SELECT p_partkey, CASE WHEN n > 1 THEN p_name || ' (' || n || ')' ELSE p_name END AS label FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) AS n FROM part)")
def w02_numbered_labels(spark, sf_dir):
    return H.numbered_labels(table(spark, sf_dir, "part"), "p_brand", "p_name", ["p_partkey"]).select("p_partkey", "label")


@query("SELECT o_custkey, o_orderstatus, min(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL")
def w03_keep_first(spark, sf_dir):
    return H.first_of(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus"], ["o_orderkey"]).select("o_custkey", "o_orderstatus", "o_orderkey")


@query(f"SELECT row, CAST((row_number() OVER (PARTITION BY \"group\" ORDER BY pos) - 1) % 4 AS INT) AS slot FROM ({ROWS})")
def w06_cycled_palette(spark, sf_dir):
    return H.cycled(rows(spark, sf_dir), "group", ["pos"]).select("row", F.col("slot").cast("int").alias("slot"))


@query(f"SELECT id, CASE WHEN coalesce(kind, '') <> 'mask' THEN CAST((count(*) FILTER (coalesce(kind, '') <> 'mask') OVER (PARTITION BY image ORDER BY index, id) - 1) % 4 AS BIGINT) END AS seed FROM ({CHANNELS})")
def w11_p35_running_seed(spark, sf_dir):
    c = channels(spark, sf_dir).withColumn("kind", H.effective_kind(F.col("kind")))
    return H.seeded(c).select("id", F.col("seed").cast("long").alias("seed"))


@query(f"SELECT a.image, a.id, b.index, CASE WHEN b.id % 3 = 0 THEN a.name ELSE b.name || '!' END AS name FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY index) k FROM ({CHANNELS})) a JOIN (SELECT *, row_number() OVER (PARTITION BY image ORDER BY index) k FROM ({CHANNELS})) b USING (image, k)")
def j08_rebound_channels(spark, sf_dir):
    c = channels(spark, sf_dir)
    new = c.select("image", "index", F.when(F.col("id") % 3 != 0, F.concat("name", F.lit("!"))).alias("name"))
    return H.rebound(c.select("image", "index", "id", "name"), new)


@query(f"SELECT image, count(*) AS old_n, count(*) FILTER (id % 10 <> 7) AS new_n FROM ({CHANNELS}) GROUP BY image HAVING bool_or(id % 10 = 7)")
def j08_rebind_errors(spark, sf_dir):
    c = channels(spark, sf_dir)
    return H.rebind_errors(c, c.where("id % 10 <> 7"))


@query(f"SELECT \"group\", bool_and(coalesce(\"on\", true)) AS all_on, bool_or(coalesce(\"on\", true)) AS any_on, NOT bool_or(coalesce(\"on\", true)) AS hidden FROM ({ROWS}) GROUP BY \"group\"")
def a17_a18_master_visibility(spark, sf_dir):
    return H.master_visibility(rows(spark, sf_dir), "group", "on")


@query("SELECT p_partkey, CAST(CASE WHEN p_partkey = 3 THEN 10 WHEN p_partkey BETWEEN 4 AND 10 THEN p_partkey - 1 ELSE p_partkey END AS BIGINT) AS there, CAST(CASE WHEN p_partkey = 10 THEN 3 WHEN p_partkey BETWEEN 3 AND 9 THEN p_partkey + 1 ELSE p_partkey END AS BIGINT) AS back FROM part")
def o09_reordered(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").alias("pos"))
    return H.reordered(p, 3, 10).withColumnRenamed("pos", "there").join(H.reordered(p, 10, 3).withColumnRenamed("pos", "back"), "p_partkey")


@query("SELECT p_partkey, CAST(CASE WHEN p_partkey > 5 THEN p_partkey - 1 ELSE p_partkey END AS BIGINT) AS pos FROM part WHERE p_partkey <> 5")
def o10_removed_at(spark, sf_dir):
    return H.removed_at(table(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").alias("pos")), 5)


@query(f"SELECT id, name FROM (SELECT *, row_number() OVER (ORDER BY pos) AS n FROM ({CHANNELS}) WHERE image = 1 AND samples <> 3 AND coalesce(kind, '') <> 'mask') WHERE n <= 4")
def o04_import_palette_channels(spark, sf_dir):
    c = channels(spark, sf_dir).where("image = 1 AND samples <> 3 AND coalesce(kind, '') <> 'mask'")
    return c.orderBy("pos").limit(H.FIRST_VISIBLE).select("id", "name")


@query(f"SELECT row, channel, pos FROM (SELECT *, row_number() OVER (PARTITION BY \"group\" ORDER BY pos) AS n FROM ({ROWS}) WHERE coalesce(\"on\", true)) WHERE n <= 6")
def o03_p32_layer_settings(spark, sf_dir):
    from pyspark.sql import Window as W

    r = rows(spark, sf_dir).where(F.coalesce("on", F.lit(True)))
    return r.withColumn("n", F.row_number().over(W.partitionBy("group").orderBy("pos"))).where(F.col("n") <= H.MOST_LAYERS).select("row", "channel", "pos")


@query(f"SELECT row, \"group\", CAST(row_number() OVER (PARTITION BY \"group\" ORDER BY NOT coalesce(\"on\", true), pos) AS INT) AS rank FROM ({ROWS})")
def o07_m15_shown_first(spark, sf_dir):
    from pyspark.sql import Window as W

    w = W.partitionBy("group").orderBy(F.coalesce("on", F.lit(True)).desc(), "pos")
    return rows(spark, sf_dir).select("row", "group", F.row_number().over(w).alias("rank"))


@query(f"SELECT \"group\", list(name ORDER BY pos) AS names FROM (SELECT r.\"group\", r.pos, c.name FROM ({ROWS}) r JOIN ({CHANNELS}) c ON c.id = r.channel) GROUP BY \"group\"")
def m14_group_name_lists(spark, sf_dir):
    l = H.legend(rows(spark, sf_dir), channels(spark, sf_dir))  # noqa: E741
    return l.groupBy("group").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("names"))


@query(f"SELECT channel, arg_min(lower, (\"group\", pos)) AS lower, arg_min(upper, (\"group\", pos)) AS upper FROM ({ROWS}) GROUP BY channel")
def j25_first_group_contrast(spark, sf_dir):
    first = F.struct("group", "pos")
    return rows(spark, sf_dir).groupBy("channel").agg(F.min_by("lower", first).alias("lower"), F.min_by("upper", first).alias("upper"))


@query(f"SELECT id FROM ({CHANNELS}) WHERE kind = 'mask' AND id IN (SELECT channel FROM ({ROWS}))")
def j26_mask_channels_refused(spark, sf_dir):
    return channels(spark, sf_dir).where("kind = 'mask'").join(rows(spark, sf_dir).select(F.col("channel").alias("id")).distinct(), "id", "left_semi").select("id")


@query(f"SELECT row, CASE WHEN channel = 3 THEN 'full' ELSE style END AS style FROM ({ROWS})")
def m13_propagated_style(spark, sf_dir):
    return rows(spark, sf_dir).select("row", F.when(F.col("channel") == 3, "full").otherwise(F.col("style")).alias("style"))


@query(f"SELECT id, CASE WHEN trim(n) = '' OR trim(n) = name THEN name ELSE trim(n) END AS name FROM (SELECT *, CASE id % 3 WHEN 0 THEN '  ' WHEN 1 THEN ' ' || name || ' ' ELSE ' New ' || id END AS n FROM ({CHANNELS}))")
def m16_renamed(spark, sf_dir):
    k = F.col("id") % 3
    new = F.trim(F.when(k == 0, "  ").when(k == 1, F.concat(F.lit(" "), "name", F.lit(" "))).otherwise(F.concat(F.lit(" New "), F.col("id").cast("string"))))
    return channels(spark, sf_dir).select("id", F.when((new == "") | (new == F.col("name")), F.col("name")).otherwise(new).alias("name"))


@query(f"SELECT c.id, c.image FROM ({CHANNELS}) c WHERE c.kind = 'mask' AND (coalesce(c.\"on\", true) OR EXISTS (SELECT 1 FROM ({ROWS}) r WHERE r.channel = c.id AND r.\"group\" = '{ACTIVE}' AND coalesce(r.\"on\", true)))")
def p15_m24_rendered_masks(spark, sf_dir):
    r = rows(spark, sf_dir).where((F.col("group") == ACTIVE) & F.coalesce("on", F.lit(True))).select(F.col("channel").alias("id")).distinct().withColumn("by_row", F.lit(True))
    c = channels(spark, sf_dir).where("kind = 'mask'").join(r, "id", "left")
    return c.where(F.coalesce("on", F.lit(True)) | F.coalesce("by_row", F.lit(False))).select("id", "image")
