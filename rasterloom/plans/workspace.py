"""Queries on what an editor does with parts of a document."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom.functions import geometry as G
from rasterloom.operators import workspace as W

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


def _text(prefix: str, c):
    return F.concat(F.lit(prefix), c.cast("string"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 < 2 THEN 'cube-root' ELSE 'contrast' END AS transfer, CASE WHEN c_custkey % 4 < 2 THEN 0 ELSE c_nationkey END AS lower, CASE WHEN c_custkey % 4 < 2 THEN 65535 ELSE c_nationkey + 100 END AS upper FROM customer""")
def p22_f21_transfers(spark, sf_dir):
    source = F.get(F.array(*(F.lit(x) for x in ("jpeg-pyramid-cube-root", "jpeg-ome-tiff", "jpeg-pyramid", None))), (F.col("c_custkey") % 4).cast("int"))
    low, high = W.folder_limits(F.col("transfer"), F.col("c_nationkey"), F.col("c_nationkey") + 100)
    return table(spark, sf_dir, "customer").withColumn("transfer", W.transfer_of(source)).select("c_custkey", "transfer", low.alias("lower"), high.alias("upper"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'segmentation' WHEN 1 THEN 'mixed' ELSE 'intensity' END AS role, (ARRAY['ff0000', '00ff00', '0000ff', NULL])[CAST(p_partkey % 4 AS INT) + 1] AS colour, CAST(p_size * 2 ** (p_partkey % 5) AS DOUBLE) AS scale,
  p_size || CASE WHEN p_size = 1 THEN ' shape' ELSE ' shapes' END AS label, CASE WHEN p_partkey % 2 = 0 THEN 'story:' || p_name || ':image:' || p_size ELSE 'image:' || p_size END AS key, p_partkey % 5 || '_' || p_size || '_7.jpg' AS file, CASE WHEN p_size = 7 THEN 1.5 ELSE p_retailprice END AS shown FROM part""")
def p04_p07_f18_p27_f82_p31_small(spark, sf_dir):
    """Roles, planar colours, tile scales, labels, keys, file names and previewed values."""
    k = F.col("p_partkey")
    role = W.content_role(F.when(k % 3 == 0, "segmentation").when(k % 3 == 1, "other").otherwise("intensity"), F.lit("mixed"))
    key = W.handle_key(F.when(k % 2 == 0, F.col("p_name")).otherwise(""), F.col("p_size").cast("string"))
    shown = W.previewed(F.col("p_retailprice"), F.lit(7), F.col("p_size"), F.lit(1.5))
    return table(spark, sf_dir, "part").select(
        "p_partkey", role.alias("role"), W.planar_colour((k % 4).cast("int")).alias("colour"), W.tile_scale(F.col("p_size"), -(k % 5)).alias("scale"), W.shape_label(F.col("p_size")).alias("label"), key.alias("key"), W.tile_file(-(k % 5), F.col("p_size"), F.lit(7)).alias("file"), shown.alias("shown"),
    )


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN p_size - 80 / 2 ** (p_partkey % 3 + 1) END AS x0, CASE WHEN p_partkey % 3 > 0 THEN 5 + 60 / 2 ** (p_partkey % 3 + 1) END AS y1, 4 AS corners, CAST(p_size AS DOUBLE) AS tip FROM part""")
def f44_f51_views_and_arrows(spark, sf_dir):
    k = F.col("p_partkey") % 3
    zoom = F.when(k > 0, F.array(k.cast("double"), F.lit(9.0))).otherwise(F.expr("cast(array() as array<double>)"))
    b, ring = W.snapshot_bounds(zoom, F.col("p_size"), F.lit(5), F.lit(80), F.lit(60)), W.arrow_ring(F.col("p_size"), F.lit(1))
    return table(spark, sf_dir, "part").select("p_partkey", b["x0"].alias("x0"), b["y1"].alias("y1"), F.size(ring).alias("corners"), F.get(ring, 3)["x"].alias("tip"))


@query("""SELECT p_partkey, CAST(k AS INT) AS pos, (k * p_size * 4 - 100) / 2 + 10 AS x, (k * 4 - 0) / 2.0 + 20 AS y FROM part, range(3) t(k) WHERE p_size % 4 > 0""")
def f75_mask_polygons(spark, sf_dir):
    """Corners of polygons found in a small mask, in the image; two corners are no polygon."""
    n = F.when(F.col("p_size") % 4 > 0, 3).otherwise(2)
    ring = F.transform(F.sequence(F.lit(0), n - 1), lambda k: G.point(k * F.col("p_size"), k))
    rect, box = F.struct(F.lit(10.0).alias("x0"), F.lit(20.0).alias("y0")), F.struct(F.lit(2.0).alias("scale"), F.lit(100.0).alias("pad_x"), F.lit(0.0).alias("pad_y"))
    p = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(W.out_of_mask(ring, rect, box)).alias("pos", "p"))
    return p.select("p_partkey", "pos", "p.x", "p.y")


@query("""SELECT o_orderkey, CASE WHEN k % 7 = 0 OR k % 11 = 0 THEN 'noop' WHEN k % 5 = 0 THEN CASE WHEN k % 3 > 0 THEN 'seedStore' ELSE 'noop' END WHEN k % 13 < 6 AND k % 2 = 0 THEN 'setShapes' WHEN k % 17 < 4 THEN 'noop' WHEN k % 4 = 1 THEN 'syncMirror' WHEN k % 3 > 0 AND k % 8 = 3 THEN 'migratePan' ELSE 'noop' END AS action FROM (SELECT o_orderkey, o_orderkey AS k FROM orders)""")
def x05_seed_actions(spark, sf_dir):
    k = F.col("o_orderkey")
    action = W.seed_action(k % 7, k % 5, k % 17 >= 4, F.when(k % 13 < 6, 2).otherwise(0), k % 2, k % 4 == 1, k % 8 == 3, k % 11, F.lit(600), k % 3, F.lit(100))
    return table(spark, sf_dir, "orders").select("o_orderkey", action.alias("action"))


def _groups(spark, sf_dir):
    return table(spark, sf_dir, "nation").where("n_regionkey <> 2").select(F.col("n_regionkey").alias("document"), F.col("n_nationkey").alias("group"), (-F.col("n_nationkey")).alias("pos"))


@query("SELECT r_regionkey AS document, CASE WHEN r_regionkey = 2 THEN NULL WHEN r_regionkey % 2 = 0 THEN (SELECT max(n_nationkey) FROM nation WHERE n_regionkey = r_regionkey) ELSE 99 END AS \"group\" FROM region")
def m07_published_groups(spark, sf_dir):
    active = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("document"), F.lit(99).alias("group"), (F.col("r_regionkey") % 2 == 0).alias("reset"))
    return W.published_group(active, _groups(spark, sf_dir))


def _removal(spark, sf_dir):
    """Customers are group rows of their segment's nation; images are market segments, of which one goes."""
    c = table(spark, sf_dir, "customer")
    rows = c.select((F.col("c_nationkey") % 5).alias("document"), F.col("c_nationkey").alias("group"), F.col("c_custkey").alias("pos"), F.col("c_custkey").alias("channel"))
    channels = c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_nationkey") < 5, "BUILDING").otherwise(F.col("c_mktsegment")).alias("image"))
    active = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("document"), F.when(F.col("r_regionkey") < 3, F.col("r_regionkey")).otherwise(F.col("r_regionkey") + 5).alias("group"))
    return W.after_removal(rows, channels, channels.where("image = 'BUILDING'").select("image"), active)


@query("SELECT c_nationkey % 5 AS document, c_nationkey AS \"group\", c_custkey AS pos, c_custkey AS channel FROM customer WHERE c_nationkey >= 5 AND c_mktsegment <> 'BUILDING'")
def m08_rows_after_removal(spark, sf_dir):
    return _removal(spark, sf_dir)[0]


@query("""WITH l AS (SELECT DISTINCT c_nationkey % 5 AS document, c_nationkey AS g FROM customer WHERE c_nationkey >= 5 AND c_mktsegment <> 'BUILDING'), a AS (SELECT r_regionkey AS document, CASE WHEN r_regionkey < 3 THEN r_regionkey ELSE r_regionkey + 5 END AS g FROM region)
  SELECT document, CASE WHEN (document, g) IN (SELECT (document, g) FROM l) THEN g ELSE (SELECT min(l.g) FROM l WHERE l.document = a.document) END AS "group" FROM a""")
def m08_active_after_removal(spark, sf_dir):
    return _removal(spark, sf_dir)[1]


@query("""WITH d AS (SELECT c_nationkey AS document, c_custkey AS id, (ARRAY['lasso', 'polyline', 'line', 'point', 'rectangle', 'text'])[CAST(c_custkey % 6 AS INT) + 1] AS tool, c_custkey % 4 + 1 AS n FROM customer),
  k AS (SELECT * FROM d WHERE n >= CASE WHEN tool = 'lasso' THEN 3 WHEN tool IN ('polyline', 'line', 'rectangle') THEN 2 ELSE 1 END)
  SELECT document, id, CASE WHEN tool IN ('lasso', 'rectangle') THEN 'polygon' ELSE tool END AS type, CAST(CASE WHEN tool = 'lasso' THEN n + 1 WHEN tool = 'rectangle' THEN 5 ELSE n END AS INT) AS points,
    'Untitled ' || (CASE WHEN document % 3 = 0 THEN 0 ELSE document % 3 END + row_number() OVER (PARTITION BY document ORDER BY id)) AS label FROM k""")
def m18_finished_shapes(spark, sf_dir):
    k = F.col("c_custkey")
    tool = F.get(F.array(*(F.lit(x) for x in ("lasso", "polyline", "line", "point", "rectangle", "text"))), (k % 6).cast("int"))
    points = F.transform(F.sequence(F.lit(0), (k % 4).cast("int")), lambda i: G.point(i, i * i))
    drawn = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("document"), k.alias("id"), tool.alias("tool"), points.alias("points"))
    counts = table(spark, sf_dir, "nation").where("n_nationkey % 3 > 0").select(F.col("n_nationkey").alias("document"), (F.col("n_nationkey") % 3).alias("n"))
    return W.finished(drawn, counts).withColumn("points", F.size("points"))


@query("""WITH m AS (SELECT n_regionkey AS g, n_nationkey AS pos, 's' || n_nationkey AS shape FROM nation WHERE n_regionkey <> 4 AND n_nationkey % 3 <> 1 AND n_regionkey <> 0)
  SELECT g AS "group", pos, shape FROM m UNION ALL SELECT s_nationkey % 5, coalesce((SELECT max(pos) FROM m WHERE g = s_nationkey % 5), -1) + row_number() OVER (PARTITION BY s_nationkey % 5 ORDER BY -s_suppkey), 'x' || s_suppkey FROM supplier WHERE s_nationkey % 5 <> 0""")
def m19_shape_groups(spark, sf_dir):
    members = table(spark, sf_dir, "nation").where("n_regionkey <> 4").select(F.col("n_regionkey").alias("group"), F.col("n_nationkey").alias("pos"), _text("s", F.col("n_nationkey")).alias("shape"))
    added = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 5).alias("group"), (-F.col("s_suppkey")).alias("order"), _text("x", F.col("s_suppkey")).alias("shape"))
    return W.edited_members(members, added, members.where("pos % 3 = 1").select("group", "shape"), members.where("group = 0").select("group").distinct())


@query("""WITH b AS (SELECT o_orderkey % 100 AS w, o_orderkey AS pos, 's' || o_orderkey AS id, o_orderkey % 50 = 7 AS fresh FROM orders WHERE o_orderkey % 100 <> 3),
  n AS (SELECT w, list(id ORDER BY pos) AS ids, bool_or(fresh) AS fresh FROM b GROUP BY w), ws AS (SELECT DISTINCT o_orderkey % 100 AS w FROM orders)
  SELECT w AS waypoint, coalesce(ids, CAST([] AS VARCHAR[])) AS shape_ids FROM ws LEFT JOIN n USING (w) WHERE coalesce(fresh, false) OR w % 10 = 4 OR w = 3""")
def m21_changed_waypoints(spark, sf_dir):
    """Waypoints of a hundred orders' shapes: some stored in another order, one whose shapes are gone, some with another body."""
    o = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 100).alias("waypoint"), F.col("o_orderkey").alias("pos"), _text("s", F.col("o_orderkey")).alias("id"), F.col("o_orderpriority").alias("body"))
    ids = F.transform(F.sort_array(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"])
    stored = o.groupBy("waypoint").agg(F.when(F.col("waypoint") % 10 == 4, F.concat(F.array(F.lit("s0")), ids)).otherwise(ids).alias("shape_ids"))
    shapes = o.select("id", F.when(F.col("pos") % 50 == 7, "other").otherwise(F.col("body")).alias("body"))
    return W.changed_waypoints(stored, o.where("waypoint <> 3"), shapes)


@query("""SELECT o_orderkey AS waypoint, 's' || CASE WHEN o_custkey % 3 = 0 AND o_custkey % 2 = 0 THEN 8 WHEN o_orderkey % 2 = 0 THEN 2 ELSE 4 END AS shape FROM orders WHERE o_orderkey % 9 <> 5""")
def m22_selection_shapes(spark, sf_dir):
    k = F.col("o_orderkey")
    ids = F.when(k % 9 == 5, F.expr("cast(array() as array<string>)")).otherwise(F.array(F.lit("s1"), F.when(k % 2 == 0, "s2").otherwise("s3"), F.lit("s4")))
    preferred = F.when(F.col("o_custkey") % 3 == 0, F.array(F.lit("s9"), F.when(F.col("o_custkey") % 2 == 0, "s8").otherwise("s7")))
    shapes = table(spark, sf_dir, "nation").select(_text("s", F.col("n_nationkey")).alias("id"), (F.col("n_nationkey") % 2 == 0).alias("encloses"))
    return W.selection_shape(table(spark, sf_dir, "orders").select(k.alias("waypoint"), ids.alias("shape_ids"), preferred.alias("preferred")), shapes)


@query("""WITH s AS (SELECT o_custkey AS store, o_orderkey AS id, o_orderdate AS modified FROM orders), d AS (SELECT * FROM s WHERE id % 3 = 0 OR store % 10 = 4), a AS (SELECT store, min(id) AS id FROM s GROUP BY store)
  SELECT store, CASE WHEN id NOT IN (SELECT id FROM d) THEN 'o' || lpad(CAST(id AS VARCHAR), 9, '0') ELSE coalesce('o' || lpad(CAST((SELECT arg_max(s.id, (s.modified, s.id)) FROM s WHERE s.store = a.store AND s.id NOT IN (SELECT id FROM d)) AS VARCHAR), 9, '0'), 'Untitled Story') END AS id FROM a""")
def m23_stories_after_deletion(spark, sf_dir):
    name = F.concat(F.lit("o"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("store"), name.alias("id"), F.col("o_orderdate").alias("modified"), F.col("o_orderkey").alias("k"))
    return W.after_deletion(o.drop("k"), o.where("k % 3 = 0 OR store % 10 = 4").select("store", "id"), o.groupBy("store").agg(F.min("id").alias("id")))


@query("SELECT r_regionkey AS document, 'Waypoint 1' AS name, (SELECT max(n_nationkey) FROM nation WHERE n_regionkey = r_regionkey AND r_regionkey <> 2) AS \"group\" FROM region WHERE r_regionkey NOT IN (1, 4)")
def m27_default_waypoints(spark, sf_dir):
    documents = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("document"))
    return W.default_waypoints(documents, table(spark, sf_dir, "nation").where("n_regionkey IN (1, 4)").select(F.col("n_regionkey").alias("document")), _groups(spark, sf_dir))


@query("""WITH c AS (SELECT c_nationkey AS document, c_custkey AS id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS index FROM customer), l(path, pos, index, need) AS (VALUES ('p0', 0, 1, 3), ('p0', 1, 2, 3), ('p1', 0, 0, 8), ('p1', 1, 7, 8))
  SELECT document, path, pos, 'n' || pos AS name, id AS channel FROM c JOIN l USING (index) WHERE path = 'p' || document % 3 AND document % 4 <> 1 AND (SELECT count(*) FROM c d WHERE d.document = c.document) >= need""")
def j22_m28_looked_up_groups(spark, sf_dir):
    """Groups by a fixed list of paths: unknown paths, too few names and indices out of range give none."""
    from pyspark.sql import Window

    c = table(spark, sf_dir, "customer")
    channels = c.select(F.col("c_nationkey").alias("document"), (F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1).alias("index"), F.col("c_custkey").alias("id"))
    k = F.col("n_nationkey")
    groups = table(spark, sf_dir, "nation").select(k.alias("document"), _text("p", k % 3).alias("path"), F.when(k % 4 == 1, F.array(F.lit("n0"))).otherwise(F.array(F.lit("n0"), F.lit("n1"))).alias("names"))
    lookup = spark.createDataFrame([("p0", [1, 2]), ("p1", [0, 7])], "path string, indices array<int>")
    return W.looked_up_groups(groups, lookup, channels)


@query("""SELECT c_nationkey % 5 AS image, c_mktsegment AS "group", count(DISTINCT c_custkey) AS channels, min('f' || c_custkey % 40) AS first_folder, bool_and(c_custkey % 40 < 39) AS complete FROM customer GROUP BY ALL""")
def m29_loader_entries(spark, sf_dir):
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select((F.col("c_nationkey") % 5).alias("image"), F.col("c_mktsegment").alias("group"), k.alias("channel"), _text("f", k % 40).alias("folder"))
    e = W.loader_entries(rows, rows.where("folder <> 'f39'").select("image", "folder"))
    return e.select("image", "group", F.size("folders").cast("long").alias("channels"), F.array_min(F.map_values("folders")).alias("first_folder"), "complete")
