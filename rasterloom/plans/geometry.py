"""Queries on rings and views: each embedding gives a ring of eight points and, as an 8 by 8 tile, a mask."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom.functions import geometry as G
from rasterloom.operators import clipping as K
from rasterloom.operators import polygons as O

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


def rings(spark, sf_dir, n: int = 8, scale: float = 100.0):
    e = table(spark, sf_dir, "embeddings")
    at = lambda k: F.floor(F.get("embedding", k).cast("double") * scale)
    return e.select(F.col("vec_id").alias("id"), F.array(*(G.point(at(2 * k) + F.col("vec_id") % 50 * 20, at(2 * k + 1) + F.floor(F.col("vec_id") / 50) * 20) for k in range(n))).alias("ring"))


RINGS = """SELECT vec_id AS id, k, CAST(floor(CAST(embedding[2 * k + 1] AS DOUBLE) * 100) AS DOUBLE) + vec_id % 50 * 20 AS x, CAST(floor(CAST(embedding[2 * k + 2] AS DOUBLE) * 100) AS DOUBLE) + (vec_id // 50) * 20 AS y
  FROM (SELECT vec_id, embedding, unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS k FROM embeddings)"""
EDGES = f"SELECT a.id, a.k, b.x AS ax, b.y AS ay, a.x AS bx, a.y AS yb FROM ({RINGS}) a JOIN ({RINGS}) b ON a.id = b.id AND b.k = (a.k + 7) % 8"


@query(f"SELECT id, sum(ax * yb - bx * ay) / 2 AS signed, abs(sum(ax * yb - bx * ay) / 2) AS area FROM ({EDGES}) GROUP BY id")
def a08_a09_areas(spark, sf_dir):
    return rings(spark, sf_dir).select("id", G.signed_area(F.col("ring")).alias("signed"), G.area(F.col("ring")).alias("area"))


@query(f"SELECT id, sum(x) / 8 AS x, sum(y) / 8 AS y FROM ({RINGS}) GROUP BY id")
def a07_vertex_mean(spark, sf_dir):
    return rings(spark, sf_dir).select("id", G.vertex_mean(F.col("ring")).alias("m")).select("id", "m.x", "m.y")


@query(f"SELECT id, (min(x) + max(x)) / 2 AS x, (min(y) + max(y)) / 2 AS y FROM ({RINGS}) GROUP BY id")
def a06_box_centre(spark, sf_dir):
    b = rings(spark, sf_dir).select("id", G.bounds(F.col("ring")).alias("b"))
    return b.select("id", ((F.col("b.x0") + F.col("b.x1")) / 2).alias("x"), ((F.col("b.y0") + F.col("b.y1")) / 2).alias("y"))


@query(f"SELECT id, count(*) FILTER ((yb > py) <> (ay > py) AND px < (ax - bx) * (py - yb) / nullif(ay - yb, 0) + bx) % 2 = 1 AS inside FROM (SELECT *, id % 50 * 20 + 1.5 AS px, (id // 50) * 20 + 2.25 AS py FROM ({EDGES})) GROUP BY id")
def f58_w09_point_in_polygon(spark, sf_dir):
    return rings(spark, sf_dir).select("id", G.contains(F.col("ring"), F.col("id") % 50 * 20 + 1.5, F.floor(F.col("id") / 50) * 20 + 2.25).alias("inside"))


@query(f"""WITH e AS ({EDGES}), r AS ({RINGS}),
  h AS (SELECT DISTINCT e.id AS holder, r.id AS held FROM r JOIN e ON e.id <> r.id GROUP BY e.id, r.id, r.k, r.x, r.y HAVING count(*) FILTER ((e.yb > r.y) <> (e.ay > r.y) AND r.x < (e.ax - e.bx) * (r.y - e.yb) / nullif(e.ay - e.yb, 0) + e.bx) % 2 = 1)
  SELECT DISTINCT least(holder, held) AS a, greatest(holder, held) AS b FROM h""")
def j23_polygon_overlaps(spark, sf_dir):
    return O.overlaps(rings(spark, sf_dir), 25.0)


@query(f"""WITH e AS (SELECT id, ax - id % 50 * 20 + 8 AS ax, ay - (id // 50) * 20 + 8 AS ay, bx - id % 50 * 20 + 8 AS bx, yb - (id // 50) * 20 + 8 AS yb FROM ({EDGES})),
  p AS (SELECT CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, x + 0.5 AS px, y + 0.5 AS py FROM range(16) a(x) CROSS JOIN range(16) b(y))
  SELECT id, x, y FROM e CROSS JOIN p GROUP BY id, x, y HAVING count(*) FILTER ((yb > py) <> (ay > py) AND px < (ax - bx) * (py - yb) / nullif(ay - yb, 0) + bx) % 2 = 1""")
def f67_rasterised(spark, sf_dir):
    r = rings(spark, sf_dir)
    moved = F.transform("ring", lambda p: G.point(p["x"] - F.col("id") % 50 * 20 + 8, p["y"] - F.floor(F.col("id") / 50) * 20 + 8))
    return O.rasterised(r.select("id", moved.alias("ring")), 16, 16)


@query("""SELECT o_orderkey, [least(a, b), least(c, d), greatest(a, b), greatest(c, d)] AS box, CAST(length(o_orderpriority) * 9.8 + 56 AS DOUBLE) AS text_width, CAST(72.8 AS DOUBLE) AS text_height
  FROM (SELECT *, CAST(o_orderkey % 17 AS DOUBLE) AS a, CAST(o_custkey % 19 AS DOUBLE) AS b, CAST(o_orderkey % 7 AS DOUBLE) AS c, CAST(o_custkey % 5 AS DOUBLE) AS d FROM orders)""")
def f46_f49_boxes(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    r = G.rectangle(*((x).cast("double") for x in (k % 17, k % 7, c % 19, c % 5)))
    t = G.bounds(G.text_box(F.lit(0.0), F.lit(0.0), F.col("o_orderpriority")))
    o = table(spark, sf_dir, "orders").select("o_orderkey", G.bounds(r).alias("r"), t.alias("t"))
    return o.select("o_orderkey", F.array("r.x0", "r.y0", "r.x1", "r.y1").alias("box"), F.round(F.col("t.x1") - F.col("t.x0"), 6).alias("text_width"), F.round(F.col("t.y1") - F.col("t.y0"), 6).alias("text_height"))


@query("SELECT p_partkey, CAST(33 AS INT) AS n, round(p_size * p_partkey * 32 / 2 * sin(2 * pi() / 32), 4) AS area FROM part")
def f47_f50_ellipse(spark, sf_dir):
    e = table(spark, sf_dir, "part").select("p_partkey", G.ellipse(F.lit(3.0), F.lit(4.0), F.col("p_size").cast("double"), F.col("p_partkey").cast("double"), 32).alias("ring"))
    return e.select("p_partkey", F.size("ring").alias("n"), F.round(G.area(F.col("ring")), 4).alias("area"))


@query("SELECT p_partkey, round(CASE WHEN p_size % 10 = 0 AND p_partkey % 10 = 0 THEN 9 ELSE 3 * sqrt(CAST((p_size % 10) * (p_size % 10) + (p_partkey % 10) * (p_partkey % 10) AS DOUBLE)) END, 6) AS area FROM part")
def f48_thick_lines(spark, sf_dir):
    q = G.thick_line(F.lit(1.0), F.lit(2.0), 1.0 + F.col("p_size") % 10, 2.0 + F.col("p_partkey") % 10, 3.0)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(G.area(q), 6).alias("area"))


@query(f"SELECT id, CAST(k AS INT) AS k, CASE WHEN id % 3 = 0 THEN x ELSE 2 * x + y + 5 END AS x, CASE WHEN id % 3 = 0 THEN y ELSE y - x - 1 END AS y FROM ({RINGS})")
def f52_f53_affine_of_parsed(spark, sf_dir):
    r = rings(spark, sf_dir)
    text = F.array_join(F.transform("ring", lambda p: F.concat(p["x"].cast("string"), F.lit(","), p["y"].cast("string"))), "  ")
    m = F.when(F.col("id") % 3 != 0, F.struct(*(F.lit(float(v)).alias(n) for n, v in (("a00", 2), ("a01", 1), ("a02", 5), ("a10", -1), ("a11", 1), ("a12", -1)))))
    back = r.select("id", F.posexplode(G.parsed_points(F.concat(F.lit(" "), text))).alias("k", "p"), m.alias("m"))
    return back.select("id", "k", G.affine(F.col("p"), F.col("m")).alias("q")).select("id", "k", "q.x", "q.y")


@query(f"""WITH r AS ({RINGS}), s AS (SELECT id, max(x) FILTER (k = 0) AS px, max(y) FILTER (k = 0) AS py, max(x) FILTER (k = 1) AS ax, max(y) FILTER (k = 1) AS ay, max(x) FILTER (k = 2) AS bx, max(y) FILTER (k = 2) AS yb FROM r GROUP BY id),
  t AS (SELECT *, coalesce(greatest(0, least(1, ((px - ax) * (bx - ax) + (py - ay) * (yb - ay)) / nullif((bx - ax) * (bx - ax) + (yb - ay) * (yb - ay), 0))), 0) AS t FROM s)
  SELECT id, round(sqrt(power(px - ax - t * (bx - ax), 2) + power(py - ay - t * (yb - ay), 2)), 6) AS d FROM t""")
def f54_segment_distance(spark, sf_dir):
    p = lambda k: F.get("ring", k)
    return rings(spark, sf_dir).select("id", F.round(G.segment_distance(p(0), p(1), p(2)), 6).alias("d"))


@query(f"SELECT id, CAST(9 AS INT) AS n_closed, CAST(8 AS INT) AS n_opened, max(x) FILTER (k = 3) - max(x) FILTER (k = 0) + 1 AS x, max(y) FILTER (k = 3) - max(y) FILTER (k = 0) + 2 AS y FROM ({RINGS}) GROUP BY id HAVING max(x) FILTER (k = 0) <> max(x) FILTER (k = 7) OR max(y) FILTER (k = 0) <> max(y) FILTER (k = 7)")
def f73_f74_rings(spark, sf_dir):
    r = rings(spark, sf_dir).where(F.get("ring", 0) != F.get("ring", 7))
    c = r.select("id", G.closed(F.col("ring")).alias("c"), G.moved_to(F.col("ring"), F.lit(1.0), F.lit(2.0)).alias("m"))
    return c.select("id", F.size("c").alias("n_closed"), F.size(G.opened(F.col("c"))).alias("n_opened"), F.get("m", 3)["x"].alias("x"), F.get("m", 3)["y"].alias("y"))


_VIEW = """SELECT o_orderkey, CASE WHEN w = 0 THEN 0.0 ELSE greatest(0, least(2000, cx - w / 2 / s)) END AS x0, CASE WHEN w = 0 THEN 0.0 ELSE greatest(0, least(1500, cy - 300 / s)) END AS y0,
  CASE WHEN w = 0 THEN 2000.0 ELSE greatest(0, least(2000, cx + w / 2 / s)) END AS x1, CASE WHEN w = 0 THEN 1500.0 ELSE greatest(0, least(1500, cy + 300 / s)) END AS y1
  FROM (SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE 800 END AS DOUBLE) AS w, CAST(o_custkey % 2000 AS DOUBLE) AS cx, CAST(o_orderkey % 1500 AS DOUBLE) AS cy, power(2.0, o_orderkey % 5 - 2) AS s FROM orders)"""


def _views(spark, sf_dir):
    k = F.col("o_orderkey")
    v = G.view_rect((k % 5 - 2).cast("double"), (F.col("o_custkey") % 2000).cast("double"), (k % 1500).cast("double"), F.when(k % 9 == 0, 0).otherwise(800), F.lit(600), F.lit(2000), F.lit(1500))
    return table(spark, sf_dir, "orders").select("o_orderkey", v.alias("v"))


@query(_VIEW)
def f38_view_rect(spark, sf_dir):
    return _views(spark, sf_dir).select("o_orderkey", "v.*")


@query(f"""WITH v AS ({_VIEW}), b AS (SELECT *, x1 - x0 AS w, y1 - y0 AS h FROM v),
  c AS (SELECT *, CASE WHEN w <= 0 OR h <= 0 THEN 1 ELSE 1024 / greatest(w, h) END AS scale FROM b)
  SELECT o_orderkey, round(scale, 9) AS scale, round(CASE WHEN w <= 0 OR h <= 0 OR w >= h THEN 0 ELSE (1024 - w * scale) / 2 END, 6) AS pad_x, round(CASE WHEN w <= 0 OR h <= 0 OR w < h THEN 0 ELSE (1024 - h * scale) / 2 END, 6) AS pad_y, true AS back FROM c""")
def f39_f40_letterbox(spark, sf_dir):
    v = _views(spark, sf_dir).withColumn("b", G.letterbox(F.col("v")))
    p = G.point(F.lit(77.0), F.lit(55.0))
    again = G.out_of_letterbox(G.into_letterbox(p, F.col("v"), F.col("b")), F.col("v"), F.col("b"))
    v = v.withColumn("again", again)
    same = (F.abs(F.col("again.x") - 77) < 1e-6) & (F.abs(F.col("again.y") - 55) < 1e-6)
    identity = F.col("b.scale") == 1
    return v.select("o_orderkey", F.round("b.scale", 9).alias("scale"), F.round("b.pad_x", 6).alias("pad_x"), F.round("b.pad_y", 6).alias("pad_y"), (same | identity).alias("back"))


@query("SELECT o_orderkey, x - 400 / s AS x0, x + 400 / s AS x1, round(log2(s), 9) AS zoom, x, y FROM (SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS x, CAST(o_orderkey AS DOUBLE) AS y, power(2.0, o_orderkey % 5 - 2) AS s FROM orders)")
def f41_view_bounds(spark, sf_dir):
    k = F.col("o_orderkey")
    b = table(spark, sf_dir, "orders").select("o_orderkey", G.view_to_bounds((k % 5 - 2).cast("double"), F.col("o_custkey").cast("double"), k.cast("double"), F.lit(800.0), F.lit(600.0)).alias("b"))
    b = b.withColumn("v", G.bounds_to_view(F.col("b"), F.lit(800.0), F.lit(600.0)))
    return b.select("o_orderkey", "b.x0", "b.x1", F.round("v.zoom", 9).alias("zoom"), F.round("v.x", 6).alias("x"), F.round("v.y", 6).alias("y"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE round(CASE WHEN o_orderkey % 4 = 2 THEN log2(900 / 3000.0) ELSE log2((1 + o_custkey % 7) * 900 / 3000.0) - 0.3 END, 9) END AS zoom,
  CASE WHEN o_orderkey % 4 = 3 THEN NULL WHEN o_orderkey % 4 = 1 THEN 2000.0 ELSE o_custkey % 10 / 10.0 * 4000 END AS x FROM orders""")
def f42_legacy_views(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    pan = F.when(k.isin(0, 2), F.col("o_custkey") % 10 / 10.0)
    v = G.legacy_view(pan, pan, F.when(k < 2, (1 + F.col("o_custkey") % 7).cast("double")), F.lit(3000), F.lit(4000), F.lit(900))
    return table(spark, sf_dir, "orders").select("o_orderkey", v.alias("v")).select("o_orderkey", F.round("v.zoom", 9).alias("zoom"), F.col("v.x").alias("x"))


@query("""WITH t AS (SELECT o_orderkey, CAST(greatest(0, floor(lo / 4.0 / 256)) AS BIGINT) AS f, CAST(ceil((lo + 900) / 4.0 / 256) - 1 AS BIGINT) AS l FROM (SELECT o_orderkey, CAST(o_custkey % 9000 AS DOUBLE) - 50 AS lo FROM orders))
  SELECT o_orderkey, least(f, 7) AS first, least(7, greatest(least(f, 9999999), l)) AS last FROM t""")
def f17_tile_range(spark, sf_dir):
    lo = (F.col("o_custkey") % 9000).cast("double") - 50
    return table(spark, sf_dir, "orders").select("o_orderkey", G.tile_range(lo, lo + 900, F.lit(4.0), 256, F.lit(2000)).alias("t")).select("o_orderkey", "t.first", "t.last")


@query("SELECT p_partkey, CAST(floor((w - least(w, h)) / 2.0) AS BIGINT) AS x, CAST(floor((h - least(w, h)) / 2.0) AS BIGINT) AS y, least(w, h) AS side FROM (SELECT p_partkey, p_partkey % 90 + 1 AS w, CAST(p_size AS BIGINT) AS h FROM part)")
def f76_square_crop(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", G.square_crop(F.col("p_partkey") % 90 + 1, F.col("p_size").cast("long")).alias("c")).select("p_partkey", "c.*")


# -- kernels without SQL; tests/test_polygons.py compares them with brute force


@query()
def f56_simplified_rings(spark, sf_dir):
    return O.simplify(rings(spark, sf_dir), 5.0)


@query()
def f55_f57_simplified_lines(spark, sf_dir):
    r = rings(spark, sf_dir)
    return O.simplify_line(r, 8.0).select("id", F.size("ring").alias("by_segment")).join(O.simplify_line(r, 8.0, to_line=True).select("id", F.size("ring").alias("by_line")), "id")


@query()
def f59_convex_hulls(spark, sf_dir):
    return O.hulls(rings(spark, sf_dir))


@query()
def f60_f61_traced_masks(spark, sf_dir):
    m = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: (v > 0.1).cast("int")).alias("mask"))
    return O.traced(m, 8)


@query()
def t10_union_and_difference(spark, sf_dir):
    """Overlapping hulls of neighbouring embeddings; tests/test_clipping.py checks areas."""
    h = O.hulls(rings(spark, sf_dir)).select("id", "ring")
    pairs = O.overlaps(h, 25.0).join(h.select(F.col("id").alias("a"), F.col("ring").alias("ring_a")), "a").join(h.select(F.col("id").alias("b"), F.col("ring").alias("ring_b")), "b")
    pairs = pairs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "a", "b")
    union = K.combined(pairs, "ring_a", "ring_b", "union").withColumn("union_area", G.area(F.col("ring")))
    return K.combined(union, "ring_a", "ring_b", "difference").select("a", "b", "union_area", G.area(F.col("ring")).alias("difference_area"))


@query()
def a22_united_strokes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return K.united(e.select(F.col("user_id").alias("id"), F.col("event_id").alias("t"), (F.col("event_id") % 97 / 4).alias("x"), (F.col("user_id") % 7).cast("double").alias("y")), 5.0)
