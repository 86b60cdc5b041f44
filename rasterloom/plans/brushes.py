"""Queries on contours, brush strokes and regions of pixels. Each embedding gives a mask, two rings and a stroke."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom.functions import geometry as G
from rasterloom.operators import contours as C
from rasterloom.operators import intervals as I
from rasterloom.operators import lines as L
from rasterloom.operators import polygons as K
from rasterloom.operators import regions as O

from .raster import MASKS, masks, table

QUERIES: dict = {}
SQL: dict = {}

SIDE = 64


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _entry(k: int):
    return F.floor(F.get("embedding", k).cast("double") * 100) + SIDE // 2


def rings(spark, sf_dir, first: int):
    """A ring of eight points from the sixteen entries after the first ones."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.array(*(G.point(_entry(first + 2 * k), _entry(first + 2 * k + 1)) for k in range(8))).alias("ring"))


def stroke(spark, sf_dir):
    """Three discs for each embedding."""
    discs = F.explode(F.array(*(G.point(_entry(32 + 2 * k), _entry(33 + 2 * k)) for k in range(3))))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 5 + 2.5).alias("r"), discs.alias("p")).select("id", "p.x", "p.y", "r")


def region(spark, sf_dir, first: int):
    return O.of_rings(rings(spark, sf_dir, first), SIDE, SIDE)


def _entries(k: str) -> str:
    return f"CAST(floor(CAST(embedding[{k}] AS DOUBLE) * 100) AS DOUBLE) + {SIDE // 2}"


def _ring_pixels(first: int) -> str:
    return f"""(WITH v AS (SELECT vec_id AS id, k, {_entries(f"2 * k + 1 + {first}")} AS x, {_entries(f"2 * k + 2 + {first}")} AS y FROM (SELECT vec_id, embedding, unnest(range(8)) AS k FROM embeddings)),
    e AS (SELECT a.id, b.x AS ax, b.y AS ay, a.x AS bx, a.y AS yb FROM v a JOIN v b ON a.id = b.id AND b.k = (a.k + 7) % 8)
    SELECT id, x, y FROM e CROSS JOIN range({SIDE}) p(x) CROSS JOIN range({SIDE}) q(y)
    GROUP BY id, x, y HAVING count(*) FILTER ((yb > y + 0.5) <> (ay > y + 0.5) AND x + 0.5 < (ax - bx) * (y + 0.5 - yb) / nullif(ay - yb, 0) + bx) % 2 = 1)"""


_STROKE_PIXELS = f"""(SELECT DISTINCT id, p.x, q.y FROM (SELECT vec_id AS id, vec_id % 5 + 2.5 AS r, {_entries("2 * k + 33")} AS cx, {_entries("2 * k + 34")} AS cy FROM (SELECT vec_id, embedding, unnest(range(3)) AS k FROM embeddings))
    CROSS JOIN range({SIDE}) p(x) CROSS JOIN range({SIDE}) q(y) WHERE (p.x - cx) * (p.x - cx) + (q.y - cy) * (q.y - cy) <= r * r)"""

_RUNS = "SELECT id, y, min(x) AS x0, max(x) AS x1 FROM (SELECT *, x - row_number() OVER (PARTITION BY id, y ORDER BY x) AS g FROM ({})) GROUP BY id, y, g"


def _measures(pixels: str, name: str) -> str:
    return f"""SELECT s.id, count(*) AS {name}_area, CAST(sum(4 - (SELECT count(*) FROM {pixels} n WHERE n.id = s.id AND abs(n.x - s.x) + abs(n.y - s.y) = 1)) AS BIGINT) AS {name}_perimeter FROM {pixels} s GROUP BY s.id"""


_CASES = " UNION ALL ".join(f"SELECT {case} AS c, {a[0]} AS fx, {a[1]} AS fy, {b[0]} AS tx, {b[1]} AS ty" for case, pairs in C.SEGMENTS.items() for a, b in pairs)

# Every segment walks on until it is back; the walk that starts at the smallest node of a loop gives its order.
_LOOPS = f"""m AS ({MASKS}), cells AS (SELECT a.plane, a.x, a.y, 8 * a.v + 4 * b.v + 2 * c.v + d.v AS c FROM m a JOIN m b ON b.plane = a.plane AND b.x = a.x + 1 AND b.y = a.y JOIN m c ON c.plane = a.plane AND c.x = a.x + 1 AND c.y = a.y + 1 JOIN m d ON d.plane = a.plane AND d.x = a.x AND d.y = a.y + 1),
  segments AS (SELECT plane, 2 * x + fx AS x0, 2 * y + fy AS y0, 2 * x + tx AS x1, 2 * y + ty AS y1 FROM cells JOIN ({_CASES}) t USING (c)),
  walk AS (SELECT plane, x0 AS sx, y0 AS sy, x1 AS x, y1 AS y, 1 AS d FROM segments
    UNION ALL SELECT w.plane, sx, sy, s.x1, s.y1, d + 1 FROM walk w JOIN segments s ON s.plane = w.plane AND s.x0 = w.x AND s.y0 = w.y WHERE w.x <> sx OR w.y <> sy),
  closed AS (SELECT plane, sx, sy, d AS n FROM walk WHERE x = sx AND y = sy AND d >= 5 AND d - 1 <= 128),
  leaders AS (SELECT c.* FROM closed c JOIN walk w USING (plane, sx, sy) GROUP BY ALL HAVING min(w.y * 1000 + w.x) = c.sy * 1000 + c.sx),
  loops AS (SELECT plane, CAST(sy AS BIGINT) * 2147483648 + sx AS loop, CAST(d % n AS BIGINT) AS pos, x / 2.0 AS x, y / 2.0 AS y, CAST(n AS BIGINT) AS n FROM walk JOIN leaders USING (plane, sx, sy))"""


@query(f"WITH RECURSIVE {_LOOPS} SELECT plane, loop, pos, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, n FROM loops")
def f62_mask_loops(spark, sf_dir):
    """Closed contours of every mask, stitched and ordered."""
    return C.loops(masks(spark, sf_dir), 8, 8)


def _world():
    return F.struct(F.col("plane").cast("double").alias("left"), F.lit(100.0).alias("bottom"), (F.col("plane") + 40.0).alias("right"), F.lit(84.0).alias("top"))


_WORLD = f"{_LOOPS}, world AS (SELECT plane, loop, pos, n, plane + x / 8 * 40 AS x, 84 + y / 8 * 16 AS y FROM loops)"


@query(f"WITH RECURSIVE {_WORLD} SELECT plane, loop, pos, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, n FROM world")
def f63_world_loops(spark, sf_dir):
    return C.to_world(C.loops(masks(spark, sf_dir), 8, 8), _world(), 8, 8)


@query(f"""WITH RECURSIVE {_WORLD}, sized AS (SELECT plane, loop, any_value(a.n) AS n, CAST(sum(a.x * b.y - b.x * a.y) / 2 AS DOUBLE) AS area FROM world a JOIN world b USING (plane, loop) WHERE b.pos = (a.pos + 1) % a.n GROUP BY plane, loop),
  marked AS (SELECT *, CASE WHEN max(area) OVER (PARTITION BY plane) > 0 THEN area > 0 ELSE area < 0 END AS outer_ FROM sized)
  SELECT plane, loop, n, area, outer_ AS "outer", outer_ AND row_number() OVER (PARTITION BY plane ORDER BY outer_ DESC, abs(area) DESC, loop) = 1 AS hull FROM marked""")
def f64_outer_loops(spark, sf_dir):
    """Loops in the world with signed areas, which of them are outer ones, and each brush's hull."""
    return C.outer(C.areas(C.to_world(C.loops(masks(spark, sf_dir), 8, 8), _world(), 8, 8)))


@query(_RUNS.format(f"""WITH a AS {_ring_pixels(0)}, b AS {_STROKE_PIXELS}, t AS (SELECT DISTINCT id FROM a JOIN b USING (id, x, y))
  SELECT * FROM a UNION SELECT * FROM b WHERE id IN (SELECT id FROM t)"""))
def f65_brush_added(spark, sf_dir):
    """Regions with the strokes that touch them."""
    brush = O.strokes(stroke(spark, sf_dir), SIDE, SIDE)
    return I.to_runs(O.edited(region(spark, sf_dir, 0), brush, "add"))


@query(_RUNS.format(f"""WITH a AS {_ring_pixels(0)}, b AS {_STROKE_PIXELS}, d AS (SELECT * FROM a EXCEPT SELECT * FROM b)
  SELECT * FROM d UNION ALL SELECT * FROM a WHERE id NOT IN (SELECT id FROM d)"""))
def f65_brush_subtracted(spark, sf_dir):
    """Regions without the strokes; one that would vanish stays."""
    brush = O.strokes(stroke(spark, sf_dir), SIDE, SIDE)
    return I.to_runs(O.edited(region(spark, sf_dir, 0), brush, "subtract"))


@query(f"""WITH a AS {_ring_pixels(0)}, b AS {_ring_pixels(16)}, u AS (SELECT * FROM a UNION SELECT * FROM b), d AS (SELECT * FROM a EXCEPT SELECT * FROM b)
  SELECT * FROM ({_measures("u", "union")}) FULL JOIN ({_measures("d", "difference")}) USING (id)""")
def t10_region_union_and_difference(spark, sf_dir):
    """Area and perimeter of the union and of the difference of two rings of each embedding."""
    a, b = region(spark, sf_dir, 0), region(spark, sf_dir, 16)
    named = lambda df, n: df.withColumnsRenamed({"area": f"{n}_area", "perimeter": f"{n}_perimeter"})
    return named(O.measured(O.united(a, b)), "union").join(named(O.measured(O.without(a, b)), "difference"), "id", "full")


@query(f"""WITH a AS {_ring_pixels(0)}, b AS {_ring_pixels(16)}, u AS (SELECT * FROM a UNION SELECT * FROM b),
  q AS (SELECT id, x + dx AS x, y + dy AS y, count(*) AS n, min(dx + dy) = 0 AND max(dx + dy) = 2 OR count(DISTINCT dx) = 2 AND count(DISTINCT dy) = 2 AS diagonal FROM u CROSS JOIN range(2) i(dx) CROSS JOIN range(2) j(dy) GROUP BY ALL)
  SELECT id, CAST(sum(CASE WHEN n IN (1, 3) THEN 1 WHEN n = 2 AND diagonal THEN 2 ELSE 0 END) AS BIGINT) AS corners, CAST((SELECT count(*) FROM u WHERE u.id = q.id) AS DOUBLE) AS signed_area FROM q GROUP BY id""")
def u06_union_outlines(spark, sf_dir):
    """Corners and summed signed area of all rings around the union of two rings, which is the union's own area."""
    sized = C.areas(O.outlines(O.united(region(spark, sf_dir, 0), region(spark, sf_dir, 16))))
    return sized.groupBy(F.col("plane").alias("id")).agg(F.sum("n").alias("corners"), F.sum("area").alias("signed_area"))


@query(f"""WITH s AS (SELECT DISTINCT user_id AS id, p.x, q.y FROM events CROSS JOIN range(40) p(x) CROSS JOIN range(20) q(y)
    WHERE (p.x - event_id % 97 / 4.0 - 6) * (p.x - event_id % 97 / 4.0 - 6) + (q.y - user_id % 7 - 6) * (q.y - user_id % 7 - 6) <= 25)
  {_measures("s", "stroke")}""")
def a22_stroke_regions(spark, sf_dir):
    """Area and perimeter of the union of the discs of each user's stroke."""
    e = table(spark, sf_dir, "events")
    discs = e.select(F.col("user_id").alias("id"), (F.col("event_id") % 97 / 4 + 6).alias("x"), (F.col("user_id") % 7 + 6.0).alias("y"), F.lit(5.0).alias("r"))
    return O.measured(O.strokes(discs, 40, 20)).withColumnsRenamed({"area": "stroke_area", "perimeter": "stroke_perimeter"})


@query(f"WITH a AS {_ring_pixels(0)}, b AS {_STROKE_PIXELS} SELECT DISTINCT id FROM a JOIN b USING (id, x, y)")
def f65_touching_strokes(spark, sf_dir):
    return O.overlapping(region(spark, sf_dir, 0), O.strokes(stroke(spark, sf_dir), SIDE, SIDE))


_VERTICES = f"SELECT vec_id AS id, k, {_entries('2 * k + 1')} AS x, {_entries('2 * k + 2')} AS y FROM (SELECT vec_id, embedding, unnest(range(24)) AS k FROM embeddings)"


def _kept_sql(distance: str, splits: str) -> str:
    """Vertices between two kept ones are split at the farthest; which one that is, is worked out for every pair of vertices."""
    return f"""WITH RECURSIVE v AS ({_VERTICES}), d AS (SELECT a.id, a.k AS i, b.k AS j, p.k, {distance} AS d FROM v a JOIN v b ON a.id = b.id AND b.k > a.k JOIN v p ON p.id = a.id AND p.k > a.k AND p.k < b.k),
  far AS (SELECT id, i, j, arg_max(k, (d, -k)) AS k FROM d GROUP BY ALL HAVING max(d) {splits} 8),
  piece AS (SELECT DISTINCT id, CAST(0 AS BIGINT) AS i, CAST(23 AS BIGINT) AS j FROM v UNION ALL SELECT id, unnest([i, far.k]), unnest([far.k, j]) FROM piece JOIN far USING (id, i, j))
  SELECT DISTINCT v.id, v.k, v.x, v.y FROM v JOIN piece USING (id) WHERE v.k IN (i, j)"""


_T = "least(1, greatest(0, ((p.x - a.x) * (b.x - a.x) + (p.y - a.y) * (b.y - a.y)) / ((b.x - a.x) ** 2 + (b.y - a.y) ** 2)))"
_TO_END = "sqrt((p.x - a.x) ** 2 + (p.y - a.y) ** 2)"


def _lines(spark, sf_dir):
    points = F.posexplode(F.array(*(G.point(_entry(2 * k), _entry(2 * k + 1)) for k in range(24)))).alias("k", "p")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), points).select("id", F.col("k").cast("long").alias("k"), "p.x", "p.y")


@query(_kept_sql(f"CASE WHEN a.x = b.x AND a.y = b.y THEN {_TO_END} ELSE sqrt((p.x - a.x - {_T} * (b.x - a.x)) ** 2 + (p.y - a.y - {_T} * (b.y - a.y)) ** 2) END", ">"))
def f55_kept_vertices(spark, sf_dir):
    """Vertices of lines of 24 that are kept by their distance to segments."""
    return L.simplified(_lines(spark, sf_dir), 8.0)


@query(_kept_sql(f"CASE WHEN a.x = b.x AND a.y = b.y THEN {_TO_END} ELSE abs((b.x - a.x) * (a.y - p.y) - (a.x - p.x) * (b.y - a.y)) / sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) END", ">="))
def f57_kept_vertices(spark, sf_dir):
    """The same by their distance to whole lines."""
    return L.simplified(_lines(spark, sf_dir), 8.0, to_line=True)


@query("""WITH p AS (SELECT DISTINCT vec_id AS id, CAST(floor(CAST(embedding[2 * k + 1] AS DOUBLE) * 100) AS BIGINT) AS x, CAST(floor(CAST(embedding[2 * k + 2] AS DOUBLE) * 100) AS BIGINT) AS y FROM (SELECT vec_id, embedding, unnest(range(8)) AS k FROM embeddings)),
  e AS (SELECT a.id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS yb FROM p a JOIN p b ON a.id = b.id AND (a.x <> b.x OR a.y <> b.y) JOIN p r ON r.id = a.id GROUP BY ALL
    HAVING bool_and((b.x - a.x) * (r.y - a.y) - (b.y - a.y) * (r.x - a.x) > 0 OR (b.x - a.x) * (r.y - a.y) = (b.y - a.y) * (r.x - a.x) AND (r.x - a.x) * (r.x - b.x) + (r.y - a.y) * (r.y - b.y) <= 0))
  SELECT id, CAST(count(*) AS INT) AS corners, CAST(sum(ax * yb - bx * ay) AS DOUBLE) / 2 AS area FROM e GROUP BY id""")
def f59_hull_measures(spark, sf_dir):
    """Corners and area of convex hulls; in SQL, of all pairs of points that have the others on one side."""
    at = lambda k: F.floor(F.get("embedding", k).cast("double") * 100)
    h = K.hulls(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.array(*(G.point(at(2 * k), at(2 * k + 1)) for k in range(8))).alias("ring")))
    return h.select("id", F.size("ring").alias("corners"), G.signed_area(F.col("ring")).alias("area"))
