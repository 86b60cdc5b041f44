"""Queries on what is imported: regions of OME-XML, DICOM metadata, click sessions with a model."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom.functions import geometry as G
from rasterloom.sources import dicom, rois
from rasterloom.sources.written import written
from rasterloom.streaming import sessions as S

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


# -- regions of interest: each customer has one ROI with shapes of all types, some without an attribute


def _described(spark, sf_dir):
    k = F.col("c_custkey")
    n = lambda m: (k % m).cast("string")
    attribute = lambda name, value: F.concat(F.lit(f' {name}="'), value, F.lit('"'))
    body = F.concat(
        F.lit("<Rectangle"), attribute("X", n(7)), F.lit(' Y="2"'), attribute("Width", n(5)), F.when(k % 4 == 1, "").otherwise(' Height="4"'), F.lit('/><Ellipse X="3"'), attribute("Y", n(9)), F.lit(' RadiusX="2"'),
        F.when(k % 3 == 0, ' FillColor="#00010203"').otherwise(""), F.lit('/><Line X1="0" Y1="0"'), attribute("X2", n(6)), F.lit(' Y2="8" StrokeWidth="2"/><Point'), attribute("X", n(11)),
        F.lit(' Y="1"/><Polygon Points="0,0 '), n(13), F.lit(',0 3,3"/><Label X="1" Y="2"'), attribute("Text", F.col("c_mktsegment")), F.lit("/>"),
    )
    whole = F.concat(F.lit('<OME xmlns="http://www.openmicroscopy.org/Schemas/OME/2016-06"><ROI ID="ROI:'), k.cast("string"), F.lit('">'), F.when(k % 3 == 0, F.concat(F.lit("<Name>"), "c_name", F.lit("</Name>"))).otherwise(""), F.when(k % 2 == 0, F.concat(F.lit("<Union>"), body, F.lit("</Union>"))).otherwise(body), F.lit("</ROI></OME>"))
    # the work is in the descriptions, not in the bytes by which a file is split
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return c.select("c_custkey", whole.alias("xml"))


_SHAPES = """(SELECT c_custkey, c_custkey AS k, c_name, c_mktsegment, pos, (ARRAY['rectangle', 'ellipse', 'line', 'point', 'polygon', 'label'])[pos + 1] AS type FROM customer CROSS JOIN range(6) t(pos)
  WHERE pos <> 0 OR c_custkey % 4 <> 1 AND c_custkey % 5 > 0)"""


@query(f"""SELECT c_custkey, 'ROI:' || k AS roi_id, CASE WHEN k % 3 = 0 THEN c_name END AS roi_name, CAST(pos AS INT) AS pos, 'Shape:' || pos AS id, type, CASE WHEN pos = 5 THEN c_mktsegment END AS text,
  CAST([k % 7, 3, 0, k % 11, NULL, 1][pos + 1] AS DOUBLE) AS x, CAST([2, k % 9, 0, 1, NULL, 2][pos + 1] AS DOUBLE) AS y, CAST(CASE pos WHEN 0 THEN k % 5 WHEN 1 THEN 2 WHEN 2 THEN k % 6 END AS DOUBLE) AS a, CAST(CASE pos WHEN 0 THEN 4 WHEN 1 THEN 2 WHEN 2 THEN 8 END AS DOUBLE) AS b,
  CASE WHEN pos = 4 THEN '0,0 ' || k % 13 || ',0 3,3' END AS points FROM {_SHAPES}""")
def f94_roi_shapes(spark, sf_dir):
    """Shapes of all types in document order; a and b are sizes, radii or the other end."""
    s = rois.shapes(_described(spark, sf_dir), "c_custkey", "xml")
    return s.select("c_custkey", "roi_id", "roi_name", "pos", "shape.id", "shape.type", "shape.text", "shape.x", "shape.y", F.coalesce("shape.width", "shape.rx", "shape.x2").alias("a"), F.coalesce("shape.height", "shape.ry", "shape.y2").alias("b"), "shape.points")


@query(f"""WITH s AS (SELECT *, 'roi-ROI:' || k AS head FROM {_SHAPES}), box AS (
    SELECT *, CAST(CASE pos WHEN 0 THEN k % 7 WHEN 1 THEN 1 WHEN 2 THEN 0 WHEN 3 THEN k % 11 WHEN 4 THEN 0 ELSE 1 END AS DOUBLE) AS x0, CAST(CASE pos WHEN 0 THEN k % 7 + k % 5 WHEN 1 THEN 5 WHEN 2 THEN k % 6 WHEN 3 THEN k % 11 WHEN 4 THEN greatest(3, k % 13) ELSE 1 END AS DOUBLE) AS x1,
      CAST(CASE pos WHEN 0 THEN 2 WHEN 1 THEN k % 9 - 2 WHEN 2 THEN 0 WHEN 3 THEN 1 WHEN 4 THEN 0 ELSE 2 END AS DOUBLE) AS y0, CAST(CASE pos WHEN 0 THEN 6 WHEN 1 THEN k % 9 + 2 WHEN 2 THEN 8 WHEN 3 THEN 1 WHEN 4 THEN 3 ELSE 2 END AS DOUBLE) AS y1 FROM s),
  own AS (SELECT c_custkey, head || '-Shape:' || pos AS id, CASE WHEN pos IN (0, 1, 4) THEN 'polygon' WHEN pos = 5 THEN 'text' ELSE type END AS type, [5, 33, 5, 1, 3, 1][pos + 1] AS n, CASE WHEN pos = 5 THEN c_mktsegment END AS text, CASE WHEN pos = 2 THEN 2.0 WHEN pos IN (0, 1, 4) THEN 3.0 END AS line_width,
      CASE WHEN pos = 1 AND k % 3 = 0 THEN [1, 2, 3, 0] ELSE [[255, 0, 0, 50], [0, 255, 0, 50], [0, 255, 255, 255], [255, 140, 0, 255], [255, 165, 0, 50], [0, 0, 0, 150]][pos + 1] END AS fill,
      'Imported from ROI ' || CASE WHEN k % 3 = 0 THEN c_name ELSE 'ROI:' || k END || ', Shape Shape:' || pos AS description,
      CASE WHEN pos = 2 THEN (x0 + x1) / 2 ELSE (x0 + x1) / 2 END AS x, (y0 + y1) / 2 AS y FROM box),
  middle AS (SELECT c_custkey, any_value(head) || '__import-centroid-label' AS id, 'text' AS type, 1 AS n, any_value(CASE WHEN k % 3 = 0 THEN c_name ELSE CAST(k AS VARCHAR) END) AS text, NULL AS line_width, [0, 0, 0, 150] AS fill, 'Auto centroid label for imported ROI ROI:' || any_value(k) AS description, (min(x0) + max(x1)) / 2 AS x, (min(y0) + max(y1)) / 2 AS y FROM box WHERE pos < 5 GROUP BY c_custkey)
  SELECT c_custkey, id, type, CAST(n AS INT) AS n, text, CAST(line_width AS DOUBLE) AS line_width, CAST(fill AS DOUBLE[]) AS fill, description, x, y FROM (SELECT * FROM own UNION ALL SELECT * FROM middle)""")
def f95_viewer_shapes(spark, sf_dir):
    """Shapes as the viewer has them, with the label in the middle of each ROI; x and y: the middle of a shape's box."""
    v = rois.viewer_shapes(written(rois.shapes(_described(spark, sf_dir), "c_custkey", "xml")), "c_custkey").withColumn("box", G.bounds(F.col("points")))
    return v.select("c_custkey", "id", "type", F.size("points").alias("n"), "text", "line_width", "fill", "description", F.round((F.col("box.x0") + F.col("box.x1")) / 2, 9).alias("x"), F.round((F.col("box.y0") + F.col("box.y1")) / 2, 9).alias("y"))


@query(f"""WITH s AS (SELECT k AS c_custkey, 'roi-ROI:' || k || '-Shape:' || pos AS id, pos FROM {_SHAPES} UNION ALL SELECT c_custkey, 'roi-ROI:' || c_custkey || '__import-centroid-label', 9 FROM customer)
  SELECT c_custkey, 'roi-group-ROI:' || c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN any_value(c_name) ELSE 'ROI ROI:' || c_custkey END AS name, list(s.id ORDER BY pos) AS shape_ids FROM s JOIN customer USING (c_custkey) GROUP BY c_custkey""")
def f95_roi_groups(spark, sf_dir):
    found = written(rois.shapes(_described(spark, sf_dir), "c_custkey", "xml"))
    return rois.groups(rois.viewer_shapes(found, "c_custkey"), found, "c_custkey").drop("roi")


@query(f"""SELECT k AS c_custkey, CAST(pos AS INT) AS pos, CASE WHEN pos = 1 THEN 33 WHEN pos = 3 THEN 25 WHEN pos = 4 THEN 3 ELSE 5 END AS n,
  round(CASE pos WHEN 0 THEN k % 5 * 4 WHEN 1 THEN 16 * 4 * sin(2 * pi() / 32) WHEN 2 THEN 2 * sqrt(k % 6 * (k % 6) + 64) WHEN 3 THEN 12 * 25 * sin(2 * pi() / 24) WHEN 4 THEN k % 13 * 1.5 ELSE (length(c_mktsegment) * 9.8 + 56) * 72.8 END, 6) AS area FROM {_SHAPES}""")
def f68_rings(spark, sf_dir):
    """The ring by which each shape selects pixels: its corners and its area."""
    s = rois.shapes(_described(spark, sf_dir), "c_custkey", "xml")
    v = rois.viewer_shapes(s, "c_custkey").where("pos is not null")
    ring = rois.ring(F.col("type"), F.col("points"), F.col("text"), F.lit(5.0))
    rings = v.select("c_custkey", "pos", F.explode_outer(F.array(ring)).alias("ring"))  # each ring once
    return rings.select("c_custkey", "pos", F.size("ring").alias("n"), F.round(G.area(F.col("ring")), 6).alias("area"))


# -- DICOM JSON


def _instances(spark, sf_dir):
    k = F.col("p_partkey")
    element = lambda vr, *values: F.struct(F.lit(vr).alias("vr"), F.array(*values).alias("Value"))
    none = F.struct(F.lit("PN").alias("vr"))
    path = lambda i: F.struct(element("SH", F.lit(str(i))).alias("00480106"), element("ST", F.concat("p_name", F.lit(f" {i}"))).alias("00480107"))
    measures = F.struct(F.lit("SQ").alias("vr"), F.array(F.struct(element("DS", k % 9 / 8.0, k % 5 / 4.0).alias("00280030"))).alias("Value"))
    body = F.struct(
        element("UI", F.concat(F.lit("1.2."), k.cast("string"))).alias("00080018"),
        none.alias("00100010"),
        element("US", F.col("p_size")).alias("00280010"),
        element("UL", k % 7 * 1000).alias("00480006"),
        F.struct(F.lit("SQ").alias("vr"), F.array(path(0), path(1)).alias("Value")).alias("00480105"),
        F.struct(F.lit("SQ").alias("vr"), F.array(F.struct(measures.alias("00289110"))).alias("Value")).alias("52009229"),
        element("LO", F.col("p_brand")).alias("00091001"),
    )
    return table(spark, sf_dir, "part").select("p_partkey", F.when(k % 10 == 7, "no json").otherwise(F.to_json(body)).alias("json"))


def _double(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


@query("""WITH p AS (SELECT * FROM part WHERE p_partkey % 10 <> 7) SELECT p_partkey, path, vr, value FROM (
  SELECT p_partkey, 'SOPInstanceUID' AS path, 'UI' AS vr, '"1.2.' || p_partkey || '"' AS value FROM p UNION ALL SELECT p_partkey, 'PatientName', 'PN', NULL FROM p
  UNION ALL SELECT p_partkey, 'Rows', 'US', CAST(p_size AS VARCHAR) FROM p UNION ALL SELECT p_partkey, 'TotalPixelMatrixColumns', 'UL', CAST(p_partkey % 7 * 1000 AS VARCHAR) FROM p
  UNION ALL SELECT p_partkey, 'OpticalPathSequence[' || i || '].OpticalPathIdentifier', 'SH', '"' || i || '"' FROM p, range(2) t(i) UNION ALL SELECT p_partkey, 'OpticalPathSequence[' || i || '].OpticalPathDescription', 'ST', '"' || p_name || ' ' || i || '"' FROM p, range(2) t(i)
  UNION ALL SELECT p_partkey, 'SharedFunctionalGroupsSequence[0].PixelMeasuresSequence[0].PixelSpacing', 'DS', '[' || regexp_replace(CAST(p_partkey % 9 / 8.0 AS VARCHAR), '\\.0$', '') || ',' || regexp_replace(CAST(p_partkey % 5 / 4.0 AS VARCHAR), '\\.0$', '') || ']' FROM p
  UNION ALL SELECT p_partkey, '00091001', 'LO', '"' || p_brand || '"' FROM p)""")
def s11_dicom_elements(spark, sf_dir):
    """Every element of every instance by name, those of nested sequences by their path; what is no JSON has none."""
    return dicom.naturalised(_instances(spark, sf_dir), "p_partkey", "json").select("p_partkey", "path", "vr", F.to_json("value").alias("value"))


# -- click sessions


def _clicks(spark, sf_dir):
    """Events as clicks, every tenth of them twice."""
    k = F.col("event_id")
    kind = F.get(F.array(*(F.lit(x) for x in ("start", "refine", "refine", "confirm", "start", "refine", "cancel", "start", "confirm"))), (k * 7 % 9).cast("int"))
    e = table(spark, sf_dir, "events")
    c = e.select(F.col("user_id").cast("string").alias("key"), "ts", k.alias("seq"), kind.alias("kind"), (k % 50).cast("double").alias("x"), (k % 60).cast("double").alias("y"), (k * 37 % 100 / 100).alias("iou"), (k * 53 % 100 / 100).alias("area"), (k % 9).cast("int").alias("corners"))
    return c.unionByName(c.where("seq % 10 = 0"))


_CLICKS = """(SELECT CAST(user_id AS VARCHAR) AS key, ts, event_id AS seq, (ARRAY['start', 'refine', 'refine', 'confirm', 'start', 'refine', 'cancel', 'start', 'confirm'])[CAST(event_id * 7 % 9 AS INT) + 1] AS kind,
  event_id % 50 AS x, event_id % 60 AS y, event_id * 37 % 100 >= 50 AND event_id * 53 % 100 <= 70 AS good, event_id % 9 AS corners FROM events)"""


@query(f"""WITH e AS (SELECT *, kind = 'start' AND good AS opens, kind IN ('confirm', 'cancel') AS ends FROM {_CLICKS}),
  n AS (SELECT *, count(*) FILTER (opens OR ends) OVER (PARTITION BY key ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e),
  s AS (SELECT key, before AS turn, ts AS ended FROM n WHERE kind = 'confirm'), o AS (SELECT key, before + 1 AS turn, ts AS started, seq, x, y, corners FROM n WHERE opens),
  c AS (SELECT key, turn, ts, seq, corners FROM o JOIN (SELECT key, turn, started AS ts FROM o) USING (key, turn) UNION ALL SELECT key, before, ts, seq, corners FROM n WHERE kind = 'refine')
  SELECT key, started, ended, CAST(any_value(o.x) AS DOUBLE) AS x, CAST(any_value(o.y) AS DOUBLE) AS y, count(*) AS points, CAST(arg_max(c.corners, (c.ts, c.seq)) AS INT) AS corners FROM s JOIN o USING (key, turn) JOIN c USING (key, turn)
  GROUP BY key, turn, started, ended HAVING arg_max(c.corners, (c.ts, c.seq)) >= 3""")
def x06_confirmed_sessions(spark, sf_dir):
    return S.confirmed(_clicks(spark, sf_dir))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS came, CAST(floor(value * 100) AS BIGINT) AS takes, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
  q AS (SELECT user_id, event_id, n, came AS begins, came + takes AS ends FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.event_id, e.n, greatest(e.came, q.ends), greatest(e.came, q.ends) + e.takes FROM q JOIN e ON e.user_id = q.user_id AND e.n = q.n + 1)
  SELECT user_id, event_id, begins, ends FROM q""")
def x04_served_calls(spark, sf_dir):
    """When each call of a user's begins and ends if one is served after the other."""
    e = table(spark, sf_dir, "events")
    calls = e.select(F.col("user_id").alias("key"), F.unix_millis(F.col("ts").cast("timestamp_ltz")).alias("ts"), F.col("event_id").alias("seq"), F.floor(F.col("value") * 100).alias("takes"))
    return S.served(calls).select(F.col("key").alias("user_id"), F.col("seq").alias("event_id"), "begins", "ends")
