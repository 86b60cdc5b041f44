"""Every shape type, Unions, aliases, missing attributes and colours of OME-XML regions."""

import pytest

from rasterloom.sources import ome, rois

XML = """<?xml version="1.0"?><!-- <ROI ID="no"><Point X="1" Y="1"/></ROI> -->
<ome:OME xmlns:ome="http://www.openmicroscopy.org/Schemas/OME/2016-06"><ome:Image ID="Image:0"/>
<ome:ROI ID="ROI:0" Name="attribute"><ome:Name> first </ome:Name><ome:Description>line one
line two</ome:Description><ome:Union>
  <ome:Rectangle ID="Shape:a" X="1" Y="2" Width="3"/>
  <ome:Rectangle ID="Shape:b" X="5" Y="6" Width="7" Height="8" FillColor="-16776961" StrokeColor="#80ff0001" StrokeWidth="2" TheC="1.5" Name="a &lt;b&gt; &quot;c&quot;"/>
  <ome:Ellipse cx='3' Y="4" Radius="2"/>
  <ome:Line X1="0" Y1="0" X2="4" Y2="3" Fill="rgba(1, 2, 3, 0.5)"><ome:Transform A00="9"/></ome:Line>
  <ome:Point x="8" py="9" Text="here"/>
  <ome:Polygon Points="0,0 4,0 4,4"/>
  <ome:Polyline points=" 1,1 2,2 "/>
  <ome:Mask X="1" Y="2" Width="3" Height="4"/>
  <ome:Label X="1" Y="1" Text="said"/><ome:Label X="2" Y="2">inner &amp; text</ome:Label><ome:Label X="3" Y="3"/>
</ome:Union></ome:ROI>
<ROI id="ROI:1"><Label X="1" Y="2" Text="only"/></ROI>
<ROI Name="no id"><Point X="1" Y="2"/></ROI><ROI ID="ROI:2"/><ROI ID="ROI:3"><Point X="1"/><Rectangle X="1" Y="1" Width="0" Height="1"/><Polygon Points="  "/><Ellipse X="1" Y="1" RadiusX="1" RadiusY="-1"/><Line X1="1" Y1="2" X2="q" Y2="3"/></ROI>
<ROI ID="urn:x:y"><Description>
  a description
more</Description><point X="4" Y="5"/></ROI></ome:OME>"""


@pytest.fixture(scope="module")
def found(spark):
    rows = [(7, XML), (8, None), (9, "no xml"), (10, "<ROI ID='z'>")]
    return rois.shapes(spark.createDataFrame(rows, "key int, value string"), "key", "value")


def test_shapes(found):
    got = {(r.roi_id, r.pos): r for r in found.collect()}
    s = {k: r["shape"] for k, r in got.items()}
    assert {k: v.type for k, v in s.items()} == {
        ("ROI:0", 1): "rectangle", ("ROI:0", 2): "ellipse", ("ROI:0", 3): "line", ("ROI:0", 4): "point", ("ROI:0", 5): "polygon", ("ROI:0", 6): "polyline",
        ("ROI:0", 8): "label", ("ROI:0", 9): "label", ("ROI:1", 0): "label", ("urn:x:y", 0): "point",
    }
    b = s["ROI:0", 1]
    assert (b.id, b.x, b.y, b.width, b.height, b.stroke_width, b.the_c, b.name) == ("Shape:b", 5, 6, 7, 8, 2, 1, 'a <b> "c"')
    assert b.fill == [255, 0, 0, 255] and b.stroke == [255, 0, 1, 128]
    e = s["ROI:0", 2]
    assert (e.id, e.x, e.y, e.rx, e.ry) == ("Shape:2", 3, 4, 2, 2)
    line = s["ROI:0", 3]
    assert (line.x, line.y, line.x2, line.y2, line.fill) == (0, 0, 4, 3, [1, 2, 3, 127.5])
    assert (s["ROI:0", 4].x, s["ROI:0", 4].y, s["ROI:0", 4].text) == (8, 9, "here")
    assert (s["ROI:0", 5].points, s["ROI:0", 6].points) == ("0,0 4,0 4,4", "1,1 2,2")
    assert (s["ROI:0", 8].text, s["ROI:0", 9].text) == ("said", "inner & text")
    assert (got["ROI:0", 1].roi_name, got["ROI:0", 1].roi_description) == ("first", "line one\nline two")


def test_viewer_shapes_groups_and_rings(found):
    v = rois.viewer_shapes(found, "key")
    by = {r.id: r for r in v.collect()}
    assert len(by) == 12 and {r.type for r in by.values()} == {"polygon", "line", "point", "polyline", "text"}
    b = by["roi-ROI:0-Shape:b"]
    assert b.points[0] == b.points[4] == (5, 6) and b.points[2] == (12, 14) and b.line_width == 2 and b.description == "Imported from ROI first, Shape Shape:b"
    e = by["roi-ROI:0-Shape:2"]
    assert len(e.points) == 33 and e.fill == [0, 255, 0, 50] and e.label == "Shape:2"
    line = by["roi-ROI:0-Shape:3"]
    assert [(round(p.x, 9), round(p.y, 9)) for p in line.points] == [(-0.9, 1.2), (3.1, 4.2), (4.9, 1.8), (0.9, -1.2), (-0.9, 1.2)]
    assert by["roi-ROI:0-Shape:6"].fill is None and len(by["roi-ROI:0-Shape:6"].points) == 2
    middle = by["roi-ROI:0__import-centroid-label"]
    assert middle.points == [(6, 7)] and middle.text == "first" and middle.line == [255] * 4
    assert by["roi-urn:x:y__import-centroid-label"].text == "a description"
    assert "roi-ROI:1__import-centroid-label" not in by
    g = {r.id: r for r in rois.groups(v, found, "key").collect()}
    assert set(g) == {"roi-group-ROI:0", "roi-group-ROI:1", "roi-group-urn:x:y"}
    assert g["roi-group-ROI:0"].shape_ids[-1] == middle.id and len(g["roi-group-ROI:0"].shape_ids) == 9 and g["roi-group-ROI:1"].name == "ROI ROI:1"
    from pyspark.sql import functions as F

    rings = {r.id: r.ring for r in v.select("id", rois.ring(F.col("type"), F.col("points"), F.col("text"), F.lit(5.0)).alias("ring")).collect()}
    assert len(rings["roi-ROI:0-Shape:4"]) == 25 and rings["roi-ROI:0-Shape:4"][0] == (13, 9)
    assert len(rings["roi-ROI:0-Shape:6"]) == 3 and len(rings[middle.id]) == 5 and rings["roi-ROI:0-Shape:b"] == b.points


def test_a_missing_attribute_moves_no_other(spark):
    df = spark.createDataFrame([(1, '<OME><ROI ID="r"><Union><Rectangle X="1" Y="2" Width="3"/><Rectangle X="5" Y="6" Width="7" Height="8"/><Point X="1"/><Point X="3" Y="4"/></Union></ROI></OME>')], "k int, xml string")
    got = {(r.kind, r.x, r.y, r.width, r.height) for r in ome.rois(df, "k", "xml").collect()}
    assert got == {("rectangle", 5, 6, 7, 8), ("point", 3, 4, None, None)}


def test_colours(spark):
    from pyspark.sql import functions as F

    cases = {"0": [0, 0, 0, 0], "-1": [255] * 4, " 255 ": [0, 0, 0, 255], "#102030": [16, 32, 48, 255], "80102030": [4, 198, 66, 142], "FF102030": [16, 32, 48, 255], "rgb(1 2 3)": [1, 2, 3, 255], "rgba(1,2,3,200)": [1, 2, 3, 200], "rgb(1,2)": None, "rgb(a,b,c)": None, "#12": None, "": None, "zz": None}
    got = {r.t: r.c for r in spark.createDataFrame([(t,) for t in cases], "t string").select("t", rois.colour(F.col("t")).alias("c")).collect()}
    assert got == cases


def test_nothing_is_worked_out_twice(spark):
    """Each of the three calls of from_xml is in the plan once: a filter that Spark pushes down would repeat them."""
    rows = spark.createDataFrame([(7, XML)], "key int, value string")
    plan = rois.shapes(rows, "key", "value")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_xml(") <= 3


def test_attributes(spark):
    from pyspark.sql import functions as F

    cases = {"<R X='1' Y = \"2\">": {"X": "1", "Y": "2"}, '<R X="" Y=" " Z=" a b "/>': {"Z": "a b"}, '<R X="1" X="2"/>': {"X": "1"}, '<R X="a &lt; b" Y="1"/>': {"X": "a < b", "Y": "1"}, '<R X="a\nb"/>': {"X": "a b"}, "<R X='a=\"b\"' b=\"c\">": {"X": 'a="b"', "b": "c"}, '<R X="a < b">': {}, "<R/>": {}, "": {}}
    got = {r.t: r.a or {} for r in spark.createDataFrame([(t,) for t in cases], "t string").select("t", rois._by_name(rois._attributes(F.col("t"))).alias("a")).collect()}
    assert got == cases
