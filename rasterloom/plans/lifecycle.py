"""Queries on what a document goes through: palettes and limits, imports and replacements, export plans, older forms, copies."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom.operators import imports as M
from rasterloom.operators import legacy as L
from rasterloom.operators import palette as P
from rasterloom.operators import statistics as S

from .documents import _UUID_SQL
from .raster import plane, table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# -- limits and palettes; tests/test_lifecycle.py compares the fits with brute force


@query()
def a04_mixture_limits(spark, sf_dir):
    return S.mixture_limits(plane(spark, sf_dir))


def _palettes(spark, sf_dir):
    """The customers of a nation and segment as channels, the first five of them, in colours of their own."""
    k = F.col("c_custkey")
    colour = F.struct((k * 37 % 256).alias("r"), (k * 59 % 256).alias("g"), (k * 83 % 256).alias("b"))
    rows = table(spark, sf_dir, "customer").groupBy((F.col("c_nationkey") % 5).alias("group")).agg(F.slice(F.sort_array(F.collect_set(F.struct((k % 5).alias("k"), colour.alias("c"), (k % 3 == 0).alias("l")))), 1, 5).alias("x"))
    return rows.select("group", F.transform("x", lambda x: x["c"]).alias("colours"), F.transform("x", lambda x: x["l"]).alias("locked"))


@query("SELECT DISTINCT c_nationkey % 5 AS \"group\", CAST(5 AS INT) AS n, true AS locked_kept, true AS not_nearer FROM customer")
def f34_spread_palettes(spark, sf_dir):
    """Locked colours are as they were, and no two colours are nearer than the nearest were."""
    g = _palettes(spark, sf_dir)
    found = P.optimised(g).join(g.withColumnRenamed("colours", "before"), "group")
    as_before = F.forall(F.arrays_zip("colours", "before", "locked"), lambda x: ~x["locked"] | ((x["colours"]["r"] == x["before"]["r"]) & (x["colours"]["g"] == x["before"]["g"]) & (x["colours"]["b"] == x["before"]["b"])))
    lab = F.transform("before", lambda c: F.struct(P.oklab(c["r"], c["g"], c["b"]).alias("lab")))
    return found.select("group", F.size("colours").alias("n"), as_before.alias("locked_kept"), (F.col("spread") >= P.spread(lab)).alias("not_nearer"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 OR c_custkey % 5 > 2 OR c_mktsegment = 'MACHINERY' THEN c_nationkey ELSE length(c_mktsegment) * 100 + c_custkey % 5 END AS colour FROM customer")
def f35_applied_palettes(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    rows = c.select("c_custkey", F.col("c_mktsegment").alias("group"), (F.col("c_custkey") % 5).alias("pos"), (F.col("c_custkey") % 3 == 0).alias("locked"), F.col("c_nationkey").alias("colour"))
    palette = c.where("c_mktsegment <> 'MACHINERY'").select(F.col("c_mktsegment").alias("group")).distinct().withColumn("colours", F.array(*(F.length("group") * 100 + k for k in range(3))))
    return P.applied(rows, palette).select("c_custkey", "colour")


@query("SELECT o_custkey AS document, bool_and(o_orderkey % 40 <> 0 AND o_orderkey % 30 BETWEEN 1 AND 4) AS \"default\" FROM orders WHERE o_orderkey % 30 < 6 GROUP BY 1")
def f36_default_grouping(spark, sf_dir):
    k = F.col("o_orderkey")
    name = F.when(k % 40 == 0, F.concat(F.lit("Group x"), k.cast("string"))).otherwise(F.concat(F.lit("Group "), k.cast("string")))
    return P.default_grouping(table(spark, sf_dir, "orders").where(k % 30 < 6).select(F.col("o_custkey").alias("document"), name.alias("name"), (k % 30).alias("n")))


# -- imports: orders are images, their lines channels


def _lines(spark, sf_dir):
    n, p = F.col("l_linenumber"), F.col("l_partkey")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("image"), n.alias("index"), F.when(n % 3 == 0, "").otherwise(F.col("l_returnflag")).alias("name"), F.when(p % 2 == 0, 3).otherwise(1).alias("samples"), F.when(p % 4 == 0, "Uint8").otherwise("Uint16").alias("dtype"), p.alias("part"), F.col("l_quantity").alias("lower"),
    )


@query("""SELECT l_orderkey AS image, l_linenumber AS index, CASE WHEN count(*) OVER (PARTITION BY l_orderkey) = 1 AND l_partkey % 4 = 0 THEN 'H&E' WHEN l_linenumber % 3 = 0 THEN 'Channel ' || (l_linenumber + 1) ELSE l_returnflag END AS name,
  'channel' AS kind, CASE WHEN l_partkey % 2 = 0 THEN 3 ELSE 1 END AS samples FROM lineitem""")
def m02_extracted_channels(spark, sf_dir):
    return M.extracted(_lines(spark, sf_dir))


@query("""WITH i AS (SELECT c_nationkey AS document, c_custkey AS pos, 'c' || c_custkey AS image, c_name AS basename, 'intensity' AS role, 10 AS width, 20 AS height, CAST(1 AS BIGINT) AS n_channels FROM customer WHERE c_nationkey % 4 <> 3)
  SELECT * FROM i UNION ALL SELECT s_nationkey, coalesce((SELECT max(pos) FROM i WHERE document = s_nationkey), -1) + row_number() OVER (PARTITION BY s_nationkey ORDER BY -s_suppkey), 's' || s_suppkey, s_name, 'segmentation', 30, 40, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey AND l_linenumber < 3) FROM supplier""")
def m01_m03_imported_images(spark, sf_dir):
    images = table(spark, sf_dir, "customer").where("c_nationkey % 4 <> 3").select(F.col("c_nationkey").alias("document"), F.col("c_custkey").alias("pos"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("image"), F.col("c_name").alias("basename"), F.lit("intensity").alias("role"), F.lit(10).alias("width"), F.lit(20).alias("height"), F.lit(1).cast("long").alias("n_channels"))
    name = lambda c: F.concat(F.lit("s"), F.col(c).cast("string")).alias("image")
    fresh = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("document"), (-F.col("s_suppkey")).alias("order"), name("s_suppkey"), F.col("s_name").alias("basename"), F.lit("segmentation").alias("role"), F.lit(30).alias("width"), F.lit(40).alias("height"))
    return M.imported(images, fresh, table(spark, sf_dir, "lineitem").where("l_linenumber < 3").select(name("l_suppkey")))


@query("SELECT p_partkey, CAST(CASE WHEN p_size % 3 > 0 THEN p_size % 3 WHEN p_size > 10 THEN p_size END AS DOUBLE) AS side FROM part")
def m04_m05_sizes(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", M.pixel_size((F.col("p_size") % 3).cast("double"), F.when(F.col("p_size") > 10, F.col("p_size")).cast("double")).alias("side"))


def _replaced(spark, sf_dir):
    """Every fourth order is replaced by one whose lines have other indices; a third of those lack a line; some don't exist."""
    o, lines = table(spark, sf_dir, "orders"), _lines(spark, sf_dir).groupBy("image", "index").agg(*(F.max(c).alias(c) for c in ("name", "part", "lower")))
    images = o.select(F.col("o_orderkey").alias("image"), F.col("o_custkey").alias("pos"), F.when(F.col("o_orderkey") % 8 == 0, "mask").alias("role"), F.col("o_orderstatus").alias("basename"))
    channels = lines.select("image", (F.col("image") * 10 + F.col("index")).alias("id"), "index", "name", F.when(F.col("part") % 2 == 0, "mask").alias("kind"), F.when(F.col("part") % 3 == 0, F.col("lower")).alias("lower"))
    old = o.where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("old"), (F.col("o_orderkey") + 100_000_000).alias("image"))
    swaps = old.unionByName(table(spark, sf_dir, "supplier").select((-F.col("s_suppkey") - 1).alias("old"), (F.col("s_suppkey") + 900_000_000).alias("image")))
    fresh = old.select("image", F.lit(-1).cast("long").alias("pos"), F.lit("image").alias("role"), F.lit("new").alias("basename"))
    some = lines.where("image % 4 = 0 AND NOT (image % 12 = 0 AND index = 1)")
    new = some.select((F.col("image") + 100_000_000).alias("image"), (-F.col("image") * 10 - F.col("index")).alias("id"), (F.col("index") * 7).alias("index"), F.lit("other").alias("name"), F.lit("channel").alias("kind"), (F.col("lower") + 0.5).alias("lower"))
    return M.replaced(images, channels, swaps, fresh, new)


_SWAPS = """old_lines AS (SELECT l_orderkey AS image, l_orderkey * 10 + l_linenumber AS id, l_linenumber AS index, CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE l_returnflag END AS name, CASE WHEN l_partkey % 2 = 0 THEN 'mask' END AS kind, CASE WHEN l_partkey % 3 = 0 THEN l_quantity END AS lower, l_quantity FROM (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS l_returnflag, max(l_partkey) AS l_partkey, max(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL)),
  counts AS (SELECT o_orderkey AS old, (SELECT count(*) FROM old_lines WHERE image = o_orderkey) AS expected, (SELECT count(*) FROM old_lines WHERE image = o_orderkey AND NOT (image % 12 = 0 AND index = 1)) AS got FROM orders WHERE o_orderkey % 4 = 0),
  good AS (SELECT old FROM counts WHERE expected = got)"""


@query(f"""WITH {_SWAPS} SELECT CASE WHEN old IS NULL THEN o_orderkey ELSE o_orderkey + 100000000 END AS image, o_custkey AS pos, CASE WHEN o_orderkey % 8 = 0 THEN 'mask' WHEN old IS NOT NULL THEN 'image' END AS role, CASE WHEN old IS NULL THEN o_orderstatus ELSE 'new' END AS basename
  FROM orders LEFT JOIN good ON old = o_orderkey""")
def m06_replaced_images(spark, sf_dir):
    return _replaced(spark, sf_dir)[0]


@query(f"""WITH {_SWAPS} SELECT CASE WHEN old IS NULL THEN image ELSE image + 100000000 END AS image, id, CASE WHEN old IS NULL THEN index ELSE index * 7 END AS index, name, CASE WHEN old IS NULL THEN kind ELSE coalesce(kind, 'channel') END AS kind, CASE WHEN old IS NULL THEN lower ELSE coalesce(lower, l_quantity + 0.5) END AS lower
  FROM old_lines LEFT JOIN good ON old = image""")
def m06_replaced_channels(spark, sf_dir):
    return _replaced(spark, sf_dir)[1]


@query(f"""WITH {_SWAPS} SELECT old, old + 100000000 AS image, 'expected ' || expected || ' channels, got ' || got AS reason FROM counts WHERE expected <> got UNION ALL SELECT -s_suppkey - 1, s_suppkey + 900000000, 'missing' FROM supplier""")
def m06_refused_images(spark, sf_dir):
    return _replaced(spark, sf_dir)[2]


def _grouped(spark, sf_dir):
    groups = table(spark, sf_dir, "nation").where("n_regionkey <> 2").select(F.col("n_regionkey").alias("document"), F.col("n_nationkey").cast("string").alias("group"), F.col("n_nationkey").alias("pos"), F.col("n_name").alias("name"), (F.col("n_nationkey") % 2 == 0).alias("expanded"))
    visible = table(spark, sf_dir, "customer").where("c_nationkey % 5 <> 3").select((F.col("c_nationkey") % 5).alias("document"), F.col("c_custkey").alias("pos"), F.col("c_custkey").alias("channel"))
    return groups, visible


@query("""WITH g AS (SELECT n_regionkey AS document, CAST(n_nationkey AS VARCHAR) AS "group", n_nationkey AS pos, n_name AS name, n_regionkey = 3 AND n_nationkey % 2 = 0 AS expanded FROM nation WHERE n_regionkey <> 2)
  SELECT * FROM g UNION ALL SELECT r, 'group-' || r || '-' || (n + 1), last + 1, 'Group ' || (n + 1), true FROM (SELECT r_regionkey AS r, (SELECT count(*) FROM g WHERE document = r_regionkey) AS n, coalesce((SELECT max(pos) FROM g WHERE document = r_regionkey), -1) AS last FROM region WHERE r_regionkey <> 3)""")
def m09_groups(spark, sf_dir):
    return M.new_group(*_grouped(spark, sf_dir))[0]


@query("SELECT 2 AS document, 'group-2-1' AS \"group\", c_custkey AS pos, c_custkey AS channel FROM customer WHERE c_nationkey % 5 = 2")
def m09_first_group_rows(spark, sf_dir):
    return M.new_group(*_grouped(spark, sf_dir))[1]


@query("SELECT document, CASE WHEN \"group\" % 3 = 0 THEN (SELECT CAST(min(n_nationkey) AS VARCHAR) FROM nation WHERE n_regionkey = document AND n_nationkey % 3 <> 0 AND document <> 4) ELSE CAST(\"group\" AS VARCHAR) END AS \"group\" FROM (SELECT n_regionkey AS document, max(n_nationkey) AS \"group\" FROM nation GROUP BY 1)")
def m12_active_groups(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("document"), F.col("n_nationkey").alias("pos"), F.col("n_nationkey").cast("string").alias("group"))
    gone = n.where("pos % 3 = 0 OR document = 4").select("document", "group")
    active = n.groupBy("document").agg(F.max("pos").cast("string").alias("group"))
    return M.without_group(n, gone.where("document <> 4 OR group % 3 = 0").unionByName(gone.where("document = 4 AND group % 3 <> 0")), active)[1]


@query("SELECT n_regionkey AS document, CAST(n_nationkey AS VARCHAR) AS \"group\", CASE WHEN n_regionkey = 1 THEN n_nationkey % 2 = 0 ELSE n_nationkey = (SELECT max(m.n_nationkey) FROM nation m WHERE m.n_regionkey = n.n_regionkey) END AS expanded FROM nation n")
def m12_activated_groups(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("document"), F.col("n_nationkey").cast("string").alias("group"), (F.col("n_nationkey") % 2 == 0).alias("expanded"))
    chosen = table(spark, sf_dir, "nation").where("n_regionkey <> 1").groupBy(F.col("n_regionkey").alias("document")).agg(F.max("n_nationkey").cast("string").alias("group"))
    return M.activated(n, chosen)


# -- export plans


@query("""WITH r AS (SELECT c_custkey, c_nationkey, c_custkey % 100 AS lo, c_custkey % 100 + 500 AS hi FROM customer WHERE c_nationkey % 4 <> 1)
  SELECT CAST(c_custkey AS BIGINT) AS "group", c_nationkey AS channel, c_nationkey % 7 AS c, sha256('{"channelId":' || c_nationkey || ',"lowerLimit":' || lo || ',"upperLimit":' || hi || '}') AS folder, '{"channel":' || c_nationkey % 7 || ',"channelId":' || c_nationkey || ',"lowerLimit":' || lo || ',"upperLimit":' || hi || '}' AS settings FROM r""")
def k03_export_folders(spark, sf_dir):
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k.cast("long").alias("group"), F.col("c_nationkey").alias("channel"), (k % 100).alias("lower"), (k % 100 + 500).alias("upper"))
    return M.export_folders(rows, table(spark, sf_dir, "nation").where("n_nationkey % 4 <> 1").select(F.col("n_nationkey").alias("id"), (F.col("n_nationkey") % 7).alias("index")))


def _exported(spark, sf_dir):
    images = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("image"), F.col("r_name").alias("basename"))
    channels = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("image"), F.col("n_nationkey").alias("id"), (-F.col("n_nationkey")).alias("index"), F.when(F.col("n_nationkey") % 5 == 0, "mask").alias("kind"))
    return images, channels


@query("""SELECT r_regionkey AS image, r_name AS basename, list(n_nationkey ORDER BY -n_nationkey) AS channels, CAST(count(*) * (SELECT sum(ceil(l * 100 / 32.0) * ceil(70 / 32.0)) FROM range(1, 4) t(l)) AS BIGINT) AS tiles FROM region JOIN nation ON n_regionkey = r_regionkey
  WHERE n_nationkey % 5 <> 0 AND n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey % 3 = 0) AND r_regionkey <> 4 GROUP BY ALL""")
def j16_export_work(spark, sf_dir):
    images, channels = _exported(spark, sf_dir)
    loaders = images.where("image <> 4").select("image", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("level")).select("image", "level", (F.col("level") * 100).alias("width"), F.lit(70).alias("height"), F.lit(32).alias("tile"))
    return M.export_work(loaders, images, channels, table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_nationkey").alias("channel")))


@query("SELECT n_regionkey AS image, list(struct_pack(index := -n_nationkey, channel := n_nationkey) ORDER BY c_custkey) AS channels FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey <> 1 AND c_custkey % 10 = 0 GROUP BY 1")
def j17_requested_channels(spark, sf_dir):
    images, channels = _exported(spark, sf_dir)
    requests = table(spark, sf_dir, "customer").where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("pos"), F.col("c_nationkey").alias("channel"))
    return M.requested(requests, channels, images.where("image <> 1"))


# -- older documents


def _snapshots(spark, sf_dir):
    """A snapshot for each order, from its lines: the channels of two images, of which one isn't listed; every fifth has nested channels."""
    k = F.col("o_orderkey")
    text = lambda *c: F.concat(*(x if not isinstance(x, str) else F.lit(x) for x in c))
    channel = lambda n, i, image: F.struct(text("ch", (k % 3 + n).cast("string")).alias("id"), text("n", str(i)).alias("Name"), F.lit(i).alias("SourceIndex"), F.lit(1).alias("Samples"), F.lit(image).alias("sourceImageId"))
    group = F.struct(F.lit("g").alias("id"), F.col("o_orderstatus").alias("Name"), F.struct((k % 2 == 0).alias("Expanded")).alias("State"), F.array(F.struct(F.lit("r").alias("id"), F.lit("ch1").alias("sourceChannelId"), F.struct((k % 256).alias("R"), F.lit(2).alias("G"), F.lit(3).alias("B")).alias("Color"), F.lit(0.5).alias("LowerRange"), (k % 9).cast("double").alias("UpperRange"))).alias("GroupChannels"))
    image = F.struct(F.lit("a").alias("uuid"), F.lit(7).alias("sizeX"), F.lit(8).alias("sizeY"), F.lit(2).alias("sizeC"), F.when(k % 5 == 0, F.array(F.lit("x"))).alias("channels"))
    d = F.struct((k % 4 * 100).alias("imageWidth"), F.lit(50).alias("imageHeight"), F.array(F.struct(F.lit("w").alias("id"))).alias("waypoints"), F.array(F.struct(F.lit("s").alias("id"))).alias("shapes"), F.array(group).alias("groups"), F.array(channel(0, 0, "a"), channel(1, 1, "b"), channel(0, 2, "a"), channel(2, 3, "b")).alias("sourceChannels"), F.array(image).alias("images"))
    doc = F.from_json(F.to_json(d), L.SNAPSHOT)
    return table(spark, sf_dir, "orders").select("o_orderkey", doc.alias("d")).where(L.is_snapshot(F.col("d")))


@query("""WITH o AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 5 <> 0)
  SELECT k AS o_orderkey, 0 AS pos, 'a' AS id, CASE WHEN k % 4 > 0 THEN k % 4 * 100 ELSE 7 END AS width, CASE WHEN k % 4 > 0 THEN 50 ELSE 8 END AS height, ['ch' || k % 3] AS channels, ['n0'] AS names, [0] AS indices FROM o
  UNION ALL SELECT k, 1, 'b', 1, 1, ['ch' || (k % 3 + 1), 'ch' || (k % 3 + 2)], ['n1', 'n3'], [1, 3] FROM o""")
def f87_snapshot_images(spark, sf_dir):
    i = _snapshots(spark, sf_dir).select("o_orderkey", F.posexplode(L.snapshot_images(F.col("d"))).alias("pos", "i"))
    each = lambda f: F.transform("i.channels", lambda c: c[f])
    return i.select("o_orderkey", "pos", "i.id", "i.width", "i.height", each("id").alias("channels"), each("name").alias("names"), each("index").alias("indices"))


@query("SELECT o_orderkey, 'g' AS id, o_orderstatus AS name, o_orderkey % 2 = 0 AS expanded, 'ch1' AS channel, CAST(o_orderkey % 256 AS INT) AS r, CAST(0.5 AS DOUBLE) AS lower, CAST(o_orderkey % 9 AS DOUBLE) AS upper FROM orders WHERE o_orderkey % 5 <> 0")
def f87_snapshot_groups(spark, sf_dir):
    g = _snapshots(spark, sf_dir).select("o_orderkey", F.explode(L.snapshot_groups(F.col("d"))).alias("g")).select("o_orderkey", "g.id", "g.name", "g.expanded", F.explode("g.rows").alias("r"))
    return g.select("o_orderkey", "id", "name", "expanded", F.col("r.channel").alias("channel"), F.col("r.colour.r").alias("r"), F.col("r.lower").alias("lower"), F.col("r.upper").alias("upper"))


def _exhibits(spark, sf_dir):
    k = F.col("c_custkey")
    group = lambda name, names, colours: F.struct(name.alias("Name"), F.array(*(F.lit(x) for x in names)).alias("Channels"), F.array(*(F.lit(x) for x in colours)).alias("Colors"))
    way = lambda n, g, lens: F.struct(F.lit(n).alias("Name"), F.col("c_name").alias("Description"), g.alias("Group"), (k % 5).cast("double").alias("Zoom"), F.array(k % 7 / 2, F.lit(0.25)).alias("Pan"), lens.alias("Lensing"))
    lens = F.when(k % 2 == 0, F.struct(F.lit("one").alias("group")))
    d = F.struct(F.col("c_name").alias("Name"), F.array(group(F.lit("one"), "abc", ["f00", "0f0"]), group(F.col("c_mktsegment"), "d", ["00f", "fff"])).alias("Groups"), F.array(F.struct(F.array(way("w0", F.col("c_mktsegment"), lens), way("w1", F.lit("none"), F.when(F.lit(False), lens))).alias("Waypoints"))).alias("Stories"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.to_json(d).alias("json"))


@query("""SELECT c_custkey, 0 AS story, CAST(n AS INT) AS pos, 'w' || n AS name, c_name AS content, CASE WHEN n = 0 THEN 1 ELSE -1 END AS "group", CASE WHEN n = 0 AND c_custkey % 2 = 0 THEN 0 END AS lens, CAST(c_custkey % 5 AS DOUBLE) AS zoom, c_custkey % 7 / 2 AS x, CAST(0.25 AS DOUBLE) AS y FROM customer, range(2) t(n)""")
def f99_exhibit_waypoints(spark, sf_dir):
    return L.exhibit_waypoints(_exhibits(spark, sf_dir), "c_custkey", "json")


@query("""SELECT c_custkey, g AS "group", CASE WHEN g = 0 THEN 'one' ELSE c_mktsegment END AS group_name, pos, name, colour FROM customer, (VALUES (0, 0, 'a', 'f00'), (0, 1, 'b', '0f0'), (1, 0, 'd', '00f')) t(g, pos, name, colour)""")
def f99_exhibit_channels(spark, sf_dir):
    return L.exhibit_channels(_exhibits(spark, sf_dir), "c_custkey", "json")


@query("""WITH b AS (SELECT o_orderkey, o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN [1, 2, 3, 4] WHEN o_orderkey % 4 = 1 THEN [100 - 80 / 2 ** (o_orderkey % 3) / 2, 50 - 60 / 2 ** (o_orderkey % 3) / 2, 100 + 80 / 2 ** (o_orderkey % 3) / 2, 50 + 60 / 2 ** (o_orderkey % 3) / 2] WHEN o_orderkey % 4 = 2 THEN [0, 0, 900, 700] ELSE [0, 0, 1, 1] END AS v FROM orders)
  SELECT o_orderkey, CAST(v[1] AS DOUBLE) AS x0, CAST(v[2] AS DOUBLE) AS y0, CAST(v[3] AS DOUBLE) AS x1, CAST(v[4] AS DOUBLE) AS y1 FROM b""")
def f93_stored_waypoints(spark, sf_dir):
    """Bounds of waypoints after they were stored and read again: their own, of a view, of the image, or a unit square."""
    k = F.col("o_orderkey")
    own = F.when(k % 4 == 0, F.struct(*(F.lit(float(v)).alias(n) for v, n in zip((1, 2, 3, 4), ("x0", "y0", "x1", "y1")))))
    size = lambda n: F.when(k % 4 != 3, n).otherwise(0)
    shown = lambda n: F.when(k % 4 == 1, n).otherwise(0)
    v = L.stored_viewport(own, (k % 3).cast("double"), F.lit(100.0), F.lit(50.0), size(900), size(700), shown(80), shown(60))
    return table(spark, sf_dir, "orders").select("o_orderkey", L.authored_bounds(v).alias("b")).select("o_orderkey", "b.x0", "b.y0", "b.x1", "b.y1")


# -- stories and copies


@query("""SELECT o_orderkey, '{"version":"2","waypoints":[{"id":"w' || o_orderkey || '","title":"' || o_orderpriority || '","shapeIds":["s' || o_custkey || '"]}],"shapes":[{"id":"s' || o_custkey || '","type":"point"}]}' AS json FROM orders""")
def k11_story_exports(spark, sf_dir):
    s = F.concat(F.lit("s"), F.col("o_custkey").cast("string"))
    w = F.array(F.struct(F.concat(F.lit("w"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_orderpriority").alias("title"), F.array(s).alias("shapeIds")))
    return table(spark, sf_dir, "orders").select("o_orderkey", L.story_export(w, F.array(F.struct(s.alias("id"), F.lit("point").alias("type")))).alias("json"))


@query(f"""WITH s AS (SELECT p_partkey, p_size, i, sha256(p_partkey || '/' || i || '/' || CASE WHEN i = 0 THEN p_name ELSE 'q' END) AS h FROM part, range(2) t(i) WHERE p_partkey % 6 NOT IN (3, 4, 5))
  SELECT p_partkey, CAST(i AS INT) AS pos, {_UUID_SQL} AS id, CASE WHEN i = 1 THEN 'line' ELSE 'polygon' END AS type, CASE WHEN i = 0 THEN [[CAST(p_size AS DOUBLE), 2.0]] ELSE [] END AS points, true AS imported FROM s""")
def k12_f96_pasted_shapes(spark, sf_dir):
    """Shapes that were copied and pasted: in an older kind, with white space, of another kind, without a version, no JSON."""
    k = F.col("p_partkey") % 6
    point = F.array(F.array(F.col("p_size").cast("double"), F.lit(2.0)))
    shapes = F.array(F.struct(F.col("p_name").alias("id"), F.when(k == 0, "rectangle").otherwise("ellipse").alias("type"), point.alias("polygon")), F.struct(F.lit("q").alias("id"), F.lit("line").alias("type"), F.expr("cast(array() as array<array<double>>)").alias("polygon")))
    text = F.when(k == 0, L.copied(shapes, "shapes")).when(k == 1, L.copied(shapes, "old-shapes")).when(k == 2, F.concat(F.lit(" \n"), L.copied(shapes, "shapes"), F.lit("\n"))).when(k == 3, L.copied(shapes, "text")).when(k == 4, F.regexp_replace(L.copied(shapes, "shapes"), '"v":1,', "")).otherwise("plain {text")
    p = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(L.pasted(text, ["shapes", "old-shapes"], F.col("p_partkey"))).alias("pos", "s"))
    return p.select("p_partkey", "pos", "s.*")


@query(f"""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'id' || o_orderkey WHEN o_orderkey % 4 = 1 THEN {_UUID_SQL} END AS id, CASE WHEN o_orderkey % 4 < 2 THEN 1 END AS n_waypoints, CASE WHEN o_orderkey % 4 = 2 THEN 'not a document' WHEN o_orderkey % 4 = 3 THEN 'no waypoints' END AS error FROM (SELECT *, sha256(CAST(o_orderkey AS VARCHAR)) AS h FROM orders)""")
def s24_loaded_stories(spark, sf_dir):
    k = F.col("o_orderkey")
    meta = F.when(k % 4 == 0, F.struct(F.concat(F.lit("id"), k.cast("string")).alias("id")))
    json = F.when(k % 4 == 2, "<html>").when(k % 4 == 3, "{}").otherwise(F.to_json(F.struct(meta.alias("metadata"), F.array(F.struct(F.lit("w").alias("id"))).alias("waypoints"))))
    d = L.loaded(table(spark, sf_dir, "orders").select("o_orderkey", json.alias("json")), "o_orderkey", "json", "waypoints array<struct<id:string>>", lambda d: F.when(d["waypoints"].isNull(), "no waypoints"))
    return d.select("o_orderkey", "id", F.size("doc.waypoints").alias("n_waypoints"), "error").withColumn("n_waypoints", F.when(F.col("error").isNull(), F.col("n_waypoints")))


@query("SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) - 1 AS pos, o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'Untitled' ELSE o_orderpriority END AS title, o_orderdate AS modified FROM orders")
def s25_listed_stories(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 5 == 0, " ").otherwise(F.col("o_orderpriority")).alias("title"), F.col("o_orderdate").alias("modified"))
    return L.listed(o, "o_custkey")
