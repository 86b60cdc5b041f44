"""Queries on documents: orders are waypoints of customer groups, parts are shapes, JSON is built from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom.operators import integrity as I
from rasterloom.operators import stories as D

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


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 20)")
def j04_drop_orphans(spark, sf_dir):
    parts = table(spark, sf_dir, "part").where("p_size < 20")
    return I.drop_orphans(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_partkey", parts, "p_partkey")


@query("SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) THEN o_custkey END AS o_custkey FROM orders")
def j04_null_orphans(spark, sf_dir):
    return I.null_orphans(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", table(spark, sf_dir, "customer").where("c_acctbal > 0"), "c_custkey")


@query("SELECT DISTINCT 'waypoints' AS \"table\", CAST(o_custkey AS VARCHAR) AS key FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) UNION ALL SELECT DISTINCT 'rows', CAST(l_partkey AS VARCHAR) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 20)")
def j05_violations(spark, sf_dir):
    a = I.violations(table(spark, sf_dir, "orders"), "waypoints", "o_custkey", table(spark, sf_dir, "customer").where("c_acctbal > 0"), "c_custkey")
    return a.unionByName(I.violations(table(spark, sf_dir, "lineitem"), "rows", "l_partkey", table(spark, sf_dir, "part").where("p_size < 20"), "p_partkey"))


@query("SELECT o_orderkey, CAST(k AS INT) AS pos, p_partkey, p_name FROM (SELECT o_orderkey, unnest([0, 1, 2]) AS k FROM orders) JOIN part ON p_partkey = (o_orderkey * 7 + k * 13) % 300")
def j06_waypoint_shapes(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.array(*((F.col("o_orderkey") * 7 + k * 13) % 300 for k in range(3))).alias("ids"))
    return I.resolved(o, "o_orderkey", "ids", table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey").select("o_orderkey", "pos", "p_partkey", "p_name")


@query("""SELECT p_partkey AS id, p_partkey AS pos, CASE WHEN p_partkey % 3 = 0 THEN 'new' ELSE p_name END AS name FROM part
  UNION ALL SELECT s_suppkey + 1000000, (SELECT max(p_partkey) FROM part) + row_number() OVER (ORDER BY s_suppkey), s_name FROM supplier""")
def j07_overlay(spark, sf_dir):
    """Parts and suppliers have keys of their own, whatever their numbers."""
    key = lambda name, k: F.struct(F.lit(name).alias("of"), F.col(k).alias("k")).alias("key")
    p = table(spark, sf_dir, "part")
    base = p.select(key("part", "p_partkey"), F.col("p_partkey").alias("id"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("name"))
    over = p.where("p_partkey % 3 = 0").select(key("part", "p_partkey"), F.col("p_partkey").alias("id"), F.lit(0).cast("long").alias("pos"), F.lit("new").alias("name"))
    more = table(spark, sf_dir, "supplier").select(key("supplier", "s_suppkey"), (F.col("s_suppkey") + 1000000).alias("id"), F.col("s_suppkey").alias("pos"), F.col("s_name").alias("name"))
    return I.overlaid(base, over.unionByName(more), "key").drop("key")


@query("""SELECT coalesce(r.image, c.image) AS image, coalesce(r.width, 1) AS width, coalesce(r.height, 1) AS height, coalesce(c.channels, CAST([] AS BIGINT[])) AS channels
  FROM (SELECT r_regionkey AS image, r_regionkey + 10 AS width, r_regionkey + 20 AS height FROM region WHERE r_regionkey <> 2) r
  FULL JOIN (SELECT n_regionkey AS image, list(CAST(n_nationkey AS BIGINT) ORDER BY -n_nationkey) AS channels FROM nation WHERE n_regionkey <> 3 GROUP BY 1) c USING (image)""")
def j09_folded_channels(spark, sf_dir):
    images = table(spark, sf_dir, "region").where("r_regionkey <> 2").select(F.col("r_regionkey").alias("image"), (F.col("r_regionkey") + 10).alias("width"), (F.col("r_regionkey") + 20).alias("height"))
    flat = table(spark, sf_dir, "nation").where("n_regionkey <> 3").select(F.col("n_regionkey").alias("image"), (-F.col("n_nationkey")).alias("index"), F.col("n_nationkey").cast("long").alias("id"))
    return I.folded(images, flat)


@query("SELECT c_custkey, c_nationkey, min(o_orderkey) AS id FROM customer LEFT JOIN orders ON o_custkey % 25 = c_nationkey AND o_orderkey % 3 = c_custkey % 3 GROUP BY ALL")
def j10_first_match(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", (F.col("c_custkey") % 3).alias("k"))
    right = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 25).cast("int").alias("c_nationkey"), (F.col("o_orderkey") % 3).alias("k"), F.col("o_orderkey").alias("id"))
    return I.first_match(rows, ["c_nationkey", "k"], right, "id", "id").select("c_custkey", "c_nationkey", "id")


_UUID_SQL = "concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-5', substr(h, 14, 3), '-8', substr(h, 18, 3), '-', substr(h, 21, 12))"


@query(f"SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN printf('%08x-0000-4000-8000-000000000000', o_custkey) ELSE {_UUID_SQL} END AS customer FROM (SELECT o_orderkey, o_custkey, sha256('c' || o_custkey) AS h FROM orders)")
def j11_id_rewrite(spark, sf_dir):
    k = F.col("o_custkey")
    own = F.when(k % 2 == 0, F.format_string("%08x-0000-4000-8000-000000000000", k)).otherwise(F.concat(F.lit("c"), k.cast("string")))
    o = table(spark, sf_dir, "orders").select("o_orderkey", own.alias("customer"))
    return I.rewritten(o, "customer", I.id_dictionary((o, "customer")))


@query("SELECT p_partkey, p_partkey % 3 = 0 AS ok FROM part")
def p24_uuid_predicate(spark, sf_dir):
    k = F.col("p_partkey")
    text = F.when(k % 3 == 0, F.format_string("%08X-1111-1111-A111-111111111111", k)).when(k % 3 == 1, F.format_string("%08x-1111-9111-a111-111111111111", k)).otherwise("x")
    return table(spark, sf_dir, "part").select("p_partkey", I.is_uuid(text).alias("ok"))


@query("SELECT o_orderkey, min(c_custkey) AS \"group\" FROM orders LEFT JOIN customer ON c_mktsegment = CASE o_orderkey % 6 WHEN 0 THEN 'MACHINERY' WHEN 1 THEN 'FURNITURE' WHEN 2 THEN 'nothing' ELSE 'HOUSEHOLD' END GROUP BY 1")
def j15_group_by_name(spark, sf_dir):
    k = F.col("o_orderkey") % 6
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(k == 0, "MACHINERY").when(k == 1, "FURNITURE").when(k == 2, "nothing").otherwise("HOUSEHOLD").alias("name"))
    right = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name"), F.col("c_custkey").alias("group"))
    return I.first_match(rows, ["name"], right, "group", "group").select("o_orderkey", "group")


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'fresh' ELSE p_name END AS name FROM part WHERE NOT (p_partkey % 2 = 0 AND p_partkey % 3 <> 0 AND p_partkey % 5 <> 0)")
def t03_shape_merge(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return I.merged_shapes(p, p.where("id % 2 = 0").select("id"), p.where("id % 3 = 0").select("id"), p.where("id % 5 = 0").withColumn("name", F.lit("fresh")))


@query("SELECT c_custkey AS row, c_mktsegment AS \"group\", CAST(c_nationkey AS BIGINT) AS channel FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def t05_remove_image(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row"), F.col("c_mktsegment").alias("group"), F.col("c_nationkey").cast("long").alias("channel"))
    ch = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").alias("image"))
    return I.without_image(rows, ch, 1).select("row", "group", "channel")


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN -1 ELSE greatest(0, least(p_size - 10, p_size % 4 - 1)) END AS at FROM part")
def t08_clamped_indices(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", I.clamped_index(F.col("p_size") - 10, F.col("p_size") % 4).alias("at"))


@query("SELECT o_orderkey, list_distinct_in_order AS ids FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 3 THEN [3, 5, 1, 2] WHEN o_orderkey % 7 = 5 THEN [5, 1, 2, 3] ELSE [o_orderkey % 7, 1, 2, 3, 5] END AS list_distinct_in_order FROM orders WHERE o_orderkey % 7 NOT IN (1, 2))")
def t09_preferred_first(spark, sf_dir):
    k = F.col("o_orderkey") % 7
    o = table(spark, sf_dir, "orders").where(~k.isin(1, 2))
    rest = F.when(k == 5, F.array(*(F.lit(x).cast("long") for x in (1, 2, 3)))).when(k == 3, F.array(*(F.lit(x).cast("long") for x in (5, 1, 2)))).otherwise(F.array(*(F.lit(x).cast("long") for x in (1, 2, 3, 5))))
    return o.select("o_orderkey", F.array_union(F.array(k), rest).alias("ids"))


@query("SELECT page_id FROM pages WHERE page_id NOT IN (SELECT page_id FROM pages WHERE page_id % 4 = 1)")
def t02_set_difference(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id")
    return p.subtract(p.where("page_id % 4 = 1"))


@query("SELECT p_partkey FROM part WHERE NOT (lower(trim(p_name)) = 'red widget' AND p_type = 'SMALL')")
def t06_drop_same_basename(spark, sf_dir):
    return table(spark, sf_dir, "part").where(~((F.lower(F.trim("p_name")) == "red widget") & (F.col("p_type") == "SMALL"))).select("p_partkey")


# -- documents as JSON


def _documents(spark, sf_dir):
    """A document for each order, in three spellings."""
    k = F.col("o_orderkey")
    text = lambda c: c.cast("string")
    old = F.struct(F.concat(F.lit("w"), text(k)).alias("id"), F.array(F.concat(F.lit("s"), text(k))).alias("shapes"), F.concat(F.lit("g"), text(F.col("o_custkey"))).alias("group"), F.col("o_orderpriority").alias("name"))
    new = F.struct(F.concat(F.lit("w"), text(k)).alias("id"), F.array(F.concat(F.lit("s"), text(k))).alias("shapeIds"), F.concat(F.lit("g"), text(F.col("o_custkey"))).alias("groupId"), F.col("o_orderpriority").alias("title"), F.lit("t").alias("thumbnail"))
    pt = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    arrow = F.struct(F.concat(F.lit("s"), text(k)).alias("uuid"), F.lit("arrow").alias("type"), pt(F.lit(0), F.lit(0)).alias("from"), pt(k % 3, k % 2).alias("to"), F.lit("a").alias("text"))
    group = F.array(F.struct(F.lit("1").alias("id"), F.col("o_orderstatus").alias("name")))
    doc = F.when(k % 3 == 0, F.to_json(F.struct(F.array(new).alias("waypoints"), F.array(arrow).alias("shapes"), group.alias("channelGroups")))).when(k % 3 == 1, F.to_json(F.struct(F.array(old).alias("waypoints"), F.array(arrow).alias("shapes"), group.alias("groups")))).otherwise(
        F.to_json(F.struct(F.lit("2").alias("version"), F.array(old).alias("waypoints"), F.array(arrow).alias("shapes")))
    )
    return D.parsed(table(spark, sf_dir, "orders").select("o_orderkey", doc.alias("json")), "json")


@query("SELECT o_orderkey, ['modern', 'groups', 'export'][CAST(o_orderkey % 3 AS INT) + 1] AS variant, CASE WHEN o_orderkey % 3 < 2 THEN o_orderstatus END AS first_group FROM orders")
def f85_document_variants(spark, sf_dir):
    d = F.col("doc")
    return _documents(spark, sf_dir).select("o_orderkey", D.variant(d).alias("variant"), F.get(D.groups_of(d), 0)["name"].alias("first_group"))


@query("SELECT o_orderkey, 'w' || o_orderkey AS id, 'g' || o_custkey AS group_id, CASE WHEN o_orderkey % 3 = 0 THEN 't' ELSE '' END AS thumbnail, o_orderpriority AS title, '' AS content, ['s' || o_orderkey] AS shape_ids FROM orders")
def f83_waypoint_keys(spark, sf_dir):
    return _documents(spark, sf_dir).select("o_orderkey", F.explode(F.transform(F.col("doc.waypoints"), D.waypoint)).alias("w")).select("o_orderkey", "w.*")


@query("SELECT o_orderkey, 's' || o_orderkey AS id, 'arrow' AS type, CAST(o_orderkey % 3 AS DOUBLE) AS x, CAST(o_orderkey % 2 AS DOUBLE) AS y, CASE WHEN o_orderkey % 6 = 0 THEN 0.0 ELSE round(atan2(CAST(-(o_orderkey % 2) AS DOUBLE), CAST(-(o_orderkey % 3) AS DOUBLE)), 9) END AS angle, 'a' AS label FROM orders")
def f84_shape_keys(spark, sf_dir):
    s = _documents(spark, sf_dir).select("o_orderkey", F.explode(F.transform(F.col("doc.shapes"), D.shape)).alias("s"))
    return s.select("o_orderkey", "s.id", "s.type", F.col("s.point.x").alias("x"), F.col("s.point.y").alias("y"), F.round("s.angle", 9).alias("angle"), "s.label")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END AS created, CASE WHEN o_orderkey % 3 = 0 THEN 'c' END AS modified, CASE WHEN o_orderkey % 4 = 0 THEN ['x', 'y'] END AS keywords FROM orders")
def f81_f86_metadata(spark, sf_dir):
    k = F.col("o_orderkey")
    words = F.when(k % 4 == 0, F.array(F.lit(" x "), F.lit(""), F.lit("y"))).when(k % 4 == 1, F.array(F.lit(" ")))
    meta = F.when(k % 2 == 0, F.struct(F.lit("a").alias("createdAt"), F.lit("zz").alias("created"), F.when(k % 3 == 0, "c").alias("modified"), words.alias("keywords"))).otherwise(F.struct(F.lit(None).cast("string").alias("createdAt"), F.lit("b").alias("created"), F.when(k % 3 == 0, "c").alias("modified"), words.alias("keywords")))
    d = D.parsed(table(spark, sf_dir, "orders").select("o_orderkey", F.to_json(F.struct(meta.alias("metadata"))).alias("json")), "json")
    created, modified = D.metadata_dates(F.col("doc"))
    return d.select("o_orderkey", created.alias("created"), modified.alias("modified"), D.clean_list(F.col("doc.metadata.keywords")).alias("keywords"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN CASE WHEN p_size % 4 < 3 THEN 'polygon needs 3 points' END WHEN 1 THEN CASE WHEN p_size % 4 < 2 THEN 'polyline needs 2 points' END WHEN 2 THEN 'no point' WHEN 3 THEN 'unknown type' END AS wrong FROM part")
def f88_shape_violations(spark, sf_dir):
    k = F.col("p_partkey") % 5
    point = F.struct(F.lit(1.0).alias("x"), F.lit(2.0).alias("y"))
    s = F.struct(F.when(k == 0, "polygon").when(k == 1, "polyline").when(k == 3, "blob").otherwise("text").alias("type"), F.when(k == 4, point).alias("point"), F.array_repeat(point, F.col("p_size") % 4).alias("points"))
    return table(spark, sf_dir, "part").select("p_partkey", s.alias("s")).select("p_partkey", D.shape_violations(F.col("s")).alias("wrong"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'given' WHEN c_custkey % 2 = 0 THEN 'c' || c_custkey ELSE 'c' || c_custkey END AS created, CASE WHEN c_custkey % 2 = 0 THEN 'now' ELSE 'm' || c_custkey END AS modified, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE c_name END AS title FROM customer
  UNION ALL SELECT s_suppkey + 1000000, 'now', 'now', 'new' FROM supplier""")
def k09_k10_story_upsert(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    stories = c.select(k.alias("id"), F.concat(F.lit("c"), k.cast("string")).alias("created"), F.concat(F.lit("m"), k.cast("string")).alias("modified"), F.col("c_name").alias("title"))
    fresh = c.where("c_custkey % 2 = 0").select(k.alias("id"), F.when(k % 4 == 0, "given").alias("created"), F.lit("now").alias("now"), F.lit("new").alias("title"))
    more = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1000000).alias("id"), F.lit(None).cast("string").alias("created"), F.lit("now").alias("now"), F.lit("new").alias("title"))
    return D.upserted(stories, fresh.unionByName(more))


@query("SELECT event_id FROM (SELECT event_id FROM events ORDER BY ts DESC, event_id LIMIT 1)")
def o05_o06_active_story(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("modified"))
    return D.active_story(e, "-5").select(F.col("id").alias("event_id"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'Untitled' ELSE c_name END AS title FROM customer")
def p25_story_titles(spark, sf_dir):
    k = F.col("c_custkey") % 3
    return table(spark, sf_dir, "customer").select("c_custkey", D.summary_title(F.when(k == 0, "  ").otherwise(F.concat(F.lit(" "), "c_name", F.lit(" ")))).alias("title"))


@query("SELECT c_name FROM customer WHERE starts_with(c_name, 'Customer#00000001')")
def s26_prefix_range(spark, sf_dir):
    return D.with_prefix(table(spark, sf_dir, "customer").select("c_name"), "c_name", "Customer#00000001")
