"""Queries on series, pyramids, exports, names and editing streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom.operators import exports as X
from rasterloom.sources import series as S
from rasterloom.streaming import autosave as A

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


_INSTANCES = "SELECT o_orderkey AS instance, o_orderkey % 100 AS series, CAST(o_custkey % 5 + 1 AS BIGINT) * 700 AS width, CAST(o_custkey % 3 + 1 AS BIGINT) * 500 AS height, CAST(256 AS BIGINT) AS columns, CAST(200 AS BIGINT) AS rows FROM orders"


def instances(spark, sf_dir):
    c = F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("instance"), (F.col("o_orderkey") % 100).alias("series"), ((c % 5 + 1) * 700).alias("width"), ((c % 3 + 1) * 500).alias("height"), F.lit(256).cast("long").alias("columns"), F.lit(200).cast("long").alias("rows"),
    )


@query(f"""WITH i AS (SELECT *, CAST(ceil(width / 256.0) AS BIGINT) AS nc, CAST(ceil(height / 200.0) AS BIGINT) AS nr FROM ({_INSTANCES})),
  k AS (SELECT i.*, c, chr(CAST(97 + c AS INT)) AS channel FROM i CROSS JOIN range(2) t(c))
  SELECT instance, (r + 1) || '-' || (q + 1) || '-' || channel AS key, CAST(((c * 2 + 1) * nr + r) * nc + q + 1 AS BIGINT) AS frame FROM k, range(8) a(r), range(14) b(q) WHERE r < nr AND q < nc""")
def s13_full_frames(spark, sf_dir):
    return S.full_frames(instances(spark, sf_dir).withColumn("planes", F.lit(2)).withColumn("channels", F.array(F.lit("a"), F.lit("b"))))


@query("SELECT l_orderkey AS instance, CAST(ceil(l_partkey / 16.0) AS BIGINT) || '-' || CAST(ceil(l_quantity / 8.0) AS BIGINT) || '-' || l_returnflag AS key, max(l_linenumber) AS frame FROM lineitem GROUP BY 1, 2")
def s13_sparse_frames(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return S.sparse_frames(l.select(F.col("l_orderkey").alias("instance"), F.col("l_linenumber").alias("frame"), F.col("l_quantity").alias("x"), F.col("l_partkey").alias("y"), F.lit(16).alias("rows"), F.lit(8).alias("columns"), F.col("l_returnflag").alias("channel")))


@query("SELECT p_partkey, 'c/' || p_brand || '/frames/' || p_size AS path FROM part")
def s12_frame_paths(spark, sf_dir):
    p = S.frame_path(F.concat(F.lit("a/b/c/"), "p_brand"), F.col("p_size"))
    return table(spark, sf_dir, "part").select("p_partkey", S.last_segments(p, 4).alias("path"))


@query("""WITH m AS (SELECT user_id AS instance, event_type AS label, min(event_id) AS f, list(event_id ORDER BY event_id) AS frames FROM events GROUP BY ALL)
  SELECT instance, label, frames, CAST(row_number() OVER (PARTITION BY instance ORDER BY f) AS INT) AS number FROM m""")
def s14_mapping_numbers(spark, sf_dir):
    return S.mapping_numbers(table(spark, sf_dir, "events").select(F.col("user_id").alias("instance"), F.col("event_type").alias("label"), F.col("event_id").alias("frame")))


@query(f"""WITH s AS (SELECT series, width, height, count(*) AS parts FROM ({_INSTANCES}) GROUP BY ALL), z AS (SELECT *, max(width) OVER (PARTITION BY series) / width AS zoom FROM s)
  SELECT series, CAST(row_number() OVER (PARTITION BY series ORDER BY width, height) - 1 AS INT) AS level, width, height, parts, CAST(ceil(width / 256.0) * ceil(height / 200.0) AS BIGINT) AS tiles, CASE WHEN zoom = floor(zoom) THEN zoom ELSE round(zoom, 2) END AS zoom FROM z""")
def s15_pyramids(spark, sf_dir):
    return S.pyramids(instances(spark, sf_dir))


@query("SELECT o_custkey AS series, d AS differs FROM (SELECT o_custkey, CASE WHEN count(DISTINCT o_orderstatus) > 1 THEN 'frame of reference' END AS a, CASE WHEN count(DISTINCT o_orderkey % 2) > 1 THEN 'container' END AS b, CASE WHEN count(DISTINCT o_orderkey % 3) > 1 THEN 'channels' END AS c FROM orders GROUP BY 1), unnest([a, b, c]) t(d) WHERE d IS NOT NULL")
def s15_a21_pyramid_errors(spark, sf_dir):
    k = F.col("o_orderkey")
    return S.pyramid_errors(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("series"), F.col("o_orderstatus").alias("reference"), (k % 2).alias("container"), (k % 3).alias("n_channels")))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = p_partkey // 16 THEN p_partkey % 16 ELSE 16 END AS extent, p_size % 2 = 0 OR (p_size % 3 = 0 AND p_partkey % 5 = 0) AS served FROM part")
def s05_s18_tiles(spark, sf_dir):
    k, n = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", S.tile_extent(F.lit(16), n % 4, k).alias("extent"), S.served_tile(n % 2 == 0, n % 3, k % 5).alias("served"))


@query("SELECT o_custkey AS plane, max(o_orderkey) AS level FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 50000 GROUP BY 1")
def s22_first_readable(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("plane"), F.col("o_orderkey").alias("level"), (F.col("o_orderstatus") == "F").alias("readable"), (F.col("o_totalprice") - 50000).alias("n_values"))
    return S.first_readable(o).select("plane", "level")


@query("SELECT DISTINCT CASE p_size % 4 WHEN 0 THEN 'series' WHEN 1 THEN 'folder' WHEN 2 THEN CASE WHEN p_type = 'SMALL' THEN 'mask' ELSE 'intensity' END END AS opener, CASE WHEN p_size % 4 = 0 THEN p_brand ELSE CAST(p_partkey AS VARCHAR) END AS key FROM part WHERE p_size % 4 <> 3")
def s01_s21_source_routing(spark, sf_dir):
    n = F.col("p_size") % 4
    return S.routed(table(spark, sf_dir, "part").select(F.when(n == 0, "dicomWeb").when(n == 1, "jpeg").when(n == 2, "url").otherwise("none").alias("kind"), F.when(F.col("p_type") == "SMALL", "mask").alias("role"), F.col("p_brand").alias("series"), F.col("p_partkey").alias("id")))


@query("""WITH i AS (SELECT DISTINCT n_regionkey AS image, (n_regionkey + 1) * 1000 AS w, (n_regionkey + 2) * 700 AS h FROM nation), l AS (SELECT *, CAST(ceil(w / (512.0 * 2 ** z)) AS BIGINT) AS nx, CAST(ceil(h / (512.0 * 2 ** z)) AS BIGINT) AS ny FROM i CROSS JOIN range(4) t(z))
  SELECT l.image, CAST(z AS INT) AS level, x, y, 'f' || k AS folder FROM l, range(10) a(x), range(10) b(y), (SELECT DISTINCT n_regionkey AS image, n_nationkey % 3 AS k FROM nation) f WHERE x < nx AND y < ny AND f.image = l.image""")
def k02_tile_jobs(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    images = n.select(F.col("n_regionkey").alias("image"), ((F.col("n_regionkey") + 1) * 1000).alias("width"), ((F.col("n_regionkey") + 2) * 700).alias("height")).distinct()
    return X.tile_jobs(images, n.select(F.col("n_regionkey").alias("image"), F.concat(F.lit("f"), (F.col("n_nationkey") % 3).cast("string")).alias("folder")), 512, 4)


@query("SELECT c_nationkey AS image, CAST(sum(ceil(c_custkey / 64.0) * ceil((c_custkey % 777 + 1) / 64.0) * 3) AS BIGINT) AS tiles FROM customer GROUP BY 1")
def a15_tile_counts(spark, sf_dir):
    k = F.col("c_custkey")
    return X.tile_count(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("image"), k.alias("width"), (k % 777 + 1).alias("height"), F.lit(64).alias("tile"), F.lit(3).alias("channels")))


@query("""SELECT c_custkey, sha256('{"channelId":' || c_nationkey || ',"lowerLimit":' || c_custkey % 100 || ',"upperLimit":' || (c_custkey % 100 + 500) || '}') AS folder FROM customer""")
def j18_folders(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", X.folder_of(F.col("c_nationkey"), k % 100, k % 100 + 500).alias("folder"))


@query("SELECT DISTINCT 'f' || c_custkey % 40 AS folder FROM customer WHERE c_custkey % 40 NOT IN (SELECT n_nationkey FROM nation)")
def j20_missing_folders(spark, sf_dir):
    name = lambda c: F.concat(F.lit("f"), c.cast("string"))
    return X.missing_folders(table(spark, sf_dir, "customer").select(name(F.col("c_custkey") % 40).alias("folder")), table(spark, sf_dir, "nation").select(F.upper(name(F.col("n_nationkey"))).alias("folder")))


@query("""WITH r AS (SELECT c_nationkey % 5 AS image, c_mktsegment AS g, c_custkey % 11 = 3 AND (c_nationkey % 5 + length(c_mktsegment)) % 3 = 0 AS missing FROM customer), o AS (SELECT image, g FROM r GROUP BY ALL HAVING NOT bool_or(missing))
  SELECT image, coalesce(max(g) FILTER (g = 'MACHINERY'), min(g)) AS "group" FROM o GROUP BY image""")
def j19_complete_folder_maps(spark, sf_dir):
    image = F.col("c_nationkey") % 5
    r = table(spark, sf_dir, "customer").select(image.alias("image"), F.col("c_mktsegment").alias("group"), F.col("c_custkey").alias("folder"))
    return X.complete_folder_map(r, r.where(~((F.col("folder") % 11 == 3) & ((F.col("image") + F.length("group")) % 3 == 0))), "MACHINERY")


@query("SELECT n_regionkey AS image, n_nationkey AS id, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY -n_nationkey) - 1 AS INT) AS index FROM nation WHERE n_nationkey % 4 <> 1")
def k06_remapped(spark, sf_dir):
    n = table(spark, sf_dir, "nation").where("n_nationkey % 4 <> 1").select(F.col("n_regionkey").alias("image"), F.col("n_nationkey").alias("id"), (-F.col("n_nationkey")).alias("index"))
    return X.remapped(n)


@query("""SELECT n_regionkey AS image, string_agg('<Channel ID="Channel:0:' || n_nationkey || '" Name="' || 'a&amp;b&lt;' || n_name || '&gt;&quot;' || '" SamplesPerPixel="1"/>', '' ORDER BY n_nationkey) AS xml FROM nation GROUP BY 1""")
def k07_f79_channel_xml(spark, sf_dir):
    return X.channel_xml(table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("image"), F.col("n_nationkey").alias("index"), F.concat(F.lit("a&b<"), "n_name", F.lit('>"')).alias("name")))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN replace(p_name, ' ', '_') WHEN 1 THEN replace(p_name, ' ', '_') || '.x' WHEN 2 THEN CAST(p_partkey AS VARCHAR) ELSE 'image' END AS stem, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || '.x' WHEN 2 THEN 'Mask' ELSE '///' END AS mask FROM part")
def f77_f78_names(spark, sf_dir):
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, F.concat("p_name", F.lit(".OME.tif"))).when(k == 1, F.concat("p_name", F.lit(".x.tiff"))).when(k == 2, ".tif").otherwise("///")
    return table(spark, sf_dir, "part").select("p_partkey", X.file_stem(name, F.col("p_partkey").cast("string")).alias("stem"), X.mask_label(name).alias("mask"))


@query("SELECT p_partkey, CASE WHEN n = 1 THEN s || '.ome.tif' ELSE s || '_' || n || '.ome.tif' END AS name FROM (SELECT p_partkey, replace(p_name, ' ', '-') AS s, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) AS n FROM part)")
def w05_unique_file_names(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.replace(F.col("p_name"), F.lit(" "), F.lit("-")).alias("stem"))
    return X.unique_names(p, "p_brand", ["p_partkey"], "stem").select("p_partkey", "name")


@query("SELECT p_partkey, CASE WHEN n = 1 THEN p_name ELSE p_name || ' (' || n || ')' END AS name FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) AS n FROM part)")
def w04_unique_mask_names(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.col("p_name").alias("stem"))
    return X.unique_names(p, "p_brand", ["p_partkey"], "stem", "{}", "{} ({})", fold=False).select("p_partkey", "name")


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN 'first' WHEN 2 THEN repeat('x', 117) || '…' WHEN 3 THEN CAST(p_size AS VARCHAR) ELSE 'ROI' END AS label FROM part")
def f80_roi_labels(spark, sf_dir):
    k = F.col("p_partkey") % 5
    name = F.when(k == 0, F.concat(F.lit(" "), "p_name")).otherwise(" ")
    about = F.when(k == 1, "\nfirst \r\nsecond").when(k == 2, "x" * 130)
    return table(spark, sf_dir, "part").select("p_partkey", X.roi_label(name, about, F.when(k == 3, F.concat(F.lit("a:b:"), F.col("p_size").cast("string"))).otherwise(" ")).alias("label"))


@query("SELECT p_partkey, CASE WHEN p_size = 1 THEN NULL ELSE round(CAST((59 - p_size) AS DOUBLE) * 90.0 / (p_size - 1), 6) END AS s, CASE WHEN p_size = 1 THEN 'estimating' WHEN ceil((59 - p_size) * 90.0 / (p_size - 1) / 60) <= 1 THEN 'about a minute left' ELSE CAST(ceil((59 - p_size) * 90.0 / (p_size - 1) / 60) AS BIGINT) || ' minutes left' END AS said FROM part")
def a16_f97_eta(spark, sf_dir):
    done = F.col("p_size") - 1
    s = X.eta_seconds(done, F.lit(58), F.lit(90.0))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(s, 6).alias("s"), X.minutes_left(s).alias("said"))


@query("""WITH p AS (SELECT user_id AS stroke, event_id AS t, CAST(event_id % 37 AS DOUBLE) AS x, CAST(user_id % 11 AS DOUBLE) AS y, lag(CAST(event_id % 37 AS DOUBLE)) OVER w AS px FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
  n AS (SELECT *, coalesce(greatest(1, CAST(ceil(abs(x - px) / 2) AS BIGINT)), 1) AS n FROM p)
  SELECT stroke, t, k, coalesce(px + (x - px) * k / n, x) AS x, y FROM n, range(1, 20) r(k) WHERE k <= n""")
def w12_stroke_points(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("stroke"), F.col("event_id").alias("t"), (F.col("event_id") % 37).cast("double").alias("x"), (F.col("user_id") % 11).cast("double").alias("y"))
    return X.stroke_points(e, 4.0)


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
  SELECT user_id AS key, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", count(*) AS n, arg_max(value, ts) AS last FROM s GROUP BY user_id, k""")
def x01_settled_edits(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("state"))
    out = A.settled(e, "2 hours")
    return out.select("key", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n", "last")


@query("""WITH p AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events), c AS (SELECT * FROM p WHERE before IS NULL OR before <> event_type)
  SELECT user_id AS key, event_id AS id, event_type AS state FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5""")
def x02_undo_history(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), "ts", F.col("event_type").alias("state"))
    return A.history(e, 5).select("key", "id", "state")


@query("SELECT page_id, url ILIKE 'http%' AS remote, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages")
def p20_p23_url_predicates(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.col("url").rlike("(?i)^https?://").alias("remote"), F.parse_url(F.col("url"), F.lit("HOST")).alias("host"))


@query("SELECT p_partkey, CAST(p_partkey % 7 AS BIGINT) AS m FROM part")
def f22_euclidean_modulo(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.pmod(F.col("p_partkey") - 700000, F.lit(7)).alias("m"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS INT) > 50")
def s23_json_scan(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int").alias("p"))
    return e.select("event_id", "p.k").where("k > 50")


@query("SELECT user_id, lower(h) AS folder FROM (SELECT DISTINCT user_id, CASE WHEN user_id % 2 = 0 THEN upper(sha256(CAST(user_id AS VARCHAR))) ELSE 'x' || user_id END AS h FROM events) WHERE user_id % 2 = 0")
def s27_folder_names(spark, sf_dir):
    u = table(spark, sf_dir, "events").select("user_id").distinct()
    name = F.when(F.col("user_id") % 2 == 0, F.upper(F.sha2(F.col("user_id").cast("string"), 256))).otherwise(F.concat(F.lit("x"), F.col("user_id").cast("string")))
    return u.select("user_id", F.lower(name).alias("folder")).where(F.col("folder").rlike("^[0-9a-f]{64}$"))
