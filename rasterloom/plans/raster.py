"""Queries on pixels, colours, masks and statistics. Pixel planes come from lineitem and events, tiles from embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions import colours as C
from rasterloom.functions import pixels as P
from rasterloom.operators import raster as R
from rasterloom.operators import statistics as S

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 16-bit plane for each event type; a pixel's place is its event's."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("channel"), F.col("event_id").alias("i"), F.least(F.lit(65535).cast("long"), F.floor(F.col("value") * 400)).alias("v"))


PLANE = "SELECT event_type AS channel, event_id AS i, least(65535, CAST(floor(value * 400) AS BIGINT)) AS v FROM events"


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.exploded(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8)


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles(spark, sf_dir).withColumn("v", (F.col("v") > F.lit(0.1)).cast("int"))


TILES = "SELECT vec_id AS plane, CAST((i - 1) % 8 AS INT) AS x, CAST((i - 1) // 8 AS INT) AS y, embedding[i] AS f FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS i FROM embeddings)"
MASKS = f"SELECT plane, x, y, CAST(CAST(f AS DOUBLE) > 0.1 AS INT) AS v FROM ({TILES})"


# -- statistics


def _bounds(bits: int) -> str:
    return f"SELECT CAST(row_number() OVER (ORDER BY u) - 1 AS INT) AS bin, u AS upper FROM (SELECT DISTINCT CAST(floor(2 ** ({bits} * k / 50.0)) AS INT) AS u FROM range(50) t(k))"


@query(
    f"""WITH b AS ({_bounds(16)}), p AS ({PLANE}),
    s AS (SELECT * FROM p WHERE (i % 4 = 0 OR (i // 128) % 4 = 0) AND v > 0),
    n AS (SELECT channel, (SELECT min(bin) FROM b WHERE upper >= v) AS bin, count(*) AS n FROM s WHERE v <= (SELECT max(upper) FROM b) GROUP BY ALL)
    SELECT c.channel, b.bin, b.upper, coalesce(n.n, 0) AS n FROM (SELECT DISTINCT channel FROM p) c CROSS JOIN b LEFT JOIN n ON n.channel = c.channel AND n.bin = b.bin"""
)
def a01_log_histogram(spark, sf_dir):
    return S.log_histogram(plane(spark, sf_dir), 16, 128)


@query(
    f"""WITH b AS ({_bounds(16)}), p AS (
      SELECT concat(l_returnflag, l_linestatus) AS channel, least(65535, CAST(floor(l_extendedprice * 0.6) AS BIGINT)) AS v FROM lineitem),
    n AS (SELECT channel, (SELECT min(bin) FROM b WHERE upper >= v) AS bin, count(*) AS n FROM p WHERE v > 0 AND v <= (SELECT max(upper) FROM b) GROUP BY ALL)
    SELECT c.channel, b.bin, b.upper, coalesce(n.n, 0) AS n FROM (SELECT DISTINCT channel FROM p) c CROSS JOIN b LEFT JOIN n ON n.channel = c.channel AND n.bin = b.bin"""
)
def a01_log_histogram_lineitem(spark, sf_dir):
    """All pixels: with a width of one every row is its own, and the places are all multiples of four."""
    p = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("channel"), F.lit(0).alias("i"), F.least(F.lit(65535).cast("long"), F.floor(F.col("l_extendedprice") * 0.6)).alias("v"))
    return S.log_histogram(p, 16, 1)


@query(
    f"""WITH b AS ({_bounds(16)}), p AS (
      SELECT l_returnflag AS channel, l_linenumber AS level, l_orderkey % 4 AS tx, l_suppkey % 2 AS ty, least(65535, CAST(floor(l_extendedprice * 0.6) AS BIGINT)) AS v FROM lineitem),
    t AS (SELECT * FROM p WHERE level = (SELECT max(level) FROM p) AND tx = 0 AND ty = 0),
    n AS (SELECT channel, (SELECT min(bin) FROM b WHERE upper >= v) AS bin, count(*) AS n FROM t WHERE v > 0 AND v <= (SELECT max(upper) FROM b) GROUP BY ALL)
    SELECT c.channel, b.bin, b.upper, coalesce(n.n, 0) AS n FROM (SELECT DISTINCT channel FROM t) c CROSS JOIN b LEFT JOIN n ON n.channel = c.channel AND n.bin = b.bin"""
)
def a02_coarsest_tile_histogram(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("channel"), F.col("l_linenumber").alias("level"), (F.col("l_orderkey") % 4).alias("tx"), (F.col("l_suppkey") % 2).alias("ty"), F.lit(0).alias("i"), F.least(F.lit(65535).cast("long"), F.floor(F.col("l_extendedprice") * 0.6)).alias("v")
    )
    coarsest = p.agg(F.max("level")).first()[0]  # one number; then the scan is filtered by it
    return S.log_histogram(p.where((F.col("level") == F.lit(coarsest)) & (F.col("tx") == 0) & (F.col("ty") == 0)), 16, 1)


@query(
    f"""WITH p AS ({PLANE}), m AS (SELECT channel, count(*) AS total, count(*) FILTER (v > 0) AS positive FROM p GROUP BY channel),
    h AS (SELECT *, (total - positive) / total >= 0.001 AND positive >= 64 AS heavy FROM m),
    r AS (SELECT p.channel, v, row_number() OVER (PARTITION BY p.channel ORDER BY v) - 1 AS k, CASE WHEN heavy THEN positive ELSE total END AS size FROM p JOIN h USING (channel) WHERE NOT heavy OR v > 0),
    f AS (SELECT channel, min(v) FILTER (k >= greatest(0, floor(0.001 * (size - 1)))) AS lo, min(v) FILTER (k >= least(size - 1, ceil(0.999 * (size - 1)))) AS hi FROM r GROUP BY channel)
    SELECT channel, CAST(lo AS BIGINT) AS lower, CAST(CASE WHEN hi <= lo THEN least(65535, lo + 1) ELSE hi END AS BIGINT) AS upper FROM f"""
)
def a03_percentile_limits(spark, sf_dir):
    return S.percentile_limits(plane(spark, sf_dir))


@query("SELECT DISTINCT o_custkey AS image, CAST(o_orderkey % 7 AS BIGINT) AS channel FROM orders WHERE NOT EXISTS (SELECT 1 FROM orders c WHERE c.o_orderstatus = 'F' AND c.o_custkey = orders.o_custkey AND c.o_orderkey % 7 = orders.o_orderkey % 7)")
def a05_cache_misses(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("image"), (F.col("o_orderkey") % 7).alias("channel"), "o_orderstatus")
    return S.missing_statistics(o, o.where("o_orderstatus = 'F'"), ["image", "channel"])


@query(f"SELECT plane, CAST(count(*) FILTER (f > CAST(0.25 AS FLOAT) AND y BETWEEN 1 AND 6) AS DOUBLE) / 48 AS ratio FROM ({TILES}) GROUP BY plane")
def a11_foreground_ratio(spark, sf_dir):
    return S.foreground_ratio(tiles(spark, sf_dir), 0.25, F.col("y").between(1, 6))


@query("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INT) AS best FROM embeddings")
def a12_argmax(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    return S.argmax(e, "vec_id")


@query("SELECT c_custkey AS id, CASE WHEN c_nationkey % 3 = 0 THEN [c_nationkey] WHEN c_custkey % 2 = 0 THEN [100, c_nationkey] ELSE CAST([] AS INTEGER[]) END AS counts FROM customer")
def j12_merge_histograms(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    own = c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_nationkey") % 3 == 0, F.array("c_nationkey")).otherwise(F.expr("cast(array() as array<int>)")).alias("counts"))
    fresh = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.array(F.lit(100), "c_nationkey").alias("counts"))
    return S.merge_histograms(own, fresh)


@query("SELECT c_custkey AS id, CASE WHEN c_nationkey % 2 = 0 THEN CAST(c_nationkey AS BIGINT) WHEN c_custkey % 3 = 0 THEN 7 END AS lower, CASE WHEN c_nationkey % 2 = 0 THEN 999 WHEN c_custkey % 3 = 0 THEN 77 END AS upper FROM customer")
def j13_merge_limits(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    has = F.col("c_nationkey") % 2 == 0
    own = c.select(F.col("c_custkey").alias("id"), F.when(has, F.col("c_nationkey").cast("long")).alias("lower"), F.when(has, 999).alias("upper"))
    return S.merge_limits(own, c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.lit(7).alias("lower"), F.lit(77).alias("upper")), overwrite=False)


@query("SELECT c_custkey AS id, CASE WHEN (lo = 32 AND hi = 16384) OR (lo = 0 AND hi IN (255, 65535)) THEN 11 ELSE lo END AS lower, CASE WHEN (lo = 32 AND hi = 16384) OR (lo = 0 AND hi IN (255, 65535)) THEN 4000 ELSE hi END AS upper FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 32 WHEN 1 THEN 0 WHEN 2 THEN 0 ELSE 5 END AS lo, CASE c_custkey % 4 WHEN 0 THEN 16384 WHEN 1 THEN 255 WHEN 2 THEN 65535 ELSE 500 END AS hi FROM customer)")
def p16_j14_fan_out_fits(spark, sf_dir):
    """Group rows that still hold an import's limits take the fit."""
    k = F.col("c_custkey") % 4
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(k == 0, 32).when(k < 3, 0).otherwise(5).alias("lo"), F.when(k == 0, 16384).when(k == 1, 255).when(k == 2, 65535).otherwise(500).alias("hi"))
    default = S.looks_like_default(F.col("lo"), F.col("hi"))
    return rows.select("id", F.when(default, 11).otherwise(F.col("lo")).alias("lower"), F.when(default, 4000).otherwise(F.col("hi")).alias("upper"))


# -- pixel functions


@query(f"SELECT channel, i, least(255, CAST(floor(power(v / 65536.0, 1.0 / 3.0) * 256 + 0.5) AS BIGINT)) AS b, CAST(least(65535, floor(power(least(255, CAST(floor(power(v / 65536.0, 1.0 / 3.0) * 256 + 0.5) AS BIGINT)) / 256.0, 3) * 65536 + 0.5)) AS BIGINT) AS back FROM ({PLANE})")
def f01_f02_cube_root(spark, sf_dir):
    p = plane(spark, sf_dir).withColumn("b", P.encode_cube_root(F.col("v")))
    return p.select("channel", "i", "b", P.decode_cube_root(F.col("b")).alias("back"))


@query(f"SELECT channel, i, CAST(round_even(least(255.0, greatest(0.0, (v - 100) / 19900.0 * 255)), 0) AS BIGINT) AS w, least(5000, greatest(200, v)) AS c, CAST(200 AS BIGINT) AS flat FROM ({PLANE})")
def f03_f04_contrast(spark, sf_dir):
    lit = lambda x: F.lit(x).cast("long")
    return plane(spark, sf_dir).select("channel", "i", P.contrast_window(F.col("v"), lit(100), lit(20000)).alias("w"), P.composite_clamp(F.col("v"), lit(200), lit(5000)).alias("c"), P.composite_clamp(F.col("v"), lit(200), lit(200)).alias("flat"))


@query(f"SELECT channel, i, CAST((v & 255) << 8 AS BIGINT) AS baked, CASE WHEN v % 5 = 0 THEN 0 ELSE CAST(least(65535, greatest(0, floor((v * 1.5 - 1000) + 0.5))) AS BIGINT) END AS u16, greatest(0, CAST(floor(v / 100.0 - 3 + 0.5) AS BIGINT)) AS label FROM ({PLANE})")
def f06_f07_f08_rasters(spark, sf_dir):
    v = F.col("v")
    wide = F.when(v % 5 == 0, F.lit(float("nan"))).otherwise(v * 1.5 - 1000)
    return plane(spark, sf_dir).select("channel", "i", P.baked_to_u16(v).alias("baked"), P.raster_to_u16(wide, F.lit(False)).alias("u16"), P.label_of(v / 100.0 - 3).alias("label"))


@query("SELECT c_custkey, CASE WHEN hi2 > lo THEN lo END AS lower, CASE WHEN hi2 > lo THEN hi2 END AS upper FROM (SELECT c_custkey, lo, CASE WHEN raw <= lo THEN least(65535, lo + 1) ELSE raw END AS hi2 FROM (SELECT c_custkey, CAST(least(65535, greatest(0, floor(c_acctbal * 8 + 0.5))) AS BIGINT) AS lo, CAST(least(65535, greatest(0, floor(c_acctbal * 3 + 20000 + 0.5))) AS BIGINT) AS raw FROM customer))")
def f09_sane_limits(spark, sf_dir):
    l = P.sane_limits(F.col("c_acctbal") * 8, F.col("c_acctbal") * 3 + 20000)  # noqa: E741
    return table(spark, sf_dir, "customer").select("c_custkey", l.alias("l")).select("c_custkey", F.col("l.lower").alias("lower"), F.col("l.upper").alias("upper"))


@query("SELECT p_partkey, CAST(floor(power(2, least(1, p_size * 160 / 8192.0) * log2(65536)) - 1 + 0.5) AS BIGINT) AS log_v, CAST(floor(least(1, p_size * 160 / 8192.0) * 65535 + 0.5) AS BIGINT) AS lin_v, CAST(floor(log2(least(65535, p_retailprice * 10) + 1) / log2(65536) * 8192 + 0.5) AS BIGINT) AS log_pos FROM part")
def f10_slider(spark, sf_dir):
    pos, top = F.col("p_size") * 160, F.lit(65535.0)
    return table(spark, sf_dir, "part").select("p_partkey", P.slider_to_intensity(pos, top, True).alias("log_v"), P.slider_to_intensity(pos, top, False).alias("lin_v"), P.intensity_to_slider(F.col("p_retailprice") * 10, top, True).alias("log_pos"))


@query("SELECT DISTINCT d AS dtype, CASE WHEN d ILIKE '%float%' THEN 16 WHEN regexp_extract(d, '(\\d+)', 1) <> '' THEN CAST(regexp_extract(d, '(\\d+)', 1) AS INT) ELSE 16 END AS bits FROM (SELECT CASE p_size % 5 WHEN 0 THEN 'Uint8' WHEN 1 THEN 'Uint16' WHEN 2 THEN 'Float32' WHEN 3 THEN 'Int32' ELSE 'other' END AS d FROM part)")
def f12_dtype_bits(spark, sf_dir):
    k = F.col("p_size") % 5
    d = table(spark, sf_dir, "part").select(F.when(k == 0, "Uint8").when(k == 1, "Uint16").when(k == 2, "Float32").when(k == 3, "Int32").otherwise("other").alias("dtype")).distinct()
    return d.select("dtype", P.dtype_bits(F.col("dtype")).alias("bits"))


@query("SELECT p_partkey, concat(CASE p_size % 4 WHEN 3 THEN 'Float' WHEN 2 THEN 'Int' ELSE 'Uint' END, CAST(CASE WHEN p_size % 2 = 0 THEN 8 ELSE 16 END AS VARCHAR)) AS dtype, CAST(power(2, floor(log2(greatest(1, least(p_size * 30, p_partkey + 1))))) AS BIGINT) AS tile FROM part")
def s07_s08_tiff_types(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", P.tiff_dtype(F.when(F.col("p_size") % 2 == 0, 8).otherwise(16), F.col("p_size") % 4).alias("dtype"), P.tile_size(F.col("p_size") * 30, F.col("p_partkey") + 1).alias("tile"))


@query("""WITH s AS (SELECT o_orderkey, CAST(floor(o_totalprice / 10) AS BIGINT) + 1 AS w, CAST(o_custkey % 3000 AS BIGINT) + 1 AS h FROM orders),
  l AS (SELECT *, (SELECT min(k) + 1 FROM range(32) t(k) WHERE greatest(w, h) // CAST(2 ** k AS BIGINT) <= 1024) AS n FROM s)
  SELECT o_orderkey, CAST(n AS INT) AS n_levels, w // 8 AS shifted, CAST(floor(w / 8.0 + 0.5) AS BIGINT) AS rounded, CAST(ceil(w / 8.0) AS BIGINT) AS ceiled, CAST(greatest(0, least(n - 1, floor(log2(greatest(greatest(w, h), 1) / 1024.0)))) AS BIGINT) AS ideal FROM l""")
def f13_f16_levels(spark, sf_dir):
    s = table(spark, sf_dir, "orders").select("o_orderkey", (F.floor(F.col("o_totalprice") / 10) + 1).alias("w"), (F.col("o_custkey") % 3000 + 1).alias("h"))
    w, h, three = F.col("w"), F.col("h"), F.lit(3)
    s = s.withColumn("n_levels", P.levels(w, h))
    return s.select("o_orderkey", "n_levels", *(P.level_side(w, three, c).alias(n) for c, n in (("shift", "shifted"), ("round", "rounded"), ("ceil", "ceiled"))), P.ideal_level(F.greatest(w, h), F.col("n_levels")).alias("ideal"))


# -- colours


@query("SELECT p_partkey, lower(printf('%06x', CAST(p_partkey * 7919 % 16777216 AS BIGINT))) AS hex, CAST(p_partkey * 7919 % 16777216 // 65536 AS INT) AS r, CAST(p_partkey * 7919 % 65536 // 256 AS INT) AS g, CAST(p_partkey * 7919 % 256 AS INT) AS b, CASE WHEN (p_partkey * 7919 % 16777216) * 256 + 128 >= 2147483648 THEN (p_partkey * 7919 % 16777216) * 256 + 128 - 4294967296 ELSE (p_partkey * 7919 % 16777216) * 256 + 128 END AS packed FROM part")
def f24_f25_f26_colours(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", C.rgb_of_hex(F.concat(F.lit("#"), F.lpad(F.hex(F.col("p_partkey") * 7919 % 16777216), 6, "0"))).alias("c"))
    r, g, b = (F.col(f"c.{x}") for x in "rgb")
    return p.select("p_partkey", C.hex_of_rgb(r, g, b).alias("hex"), r.alias("r"), g.alias("g"), b.alias("b"), C.packed_rgba(r, g, b, F.lit(128)).alias("packed"))


@query("""WITH n AS (SELECT p_partkey, CAST(p_partkey * 2654435 % 4294967296 - 2147483648 AS BIGINT) AS s, p_partkey * 7919 % 256 AS x FROM part)
  SELECT p_partkey, CASE p_partkey % 4
    WHEN 0 THEN [CAST((s + 4294967296) % 4294967296 // 16777216 AS INT), CAST((s + 4294967296) % 16777216 // 65536 AS INT), CAST((s + 4294967296) % 65536 // 256 AS INT), CAST((s + 4294967296) % 256 AS INT)]
    WHEN 1 THEN [CAST(x AS INT), 2, 3, 255] WHEN 2 THEN [17, 34, CAST(x AS INT), 160] ELSE [CAST(x AS INT), 0, 255, 255] END AS rgba FROM n""")
def f27_parse_colours(spark, sf_dir):
    x = F.col("p_partkey") * 7919 % 256
    h = F.lpad(F.lower(F.hex(x)), 2, "0")
    k = F.col("p_partkey") % 4
    text = F.when(k == 0, ((F.col("p_partkey") * 2654435) % 4294967296 - 2147483648).cast("string")).when(k == 1, F.concat(F.lit("rgb("), x.cast("string"), F.lit(", 2, 3)"))).when(k == 2, F.concat(F.lit("a01122"), h)).otherwise(F.concat(F.lit("#"), h, F.lit("00ff")))
    return table(spark, sf_dir, "part").select("p_partkey", C.parsed_colour(text).alias("rgba"))


def _fnv(column: str) -> str:
    return f"list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split({column}, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"


@query(f"SELECT p_partkey, {_fnv('p_name')} AS h, CAST(({_fnv('p_name')} & 159) + 50 AS INT) AS r, CAST((({_fnv('p_name')} >> 8) & 159) + 50 AS INT) AS g, CAST((({_fnv('p_name')} >> 16) & 159) + 50 AS INT) AS b FROM part")
def f29_seed_colour(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", C.fnv1a(F.col("p_name")).alias("h"), C.seed_colour(F.col("p_name")).alias("c")).select("p_partkey", "h", "c.*")


@query("""WITH a AS (SELECT p_partkey, CAST(xor(p_partkey * 3, 99) AS HUGEINT) AS x FROM part),
  b AS (SELECT p_partkey, CAST((xor(CAST(x AS BIGINT), CAST(x AS BIGINT) >> 16)) AS HUGEINT) * 2146121005 % 4294967296 AS x FROM a),
  c AS (SELECT p_partkey, CAST((xor(CAST(x AS BIGINT), CAST(x AS BIGINT) >> 15)) AS HUGEINT) * 2221713035 % 4294967296 AS x FROM b)
  SELECT p_partkey, xor(CAST(x AS BIGINT), CAST(x AS BIGINT) >> 16) AS h FROM c""")
def f30_label_hash(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", C.label_hash(F.col("p_partkey") * 3, F.lit(99)).alias("h"))


@query("SELECT p_partkey, CAST(list_sum(list_transform(generate_series(1, length(p_name)), lambda i: ascii(substr(p_name, i, 1)) * i)) % 360 AS BIGINT) AS hue, CAST(floor(least(1.0, greatest(0.0, p_size / 40.0)) * 255 + 0.5) AS INT) AS shown FROM part")
def f28_f31_hues(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", C.accent_hue(F.col("p_name")).alias("hue"), C.display_rgb(F.col("p_size") / 40.0).alias("shown"))


@query("""SELECT p_partkey, sha256('{"channel":' || p_size || ',"name":"' || p_name || '"}') AS folder FROM part""")
def f33_folder_name(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", C.canonical_hash(F.col("p_size").alias("channel"), F.col("p_name").alias("name")).alias("folder"))


# -- rasters


@query(f"WITH m AS ({MASKS}) SELECT m.plane, m.x, m.y, CAST(m.v = 1 AND (SELECT coalesce(sum(n.v), 0) FROM m n WHERE n.plane = m.plane AND abs(n.x - m.x) + abs(n.y - m.y) = 1) < 4 AS INT) AS edge FROM m")
def f69_mask_edges(spark, sf_dir):
    return R.edges(masks(spark, sf_dir)).select("plane", "x", "y", "edge")


@query(f"WITH m AS ({MASKS}) SELECT a.plane, a.x, a.y, max(b.v) AS v FROM m a JOIN m b ON a.plane = b.plane AND abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2 GROUP BY ALL")
def f70_dilation(spark, sf_dir):
    return R.dilated(masks(spark, sf_dir), 2)


@query(f"""WITH m AS ({MASKS}), e AS (SELECT m.plane, m.x, m.y, CAST(m.v = 1 AND (SELECT coalesce(sum(n.v), 0) FROM m n WHERE n.plane = m.plane AND abs(n.x - m.x) + abs(n.y - m.y) = 1) < 4 AS INT) AS v FROM m),
  d AS (SELECT a.plane, a.x, a.y, max(b.v) AS v FROM e a JOIN e b ON a.plane = b.plane AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY ALL)
  SELECT plane, x, y, CASE WHEN v = 1 THEN 10 ELSE 0 END AS r, CASE WHEN v = 1 THEN 20 ELSE 0 END AS g, CASE WHEN v = 1 THEN 30 ELSE 0 END AS b, CASE WHEN v = 1 THEN 230 ELSE 0 END AS a FROM d""")
def f71_mask_rgba(spark, sf_dir):
    return R.mask_rgba(masks(spark, sf_dir), True, (10, 20, 30))


@query(f"WITH m AS (SELECT plane, x, y, CAST(floor(f * 10) AS INT) AS v FROM ({TILES})) SELECT a.plane, a.x, a.y, CAST(a.v > 0 AND bool_or(b.v <> a.v) AS INT) AS edge FROM m a JOIN m b ON a.plane = b.plane AND abs(a.x - b.x) + abs(a.y - b.y) = 1 GROUP BY a.plane, a.x, a.y, a.v")
def f72_label_edges(spark, sf_dir):
    t = tiles(spark, sf_dir).withColumn("v", F.floor(F.col("v") * F.lit(10).cast("float")).cast("int"))
    return R.label_edges(t).select("plane", "x", "y", "edge")


@query(f"SELECT plane, x, y, CASE WHEN (x - 3.5) * (x - 3.5) + (y - 2) * (y - 2) <= 6.25 THEN 1 ELSE v END AS v FROM ({MASKS})")
def f66_paint_disc(spark, sf_dir):
    return R.painted(masks(spark, sf_dir), 3.5, 2.0, 2.5)


@query(f"SELECT plane, y, min(x) AS x0, max(x) AS x1 FROM (SELECT *, x - row_number() OVER (PARTITION BY plane, y ORDER BY x) AS g FROM ({MASKS}) WHERE v = 1) GROUP BY plane, y, g")
def w08_mask_runs(spark, sf_dir):
    return R.runs(masks(spark, sf_dir))


@query(f"WITH m AS ({MASKS}) SELECT a.plane, a.x, a.y, CAST(8 * a.v + 4 * b.v + 2 * c.v + d.v AS INT) AS \"case\" FROM m a JOIN m b ON b.plane = a.plane AND b.x = a.x + 1 AND b.y = a.y JOIN m c ON c.plane = a.plane AND c.x = a.x + 1 AND c.y = a.y + 1 JOIN m d ON d.plane = a.plane AND d.x = a.x AND d.y = a.y + 1")
def f62_cell_cases(spark, sf_dir):
    return R.cell_cases(masks(spark, sf_dir))


@query(f"WITH m AS ({MASKS}) SELECT p.plane, CAST(gx AS INT) AS x, CAST(gy AS INT) AS y, coalesce(m.v, 0) AS v FROM (SELECT DISTINCT plane FROM m) p CROSS JOIN range(10) a(gx) CROSS JOIN range(10) b(gy) LEFT JOIN m ON m.plane = p.plane AND m.x = gx AND m.y = gy")
def f23_padded_tiles(spark, sf_dir):
    return R.padded(masks(spark, sf_dir), 10)


@query("""WITH l AS (SELECT vec_id // 3 AS plane, unnest(generate_series(1, 64)) AS i, vec_id % 3 AS pos, embedding FROM embeddings),
  s AS (SELECT plane, i - 1 AS i, pos, least(1.0, greatest(0.0, CAST(embedding[i] AS DOUBLE) * 2)) AS share, (ARRAY[250.0, 30, 120])[pos + 1] AS r, (ARRAY[10.0, 240, 130])[pos + 1] AS g, (ARRAY[5.0, 200, 180])[pos + 1] AS b FROM l),
  a AS (SELECT plane, i, coalesce(max(share * r) FILTER (pos = 0), 0) r0, coalesce(max(share * r) FILTER (pos = 1), 0) r1, coalesce(max(share * r) FILTER (pos = 2), 0) r2, coalesce(max(share * g) FILTER (pos = 0), 0) g0, coalesce(max(share * g) FILTER (pos = 1), 0) g1, coalesce(max(share * g) FILTER (pos = 2), 0) g2, coalesce(max(share * b) FILTER (pos = 0), 0) b0, coalesce(max(share * b) FILTER (pos = 1), 0) b1, coalesce(max(share * b) FILTER (pos = 2), 0) b2 FROM s GROUP BY ALL)
  SELECT plane, CAST(i AS INT) AS i, CAST(least(255, round_even(least(255, round_even(least(255, round_even(r0, 0)) + r1, 0)) + r2, 0)) AS INT) AS r, CAST(least(255, round_even(least(255, round_even(least(255, round_even(g0, 0)) + g1, 0)) + g2, 0)) AS INT) AS g, CAST(least(255, round_even(least(255, round_even(least(255, round_even(b0, 0)) + b1, 0)) + b2, 0)) AS INT) AS b FROM a""")
def f05_composite(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 3).alias("plane"), (F.col("vec_id") % 3).alias("pos"), F.posexplode("embedding").alias("i", "v"))
    colour = lambda *c: F.get(F.array(*(F.lit(float(x)) for x in c)), F.col("pos").cast("int"))
    layers = e.select("plane", "i", "pos", P.clamp(F.col("v").cast("double") * 2, 0.0, 1.0).alias("share"), colour(250, 30, 120).alias("r"), colour(10, 240, 130).alias("g"), colour(5, 200, 180).alias("b"))
    return R.composited(layers)


@query("SELECT vec_id AS plane, CAST(i - 1 AS INT) AS i, round((v / 255.0 - 0.485) / 0.229, 9) AS r, round((v / 255.0 - 0.456) / 0.224, 9) AS g, round((v / 255.0 - 0.406) / 0.225, 9) AS b FROM (SELECT vec_id, i, CAST(floor((CAST(embedding[i] AS DOUBLE) + 1) * 100) AS INT) AS v FROM (SELECT vec_id, embedding, unnest(generate_series(1, 64)) AS i FROM embeddings))")
def f19_normalised(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("plane"), F.posexplode("embedding").alias("i", "v"))
    v = F.floor((F.col("v").cast("double") + 1) * 100)
    out = R.normalised(e.select("plane", "i", *(v.alias(c) for c in "rgb")), (0.485, 0.456, 0.406), (0.229, 0.224, 0.225))
    return out.select("plane", "i", *(F.round(c, 9).alias(c) for c in "rgb"))
