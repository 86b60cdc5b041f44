"""Tiles of files that the test writes byte by byte, and of files that the writer made."""

import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.sources import tiff


def crafted(path, arrays, end, tile, planar=False, deflate=False, predictor=1):
    """A classic TIFF of a page with SubIFDs; arrays: (rows, columns, samples), the largest first. tile 0: strips of 5 rows."""
    body, dirs = bytearray(struct.pack(f"{end}2sHI", b"II" if end == "<" else b"MM", 42, 0)), []

    def put(data):
        at = len(body)
        body.extend(data)
        return at

    for a in arrays:
        h, w, s = a.shape
        th, tw = (tile, tile) if tile else (5, w)
        offsets, sizes = [], []
        for c in range(s) if planar else [slice(None)]:
            for y in range(0, h, th):
                for x in range(0, w, tw):
                    part = a[y : y + th, x : x + tw, c]
                    part = part[:, :, None] if planar else part
                    full = np.zeros((th if tile else part.shape[0], tw, part.shape[2]), a.dtype)
                    full[: part.shape[0], : part.shape[1]] = part
                    if predictor == 2:
                        full[:, 1:] -= full[:, :-1].copy()
                    raw = full.astype(a.dtype.newbyteorder(end)).tobytes()
                    raw = zlib.compress(raw) if deflate else raw
                    offsets.append(put(raw))
                    sizes.append(len(raw))
        dirs.append((a, th, tw, offsets, sizes))
    places = []
    for a, th, tw, offsets, sizes in reversed(dirs):
        h, w, s = a.shape
        tags = [(256, "I", [w]), (257, "I", [h]), (258, "H", [a.dtype.itemsize * 8] * s), (259, "H", [8 if deflate else 1]), (277, "H", [s]), (284, "H", [2 if planar else 1]), (317, "H", [predictor]), (339, "H", [{"u": 1, "i": 2, "f": 3}[a.dtype.kind]] * s)]
        tags += [(322, "I", [tw]), (323, "I", [th]), (324, "I", offsets), (325, "I", sizes)] if tile else [(273, "I", offsets), (278, "I", [th]), (279, "I", sizes)]
        if len(places) == len(dirs) - 1 and places:
            tags.append((330, "I", places[::-1]))
        rows = b""
        for tag, kind, values in sorted(tags):
            raw = struct.pack(f"{end}{len(values)}{kind}", *values)
            raw = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(f"{end}I", put(raw))
            rows += struct.pack(f"{end}HHI", tag, {"H": 3, "I": 4}[kind], len(values)) + raw
        places.append(put(struct.pack(f"{end}H", len(tags)) + rows + struct.pack(f"{end}I", 0)))
    struct.pack_into(f"{end}I", body, 4, places[-1])
    with open(path, "wb") as f:
        f.write(body)


def planes(df):
    out = {}
    for r in tiff.pixels(df).collect():
        out.setdefault((r.page, r.level, r.channel), {})[r.y, r.x] = r.v
    return out


@pytest.mark.parametrize("end, dtype, tile, planar, deflate, predictor", [("<", "u1", 16, False, False, 1), (">", "u2", 16, True, True, 2), ("<", "i2", 0, False, True, 1), (">", "f4", 16, False, True, 1), ("<", "u2", 0, True, False, 2), ("<", "f8", 32, True, True, 1)])
def test_tiles_are_those_of_the_array(spark, tmp_path, end, dtype, tile, planar, deflate, predictor):
    rng = np.random.default_rng(1)
    base = (rng.random((37, 50, 2)) * 250).astype(dtype)
    levels = [base, base[::2, ::2], base[::4, ::4]]
    crafted(tmp_path / "a.tif", levels, end, tile, planar, deflate, predictor)
    tiff.register(spark)
    df = spark.read.format("tiles").option("tilesPerPartition", 3).load(str(tmp_path))
    got = planes(df)
    assert set(got) == {(0, n, c) for n in range(3) for c in range(2)}
    for n, a in enumerate(levels):
        for c in range(2):
            assert got[0, n, c] == {(y, x): float(a[y, x, c]) for y in range(a.shape[0]) for x in range(a.shape[1])}


def test_filters_reach_the_scan(spark, tmp_path):
    a = np.arange(64 * 80, dtype="u2").reshape(64, 80, 1)
    crafted(tmp_path / "a.tif", [a, a[::2, ::2]], "<", 16)
    tiff.register(spark)
    df = spark.read.format("tiles").load(str(tmp_path / "a.tif"))
    some = df.where("level = 0 and tile_y >= 2 and tile_x in (0, 4) and width > 3")
    assert {(r.tile_y, r.tile_x) for r in some.collect()} == {(2, 0), (2, 4), (3, 0), (3, 4)}
    plan = some._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    pushed = plan.split("PushedFilters")[1].split("\n")[0]
    assert all(name in pushed for name in ("level", "tile_y", "tile_x"))
    reader = tiff.TileReader({"path": str(tmp_path / "a.tif")})
    left = list(reader.pushFilters([tiff.EqualTo(("level",), 0), tiff.GreaterThanOrEqual(("tile_y",), 2), tiff.In(("tile_x",), (0, 4)), tiff.GreaterThan(("width",), 3)]))
    assert [f.attribute for f in left] == [("width",)]
    assert [t[1:3] for p in reader.partitions() for t in p.tiles] == [(2, 0), (2, 4), (3, 0), (3, 4)]
    assert spark.read.format("tiles").load(str(tmp_path / "a.tif")).where("level = 7").count() == 0


def test_refused_files(spark, tmp_path):
    a = np.zeros((40, 40, 1), "u1")
    crafted(tmp_path / "a.tif", [a], "<", 0)
    with pytest.raises(ValueError, match="neither tiled nor a pyramid"):
        tiff.TileReader({"path": str(tmp_path / "a.tif"), "maxPlainSide": "39"}).partitions()
    (tmp_path / "b.tif").write_bytes(b"no image at all ....")
    with pytest.raises(ValueError, match="not a TIFF"):
        tiff.TileReader({"path": str(tmp_path / "b.tif")}).partitions()


@pytest.fixture(scope="module")
def image(spark):
    """Two pages of two levels, with a tile of zeros that is missing."""
    p = spark.range(2 * 45 * 70).select((F.col("id") % 2).cast("int").alias("page"), F.floor(F.col("id") / 2).alias("i"))
    p = p.select("page", (F.col("i") % 70).cast("int").alias("x"), F.floor(F.col("i") / 70).cast("int").alias("y"), (F.col("i") * 7 % 60_000 + F.col("page")).alias("v"))
    base = p.where("not (x < 16 and y < 16)").select("page", F.lit(0).alias("level"), "x", "y", "v")
    return base.unionByName(base.where("x % 2 = 0 and y % 2 = 0").select("page", F.lit(1).alias("level"), (F.col("x") / 2).cast("int").alias("x"), (F.col("y") / 2).cast("int").alias("y"), "v"))


def test_written_tiles_come_back(spark, tmp_path, image):
    path = str(tmp_path / "out.tif")
    for _ in range(2):  # the second time over the first
        tiff.write(tiff.encoded(image, 16, "u2").repartition(5), path, [(70, 45), (35, 23)], 2, 16, "u2", "<OME/>")
    assert os.listdir(tmp_path) == ["out.tif"]
    got = planes(spark.read.format("tiles").load(path))
    assert set(got) == {(p, n, 0) for p in (0, 1) for n in (0, 1)} and [len(got[0, n, 0]) for n in (0, 1)] == [70 * 45, 35 * 23]
    want = {}
    for r in image.collect():
        want.setdefault((r.page, r.level, 0), {})[r.y, r.x] = float(r.v)
    assert all(v == want[k].get(at, 0.0) for k, plane in got.items() for at, v in plane.items())
    with pafile(path) as f:
        assert next(tiff.Directories(f).pages())[0][270] == b"<OME/>\0"


def pafile(path):
    fs, at = tiff._opened(path)
    return fs.open_input_file(at)


def test_failed_write_leaves_nothing(spark, tmp_path, image):
    path = str(tmp_path / "out.tif")
    tiff.register(spark)
    rows = spark.range(40).select(F.col("id").alias("at"), F.when(F.col("id") == 33, F.raise_error(F.lit("stop"))).otherwise(F.lit("x")).cast("binary").alias("data")).repartition(4)
    with pytest.raises(Exception, match="stop"):
        rows.write.format("placed_bytes").mode("overwrite").save(path)
    assert os.listdir(tmp_path) == []


def test_one_tile_levels_keep_their_places_in_the_directory(spark, tmp_path):
    p = spark.range(100).select(F.lit(0).alias("page"), F.lit(0).alias("level"), (F.col("id") % 10).cast("int").alias("x"), F.floor(F.col("id") / 10).cast("int").alias("y"), (F.col("id") - 50).alias("v"))
    tiff.write(tiff.encoded(p, 16, "i4"), str(tmp_path / "o.tif"), [(10, 10)], 1, 16, "i4")
    assert planes(spark.read.format("tiles").load(str(tmp_path / "o.tif"))) == {(0, 0, 0): {(i // 10, i % 10): float(i - 50) for i in range(100)}}
