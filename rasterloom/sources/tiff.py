"""Tiled TIFF files as a Spark data source: planned by tile, with filters that decide which tiles are read; and a writer.

    tiff.register(spark)
    spark.read.format("tiles").load("/images/a.tif").where("level = 1 and tile_y < 4")

Planning reads the chain of directories of each file once: the images of the chain are pages, their SubIFDs the
levels of a page. A partition is a range of tiles and carries the places of those only. Classic and BigTIFF in both
byte orders, tiles and strips (a strip is a tile as wide as the image), chunky and planar samples; uncompressed or
deflate, with or without horizontal prediction. Other compressions raise an error when a tile of theirs is read. Spark
keeps the filters of a scan with what load() returns, so load twice to read a file twice with different filters.

A file is written in place and in parallel: sizes of the encoded tiles are added up over partitions, so every tile
knows where it goes before anything is written, and tasks write tiles and their directory entries there. The header
comes last, then the file gets its name; until then it has another, and a job that fails removes it.
"""

from __future__ import annotations

import base64
import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from .written import written

SCHEMA = "file string, page int, level int, channel int, tile_y int, tile_x int, top int, left int, height int, width int, values array<double>"

# Tags and types of the format.
_WIDTH, _HEIGHT, _BITS, _COMPRESSION, _PHOTOMETRIC, _DESCRIPTION = 256, 257, 258, 259, 262, 270
_STRIPS, _SAMPLES, _ROWS, _STRIP_BYTES, _PLANAR, _PREDICTOR = 273, 277, 278, 279, 284, 317
_TILE_WIDTH, _TILE_HEIGHT, _TILES, _TILE_BYTES, _SUBIFDS, _FORMAT, _SUBFILE = 322, 323, 324, 325, 330, 339, 254
_TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
_DEFLATE = (8, 32946)


def _opened(path: str):
    fs, at = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))
    return fs, at


def _files(path: str) -> list[str]:
    """The TIFF files of a folder, or the file itself."""
    fs, at = _opened(path)
    if fs.get_file_info(at).type != pafs.FileType.Directory:
        return [path]
    found = fs.get_file_info(pafs.FileSelector(at, recursive=True))
    head = path[: len(path) - len(at)] if path.endswith(at) else ""
    return sorted(head + f.path for f in found if f.type == pafs.FileType.File and f.path.lower().endswith((".tif", ".tiff")))


class Directories:
    """The directories of a file, read from its header on."""

    def __init__(self, f):
        self.f = f
        magic = f.read_at(16, 0)
        self.end = {b"II": "<", b"MM": ">"}.get(bytes(magic[:2]))
        version = struct.unpack(f"{self.end}H", magic[2:4])[0] if self.end else 0
        if version not in (42, 43):
            raise ValueError("not a TIFF file")
        self.big = version == 43
        self.first = struct.unpack(f"{self.end}Q", magic[8:16])[0] if self.big else struct.unpack(f"{self.end}I", magic[4:8])[0]

    def at(self, place: int) -> tuple[dict[int, tuple], int]:
        """Tags with their values, and where the next directory of the chain is; 0 at its end."""
        count_size, count_code, row, word, code = (8, "Q", 20, 8, "Q") if self.big else (2, "H", 12, 4, "I")
        n = struct.unpack(self.end + count_code, self.f.read_at(count_size, place))[0]
        body = self.f.read_at(n * row + word, place + count_size)
        tags = {}
        for i in range(n):
            tag, kind = struct.unpack_from(f"{self.end}HH", body, i * row)
            count = struct.unpack_from(self.end + code, body, i * row + 4)[0]
            own = body[(i + 1) * row - word : (i + 1) * row]
            if kind not in _TYPES:
                continue
            each = _TYPES[kind]
            size = count * struct.calcsize(f"<{each}")
            raw = own[:size] if size <= word else self.f.read_at(size, struct.unpack(self.end + code, own)[0])
            tags[tag] = bytes(raw) if kind == 2 else struct.unpack(f"{self.end}{count * len(each)}{each[0]}", raw)
        return tags, struct.unpack(self.end + code, body[n * row :])[0]

    def pages(self) -> Iterator[list[dict[int, tuple]]]:
        """The levels of each image of the chain."""
        place, seen = self.first, set()
        while place and place not in seen:
            seen.add(place)
            tags, place = self.at(place)
            yield [tags, *(self.at(p)[0] for p in tags.get(_SUBIFDS, ()))]


@dataclass
class Level:
    """What reading tiles of one directory takes."""

    width: int
    height: int
    tile_w: int
    tile_h: int
    samples: int
    planar: bool
    dtype: str
    compression: int
    predictor: int

    @classmethod
    def of(cls, tags: dict[int, tuple], end: str) -> Level:
        width, height, bits = tags[_WIDTH][0], tags[_HEIGHT][0], tags.get(_BITS, (1,))[0]
        kind = {3: "f", 2: "i"}.get(tags.get(_FORMAT, (1,))[0], "u")
        if bits not in (8, 16, 32, 64):
            raise ValueError(f"{bits} bits a sample")
        tile_w, tile_h = (tags[_TILE_WIDTH][0], tags[_TILE_HEIGHT][0]) if _TILES in tags else (width, min(height, tags.get(_ROWS, (height,))[0]))
        return cls(width, height, tile_w, tile_h, tags.get(_SAMPLES, (1,))[0], tags.get(_PLANAR, (1,))[0] == 2, f"{end}{kind}{bits // 8}", tags.get(_COMPRESSION, (1,))[0], tags.get(_PREDICTOR, (1,))[0])

    @property
    def across(self) -> int:
        return -(-self.width // self.tile_w)

    @property
    def down(self) -> int:
        return -(-self.height // self.tile_h)

    def pixels(self, raw: bytes, tile_y: int, tile_x: int) -> np.ndarray:
        """rows, columns and samples of a tile, cut at the edge of the image."""
        if self.compression in _DEFLATE:
            raw = zlib.decompress(raw)
        elif self.compression != 1:
            raise ValueError(f"compression {self.compression} is not supported")
        own = 1 if self.planar else self.samples
        flat = np.frombuffer(raw, self.dtype)
        rows = len(flat) // (self.tile_w * own)  # the last strip may be short
        v = flat[: rows * self.tile_w * own].reshape(rows, self.tile_w, own)
        if self.predictor == 2:
            v = np.cumsum(v, axis=1, dtype=v.dtype.newbyteorder("="))
        return v[: min(self.tile_h, self.height - tile_y * self.tile_h), : min(self.tile_w, self.width - tile_x * self.tile_w)]


@dataclass
class TileRange(InputPartition):
    """Tiles of one level that one task reads: (channels, tile_y, tile_x, offset, bytes) of each."""

    file: str
    page: int
    number: int
    level: Level
    tiles: list[tuple] = field(default_factory=list)

    def __post_init__(self):
        self.value = 0


_PUSHED = {EqualTo: lambda a, b: a == b, In: lambda a, b: a in b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}


class TileReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.step = int(options.get("tilesPerPartition", 256))
        self.largest = int(options.get("maxPlainSide", 1 << 14))
        self.wanted: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = getattr(f, "attribute", (None,))
            if type(f) in _PUSHED and len(name) == 1 and name[0] in ("page", "level", "channel", "tile_y", "tile_x"):
                self.wanted.append((name[0], type(f), getattr(f, "value", None)))
            else:
                yield f

    def _takes(self, **place: int) -> bool:
        """Whether what is known of a tile passes all filters on it."""
        return all(_PUSHED[kind](place[name], value) for name, kind, value in self.wanted if name in place)

    def partitions(self) -> list[TileRange]:
        out = []
        for file in _files(self.path):
            fs, at = _opened(file)
            with fs.open_input_file(at) as f:
                d = Directories(f)
                for page, levels in enumerate(d.pages()):
                    base = levels[0]
                    if len(levels) == 1 and _TILES not in base and max(base[_WIDTH][0], base[_HEIGHT][0]) > self.largest:
                        raise ValueError(f"{file} is neither tiled nor a pyramid, and larger than {self.largest}")
                    for number, tags in enumerate(levels):
                        if self._takes(page=page, level=number):
                            out += self._ranges(file, page, number, Level.of(tags, d.end), tags)
        return out or [TileRange("", 0, 0, None)]

    def _ranges(self, file: str, page: int, number: int, level: Level, tags: dict) -> Iterator[TileRange]:
        offsets, sizes = (tags[_TILES], tags[_TILE_BYTES]) if _TILES in tags else (tags[_STRIPS], tags[_STRIP_BYTES])
        channels = [c for c in range(level.samples) if self._takes(channel=c)]
        groups = [[c] for c in channels] if level.planar else [channels] if channels else []
        now = TileRange(file, page, number, level)
        for own in groups:
            first = own[0] * level.across * level.down if level.planar else 0
            for y in range(level.down):
                if not self._takes(tile_y=y):
                    continue
                for x in range(level.across):
                    if self._takes(tile_x=x):
                        k = first + y * level.across + x
                        now.tiles.append((own, y, x, offsets[k], sizes[k]))
                        if len(now.tiles) == self.step:
                            yield now
                            now = TileRange(file, page, number, level)
        if now.tiles:
            yield now

    def read(self, partition: TileRange) -> Iterator[pa.RecordBatch]:
        if not partition.tiles:
            return
        level, (fs, at) = partition.level, _opened(partition.file)
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = [pa.string(), *[pa.int32()] * 9, pa.list_(pa.float64())]
        with fs.open_input_file(at) as f:
            for own, y, x, offset, size in partition.tiles:
                # no bytes stand for a tile of zeros
                v = level.pixels(f.read_at(size, offset), y, x) if size else np.zeros((min(level.tile_h, level.height - y * level.tile_h), min(level.tile_w, level.width - x * level.tile_w), level.samples))
                columns: list[list] = [[] for _ in names]
                for c in own:
                    plane = v[:, :, 0 if level.planar else c].astype(np.float64)
                    for column, value in zip(columns, (partition.file, partition.page, partition.number, c, y, x, y * level.tile_h, x * level.tile_w, *plane.shape, plane.ravel())):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


class Tiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TileReader:
        return TileReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the formats known and lets filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Tiles)
    spark.dataSource.register(PlacedBytes)


def pixels(tiles: DataFrame) -> DataFrame:
    """file, page, level, channel, x, y and v of each pixel of tiles."""
    p = tiles.select("*", F.posexplode("values").alias("i", "v"))
    return p.select("file", "page", "level", "channel", (F.col("left") + F.col("i") % F.col("width")).alias("x"), (F.col("top") + F.floor(F.col("i") / F.col("width")).cast("int")).alias("y"), "v")


# -- writing


def encoded(pixel_rows: DataFrame, tile: int, dtype: str) -> DataFrame:
    """page, level, tile_y, tile_x and data (deflate, big-endian) of pixels (page, level, x, y, v); missing ones are 0."""
    at = (F.col("y") % tile * tile + F.col("x") % tile).cast("int")
    keys = ("page", "level", "tile_y", "tile_x")
    tiles = pixel_rows.select("page", "level", F.floor(F.col("y") / tile).cast("int").alias("tile_y"), F.floor(F.col("x") / tile).cast("int").alias("tile_x"), F.struct(at.alias("at"), F.col("v").cast("double").alias("v")).alias("p"))
    packed = tiles.groupBy(*keys).agg(F.collect_list("p").alias("p"))  # a tile's pixels

    def run(batches):
        for b in batches:
            out = []
            for p in b.column("p"):
                v = np.zeros(tile * tile)
                v[p.values.field("at").to_numpy()] = p.values.field("v").to_numpy()
                out.append(zlib.compress(v.astype(np.dtype(dtype).newbyteorder(">")).tobytes()))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(out, pa.binary())], [*keys, "data"])

    return packed.mapInArrow(run, "page int, level int, tile_y int, tile_x int, data binary")


def _header(sizes: list[tuple[int, int]], pages: int, tile: int, dtype: str, description: str) -> tuple[bytes, list[tuple]]:
    """Header and directories; and for each of them page, level, tiles across, and where its tile offsets and sizes go."""
    d = np.dtype(dtype)
    sample = {"u": 1, "i": 2, "f": 3}[d.kind]
    text = description.encode() + b"\0"
    plans, place = [], 16
    for page in range(pages):
        for level, (w, h) in enumerate(sizes):
            tiles = -(-w // tile) * -(-h // tile)
            tags = [(_SUBFILE, 4, 1, int(level > 0)), (_WIDTH, 4, 1, w), (_HEIGHT, 4, 1, h), (_BITS, 3, 1, d.itemsize * 8), (_COMPRESSION, 3, 1, 8), (_PHOTOMETRIC, 3, 1, 1)]
            tags += [(_DESCRIPTION, 2, len(text), None)] if page == level == 0 and description else []
            tags += [(_SAMPLES, 3, 1, 1), (_TILE_WIDTH, 4, 1, tile), (_TILE_HEIGHT, 4, 1, tile), (_TILES, 16, tiles, None), (_TILE_BYTES, 16, tiles, None)]
            tags += [(_SUBIFDS, 16, len(sizes) - 1, None)] if level == 0 and len(sizes) > 1 else []
            tags.append((_FORMAT, 3, 1, sample))
            own, place = place, place + 8 + 20 * len(tags) + 8
            where = {}
            for k, (tag, kind, count, _) in enumerate(tags):
                bytes_ = count * struct.calcsize(f"<{_TYPES[kind]}")
                where[tag], place = (own + 8 + 20 * k + 12, place) if bytes_ <= 8 else (place, place + -(-bytes_ // 8) * 8)
            plans.append((page, level, own, tags, where))
    head = bytearray(place)
    struct.pack_into(">2sHHHQ", head, 0, b"MM", 43, 8, 0, plans[0][2])
    for k, (page, level, own, tags, where) in enumerate(plans):
        struct.pack_into(">Q", head, own, len(tags))
        for i, (tag, kind, count, value) in enumerate(tags):
            entry = own + 8 + 20 * i
            struct.pack_into(">HHQ", head, entry, tag, kind, count)
            if value is not None:
                struct.pack_into(f">{_TYPES[kind]}", head, entry + 12, value)
            elif where[tag] != entry + 12:
                struct.pack_into(">Q", head, entry + 12, where[tag])
            if tag == _DESCRIPTION:
                head[where[tag] : where[tag] + len(text)] = text
            if tag == _SUBIFDS:
                struct.pack_into(f">{count}Q", head, where[tag], *(p[2] for p in plans[k + 1 : k + 1 + count]))
        following = next((p[2] for p in plans[k + 1 :] if p[1] == 0), 0) if level == 0 else 0
        struct.pack_into(">Q", head, own + 8 + 20 * len(tags), following)
    return bytes(head), [(page, level, -(-sizes[level][0] // tile), where[_TILES], where[_TILE_BYTES]) for page, level, _, _, where in plans]


def write(tiles: DataFrame, path: str, sizes: list[tuple[int, int]], pages: int, tile: int, dtype: str, description: str = "") -> None:
    """Writes encoded() tiles as one file; sizes: width and height of each level. A tile that is missing reads as zeros.

    Places of tiles are prefix sums: within a partition by a window, over partitions of their totals."""
    spark = tiles.sparkSession
    register(spark)
    head, slots = _header(sizes, pages, tile, dtype, description)
    kept = written(tiles.withColumns({"part": F.spark_partition_id(), "bytes": F.length("data").cast("long")}))
    totals = kept.groupBy("part").agg(F.sum("bytes").alias("total"))  # a row for each partition
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = totals.select("part", (F.coalesce(before, F.lit(0)) + len(head)).alias("base"))
    own = F.sum("bytes").over(Window.partitionBy("part").orderBy("page", "level", "tile_y", "tile_x").rowsBetween(Window.unboundedPreceding, -1))
    placed = kept.withColumn("before", F.coalesce(own, F.lit(0))).join(F.broadcast(bases), "part")
    placed = placed.join(F.broadcast(spark.createDataFrame(slots, "page int, level int, across int, offsets long, counts long")), ["page", "level"])
    k = 8 * (F.col("tile_y") * F.col("across") + F.col("tile_x"))
    word = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))
    at = F.col("base") + F.col("before")
    writes = F.array(F.struct(at.alias("at"), F.col("data").alias("data")), F.struct((F.col("offsets") + k).alias("at"), word(at).alias("data")), F.struct((F.col("counts") + k).alias("at"), word(F.col("bytes")).alias("data")))
    out = placed.select(F.explode(writes).alias("w")).select("w.at", "w.data")
    out.write.format("placed_bytes").mode("overwrite").option("head", base64.b64encode(head).decode()).save(path)


@dataclass
class Placed(WriterCommitMessage):
    rows: int


class PlacedBytes(DataSource):
    """One file from rows of data (binary) and the place where they go (at); option head: what is at its start."""

    @classmethod
    def name(cls) -> str:
        return "placed_bytes"

    def schema(self) -> str:
        return "at long, data binary"

    def writer(self, schema, overwrite: bool) -> PlacedWriter:
        return PlacedWriter(self.options["path"].removeprefix("file:"), base64.b64decode(self.options.get("head", "")))


class PlacedWriter(DataSourceWriter):
    """Tasks write in place into a file with another name, in a folder that all of them can write at offsets.

    A task that is repeated writes the same bytes again. Entries of missing tiles in the head stay as they are there."""

    def __init__(self, path: str, head: bytes):
        self.path, self.head = path, head
        self.open_path = f"{path}.{uuid.uuid4().hex}.open"

    def write(self, iterator) -> Placed:
        f = os.open(self.open_path, os.O_RDWR | os.O_CREAT)
        try:
            n = 0
            for n, row in enumerate(iterator, 1):
                data, at = memoryview(bytes(row["data"])), row["at"]
                while data:
                    done = os.pwrite(f, data, at)
                    data, at = data[done:], at + done
            os.fsync(f)
        finally:
            os.close(f)
        return Placed(n)

    def commit(self, messages) -> None:
        """The head is what tasks have not written of it: directory entries are theirs."""
        f = os.open(self.open_path, os.O_RDWR | os.O_CREAT)
        try:
            own = np.frombuffer(os.pread(f, len(self.head), 0).ljust(len(self.head), b"\0"), np.uint8)
            os.pwrite(f, (own | np.frombuffer(self.head, np.uint8)).tobytes(), 0)
            os.fsync(f)
        finally:
            os.close(f)
        os.replace(self.open_path, self.path)

    def abort(self, messages) -> None:
        if os.path.exists(self.open_path):
            os.unlink(self.open_path)
