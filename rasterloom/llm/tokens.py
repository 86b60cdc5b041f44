"""Token ids in Huffman-coded blocks.

Texts are encoded with a tokenizer of the tokenizers library; each document ends with id 0. The counts
of all ids give a canonical Huffman code of at most MAX_BITS bits. Documents go in ascending doc_id
order into blocks, the rows of a Parquet table that Spark writes and commits: a block holds whole
documents, each from a byte boundary, and the bit offset of every LANE-th id, so that each block is
decoded by itself and all its lanes side by side through one lookup table.

A text is cut where the tokenizer's own pattern always splits (a single space or line feed between two
visible characters); each distinct piece is encoded once and kept in the worker.

Edge cases: a null or empty text is the end id alone; rows with the same doc_id follow each other in the
order of their ids' checksum; a null doc_id comes first; an empty table gives an empty code and no rows; a very
long text is worked on alone; with a tokenizer that splits otherwise texts are encoded whole; other columns are
not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as T
from .session import dropped, shared_dir, stored

END, MAX_BITS, LANE, BLOCK_IDS = 0, 20, 1024, 1 << 16

#: Pieces that a worker keeps before it drops those that it met once; only speed depends on it.
KEPT_PIECES = 1 << 20

#: Blocks that are decoded side by side.
ABREAST = 32

_BREAK = np.zeros(256, bool)
_BREAK[[10, 32]] = True


def _visible(lead: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether the character with these first and last bytes is surely not white space: ASCII above the space, or two
    bytes from U+00C0 on."""
    return ((last > 32) & (last < 127)) | ((last >= 128) & (lead >= 0xC3) & (lead <= 0xDF))


def pieces(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of all texts, without the line feeds that follow texts."""
    at = np.flatnonzero(_BREAK[buf])
    at = at[(at > 1) & (at < len(buf) - 1)]
    before, after = buf[at - 1], buf[at + 1]
    at = at[_visible(buf[at - 2], before) & (((after > 32) & (after < 127)) | ((after >= 0xC3) & (after <= 0xDF)))]
    ends = off[1:] - 1
    last = np.zeros(len(buf), bool)
    last[ends] = True
    at = at[~last[at]]
    starts = np.sort(np.concatenate([at, at[buf[at] == 10] + 1, off[:-1]]))
    starts = starts[np.concatenate([[True], starts[1:] != starts[:-1]])] if len(starts) else starts
    stops = np.append(starts[1:], len(buf))
    own = np.searchsorted(off, starts, "right") - 1
    stops = np.minimum(stops, ends[own])
    keep = stops > starts
    return starts[keep], stops[keep]


class Crossed(Exception):
    """A token crosses pieces, as with a tokenizer that splits otherwise."""


class Encoder:
    """A tokenizer with the ids of the pieces that it has met."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(vocab.values()) + 1, np.int64)
        self.width[list(vocab.values())] = [len(k) for k in vocab]  # a character of a token stands for one byte
        self.dtype = np.uint16 if len(self.width) <= 1 << 16 else np.uint32
        self.newline = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.forget()

    def forget(self) -> None:
        """Drops all pieces. Of each are kept: its hash; where its ids start and how many there are; where its bytes start
        and how many there are; and whether it was met in a later slice again."""
        self.keys, self.at, self.again = np.zeros(0, T.U64), np.zeros((0, 4), np.int64), np.zeros(0, bool)
        self.ids, self.bytes = np.zeros(0, self.dtype), np.zeros(0, np.uint8)

    def thin(self) -> None:
        """Drops the pieces that weren't met again since the last time; all, where that leaves too many."""
        at = self.at[self.again]
        if 2 * len(at) > KEPT_PIECES:
            return self.forget()
        first, n, place, size = at.T
        self.keys, self.again = self.keys[self.again], np.zeros(len(at), bool)
        self.ids, self.bytes = self.ids[T.ranges(first, first + n)[0]], self.bytes[T.ranges(place, place + size)[0]]
        self.at = np.stack([np.cumsum(n) - n, n, np.cumsum(size) - size, size], axis=1)

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An order of the parts, their ids in that order, and how many each has. Parts that begin and end visibly are
        joined to long texts, between which the tokenizer splits anyway."""
        n = ends - starts
        two = np.maximum(ends - 2, 0)
        head, after = buf[starts], buf[np.minimum(starts + 1, len(buf) - 1)]
        opens = lambda x: ((x > 32) & (x < 127)) | ((x >= 0xC3) & (x <= 0xDF))
        spaced = head == 32
        joint = (n > 1) & _visible(buf[two], buf[ends - 1]) & np.where(spaced, opens(after), opens(head))
        bar = np.flatnonzero((buf[:-1] == 60) & (buf[1:] == 124))  # what may begin a special token is encoded by itself
        if len(bar):
            joint &= np.searchsorted(bar, starts) == np.searchsorted(bar, ends)
        order, ids, counts = [], [], []
        for own, gap in ((np.flatnonzero(joint & spaced), 0), (np.flatnonzero(joint & ~spaced), 1)):
            for lo in range(0, len(own), 8192):
                group = own[lo : lo + 8192]
                at, owner = T.ranges(starts[group] - gap, ends[group])
                raw = buf[at]
                size = n[group] + gap
                if gap:
                    raw[np.cumsum(size) - size] = 10
                got = np.array(self._plain([raw.tobytes().decode()])[0], np.int64)
                end, want = np.cumsum(self.width[got]), np.cumsum(size)
                cut = np.searchsorted(end, want) + 1
                if len(end) == 0 or (end[np.minimum(cut, len(end)) - 1] != want).any():
                    raise Crossed
                per = np.diff(cut, prepend=0)
                if gap:
                    got = np.delete(got, cut - per)
                order.append(group)
                ids.append(got.astype(self.dtype))
                counts.append(per - gap)
        lone = np.flatnonzero(~joint)
        plain = self._plain([buf[x:y].tobytes().decode() for x, y in zip(starts[lone].tolist(), ends[lone].tolist())])
        order.append(lone)
        ids.append(np.array([x for g in plain for x in g], self.dtype))
        counts.append(np.array([len(g) for g in plain], np.int64))
        return np.concatenate(order), np.concatenate(ids), np.concatenate(counts)

    def __call__(self, col) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of an Arrow column, each with the end id, and how many each text has."""
        try:
            got = self._by_pieces(*T.buffer(col))
        except Crossed:
            self.forget()
            got = None
        if got is not None:
            return got
        ids = [[*g, END] for g in self._plain(T.strings(col).to_pylist())]
        return np.array([x for g in ids for x in g], self.dtype), np.array([len(g) for g in ids], np.int64)

    def _by_pieces(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids by distinct pieces, whose bytes are compared; nothing if two pieces share a hash."""
        starts, ends = pieces(buf, off)
        keys, first, _, inv = T.distinct(T.hashes(buf, starts, ends, fold=False))
        if not ((ends[first] - starts[first])[inv] == ends - starts).all() or not T.equal(buf, starts, buf, starts[first][inv], ends - starts).all():
            return None
        if len(self.keys) > KEPT_PIECES:
            self.thin()
        slot = np.searchsorted(self.keys, keys)
        known = slot < len(self.keys)
        known[known] = self.keys[slot[known]] == keys[known]
        old, new = np.flatnonzero(known), np.flatnonzero(~known)
        size = ends[first] - starts[first]
        _, _, place, kept = self.at[slot[old]].T
        if len(old) and not ((kept == size[old]).all() and T.equal(self.bytes, place, buf, starts[first[old]], size[old]).all()):
            return None
        self.again[slot[old]] = True
        if len(new):
            turn, ids, n = self._encode(buf, starts[first[new]], ends[first[new]])
            own = new[turn]
            at = np.stack([len(self.ids) + np.cumsum(n) - n, n, len(self.bytes) + np.cumsum(size[own]) - size[own], size[own]], axis=1)
            self.keys, self.again = np.insert(self.keys, slot[new], keys[new]), np.insert(self.again, slot[new], False)
            self.at = np.insert(self.at, slot[new], at[np.argsort(own)], axis=0)
            self.bytes = np.concatenate([self.bytes, buf[T.ranges(starts[first[own]], ends[first[own]])[0]]])
            self.ids = np.concatenate([self.ids, ids])
            slot += np.cumsum(~known) - ~known  # the new ones before each
        of = slot[inv]
        at, n = self.at[:, 0][of], self.at[:, 1][of]
        texts = len(off) - 1
        own = np.searchsorted(off, starts, "right") - 1
        per = np.bincount(own, weights=n, minlength=texts).astype(np.int64) + 1
        out = np.full(per.sum(), END, self.dtype)
        last = np.zeros(len(out), bool)
        last[np.cumsum(per) - 1] = True
        at, _ = T.ranges(at, at + n)
        out[~last] = self.ids[at]
        return out, per


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _forgotten() -> None:
    """Drops the tokenizers and pieces of a worker that lives on and now codes or decodes ids."""
    if encoder.cache_info().currsize:
        encoder.cache_clear()
        T._give_back()


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 for what doesn't occur."""
    out = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols don't fit into {limit} bits")
    o = used[np.argsort(counts[used], kind="stable")]
    w = counts[o].astype(np.int64)
    n, level, marks = len(o), w, []
    for _ in range(limit - 1):
        m = len(level) // 2
        pairs = level[: 2 * m : 2] + level[1 : 2 * m : 2]
        both = np.concatenate([w, pairs])
        at = np.argsort(both, kind="stable")
        marks.append(at < n)
        level = both[at]
    take = 2 * n - 2
    for single in reversed(marks):  # of the first take nodes: leaves gain a bit, packages open one level down
        leaves = int(single[:take].sum())
        out[o[:leaves]] += 1
        take = 2 * (take - leaves)
    out[o[:take]] += 1
    return out


class Code:
    """The canonical code of the given lengths."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths
        used = np.flatnonzero(lengths)
        used = used[np.lexsort((used, lengths[used]))]
        self.bits = np.zeros(len(lengths), np.int64)
        n = lengths[used]
        self.top = int(n.max(initial=1))
        step = (1 << (self.top - n)).astype(np.int64)
        self.bits[used] = (np.cumsum(step) - step) >> (self.top - n)
        self.table = np.repeat(used << 5 | n, step).astype(np.uint32)  # an id and its length
        self.table = np.concatenate([self.table, np.zeros((1 << self.top) - len(self.table), np.uint32)])

    def encode(self, ids: np.ndarray, per: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The bits of all documents, each from a byte boundary; the first byte of each and the end; the first bit of each id."""
        n = self.lengths[ids]
        end = np.cumsum(n)
        last = np.cumsum(per) - 1
        whole = np.diff(end[last], prepend=0)
        size = (whole + 7) // 8
        first = np.concatenate([[0], np.cumsum(size)])
        at = end - n + np.repeat(first[:-1] * 8 - (np.cumsum(whole) - whole), per)
        words = np.zeros(int(first[-1] // 4 + 3), T.U64)
        v = self.bits[ids].astype(T.U64) << (64 - (at & 31) - n).astype(T.U64)
        w = at >> 5
        g = np.flatnonzero(np.diff(w, prepend=-1))
        if len(g):
            words[w[g]] += np.add.reduceat(v >> T.U64(32), g)
            words[w[g] + 1] += np.add.reduceat(v & T.U64(0xFFFFFFFF), g)
        return words.astype(">u4").tobytes()[: first[-1]], first, at

    def decode(self, data: bytes, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The ids of all lanes one after another; each lane has its first bit and how many ids it has."""
        four = np.ndarray(len(data) + 1, ">u4", data + b"\0\0\0\0", 0, (1,))  # the four bytes from each position
        out = np.zeros(int(counts.sum()), np.uint32)
        to = np.cumsum(counts) - counts
        o = np.argsort(-counts, kind="stable")
        p, to, left = starts[o].astype(np.int64), to[o], counts[o]
        shift, mask = 32 - self.top, np.uint32((1 << self.top) - 1)
        for k in range(int(left[0]) if len(left) else 0):
            live = int(np.searchsorted(-left, -k))
            q = p[:live]
            x = four[q >> 3].astype(np.uint32)
            found = self.table[(x >> (shift - (q & 7)).astype(np.uint32)) & mask]
            out[to[:live] + k] = found >> np.uint32(5)
            q += found & np.uint32(31)
        return out


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian, 2 bytes where the vocabulary allows) and their checksum of each document."""

    def run(batches):
        enc = encoder(path)
        for b in T.slices(batches, size=2 << 20):
            ids, per = enc(b.column("text"))
            end = np.cumsum(per) * ids.itemsize
            raw = ids.tobytes()
            own = [raw[x:y] for x, y in zip([0, *end.tolist()], end.tolist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(per, pa.int64()), pa.array([zlib.crc32(x) for x in own], pa.int64()), pa.array(own, pa.binary())], ["doc_id", "n_tokens", "tie", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, tie long, ids binary")


def id_counts(ids: DataFrame, dtype) -> np.ndarray:
    """How often each id occurs; as long as the largest id says."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for b in batches:
            c = np.bincount(np.frombuffer(b"".join(b.column("ids").to_pylist()), dtype))
            total = np.pad(total, (0, max(0, len(c) - len(total))))
            total[: len(c)] += c
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["id", "n"])

    rows = ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(int(rows.id.max()) + 1 if len(rows) else 1, np.int64)
    out[rows.id.to_numpy(np.int64)] = rows.n.to_numpy(np.int64)
    return out


BLOCKS = "part int, seq long, before long, doc_ids array<long>, n_tokens array<long>, first_bytes array<long>, lane_bits array<long>, payload binary"


def write(docs: DataFrame, path: str, tokenizer: str) -> np.ndarray:
    """Writes all documents to the folder ``path`` and returns the code lengths.

    The folder needs nothing else to be read: blocks holds the coded ids, code the length of each id's code, from which
    a canonical code follows, parts how many ids lie before each part of the blocks, and about the tokenizer's name."""
    spark = docs.sparkSession
    dtype = encoder(tokenizer).dtype
    ids = stored(tokenized(docs, tokenizer), compression="zstd")
    lengths = code_lengths(id_counts(ids, dtype))
    shared = spark.sparkContext.broadcast(lengths)

    # ids are dealt before they are coded: Spark reads the rows twice, once for the bounds of the ranges
    ordered = ids.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "n_tokens", "ids")
    ordered.mapInArrow(lambda batches: _blocks(batches, Code(shared.value), dtype), BLOCKS).write.parquet(f"{path}/blocks")
    dropped(spark, ids)
    sizes = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").groupBy("part").agg(F.sum(F.expr("aggregate(n_tokens, 0L, (a, x) -> a + x)")).alias("n"))
    before = F.sum("n").over(Window.orderBy("part")) - F.col("n")  # a row for each part
    sizes.select("part", before.alias("before")).coalesce(1).write.parquet(f"{path}/parts")
    at = np.flatnonzero(lengths)
    spark.createDataFrame(pa.table({"id": pa.array(at, pa.int64()), "length": pa.array(lengths[at], pa.int32())})).coalesce(1).write.parquet(f"{path}/code")
    spark.createDataFrame([(tokenizer.rsplit("/", 1)[-1], len(lengths))], "tokenizer string, ids long").coalesce(1).write.parquet(f"{path}/about")
    return lengths


def _blocks(batches, code: Code, dtype) -> Iterator[pa.RecordBatch]:
    _forgotten()
    part, seq, before = TaskContext.get().partitionId(), 0, 0
    held: list[tuple] = []
    size = 0

    def block():
        docs, per, raw = zip(*held)
        n = np.array(per, np.int64)
        data, first, at = code.encode(np.frombuffer(b"".join(raw), dtype).astype(np.int64), n)
        # every LANE-th id of each document
        lanes = (n + LANE - 1) // LANE
        begin = np.repeat(np.cumsum(n) - n, lanes) + (np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * LANE
        row = [[part], [seq], [before], [list(docs)], [list(per)], [first.tolist()], [at[begin].tolist()], [data]]
        types = [pa.int32(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 4, pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types)], [x.split()[0] for x in BLOCKS.split(", ")])

    for b in batches:
        for x in zip(b.column("doc_id").to_pylist(), b.column("n_tokens").to_pylist(), b.column("ids").to_pylist()):
            held.append(x)
            size += x[1]
            if size >= BLOCK_IDS:
                yield block()
                before, seq, held, size = before + size, seq + 1, [], 0
    if held:
        yield block()
    T._give_back()


def read(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian, 4 bytes) of all documents of a written folder."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    base = {r["part"]: r["before"] for r in spark.read.schema("part int, before long").parquet(f"{path}/parts").toLocalIterator()}  # one number a part
    lengths = np.zeros(spark.read.schema("tokenizer string, ids long").parquet(f"{path}/about").first()["ids"], np.int64)
    for r in spark.read.schema("id long, length int").parquet(f"{path}/code").toLocalIterator():  # a number for each id
        lengths[r["id"]] = r["length"]
    shared = spark.sparkContext.broadcast((lengths, base))

    def run(batches):
        _forgotten()
        lens, bases = shared.value
        code = Code(lens)
        for b in batches:
            for lo in range(0, b.num_rows, ABREAST):
                part = b.slice(lo, ABREAST).to_pylist()
                n = np.concatenate([np.array(r["n_tokens"], np.int64) for r in part])
                first = np.cumsum([0, *(len(r["payload"]) for r in part)])
                bits = np.concatenate([np.array(r["lane_bits"], np.int64) + 8 * f for r, f in zip(part, first)])
                lanes = (n + LANE - 1) // LANE
                counts = np.full(lanes.sum(), LANE)
                counts[np.cumsum(lanes) - 1] = n - (lanes - 1) * LANE
                raw = code.decode(b"".join(r["payload"] for r in part), bits, counts).astype("<u4").tobytes()
                end = np.cumsum(n)
                start = np.concatenate([np.cumsum(r["n_tokens"]) - r["n_tokens"] + r["before"] + bases[r["part"]] for r in part])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d for r in part for d in r["doc_ids"]], pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array([raw[4 * x : 4 * y] for x, y in zip((end - n).tolist(), end.tolist())], pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def report(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Writes all documents, reads the folder back and returns where each document lies and its checksum."""
    path = path or shared_dir(docs.sparkSession)
    write(docs, path, tokenizer)
    back = read(docs.sparkSession, path)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
