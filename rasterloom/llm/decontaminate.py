"""Benchmark decontamination with suffix arrays.

Every slice of the training texts becomes one suffix array over its words. Each suffix of each benchmark
item is searched in it by narrowing an interval word by word, which gives its longest verbatim match and
all places where a whole window occurs. A text never leaves its slice, so nothing is shuffled.

Edge cases: null and empty texts have no words, so no match; items without words are ignored; an item of
fewer words than a window is one window by itself; repeated items and repeated rows are each reported;
items with a null item_id are searched like others: their hits have a null item_id, and in the report all of
them are one more item in n_items, and none in the digest, which lists item_ids;
an empty table gives no rows; a text longer than a slice is a slice by itself; of items that match equally far
longest_item is the first in the benchmark's order; columns that clash with the results are kept by
decontaminated() and not read by report(), like all other columns. Windows match by 128 bits of hash a word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .names import set_aside
from .session import stored

#: Words of a window.
WINDOW = 10

#: Benchmark words that are sent to the executors at once (8 bytes each); more go in further passes.
BLOCK_WORDS = 200_000

#: Bytes of training text in one suffix array.
SHARD_BYTES = 8 << 20

#: Words that are hashed at once, since hashing needs several times their bytes.
HASHED_WORDS = 1 << 17


class Probes:
    """The suffixes of a block of benchmark items."""

    def __init__(self, item_ids: list[int | None], hashes: list[np.ndarray], window: int):
        """hashes: of each item, the first family's for all words and then the second one's."""
        self.ids = item_ids
        n = np.array([len(h) // 2 for h in hashes], np.int64)
        self.words = np.concatenate([*(h[: len(h) // 2] for h in hashes), np.zeros(1, T.U64)])
        self.more = np.concatenate([*(h[len(h) // 2 :] for h in hashes), np.zeros(1, T.U64)])
        lo = np.cumsum(n) - n
        self.at, self.item = T.ranges(lo, lo + n)
        self.left = (lo + n)[self.item] - self.at
        whole = n[self.item] < window
        self.need = np.where(whole, n[self.item], window)
        self.longest = int(n.max(initial=0))


def suffix_array(h: np.ndarray, depth: int) -> np.ndarray:
    """Positions of h in the order of the words from there on, as far as ``depth`` words tell."""
    n = len(h)
    at = T.order(h)
    k = h[at]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    rank = np.empty(n, np.int64)
    rank[at] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    step = 1
    while step < depth:
        tied = ~new
        tied[:-1] |= ~new[1:]
        slots = np.flatnonzero(tied)
        if not len(slots):
            break
        pos = at[slots]
        nxt = pos + step
        second = np.where(nxt < n, rank[np.minimum(nxt, n - 1)] + 1, 0)
        key = (rank[pos].astype(T.U64) << T.U64(32)) | second.astype(T.U64)
        o = T.order(key) if n < 1 << 31 else np.argsort(key)
        at[slots], key = pos[o], key[o]
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        new[slots] |= fresh
        rank[at[slots]] = np.maximum.accumulate(np.where(fresh, slots, 0))
        step *= 2
    return at


def search(h: np.ndarray, sa: np.ndarray, q: Probes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each probe: the words of its longest match, one place of it, and the interval of its window (empty without one)."""
    n, m = len(sa), len(q.at)
    lo, hi = np.zeros(m, np.int64), np.full(m, n, np.int64)
    length, place = np.zeros(m, np.int64), np.full(m, -1, np.int64)
    wlo, whi = np.zeros(m, np.int64), np.zeros(m, np.int64)
    live, depth = np.arange(m), 0
    while len(live):
        want = q.words[q.at[live] + depth]
        bounds = []
        for right in (False, True):
            a, b = lo[live].copy(), hi[live].copy()
            while True:
                act = np.flatnonzero(a < b)
                if not len(act):
                    break
                mid = (a[act] + b[act]) >> 1
                p = sa[mid] + depth
                have = np.where(p < n, h[np.minimum(p, n - 1)], T.U64(0))
                less = have <= want[act] if right else have < want[act]
                a[act[less]] = mid[less] + 1
                b[act[~less]] = mid[~less]
            bounds.append(a)
        ok = bounds[1] > bounds[0]
        live = live[ok]
        lo[live], hi[live] = bounds[0][ok], bounds[1][ok]
        depth += 1
        length[live], place[live] = depth, sa[lo[live]]
        full = live[q.need[live] == depth]
        wlo[full], whi[full] = lo[full], hi[full]
        live = live[q.left[live] > depth]
    return length, place, wlo, whi


def _shards(batches, size: int) -> Iterator[pa.RecordBatch]:
    """Batches of about ``size`` bytes of text."""
    held, got = [], 0
    for b in T.slices(batches, size=size):
        n = b.column("text").nbytes
        if held and got + n > size:
            yield pa.concat_batches(held)
            held, got = [], 0
        held.append(b)
        got += n
    if held:
        yield pa.concat_batches(held)


def _sequence(col) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Callable[[np.ndarray], np.ndarray]]:
    """Word hashes of all texts with a 0 after each text; the text of each; where each text starts; words of each text;
    and the second family's hashes of words of the sequence."""
    buf, off = T.buffer(col)
    starts, ends = T.words(buf, T.ALNUM)
    bounds = T.per_text(starts, off)
    n = np.diff(bounds)
    owner = np.repeat(np.arange(len(n)), n)
    h = np.zeros(len(starts) + len(n), T.U64)
    to = np.arange(len(starts)) + owner
    for lo in range(0, len(starts), HASHED_WORDS):
        a, b = starts[lo : lo + HASHED_WORDS], ends[lo : lo + HASHED_WORDS]
        h[to[lo : lo + HASHED_WORDS]] = T.hashes(buf[a[0] : b[-1]], a - a[0], b - a[0], fold=True)
    owners = np.repeat(np.arange(len(n)), n + 1)

    def more(at: np.ndarray) -> np.ndarray:
        k = at - owners[at]
        return T.hashes(buf, starts[k], ends[k], fold=True, family=1)

    return h, owners, np.cumsum(n + 1) - (n + 1), n, more


def _blocks(benchmark: DataFrame, window: int, block_words: int) -> Iterator[Probes]:
    """The benchmark in blocks of bounded size; long items are cut into parts that share window - 1 words."""

    def cut(batches):
        for b in T.slices(batches):
            h, _, first, n, more = _sequence(b.column("text"))
            ids, parts, data = b.column("item_id").to_pylist(), [], []
            for i, item in enumerate(ids):
                for lo in range(0, max(1, int(n[i]) - window + 1), block_words):
                    at = np.arange(first[i] + lo, first[i] + min(int(n[i]), lo + block_words + window - 1))
                    if len(at):
                        parts.append(item)
                        data.append(h[at].tobytes() + more(at).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(data, pa.binary())], ["item_id", "words"])

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(cut, "item_id long, words binary")
    ids, hashes, size = [], [], 0
    for r in rows.toLocalIterator():
        h = np.frombuffer(bytes(r["words"]), T.U64)
        if ids and size + len(h) // 2 > block_words:
            yield Probes(ids, hashes, window)
            ids, hashes, size = [], [], 0
        ids.append(r["item_id"])
        hashes.append(h)
        size += len(h) // 2
    if ids:
        yield Probes(ids, hashes, window)


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with n_words, and with what occurs of the benchmark in each text.

    hits: array of (item_id, start, length): maximal runs of words covered by windows of that item.
    longest: words of the longest verbatim match of any benchmark suffix; longest_item: whose it is.
    """
    spark = docs.sparkSession
    kept = docs.columns
    out = docs.select(
        "*",
        F.lit(0).cast("long").alias("n_words"),
        F.expr("cast(array() as array<struct<item_id:bigint,start:bigint,length:bigint>>)").alias("hits"),
        F.lit(0).cast("long").alias("longest"),
        F.lit(None).cast("long").alias("longest_item"),
    )
    schema = out.schema
    blocks = _blocks(benchmark, window, block_words)  # the driver holds one block, and the next while it looks whether there is one
    probes = next(blocks, None) or Probes([], [], window)
    while True:
        shared = spark.sparkContext.broadcast(probes)
        out = out.mapInArrow(lambda batches, s=shared: _matched(batches, s.value, kept), schema)
        probes = next(blocks, None)
        if probes is None:
            return out
        out = stored(out)


def _matched(batches, q: Probes, kept: list[str]) -> Iterator[pa.RecordBatch]:
    for b in _shards(batches, SHARD_BYTES):
        h, owner, first, n, more = _sequence(b.column("text"))
        hits: list[list] = [list(x or []) for x in b.column("hits").to_pylist()]
        longest = b.column("longest").to_numpy(zero_copy_only=False).copy()
        best = b.column("longest_item").to_pylist()
        if len(q.at) and n.sum():
            sa = suffix_array(h, q.longest)
            length, place, lo, hi = search(h, sa, q)
            for k in np.flatnonzero(length):
                d = int(owner[place[k]])
                if length[k] > longest[d]:
                    longest[d], best[d] = length[k], q.ids[q.item[k]]
            slot, probe = T.ranges(lo, hi)
            pos = sa[slot]
            at, of = T.ranges(pos, pos + q.need[probe])
            if len(at):  # the second hashes decide
                every, back = np.unique(at, return_inverse=True)
                other = more(every)[back] != q.more[q.at[probe][of] + at - pos[of]]
                wrong = np.unique(of[other])
                pos, probe = np.delete(pos, wrong), np.delete(probe, wrong)
            o = np.lexsort((pos, q.item[probe], owner[pos]))
            pos, item, doc, end = pos[o], q.item[probe][o], owner[pos][o], (pos + q.need[probe])[o]
            if len(pos):
                edge = np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (pos[1:] > end[:-1])])
                # all windows of an item are as long, so their ends grow with their starts
                s = np.flatnonzero(edge)
                run_end = np.maximum.reduceat(end, s)
                for x, e in zip(s.tolist(), run_end.tolist()):
                    d = int(doc[x])
                    hits[d].append({"item_id": q.ids[item[x]], "start": int(pos[x] - first[d]), "length": int(e - pos[x])})
        cols = [b.column(c) for c in kept]
        cols += [pa.array(n, pa.int64()), pa.array(hits, b.schema.field("hits").type), pa.array(longest, pa.int64()), pa.array(best, pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, schema=b.schema)


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs in which no window of the benchmark occurs; all columns stay."""
    added = ("n_words", "hits", "longest", "longest_item")
    own, moved = set_aside(docs, added)
    return matches(own, benchmark, window).where(F.size("hits") == 0).drop(*added).withColumnsRenamed(moved)


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document with counts and a digest of the items found, and the longest match."""

    def digest(batches):
        for b in batches:
            rows = {"n_hit": [], "n_items": [], "items_sha256": []}
            for hits in b.column("hits").to_pylist():
                end = covered = 0
                for x in sorted((x["start"], x["start"] + x["length"]) for x in hits):
                    covered += max(0, x[1] - max(x[0], end))
                    end = max(end, x[1])
                found = {x["item_id"] for x in hits}
                ids = sorted(str(x) for x in found if x is not None)
                rows["n_hit"].append(covered)
                rows["n_items"].append(len(found))
                rows["items_sha256"].append(hashlib.sha256(",".join(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("n_words"), pa.array(rows["n_hit"], pa.int64()), pa.array(rows["n_items"], pa.int64()), pa.array(rows["items_sha256"], pa.string()), b.column("longest"), b.column("longest_item")],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "longest", "longest_item"],
            )

    found = matches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, window).drop("text")
    out = found.mapInArrow(digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, longest long, longest_item long")
    return out.withColumn("contaminated", F.col("n_hit") > 0)
