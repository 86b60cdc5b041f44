"""Ranked lexical search: postings are traversed in fixed windows of documents.

The index is a table with a row for each term of each window. A window is up to WINDOW documents that are read
together, numbered from 0 in ascending order of doc_id (a slot); a posting is a slot with the number of occurrences.
So a window's scores are one array of WINDOW numbers, which stays in a core's cache. A search joins the terms of its
items with the index, gathers each window's matching postings in one place, and takes window after window: for each
item the contributions of its terms are added into the array at their slots, a bitset notes which slots are occupied,
and the occupied slots are harvested into the item's heap of k documents. Tasks give k rows an item at most; the
best of them are taken at the end.

Making the index is one pass over the texts without a shuffle; a search shuffles the postings of its terms only. Items
are searched in blocks of BLOCK_TERMS terms at most (or one longer item), which bounds what is broadcast. Terms are
compared as strings; hashes only group the words of a window, and their bytes are compared too.

Edge cases: null and empty texts, and texts without a term, are no documents (they count neither in N nor in L); an
item without a term has no rows; rows of one item_id are one item with the terms of all; a null item_id or doc_id is
an id like others, and among equal scores a null doc_id comes last; repeated documents are ranked each, in any order;
very long texts are a window alone; without documents or items there are no rows; other columns, whatever their
names, are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as T
from .session import stored

#: Documents of a window; its scores take 32 kB.
WINDOW = 4096

#: Bytes of text after which a window ends early.
WINDOW_BYTES = 12 << 20

#: Different terms of the items that are searched at once.
BLOCK_TERMS = 200_000

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_SCHEMA = "window long, term string, n_docs long, slots binary, tfs binary, ids array<long>, lengths array<long>"


def index(docs: DataFrame, window: int = WINDOW, window_bytes: int = WINDOW_BYTES) -> DataFrame:
    """The postings of docs (doc_id, text), and for each window a row without a term: its documents and their lengths."""

    def run(batches):
        for k, w in enumerate(_windows(batches, window, window_bytes)):
            yield from _inverted(w, (TaskContext.get().partitionId() << 32) + k)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SCHEMA)


def _windows(batches: Iterable[pa.RecordBatch], rows: int, size: int) -> Iterator[pa.Table]:
    """The rows in tables of ``rows`` rows; fewer where the texts are long, and at the end."""
    held, n, n_bytes = [], 0, 0
    for b in T.slices(batches, size=min(size, T.SLICE_BYTES)):
        at = 0
        while at < b.num_rows:
            part = b.slice(at, rows - n)
            held.append(part)
            n, n_bytes, at = n + part.num_rows, n_bytes + part.nbytes, at + part.num_rows
            if n == rows or n_bytes >= size:
                yield pa.Table.from_batches(held)
                held, n, n_bytes = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def _inverted(window: pa.Table, number: int) -> Iterator[pa.RecordBatch]:
    """The rows of the index for one window."""
    window = window.take(pc.sort_indices(window.column("doc_id")))  # a null comes last
    buf, off = T.buffer(window.column("text"))
    buf = T._FOLD[buf]
    starts, ends = T.words(buf, T.ALNUM)
    n = np.diff(T.per_text(starts, off))
    if not len(starts):
        return
    live = np.flatnonzero(n)
    owner = np.repeat(np.arange(len(live)), n[live])
    h = T.hashes(buf, starts, ends, fold=False)
    _, first, _, term = T.distinct(h)
    if not T.equal(buf, starts[first[term]], buf, starts, np.minimum(ends - starts, (ends - starts)[first[term]])).all() or (ends - starts != (ends - starts)[first[term]]).any():
        first, term = _by_bytes(buf, starts, ends)
    pairs, tf = np.unique(term * len(live) + owner, return_counts=True)
    slot, of = pairs % len(live), pairs // len(live)
    at = np.searchsorted(of, np.arange(len(first) + 1))
    width = np.uint16 if tf.max() < 1 << 16 else np.uint32
    byte, _ = T.ranges(starts[first], ends[first])
    terms = pa.Array.from_buffers(pa.string(), len(first), [None, _offsets(ends[first] - starts[first]), pa.py_buffer(buf[byte])])
    none = lambda rows, kind: pa.nulls(rows, kind)
    long = pa.list_(pa.int64())
    ids = window.column("doc_id").combine_chunks().take(pa.array(live))
    names = [c.split()[0] for c in _SCHEMA.split(", ")]
    yield pa.RecordBatch.from_arrays(
        [pa.array([number]), none(1, pa.string()), pa.array([len(live)]), none(1, pa.binary()), none(1, pa.binary()), pa.array([ids.to_pylist()], long), pa.array([n[live]], long)], names
    )
    for x in range(0, len(first), 1 << 14):
        y = min(len(first), x + (1 << 14))
        count = np.diff(at[x : y + 1])
        own = slice(at[x], at[y])
        packed = [pa.Array.from_buffers(pa.binary(), y - x, [None, _offsets(count * v.itemsize), pa.py_buffer(v)]) for v in (slot[own].astype(np.uint16), tf[own].astype(width))]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(y - x, number)), terms.slice(x, y - x), pa.array(count), *packed, none(y - x, long), none(y - x, long)], names)


def _offsets(lengths: np.ndarray) -> pa.Buffer:
    return pa.py_buffer(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))


def _by_bytes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place of each different word, and the word at each place, if two of them share a hash."""
    seen: dict[bytes, int] = {}
    first, term = [], np.empty(len(starts), np.int64)
    for i, (s, e) in enumerate(zip(starts.tolist(), ends.tolist())):
        w = buf[s:e].tobytes()
        if w not in seen:
            seen[w] = len(first)
            first.append(i)
        term[i] = seen[w]
    return np.array(first), term


def _blocks(items: DataFrame, block_terms: int) -> Iterator[list[tuple[int | None, list[str]]]]:
    """Items with their different terms, in blocks of bounded size."""
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(F.array_distinct(F.regexp_extract_all(lowered, F.lit(f"({TERM})")))).alias("term"))
    block, size = [], 0
    for r in words.groupBy("item_id").agg(F.sort_array(F.collect_set("term")).alias("terms")).toLocalIterator():
        if block and size + len(r["terms"]) > block_terms:
            yield block
            block, size = [], 0
        block.append((r["item_id"], r["terms"]))
        size += len(r["terms"])
    if block:
        yield block


def search(indexed: DataFrame, items: DataFrame, k: int = 10, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of each item (item_id, text); indexed: a stored index()."""
    spark = indexed.sparkSession
    total = indexed.where("term is null").agg(F.sum("n_docs").alias("n"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("l")).first()
    best = None
    for block in _blocks(items, block_terms) if total["n"] else ():
        own = _searched(spark, indexed, block, total["n"], total["l"], k)
        best = own if best is None else best.unionAll(own)
    if best is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    by = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return best.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _searched(spark, indexed: DataFrame, block: list, n: int, length: int, k: int) -> DataFrame:
    """At most k documents of each item of the block for each task."""
    terms = sorted({t for _, own in block for t in own})
    number = {t: i for i, t in enumerate(terms)}
    asked = F.broadcast(spark.createDataFrame(pa.table({"term": pa.array(terms, pa.string()), "tid": pa.array(range(len(terms)), pa.int32())})))  # a block's terms
    weight = F.floor(1000 * F.log((2 * F.lit(n) + 2).cast("double") / (2 * F.sum("n_docs") + 1).cast("double"))).cast("long")
    w = np.zeros(len(terms), np.int64)
    for r in indexed.join(asked, "term").groupBy("tid").agg(weight.alias("w")).toLocalIterator():
        w[r["tid"]] = r["w"]
    shared = spark.sparkContext.broadcast((w, [i for i, _ in block], [np.array([number[t] for t in own]) for _, own in block]))
    found = indexed.join(asked, "term", "left").where("tid is not null or term is null")
    postings = found.select("window", F.coalesce("tid", F.lit(-1)).alias("tid"), "slots", "tfs", "ids", "lengths")
    near = postings.repartition("window").sortWithinPartitions("window", "tid")

    def run(batches):
        w, ids, wanted = shared.value
        heaps: list[list] = [[] for _ in ids]
        for docs, lengths, tids, slots, tfs in _gathered(batches):
            m = 100 - 90 + (90 * lengths * n) // length
            at = np.cumsum([0, *map(len, slots)])
            lo, hi = np.zeros(len(w), np.int64), np.zeros(len(w), np.int64)
            lo[tids], hi[tids] = at[:-1], at[1:]
            slot, tf = np.concatenate([np.zeros(0, np.int64), *slots]).astype(np.int64), np.concatenate([np.zeros(0, np.int64), *tfs]).astype(np.int64)
            gain = np.repeat(w[tids], np.diff(at)) * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[slot]))
            scores, occupied = np.zeros(len(docs), np.int64), np.zeros(len(docs), bool)
            for heap, own in zip(heaps, wanted):
                p, _ = T.ranges(lo[own], hi[own])
                np.add.at(scores, slot[p], gain[p])
                occupied[slot[p]] = True
                full = np.flatnonzero(occupied)
                _harvest(heap, scores[full], docs, full, k)
                scores[full], occupied[full] = 0, False
        rows = [(i, -d if d > -np.inf else None, s) for i, heap in zip(ids, heaps) for s, d in heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], ["item_id", "doc_id", "score"])

    return near.mapInArrow(run, "item_id long, doc_id long, score long")


def _gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Documents, their lengths, and the numbers, slots and counts of the terms that occur, window by window."""
    docs, current = None, None
    for b in batches:
        for window, tid, slots, tfs, ids, lengths in zip(*(b.column(c) for c in ("window", "tid", "slots", "tfs", "ids", "lengths"))):
            if tid.as_py() < 0:
                if docs is not None:
                    yield docs, n, np.array(tids, np.int64), of, counts
                docs, n, tids, of, counts = ids.as_py(), np.array(lengths.as_py(), np.int64), [], [], []
            else:
                s = np.frombuffer(slots.as_buffer(), np.uint16)
                tids.append(tid.as_py())
                of.append(s)
                counts.append(np.frombuffer(tfs.as_buffer(), np.uint16 if tfs.as_buffer().size == s.nbytes else np.uint32))
    if docs is not None:
        yield docs, n, np.array(tids, np.int64), of, counts


def _harvest(heap: list, scores: np.ndarray, docs: list, slots: np.ndarray, k: int) -> None:
    """Puts the best of a window's occupied slots into the heap of (score, -doc_id)."""
    floor = heap[0][0] if len(heap) == k else 1
    good = np.flatnonzero(scores >= max(floor, 1))
    if len(good) > k:  # slots ascend with doc_id, so the first of equal scores are the ones to take
        good = good[np.argsort(-scores[good], kind="stable")[:k]]
    for s, slot in zip(scores[good].tolist(), slots[good].tolist()):
        entry = (s, -np.inf if docs[slot] is None else -docs[slot])
        if len(heap) < k:
            heapq.heappush(heap, entry)
        else:
            heapq.heappushpop(heap, entry)


def report(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The k best documents of each item, from an index of docs that is written first."""
    return search(stored(index(docs)), items, k)
