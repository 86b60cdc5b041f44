"""Toxicity by FTRL-proximal logistic regression.

Features are the lower-cased words of a whole text, pairs of neighbours, pairs one word apart, and the
first bytes of longer words, hashed to BITS bits; each counts once as present, once more if it occurs
twice and once more if it occurs three times. The weights are learned online from a bounded sample of
labelled rows that streams through the driver one partition at a time: each coordinate has its own rate,
and the L1 term leaves most weights at zero, so that the rest is a small table (at most 3 * 2^BITS + 1
entries) which is broadcast. Scoring is one pass without a shuffle.

Edge cases: null and empty texts have no feature and get the bias alone; a document with several labels
takes the highest; without labels all scores are 0.5; repeated rows score alike; an empty table gives no rows;
very long texts are worked on alone; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .samples import texts_of
from .session import stored

#: Labelled rows that are learned from at most: those with the lowest hash of doc_id.
SAMPLE_ROWS = 12_000

BITS = 20
SIZE = 1 << BITS

#: Bytes of the word beginnings that are features.
BEGINNINGS = (5, 6, 7, 8)

ALPHA, BETA, L1, L2, EPOCHS = 0.1, 1.0, 2.0, 0.1, 4


def features(col) -> tuple[np.ndarray, np.ndarray, int]:
    """Feature numbers of all texts, the text of each, and how many texts there are."""
    buf, off = T.buffer(col)
    starts, ends = T.words(buf, T.ALNUM)
    n = np.diff(T.per_text(starts, off))
    owner = np.repeat(np.arange(len(n), dtype=np.uint32), n)
    number = lambda x: (x >> T.U64(64 - BITS)).astype(np.uint32)
    h = T.hashes(buf, starts, ends, fold=True)
    ids, of = [number(h)], [owner]
    for gap, salt in ((1, 0x51ED270B), (2, 0x2545F491)):
        if len(h) > gap:
            inside = owner[gap:] == owner[:-gap]
            ids.append(number(T.mix(h[:-gap] * T.U64(0x9E3779B97F4A7C15) + h[gap:] + T.U64(salt)))[inside])
            of.append(owner[gap:][inside])
    for k in BEGINNINGS:
        long = ends - starts > k
        ids.append(number(T.mix(T.hashes(buf, starts[long], starts[long] + k, fold=True) + T.U64(k))))
        of.append(owner[long])
    return np.concatenate(ids), np.concatenate(of), len(n)


def _counted(f: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Sorted keys of text and feature, a feature once more for its second and third occurrence."""
    key = np.sort((of.astype(T.U64) << T.U64(32)) | f)
    same = np.concatenate([[False], key[1:] == key[:-1]]) if len(key) else np.zeros(0, bool)
    third = same & np.concatenate([[False], same[:-1]])[: len(same)]
    again = same & ~third
    fourth = third & np.concatenate([[False], third[:-1]])[: len(third)]
    return np.concatenate([key[~same], key[again] + T.U64(SIZE), key[third & ~fourth] + T.U64(2 * SIZE)])


def _packed(batches: Iterable[pa.RecordBatch]):
    for b in T.slices(batches):
        f, of, n = features(b.column("text"))
        key = np.sort(_counted(f, of))
        cut = np.searchsorted(key >> T.U64(32), np.arange(n + 1).astype(T.U64))
        f = (key & T.U64(0xFFFFFFFF)).astype(np.uint32)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), b.column("toxic"), pa.array([f[x:y].tobytes() for x, y in zip(cut, cut[1:])], pa.binary())], ["doc_id", "row", "toxic", "features"])


def learn(rows: Iterable[tuple[int, np.ndarray]], state: dict | None = None) -> dict:
    """One pass of FTRL-proximal over (label, feature numbers); state has z and n of each coordinate."""
    s = state or {"z": np.zeros(3 * SIZE + 1), "n": np.zeros(3 * SIZE + 1)}
    z, n = s["z"], s["n"]
    for y, f in rows:
        f = np.append(f, 3 * SIZE)  # the bias
        w = weights(s, f)
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30)))
        g = p - y
        z[f] += g - (np.sqrt(n[f] + g * g) - np.sqrt(n[f])) / ALPHA * w
        n[f] += g * g
    return s


def weights(s: dict, at=slice(None)) -> np.ndarray:
    """The weights that z and n stand for; zero where L1 holds them."""
    z, n = s["z"][at], s["n"][at]
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def model(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers with their nonzero weights; the bias is number 3 * SIZE."""
    marked = (
        labels.where("toxic is not null and doc_id is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
    )
    packed = texts_of(docs, marked, "toxic", sample_rows).mapInArrow(_packed, "doc_id long, row long, toxic int, features binary")
    once = packed.groupBy("doc_id", "row", "toxic").agg(F.first("features").alias("features"))
    sample = stored(once.repartition(8, F.xxhash64("doc_id")).sortWithinPartitions("doc_id", "toxic", "row"))
    state = None
    for _ in range(EPOCHS):
        state = learn(((r["toxic"], np.frombuffer(bytes(r["features"]), np.uint32).astype(np.int64)) for r in sample.toLocalIterator()), state)
    w = weights(state)
    at = np.flatnonzero(w)
    return at, w[at]


def scored(docs: DataFrame, fitted: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id and score of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted)

    def run(batches):
        at, w = shared.value
        dense = np.zeros(3 * SIZE + 1, np.float64)
        dense[at] = w
        any_of = (dense[:-1].reshape(3, SIZE) != 0).any(axis=0)
        for b in T.slices(batches):
            f, of, n = features(b.column("text"))
            hit = any_of[f]
            key = _counted(f[hit], of[hit])
            s = dense[-1] + np.bincount((key >> T.U64(32)).astype(np.int64), weights=dense[(key & T.U64(0xFFFFFFFF)).astype(np.int64)], minlength=n)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(s, -30, 30))), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def held_out() -> Column:
    """Whether a row is kept away from learning; a null doc_id is not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document with its score; learned from labels of documents that are not held out."""
    fitted = model(docs, labels.where(~held_out()))
    return scored(docs, fitted).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
