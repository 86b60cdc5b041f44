"""Embedding whitening: blockwise TSQR, then a one-sided Jacobi SVD of the triangle.

Entries become whole numbers x = floor(64 * c) + 1000000. The fit list holds each different vector of them once; its
count n and its sums S are exact, so n * x - S is too, and rows are centred before anything is multiplied. Each task
takes its rows of the fit list in blocks, puts a block under the triangle it has, and keeps the triangle R of their QR
decomposition; triangles of tasks are merged FAN at a time until one is left. Plane rotations then make R's columns
orthogonal, all disjoint pairs of a round at once; the accumulated rotations are the components, the lengths of the
columns (over the root of n) their standard deviations. No covariance matrix is ever formed to get them, so small
components keep their digits.

Data move once: the different vectors, in as few bytes an entry as a vector needs. What is broadcast are n, S and the
components (dimensions times dimensions numbers at most); R has the same size.

Edge cases: null vectors and vectors with a null or non-finite entry are dropped; so are empty ones, and all whose
length isn't the most frequent one (of equals the longest). Entries beyond +-2^45 are taken as +-2^45. Equal rows are
one in the fit list and are all returned; a null vec_id is returned. Components without variance are left out: those
whose standard deviation is below 1e-11 of the largest, so a single different vector has no rows. A deviation that
does not fit into a long is null. An empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import stored

#: Components that are returned at most.
COMPONENTS = 16

#: Numbers of a block of rows, and triangles that are merged in one task.
BLOCK, FAN = 1 << 20, 16

SCALE, SHIFT, LARGEST = 64, 1_000_000, float(1 << 45)

#: Columns count as orthogonal if their cosine is below; sweeps at most.
ORTHOGONAL, SWEEPS = 1e-15, 60

#: Standard deviations below this share of the largest count as none.
NOTHING = 1e-11

_KINDS = (np.int8, np.int16, np.int32, np.int64)


def vectors(rows: DataFrame) -> DataFrame:
    """vec_id, dims and x of the rows that remain; x: the whole numbers less SHIFT, in the narrowest type, equal for equal vectors."""

    def run(batches):
        for b in batches:
            v = b.column("embedding")
            good = np.flatnonzero(pc.fill_null(pc.greater(pc.list_value_length(v), 0), False).to_numpy(zero_copy_only=False))
            v = v.take(pa.array(good))
            c = pc.fill_null(v.flatten(), np.nan).to_numpy(zero_copy_only=False)
            dims = pc.list_value_length(v).to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.concatenate([[0], np.cumsum(dims)])
            with np.errstate(over="ignore"):
                x = np.floor(SCALE * c)
            fine = np.logical_and.reduceat(np.isfinite(c), at[:-1]) if len(dims) else np.zeros(0, bool)
            x = np.clip(np.where(np.isfinite(c), x, 0), -LARGEST, LARGEST).astype(np.int64)
            size = np.maximum.reduceat(np.abs(2 * x + 1), at[:-1]) if len(dims) else np.zeros(0, np.int64)
            kind = (size >= 1 << 8).astype(int) + (size >= 1 << 16) + (size >= 1 << 32)
            packed = [x[at[i] : at[i + 1]].astype(_KINDS[kind[i]]).tobytes() for i in np.flatnonzero(fine)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(pa.array(good[fine])), pa.array(dims[fine]), pa.array(packed, pa.binary())], ["vec_id", "dims", "x"])

    own = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return own.mapInArrow(run, "vec_id long, dims long, x binary")


def _numbers(col, dims: int) -> np.ndarray:
    """A row of whole numbers for each packed vector."""
    out = np.empty((len(col), dims), np.int64)
    size = pc.binary_length(col).to_numpy(zero_copy_only=False)
    for kind in _KINDS:
        own = np.flatnonzero(size == dims * np.dtype(kind).itemsize)
        if len(own):
            out[own] = np.array(col.take(pa.array(own)).to_pylist(), dtype=f"V{dims * np.dtype(kind).itemsize}").view(kind).reshape(len(own), dims)
    return out


def _parts(batches: Iterable[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches and their whole numbers, BLOCK numbers at a time."""
    step = max(1, BLOCK // dims)
    for b in batches:
        for lo in range(0, b.num_rows, step):
            part = b.slice(lo, step)
            yield part, _numbers(part.column("x"), dims)


def totals(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """How many vectors the fit list has, and their exact sums (of the numbers less SHIFT)."""

    def run(batches):
        n, high, low = 0, np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for _, x in _parts(batches, dims):  # in two halves, which don't overflow
            n, high, low = n + len(x), high + (x >> 20).sum(axis=0), low + (x & ((1 << 20) - 1)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([n] * dims), pa.array(range(dims), pa.int32()), pa.array(high), pa.array(low)], ["n", "dim", "high", "low"])

    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    out, n = [0] * dims, 0
    for r in fit.mapInArrow(run, "n long, dim int, high long, low long").groupBy("dim").agg(F.sum("n").alias("n"), exact("high").alias("high"), exact("low").alias("low")).toLocalIterator():
        n, out[r["dim"]] = r["n"], (int(r["high"]) << 20) + int(r["low"])
    return n, out


def centred(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """n * x - S exactly (as Python's numbers if they are large), and x - S / n."""
    fits = n * (int(np.abs(x).max(initial=0)) + 1) + max(map(abs, sums)) < 1 << 62
    exact = n * x - np.array(sums, np.int64) if fits else n * x.astype(object) - np.array(sums, object)
    return exact, (exact / n).astype(np.float64)


def triangle(fit: DataFrame, dims: int, n: int, sums: list[int]) -> np.ndarray:
    """R of the QR decomposition of the centred fit list."""

    def reduced(blocks: Iterator[np.ndarray]):
        r = np.zeros((0, dims))
        for b in blocks:
            r = np.linalg.qr(np.vstack([r, b]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], ["r"])

    def first(batches):
        return reduced(centred(x, n, sums)[1] for _, x in _parts(batches, dims))

    def merge(batches):
        return reduced(np.frombuffer(r.as_buffer()).reshape(-1, dims) for b in batches for r in b.column("r"))

    rs = stored(fit.mapInArrow(first, "r binary"))
    left = rs.count()
    while left > 1:
        tasks = -(-left // FAN)
        rs = stored(rs.repartition(tasks).mapInArrow(merge, "r binary"))
        left = rs.count()
    return np.frombuffer(bytes(rs.first()["r"])).reshape(-1, dims)


def _rounds(d: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of d columns (d even) in d - 1 rounds of disjoint pairs: one stays, the others move round a circle."""
    ring = np.arange(d)
    for _ in range(d - 1):
        yield ring[: d // 2], ring[: d // 2 - 1 : -1]
        ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values and right singular vectors (columns) of a matrix, the largest first."""
    dims = r.shape[1]
    d = dims + dims % 2
    a = np.zeros((d, r.shape[0]))  # columns as rows, which lie together in memory
    a[:dims] = r.T
    unit = np.abs(a).max(initial=0) or 1.0
    a, v = a / unit, np.eye(d)
    for _ in range(SWEEPS):
        worst = 0.0
        for i, j in _rounds(d):
            x, y = a[i], a[j]
            xx, yy, xy = (x * x).sum(axis=1), (y * y).sum(axis=1), (x * y).sum(axis=1)
            size = np.maximum(np.sqrt(xx) * np.sqrt(yy), np.finfo(float).tiny)
            turn = np.abs(xy) > np.maximum(ORTHOGONAL * size, np.finfo(float).tiny)
            if not turn.any():
                continue
            worst = max(worst, float((np.abs(xy[turn]) / size[turn]).max()))
            i, j, x, y, xx, yy, xy = i[turn], j[turn], x[turn], y[turn], xx[turn], yy[turn], xy[turn]
            z = (yy - xx) / (2 * xy)
            t = np.where(z < 0, -1.0, 1.0) / (np.abs(z) + np.hypot(1, z))
            c = 1 / np.hypot(1, t)
            s = c * t
            a[i], a[j] = c[:, None] * x - s[:, None] * y, s[:, None] * x + c[:, None] * y
            p, q = v[i], v[j]
            v[i], v[j] = c[:, None] * p - s[:, None] * q, s[:, None] * p + c[:, None] * q
        if worst <= 4 * ORTHOGONAL:
            break
    length = np.sqrt((a * a).sum(axis=1))[:dims]  # a column that was added stays a zero column
    order = np.argsort(-length, kind="stable")
    return length[order] * unit, v[:dims, :dims][order].T


def model(fit: DataFrame, dims: int, components: int = COMPONENTS) -> dict | None:
    """n, sums, components (columns) with standard deviations and shares of the variance, and the identity error."""
    n, sums = totals(fit, dims)
    if not n:
        return None
    length, axes = jacobi(triangle(fit, dims, n, sums))
    deviation = length / np.sqrt(n)
    k = int((deviation > NOTHING * deviation[0]).sum()) if deviation[0] > 0 else 0
    if not k:
        return None
    axes = axes * np.where(np.take_along_axis(axes, np.abs(axes).argmax(axis=0)[None], 0)[0] < 0, -1.0, 1.0)  # the largest entry is positive
    shown = min(k, components)
    out = {"n": n, "sums": sums, "axes": axes[:, :shown], "deviation": deviation[:shown], "explained": (deviation**2 / (deviation**2).sum())[:shown]}
    return out | {"identity_error": _identity_error(fit, dims, out)}


def whiten(x: np.ndarray, fitted: dict) -> tuple[np.ndarray, np.ndarray]:
    """n * x - S, and the whitened rows."""
    exact, c = centred(x, fitted["n"], fitted["sums"])
    return exact, c @ fitted["axes"] / fitted["deviation"]


def _identity_error(fit: DataFrame, dims: int, fitted: dict) -> float:
    """The largest entry of the covariance of the whitened fit list, less the identity; measured, not derived."""
    k = len(fitted["deviation"])
    shared = fit.sparkSession.sparkContext.broadcast(fitted)

    def moments(batches):
        sums, squares = np.zeros(k), np.zeros((k, k))
        for _, x in _parts(batches, dims):
            w = whiten(x, shared.value)[1]
            sums, squares = sums + w.sum(axis=0), squares + w.T @ w
        values = np.concatenate([sums, squares.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array(values)], ["at", "value"])

    rows = fit.mapInArrow(moments, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()  # k + k * k numbers
    values = np.zeros(k + k * k)
    for r in rows:
        values[r["at"]] = r["value"] / fitted["n"]
    mean = values[:k]
    return float(np.abs(values[k:].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def whitened(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row for each remaining row of rows (vec_id, embedding) and component."""
    spark = rows.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    every = stored(vectors(rows))
    lengths = every.groupBy("dims").count().orderBy(F.desc("count"), F.desc("dims")).first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    dims = lengths["dims"]
    own = every.where(F.col("dims") == dims)
    fitted = model(stored(own.select("x").distinct()), dims, components)
    if fitted is None:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(fitted)

    def run(batches):
        m = shared.value
        k = len(m["deviation"])
        for b, x in _parts(batches, dims):
            exact, w = whiten(x, m)
            near = exact.dtype != object and float(np.abs(exact.astype(np.float64)).max(initial=0)) ** 2 * dims < 2.0**62
            squares = (exact * exact).sum(axis=1) if near else [s if s < 1 << 63 else None for s in (sum(int(e) ** 2 for e in r) for r in exact)]
            again = pa.array(np.repeat(np.arange(b.num_rows), k))
            count = b.num_rows * k
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id").take(again), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), b.num_rows)), pa.array(np.full(count, m["n"])), pa.array(squares, pa.int64()).take(again)]
                + [pa.array(w.ravel()), pa.array(np.tile(m["explained"], b.num_rows)), pa.array(np.full(count, m["identity_error"]))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return own.select("vec_id", "x").mapInArrow(run, schema)
