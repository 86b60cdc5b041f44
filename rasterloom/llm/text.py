"""Words and hashes of Arrow text columns, with numpy and without a Python loop over words.

All functions work on one buffer in which a line feed follows each text, so that no word, line or
window ever crosses from one text into the next.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64

#: Bytes of text that are worked on at once; a longer text is worked on alone.
SLICE_BYTES = 2 << 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32

#: Letters and digits of ASCII, and every byte of a character outside ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

#: All but space and the control characters tab to carriage return.
SPACED = np.ones(256, bool)
SPACED[[32, 9, 10, 11, 12, 13]] = False

_MUL = U64(0x9E3779B97F4A7C15)

#: Multipliers of the two independent families of hashes.
_LANE = [(U64(0xFF51AFD7ED558CCD), U64(0x2545F4914F6CDD1D)), (U64(0xC4CEB9FE1A85EC53), U64(0x9FB21C651E98DF25))]

#: Masks that leave the first k bytes of eight.
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=U64)

#: Eight-byte lanes of a part that are hashed side by side; the rest of longer parts is hashed one by one.
_LANES = 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(U64, copy=True)
    for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x ^= x >> U64(33)
        x *= U64(m)
    x ^= x >> U64(33)
    return x


def strings(col) -> pa.Array:
    """The column as one Arrow string array with large offsets; null becomes the empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    return pc.fill_null(col.cast(pa.large_string()), "")


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each holds about ``size`` bytes of text or one longer text."""
    for b in batches:
        if not b.num_rows:
            continue
        n = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(n + 1) // size
        cuts = np.flatnonzero(np.diff(part)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
            if hi > lo:
                yield b.slice(lo, hi - lo)
    _give_back()


def _give_back() -> None:
    """Returns what a task has freed to the system: workers live on, and the next stage's workers need the memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def buffer(col) -> tuple[np.ndarray, np.ndarray]:
    """All texts, each followed by a line feed, as bytes; and where each starts, and the end of all."""
    a = strings(col)
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    j = pc.binary_join_element_wise(a, pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string()))
    off = np.frombuffer(j.buffers()[1], np.int64)[j.offset : j.offset + len(j) + 1]
    return np.frombuffer(j.buffers()[2], np.uint8)[off[0] : off[-1]], off - off[0]


def words(buf: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of member bytes."""
    inside = member[buf].view(np.int8)
    step = np.diff(inside, prepend=np.int8(0))
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    return starts, ends if len(ends) == len(starts) else np.append(ends, len(buf))


def lanes(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each position, zeros after the end, as one number."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    return np.ndarray(len(buf) + 1, "<u8", padded, 0, (1,))


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool, family: int = 0) -> np.ndarray:
    """64-bit hashes, never 0, of the parts [start, end): equal bytes have equal hashes. fold lower-cases A-Z.

    Parts of one length of up to eight bytes never share a hash: every step is a bijection of the lane. The families
    are independent; two of them together make 128 bits."""
    if fold:
        buf = _FOLD[buf]
    lane = lanes(buf)
    a, b = _LANE[family]
    left = ends - starts
    out = left.astype(U64) * b
    live, at, h = np.arange(len(left)), starts, out
    for k in range(_LANES):
        if k:
            more = np.flatnonzero(left > 8)
            if len(more) < len(left):
                out[live] = h
                live, at, left, h = live[more], at[more], left[more], h[more]
            at, left = at + 8, left - 8
        if not len(live):
            break
        v = lane[at] & _FIRST[np.minimum(left, 8)]
        v *= a
        v ^= v >> U64(32)
        h = (h ^ v) * b
        h ^= h >> U64(29)
    out[live] = h
    for i in np.flatnonzero(left > 8).tolist() if len(live) else ():
        x = int(at[i]) + 8
        out[live[i]] ^= U64(xxhash.xxh3_64_intdigest(buf[x : x + int(left[i]) - 8], seed=family + 1))
    out = mix(out)
    out[out == 0] = 1
    return out


def equal(x: np.ndarray, a: np.ndarray, y: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether x[a:a+n] and y[b:b+n] are the same bytes, for all parts."""
    out = np.ones(len(n), bool)
    one, two = lanes(x), lanes(y) if y is not x else None
    two = one if two is None else two
    live = np.flatnonzero(n > 0)
    a, b, left = a[live], b[live], n[live]
    for k in range(_LANES):
        if not len(live):
            return out
        m = _FIRST[np.minimum(left, 8)]
        same = (one[a] & m) == (two[b] & m)
        out[live[~same]] = False
        more = np.flatnonzero(same & (left > 8))
        live, a, b, left = live[more], a[more] + 8, b[more] + 8, left[more] - 8
    for i, p, q, m in zip(live.tolist(), a.tolist(), b.tolist(), left.tolist()):
        out[i] = bool((x[p : p + m] == y[q : q + m]).all())
    return out


def per_text(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of the sorted starts lie before each offset: the words of text i are [out[i], out[i+1])."""
    return np.searchsorted(starts, offsets)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive word hashes; the last n-1 words start none."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    s = np.zeros(m, U64)
    for j in range(n):
        s = s * _MUL + h[j : j + m]
    s = mix(s)
    s[s == 0] = 1
    return s


def gram_spans(bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the n-grams of each text start and end, given the bounds of its words."""
    lo, hi = bounds[:-1], bounds[1:]
    return lo, np.maximum(lo, hi - n + 1)


def ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All whole numbers of [lo, hi) for each pair, and which pair each comes from."""
    n = np.maximum(hi - lo, 0)
    owner = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n), owner


def order(keys: np.ndarray) -> np.ndarray:
    """A sorting permutation of 64-bit keys: sorts leading bits and position in one word, which is
    several times faster than argsort, and falls back to it where the leading bits don't decide."""
    n = len(keys)
    bits = max(1, int(n - 1).bit_length()) if n else 1
    low = U64((1 << bits) - 1)
    at = (np.sort((keys & ~low) | np.arange(n, dtype=U64)) & low).astype(np.int64)
    k = keys[at]
    return at if bool((k[1:] >= k[:-1]).all()) else np.argsort(keys, kind="stable")


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys; the first position of each; the number of each; and, for each position, its key's index."""
    if not len(keys):
        z = np.zeros(0, np.int64)
        return keys, z, z, z
    at = order(keys)
    k = keys[at]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    first = np.flatnonzero(new)
    inv = np.empty(len(keys), np.int64)
    inv[at] = np.cumsum(new) - 1
    return k[first], np.minimum.reduceat(at, first), np.diff(np.append(first, len(keys))), inv
