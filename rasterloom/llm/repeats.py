"""Suffix-array dedup with a run-length index.

A byte goes if a string of LENGTH bytes that covers it also starts earlier: in a document with a smaller
doc_id, or before in the same one. Each such string holds an anchor, the smallest hash of its WIDTH-byte
substrings, at the same place wherever the string occurs. The strings that share an anchor make a context,
so the contexts parse every text into phrases, and the different ones are its dictionary (prefix-free
parsing). A phrase that occurred earlier repeats as a whole. The dictionary's phrases meet by anchor in
shards; a shard is indexed by its run-length Burrows-Wheeler transform, kept as runs (symbol, start, where
they map to) with sampled run ends; the suffix array and the transform itself are dropped. Phrases are
streamed through the index by backward search, which yields matching statistics: at each place how far the
text matches and the row reached. Rows between two of the index's breaks share LENGTH bytes, so the place
that comes first among them is kept and the others are marked. All comparisons in a shard are of bytes.

Hot phrases are combined in each task before they move: of a phrase's places in a task only the earliest
leaves it. An anchor with more than SHARD_CONTEXTS different phrases is cut into pieces of fewer strings,
which share a longer core: strings around one anchor that start at most ``slack`` bytes apart share
LENGTH - slack bytes, and meet by these; the last slack is 0, where all strings of a key are equal. Pieces
take the same way through the index. Bit filters of bounded size keep other rows out of the shuffles; they
never decide.

Equal phrases are told by 96 bits of two hashes.

Edge cases: null and empty texts, and texts below LENGTH bytes, keep all bytes; an empty table gives no rows;
rows with the same doc_id and text are one document, of which each row gets the same result; rows with the
same doc_id and other texts follow in the order of a hash of the text; rows without a doc_id come before
those with one (above -2^62), in the order of that hash; very long texts are worked on alone; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .filters import bitmap, passes
from .session import dropped, stored

LENGTH, WIDTH = 100, 32

#: Bits of the filters of anchors, of places and of documents: at least so many, and KEY_BITS a key up to 2^MOST_BITS.
ANCHOR_BITS, PLACE_BITS, DOC_BITS = 26, 26, 22
KEY_BITS, MOST_BITS = 16, 29

#: Different phrases of an anchor, and bytes of phrases, that go into one shard.
SHARD_CONTEXTS, SHARD_BYTES = 4096, 1 << 19

#: Strings of a piece start at most so far apart: where an anchor, and where a piece again, has too many phrases.
SLACKS = (8, 0)

#: Bytes of text whose phrases are combined before they leave a task, and bytes of text for each bucket of phrases.
TASK_BYTES, BUCKET_BYTES = 16 << 20, 16 << 20

#: Bytes of phrases that a task hands on at once, but for a larger bucket.
HAND_ON = 1 << 20

_SLICE = 1 << 19
_M = [T.U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


class Anchors:
    """The anchors of all texts of a column, each with the run of strings of LENGTH bytes that choose it."""

    def __init__(self, col):
        self.buf, self.off = T.buffer(col)
        z = np.zeros(0, np.int64)
        self.first, self.count, self.at, self.fp, self.owner = z, z, z, np.zeros(0, T.U64), z
        n = len(self.buf) - LENGTH + 1
        if n <= 0:
            return
        v = T.lanes(self.buf)[: len(self.buf) - 7].copy()
        v *= _M[0]
        v ^= v >> T.U64(32)
        for step in (8, 16):
            v = v[:-step] * _M[step >> 3] + v[step:]
            v ^= v >> T.U64(29)
        self.h32 = v  # of the WIDTH bytes from each position
        bits = len(self.buf).bit_length()
        low = T.U64((1 << bits) - 1)
        m = v * _M[3]
        m &= ~low
        m |= np.arange(len(m), dtype=T.U64)
        width, span = LENGTH - WIDTH + 1, 1
        while 2 * span <= width:
            m = np.minimum(m[:-span], m[span:])
            span *= 2
        m = np.minimum(m[: n], m[width - span : width - span + n])
        m &= low
        at = m.view(np.int64)  # the anchor of the string from each position
        size = np.diff(self.off) - 1  # without the line feed
        some = np.flatnonzero(size >= LENGTH)
        if not len(some):
            return
        new = np.empty(n, bool)
        new[0] = True
        np.not_equal(at[1:], at[:-1], out=new[1:])
        lo, hi = self.off[:-1][some], self.off[:-1][some] + size[some] - LENGTH + 1
        new[lo] = True
        ok = np.zeros(n + 1, np.int8)
        ok[lo] += 1
        ok[hi] -= 1
        inside = np.cumsum(ok[:n], dtype=np.int8).view(bool)
        self.first = np.flatnonzero(new & inside)
        self.owner = some[np.searchsorted(lo, self.first, "right") - 1]
        last = self.off[:-1][self.owner] + size[self.owner] - LENGTH + 1
        after = np.append(self.first[1:], n)
        self.count = np.minimum(after, last) - self.first
        self.at = at[self.first]
        self.fp = T.mix(self.h32[self.at])

    def keep(self, mask: np.ndarray) -> None:
        self.first, self.count, self.at, self.fp, self.owner = (x[mask] for x in (self.first, self.count, self.at, self.fp, self.owner))

    @property
    def ends(self) -> np.ndarray:
        return self.first + self.count - 1 + LENGTH

    @property
    def pos(self) -> np.ndarray:
        return self.first - self.off[self.owner]

    def contexts(self) -> tuple[np.ndarray, np.ndarray]:
        """64 bits and further 32 bits of hash of each phrase."""
        one = T.hashes(self.buf, self.first, self.ends, fold=False)
        two = np.zeros(len(one), T.U64)
        for k in range(0, 2 * LENGTH, WIDTH):
            two = (two ^ self.h32[np.minimum(self.first + k, self.ends - WIDTH)]) * _M[1]
            two ^= two >> T.U64(31)
        return one, (two >> T.U64(32)).astype(np.uint32)

    def pieces(self, slack: int) -> None:
        """Cuts each phrase into pieces of strings that start at most ``slack`` bytes apart; they meet by their core."""
        lo = self.at - self.first  # bytes of the first string before the anchor; the last has count - 1 fewer
        top = LENGTH - WIDTH
        step = slack + 1
        part, owner = T.ranges((top - lo) // step, (top - lo + self.count - 1) // step + 1)
        a = np.maximum(part * step - (top - lo[owner]), 0)
        b = np.minimum((part + 1) * step - (top - lo[owner]), self.count[owner])
        first, count, at = self.first[owner] + a, b - a, self.at[owner]
        begin = at - top + np.minimum(part * step + slack, top)
        core = T.hashes(self.buf, begin, at - top + part * step + LENGTH, fold=False)
        self.first, self.count, self.at, self.owner, self.fp = first, count, at, self.owner[owner], T.mix(core ^ (part + slack * LENGTH).astype(T.U64))


def _bits(least: int, keys: int) -> int:
    return max(least, min(MOST_BITS, (KEY_BITS * keys).bit_length()))


def _place(rk: np.ndarray, pos: np.ndarray) -> np.ndarray:
    return T.mix(rk.view(T.U64) + pos.astype(T.U64) * _M[0])


def _ordered(ctx, more, doc, rk, pos) -> tuple[np.ndarray, np.ndarray]:
    """A permutation that sorts by all of these, and where a phrase is new in it."""
    at = T.order(ctx)
    k = ctx[at]
    same = k[1:] == k[:-1]
    tied = np.concatenate([[False], same]) | np.concatenate([same, [False]]) if len(at) else np.zeros(0, bool)
    some = at[tied]
    at[tied] = some[np.lexsort([c[some] for c in (pos, rk, doc, more, ctx)])]
    new = np.ones(len(at), bool)
    new[1:] = (k[1:] != k[:-1]) | (more[at[1:]] != more[at[:-1]])
    return at, new


def _packed(columns: list[np.ndarray]) -> bytes:
    return b"".join(c.tobytes() for c in columns)


#: What moves of a phrase: two hashes, anchor, document, its key, place and strings.
_FIELDS = [("ctx", T.U64), ("more", np.uint32), ("fp", T.U64), ("doc", np.int64), ("rk", np.int64), ("pos", np.int64), ("n", np.uint8)]
_WIDE = sum(np.dtype(t).itemsize for _, t in _FIELDS)


def _unpacked(blobs: list[bytes]) -> list[np.ndarray]:
    parts: list[list[np.ndarray]] = [[] for _ in _FIELDS]
    for blob in blobs:
        n, at = len(blob) // _WIDE, 0
        for out, (_, t) in zip(parts, _FIELDS):
            out.append(np.frombuffer(blob, t, n, at))
            at += n * np.dtype(t).itemsize
    return [np.concatenate(p) for p in parts]


MARKS = "rk long, start long, end long, fp long, place long"


def _mark_rows(rk, start, end) -> pa.RecordBatch:
    nothing = pa.nulls(len(rk), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(rk, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), nothing, nothing], ["rk", "start", "end", "fp", "place"])


def _again(cols: list[np.ndarray], at: np.ndarray) -> pa.RecordBatch:
    """Marks of phrases that occurred before."""
    rk, pos, n = cols[4][at], cols[5][at], cols[6][at]
    return _mark_rows(rk, pos, pos + n + (LENGTH - 1))


def _combined(cols: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Columns in the order of phrase, document and place; where a phrase is new; where it comes again (equal places once)."""
    at, new = _ordered(cols[0], cols[1], *cols[3:6])
    cols = [c[at] for c in cols]
    other = np.concatenate([[True], (cols[4][1:] != cols[4][:-1]) | (cols[5][1:] != cols[5][:-1])]) if len(at) else new
    return cols, np.flatnonzero(new), np.flatnonzero(~new & other)


def _phrases(buckets: int):
    """Of all texts: for each bucket the earliest place of each phrase in the task, and marks of the others (bucket -1)."""
    names = ["bucket", "data"]
    shift = T.U64(64 - max(1, int(buckets - 1).bit_length()))

    def out(parts: list[list[np.ndarray]]):
        whole = [np.concatenate(p) for p in zip(*parts)]
        parts.clear()  # nothing is held twice while rows are handed on
        cols, first, again = _combined(whole)
        del whole
        step = max(1, HAND_ON // _WIDE)
        for lo in range(0, len(again), step):
            at = again[lo : lo + step]
            yield pa.RecordBatch.from_arrays([pa.array([-1 - int(cols[4][at[0]]) % buckets], pa.int64()), pa.array([_packed([c[at] for c in cols])], pa.binary())], names)
        bucket = (cols[0][first] >> shift).astype(np.int64)
        cut = np.flatnonzero(np.diff(bucket, prepend=-1))
        ends = np.append(cut[1:], len(bucket))
        group = ends // step
        edge = np.flatnonzero(np.diff(group, prepend=-1)).tolist()
        for lo, hi in zip(edge, [*edge[1:], len(cut)]):
            blobs = [_packed([c[first[x:y]] for c in cols]) for x, y in zip(cut[lo:hi].tolist(), ends[lo:hi].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cut[lo:hi]], pa.int64()), pa.array(blobs, pa.binary())], names)

    def run(batches):
        parts, size = [], 0
        for b in T.slices(batches, size=_SLICE):
            a = Anchors(b.column("text"))
            if not len(a.first):
                continue
            ctx, more = a.contexts()
            doc, rk = b.column("doc").to_numpy(), b.column("rk").to_numpy()
            parts.append([ctx, more, a.fp, doc[a.owner], rk[a.owner], a.pos, a.count.astype(np.uint8)])
            size += len(a.buf)
            if size >= TASK_BYTES:
                yield from out(parts)
                parts, size = [], 0
        if parts:
            yield from out(parts)

    return run


def _origins(batches) -> Iterator[pa.RecordBatch]:
    """Marks of phrases that come again, and anchor and place of each that is new, bucket by bucket."""

    def out(bucket: int, blobs: list[bytes]):
        cols = _unpacked(blobs)
        blobs.clear()
        if bucket < 0:
            yield _again(cols, np.arange(len(cols[0])))
            return
        cols, first, again = _combined(cols)
        if len(again):
            yield _again(cols, again)
        nothing = pa.nulls(len(first), pa.int64())
        place = _place(cols[4][first], cols[5][first]).view(np.int64)
        yield pa.RecordBatch.from_arrays([nothing, nothing, nothing, pa.array(cols[2][first].view(np.int64), pa.int64()), pa.array(place, pa.int64())], ["rk", "start", "end", "fp", "place"])

    now, blobs = None, []
    for b in batches:
        for bucket, data in zip(b.column("bucket").to_pylist(), b.column("data")):
            if bucket != now and blobs:
                yield from out(now, blobs)
                blobs = []
            now = bucket
            blobs.append(data.as_py())
            if bucket < 0:
                yield from out(now, blobs)
                blobs = []
    if blobs:
        yield from out(now, blobs)
    T._give_back()


PIECES = "fp long, doc long, rk long, pos long, bytes binary"


def _bytes(docs: DataFrame, anchors, places, large=None, slack: int | None = None, still=None) -> DataFrame:
    """The bytes of the phrases whose anchor and place pass the filters: whole ones, or with a slack the pieces of large
    anchors. ``still``: only pieces of pieces (of the slack before) whose core passes this filter too."""

    def run(batches):
        for b in T.slices(batches, size=_SLICE):
            a = Anchors(b.column("text"))
            rk = b.column("rk").to_numpy()
            a.keep(passes(anchors.value, a.fp))
            a.keep(passes(places.value, _place(rk[a.owner], a.pos)))
            if large is not None:
                a.keep(passes(large.value, a.fp) == (slack is not None))
            if slack is not None:
                for s in SLACKS:
                    a.pieces(s)
                    if s == slack:
                        break
                    a.keep(passes(still.value, a.fp))
            if not len(a.first):
                continue
            data = pa.array([a.buf[x:y].tobytes() for x, y in zip(a.first.tolist(), a.ends.tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(a.fp.view(np.int64), pa.int64()), pa.array(b.column("doc").to_numpy()[a.owner], pa.int64()), pa.array(rk[a.owner], pa.int64()), pa.array(a.pos, pa.int64()), data], [x.split()[0] for x in PIECES.split(", ")])

    return docs.mapInArrow(run, PIECES)


class RunIndex:
    """The run-length Burrows-Wheeler transform of strings, each followed by a terminator of its own.

    Row k is the terminator of string k, and the rows after them are the suffixes in order. Kept are, for each run, its
    symbol, its first row, the row that it maps to, and the text positions of its first and last row; the row of the last
    ``depth`` symbols of each string; and the breaks, the rows that share fewer than ``depth`` symbols with the row before."""

    def __init__(self, data: np.ndarray, size: np.ndarray, depth: int = LENGTH):
        """data: the bytes of all strings one after the other; size: how many each has."""
        last = np.cumsum(size + 1) - 1
        self.text = np.zeros(int(size.sum()) + len(size), np.int16)
        inside = np.ones(len(self.text), bool)
        inside[last] = False
        self.text[inside] = data
        self.text[inside] += 1
        self.first, self.depth = last - size, depth
        rows, self.breaks = _suffixes(self.text, last, depth)
        before = self.text[rows - 1]
        head = np.flatnonzero(np.diff(before, prepend=np.int16(-1))).astype(np.int32)
        self.symbol, self.start = before[head], head
        length = np.diff(np.append(head, np.int32(len(rows))))
        by_symbol = np.argsort(self.symbol, kind="stable")
        self.target = np.empty(len(head), np.int32)
        self.target[by_symbol] = np.cumsum(length[by_symbol]) - length[by_symbol]
        self.head_at, self.tail_at = rows[head], rows[head + length - 1]
        self.ordered = (self.symbol[by_symbol].astype(np.int64) << 32) | by_symbol
        self.length = length
        row = np.empty(len(rows), np.int32)
        row[rows] = np.arange(len(rows), dtype=np.int32)
        self.last = np.maximum(last - depth, self.first)  # where the last string of ``depth`` symbols starts
        self.last_row = row[self.last]

    def _jump(self, run: np.ndarray, symbol: np.ndarray, known: list[np.ndarray], far: np.ndarray) -> tuple[np.ndarray, ...]:
        """Row before the step, and symbols matched, at the sampled run end of the symbol that matches farthest."""
        key = (symbol.astype(np.int64) << 32) | run
        k = np.searchsorted(self.ordered, key)
        best_row, best = np.full(len(run), -1), np.full(len(run), -1)
        for j, at, tail in ((k - 1, self.tail_at, True), (k, self.head_at, False)):
            ok = (j >= 0) & (j < len(self.ordered))
            ok[ok] = (self.ordered[j[ok]] >> 32) == symbol[ok]
            i = np.flatnonzero(ok)
            r = (self.ordered[j[i]] & 0xFFFFFFFF).astype(np.int64)
            row = self.start[r] + (self.length[r] - 1 if tail else 0)
            got = np.zeros(len(i), np.int64)
            live = np.arange(len(i))
            while len(live):
                live = live[got[live] < far[i[live]]]
                x = at[r[live]] + got[live]
                live = live[x < len(self.text)]
                x = at[r[live]] + got[live]
                live = live[self.text[x] == known[0][known[1][i[live]] + got[live]]]
                got[live] += 1
            better = got > best[i]
            best_row[i[better]], best[i[better]] = row[better], got[better]
        return best_row, best

    def statistics(self, text: np.ndarray, first: np.ndarray, last: np.ndarray, rows: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Streams the strings text[first:last] through the index, all side by side and each from its end: for each
        position the symbols from there that match some place of the index, and a row that starts with them. rows and
        far: where each string's search starts, and how many symbols after the string match there already."""
        match, reached = np.zeros(len(text), np.int32), np.zeros(len(text), np.int32)
        order = np.argsort(first - last, kind="stable")  # the longest first
        longest = last[order] - first[order]
        row, far = rows[order].astype(np.int32), far[order].astype(np.int32)
        at = last[order] - 1
        for step in range(int(longest[0]) if len(order) else 0):
            live = int(np.searchsorted(-longest, -step))  # those with symbols left
            row, far, at = row[:live], far[:live], at[:live]
            symbol = text[at]
            run = np.searchsorted(self.start, row, "right") - 1
            off = np.flatnonzero(self.symbol[run] != symbol)
            if len(off):
                there, got = self._jump(run[off], symbol[off], [text, at[off] + 1], far[off])
                none = there < 0
                far[off] = np.where(none, -1, got)
                row[off] = np.where(none, 0, there)
                run[off] = np.searchsorted(self.start, row[off], "right") - 1
                row = np.where(far < 0, 0, self.target[run] + (row - self.start[run]))
            else:
                row = self.target[run] + (row - self.start[run])
            far = far + 1
            match[at], reached[at] = far, row
            at = at - 1
        return match, reached

    def earliest(self) -> np.ndarray:
        """For each position of the index's own text the first position with the same ``depth`` symbols, or itself."""
        end = np.append(self.first[1:], len(self.text)) - 1
        match, row = self.statistics(self.text, self.first, self.last, self.last_row, end - self.last)
        match[self.last], row[self.last] = end - self.last, self.last_row
        every = np.arange(len(self.text))
        p = np.flatnonzero(match >= self.depth)
        group = np.searchsorted(self.breaks, row[p], "right")
        least = np.full(len(self.breaks) + 1, len(self.text))
        np.minimum.at(least, group, p)
        every[p] = least[group]
        return every


def _suffixes(text: np.ndarray, last: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes up to their terminators (0, each different) in order, and the rows that share fewer than ``depth``
    symbols with the row before. By prefix doubling, the first symbols packed into one number."""
    n = len(text)
    bits = max(1, n.bit_length())
    if 3 * bits > 63:
        raise ValueError("the text is too long for one index")
    low = T.U64((1 << bits) - 1)
    known = min(depth, 7)
    end = np.repeat(last.astype(np.int32), np.diff(last, prepend=-1))  # each position's terminator
    left = end - np.arange(n, dtype=np.int32)
    key = np.zeros(n, T.U64)
    for k in range(known):
        key <<= T.U64(9)
        key[: n - k] |= np.where(left[: n - k] > k, text[k:], 0).astype(T.U64)
    at = np.argsort(key).astype(np.int32)
    at[: len(last)] = last  # terminators in their order
    key = key[at]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    new[: len(last)] = True
    del key, left
    rank = np.empty(n, np.int32)
    rank[at] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), 0))
    breaks = np.flatnonzero(new).astype(np.int32) if known == depth else None
    while True:
        reach = 2 * known if known >= depth else min(2 * known, depth)
        tied = ~new
        tied[:-1] |= ~new[1:]
        slots = np.flatnonzero(tied).astype(np.int32)
        if not len(slots):
            break
        pos = at[slots]
        nxt = np.minimum(pos + np.int32(reach - known), end[pos])
        key = rank[pos].astype(T.U64)
        key <<= T.U64(bits)
        key |= rank[nxt].astype(T.U64)
        key <<= T.U64(bits)
        key |= np.arange(len(slots), dtype=T.U64)
        key.sort()
        at[slots] = pos[(key & low).astype(np.int32)]
        key >>= T.U64(bits)
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        new[slots] |= fresh
        rank[at[slots]] = np.maximum.accumulate(np.where(new[slots], slots, 0))
        known = reach
        if known == depth:
            breaks = np.flatnonzero(new).astype(np.int32)
    return at, np.flatnonzero(new).astype(np.int32) if breaks is None else breaks


def _shard(keys: list[tuple[int, int]], data: list[bytes]) -> pa.RecordBatch:
    """Marks of a shard: byte ranges of documents whose strings occur earlier in the shard. keys: rk and place."""
    size = np.array([len(d) for d in data], np.int64)
    index = RunIndex(np.frombuffer(b"".join(data), np.uint8), size)
    least = index.earliest()
    p, owner = T.ranges(index.first, index.first + size - LENGTH + 1)
    hit = least[p] < p
    p, owner = p[hit], owner[hit]
    edge = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1] + 1) | (owner[1:] != owner[:-1])])) if len(p) else p
    ends = np.append(edge[1:], len(p)) - 1 if len(p) else p
    o = owner[edge]
    rk, pos = np.array([k[0] for k in keys], np.int64), np.array([k[1] for k in keys], np.int64)
    base = pos[o] - index.first[o]
    return _mark_rows(rk[o], p[edge] + base, p[ends] + base + LENGTH)


def _shards(whole: bool):
    """Marks of phrases, or of pieces, that come sorted by anchor and, within one, by document and position. Of equal ones
    the first goes into the index. The others repeat as a whole: phrases have their marks from ``_origins``, where all equal
    ones met, and pieces get them here. Rows of one place are one."""

    def _indexed(batches) -> Iterator[pa.RecordBatch]:
        keys, data, again = [], [], []
        size, now, seen, place = 0, None, set(), None
        for b in batches:
            for fp, rk, pos, d in zip(*(b.column(c).to_pylist() for c in ("fp", "rk", "pos", "bytes"))):
                if fp != now:
                    if size >= SHARD_BYTES:
                        yield _shard(keys, data)
                        keys, data, size = [], [], 0
                    now, seen, place = fp, set(), None
                if d not in seen:
                    seen.add(d)
                    keys.append((rk, pos))
                    data.append(d)
                    size += len(d)
                elif not whole and (rk, pos) != place:
                    again.append((rk, pos, len(d)))
                place = rk, pos
            if again:
                rk, pos, n = (np.array(c, np.int64) for c in zip(*again))
                yield _mark_rows(rk, pos, pos + n)
                again = []
        if data:
            yield _shard(keys, data)
        T._give_back()

    return _indexed


def _by_key(pieces: DataFrame, whole: bool) -> DataFrame:
    return pieces.repartition("fp").sortWithinPartitions("fp", "doc", "rk", "pos").mapInArrow(_shards(whole), MARKS)


def marks(docs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """rk, start and end of ranges of bytes that repeat; docs has doc, rk and text. And the tables that were stored."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    buckets = max(2, -(-size // BUCKET_BYTES))
    moved = docs.mapInArrow(_phrases(buckets), "bucket long, data binary").repartition("bucket").sortWithinPartitions("bucket")
    found = stored(moved.mapInArrow(_origins, MARKS))
    tables = [found]
    out = found.where("rk IS NOT NULL")
    origins = found.where("rk IS NULL").select("fp", "place")
    phrases = stored(origins.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1"))
    tables.append(phrases)
    met = phrases.agg(F.count("*").alias("anchors"), F.coalesce(F.sum("n"), F.lit(0)).alias("places"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    anchors = bitmap(phrases, "fp", _bits(ANCHOR_BITS, met["anchors"]))
    # the places of shared anchors only: with all of them the share of others that pass would grow with the table
    shared = _passed(origins, "fp", anchors).join(phrases.select("fp").hint("merge"), "fp", "left_semi")
    places = bitmap(shared, "place", _bits(PLACE_BITS, met["places"]))
    large, slack, still = phrases.where(F.col("n") > SHARD_CONTEXTS), None, None
    if met["most"] <= SHARD_CONTEXTS:
        return out.unionByName(_by_key(_bytes(docs, anchors, places), True)), tables
    large = bitmap(large, "fp", ANCHOR_BITS)
    out = out.unionByName(_by_key(_bytes(docs, anchors, places, large), True))
    for slack in SLACKS:
        pieces = stored(_bytes(docs, anchors, places, large, slack, still))
        tables.append(pieces)
        if slack != SLACKS[-1]:
            many = pieces.groupBy("fp").agg(F.approx_count_distinct("bytes").alias("n")).where(F.col("n") > SHARD_CONTEXTS)
            still = bitmap(many, "fp", ANCHOR_BITS)
            pieces = _passed(pieces, "fp", still, False)
        out = out.unionByName(_by_key(pieces, False))
    return out, tables


def _passed(df: DataFrame, key: str, filtered, wanted: bool = True) -> DataFrame:
    """The rows whose key passes the filter, or those that it keeps out."""

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(passes(filtered.value, b.column(key).to_numpy()) == wanted))

    return df.mapInArrow(run, df.schema)


def _merged(batches) -> Iterator[pa.RecordBatch]:
    """Maximal runs of each document's marks, which come sorted by document and start."""

    def out(rk, start, end):
        other = np.concatenate([[True], rk[1:] != rk[:-1]])
        group = np.cumsum(other)
        far = np.maximum.accumulate((group << 40) | end)  # the last end so far, of each document
        new = other.copy()
        new[1:] |= (start[1:] | (group[1:] << 40)) > far[:-1]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(rk)) - 1
        own = np.flatnonzero(other[first])
        lists = np.append(own, len(first)).astype(np.int32)
        a, b = (pa.ListArray.from_arrays(lists, pa.array(x, pa.int64())) for x in (start[first], far[last] & ((1 << 40) - 1)))
        return pa.RecordBatch.from_arrays([pa.array(rk[first[own]], pa.int64()), a, b], ["rk", "starts", "ends"])

    held = None
    for batch in batches:
        now = [batch.column(c).to_numpy() for c in ("rk", "start", "end")]
        if held:
            now = [np.concatenate(x) for x in zip(held, now)]
        if not len(now[0]):
            continue
        cut = int(np.searchsorted(now[0], now[0][-1]))
        if cut:
            yield out(*(x[:cut] for x in now))
        held = [x[cut:] for x in now]
    if held:
        yield out(*held)
    T._give_back()


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(batches) -> Iterator[pa.RecordBatch]:
    for b in T.slices(batches):
        out: list[tuple] = []
        marked = zip(b.column("starts").to_pylist(), b.column("ends").to_pylist()) if "starts" in b.schema.names else [(None, None)] * b.num_rows
        for doc, text, (starts, ends) in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), marked):
            raw = (text or "").encode()
            kept, gone, at = hashlib.sha256(), 0, 0
            for x, y in zip(starts or (), ends or ()):
                kept.update(raw[at:x])
                gone += y - x
                at = y
            kept.update(raw[at:])
            out.append((doc, len(raw), gone, len(starts or ()), kept.hexdigest()))
        cols = list(zip(*out))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == 4 else pa.int64()) for k, c in enumerate(cols)], [x.split()[0] for x in RESULT.split(", ")])


def report(docs: DataFrame) -> DataFrame:
    """One row per document: its bytes, those removed, in how many runs, and a digest of the rest."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("rk", F.xxhash64("doc_id", "text"))
    doc = F.coalesce("doc_id", F.col("rk").bitwiseAND(F.lit((1 << 62) - 1)) - F.lit((1 << 62) - 1) - F.lit(1 << 62) - F.lit(1))
    ranges, tables = marks(own.select(doc.alias("doc"), "rk", "text"))
    ranges = ranges.select("rk", "start", "end").repartition("rk").sortWithinPartitions("rk", "start")
    found = stored(ranges.mapInArrow(_merged, "rk long, starts array<long>, ends array<long>"))
    for t in tables:
        dropped(own.sparkSession, t)
    some = bitmap(found.select("rk"), "rk", _bits(DOC_BITS, found.count()))

    def split(batches, wanted: bool):
        for b in batches:
            yield b.filter(pa.array(passes(some.value, b.column("rk").to_numpy()) == wanted))

    # split and cut in one step: each step of its own has a Python worker of its own, which keeps its memory
    whole = own.mapInArrow(lambda batches: _cut(split(batches, False)), RESULT)
    marked = own.mapInArrow(lambda batches: split(batches, True), own.schema)
    return whole.unionByName(marked.join(found, "rk", "left").select("doc_id", "text", "starts", "ends").mapInArrow(_cut, RESULT))
