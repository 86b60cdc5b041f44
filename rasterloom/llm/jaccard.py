"""N-gram Jaccard join by chosen paths.

Each text is the set of its five-word shingles. A run sends every set down one path: the root splits all
sets by the value of one min-hash, so sets go together where they share the sampled shingle. A node that
is small, or whose members are alike, is a leaf, in which all pairs are compared exactly; any other node
is split again by BRANCH further samples that depend on the node. A pair at the threshold misses a run
with a chance of at most MISS, so RUNS independent runs reach RECALL.

Texts with the same set are one set with a number of copies. Leaves with the same members are compared
once. A leaf is cut into blocks of bounded size, and each pair of blocks is a unit of work, so no task
holds an unbounded group; a pair in several leaves counts in the first one only. Units give counts of
links and a spanning forest, never all pairs. Classes are the connected components.

Edge cases: words are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z in lower
case; a text of one to four words is one shingle; null and empty texts and those without words link to
nothing and are classes by themselves; equal texts and repeated rows are links of each other; a null
doc_id takes part, and a class of such rows alone has a null class_id; an empty table gives no rows; a very long
text is sketched alone; links() doesn't read other columns, and deduplicated() keeps them all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .filters import bitmap, passes
from .names import set_aside
from .session import stored

SHINGLE, THRESHOLD = 5, 0.8

#: Chance that a pair at the threshold is found, and the samples by which a node is split.
RECALL, BRANCH, DEPTH = 1 - 1e-7, 3, 4
MISS = 1 - THRESHOLD * (1 - (1 - THRESHOLD) ** BRANCH) ** (DEPTH - 1)
RUNS = math.ceil(math.log(1 - RECALL) / math.log(MISS))

#: Further min-hashes, of which nodes choose BRANCH.
POOL = 24

#: Members up to which a node is a leaf; chance of two members to have an equal sample from which they are alike.
LEAF, ALIKE = 200, 0.5

#: Parts that the members of a node above LEAF are dealt to wherever they are joined by node.
SALTS = 64

#: Members and shingles of a block at most, on average.
BLOCK_SETS, BLOCK_SHINGLES = 2048, 1 << 20

_MULTIPLIERS = np.random.default_rng(7).integers(0, 2**63, RUNS + POOL, dtype=np.int64).astype(T.U64) * T.U64(2) + T.U64(1)

#: Bits of the filter that spares the second pass over the texts most sets; it only saves work.
FILTER_BITS = 24


def shingles(col) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, text after text, and where those of each text begin."""
    buf, off = T.buffer(col)
    starts, ends = T.words(buf, T.ALNUM)
    bounds = T.per_text(starts, off)
    h = T.hashes(buf, starts, ends, fold=True)
    n = np.diff(bounds)
    lo, hi = T.gram_spans(bounds, SHINGLE)
    g = T.grams(h, SHINGLE)
    at, owner = T.ranges(lo, np.minimum(hi, len(g)))
    values = g[at]
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    extra = np.array([T.mix(np.cumsum(h[bounds[i] : bounds[i + 1]] * T.U64(0xD6E8FEB86659FD93))[-1:] + T.U64(n[i]))[0] if n[i] == 1 else T.grams(h[bounds[i] : bounds[i + 1]], int(n[i]))[0] for i in short.tolist()], T.U64)
    values, owner = np.concatenate([values, extra]), np.concatenate([owner, short])
    parts = np.cumsum(np.bincount(owner, minlength=len(n)))
    o = np.argsort(owner, kind="stable")
    values = values[o]
    out = []
    for x, y in zip([0, *parts[:-1].tolist()], parts.tolist()):
        v = np.sort(values[x:y])
        out.append(v[np.concatenate([[True], v[1:] != v[:-1]])] if len(v) else v)
    return (np.concatenate(out) if out else values), np.concatenate([[0], np.cumsum([len(v) for v in out])]).astype(np.int64)


def _set_ids(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit number of each nonempty set."""
    full = np.flatnonzero(np.diff(first))
    out = np.zeros(len(first) - 1, np.int64)
    if len(full):
        s = np.add.reduceat(T.mix(values ^ T.U64(0xA24BAED4963EE407)), first[full]) + np.diff(first)[full].astype(T.U64)
        out[full] = T.mix(s).view(np.int64)
    return out


def _sketched(batches) -> Iterator[pa.RecordBatch]:
    for b in T.slices(batches):
        values, first = shingles(b.column("text"))
        size = np.diff(first)
        full = np.flatnonzero(size)
        mins = np.zeros((len(size), RUNS + POOL), T.U64)
        if len(full):
            for k, m in enumerate(_MULTIPLIERS):
                mins[full, k] = np.minimum.reduceat(values * m, first[full])
        flat = pa.array(mins.view(np.int64).ravel(), pa.int64())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1) * (RUNS + POOL), pa.int32()), flat)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), pa.array(_set_ids(values, first), pa.int64()), pa.array(size, pa.int64()), lists], ["doc_id", "row", "sid", "size", "mins"])


def _members(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (sid, rep, and more) with the shingles; the texts are read again, and a bounded bit filter spares the others.

    One shuffle by sid serves the join, the removal of repeated rows and what the caller joins by sid."""
    key = F.col("sid").bitwiseXOR(F.coalesce("rep", F.lit(0).cast("long"))).alias("key")
    shared = bitmap(wanted.select(key), "key", FILTER_BITS)

    def run(batches):
        for b in T.slices(batches):
            values, first = shingles(b.column("text"))
            sid, rep = _set_ids(values, first), b.column("doc_id")
            some = np.flatnonzero(passes(shared.value, sid ^ pc.fill_null(rep, 0).to_numpy()))
            raw = [values[x:y].tobytes() for x, y in zip(first[some].tolist(), first[some + 1].tolist())]
            yield pa.RecordBatch.from_arrays([rep.take(pa.array(some)), pa.array(sid[some]), pa.array(raw, pa.binary())], ["rep", "sid", "shingles"])

    some = docs.mapInArrow(run, "rep long, sid long, shingles binary")
    joined = some.withColumnRenamed("rep", "doc").join(wanted, "sid").where(F.col("doc").eqNullSafe(F.col("rep")))
    return joined.dropDuplicates(["sid"]).drop("doc", "rep")


def _spread(nodes: DataFrame) -> DataFrame:
    """nodes, each once for every salt that a member can have."""
    return nodes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _salt(sid: str = "sid"):
    return F.pmod(F.xxhash64(sid, F.lit("salt")), F.lit(SALTS)).cast("int").alias("salt")


def _leaves(sets: DataFrame) -> DataFrame:
    """node and sid of the members of all leaves, with the number of members and of shingles of the node.

    Members of large nodes are joined by node and salt, so that none of them is the work of one task; only nodes of up to
    LEAF members are joined by node."""
    at = F.posexplode(F.slice("mins", 1, RUNS)).alias("run", "value")
    rows = sets.select("sid", "size", at).select(F.xxhash64("run", "value").alias("node"), "sid", "size")
    leaves, salted = None, ["node", "salt"]
    for depth in range(DEPTH):
        rows = stored(rows.select("node", "sid", "size", _salt()))
        nodes = rows.groupBy("node").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"), F.bit_xor(F.xxhash64("sid")).alias("print")).where("n > 1")
        large = stored(nodes.where(F.col("n") > LEAF))
        wide = rows.join(_spread(large), salted)
        found = rows.join(_spread(large.select("node")), salted, "left_anti").join(nodes.where(F.col("n") <= LEAF), "node")
        deeper = None
        if depth < DEPTH - 1:
            pick = lambda k: F.pmod(F.xxhash64("node", F.lit(k)), F.lit(POOL)).cast("int")
            value = lambda k: F.get("mins", F.lit(RUNS) + pick(k))
            children = (F.xxhash64("node", F.lit(k), value(k)).alias(f"child{k}") for k in range(BRANCH))
            members = stored(wide.join(sets.select("sid", "mins"), "sid").select("node", "salt", "n", "shingles", "print", "sid", "size", *children))
            split = members.groupBy("node", "n", "child0").agg(F.count("*").alias("m"))
            alike = stored(split.groupBy("node", "n").agg((F.sum(F.col("m") * F.col("m")) / F.first("n") / F.first("n")).alias("share")).where(F.col("share") >= ALIKE).select("node"))
            wide = members.join(_spread(alike), salted, "left_semi")
            child = F.explode(F.array(*(f"child{k}" for k in range(BRANCH)))).alias("node")
            deeper = members.join(_spread(alike), salted, "left_anti").select("sid", "size", child).distinct()
        columns = ["node", "sid", "n", "shingles", "print"]
        found = found.select(columns).unionByName(wide.select(columns))
        leaves = found if leaves is None else leaves.unionByName(found)
        if deeper is None or not deeper.take(1):
            break
        rows = deeper
    leaves = stored(leaves)
    first = leaves.groupBy("node", "n", "print").agg(F.lit(1)).groupBy("n", "print").agg(F.min("node").alias("node"))
    few, many = (F.col("n") <= LEAF), (F.col("n") > LEAF)
    small = leaves.where(few).join(first.where(few).select("node"), "node", "left_semi")
    big = leaves.where(many).withColumn("salt", _salt()).join(_spread(first.where(many).select("node")), salted, "left_semi")
    return small.select("node", "sid", "n", "shingles").unionByName(big.select("node", "sid", "n", "shingles"))


UNIT = "sid long, root long, links long, texts long"


def _compared(batches) -> Iterator[pa.RecordBatch]:
    """All pairs of each unit; rows come sorted by unit."""

    def units():
        held, key = [], None
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(c).to_numpy() for c in ("node", "i", "j")]
            edge = np.flatnonzero(np.any([np.diff(c) != 0 for c in cols], axis=0)) + 1
            for x, y in zip([0, *edge.tolist()], [*edge.tolist(), b.num_rows]):
                k = tuple(int(c[x]) for c in cols)
                if k != key and held:
                    yield key, pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    held = []
                key = k
                held.append(b.slice(x, y - x))
        if held:
            yield key, pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    out: list[tuple] = []
    for (node, i, j), b in units():
        out += _unit(node, i, j, b)
        if len(out) > 20_000:
            yield _rows(out)
            out = []
    if out:
        yield _rows(out)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["sid", "root", "links", "texts"])


def _unit(node: int, i: int, j: int, b: pa.RecordBatch) -> list[tuple]:
    n = b.num_rows
    if n < 2:
        return []
    sid, copies, block = (b.column(c).to_numpy() for c in ("sid", "copies", "block"))
    sets = [np.frombuffer(x.as_buffer(), T.U64) for x in b.column("shingles")]
    size = np.array([len(s) for s in sets], np.float32)
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(n), size.astype(np.int64))
    at = T.order(every)
    every, owner = every[at], owner[at]
    new = np.concatenate([[True], every[1:] != every[:-1]])
    number = np.cumsum(new) - 1
    often = np.bincount(number) > 1
    keep = often[number]
    owner, number = owner[keep], (np.cumsum(often) - 1)[number[keep]]
    common = np.zeros((n, n), np.float32)
    cut = np.searchsorted(number, np.arange(0, int(often.sum()) + 2048, 2048))
    for x, y in zip(cut, cut[1:]):
        if y > x:
            a = np.zeros((n, 2048), np.float32)
            a[owner[x:y], number[x:y] % 2048] = 1
            common += a @ a.T
    linked = common >= np.float32(THRESHOLD / (1 + THRESHOLD)) * (size[:, None] + size[None, :]) * np.float32(1 - 1e-6)
    exact = np.nonzero(linked)
    c, total = common[exact].astype(np.int64), (size[exact[0]] + size[exact[1]]).astype(np.int64)
    linked[exact] = 10 * c >= round(10 * THRESHOLD) * (total - c)
    linked &= (block[:, None] != block[None, :]) if i != j else ~np.eye(n, dtype=bool)
    if not linked.any():
        return []
    # connected parts
    root, todo = np.full(n, -1), np.arange(n)
    while len(todo):
        front, part = todo[:1], np.zeros(n, bool)
        while len(front):
            part[front] = True
            front = np.flatnonzero(linked[front].any(axis=0) & ~part)
        root[part] = np.flatnonzero(part)[np.argmin(sid[part])]
        todo = np.flatnonzero(root < 0)
    # a pair counts in the first leaf that both are in
    leaves = b.column("leaves")
    flat, first = leaves.flatten().to_numpy(), np.diff(leaves.offsets.to_numpy())
    who = np.repeat(np.arange(n), first)
    early = flat < node
    if early.any():
        _, inv = np.unique(flat[early], return_inverse=True)
        e = np.zeros((n, int(inv.max()) + 1), np.float32)
        e[who[early], inv] = 1
        linked &= (e @ e.T) == 0
    links = linked @ copies.astype(np.float64)
    texts = linked.sum(axis=1)
    some = np.flatnonzero((root != np.arange(n)) | (texts > 0))
    return list(zip(sid[some].tolist(), sid[root[some]].tolist(), links[some].astype(np.int64).tolist(), texts[some].tolist()))


def _components(edges: DataFrame) -> DataFrame:
    """sid and the smallest sid of its connected component, for all ends of edges (sid, root)."""
    edges = stored(edges.where("sid != root").distinct())
    labels = None
    while True:
        # every end takes the smallest of its neighbours, and then that one's own label
        both = edges.unionByName(edges.select(F.col("root").alias("sid"), F.col("sid").alias("root")))
        low = stored(both.groupBy("sid").agg(F.least(F.min("root"), F.col("sid")).alias("root")))
        if labels is None:
            labels = low
        else:
            to = low.select(F.col("sid").alias("label"), F.col("root").alias("next"))
            labels = stored(labels.select("sid", F.col("root").alias("label")).join(to, "label", "left").select("sid", F.coalesce("next", "label").alias("root")))
        # contract: edges run between labels
        a, b = (low.select(F.col("sid").alias(x), F.col("root").alias(f"to_{x}")) for x in ("sid", "root"))
        edges = stored(edges.join(a, "sid").join(b, "root").select(F.col("to_sid").alias("sid"), F.col("to_root").alias("root")).where("sid != root").distinct())
        if not edges.take(1):
            return labels


def _linked(docs: DataFrame) -> DataFrame:
    """What links() gives, with row, the hash of the text, and head, the (none, doc_id, row) of the first row of its class:
    that of the smallest doc_id, nulls last, then of the smallest hash. A row without words has no head."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = stored(own.withColumn("row", F.xxhash64("text")).mapInArrow(_sketched, "doc_id long, row long, sid long, size long, mins array<long>"))
    head = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("head")
    sets = stored(sketches.where("size > 0").groupBy("sid").agg(F.min("doc_id").alias("rep"), head, F.count("*").alias("copies"), F.first("size").alias("size"), F.first("mins").alias("mins")))
    leaves = stored(_leaves(sets))
    wanted = stored(leaves.groupBy("sid").agg(F.sort_array(F.collect_list("node")).alias("leaves")).join(sets.select("sid", "rep", "copies"), "sid"))
    members = _members(own, wanted)
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_SETS), F.ceil(F.col("shingles") / BLOCK_SHINGLES))
    rows = leaves.select("node", "sid", blocks.alias("g")).withColumn("block", F.pmod(F.xxhash64("sid"), "g"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)).alias("other")
    rows = rows.select("node", "sid", "block", other).select("node", "sid", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    units = rows.join(members, "sid").repartition("node", "i", "j").sortWithinPartitions("node", "i", "j", "sid")
    found = stored(units.mapInArrow(_compared, UNIT))
    counts = found.groupBy("sid").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    parts = _components(found.select("sid", "root"))
    classed = sets.select("sid", "rep", F.col("head").alias("first"), "copies").join(parts, "sid", "left").withColumn("root", F.coalesce("root", "sid")).join(counts, "sid", "left")
    heads = classed.groupBy("root").agg(F.min("rep").alias("class_id"), F.min("first").alias("head"), F.sum("copies").alias("n_class"))
    table = classed.join(heads, "root").select("sid", "class_id", "head", "n_class", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("texts", F.lit(0)).alias("texts"))
    out = sketches.select("doc_id", "row", F.when(F.col("size") > 0, F.col("sid")).alias("sid")).join(table, "sid", "left")
    alone = F.col("class_id").isNull() & F.col("copies").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, 0).otherwise(F.col("links") + F.col("copies") - 1).cast("long").alias("n_links"),
        F.coalesce("texts", F.lit(0)).cast("long").alias("n_linked_texts"),
        F.coalesce("n_class", F.lit(1)).cast("long").alias("n_class"),
        "row",
        "head",
    )


def links(docs: DataFrame) -> DataFrame:
    """One row per document: class_id, the smallest doc_id of its class; n_links, documents with a Jaccard similarity of
    THRESHOLD or more; n_linked_texts, different sets among them; n_class, documents of the class."""
    return _linked(docs).drop("row", "head")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of docs for each class: that of its smallest doc_id, or of its smallest hash of a text where all are null; all
    columns stay. Rows are told apart by doc_id and text, so other texts of a doc_id are kept or go with their own classes;
    rows without words stay, repeated ones once."""
    docs, moved = set_aside(docs, ("__doc", "__none", "__row"))
    keys = [F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("__doc"), F.col("doc_id").cast("long").isNull().alias("__none")]
    first = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("row") == F.col("head.row"))
    gone = stored(_linked(docs).where(F.col("head").isNotNull() & ~first).select(*keys, F.col("row").alias("__row")).distinct())
    out = docs.select("*", *keys, F.xxhash64("text").alias("__row")).join(gone, ["__doc", "__none", "__row"], "left_anti")
    return out.dropDuplicates(["__doc", "__none", "__row"]).select(docs.columns).withColumnsRenamed(moved)
