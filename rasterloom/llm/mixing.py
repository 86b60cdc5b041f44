"""Mixing sources to target weights by soft membership.

A softmax classifier learned from a bounded sample of labelled rows gives each document a posterior over
the domains. Its features are the words that a text has and their beginnings, hashed, and the manner of the text: how
long it and its words are, how much repeats, how many signs it has, each by the bin it falls in. It is learned online
by FTRL-proximal, whose L1 term drops what few rows speak for, so that it doesn't remember rows. Document rates r >= 0
minimise

    sum over domains of (expected tokens - target)^2 / total^2
    + RIDGE * sum over documents of (tokens / total) * (r - 1)^2

by projected gradient, scaled by the second moments of the posteriors of the documents whose rate is not 0 (a matrix of
domains by domains), so that few steps do. A step needs these and the expected tokens of each domain, which are one
aggregation over all documents; a step that doesn't help is cut to a third, three times, and then replaced by one along
the plain gradient. A step is a few numbers a domain, and the rate follows from the posterior and the list of steps;
every STORED steps the rates so far are written, so that a job applies few steps. The fit ends when each domain's
share is within TOLERANCE of its target or no step lowers the squared gaps by a share of GAIN; results carry the largest
gap that is left. The
rates decide how often a document is taken: its whole part, and once more if a hash of doc_id falls below the rest.

Edge cases: null and empty texts have no tokens, the prior as posterior and rate 1; null or repeated labels: rows
without a label are ignored, a document with several counts in each, equal rows of a doc_id teach once; domains without a target keep
the weight that they have; without labelled rows all documents are of one domain; a null doc_id hashes to 42;
an empty table gives no rows; very long texts are worked on alone; report() doesn't read other columns, and taken()
keeps them all, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import quality
from . import text as T
from .names import set_aside
from .samples import texts_of
from .session import dropped, stored

#: Labelled rows that the classifier is learned from: those with the lowest hash of doc_id; equal rows are one.
SAMPLE_ROWS = 4_000

#: Bits of a hashed word; bytes of the beginnings of words; bins of each number that tells of the manner of a text.
BITS, BEGINNINGS, BINS = 18, (5, 6, 7, 8), 128

ALPHA, BETA, L1, L1_MANNER, L2, PASSES = 0.1, 1.0, 4.0, 0.05, 0.1, 2
RIDGE, STEPS, TOLERANCE, GAIN, STORED = 1e-5, 400, 1e-4, 1e-3, 8
_WORDS = 1 << BITS
_SIZE = _WORDS + BINS * len(quality.FEATURES) + 1


def features(col, useful: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the features that texts have, sorted by text; the text of each; and the words of each text.

    useful: which hashed words matter. The last feature is the bias; a text without words has no other."""
    buf, off = T.buffer(col)
    starts, ends = T.words(buf, T.ALNUM)
    n = np.diff(T.per_text(starts, off))
    owner = np.repeat(np.arange(len(n)), n)
    keys = []
    for k in (0, *BEGINNINGS):
        own = np.flatnonzero(ends - starts > k) if k else slice(None)
        h = T.hashes(buf, starts[own], starts[own] + k if k else ends, fold=True)
        f = (T.mix(h + T.U64(k)) >> T.U64(64 - BITS)).astype(np.int64)
        of = owner[own]
        if useful is not None:
            some = useful[f]
            f, of = f[some], of[some]
        keys.append(of << 32 | f)
    key = np.concatenate(keys).astype(T.U64)
    live = np.flatnonzero(n)
    c = quality.counts(col)
    with np.errstate(divide="ignore", invalid="ignore"):
        x = np.stack([np.nan_to_num(f(lambda k: c[k][live].astype(float)), posinf=0.0) for f in quality.FEATURES.values()], axis=1)
    places = np.minimum(BINS - 1, (4 * np.log2(1 + 1000 * x)).astype(np.int64)) + _WORDS + BINS * np.arange(x.shape[1])
    manner = np.repeat(live, x.shape[1]) << 32 | places.ravel()
    bias = np.arange(len(n)) << 32 | (_SIZE - 1)
    every = T.distinct(np.concatenate([key, manner.astype(T.U64), bias.astype(T.U64)]))[0]
    return (every & T.U64(0xFFFFFFFF)).astype(np.int64), (every >> T.U64(32)).astype(np.int64), n


def _bags(batches):
    for b in T.slices(batches):
        f, of, n = features(b.column("text"))
        cut = np.searchsorted(of, np.arange(len(n) + 1)).tolist()
        f = f.astype(np.uint32)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), b.column("label"), pa.array([f[x:y].tobytes() for x, y in zip(cut, cut[1:])], pa.binary())], ["doc_id", "row", "label", "features"])


def classifier(docs: DataFrame, labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray]:
    """Domains in order and the weights of a softmax over features, learned online over the sample.

    labelled: doc_id and label."""
    marked = labelled.where("label is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("string").alias("label"))
    marked = marked.distinct().orderBy(F.xxhash64("doc_id", "label"), "doc_id", "label").limit(sample_rows)
    bags = texts_of(docs, marked, "label", sample_rows).mapInArrow(_bags, "doc_id long, row long, label string, features binary")
    sample = stored(bags.groupBy("doc_id", "row", "label").agg(F.first("features").alias("features")).repartition(8))
    domains = sorted(r["label"] for r in sample.select("label").distinct().collect())
    if not domains:
        return [""], np.zeros((1, _SIZE))
    z, n, l1 = np.zeros((len(domains), _SIZE)), np.zeros((len(domains), _SIZE)), np.full(_SIZE, L1)
    l1[_WORDS:] = L1_MANNER
    for _ in range(PASSES):
        for r in sample.orderBy(F.xxhash64("features", "label"), "label").toLocalIterator():
            f = np.frombuffer(bytes(r["features"]), np.uint32).astype(np.int64)
            w = _weights(z[:, f], n[:, f], l1[f])
            g = _softmax(w.sum(axis=1))
            g[domains.index(r["label"])] -= 1
            g = g[:, None]
            z[:, f] += g - (np.sqrt(n[:, f] + g * g) - np.sqrt(n[:, f])) / ALPHA * w
            n[:, f] += g * g
    dropped(docs.sparkSession, sample)
    return domains, _weights(z, n, l1)


def _weights(z: np.ndarray, n: np.ndarray, l1: np.ndarray) -> np.ndarray:
    """The weights that the sums z and n stand for; zero where L1 holds them."""
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=0))
    return e / e.sum(axis=0)


def posteriors(docs: DataFrame, fitted: tuple[list[str], np.ndarray]) -> DataFrame:
    """docs with n_tokens (words) and posterior, an array in the order of the domains, as the last columns."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted[1].astype(np.float32))
    domains = len(fitted[0])
    schema = docs.select("*", F.lit(0).cast("long").alias("n_tokens"), F.expr("cast(array() as array<double>)").alias("posterior")).schema

    def run(batches):
        w = shared.value
        useful = (w[:, :_WORDS] != 0).any(axis=0)
        for b in T.slices(batches):
            f, of, n = features(b.column("text"), useful)
            p = _softmax(np.stack([np.bincount(of, weights=w[k, f], minlength=len(n)) for k in range(domains)])).T
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * domains, pa.int32()), pa.array(p.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64()), lists], [*b.schema.names, "n_tokens", "posterior"])

    return docs.mapInArrow(run, schema)


def rate(steps: list[np.ndarray], before: Column | None = None) -> Column:
    """The rate of a document after the steps: each adds the step's dot product with the posterior, then cuts at 0.

    A step is the gradient's part per domain; RIDGE pulls towards 1. before: the rate before the steps, 1 at first."""
    before = F.lit(1.0) if before is None else before
    if not steps:
        return before
    many = F.array(*(F.array(*(F.lit(float(x)) for x in s)) for s in steps))
    return F.aggregate(many, before, lambda r, s: F.greatest(F.lit(0.0), r + F.get(s, F.size(s) - 1) * (F.lit(1.0) - r) - F.aggregate(F.zip_with(F.slice(s, 1, F.size(s) - 1), F.col("posterior"), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)))


def rates(scored: DataFrame, domains: list[str], targets: dict[str, float]) -> tuple[list[np.ndarray], dict]:
    """The steps that fit the expected share of each domain to its target, and what they reach."""
    k = len(domains)
    scored = scored.select("n_tokens", "posterior", F.lit(1.0).alias("before"))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    part = lambda j: F.col("n_tokens") * F.get("posterior", j)
    sums = [F.sum(part(j) * F.col("rate")).alias(f"t{j}") for j in range(k)]
    sums += [F.sum(F.when(F.col("rate") > 0, part(i) * F.get("posterior", j))).alias(f"m{i}_{j}") for i, j in pairs]

    def expected(r: Column) -> tuple[np.ndarray, np.ndarray]:
        """Expected tokens of each domain, and how they bend with the posteriors of the documents whose rate is not 0."""
        row = [x or 0.0 for x in scored.select("n_tokens", "posterior", r.alias("rate")).agg(*sums).first()]
        bend = np.zeros((k, k))
        for (i, j), x in zip(pairs, row[k:]):
            bend[i, j] = bend[j, i] = x
        return np.array(row[:k], float), bend

    now, curve = expected(F.lit(1.0))
    start = now
    total = max(1.0, start.sum())
    given = np.array([targets.get(d, np.nan) for d in domains], float)
    free = np.isnan(given)
    left = max(0.0, 1 - given[~free].sum())
    shares = np.where(free, start / total * (left / max(1e-12, start[free].sum() / total) if free.any() else 0), given)
    goal = shares / max(1e-12, shares.sum())
    steps: list[np.ndarray] = []
    written = 0
    error = lambda x: float(((x / total - goal) ** 2).sum())
    while len(steps) < STEPS and start.sum() > 0 and np.abs(now / total - goal).max() > TOLERANCE:
        gap = now / total - goal
        scaled = np.linalg.solve(curve / total + RIDGE * np.eye(k), gap)
        # the plain gradient comes last: shares and posteriors are at most 1, so a whole step of it cannot overshoot
        for size, move in [(3.0**-j, scaled) for j in range(4)] + [(1.0, gap)]:
            step = np.append(size * move, size * RIDGE)
            then, bend = expected(rate([*steps[written:], step], F.col("before")))
            if error(then) < (1 - GAIN) * error(now):
                break
        else:
            break
        steps.append(step)
        now, curve = then, bend
        if len(steps) - written >= STORED:
            later = stored(scored.withColumn("before", rate(steps[written:], F.col("before"))))
            if written:
                dropped(scored.sparkSession, scored)
            scored, written = later, len(steps)
    if written:
        dropped(scored.sparkSession, scored)
    return steps, {"domains": domains, "targets": goal.tolist(), "before": (start / total).tolist(), "reached": (now / total).tolist(), "gap": float(np.abs(now / total - goal).max())}


def _copied(scored: DataFrame, steps: list[np.ndarray], doc_id: str) -> DataFrame:
    """scored with the rate of each row and how often it is taken."""
    coin = F.pmod(F.xxhash64(F.col(doc_id).cast("long")), F.lit(1 << 30)) / float(1 << 30)
    out = scored.withColumn("rate", F.when(F.col("n_tokens") > 0, rate(steps)).otherwise(F.lit(1.0)))
    return out.withColumn("copies", (F.floor("rate") + (coin < F.col("rate") - F.floor("rate")).cast("long")).cast("int"))


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float]) -> tuple[DataFrame, dict]:
    """doc_id, n_tokens, posterior, rate and copies of each document, and what the mixture reaches."""
    fitted = classifier(docs, labelled)
    scored = stored(posteriors(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fitted).drop("text"))
    steps, reached = rates(scored, fitted[0], targets)
    return _copied(scored, steps, "doc_id"), reached


def report(docs: DataFrame, labelled: DataFrame, targets: dict[str, float]) -> DataFrame:
    """One row per document: its likeliest domain, that one's posterior, its rate and how often it is taken; and the
    largest gap between a domain's share of the mixture and its target."""
    out, reached = mixed(docs, labelled, targets)
    names = F.array(*map(F.lit, reached["domains"]))
    top = F.array_max("posterior")
    return out.select("doc_id", "n_tokens", F.element_at(names, F.array_position("posterior", top).cast("int")).alias("domain"), top.alias("posterior"), "rate", "copies", F.lit(reached["gap"]).alias("gap"))


def taken(docs: DataFrame, labelled: DataFrame, targets: dict[str, float]) -> DataFrame:
    """docs with each row as often as it is taken; all columns stay. Texts are read again for it, and not shuffled."""
    fitted = classifier(docs, labelled)
    scored = stored(posteriors(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fitted).drop("text"))
    steps, _ = rates(scored, fitted[0], targets)
    dropped(docs.sparkSession, scored)
    added = ("n_tokens", "posterior", "rate", "copies", "__copy")
    own, moved = set_aside(docs, added)
    out = _copied(posteriors(own, fitted), steps, "doc_id")
    return out.withColumn("__copy", F.explode(F.expr("array_repeat(1, copies)"))).drop(*added).withColumnsRenamed(moved)
