"""Quality rules as a learned decision list.

Counts of every whole text are made in Arrow batches. A decision list is learned from labelled rows by
sequential covering: a conjunction of thresholds is grown on two thirds of them, pruned on the last
third, and the rows that it covers are set aside before the next. The list is applied as one ordered
Spark conditional expression.

Edge cases: a null or empty text has no words, fails the base rule and is not judged by the list; a document with several labels
takes the lowest; labels of unknown documents and null labels are ignored; without labels the list is
empty and only the base rule decides; repeated rows are judged alike; an empty table gives no rows; very long
texts are worked on alone; other columns pass through kept(), whatever their names, and report() doesn't read them.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .names import set_aside
from .samples import texts_of

#: Labelled rows that the list is learned from: those with the lowest hash of doc_id.
SAMPLE_ROWS = 20_000

#: Thresholds tried for each feature, conditions of a rule, rules of a list, rows a rule must cover.
THRESHOLDS, CONDITIONS, RULES, LEAST = 40, 4, 24, 8

#: Share of bad rows, among those it covers on the pruning rows, that a rule must reach.
PRECISION = 0.9

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_digits", "n_distinct")

_SYMBOL, _UPPER, _MARK, _DIGIT = (np.zeros(256, np.int32) for _ in range(4))
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1
_UPPER[65:91] = 1
_MARK[[ord(c) for c in "!?"]] = 1
_DIGIT[48:58] = 1


def _sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    c = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=c[1:])
    return np.diff(c[off])


def counts(col) -> dict[str, np.ndarray]:
    """The counts of COUNTS for each text of an Arrow column."""
    buf, off = T.buffer(col)
    starts, ends = T.words(buf, T.SPACED)
    bounds = T.per_text(starts, off)
    n = np.diff(bounds)
    owner = np.repeat(np.arange(len(n)), n)
    salt = T.mix(np.arange(1, len(n) + 1).astype(T.U64))
    h = T.hashes(buf, starts, ends, fold=False)
    newline = np.flatnonzero(buf == 10)
    first = np.concatenate([[0], newline[:-1] + 1]) if len(newline) else newline
    line_owner = np.searchsorted(off, first, "right") - 1
    worded = np.searchsorted(starts, newline) > np.searchsorted(starts, first)
    lines = np.bincount(line_owner, minlength=len(n))
    n_dup = _repeated_lines(buf, first[worded], newline[worded], line_owner[worded], salt, len(n))
    repeated = np.zeros(len(h), bool)
    if len(h) >= 3:
        inside = np.flatnonzero(owner[:-2] == owner[2:])
        g = T.grams(h, 3)[inside] ^ salt[owner[inside]]
        at = T.order(g)
        same = np.flatnonzero(g[at][1:] == g[at][:-1])
        one, two = inside[at[:-1][same]], inside[at[1:][same]]
        twice = np.zeros(len(h) - 2, bool)
        twice[one] = twice[two] = True
        alike = owner[one] == owner[two]
        for j in range(3):
            size = ends[one + j] - starts[one + j]
            alike &= (size == ends[two + j] - starts[two + j]) & T.equal(buf, starts[one + j], buf, starts[two + j], size)
        for t in np.unique(np.concatenate([owner[one[~alike]], owner[two[~alike]]])).tolist():  # windows share a hash
            twice[bounds[t] : max(bounds[t], bounds[t + 1] - 2)] = _twice([buf[x:y].tobytes() for x, y in zip(starts[bounds[t] : bounds[t + 1]].tolist(), ends[bounds[t] : bounds[t + 1]].tolist())])
        for j in range(3):
            repeated[j : len(h) - 2 + j] |= twice
    lead = ((buf & 0xC0) != 0x80) & T.SPACED[buf]
    return {
        "n_words": n,
        "word_chars": _sums(lead, off),
        "n_symbols": _sums(_SYMBOL[buf], off),
        "n_dup_lines": n_dup,
        "n_repeat_words": np.bincount(owner[repeated], minlength=len(n)),
        "n_lines": lines,
        "n_upper": _sums(_UPPER[buf], off),
        "n_marks": _sums(_MARK[buf], off),
        "n_digits": _sums(_DIGIT[buf], off),
        "n_distinct": _distinct_by(h ^ salt[owner], owner, len(n)),
    }


def _twice(words: list[bytes]) -> list[bool]:
    """Which windows of three words are found twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    many = Counter(windows)
    return [many[w] > 1 for w in windows]


def _repeated_lines(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray, salt: np.ndarray, n: int) -> np.ndarray:
    """Lines of each text that equal an earlier one; lines with one hash are compared."""
    keys = T.hashes(buf, starts, ends, fold=False) ^ salt[owner]
    at = T.order(keys)
    k = keys[at]
    same = np.flatnonzero(k[1:] == k[:-1])
    one, two = at[:-1][same], at[1:][same]
    size = ends[one] - starts[one]
    alike = (owner[one] == owner[two]) & (size == ends[two] - starts[two]) & T.equal(buf, starts[one], buf, starts[two], size)
    out = np.bincount(owner[two], minlength=n)
    for t in np.unique(np.concatenate([owner[one[~alike]], owner[two[~alike]]])).tolist():  # lines share a hash
        own = [buf[starts[i] : ends[i]].tobytes() for i in np.flatnonzero(owner == t).tolist()]
        out[t] = len(own) - len(set(own))
    return out


def _distinct_by(keys: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """How many distinct keys each owner has; keys of different owners differ."""
    if not len(keys):
        return np.zeros(n, np.int64)
    at = T.order(keys)
    k = keys[at]
    return np.bincount(owner[at[np.concatenate([[True], k[1:] != k[:-1]])]], minlength=n)


FEATURES = {
    "n_words": lambda c: c("n_words"),
    "word_length": lambda c: c("word_chars") / c("n_words"),
    "symbols_per_word": lambda c: c("n_symbols") / c("n_words"),
    "repeated": lambda c: c("n_repeat_words") / c("n_words"),
    "dup_lines": lambda c: c("n_dup_lines") / c("n_lines"),
    "words_per_line": lambda c: c("n_words") / c("n_lines"),
    "upper": lambda c: c("n_upper") / c("word_chars"),
    "marks_per_word": lambda c: c("n_marks") / c("n_words"),
    "digits": lambda c: c("n_digits") / c("word_chars"),
    "distinct": lambda c: c("n_distinct") / c("n_words"),
}

Rule = list[tuple[str, str, float]]


def _gain(p: np.ndarray, n: np.ndarray, p0: float, n0: float) -> np.ndarray:
    """FOIL's gain: positives kept times the bits that the condition saves on each."""
    with np.errstate(divide="ignore", invalid="ignore"):
        g = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
    return np.where(p > 0, g, -1.0)


def _covered(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    m = np.ones(len(next(iter(x.values()))), bool)
    for f, op, t in rule:
        m &= x[f] >= t if op == ">=" else x[f] <= t
    return m


def learn(x: dict[str, np.ndarray], bad: np.ndarray, part: np.ndarray) -> list[Rule]:
    """An ordered list of conjunctions that cover bad rows. part: 0 and 1 grow, 2 prunes."""
    cuts = {f: np.unique(np.quantile(v, np.linspace(0, 1, THRESHOLDS))) for f, v in x.items() if len(v)}
    left, rules = np.ones(len(bad), bool), []
    while len(rules) < RULES:
        grow, prune = left & (part < 2), left & (part == 2)
        inside, rule = grow.copy(), []
        while len(rule) < CONDITIONS and (inside & ~bad).any():
            p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
            if p0 < LEAST:
                break
            best = (1e-9, None)
            for f, c in cuts.items():
                v = x[f][inside]
                y = bad[inside]
                slot = np.searchsorted(c, v, "right")
                pos, neg = (np.bincount(slot[m], minlength=len(c) + 1) for m in (y, ~y))
                above_p, above_n = pos[::-1].cumsum()[::-1][1:], neg[::-1].cumsum()[::-1][1:]
                slot = np.searchsorted(c, v, "left")
                pos, neg = (np.bincount(slot[m], minlength=len(c) + 1) for m in (y, ~y))
                for op, p, n in ((">=", above_p, above_n), ("<=", pos.cumsum()[:-1], neg.cumsum()[:-1])):
                    g = _gain(p, n, p0, n0)
                    k = int(g.argmax())
                    if g[k] > best[0]:
                        best = (float(g[k]), (f, op, float(c[k])))
            if best[1] is None:
                break
            rule.append(best[1])
            inside &= _covered([best[1]], x)
        if not rule:
            break
        worth = []
        for k in range(1, len(rule) + 1):
            m = _covered(rule[:k], x) & prune
            p, n = (m & bad).sum(), (m & ~bad).sum()
            worth.append((p - n) / max(1, p + n))
        rule = rule[: 1 + int(np.argmax(worth))]
        m = _covered(rule, x)
        p, n = (m & prune & bad).sum(), (m & prune & ~bad).sum()
        if p < max(1, LEAST // 4) or p < PRECISION * (p + n) or (m & left & bad).sum() < LEAST:
            break
        rules.append(rule)
        left &= ~m
    return rules


def expression(rules: list[Rule], col=F.col) -> Column:
    """The list as an ordered conditional expression: true where a rule rejects. Features divide by words, so texts without
    any come first and no rule judges them."""
    out = F.when(col("n_words") == 0, F.lit(False))
    for rule in rules:
        tests = [FEATURES[f](col) >= t if op == ">=" else FEATURES[f](col) <= t for f, op, t in rule]
        out = out.when(reduce(lambda a, b: a & b, tests), F.lit(True))
    return out.otherwise(F.lit(False)) if rules else F.lit(False)


def counted(docs: DataFrame) -> DataFrame:
    """docs with a struct __counts of the counts of COUNTS, as the last column."""
    schema = docs.select("*", F.struct(*(F.lit(0).cast("long").alias(c) for c in COUNTS)).alias("__counts")).schema

    def run(batches):
        for b in T.slices(batches):
            c = counts(b.column("text"))
            s = pa.StructArray.from_arrays([pa.array(c[k], pa.int64()) for k in COUNTS], list(COUNTS))
            yield pa.RecordBatch.from_arrays([*b.columns, s], [*b.schema.names, "__counts"])

    return docs.mapInArrow(run, schema)


def rules_of(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The decision list learned from at most sample_rows labelled documents, and twice as many different texts of them."""
    marked = (
        labels.where("quality is not null and doc_id is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
    )
    own = texts_of(docs, marked, "quality", 2 * sample_rows)
    rows = counted(own).select("doc_id", "row", "quality", "__counts.*").dropDuplicates(["doc_id", "row"]).toPandas()
    rows = rows[rows.n_words > 0].sort_values(["doc_id", "row"], kind="stable")
    if rows.empty:
        return []
    get = lambda k: rows[k].to_numpy(float)
    x = {f: make(get) for f, make in FEATURES.items() if f != "word_length"} | {"word_length": get("word_chars") / get("n_words")}
    part = (T.mix(rows.doc_id.to_numpy().astype(T.U64)) % T.U64(3)).astype(int)
    return learn(x, rows.quality.to_numpy() == 0, part)


def base_failed(col=F.col) -> Column:
    return (col("n_words") < 50) | (100 * col("n_repeat_words") > 50 * col("n_words"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document with its counts and the verdict."""
    rules = rules_of(docs, labels)
    c = counted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", "__counts.*")
    out = c.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), expression(rules).alias("rejected"))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("rejected"))


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that neither the base rule nor the list rejects; all columns stay."""
    rules = rules_of(docs, labels)
    at = lambda k: F.col(f"__counts.{k}")
    own, moved = set_aside(docs, ("__counts",))
    return counted(own).where(~base_failed(at) & ~expression(rules, at)).drop("__counts").withColumnsRenamed(moved)
