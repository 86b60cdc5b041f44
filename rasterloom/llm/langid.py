"""Language identification by hierarchical discrimination.

A text's features are the relative frequencies of its letter n-grams of one to four bytes (A-Z lower-cased, all that
is no letter is one space), hashed to BITS bits. First its family is predicted, then its language among those of the
family; both by linear support vector machines, one for each pair (of families, of languages of one family), whose
probabilities vote. So a language is only ever compared with its relatives, and k languages in families of f need
about k * f / 2 machines instead of k * k / 2.

Families follow from the code of a language (FAMILIES, as far as the hyphen: en-GB is en); languages that are not
listed are one family. Machines are learned as tasks, one a pair, from at most ``texts`` different labelled texts of
each language, chosen by hash. Of a longer sampled text SAMPLE_CHARS characters in evenly spaced pieces are learned
from; what is predicted is always the whole text. What is broadcast are 4 * 2^BITS bytes a machine. Prediction is one
pass without a shuffle.

Edge cases: a null text and one without a letter (of any script) are ``und`` with score 0, and so is every text if no
language was learned; if one was, it is predicted with score 1. Rows with a null language are not learned from, an
empty string is a language like others; equal texts of one language count once; a null doc_id is learned from and
predicted; repeated rows are predicted each and alike; an empty table gives no rows; other columns, whatever their
names, are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as T
from .session import stored
from .toxicity import held_out

# ISO 639-1 codes by family.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "turkic": "az kk ky tk tr tt ug uz",
    "indo-aryan": "as bn gu hi mr ne or pa sd si ur",
    "iranian": "fa ku ps tg",
    "dravidian": "kn ml ta te",
    "semitic": "am ar he mt",
    "austronesian": "id jv mg ms su tl",
    "sinitic": "zh",
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

#: Different texts of each language that are learned from at most.
TEXTS = 300

#: Characters of a sampled text that are learned from at most.
SAMPLE_CHARS = 16_384

#: Words of the pieces that a text is also learned from in, and how many pieces of each length at most.
PIECES, PIECES_OF_TEXT = (3, 12, 50), 6

BITS = 16
SIZE = 1 << BITS
ORDERS = (1, 2, 3, 4)

#: Cost of a violated margin; passes over the sample at most; the largest step of a pass that ends learning.
COST, PASSES, SMALL_STEP = 4.0, 30, 0.02

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def family(lang: str) -> str:
    return _FAMILY_OF.get(lang.lower().replace("_", "-").split("-")[0], "other")


def grams(col) -> tuple[np.ndarray, np.ndarray, int]:
    """Numbers of the n-grams of all texts, the text of each, and how many texts there are."""
    spaced = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), T.strings(col), pa.scalar(" ", pa.large_string()))
    buf, off = T.buffer(spaced)
    n = len(off) - 1
    x = np.where(_LETTER[buf], T._FOLD[buf], 32).astype(np.uint8)
    keep = x != 32
    keep[1:] |= x[:-1] != 32
    keep[off[:-1]] = True  # every text starts with a space of its own
    owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(off))[keep]
    x = x[keep]
    lane = T.lanes(x)
    ids, of = [], []
    for k in ORDERS:
        if len(x) < k:
            continue
        inside = owner[k - 1 :] == owner[: len(x) - k + 1]
        if k == 1:
            inside &= x != 32
        ids.append((T.mix(lane[: len(x) - k + 1][inside] & T._FIRST[k]) >> T.U64(64 - BITS)).astype(np.int32))
        of.append(owner[: len(x) - k + 1][inside])
    if not ids:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), n
    return np.concatenate(ids), np.concatenate(of), n


def frequencies(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Relative frequencies by rows: where each text's features start (and the end), their numbers and their values."""
    ids, of, n = grams(pa.array(texts, pa.large_string()))
    key, count = np.unique(of.astype(np.int64) << BITS | ids, return_counts=True)
    row = key >> BITS
    total = np.bincount(of, minlength=n)
    return np.searchsorted(row, np.arange(n + 1)), key & (SIZE - 1), count / total[row]


def pieces(text: str) -> list[str]:
    """The text and evenly spaced runs of its words."""
    words = text.split()
    out = [text]
    for n in PIECES:
        if len(words) > n:
            at = np.unique(np.linspace(0, len(words) - n, PIECES_OF_TEXT).astype(int))
            out += [" ".join(words[i : i + n]) for i in at.tolist()]
    return out


def separated(at: np.ndarray, ids: np.ndarray, x: np.ndarray, y: np.ndarray, cost: np.ndarray, passes: int = PASSES) -> np.ndarray:
    """Weights of the linear machine without intercept: dual coordinate descent over rows of length 1, labels y of -1 and 1.

    It minimises w.w / 2 + sum(cost * max(0, 1 - y * w.x))."""
    w, alpha = np.zeros(SIZE), np.zeros(len(y))
    rng = np.random.default_rng(0)
    for _ in range(passes):
        largest = 0.0
        for i in rng.permutation(len(y)).tolist():
            own, v = ids[at[i] : at[i + 1]], x[at[i] : at[i + 1]]
            new = min(max(alpha[i] + 1 - y[i] * (w[own] @ v), 0.0), cost[i])
            step = new - alpha[i]
            if step:
                w[own] += step * y[i] * v
                alpha[i] = new
                largest = max(largest, abs(step))
        if largest < SMALL_STEP:
            break
    return w


def machine(texts: list[str], y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of relative frequencies, and the slope that makes a margin the logit of label 1."""
    parts = [pieces(t) for t in texts]
    y = np.repeat(y, [len(p) for p in parts])
    at, ids, f = frequencies([p for ps in parts for p in ps])
    live = np.flatnonzero(np.diff(at))
    pick, _ = T.ranges(at[live], at[live + 1])
    y, ids, f, at = y[live], ids[pick], f[pick], np.concatenate([[0], np.cumsum(np.diff(at)[live])])
    if not len(y):
        return np.zeros(SIZE, np.float32), 1.0
    rows = np.repeat(np.arange(len(y)), np.diff(at))
    scale = 1 / np.sqrt(np.bincount(ids, weights=f, minlength=SIZE) / len(y) + 1e-5)
    x = f * scale[ids]
    x /= np.sqrt(np.bincount(rows, weights=x * x))[rows]
    share = np.array([(y == s).mean() for s in (-1, 1)])
    w = separated(at, ids, x, y, COST / 2 / np.maximum(share, 1 / len(y))[(y > 0).astype(int)]) * scale
    margin = y * np.bincount(rows, weights=w[ids] * f, minlength=len(y))
    slope, want = 0.0, 1 - 1 / (len(y) + 2)  # logistic regression on the margins, with a target below 1 so that it ends
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * margin, -30, 30)))
        slope = float(np.clip(slope + ((want - p) * margin).sum() / ((p * (1 - p) * margin * margin).sum() + 1e-9), 0.0, 1e4))
    return w.astype(np.float32), slope


def sample(docs: DataFrame, texts: int = TEXTS) -> DataFrame:
    """lang and text of at most ``texts`` different labelled texts of each language; long ones in pieces."""
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.xxhash64("text").alias("row"), "text").where(r"lang is not null and rlike(text, '\\p{L}')")
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("row"))  # a limit in each task comes before the shuffle
    picked = rows.select("lang", "row").distinct().withColumn("turn", turn).where(F.col("turn") <= texts).select("lang", "row")
    found = rows.join(F.broadcast(stored(picked)), ["lang", "row"])
    n, k = F.length("text"), 16
    spread = F.concat_ws(" ", *[F.substring("text", F.floor(n * i / k).cast("int") + 1, F.lit(SAMPLE_CHARS // k)) for i in range(k)])
    return found.select("lang", "row", F.when(n <= SAMPLE_CHARS, F.col("text")).otherwise(spread).alias("text")).groupBy("lang", "row").agg(F.min("text").alias("text"))


def model(docs: DataFrame, texts: int = TEXTS) -> dict:
    """Families, the languages of each, and a machine for each pair; learned from docs (text, lang)."""
    spark = docs.sparkSession
    learned = stored(sample(docs, texts))
    langs = sorted(r["lang"] for r in learned.select("lang").distinct().toLocalIterator())
    tree: dict[str, list[str]] = {}
    for lang in langs:
        tree.setdefault(family(lang), []).append(lang)
    tree = dict(sorted(tree.items()))
    pairs = [("", a, b) for a, b in combinations(tree, 2)] + [(f, a, b) for f, own in tree.items() for a, b in combinations(own, 2)]
    sides = [(f, a, b, lang, y) for f, a, b in pairs for side, y in ((a, 1), (b, -1)) for lang in ([side] if f else tree[side])]
    if not pairs:
        return {"tree": tree, "machines": {}}

    def fitted(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["lang", "row"])
        w, slope = machine(df["text"].tolist(), df["y"].to_numpy())
        return pd.DataFrame({"family": [df["family"].iloc[0]], "a": [df["a"].iloc[0]], "b": [df["b"].iloc[0]], "weights": [w.tobytes()], "slope": [slope]})

    shares = learned.join(F.broadcast(spark.createDataFrame(sides, "family string, a string, b string, lang string, y int")), "lang")
    fits = stored(shares.groupBy("family", "a", "b").applyInPandas(fitted, "family string, a string, b string, weights binary, slope double"))
    machines = {(r["family"], r["a"], r["b"]): (np.frombuffer(bytes(r["weights"]), np.float32), r["slope"]) for r in fits.toLocalIterator()}
    return {"tree": tree, "machines": machines}


def _winners(fitted: dict, kin: str, names: list[str], ids: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the names has most votes in each text, and its mean vote; the first of equals."""
    votes = np.zeros((len(names), n))
    total = np.maximum(np.bincount(of, minlength=n), 1)
    for i, j in combinations(range(len(names)), 2):
        w, slope = fitted["machines"][kin, names[i], names[j]]
        margin = np.bincount(of, weights=w[ids], minlength=n) / total
        p = 1 / (1 + np.exp(-np.clip(slope * margin, -30, 30)))
        votes[i] += p
        votes[j] += 1 - p
    best = votes.argmax(axis=0)
    return best, votes[best, np.arange(n)] / (len(names) - 1) if len(names) > 1 else np.ones(n)


def languages(fitted: dict, col) -> tuple[np.ndarray, np.ndarray]:
    """Language and score of each text of an Arrow column; every text is taken to have a letter."""
    ids, of, n = grams(col)
    names = list(fitted["tree"])
    kin, score = _winners(fitted, "", names, ids, of, n)
    lang = np.full(n, "und", dtype=object)
    for f, (name, own) in enumerate(fitted["tree"].items()):
        rows = np.flatnonzero(kin == f)
        place = np.full(n, -1, np.int32)
        place[rows] = np.arange(len(rows))
        inside = place[of] >= 0
        best, sure = _winners(fitted, name, own, ids[inside], place[of[inside]], len(rows))
        lang[rows] = np.array(own, dtype=object)[best]
        score[rows] *= sure
    return lang, score


def predicted(docs: DataFrame, fitted: dict) -> DataFrame:
    """doc_id, lang_pred and score of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted)

    def run(batches):
        for b in T.slices(batches):
            known = np.flatnonzero(b.column("spoken").to_numpy(zero_copy_only=False)) if shared.value["tree"] else np.zeros(0, np.int64)
            lang, score = np.full(b.num_rows, "und", dtype=object), np.zeros(b.num_rows)
            if len(known):
                lang[known], score[known] = languages(shared.value, b.column("text").take(pa.array(known)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("spoken"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def report(docs: DataFrame) -> DataFrame:
    """One row per document with its language; learned from the languages of documents that are not held out."""
    fitted = model(docs.where(~held_out()))
    return predicted(docs, fitted).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
