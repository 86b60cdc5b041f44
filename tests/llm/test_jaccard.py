import random
import re
from itertools import combinations

import pytest

from rasterloom.llm import jaccard as J

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sets(docs):
    out = []
    for d, t in docs:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out.append((d, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    return out


def brute(docs):
    s = sets(docs)
    n = len(s)
    parent, links, texts = list(range(n)), [0] * n, [set() for _ in s]

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = {}
    for k, (_, x) in enumerate(s):
        for g in x:
            index.setdefault(g, []).append(k)
    pairs = {p for ks in index.values() for p in combinations(ks, 2)}
    for a, b in pairs:
        x, y = s[a][1], s[b][1]
        c = len(x & y)
        if 10 * c >= 8 * (len(x) + len(y) - c):
            links[a] += 1
            links[b] += 1
            if x != y:
                texts[a].add(y)
                texts[b].add(x)
            parent[find(a)] = find(b)
    head = {}
    for k, (d, _) in enumerate(s):
        head.setdefault(find(k), []).append(d)
    out = []
    for k, (d, _) in enumerate(s):
        ids = [x for x in head[find(k)] if x is not None]
        out.append((d, min(ids) if ids else None, links[k], len(texts[k]), len(head[find(k)])))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in J.links(df).select("doc_id", "class_id", "n_links", "n_linked_texts", "n_class").collect()), key=repr)


def mutated(rng, words, k):
    w = list(words)
    for _ in range(k):
        w[rng.randrange(len(w))] = f"z{rng.randrange(10**9)}"
    return " ".join(w)


@pytest.mark.parametrize("leaf", [3, 200])
def test_planted(spark, leaf, monkeypatch):
    monkeypatch.setattr(J, "LEAF", leaf)
    monkeypatch.setattr(J, "BLOCK_SETS", 20)
    rng = random.Random(leaf)
    passage = " ".join(f"p{k}" for k in range(40))
    docs, i = [], 0
    for g in range(25):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice((3, 8, 60, 200)))]
        for _ in range(rng.choice((1, 2, 5))):
            docs.append((i, mutated(rng, base, rng.randrange(1 + len(base) // 30)) + (" " + passage if g % 2 else "")))
            i += 1
    hot = [f"h{k}" for k in range(150)]
    docs += [(i + k, mutated(rng, hot, rng.randrange(4))) for k in range(60)]
    docs += [(1000, None), (1001, ""), (1002, "!!"), (None, docs[3][1]), (1003, docs[3][1].upper()), (1003, docs[3][1].upper()), (1004, "one"), (1005, "ONE."), (1006, "one two"), (None, "lonely null"), (1007, "w " * 3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert got(df) == brute(docs)
    kept = {r.doc_id for r in J.deduplicated(df).collect()}
    want = {d for d, c, *_ in brute(docs) if d == c or c is None}
    assert kept == want
    assert J.links(df.limit(0)).count() == 0


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert got(df) == brute([(r.doc_id, r.text) for r in df.collect()])


def test_rows_of_one_id_and_of_none(spark):
    """A copy leaves only itself, not other texts of its doc_id; copies without ids leave too."""
    a, b, c, e = (" ".join(f"{x}{k}" for k in range(60)) for x in "abce")
    docs = [(1, a), (5, a), (5, b), (5, b), (None, a), (None, c), (None, c), (None, c + " more"), (7, e), (7, e.upper()), (None, e), (None, None), (8, ""), (9, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert got(df) == brute(docs)
    kept = [tuple(r) for r in J.deduplicated(df).collect()]
    assert len(kept) == 7 and {(1, a), (5, b), (None, None), (8, ""), (9, "")} < set(kept)
    assert sum(d is None and t in (c, c + " more") for d, t in kept) == 1
    assert sum(d == 7 and t in (e, e.upper()) for d, t in kept) == 1
