import hashlib
import re
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from rasterloom.llm import decontaminate as D
from rasterloom.llm import queries
from rasterloom.llm import text as T

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    wins = {}
    for i, t in items:
        w = _words(t)
        for k in range(max(1, len(w) - window + 1)) if w else ():
            wins.setdefault(tuple(w[k : k + window]), set()).add(i)
    sizes = {len(k) for k in wins}
    out = []
    for d, t in docs:
        w, hit, found = _words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in wins:
                    hit |= set(range(k, k + n))
                    found |= wins[x]
        ids = ",".join(sorted(map(str, found)))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


COLS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def got(df):
    return sorted((tuple(r[c] for c in COLS) for r in df.collect()), key=repr)


@pytest.mark.parametrize("block", [5, 200_000])
def test_small(spark, block, monkeypatch):
    monkeypatch.setattr(D.matches, "__defaults__", (D.WINDOW, block))
    a = "one two three four five six seven eight nine ten eleven twelve"
    docs = [(1, a), (2, None), (3, ""), (4, "x " + a.upper() + ". Y"), (5, a[4:40] + " É é"), (6, "short item; again SHORT item"), (6, a + " " + a), (7, "ñandú " * 30), (8, "…" + "w" * 5000)]
    items = [(1, a), (10, a), (2, "Short, item"), (3, ""), (4, None), (5, "ñandú " * 12), (6, "w" * 5000)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert got(D.report(d, b)) == brute(docs, items)


def test_longest_and_removal(spark):
    a = " ".join(f"w{i}" for i in range(30))
    d = spark.createDataFrame([(1, "p " + a, "h"), (2, "w3 w4 w5 zz", "g"), (3, None, "g")], "doc_id long, text string, hits string")
    b = spark.createDataFrame([(7, a)], "item_id long, text string")
    r = {x.doc_id: x for x in D.report(d, b).collect()}
    assert (r[1].longest, r[1].longest_item, r[2].longest, r[3].longest) == (30, 7, 3, 0)
    kept = D.decontaminated(d, b)
    assert kept.columns == d.columns and sorted(x.doc_id for x in kept.collect()) == [2, 3]
    assert D.report(d.limit(0), b).count() == 0 and D.report(d, b.limit(0)).where("contaminated").count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert got(D.report(docs, items)) == want
    assert any(x[-1] for x in want)


def test_items_without_id(spark):
    a, b = ([f"{x}{k}" for k in range(14)] for x in "ab")
    docs = [(1, " ".join(["x", *a, "y"])), (2, " ".join(b)), (3, " ".join([*a, *b])), (4, "clean")]
    items = [(None, " ".join(a)), (None, " ".join(a[2:])), (8, " ".join(b)), (None, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    rows = {r.doc_id: r for r in D.report(d, i).collect()}
    eight = hashlib.sha256(b"8").hexdigest()
    assert [(rows[k].n_hit, rows[k].n_items, rows[k].contaminated) for k in (1, 2, 3, 4)] == [(14, 1, True), (14, 1, True), (28, 2, True), (0, 0, False)]
    assert rows[1].items_sha256 == hashlib.sha256(b"").hexdigest() and rows[2].items_sha256 == rows[3].items_sha256 == eight
    assert (rows[1].longest, rows[1].longest_item) == (14, None)
    assert [r.doc_id for r in D.decontaminated(d, i).collect()] == [4]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    assert got(D.report(d, i)) == sorted(con.execute(queries.LEAKS_SQL).fetchall(), key=repr)


def test_blocks_come_one_by_one(spark, monkeypatch):
    made, seen, make, keep = [], [], D.Probes.__init__, D.stored
    monkeypatch.setattr(D.Probes, "__init__", lambda *a: made.append(1) or make(*a))
    monkeypatch.setattr(D, "stored", lambda df: seen.append(len(made)) or keep(df))
    docs = [(k, " ".join(f"w{k}x{j}" for j in range(12))) for k in range(5)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(1)
    i = d.withColumnRenamed("doc_id", "item_id")
    assert {r.doc_id: (len(r.hits), r.hits[0].item_id) for r in D.matches(d, i, block_words=12).collect()} == {k: (1, k) for k in range(5)}
    assert seen == [2, 3, 4, 5]


def test_hashing_needs_a_bounded_part_of_the_words_at_once():
    words = [f"w{i % 5000}" + "x" * (i % 13) for i in range(400_000)]
    text = pa.array([" ".join(words[lo : lo + 777]) for lo in range(0, len(words), 777)])
    tracemalloc.start()
    h, owner, first, n, more = D._sequence(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    buf, off = T.buffer(text)
    starts, ends = T.words(buf, T.ALNUM)
    at = np.flatnonzero(h)
    assert n.sum() == len(at) == len(words) and (h[at] == T.hashes(buf, starts, ends, fold=True)).all()
    assert (more(at) == T.hashes(buf, starts, ends, fold=True, family=1)).all()
    assert peak < 40_000_000
