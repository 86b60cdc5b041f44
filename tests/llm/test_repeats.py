import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from rasterloom.llm import repeats as R


def brute(docs):
    seen, out = {}, []
    order = sorted({(d is not None, d or 0, t or "") for d, t in docs}, key=lambda x: (x[0], x[1]))
    res = {}
    for known, d, t in order:
        raw = t.encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 99):
            w = raw[k : k + 100]
            if w in seen:
                gone[k : k + 100] = b"\1" * 100
            else:
                seen[w] = 1
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        res[(known, d, t)] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return sorted([(d, *res[(d is not None, d or 0, t or "")]) for d, t in docs], key=repr)


def got(df):
    return sorted(map(tuple, R.report(df).collect()), key=repr)


@pytest.mark.parametrize("most, size", [(1, 100), (2, 1 << 10), (4096, 1 << 19)])
def test_small(spark, most, size, monkeypatch):
    monkeypatch.setattr(R, "SHARD_CONTEXTS", most)
    monkeypatch.setattr(R, "SHARD_BYTES", size)
    monkeypatch.setattr(R, "BUCKET_BYTES", size)
    monkeypatch.setattr(R, "TASK_BYTES", size)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(5))
    say = lambda n: " ".join(word() for _ in range(n))
    p, q, hot = say(40), say(18), say(30)
    docs = [(k, say(rng.randrange(5, 60)) + hot[: rng.randrange(60, len(hot))] + say(3)) for k in range(40)]
    docs += [(100, p), (101, p), (102, say(9) + p + say(9)), (103, p[:150] + q + p[100:]), (104, q + q + q), (105, None), (106, ""), (107, "x" * 99), (108, "x" * 100), (109, "x" * 101), (110, "y" * 5000 + p), (None, p), (111, p[3:]), (111, p[3:]), (112, "é" * 300), (3, None), (-5, p)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert got(df) == brute(docs)
    assert R.report(df.limit(0)).count() == 0


def longest(p, parts):
    """For each position of p the length of the longest string from there that occurs in a part."""
    return [max(n for n in range(len(p) - i + 1) if any(p[i : i + n] in s for s in parts)) for i in range(len(p))]


@pytest.mark.parametrize("depth, letters", [(100, 2), (5, 3), (12, 2)])
def test_index(depth, letters):
    rng = np.random.default_rng(depth)
    base = bytes(rng.integers(97, 97 + letters, 400).astype(np.uint8))
    parts = []
    for _ in range(40):
        x = int(rng.integers(0, 300))
        part = bytearray(base[x : x + int(rng.integers(1, 168))])
        if rng.random() < 0.5:
            part[int(rng.integers(0, len(part)))] = 122
        parts.append(bytes(part))
    index = R.RunIndex(np.frombuffer(b"".join(parts), np.uint8), np.array([len(p) for p in parts]), depth)
    texts = [bytes(rng.integers(97, 98 + letters, int(rng.integers(1, 30))).astype(np.uint8)) for _ in range(20)] + [base[3:80], parts[0]]
    size = np.array([len(t) for t in texts])
    last = np.cumsum(size)
    none = np.zeros(len(texts), np.int64)
    match, row = index.statistics(np.frombuffer(b"".join(texts), np.uint8).astype(np.int16) + 1, last - size, last, none, none)
    assert match.tolist() == [n for t in texts for n in longest(t, parts)]
    least, seen = index.earliest(), {}
    for k, p in enumerate(parts):
        for i in range(len(p) - depth + 1):
            at = int(index.first[k]) + i
            assert least[at] == seen.setdefault(p[i : i + depth], at)


def test_other_columns(spark):
    rows = [(1, "a" * 300, 7, 1, "x"), (2, "a" * 300, 8, 2, "y")]
    df = spark.createDataFrame(rows, "doc_id int, text string, rk int, doc int, marks string")
    assert got(df) == brute([(r[0], r[1]) for r in rows])


def test_rows_are_handed_on_in_small_batches():
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(97, 123, 40_000).astype(np.uint8)).decode() for _ in range(100)]
    rows = pa.RecordBatch.from_pydict({"doc": list(range(200)), "rk": list(range(200)), "text": texts * 2})
    batches = list(R._phrases(64)(iter([rows])))
    assert max(b.nbytes for b in batches) <= 2 << 20
    cols = R._unpacked([x.as_py() for b in batches for x in b.column("data")])
    first = [x.as_py() >= 0 for b in batches for x, d in zip(b.column("bucket"), b.column("data")) for _ in range(len(d.as_py()) // R._WIDE)]
    assert sum(first) == len(set(cols[0].tolist())) and first.count(False) == first.count(True)
    assert set(cols[4][np.array(first)].tolist()) == set(range(100))


def test_whole_documents_need_one_python_worker_a_task(spark):
    df = spark.createDataFrame([(1, "a" * 300), (2, "b")], "doc_id long, text string")
    plan = R.report(df)._jdf.queryExecution().executedPlan().toString()
    nodes = [n for n in re.findall(r"MapInArrow|Exchange|Union|\w*Scan|RDDScan|Join", plan)]
    assert "MapInArrow" in nodes and ("MapInArrow", "MapInArrow") not in zip(nodes, nodes[1:])


@pytest.mark.parametrize("most", [1, 4096])
def test_rows_of_one_place_do_not_repeat_each_other(spark, most, monkeypatch):
    monkeypatch.setattr(R, "SHARD_CONTEXTS", most)
    rng = random.Random(8)
    say = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = [say(90) for _ in range(30)]  # anchors meet, strings do not
    docs = [(k, say(40).join(shared)) for k in range(1, 4)]
    docs += docs[:2] * 2
    assert got(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)) == brute(docs)


def test_full_filters_mark_nothing_twice(spark, monkeypatch):
    for name in ("ANCHOR_BITS", "PLACE_BITS", "MOST_BITS"):
        monkeypatch.setattr(R, name, 9, raising=False)
    rng = random.Random(9)
    say = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    p = say(2000)
    docs = [(k, p) for k in range(40)] + [(100 + k, p[:1000] + say(20) + p[1000:]) for k in range(5)]
    df = spark.createDataFrame([(d, d, t) for d, t in docs], "doc long, rk long, text string").repartition(4)
    ranges = [tuple(r)[:3] for r in R.marks(df)[0].collect()]
    assert len(ranges) == len(set(ranges))
    assert got(spark.createDataFrame(docs, "doc_id long, text string")) == brute(docs)


def test_other_places_do_not_let_copies_pass(spark, monkeypatch):
    monkeypatch.setattr(R, "PLACE_BITS", 12)
    sent, by_key = [], R._by_key
    monkeypatch.setattr(R, "_by_key", lambda pieces, *more: (sent.append(pieces.count()), by_key(pieces, *more))[1])
    rng = random.Random(10)
    say = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    p, q = say(150), say(150)
    docs = [(0, p + q), (1, p + say(5) + q)] + [(k, p + q) for k in range(2, 300)] + [(k, say(2000)) for k in range(300, 800)]
    R.marks(spark.createDataFrame([(d, d, t) for d, t in docs], "doc long, rk long, text string"))
    assert sum(sent) < 100


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert got(df) == brute([(r.doc_id, r.text) for r in df.collect()])
