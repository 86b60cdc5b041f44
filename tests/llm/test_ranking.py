import math
import random
import re

import pytest

from rasterloom.llm import queries, ranking
from rasterloom.llm.session import stored

from . import oracle

TERM = re.compile("[0-9a-z\u0080-\U0010ffff]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(docs, items, k=10):
    terms = [(d, TERM.findall(lowered(t or ""))) for d, t in docs]
    terms = [(d, ws) for d, ws in terms if ws]
    n_docs, length = len(terms), sum(len(ws) for _, ws in terms)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(TERM.findall(lowered(t or "")))
    out = []
    for i, own in wanted.items():
        rows = []
        for d, ws in terms:
            score = 0
            for t in own:
                df = sum(t in x for _, x in terms)
                if df:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
                    score += w * ((1_000_000_000 * ws.count(t)) // (1000 * ws.count(t) + 8 * (10 + (90 * len(ws) * n_docs) // length)))
            if score > 0:
                rows.append((-score, d is None, d or 0, d))
        out += [(i, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(rows, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


def table(spark, rows, key):
    return spark.createDataFrame(rows, f"{key} long, text string")


def got(df):
    return sorted([tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()], key=repr)


def test_same_as_sql(spark):
    oracle.same(queries.op11_ranked_search(spark, "/root/testdata/sf0.01"), queries.oracle_sql()["op11_ranked_search"], "/root/testdata/sf0.01")


@pytest.mark.parametrize("window", [1, 3, 4096])
def test_brute_force(spark, window):
    rng = random.Random(window)
    words = ["a", "B", "c3", "é", "Straße", "x" * 300, "x" * 299 + "y", "zz", "the"]
    docs = [(rng.randrange(-50, 50), " ".join(rng.choices(words, k=rng.randrange(30)))) for _ in range(70)]
    docs += [(None, "zz the"), (None, "zz the"), (7, None), (8, ""), (9, " .;"), (10, "zz the"), (10, "zz the"), (11, "the " * 70_000)]
    items = [(i, " ".join(rng.choices([*words, "absent"], k=rng.randrange(1, 12)))) for i in range(12)] + [(None, "zz zz"), (20, None), (21, "..."), (22, "zz"), (22, "a zz")]
    indexed = stored(ranking.index(table(spark, docs, "doc_id").repartition(3), window))
    want = brute(docs, items)
    assert got(ranking.search(indexed, table(spark, items, "item_id"))) == want and len(want) > 100
    assert got(ranking.search(indexed, table(spark, items, "item_id"), block_terms=2)) == want
    assert got(ranking.search(indexed, table(spark, items, "item_id"), k=2)) == [r for r in want if r[1] <= 2]


def test_windows_end_early_for_long_texts(spark):
    docs = table(spark, [(i, "word " * 50 + f"own{i}") for i in range(40)], "doc_id").coalesce(1)
    heads = ranking.index(docs, window_bytes=1000).where("term is null")
    assert heads.count() > 3 and heads.agg({"n_docs": "sum"}).first()[0] == 40


def test_hashes_that_meet(spark, monkeypatch):
    monkeypatch.setattr(ranking.T, "hashes", lambda buf, starts, ends, fold: (ends - starts).astype("uint64"))
    window = ranking.pa.table({"doc_id": [2, 1], "text": ["ab cd ab", "cd e"]})
    rows = ranking.pa.Table.from_batches(ranking._inverted(window, 0)).to_pylist()
    assert {r["term"]: r["n_docs"] for r in rows[1:]} == {"ab": 1, "cd": 2, "e": 1} and rows[0]["ids"] == [1, 2]


def test_clashing_names_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 3, 4.0)], "doc_id long, text string, term string, window int, Score double")
    items = spark.createDataFrame([(5, "b", 1, "y")], "item_id long, text string, rank int, Doc_Id string")
    assert got(ranking.report(docs, items)) == brute([(1, "a b")], [(5, "b")])
    assert ranking.report(docs.limit(0), items).count() == 0
    assert ranking.report(docs, items.limit(0)).count() == 0
    assert ranking.report(docs, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
