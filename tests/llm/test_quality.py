import re
from collections import Counter

from pyspark.sql import functions as F

from rasterloom.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    w = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    wins = Counter(zip(w, w[1:], w[2:]))
    hit = {k + j for k in range(len(w) - 2) if wins[tuple(w[k : k + 3])] > 1 for j in range(3)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit))


COLS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def check(df, docs):
    got = sorted([(r.doc_id, *(r[c] for c in COLS), r.base_failed) for r in df.collect()], key=repr)
    want = []
    for d, t in docs:
        b = brute(t)
        want.append((d, *b, b[0] < 50 or 100 * b[4] > 50 * b[0]))
    assert got == sorted(want, key=repr)


def test_counts(spark):
    docs = [(1, "a b c a b c\n\na b c\n a\na b c"), (2, None), (3, ""), (4, "é " * 60), (5, "\n\n \t"), (6, "x" * 200_000 + " y"), (7, "# *\x0b%\xa0z | <q>"), (7, "# *\x0b%\xa0z | <q>"), (None, " ".join(map(str, range(80))))]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    check(Q.report(d, none), docs)
    clash = d.withColumn("n_words", F.lit("x"))
    assert Q.kept(d.withColumn("__counts", F.lit(1)), none).columns == ["doc_id", "text", "__counts"]
    kept = Q.kept(clash, none)
    assert kept.columns == clash.columns and [r.doc_id for r in kept.collect()] == [None]
    assert Q.report(d.limit(0), none).count() == 0


def test_whole_table_and_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    check(Q.report(docs, labels), [(r.doc_id, r.text) for r in docs.collect()])
    train = labels.where("doc_id % 4 != 0")
    got = Q.report(docs, train).join(labels.where("doc_id % 4 = 0"), "doc_id").collect()
    judged = [r for r in got if not r.base_failed]
    assert sum(r.rejected == (r.quality == 0) for r in judged) / len(judged) > 0.9


def test_texts_without_words_under_rules(spark):
    """Every feature is a quotient; rules that use them meet texts without words."""
    docs = [(k, "a b c " * 40 if k % 2 else " ".join(f"w{k}x{j}" for j in range(120))) for k in range(400)]
    odd = [(1000, None), (1001, ""), (1002, " \n\t\x0b")]
    d = spark.createDataFrame(docs + odd, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(k, 0 if k % 2 else 1) for k, _ in docs] + [(k, 0) for k, _ in odd], "doc_id long, quality int")
    rules = Q.rules_of(d, labels)
    assert rules
    every = [[(f, op, 0.0)] for f in Q.FEATURES for op in (">=", "<=")]
    for r in (rules, every):
        c = Q.counted(d).select("doc_id", "__counts.*").withColumn("rejected", Q.expression(r))
        assert {x.doc_id: x.rejected for x in c.where("doc_id >= 1000").collect()} == {1000: False, 1001: False, 1002: False}
    check(Q.report(d, labels), docs + odd)
    assert not [r for r in Q.report(d, labels).collect() if r.doc_id >= 1000 and (r.kept or not r.base_failed)]
    assert Q.kept(d, labels).where("doc_id >= 1000").count() == 0
