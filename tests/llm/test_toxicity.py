from rasterloom.llm import toxicity as X


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = X.report(docs, labels).join(labels, "doc_id").where("held_out").collect()
    pos = sorted(r.score for r in rows if r.toxic)
    neg = sorted(r.score for r in rows if not r.toxic)
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    right = sum(r.predicted == r.toxic for r in rows) / len(rows)
    print("auc", auc, "accuracy", right, len(pos), len(neg))
    assert auc > 0.95 and right > 0.93


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b " * 9), (3, "a b " * 9), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (3, 0), (3, None), (9, 1)], "doc_id long, toxic int")
    rows = X.report(docs, labels).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert {r.score for r in X.report(docs, labels.limit(0)).collect()} == {0.5}
    assert X.report(docs.limit(0), labels).count() == 0


def test_other_columns_and_long_texts(spark):
    docs = spark.createDataFrame([(1, "good words " * 200_000, 7, 0.5), (2, "bad words", 8, 0.1)], "doc_id long, text string, label int, score double")
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int")
    plain = {r.doc_id: r.score for r in X.report(docs.select("doc_id", "text"), labels).collect()}
    assert {r.doc_id: r.score for r in X.report(docs, labels).collect()} == plain and len(plain) == 2
