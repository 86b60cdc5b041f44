import numpy as np
from pyspark.sql import functions as F

from rasterloom.llm import mixing as M
from rasterloom.llm import quality, queries, toxicity
from rasterloom.llm.samples import texts_of

TARGETS = {"en": 0.4, "de": 0.3, "fr": 0.2, "es": 0.1}


def test_targets_and_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id")
    labelled = docs.join(labels, "doc_id").select("doc_id", F.col("lang").alias("label"))
    out, reached = M.mixed(docs, labelled, TARGETS)
    rows = out.join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    p = np.stack(rows.posterior)
    want = np.array([TARGETS[d] for d in reached["domains"]])
    weight = (rows.n_tokens * rows.rate).to_numpy()
    got = (weight[:, None] * p).sum(0)
    assert abs(got.sum() / rows.n_tokens.sum() - 1) < 2e-3 and np.abs(got / rows.n_tokens.sum() - want).max() < 1e-3
    assert (rows.rate >= 0).all() and ((rows.copies - rows.rate).abs() < 1).all()
    unseen = rows[~rows.doc_id.isin([r.doc_id for r in labels.collect()])]
    right = np.array(reached["domains"])[np.stack(unseen.posterior).argmax(1)] == unseen.lang
    assert right.mean() > 0.9
    # the same by plain projected gradient on the same posteriors, with the penalty of the objective
    n = rows.n_tokens.to_numpy()
    def cost(r): return (((n * r)[:, None] * p).sum(0) / n.sum() - want) @ (((n * r)[:, None] * p).sum(0) / n.sum() - want)
    r = np.ones(len(n))
    for _ in range(3000):
        gap = ((n * r)[:, None] * p).sum(0) / n.sum() - want
        r = np.maximum(0, r - 0.5 * (p @ gap))
    assert cost(rows.rate.to_numpy()) < cost(r) + 1e-6 and np.abs(r - rows.rate.to_numpy()).max() < 0.2
    taken = M.taken(docs, labelled, TARGETS)
    assert taken.columns == docs.columns
    assert {r.doc_id: r["count"] for r in taken.groupBy("doc_id").count().collect()} == {int(d): int(c) for d, c in zip(rows.doc_id, rows.copies) if c}


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "a b " * 9, 3), (3, "a b " * 9, 3), (None, "x", 4), (4, "c d " * 20, 5)], "doc_id long, text string, rate int")
    labelled = spark.createDataFrame([(3, "A"), (4, "B"), (4, None), (None, "A"), (9, "B"), (4, "B")], "doc_id long, label string")
    rows = M.report(docs, labelled, {"A": 0.5, "B": 0.5}).collect()
    assert len(rows) == 6 and all(r.rate >= 0 for r in rows) and {r.rate for r in rows if not r.n_tokens} == {1.0}
    assert M.taken(docs, labelled, {"A": 1.0}).columns == docs.columns
    assert {r.copies for r in M.report(docs, labelled.limit(0), {}).collect()} == {1}
    assert M.report(docs.limit(0), labelled, {"A": 1.0}).count() == 0


def test_repeated_rows_teach_once(spark):
    """A repeated labelled row changes neither the sample nor the fit, and keeps no other domain out of it."""
    docs = spark.createDataFrame([(1, "a b c " * 9), (2, "d e f " * 9), (3, "g h i " * 9)], "doc_id long, text string")
    labelled = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "doc_id long, label string")
    names, w = M.classifier(docs, labelled, 4)
    many = docs.unionByName(docs.where("doc_id = 1").crossJoin(spark.range(50)).drop("id")).repartition(3)
    again, v = M.classifier(many, many.select("doc_id").join(labelled, "doc_id"), 4)
    assert names == again == ["A", "B", "C"] and np.array_equal(w, v)
    # different texts of a doc_id come after the first texts of the others
    texts = spark.range(50).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("a b c "), F.col("id").cast("string")).alias("text"))
    picked = [r.doc_id for r in texts_of(docs.unionByName(texts), labelled, "label", 4).collect()]
    assert sorted(picked) == [1, 1, 2, 3]


def test_repeated_rows_in_other_fits(spark):
    good, bad = "some plain words of prose here " * 3, "## $$ %% && ** bad || "
    docs = spark.createDataFrame([(k, f"{bad if k % 2 else good}{k} {k * 7}") for k in range(80)], "doc_id long, text string")
    labels = docs.select("doc_id", (1 - F.col("doc_id") % 2).cast("int").alias("quality"), (F.col("doc_id") % 2).cast("int").alias("toxic"))
    many = docs.unionByName(docs.where("doc_id = 4").crossJoin(spark.range(500)).drop("id")).repartition(3)
    assert quality.rules_of(docs, labels, 100) == quality.rules_of(many, labels, 100) != []
    for x, y in zip(toxicity.model(docs, labels, 100), toxicity.model(many, labels, 100)):
        assert np.array_equal(x, y)


def test_rare_domain_and_targets_out_of_reach(spark):
    """A domain with few tokens reaches its target in few steps; where no rates do, the fit ends and says what is left."""
    rare = spark.range(400).select(F.lit(100).cast("long").alias("n_tokens"), F.when(F.col("id") < 2, F.expr("array(0.1D, 0.9D)")).otherwise(F.expr("array(0.999D, 0.001D)")).alias("posterior"))
    steps, reached = M.rates(rare, ["A", "B"], {"A": 0.8, "B": 0.2})
    assert len(steps) <= 3 and reached["gap"] <= M.TOLERANCE
    never = rare.withColumn("posterior", F.expr("array(0.6D, 0.4D)"))
    steps, reached = M.rates(never, ["A", "B"], {"A": 0.2, "B": 0.8})
    # with shares 0.6 x and 0.4 x of the total, the squared gaps are least at x = 0.44 / 0.52
    assert len(steps) <= 20 and np.abs(np.array(reached["reached"]) - np.array([0.6, 0.4]) * 0.44 / 0.52).max() < 0.02
    # rates of 0 take part
    mixed = spark.range(300).select(F.lit(10).cast("long").alias("n_tokens"), F.when(F.col("id") < 100, F.expr("array(1D, 0D, 0D)")).when(F.col("id") < 200, F.expr("array(0D, 0.5D, 0.5D)")).otherwise(F.expr("array(0D, 0D, 1D)")).alias("posterior"))
    steps, reached = M.rates(mixed, ["A", "B", "C"], {"A": 0.5, "B": 0.5, "C": 0.0})
    r = [x.r for x in mixed.select(M.rate(steps).alias("r")).collect()]
    # least squares: B's rows at x with (0.5 x - 0.5, 0.5 x), so x = 0.5 of all tokens, rows of C alone at 0
    assert min(r) == 0 and np.abs(np.array(reached["reached"]) - [0.5, 0.25, 0.25]).max() < 0.02


def test_held_out_domains(spark):
    """Of the query's own domains, learned from four fifths of the labelled rows: recognised, and their true shares in the mixture."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    labelled = queries.labelled_domains(docs, labels).toPandas()
    held = labelled.doc_id % 5 == 0
    domains, w = M.classifier(docs, spark.createDataFrame(labelled[~held]))
    truth = spark.createDataFrame(labelled[held])
    scored = M.posteriors(docs.join(truth, "doc_id").select("doc_id", "label", "text"), (domains, w)).drop("text").cache()
    rows = scored.toPandas()
    p = np.stack(rows.posterior)
    top = np.array(domains)[p.argmax(axis=1)]
    caught = {d: float((top[rows.label == d] == d).mean()) for d in domains}
    print(caught)
    assert caught["good"] > 0.98 and caught["plain"] > 0.8 and caught["toxic"] > 0.65
    steps, reached = M.rates(scored, domains, queries.TARGETS)
    rate = scored.select("doc_id", M.rate(steps).alias("rate")).toPandas().set_index("doc_id").rate[rows.doc_id].to_numpy()
    weight = rate * rows.n_tokens.to_numpy()
    shares = {d: weight[rows.label == d].sum() / weight.sum() for d in domains}
    print(shares)
    assert reached["gap"] < 1e-3 and all(abs(shares[d] - queries.TARGETS[d]) < 0.05 for d in domains)
