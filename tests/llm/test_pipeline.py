import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline as P
from rasterloom.llm import mixing, quality, queries, session

from .test_decontaminate import brute as leaks
from .test_jaccard import brute as classes
from .test_quality import brute as counts
from .test_tokens import plain

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns = docs.columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    stage = dict(P.STAGES)
    assert [k for k, _ in P.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "mix", "token_blocks"]
    rows = [(r.doc_id, r.text) for r in docs.collect()]

    kept = stage["quality_rules"](spark, docs, SF)
    assert kept.columns == columns
    rules = quality.rules_of(docs, labels)
    want = set()
    for d, t in rows:
        b = counts(t)
        if not (b[0] < 50 or 100 * b[4] > 50 * b[0]):
            want.add(d)
    rejected = {r.doc_id for r in quality.counted(docs).where(quality.expression(rules, lambda k: F.col(f"__counts.{k}"))).collect()}
    assert {r.doc_id for r in kept.collect()} == want - rejected

    once = stage["near_duplicates"](spark, kept, SF)
    own = [(d, t) for d, t in rows if d in want - rejected]
    assert once.columns == columns and sorted(r.doc_id for r in once.collect()) == sorted(d for d, c, *_ in classes(own) if d == c)

    clean = stage["decontamination"](spark, once, SF)
    own = [(r.doc_id, r.text) for r in once.collect()]
    assert clean.columns == columns and sorted(r.doc_id for r in clean.collect()) == sorted(x[0] for x in leaks(own, items) if not x[-1])

    mixed = stage["mix"](spark, clean, SF).cache()
    often, _ = mixing.mixed(clean, queries.labelled_domains(clean, labels), queries.TARGETS)
    assert mixed.columns == columns
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {r.doc_id: r.copies for r in often.collect() if r.copies}

    final = sorted(map(tuple, stage["token_blocks"](spark, mixed, SF).collect()))
    start, want = 0, []
    own = sorted((r.doc_id, r.text) for r in mixed.collect())
    for (d, _), ids in zip(own, plain([t for _, t in own])):
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert final == want and len(final) > 20
    assert sorted(map(tuple, P.run(spark, SF).collect())) == final


CLASHES = ["Hits", "N_Words", "longest", "__doc", "__ROW", "__none", "__counts", "__own___counts", "Posterior", "copies", "set_aside_0"]


def crafted(spark, path, docs, labels, items):
    spark.createDataFrame(docs, "doc_id long, text string, " + ", ".join(f"{c} int" for c in CLASHES)).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_clashing_names_nulls_empty_and_repeated_rows(spark, tmp_path):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(80))
    leaked = " ".join(f"secret{i}" for i in range(12))
    docs = [(i, text(i)) for i in range(12)] + [(20, None), (21, ""), (22, "too short"), (3, text(3)), (None, text(40)), (23, text(2)), (24, text(50) + " " + leaked)]
    sf = crafted(spark, tmp_path, [(d, t, *range(len(CLASHES))) for d, t in docs], [(i, 1, 0) for i in range(12)] + [(3, None, None), (99, 0, 1)], [(1, leaked), (2, None)])
    now = spark.read.parquet(f"{sf}/documents.parquet")
    columns = now.columns
    for name, stage in P.STAGES[:-1]:
        now = stage(spark, now, sf)
        assert now.columns == columns, name
        assert {tuple(r)[2:] for r in now.collect()} == {tuple(range(len(CLASHES)))}, name
    want = set(range(12)) | {None}
    assert {r.doc_id for r in now.collect()} == want
    got = P.run(spark, sf).collect()
    assert {r.doc_id for r in got} == want and len(got) == now.count()


def test_empty_tables(spark, tmp_path):
    text = " ".join(f"word{i}" for i in range(60))
    row = [(1, text, *range(len(CLASHES)))]
    assert [r.doc_id for r in P.run(spark, crafted(spark, tmp_path / "a", row, [], [])).collect()] == [1]
    assert P.run(spark, crafted(spark, tmp_path / "b", [], [(1, 1, 0)], [(1, text)])).count() == 0


def test_batches_of_long_texts_are_bounded_in_every_stage(spark, tmp_path):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    sf = crafted(spark, tmp_path, [(i, "word " * 20_000, *range(len(CLASHES))) for i in range(120)], [], [])
    docs = spark.read.parquet(f"{sf}/documents.parquet").coalesce(1)
    before = spark.conf.get(session.BATCH_SETTING)
    try:
        for name, stage in P.STAGES:
            spark.conf.set(session.BATCH_SETTING, "67108864")
            stage(spark, docs, sf)
            got = docs.select("doc_id", "text").mapInArrow(sizes, "n long, size long").collect()
            assert sum(r.n for r in got) == 120 and max(r.size for r in got) < 5 << 20, name
            spark.conf.set(session.BATCH_SETTING, "1m")
            stage(spark, docs, sf)
            assert spark.conf.get(session.BATCH_SETTING) == "1m", name
    finally:
        spark.conf.set(session.BATCH_SETTING, before)
