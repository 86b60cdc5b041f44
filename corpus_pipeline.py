"""A training corpus from the documents table, in stages that are each written and read again.

Every stage takes all that its predecessor kept; all but the last return the columns of documents.

Edge cases, as in the operators: null and empty texts fail the base rule of the first stage, and so do texts below 50
words; a null doc_id is kept like others, goes with its class of near copies, and comes first in the token blocks;
repeated rows are one class, of which one row stays; further columns of documents, whatever their names, pass through
all stages but the last; very long texts are worked on alone; an empty table of documents gives no rows, and an empty
table of labels or of the benchmark lets the documents through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rasterloom.llm import decontaminate, jaccard, mixing, quality, queries, tokens
from rasterloom.llm.session import bounded_batches, stored

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor the learned decision list rejects."""
    bounded_batches(spark)
    return quality.kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near duplicates."""
    bounded_batches(spark)
    return jaccard.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    bounded_batches(spark)
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says, so that the domains reach their target weights."""
    bounded_batches(spark)
    labelled = queries.labelled_domains(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mixing.taken(docs, labelled, queries.TARGETS)


def token_blocks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document lies in the written blocks of token ids, read back from them."""
    bounded_batches(spark)
    return tokens.report(docs, TOKENIZER)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mix", mix),
    ("token_blocks", token_blocks),
]

#: No stage but decontamination can be expressed in SQL; tests/llm/test_pipeline.py compares each with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs)
    return docs
