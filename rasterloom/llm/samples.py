"""Bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .session import stored


def texts_of(docs: DataFrame, marked: DataFrame, label: str, rows: int) -> DataFrame:
    """doc_id, row (hash of the text), label and text of at most ``rows`` different texts of marked documents.

    marked: doc_id and label, each pair once and few enough to broadcast. Each pair's first text, by hash, comes before
    the second ones, so no doc_id with many texts keeps others out. Equal rows of docs stay: the caller
    reduces what it makes of them to one per (doc_id, label, row)."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text")
    keys = own.select("doc_id", "row").join(F.broadcast(marked), "doc_id").distinct()
    turn = F.row_number().over(Window.partitionBy("doc_id", label).orderBy("row"))
    picked = keys.withColumn("turn", turn).orderBy("turn", F.xxhash64("doc_id", label), "doc_id", label).limit(rows)
    return own.join(F.broadcast(stored(picked.select("doc_id", "row", label))), ["doc_id", "row"])
