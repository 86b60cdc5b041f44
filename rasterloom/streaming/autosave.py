"""Analogues of an editor's autosave and undo history, as streams and as batches. The reference has no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def settled(edits: DataFrame, gap: str = "2 seconds", late: str = "10 minutes") -> DataFrame:
    """key, start, end, n and last: bursts of edits (key, ts, state) that a pause of the gap ends, with the last state.

    Works on a stream, where the watermark lets a burst go once no more of it can come, and on a batch."""
    own = edits.withWatermark("ts", late) if edits.isStreaming else edits
    burst = own.groupBy("key", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.max_by("state", "ts").alias("last"))
    return burst.select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "last")


def history(states: DataFrame, most: int = 100) -> DataFrame:
    """The last states of each key whose digest differs from the one before."""
    w = W.partitionBy("key").orderBy("ts", "id")
    digest = F.sha2(F.col("state").cast("string"), 256)
    changed = states.withColumn("__d", digest).withColumn("__p", F.lag("__d").over(w)).where("__p is null or __p <> __d")
    newest = F.row_number().over(W.partitionBy("key").orderBy(F.col("ts").desc(), F.col("id").desc()))
    return changed.withColumn("__n", newest).where(F.col("__n") <= most).drop("__d", "__p", "__n")


def run_to_table(edits: DataFrame, name: str, checkpoint: str, gap: str = "2 seconds") -> DataFrame:
    """Runs settled() over what the stream holds now and gives the finished bursts, as Parquet in a folder beside the
    checkpoint and as a view of that name."""
    out, path = settled(edits, gap), f"{checkpoint.rstrip('/')}-{name}"
    q = out.writeStream.outputMode("append").format("parquet").queryName(name).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    edits.sparkSession.read.schema(out.schema).parquet(path).createOrReplaceTempView(name)
    return edits.sparkSession.table(name)
