"""Tables written between jobs, in the folder that the cluster shares."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"

#: Bytes of an Arrow batch that goes to a Python worker, about two slices of text.
BATCH_BYTES, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under spark.checkpoint.dir; where that is unset, a temporary folder if Spark runs in one process."""
    top = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not top:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError(f"{SETTING} must name a folder that the cluster shares")
        top = f"{tempfile.gettempdir()}/rasterloom-shared"
        spark.conf.set(SETTING, top)
    return f"{top.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """The rows, written as Parquet to the shared folder and read back: cuts lineage, survives executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """From now on Arrow batches end at BATCH_BYTES: by rows alone, one of long texts takes tens of MB in the executor and
    again in its worker. A lower bound that the session has stays. Rows are the same, only dealt over more batches."""
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH_SETTING))
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def dropped(spark: SparkSession, df: DataFrame) -> None:
    """Deletes a table that stored() wrote and that no later plan reads."""
    jvm = spark.sparkContext._jvm
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for f in folders:
        p = jvm.org.apache.hadoop.fs.Path(f)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def let_go(spark: SparkSession) -> None:
    """Asks for a collection of what nothing refers to: Spark deletes the files of a shuffle when its plan is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
