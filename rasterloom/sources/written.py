"""Tables that iterations write between jobs, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, a temporary one if Spark is one process."""
    top = spark.conf.get(SETTING, None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{SETTING} must name a folder that the cluster shares")
        top = f"{tempfile.gettempdir()}/rasterloom-shared"
        spark.conf.set(SETTING, top)
    return f"{top.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """The rows, written as Parquet and read back; the table that they replace is deleted."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    if instead_of is not None:
        removed(instead_of)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(table: DataFrame) -> None:
    """Deletes a written table that no later plan reads."""
    sc = table.sparkSession.sparkContext
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
