"""Tables written in between, in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local session does without, in a folder of its machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if spark.conf.get("spark.master", "").split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    import tempfile

    return f"file://{tempfile.gettempdir()}/checkpoints"


def new_folder(spark: SparkSession) -> str:
    """A folder of its own for one computation; it goes when the application ends."""
    path = f"{shared_dir(spark)}/tidemark/{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write a table and read it again: what it took is computed once, and a lost executor costs a read."""
    path = f"{new_folder(df.sparkSession)}/{tag}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
