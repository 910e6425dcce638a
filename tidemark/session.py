"""One place for the session settings that the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    conf = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
    }
    conf.update({k.replace("__", "."): v for k, v in extra.items()})
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tidemark").config(map=conf)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str):
    """A table of the given folder; only Spark's own reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
